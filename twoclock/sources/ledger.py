"""A ledger of what was appended, to prove later that it still is there, unchanged.

Comparing a log with an earlier copy of itself reads both. The ledger holds, for every
file and slot, how many rows there are and a digest of them that does not depend on their
order: the sums of four parts of each row's SHA-256. Sealing reads files that are not in
the ledger yet; a proof reads the ledger, the list of files, and those whose size or time
changed (or, asked to be thorough, all).
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .log import read_claims

_SHAPE = ("file string, length long, modified timestamp, slot string, rows long, "
          "part0 decimal(38,0), part1 decimal(38,0), part2 decimal(38,0), part3 decimal(38,0)")
PARTS = ["part0", "part1", "part2", "part3"]


def row_text(df, columns=None):
    """One text for a row: its columns by name, NULL told apart from any value."""
    fields = []
    for f in sorted((f for f in df.schema if columns is None or f.name in columns),
                    key=lambda f: f.name):
        col = F.col(f"`{f.name}`")
        if f.dataType.typeName().startswith("timestamp"):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        fields.append(F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit("")))
    return F.concat_ws("|", *fields)


def multiset(df, *by, columns=None) -> DataFrame:
    """Rows and digest of each group: equal for the same rows in any order and number of
    files, different if one is changed, lost or repeated. A part has 60 bits; its sum is
    kept as three of 20 bits each, which are whole numbers that 8 * 10^12 rows do not fill,
    and put together once a group."""
    held = df.withColumn("_digest", F.sha2(row_text(df, columns), 256)).select(*by, *[
        F.conv(F.substring("_digest", 1 + 15 * k, 15), 16, 10).cast("long").alias(f"_{part}")
        for k, part in enumerate(PARTS)])
    names = held.columns[:-len(PARTS)]
    sums = held.groupBy(*[F.col(f"`{n}`") for n in names]).agg(
        F.count(F.lit(1)).alias("rows"), *[
            F.sum(F.shiftright(f"_{part}", 20 * n).bitwiseAND(F.lit((1 << 20) - 1)))
            .alias(f"_{part}{n}") for part in PARTS for n in range(3)])
    return sums.select(*[F.col(f"`{n}`") for n in names], "rows", *[
        reduce(lambda a, b: a + b, [F.col(f"_{part}{n}").cast("decimal(20,0)")
                                    * F.lit(1 << 20 * n).cast("decimal(14,0)") for n in range(3)])
        .cast("decimal(38,0)").alias(part) for part in PARTS])


def _plain(path):
    return F.regexp_replace(path, r"^([a-z0-9]+):/+", r"$1:/")


def _files(spark, log_path):
    """(file, length, modified) of the log; no file is opened."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.parquet").load(log_path)
            .select(_plain("path").alias("file"), "length",
                    F.col("modificationTime").alias("modified")))


def _digests(spark, log_path, files, claims_of=None):
    """Ledger rows of some files (file, length, modified), which alone are read."""
    names = [r["file"] for r in files.select("file").collect()]
    if not names:
        return spark.createDataFrame([], _SHAPE)
    held = spark.read.option("basePath", log_path).parquet(*names).select(
        "*", _plain("_metadata.file_path").alias("_file"))
    if claims_of is not None:
        held = claims_of(held)
    held = held.withColumn("slot", F.col("slot").cast("string"))
    columns = [c for c in held.columns if c != "_file"]
    rows = multiset(held, F.col("_file").alias("file"), "slot", columns=columns)
    return files.join(rows, "file").select("file", "length", "modified", "slot", "rows", *PARTS)


def read_ledger(spark, ledger_path) -> DataFrame:
    where = spark._jvm.org.apache.hadoop.fs.Path(ledger_path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], _SHAPE)
    return spark.read.schema(_SHAPE).parquet(ledger_path)


def seal(spark, log_path, ledger_path, claims_of=None) -> DataFrame:
    """Adds the files that the ledger does not hold yet; returns the ledger. Sealing again
    adds nothing. Where files hold rows that claims are made from, `claims_of` makes them,
    and hands on the column `_file` of each row."""
    known = read_ledger(spark, ledger_path).select("file").distinct()
    fresh = _files(spark, log_path).join(known, "file", "left_anti")
    _digests(spark, log_path, fresh, claims_of).write.mode("append").parquet(ledger_path)
    return read_ledger(spark, ledger_path)


def prove(spark, log_path, ledger_path, thorough=False, claims_of=None) -> DataFrame:
    """(file, slot, finding) for everything sealed that is not in the log as it was, empty
    if all is: `lost` files, and `altered` ones, in which rows of a slot were changed, lost
    or repeated. New files are `unsealed`, or `repeated` where one has just the rows of a
    sealed file. Unless `thorough`, a file of the sealed size and time is taken as it is."""
    ledger, files = read_ledger(spark, ledger_path), _files(spark, log_path)
    sealed = ledger.select("file", "length", "modified").distinct()
    lost = ledger.join(files.select("file"), "file", "left_anti").select(
        "file", "slot", F.lit("lost").alias("finding"))
    there = files.join(sealed.withColumnsRenamed({"length": "_length", "modified": "_modified"}),
                       "file", "left")
    doubted = there.where("_length is not null").where(
        "true" if thorough else "length <> _length or modified <> _modified")
    now = _digests(spark, log_path, doubted.select("file", "length", "modified"),
                   claims_of)
    both = ledger.join(doubted.select("file"), "file", "left_semi").select(
        "file", "slot", "rows", *PARTS)
    altered = (both.exceptAll(now.select(*both.columns)).select("file", "slot")
               .unionByName(now.select(*both.columns).exceptAll(both).select("file", "slot"))
               .distinct().withColumn("finding", F.lit("altered")))
    fresh = _digests(spark, log_path, there.where("_length is null").select(*files.columns),
                     claims_of)
    known = ledger.select("slot", "rows", *PARTS).distinct().withColumn("_known", F.lit(True))
    fresh = fresh.join(known, ["slot", "rows", *PARTS], "left").select(
        "file", "slot", F.when(F.col("_known"), "repeated").otherwise("unsealed").alias("finding"))
    return lost.unionByName(altered).unionByName(fresh)


def slot_digests(spark, log_path) -> DataFrame:
    """Rows and digest of every slot of a log, however it is cut into files."""
    return multiset(read_claims(spark, log_path), "slot")
