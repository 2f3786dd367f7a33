import os
import shutil

from pyspark.sql import functions as F

from twoclock.sources import append_claims, read_claims
from twoclock.sources.ledger import multiset, prove, read_ledger, seal, slot_digests


def findings(spark, log, ledger, **how):
    return sorted((r["slot"], r["finding"]) for r in prove(spark, log, ledger, **how).collect())


def files_of(log, slot):
    return sorted(os.path.join(d, f) for d, _, fs in os.walk(f"{log}/slot={slot}") for f in fs
                  if f.endswith(".parquet"))


def test_tampered_lost_and_repeated_rows_are_found(claims, spark, tmp_path):
    log, ledger = f"{tmp_path}/log", f"{tmp_path}/ledger"
    rows = [(f"s{k}", slot, None if k == 3 else f"v{k}", "2026-01-01", "2026-01-02", None)
            for k in range(20) for slot in ("a", "b", "c", "d")]
    append_claims(claims(rows), log)
    first = seal(spark, log, ledger).count()
    assert seal(spark, log, ledger).count() == first == 4
    assert findings(spark, log, ledger) == findings(spark, log, ledger, thorough=True) == []

    more = claims([*rows, ("t", "a", "new", "2026-01-03", "2026-01-03", None)]).where("seq > 80")
    append_claims(more, log)
    assert findings(spark, log, ledger) == [("a", "unsealed")]
    assert seal(spark, log, ledger).count() == 5

    def rewritten(slot, change):
        """A file of a slot with other rows in its place."""
        path = files_of(log, slot)[0]
        change(spark.read.parquet(path)).coalesce(1).write.parquet(f"{tmp_path}/new-{slot}")
        new = next(f for f in os.listdir(f"{tmp_path}/new-{slot}") if f.endswith(".parquet"))
        os.remove(os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc"))
        shutil.copy(f"{tmp_path}/new-{slot}/{new}", path)

    rewritten("b", lambda df: df.withColumn("value", F.when(F.col("subject") == "s5", "x")
                                            .otherwise(F.col("value"))))
    rewritten("c", lambda df: df.unionByName(df.where("subject = 's7'")))
    os.remove(files_of(log, "d")[0])
    extra = files_of(log, "a")[0]
    shutil.copy(extra, extra.replace("part-", "part-9"))
    want = [("a", "repeated"), ("b", "altered"), ("c", "altered"), ("d", "lost")]
    assert findings(spark, log, ledger) == findings(spark, log, ledger, thorough=True) == want


def test_a_change_that_keeps_size_and_time_is_found_when_thorough(claims, spark, tmp_path):
    log, ledger = f"{tmp_path}/log", f"{tmp_path}/ledger"
    append_claims(claims([("s", "a", "v", "2026-01-01", "2026-01-02", None)]), log)
    seal(spark, log, ledger)
    held = read_ledger(spark, ledger).withColumn("part1", F.col("part1") + 1).collect()
    spark.createDataFrame(held, read_ledger(spark, ledger).schema).write.mode("overwrite") \
        .parquet(f"{tmp_path}/other")
    assert findings(spark, log, f"{tmp_path}/other") == []
    assert findings(spark, log, f"{tmp_path}/other", thorough=True) == [("a", "altered")]


def test_digests_do_not_depend_on_order_or_files(claims, spark, tmp_path):
    rows = [(f"s{k % 7}", "p", f"v{k}", "2026-01-01", "2026-01-02", None) for k in range(50)]
    log = claims(rows)
    append_claims(log.where("seq % 3 = 0"), f"{tmp_path}/log")
    append_claims(log.where("seq % 3 <> 0"), f"{tmp_path}/log")
    whole = multiset(log, "slot").collect()
    assert slot_digests(spark, f"{tmp_path}/log").collect() == whole
    assert multiset(log.repartition(5), "slot").collect() == whole
    assert multiset(log.unionByName(log.limit(1)), "slot").collect() != whole
    assert read_claims(spark, f"{tmp_path}/log").count() == 50


def test_parts_are_summed_exactly_as_whole_numbers(spark):
    import hashlib
    df = spark.createDataFrame([("a", "1"), ("a", None), ("b", "3"), ("a", "1")],
                               "slot string, value string")
    texts = [("a", "=a|=1"), ("a", "=a|"), ("b", "=b|=3"), ("a", "=a|=1")]
    found = {r["slot"]: r for r in multiset(df, "slot").collect()}
    for slot in "ab":
        digests = [hashlib.sha256(t.encode()).hexdigest() for s, t in texts if s == slot]
        assert found[slot]["rows"] == len(digests)
        assert [int(found[slot][f"part{k}"]) for k in range(4)] == [
            sum(int(d[15 * k:15 * k + 15], 16) for d in digests) for k in range(4)]
    plan = multiset(df, "slot")._jdf.queryExecution().executedPlan().toString()
    partial = next(line for line in plan.splitlines() if "partial_sum" in line)
    assert "decimal" not in partial
