"""The registered queries of this subpackage, each over its whole table."""

import public_tokenizers
from pyspark.sql import functions as F

from twoclock.session import kept, scratch_path

from . import (decontam, fixity, licenses, linededup, pieces, quality, search, simhash,
               tokenfile, toxicity, urlfilter, vectors, wordruns)
from .common import bucket_of, table


def _judged(found, modulus, held_out, least):
    fold = F.coalesce(bucket_of(F.col("doc_id"), modulus) == held_out, F.lit(False))
    return found.select("doc_id", fold.alias("held_out"), "score",
                        (F.col("score") >= least).cast("int").alias("predicted"))


def op1_toxicity(spark, sf_dir):
    """Toxicity of every document."""
    found = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return _judged(found, 5, 0, 0.5)


def op2_license_scan(spark, sf_dir):
    """License of every document, its own or of the nearest directory above. A document
    stands at source/lang/doc_id div 64; those of at most three lines are licence files."""
    name = F.when(F.size(F.split("text", "\n")) <= 3, F.lit("LICENSE-")).otherwise(F.lit("text-"))
    folder = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 64).cast("string"))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.concat(folder, F.lit("/"), name, F.col("doc_id")).alias("path"))
    return licenses.scan(docs, carry=["doc_id"]).withColumn("score", F.round("score", 6))


def op3_fixity_audit(spark, sf_dir):
    """Faults of a replica of the WARC records of all pages: in it, the body is altered
    where the md5 of the page_id begins with 00 or 7f, and the last three records are lost."""
    middle = F.floor(F.length("html") / 2).cast("int")
    other = F.when(F.substring("html", middle + 1, F.lit(1)) == "x", "y").otherwise("x")
    rotten = F.concat(F.substring("html", F.lit(1), middle), other,
                      F.substring("html", middle + 2, F.length("html")))
    hit = F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 2).isin("00", "7f")
    both = fixity.archived(table(spark, sf_dir, "pages"),
                           also={"replica": F.when(hit, rotten).otherwise(F.col("html"))})
    both = kept(fixity.with_offsets(both))
    last = both.agg(F.max("position").alias("p")).head()["p"] or 0
    replica = both.where(F.col("position") <= last - 3).drop("digest")
    return fixity.audit(both.drop("replica"), replica.withColumnRenamed("replica", "digest"))


def op4_decontamination(spark, sf_dir):
    """Words of every document inside any benchmark window."""
    return decontam.digest(decontam.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_sentencepiece(spark, sf_dir):
    """Piece ids of every document, decoded again."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.md5(
        F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))
    back = pieces.encode(docs, model, decoded="text")
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids_crc32", "text_md5",
        (F.md5(F.col("text").cast("binary")) == F.col("text_md5")).alias("restored"))


def op6_quality(spark, sf_dir):
    """Quality of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return _judged(quality.scored(docs, model), 4, 2, 0.7)


def op7_embedding_neardup(spark, sf_dir):
    """Links and component of every embedding."""
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_line_dedup(spark, sf_dir):
    """Every document less its later repeated runs of lines, as counts and digest."""
    done = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed",
                       F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op9_token_file(spark, sf_dir):
    """Token ids of every document written to a file and read back."""
    path = scratch_path(spark, "tokens")
    tokenfile.write(table(spark, sf_dir, "documents"), path,
                    public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return tokenfile.read(spark, path)


def op10_simhash(spark, sf_dir):
    """SimHash fingerprint and near-duplicate group of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        "component_id")


def op11_word_runs(spark, sf_dir):
    """Runs of every document's words and what is left of them, some texts made periodic:
    where crc32(doc_id) ends in 0, words from some place on repeat in a short period."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size("__words")
    a = F.pmod(g, F.greatest(n, F.lit(1)))
    p = 1 + F.floor((n - a) / (3 + g % 8))
    words = F.regexp_extract_all("text", F.lit(wordruns.WORD_PATTERN), F.lit(0))
    made = F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda i: F.get(
        F.col("__words"), F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int")))
    periodic = F.coalesce(h % 10 == 0, F.lit(False))
    docs = docs.withColumn("__words", F.when(periodic, words)).withColumn("text", F.when(
        n > 0, F.array_join(made, " ")).otherwise(F.col("text"))).drop("__words")
    found = wordruns.runs(docs)
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"),
        (-r["period"]).alias("period"))))
    found = found.withColumn("best", best)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_lexical_search(spark, sf_dir):
    """The 20 documents that rank highest for each benchmark item."""
    return search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The rules of op13, as its contract lists them.
URL_RULES = [
    urlfilter.Rule("allow", "com"), urlfilter.Rule("block", "example.com", "/en/"),
    urlfilter.Rule("allow", "www.example.com", "/en/"),
    urlfilter.Rule("block", "net", "/es/"), urlfilter.Rule("block", "net", "/fr/")]


def op13_url_filter(spark, sf_dir):
    """Verdict on the url of every page."""
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES)


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_license_scan": op2_license_scan,
    "op3_fixity_audit": op3_fixity_audit,
    "op4_decontamination": op4_decontamination,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_quality": op6_quality,
    "op7_embedding_neardup": op7_embedding_neardup,
    "op8_line_dedup": op8_line_dedup,
    "op9_token_file": op9_token_file,
    "op10_simhash": op10_simhash,
    "op11_word_runs": op11_word_runs,
    "op12_lexical_search": op12_lexical_search,
    "op13_url_filter": op13_url_filter,
}

_LOWER = ("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          "'abcdefghijklmnopqrstuvwxyz')")
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP4 = f"""
with item as (select item_id, {_WORDS} w from benchmark),
doc as materialized (select doc_id, {_WORDS} w from documents),
sized as (select item_id, w, least(10, len(w)) n from item where len(w) > 0),
spots as (select item_id, w, n, unnest(range(1, len(w) - n + 2)) i from sized),
pattern as materialized (
    select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') k from spots),
lengths as (select distinct n from pattern),
places as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i
           from doc, lengths where len(w) >= n),
cut as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') k from places),
found as materialized (select doc_id, c.n, i, item_id from cut c join pattern p
                       on c.n = p.n and c.k = p.k),
covered as (select doc_id, count(distinct word) n_hit from
            (select doc_id, unnest(range(i, i + n)) word from found) group by doc_id),
items as (select doc_id, count(*) n_items, string_agg(id, ',' order by id) ids from
          (select distinct doc_id, cast(item_id as varchar) id from found) group by doc_id)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit,
       cast(coalesce(n_items, 0) as bigint) n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from doc left join covered using (doc_id) left join items using (doc_id)
"""

_NOTICES = ", ".join("('{}', {}, '{}')".format(name, rank, notice.replace("'", "''"))
                     for rank, (name, notice) in enumerate(licenses.TEMPLATES))
_OP2 = rf"""
with d as materialized (
    select doc_id, lower(text) t, source || '/' || lang || '/' || cast(doc_id // 64 as varchar) folder,
           case when len(string_split(text, chr(10))) <= 3 then 'LICENSE-' else 'text-' end
           || cast(doc_id as varchar) file from documents),
n as (select count(*) n from d),
notice(license, rank, words) as (values {_NOTICES}),
tw as (select license, rank, term, count(*) tf from
       (select license, rank, unnest(regexp_split_to_array(lower(words), '[^a-z0-9]+')) term
        from notice) where term <> '' group by all),
dw as materialized (select doc_id, unnest(list_distinct(
       regexp_split_to_array(t, '[^a-z0-9]+'))) term from d),
df as (select v.term, count(doc_id) c from (select distinct term from tw) v
       left join dw on dw.term = v.term group by v.term),
idf as materialized (select term, ln((n + 1) / (c + 1)) + 1 w from df, n),
raw as (select license, rank, term, tf * w v from tw join idf using (term)),
unit as materialized (select license, rank, term, v / sqrt(sum(v * v) over (partition by license)) u from raw),
part as (select doc_id, 0 pos, t passage from d union all
         select doc_id, unnest(range(1, len(s) + 1)), unnest(s) from
         (select doc_id, string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)) s from d)),
pw as materialized (select doc_id, pos, term, count(*) tf from (select doc_id, pos,
       unnest(regexp_split_to_array(passage, '[^a-z0-9]+')) term from part)
       where term <> '' group by all),
pv as (select doc_id, pos, pw.term, tf * coalesce(w, ln((select n from n) + 1) + 1) v
       from pw left join idf on idf.term = pw.term),
size as (select doc_id, pos, sqrt(sum(v * v)) norm from pv group by all),
cosine as (select doc_id, pos, license, rank, sum(v * u) dot from pv join unit using (term) group by all),
scored as (select doc_id, license, rank, round(dot / norm, 9) score from cosine join size using (doc_id, pos)),
own as materialized (select doc_id, license, score from scored where score >= 0.8 qualify row_number()
       over (partition by doc_id order by score desc, rank) = 1),
spoken as (select folder place, license, score, folder || '/' || file from_path from own join d using (doc_id)
           where file like 'LICENSE-%' qualify row_number() over (partition by folder
           order by score desc, license, folder || '/' || file) = 1),
up as (select doc_id, folder place, 3 depth from d union all
       select doc_id, regexp_extract(folder, '^(.*)/[^/]*$', 1), 2 from d union all
       select doc_id, regexp_extract(folder, '^([^/]*)/', 1), 1 from d union all select doc_id, '', 0 from d),
near as (select doc_id, license, score, from_path from up join spoken using (place)
         qualify row_number() over (partition by doc_id order by depth desc) = 1)
select folder || '/' || file path, d.doc_id, coalesce(o.license, i.license) license,
       round(coalesce(o.score, i.score), 6) score,
       case when o.license is not null then 'own' when i.license is not null then 'inherited' else 'none' end origin,
       case when o.license is null then i.from_path end from_path
from d left join own o on o.doc_id = d.doc_id left join near i on i.doc_id = d.doc_id
"""

_CRLF = "chr(13) || chr(10)"
_OP3 = f"""
with p as (select page_id, strlen('WARC/1.0' || {_CRLF} || 'WARC-Type: response' || {_CRLF}
           || 'WARC-Target-URI: ' || coalesce(url, '') || {_CRLF} || 'WARC-Record-ID: <urn:page:'
           || page_id || '>' || {_CRLF} || 'Content-Length: ' || strlen(coalesce(html, ''))
           || {_CRLF} || {_CRLF} || coalesce(html, '') || {_CRLF} || {_CRLF}) length,
           row_number() over (order by page_id) - 1 as position, count(*) over () n,
           substr(md5(cast(page_id as varchar)), 1, 2) in ('00', '7f') hit from pages),
placed as (select *, position // 4096 archive, coalesce(sum(length) over (partition by position // 4096
           order by position rows between unbounded preceding and 1 preceding), 0) start from p)
select position, cast(archive as bigint) archive, page_id, cast(start as bigint) "offset",
       cast(length as bigint) length, case when position >= n - 3 then 'missing' else 'altered' end fault
from placed where hit or position >= n - 3
"""

_OP8 = r"""
with line as materialized (
    select doc_id, unnest(string_split(text, chr(10))) body,
           generate_subscripts(string_split(text, chr(10)), 1) - 1 n from documents),
cut as (select doc_id, n, regexp_extract_all(body, '[^ \t\r\x0b\x0c]+') w from line),
worded as materialized (
    select doc_id, n, array_to_string(w, ' ') norm,
           row_number() over o k, sum(len(w)) over o upto, sum(len(w)) over o - len(w) before
    from cut where len(w) > 0 window o as (partition by doc_id order by n)),
ahead as (select a.doc_id, a.k, b.k j from (select *, before + 10 want from worded) a
          asof join worded b on a.doc_id = b.doc_id and a.want <= b.upto),
back as (select a.doc_id, b.k, a.k j from (select *, upto - 10 want from worded) a
         asof join worded b on a.doc_id = b.doc_id and a.want >= b.before),
span as (select * from ahead union select * from back),
listed as (select doc_id, list(norm order by k) norms, list(n order by k) ns from worded group by doc_id),
place as materialized (
    select doc_id, ns[k] first, ns[j] last, array_to_string(norms[k:j], chr(10)) run
    from span join listed using (doc_id)),
kept as (select run, min(row(doc_id, first, last)) p from place group by run),
later as (select doc_id, case when doc_id = p[1] then greatest(first, p[3] + 1) else first end first, last
          from place join kept using (run) where (doc_id, first) <> (p[1], p[2])),
gone as (select distinct l.doc_id, w.n from later l join worded w
         on w.doc_id = l.doc_id and w.n between l.first and l.last),
flagged as (select line.doc_id, line.n, body, w.n is not null worded, g.n is not null gone
            from line left join worded w on (w.doc_id, w.n) = (line.doc_id, line.n)
            left join gone g on (g.doc_id, g.n) = (line.doc_id, line.n)),
around as (select *, last_value(case when worded then gone end ignore nulls) over (partition by doc_id
           order by n rows between unbounded preceding and current row) above,
           first_value(case when worded then gone end ignore nulls) over (partition by doc_id
           order by n rows between current row and unbounded following) below from flagged),
judged as (select doc_id, n, body, case when worded then gone else coalesce(above and below, false) end gone
           from around)
select doc_id, count(*) n_lines, count(*) filter (gone) n_removed,
       md5(coalesce(string_agg(body, chr(10) order by n) filter (not gone), '')) text_md5
from judged group by doc_id
"""

_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(
    string_split(cast(doc_id as varchar), ''), lambda c: ascii(c)::bigint)), lambda r, b:
    list_reduce(list_prepend(xor(r, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, y:
    case when x % 2 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end)))"""

_OP11 = rf"""
with d as (select doc_id, {_CRC32} h, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) w
           from documents),
g as (select *, h // 10 g, len(w) n from d),
made as materialized (select doc_id, n, case when h % 10 = 0 and n > 0 then list_transform(range(n), lambda i:
         w[1 + case when i < g % n then i
             else g % n + (i - g % n) % (1 + (n - g % n) // (3 + g % 8)) end]) else w end w from g),
word as (select doc_id, unnest(range(n)) i, unnest(w) v from made),
same as (select a.doc_id, a.i, b.i - a.i q from word a join word b
         on a.doc_id = b.doc_id and a.v = b.v and a.i < b.i),
island as (select doc_id, q, min(i) s, count(*) + q as length from
           (select *, i - row_number() over (partition by doc_id, q order by i) k from same)
           group by doc_id, q, k having count(*) + q >= greatest(12, 2 * q)),
run as materialized (select doc_id, s, length, min(q) q from island group by all),
best as (select doc_id, s, length, q, row_number() over (partition by doc_id order by length desc, s, q) k,
         count(*) over (partition by doc_id) n_runs from run),
listed as (select doc_id, string_agg(s || ',' || length || ',' || q || chr(10), '' order by s, q) runs
           from run group by doc_id),
gone as (select distinct doc_id, unnest(range(s + q, s + length)) i from run),
left_over as (select doc_id, string_agg(v, ' ' order by i) words from word anti join gone
              using (doc_id, i) group by doc_id)
select doc_id, cast(coalesce(n_runs, 0) as bigint) n_runs, cast(s as bigint) as start,
       cast(length as bigint) length, cast(q as bigint) period,
       cast(1000 * length // q as bigint) exponent_milli, sha256(coalesce(runs, '')) runs_sha256,
       sha256(coalesce(words, '')) collapsed_sha256
from made left join (select * from best where k = 1) using (doc_id) left join listed using (doc_id)
     left join left_over using (doc_id)
"""

_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_OP12 = rf"""
with doc as materialized (select doc_id, {_TERMS} t from documents),
size as (select count(*) docs, sum(len(t)) words from doc where len(t) > 0),
post as materialized (select doc_id, n, t, count(*) tf from
        (select doc_id, len(t) n, unnest(t) t from doc) group by all),
df as (select t, count(*) df from post group by t),
ask as (select item_id, t, count(*) r from (select distinct item_id, text from benchmark),
        unnest({_TERMS}) u(t) group by all),
weighed as (select item_id, t, r * cast(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) as bigint) w
            from ask join df using (t), size),
found as (select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 12 *
          (75 + (25 * n * docs) // words)))) as bigint) score
          from weighed join post using (t), size group by all)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) rank,
       doc_id, score from found where score > 0 qualify rank <= 20
"""

ORACLES = {
    "op11_word_runs": _OP11,
    "op12_lexical_search": _OP12,
    "op8_line_dedup": _OP8,
    "op2_license_scan": _OP2,
    "op3_fixity_audit": _OP3,
    "op4_decontamination": _OP4,
}
