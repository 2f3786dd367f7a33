import hashlib
import math
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twoclock.llm import fixity, licenses, pieces, tokenfile, vectors
from twoclock.session import kept

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "a", "  two  spaces ", "Été à 1.5\n\n\tx'll", "▁ literal ▁▁ mark",
         "日本語 ① 　wide nbsp", "word " * 3000, "x" * 5000, "a\r\n b\n c  \n",
         "same", "same", "emoji 👩‍👩‍👧 and ́ marks"]


def vector_frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, node string")


@pytest.mark.parametrize("group", [5, 64, 4096])
def test_vector_links_match_brute_force(spark, group):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 12))
    near = base[rng.integers(0, 12, 60)] + rng.normal(size=(60, 12)) * 0.15
    x = np.concatenate([base, near, base[:3] * 2.5, base[:5], base[:5]]).astype(np.float32)
    rows = [(3 * k + 1, v.tolist(), "n") for k, v in enumerate(x)]
    bad = [None, [], [0.0] * 12, [float("nan")] + [1.0] * 11, [float("inf")] + [1.0] * 11,
           [None] + [1.0] * 11]
    rows += [(1000 + k, v, "n") for k, v in enumerate(bad)] + [(2000, [1.0, 2.0], "n"),
                                                               (2001, [1.0, 2.0], "n"),
                                                               (None, rows[0][1], "n")]
    got = {r["vec_id"]: r for r in
           vectors.near_duplicates(vector_frame(spark, rows), group=group).collect()}
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    least = np.arange(len(u))
    for _ in u:
        least = np.minimum(least, np.where(linked, least[None, :], len(u)).min(axis=1))
    for k in range(len(u)):
        r = got[3 * k + 1]
        assert (r["n_links"], r["component_id"]) == (linked[k].sum(), 3 * least[k] + 1)
        assert r["kept"] == (r["vec_id"] == r["component_id"])
    for k in range(len(bad)):
        assert tuple(got[1000 + k])[1:] == (0, 1000 + k, True)
    assert got[2001]["component_id"] == 2000 and got[2000]["n_links"] == 1
    assert tuple(got[None]) == (None, 0, None, True)


def test_vectors_of_an_empty_table(spark):
    assert vectors.near_duplicates(vector_frame(spark, [])).count() == 0


def test_elias_fano_round_trip():
    rng = random.Random(2)
    for n, top in [(0, 0), (1, 0), (1, 9), (5, 3), (200, 200), (500, 10 ** 9), (129, 10 ** 15)]:
        values = sorted(rng.randint(0, top) for _ in range(n))
        code = tokenfile.EliasFano(data := tokenfile.EliasFano.pack(values))
        assert code.all().tolist() == values == [code.select(i) for i in range(n)]
        if n >= 500:
            assert len(data) * 8 < n * (3 + math.log2(top / n)) + 32 * n / 64 + 500


@pytest.mark.parametrize("block_tokens", [1, 300, 1 << 20])
def test_token_file_matches_the_tokenizer(spark, tmp_path, block_tokens):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(BYTE_BPE)
    rows = [(7 * (k % 9) - 20, t) for k, t in enumerate(TEXTS)]
    rows = [(r[0] + 1000 * (k // 9), r[1]) for k, r in enumerate(rows)] + [(None, "no id")]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int")
    tokenfile.write(docs, str(tmp_path / "t"), BYTE_BPE, block_tokens=block_tokens)
    got = {r["doc_id"]: r for r in tokenfile.read(spark, str(tmp_path / "t")).collect()}
    base = 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        assert tuple(got[i])[1:] == (base, len(ids), zlib.crc32(ids.tobytes()))
        base += len(ids)
    blocks = spark.read.parquet(str(tmp_path / "t")).orderBy("part", "block").collect()
    some = [tokenfile.ids_of(b, k).tolist() for b in blocks for k in range(b["n_docs"])]
    assert some[0] == [*whole.encode("no id").ids, 2] and len(some) == len(rows)


def test_token_file_of_an_empty_table_and_repeated_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, None)], "doc_id long, text string")
    tokenfile.write(docs.limit(0), str(tmp_path / "none"), BYTE_BPE)
    assert tokenfile.read(spark, str(tmp_path / "none")).count() == 0
    tokenfile.write(docs, str(tmp_path / "some"), BYTE_BPE)
    got = tokenfile.read(spark, str(tmp_path / "some")).orderBy("start").collect()
    assert sorted(r["n_tokens"] for r in got) == [1, 3, 3]
    assert [r["start"] for r in got] == [0, got[0]["n_tokens"], 7 - got[2]["n_tokens"]]


def slow_best(chunk, pieces_, scores, unknown):
    """Best score of a chunk by trying every split."""
    table = {p: scores[k] for k, p in enumerate(pieces_) if k in scores}
    best = [0] + [-math.inf] * len(chunk)
    for end in range(1, len(chunk) + 1):
        for start in range(end):
            part = chunk[start:end]
            score = table.get(part, unknown if len(part) == 1 else None)
            if score is not None and best[start] + score > best[end]:
                best[end] = best[start] + score
    return best[-1]


def test_pieces_are_the_best_path_and_round_trip():
    vocabulary = pieces.vocabulary(MODEL)
    scores = pieces.zipf_scores(vocabulary)
    codec = pieces.PieceCodec(vocabulary, memory=3)
    index = {v: k for k, v in enumerate(vocabulary)}
    for text in TEXTS:
        ids = codec.encode(text).tolist()
        assert codec.decode(ids) == (text or "")
    for text in ("hello there", " unbelievably 漢字", "Ünïcödé①", "aaaaaaaa"):
        ids, total, k = codec._best_path(" " + text), 0, 0
        while k < len(ids):
            if ids[k] in scores:
                total, k = total + scores[ids[k]], k + 1
            else:  # the bytes of one character
                lead = int(vocabulary[ids[k]][3:5], 16)
                total += codec.unknown
                k += 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        assert total == slow_best(" " + text, vocabulary, scores, codec.unknown)
    assert index[" the"] in codec.encode("of the").tolist()


def test_pieces_match_the_library_on_a_unigram_model():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    model.ParseFromString(Path(MODEL).read_bytes())
    model.trainer_spec.model_type = 1
    vocabulary = pieces.vocabulary(MODEL)
    scores = pieces.zipf_scores(vocabulary)
    for k, piece in enumerate(model.pieces):
        piece.score = scores.get(k, 0) / 64
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    codec = pieces.PieceCodec(vocabulary)
    for text in TEXTS[1:]:
        if "▁" not in text:
            assert codec.encode(text).tolist() == library.encode(text)


def test_piece_columns_of_whole_tables(spark):
    docs = spark.createDataFrame([(k, t, "c") for k, t in enumerate(TEXTS)],
                                 "doc_id long, text string, ids_crc32 string")
    done = pieces.encode(docs, MODEL)
    assert done.columns == ["doc_id", "ids", "ids_crc32"]
    back = {r["doc_id"]: r for r in pieces.decode(done, MODEL).collect()}
    for k, t in enumerate(TEXTS):
        assert back[k]["text"] == (t or "")
        assert back[k]["ids_crc32"] == zlib.crc32(np.array(back[k]["ids"], "<i4").tobytes())
    assert pieces.encode(docs.limit(0), MODEL).count() == 0


PAGES = "page_id long, url string, html string, position int"


def archive(frame):
    return fixity.with_offsets(fixity.archived(frame))


def test_tree_matches_hashing_by_hand(spark):
    rows = [(k, f"http://h/{k}", "é" * k if k % 3 else None, 0) for k in range(40)]
    got = archive(spark.createDataFrame(rows, PAGES)).orderBy("position").collect()
    offset, level = 0, []
    for k, r in enumerate(got):
        body = rows[k][2] or ""
        record = (f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {rows[k][1]}\r\n"
                  f"WARC-Record-ID: <urn:page:{k}>\r\nContent-Length: {len(body.encode())}"
                  f"\r\n\r\n{body}\r\n\r\n").encode()
        assert (r["offset"], r["length"], bytes(r["digest"])) == (
            offset, len(record), hashlib.sha256(record).digest())
        ends = offset.to_bytes(8, "big") + (offset + len(record)).to_bytes(8, "big")
        level.append((k, hashlib.sha256(hashlib.sha256(record).digest() + ends).digest(), k, k))
        offset += len(record)
    while len(level) > 1:
        up = {}
        for node in level:
            up.setdefault(node[0] // 16, []).append(node)
        level = [(n, hashlib.sha256(b"".join(c[1] for c in under) + under[0][2].to_bytes(8, "big")
                                    + under[-1][3].to_bytes(8, "big")).digest(),
                  under[0][2], under[-1][3]) for n, under in up.items()]
    root = fixity.tree(archive(spark.createDataFrame(rows, PAGES)))[-1].collect()
    assert [bytes(r["hash"]) for r in root] == [level[0][1]]


def test_audit_finds_every_fault_and_nothing_else(spark):
    rows = [(k if k % 50 else None, None if k % 7 == 0 else f"u{k}", f"page {k}", 1)
            for k in range(300)] + [(5, "same", "same", 1)] * 3
    one = kept(archive(spark.createDataFrame(rows, PAGES)))
    assert fixity.audit(one, one).count() == 0
    wrong = [3, 17, 18, 255]
    two = one.withColumn("digest", F.when(F.col("position").isin(wrong), F.unhex(F.lit("00")))
                         .otherwise(F.col("digest")))
    two = two.withColumn("offset", F.when(F.col("position") == 100, F.col("offset") + 1)
                         .otherwise(F.col("offset"))).where("position <> 280")
    got = {r["position"]: r["fault"] for r in fixity.audit(one, two).collect()}
    assert got == {**dict.fromkeys(wrong, "altered"), 100: "moved", 280: "missing"}
    assert fixity.audit(one.limit(0), one.where("position < 4")).select("fault").distinct() \
        .collect()[0][0] == "extra"
    assert fixity.audit(one.limit(0), one.limit(0)).count() == 0


def slow_scan(rows, least=0.8):
    import re
    from collections import Counter

    def terms(t):
        return [w for w in re.split("[^a-z0-9]+", t.lower()) if w]
    known = {t for _, notice in licenses.TEMPLATES for t in terms(notice)}
    seen = Counter(t for _, x in rows for t in known & set(terms(x or "")))
    idf = {t: math.log((len(rows) + 1) / (seen[t] + 1)) + 1 for t in known}

    def vector(text):
        v = {t: n * idf.get(t, math.log(len(rows) + 1) + 1) for t, n in Counter(terms(text)).items()}
        size = math.sqrt(sum(x * x for x in v.values())) or 1
        return {t: x / size for t, x in v.items()}
    models = [(name, vector(notice)) for name, notice in licenses.TEMPLATES]
    own = {}
    for path, text in rows:
        best = (-1.0, 0, None)
        for unit in [text or "", *re.split(r"\n|(?<=[.!?])\s+", text or "")]:
            v = vector(unit)
            for rank, (name, model) in enumerate(models):
                score = round(sum(x * model.get(t, 0) for t, x in v.items()), 9)
                best = max(best, (score, -rank, name))
        if best[0] >= least:
            own[path, text] = (best[2], best[0])
    spoken = {}
    for (path, text), (name, score) in own.items():
        if re.search(licenses.LICENSE_FILE, path or ""):
            folder = path.rpartition("/")[0]
            spoken[folder] = min(spoken.get(folder, (9, "", "")), (-score, name, path))
    out = []
    for path, text in rows:
        if (path, text) in own:
            out.append((path, own[path, text][0], "own", None))
            continue
        folder = (path or "").rpartition("/")[0]
        while folder not in spoken and folder:
            folder = folder.rpartition("/")[0]
        held = spoken.get(folder)
        out.append((path, held and held[1], "inherited" if held else "none", held and held[2]))
    return sorted(out, key=str)


def test_license_scan_matches_brute_force(spark):
    notice = dict(licenses.TEMPLATES)
    rows = [("LICENSE", notice["MIT"] + "."), ("a/COPYING.md", "x\n" + notice["GPL-3.0"]),
            ("a/b/c/d.py", "code only"), ("a/b/LICENCE-APACHE", notice["Apache-2.0"].upper()),
            ("a/b/x.py", None), ("a/b/y.py", ""), ("z.py", "nothing. here"), (None, "pathless"),
            ("q/w.py", "intro\nLicensed under CC BY-NC 4.0. More text follows"),
            ("q/v.py", "under the version of the public domain"), ("q/v.py", notice["ISC"]),
            ("q/notice", "no terms at all"), ("q/LICENSE.txt", notice["CC-BY-4.0"]),
            ("q/LICENSE.txt", notice["CC-BY-4.0"]), ("q/LICENSE-2", notice["MPL-2.0"])]
    rows += [(f"deep/{'n/' * k}f.py", "filler words " * k) for k in range(12)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "path string, text string, license string")
    got = licenses.scan(frame).select("path", "license", "origin", "from_path").collect()
    assert sorted(map(tuple, got), key=str) == slow_scan(rows)
    assert licenses.scan(frame.limit(0)).count() == 0


def test_native_operator_has_no_python_nodes(spark):
    frame = spark.createDataFrame([("LICENSE", "Released under the MIT License.")],
                                  "path string, text string")
    plan = licenses.scan(frame)._jdf.queryExecution().toString()
    assert not any(n in plan for n in ("Python", "Pandas", "Arrow", "MapPartitions"))


def test_vectors_whose_squares_leave_the_range_of_doubles(spark):
    rows = [(0, [1e-200, 1e-200]), (1, [1e200, 1e200]), (2, [1e200, 1.01e200]), (3, [1.0, 1.0]),
            (4, [5e-324, 0.0]), (5, [1.7e308, 0.0]), (6, [1e-200, -1e-200]), (7, [1e300, 1e-300]),
            (8, [0.0, -0.0]), (9, [1e-160, 9e-161]), (10, [-1e200, -1e200])]
    found = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found.collect()}
    assert got == {0: (4, 0), 1: (4, 0), 2: (4, 0), 3: (4, 0), 9: (4, 0), 4: (2, 4), 5: (2, 4),
                   7: (2, 4), 6: (0, 6), 8: (0, 8), 10: (0, 10)}


def test_each_chunk_of_a_column_is_looked_up_once_and_odd_spaces_give_the_library_s_ids():
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(BYTE_BPE)
    texts = ["the cat, the cat", "the cat\nthe cat.", None, "", " a  b ", "a\u00a0 b\u2003c", "e\u0301 \u4e2d",
             "x<|endo", "ftext|> y <|endoftext|> z", "tab\t end\n", "\0 nul\n\nline"] * 3
    coder = tokenfile.ChunkedEncoder(BYTE_BPE, 2)
    asked, look_up = [], coder._look_up
    coder._look_up = lambda chunks: asked.append(list(chunks)) or look_up(chunks)
    for column in (pa.array(texts), pa.array(texts, pa.large_string()), pa.array(["-", *texts])[1:]):
        got = [np.frombuffer(ids, "<u2").tolist() for ids in coder.encode_column(column)]
        assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert all(len(chunks) == len(set(chunks)) for chunks in asked)
