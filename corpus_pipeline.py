"""The corpus pipeline: each stage works on all that the one before kept.

Documents that the quality classifier rejects go; later repeated lines of any length
go, and documents of which nothing is left; one document of each near-duplicate group
(SimHash, or 5-word shingles of Jaccard 0.8) stays;
documents holding a benchmark window go; the rest are encoded to piece ids and decoded.
"""

import public_tokenizers
from pyspark.sql import functions as F

from twoclock.llm import decontam, linededup, pieces, quality, similar
from twoclock.llm.common import table
from twoclock.session import kept

#: The tokenizer file of the last stage.
MODEL_FILE = public_tokenizers.path("piece_bpe_32k.model")


def quality_classifier(spark, docs, sf_dir):
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark, docs, sf_dir):
    left = linededup.without_repeats(docs, whole_lines=True)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup(spark, docs, sf_dir):
    return similar.one_of_each_group(docs)


def decontamination(spark, docs, sf_dir):
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark, docs, sf_dir):
    """doc_id, the piece ids with their crc32 and number, and the text they decode to."""
    encoded = pieces.encode(docs.select("doc_id", "text"), MODEL_FILE, decoded="text")
    return encoded.select(
        "doc_id", "ids", "ids_crc32", F.size("ids").cast("long").alias("n_pieces"), "text")


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", sentencepiece),
]

# A trained classifier and XXH64 fingerprints have no SQL; the tests hold the pipeline
# against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over `documents`, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
