"""The corpus pipeline: five stages over ``documents``, each one operator, each written before the next.

toxicity drops documents that the ordinal model rejects; line dedup takes repeated lines out of texts and drops documents
that have nothing else; near-dedup keeps the smallest doc_id of each group of near duplicates; decontamination drops documents
that hold a benchmark item; the last stage encodes and decodes what is left. All but the last return the columns
of ``documents``; n_chars follows the text.

Cases, in every stage: null and empty texts are clean and stay (the last stage gives them 0 tokens); rows that share a
doc_id are judged each by toxicity and share their fate in the others; a row without doc_id loses no line and is in no group,
but goes if it is toxic or holds a benchmark item; repeated rows without doc_id all stay; extra columns go; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvella.llm import bpe, decontaminate, line_dedup, minhash, toxicity
from corvella.llm.common import Scratch, documents

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, keep=COLUMNS).where(~F.col("rejected")).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedupe_lines(docs, keep=("doc_id", "lang", "source"))
    emptied = (F.col("n_dropped") > 0) & F.col("text").rlike(r"^[\x20\x09-\x0D]*$")
    return out.where(~emptied).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # rows without an id are in no group and stay
    gone = minhash.near_duplicates(docs).where(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # rows without an id are told by a hash of their text: equal texts hold the same items
    keyed = docs.withColumn("__key", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")))
    found = decontaminate.matches(keyed.select(F.col("__key").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return keyed.join(found.select(F.col("doc_id").alias("__key")).distinct(), "__key", "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("BPE encoding and decoding", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = documents(spark, sf_dir), Scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = scratch.table(f"stage{k}", out)
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
