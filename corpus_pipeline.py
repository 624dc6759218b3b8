"""The corpus pipeline: toxicity, exact dedup, near-dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the
last return the columns of documents; what they reject is gone from then on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.llm import toxicity
from fluvia.llm.decontaminate import contamination
from fluvia.llm.exact_dedup import exact_duplicates
from fluvia.llm.minhash import near_duplicates
from fluvia.llm.queries import piece_model_path, toxicity_model
from fluvia.llm.sentencepiece_bpe import encoded
from fluvia.llm.storage import without, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below one half."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.accepted(docs, toxicity_model(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, the longest, then that of the smallest doc_id."""
    gone = written(exact_duplicates(docs).filter("not kept").select("doc_id"), "copies")
    return without(docs, gone)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates."""
    gone = written(near_duplicates(docs).filter("not kept").select("doc_id"), "near-copies")
    return without(docs, gone)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    gone = written(contamination(docs, benchmark).filter("n_hit > 0").select("doc_id"), "contaminated")
    return without(docs, gone)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, packed as little-endian unsigned 32-bit integers, and the digest of
    the text that they decode to."""
    return encoded(docs, piece_model_path()).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("minhash", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("sentencepiece", tokens),
]

#: SQL expresses neither the classifier nor the token merges; the tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
