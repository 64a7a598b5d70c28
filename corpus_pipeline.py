"""The corpus pipeline: documents through five operators, each stage on all that the one before kept.

Toxic documents go, one document of each group of near-duplicates stays, documents that hold benchmark
passages go, personal data is replaced in the text, and what is left is encoded. Stages pass the columns
of documents on; the last returns the encoded corpus. Columns beyond those of documents pass unread.

Cases: a null text counts as empty and is kept by every filter; rows of one id are one document for the
near-duplicate stage and stay or go together; a null id is never a duplicate; empty tables give empty
results of the same columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmill.llm import bpe, langid, neardup, pii, toxicity, winnowing
from pairmill.storage import staged

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Keys of at most this many rows (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def _without(docs: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return docs.join(keys, on, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def _packed(docs: DataFrame) -> DataFrame:
    """The whole row in one column beside its text, so that no column's name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("text").alias("text"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    teaching = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(langid.crc_part("doc_id", 3) != 1)
    model = toxicity.fit(docs, teaching)
    return toxicity.score(_packed(docs), model, ["doc"]).filter("predicted = 0").select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(docs, width=5, percent=80)
    gone = staged(found.filter("NOT kept").select("doc_id").distinct(), "duplicates")
    return _without(docs, gone, "doc_id")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _packed(docs).withColumn("key", F.xxhash64("doc.doc_id", "text"))
    found = winnowing.decontaminate(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc_id="key")
    gone = staged(found.filter("n_hit > 0").select(F.col("doc_id").alias("key")).distinct(), "contaminated")
    return _without(keyed, gone, "key").select("doc.*")


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_packed(docs), ["doc"])
    clean = found.select("doc", pii.redact(F.col("doc.text"), F.col("spans")).alias("clean"))
    new = {"text": F.col("clean"), "n_chars": F.when(F.col("clean").isNotNull(), F.length("clean").cast("bigint"))}
    return clean.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = bpe.send_ranks(spark, RANKS)
    keep = ["doc_id", "lang", "source"]
    encoded = bpe.encode(docs, ranks, keep, columns=("ids", "piece_starts", "round_trip"))
    n_tokens = F.expr("octet_length(ids) div 4").cast("bigint")
    return encoded.select(*keep, n_tokens.alias("n_tokens"), "ids", "piece_starts", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_pii),
    ("byte_bpe", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
