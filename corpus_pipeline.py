"""A corpus pipeline of five stages, each a job over the documents its predecessor kept."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from offergrid.llm import bpe, mixing, near_dedup, substring_dedup, toxicity
from offergrid.llm.common import shared_dir, written
from offergrid.llm.queries import bpe_digest

TOXIC = 0.7
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
PLACEMENT = "placement"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below TOXIC by a model of the labels that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.toxicity(docs, labels, keep=[c for c in COLUMNS if c != "text"] + ["text"])
    return scored.where(F.col("score") < TOXIC).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one of the smallest id, then text key.

    Of rows equal in id and text one stays; rows of one id and different texts are judged apart. Rows without an id stay.
    """
    kept = near_dedup.near_duplicates(docs).where("kept and doc is not null").select(F.col("doc").alias("_doc"), "text_key").distinct()
    keyed = docs.where("doc_id is not null").withColumn("_key", F.xxhash64("text"))
    leaders = keyed.join(kept, (F.col("doc_id") == F.col("_doc")) & (F.col("_key") == F.col("text_key")), "left_semi")
    order = Window.partitionBy("doc_id", "_key").orderBy("source", "lang", "n_chars")
    one = leaders.withColumn("_rn", F.row_number().over(order)).where("_rn = 1")
    return one.select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated 35-word windows; every document stays, some with less text."""
    cut = substring_dedup.substring_dedup(docs, window=35).where("size(spans) > 0").select("id", "text_key", "kept_text").dropDuplicates(["id", "text_key"])
    joined = docs.join(cut, docs["doc_id"].eqNullSafe(cut["id"]) & (F.xxhash64(docs["text"]) == cut["text_key"]), "left")
    gone = F.col("kept_text").isNotNull()
    out = joined.withColumn("text", F.coalesce("kept_text", "text"))
    return out.withColumn("n_chars", F.when(gone, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their placement in the mixture of sources at tempered weights.

    Files don't keep an order for their readers, so the placement (doc_id, text_sha256, slot, place) is a table in the
    shared folder; the path goes with the documents as metadata of doc_id.
    """
    keys = docs.select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))
    placed = mixing.mix(keys, mixing.tempered_weights(keys), tie=["text_sha256"]).select("doc_id", "text_sha256", "slot", "place")
    path = f"{shared_dir(spark)}/placement-{uuid.uuid4().hex}"
    placed.write.parquet(path)
    return docs.select(*COLUMNS).withMetadata("doc_id", {PLACEMENT: path})


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document's ids and decoded bytes, at the document's slot and place.

    Rows of one id and text have equal digests: one of them stands at each of their places.
    """
    digests = bpe_digest(bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
    placed = spark.read.parquet(docs.schema["doc_id"].metadata[PLACEMENT])
    one = digests.dropDuplicates(["doc_id", "decoded_sha256"])
    here = one["doc_id"].eqNullSafe(placed["doc_id"]) & (one["decoded_sha256"] == placed["text_sha256"])
    return one.join(placed, here).select(*[one[c] for c in digests.columns], "slot", "place")


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("substring_dedup", cut_repeats), ("mixing", mix_sources), ("bpe", tokens)]

#: Hashed features, trained weights and byte-pair merges have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from the documents table; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
