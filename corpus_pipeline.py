"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

Every stage works on all rows that the one before kept, and its decisions take effect. Decisions are applied by the pair (doc_id, hash of the text), so repeated
and null ids with different texts are told apart; of rows with equal id and text the near-duplicate stage keeps one.
Columns beside those of documents are passed through. Null texts count as empty; an empty table goes through all stages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.llm import bpe_transducer, decontaminate, jaccard_join, secret_scan, zstd_quality
from millrace.llm.common import bound_batches, bounded, held_out, read, release_heap, stage, unstage
from millrace.llm.queries import tokenizer

#: Near duplicates: words in a shingle, and the least similarity in percent.
SHINGLE, PERCENT = 5, 80


def text_key(docs: DataFrame) -> Column:
    return F.xxhash64(F.coalesce(docs.text, F.lit("")))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id becomes the pair (id, hash), which the operators pass through."""
    return docs.select(F.struct(F.col("doc_id").alias("id"), text_key(docs).alias("hash")).alias("doc_id"), "text")


def without(docs: DataFrame, drop: DataFrame) -> DataFrame:
    """docs but for the rows with a pair (id, hash) in drop."""
    d = bounded(stage(drop.select("id", "hash").distinct(), "pipeline-drop"))
    return docs.join(d, docs.doc_id.eqNullSafe(d.id) & (text_key(docs) == d.hash), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (operator 10) rejects go."""
    bound_batches(spark)
    release_heap(spark)
    labels = read(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 3, 1))
    scored = zstd_quality.score(docs, zstd_quality.fit(docs, labels), "_pipeline_quality")
    return scored.where(F.col("_pipeline_quality") >= 0.5).drop("_pipeline_quality")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (operator 5) one row stays: that with the least doc_id, null ids last, and of several texts under that id the one with the least hash."""
    bound_batches(spark)
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), text_key(docs).alias("hash"))
    joined = stage(jaccard_join.join(docs.select(key.alias("doc_id"), "text"), SHINGLE, PERCENT), "pipeline-groups")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    kept = without(docs, joined.where(~stays).select("doc_id.id", "doc_id.hash"))
    twice = stage(joined.where(stays).groupBy("doc_id").count().where("count > 1").select(F.col("doc_id.id").alias("_id"), F.col("doc_id.hash").alias("_hash")), "pipeline-twice")
    if twice.isEmpty():
        return kept
    twice = bounded(twice)
    on = kept.doc_id.eqNullSafe(twice._id) & (text_key(kept) == twice._hash)
    one = kept.join(twice, on, "left_semi").withColumn("_hash", text_key(kept)).dropDuplicates(["doc_id", "_hash"]).drop("_hash")
    return kept.join(twice, on, "left_anti").unionByName(one)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a word inside a benchmark window (operator 8) go."""
    found = decontaminate.decontaminate(keyed(docs), read(spark, sf_dir, "benchmark"))
    return without(docs, found.where("n_hit > 0").select("doc_id.*"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the secret scan (operator 1) finds is replaced in the text, and n_chars follows."""
    found = secret_scan.scan(keyed(docs)).where(F.size("spans") > 0).select("doc_id.*", F.col("spans").alias("_spans")).dropDuplicates(["id", "hash"])
    f = bounded(stage(found.select(F.col("id").alias("_pipeline_id"), F.col("hash").alias("_pipeline_hash"), F.col("_spans").alias("_pipeline_spans")), "pipeline-spans"), F.size("_pipeline_spans"))
    joined = docs.join(f, docs.doc_id.eqNullSafe(f._pipeline_id) & (text_key(docs) == f._pipeline_hash), "left")
    clean = F.col("_pipeline_spans").isNull()
    out = joined.withColumn("_pipeline_text", F.when(clean, docs.text).otherwise(secret_scan.redact(docs.text, F.col("_pipeline_spans"))))
    changed = {"text": F.col("_pipeline_text")} | ({"n_chars": F.when(clean, F.col("n_chars")).otherwise(F.length("_pipeline_text"))} if "n_chars" in docs.columns else {})
    return out.withColumns(changed).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text (operator 4), with their digest and that of the text decoded from them. Workers keep no tables: other stages need the memory."""
    bound_batches(spark)
    release_heap(spark)
    ranks, pattern = tokenizer()
    return bpe_transducer.round_trip(docs.select("doc_id", "text"), ranks, pattern, "bpe", with_ids=True, keep=False, states=30_000, words=60_000).select("doc_id", "bpe.*")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("secrets", secrets), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn. A stage's table goes once the next one's is written."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, f) in enumerate(STAGES):
        before, docs = docs, f(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, f"pipeline-{name}")
            unstage(before)
    return docs


#: The classifier, the components and the byte-level BPE can't be expressed in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None
