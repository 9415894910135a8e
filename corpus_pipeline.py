"""The training-corpus pipeline: five stages from raw documents to sharded ones.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of
``documents``; the last adds ``slot`` and ``shard``.  ``run`` writes each stage's result
to the shared folder and reads it again as the next one's input.  Whoever calls the stages
one by one must do so too: a stage removes what the stage before it wrote on its way.
Empty tables give empty results of the same columns.

SQL cannot express the forest, the singular vectors or the signatures, so ``ORACLE_SQL``
is None; the tests hold the stages against brute force.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from artifact_scan.llm import decontamination, jaccard_join, mixing, quality, sharding
from artifact_scan.llm.store import drop, free, mark, maybe_among, paths_since, table, without, written


_LEFT: list[str] = []  # what the last stage wrote on its way


def _stage(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, which first removes what the stage before it has left."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop(spark, _LEFT)
        since = mark()
        out = function(spark, docs, sf_dir)
        _LEFT[:] = paths_since(since)
        return out

    return run_stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the forest, which is fitted on this input's labelled rows.

    Null and empty texts fail; rows that repeat an id are judged each by its text; columns of
    the names that the operator adds are kept as they are.
    """
    clash = {c: free(docs, f"_{c}") for c in docs.columns if c in (*quality.STATISTICS, *quality.VERDICTS)}
    forest = quality.fit(docs, table(spark, sf_dir, "labels"))
    kept = quality.judge(docs.withColumnsRenamed(clash), forest).where("kept")
    return kept.select(*(F.col(clash.get(c, c)).alias(c) for c in docs.columns))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least id, once; null ids and texts without words stay.

    Rows that share an id are told apart by the prints of their texts.
    """
    name = free(docs, "_print")
    found = written(jaccard_join.linked(docs).where("doc_id is not null").select("doc_id", "class_id", "print", "group"), "stage-classes")
    copies = found.where("doc_id <> class_id").select("doc_id").distinct()
    repeated = written(found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "stage-repeated")
    kept = without(docs, written(copies.unionByName(repeated).distinct(), "stage-dropped"), "doc_id")
    first = maybe_among(found.where("doc_id = class_id"), repeated, "doc_id").groupBy("doc_id", "group").agg(F.min("print").alias(name))
    first = first.join(repeated, "doc_id").select("doc_id", name).distinct()
    once = jaccard_join.printed(maybe_among(docs, repeated, "doc_id"), name).join(first.hint("merge"), ["doc_id", name]).dropDuplicates(["doc_id", name])
    return kept.unionByName(once.select(*docs.columns))


@_stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands: their texts alone decide, so null and repeated ids do not matter."""
    key = free(docs, "_key")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    found = decontamination.contaminated(keyed.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return without(keyed, written(found.select(F.col("doc_id").alias(key)).distinct(), "stage-leaks"), key).select(*docs.columns)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; rows equal in id, source and text are one document that counts as often."""
    plan = mixing.mix(mixing.sizes(docs), mixing.quality_weights(table(spark, sf_dir, "labels")))
    return mixing.mixed(docs, plan)


@_stage
def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its slot and shard."""
    return sharding.place(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
    ("sharding", shard),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before: list[str] = []
    for k, (_, stage) in enumerate(STAGES):
        found = stage(spark, docs, sf_dir)
        since = mark()
        docs = written(found, f"pipeline-{k}")
        drop(spark, before)  # what the stage read
        before = paths_since(since)
    return docs
