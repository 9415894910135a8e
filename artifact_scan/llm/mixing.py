"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its weight's share of all words, but never over ``MAX_EPOCHS``
times its own size; what a capped source cannot use is shared again by weight.  As the
uncapped targets stay in proportion to their weights, the end of that resharing is one
level ``target = min(cap, level * weight)``, found from running sums over the sources
sorted by cap / weight.

A source takes whole epochs first.  For the fraction left over, each document draws the
exponential key ``-ln(u) / w``, with u from a hash of its id and w its quality weight;
the documents with the least keys are taken until their sizes reach the budget, and the
document on the boundary gives its first words only, so a source's total is its target
to the word.

The prefix sum never sorts a source in one task: sizes are summed by (source, key bin),
the running sum over the bins finds the one bin in which the budget ends, and only the
rows of that bin, 1 / ``BINS`` of the source, are sorted.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from artifact_scan.llm.store import broadcast_if_small, free, maybe_among, table, without, written
from artifact_scan.llm.words import slices, split

WEIGHTS = (5, 2, 1)  # repeated over the sources in code point order, null last
MAX_EPOCHS = 3
BINS = 4096
#: Quality weights of the exponential keys, by label; unlabelled documents count 1.
GOOD, BAD = 2.0, 0.5


def row_key():
    """A number that rows equal in id, source and text share, and others do not."""
    some = [x for c in ("doc_id", "source") for x in (F.col(c), F.col(c).isNull())]
    return F.xxhash64(*some, F.col("text"))


def _count(batches):
    for batch in batches:
        for part in slices(batch):
            counts = pa.array(split(part.column("text")).counts)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "source", "row")), counts], ["doc_id", "source", "row", "size"])


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, row, size in words); null text has size 0."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return docs.withColumn("row", row_key()).mapInArrow(_count, "doc_id long, source string, row long, size long")


def _in_order(df: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """``df`` with ``rank`` from 0 and, for each of ``sums``, ``<name>_before``, the sum over all earlier rows.

    Rows are sorted by ranges, so that no task sees all of them; the totals of the ranges before a
    row's own, one number a partition, are added to the running sum within it.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed.withColumn("_range", F.shiftright("_at", 33)).withColumn("_one", F.lit(1).cast("long")), "in-order")
    totals = placed.groupBy("_range").agg(*(F.sum(c).alias(c) for c in (*sums, "_one")))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    offsets = totals.select("_range", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in (*sums, "_one")))
    inner = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(F.broadcast(offsets), "_range")
    upto = lambda c: F.col(f"_{c}") + F.coalesce(F.sum(c).over(inner), F.lit(0))
    return out.select(*df.columns, upto("_one").alias("rank"), *(upto(c).alias(f"{c}_before") for c in sums))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(skey, source, source_size, target) for each source; however many there are, no task sees them all."""
    by = sized.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    name = [F.col("source").isNull(), F.col("source")]
    by = _in_order(by, name, [])
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    by = by.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    by = by.withColumn("ratio", F.col("cap") / F.col("weight")).drop("rank")
    by = written(_in_order(by, [F.col("ratio"), *name], ["cap", "weight"]), "targets-levels")
    size, weight = by.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(size).cast("long") - F.col("cap_before")) / (F.lit(weight).cast("long") - F.col("weight_before"))
    # The first source in the order whose cap is above the level sets the level of all after it.
    above = by.withColumn("level", level).where(F.col("ratio") > F.col("level")).agg(F.min(F.struct("ratio", "level"))["level"]).first()[0]
    cap = F.col("cap").cast("double")
    return by.select("skey", "source", "source_size", F.coalesce(F.least(cap, F.lit(above).cast("double") * F.col("weight")), cap).alias("target"))


def mix(sized: DataFrame, weighted: DataFrame | None = None, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, bins: int = BINS) -> DataFrame:
    """(doc_id, size, source_size, target, taken[, row]), one row for each row of ``sized`` (doc_id, source, size[, row]).

    ``weighted`` gives (doc_id, weight > 0) for some documents.  Rows without words take 0;
    an empty table gives none; rows that repeat a document draw the same key and are ordered
    by size.  Reruns agree, as a key depends on the id and the weight only.
    """
    if weighted is None:
        sized = sized.withColumn("w", F.lit(1.0))
    else:
        sized = sized.join(weighted.groupBy("doc_id").agg(F.max("weight").alias("w")), "doc_id", "left").fillna(1.0, ["w"])
    number = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10)
    u = (number.cast("long") + 1) / F.lit(float(2**52 + 1))
    sized = sized.withColumn("skey", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).withColumn("key", -F.log(u) / F.col("w"))
    sized = sized.withColumn("bin", F.floor((1 - F.exp(-F.col("key"))) * bins).cast("int"))
    sized = written(sized.drop("w"), "keys")

    goal = targets(sized, weights, max_epochs)
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.round("target").cast("long") - F.pmod(F.round("target").cast("long"), "source_size")).otherwise(F.lit(0)))
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, (F.col("whole") / F.col("source_size")).cast("long")).otherwise(F.lit(0)))
    goal = written(goal.withColumn("budget", F.round("target").cast("long") - F.col("whole")).drop("source", "whole"), "targets")

    by_bin = sized.groupBy("skey", "bin").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("skey").orderBy("bin"))
    ends = by_bin.withColumn("upto", upto).join(goal.select("skey", "budget"), "skey").where("upto >= budget")
    ends = ends.groupBy("skey").agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("before"))).alias("end"))
    goal = written(goal.join(ends.select("skey", "end.bin", "end.before").withColumnRenamed("bin", "last"), "skey", "left"), "budgets")

    rows = sized.join(broadcast_if_small(goal), "skey")
    inner = F.col("bin") == F.col("last")
    order = Window.partitionBy("skey").orderBy("key", "doc_id", "size", *(["row"] if "row" in sized.columns else [])).rowsBetween(Window.unboundedPreceding, -1)
    ended = rows.where(inner).withColumn("ahead", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    ended = ended.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("ahead"))))
    whole = rows.where(F.col("last").isNull() | ~inner).withColumn("part", F.when(F.col("bin") < F.col("last"), F.col("size")).otherwise(F.lit(0)))
    out = ["doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"), *(["row"] if "row" in sized.columns else [])]
    return whole.select(*out).unionByName(ended.select(*out))


def quality_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight) from quality labels; unlabelled rows are left out and count 1."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    return known.select("doc_id", F.when(F.col("quality") == 1, GOOD).otherwise(BAD).alias("weight"))


def mixed(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The documents that a plan (row, size, taken) of ``mix`` takes, with the columns of ``docs``.

    A document taken whole n times stands there n times; the part of one is its first words,
    joined by spaces, with ``n_chars``, where there is such a column, counted anew.  Rows equal
    in id, source and text are one document whose planned words add up; one of them stands for
    all.  Null ids and sources, and ids shared by different texts, are planned by row.  Documents
    that the plan does not name or gives nothing are left out; an empty table gives none.
    """
    row, size, whole, part, copy = (free(docs, name) for name in ("_row", "_size", "_whole", "_part", "_copy"))
    named = docs.withColumn(row, row_key())
    plan = plan.groupBy(F.col("row").alias(row)).agg(F.max("size").alias(size), F.sum("taken").alias("taken"), F.count("*").alias("n"))
    plan = written(plan.where("taken > 0"), "mix-plan")
    repeated = written(plan.where("n > 1").select(row), "mix-repeated")
    once = maybe_among(named, repeated, row).join(repeated.hint("merge"), row).dropDuplicates([row]).select(*named.columns)
    named = without(named, repeated, row).unionByName(once)
    plan = plan.withColumn(whole, F.floor(F.col("taken") / F.col(size))).withColumn(part, F.col("taken") - F.col(whole) * F.col(size))
    plan = plan.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(whole) + F.when(F.col(part) > 0, 1).otherwise(0))))
    # The plan has a row a document, so it is never broadcast, however small the corpus.
    both = named.join(plan.select(row, whole, part, copy).hint("merge"), row)
    cut = F.col(copy) > F.col(whole)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    both = both.withColumn("text", F.when(cut, F.array_join(F.slice(words, 1, F.col(part).cast("int")), " ")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        both = both.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return both.select(*docs.columns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(sizes(table(spark, sf_dir, "documents")).drop("row"), quality_weights(table(spark, sf_dir, "labels")))


ORACLE_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [{", ".join(map(str, WEIGHTS))}][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(WEIGHTS)} + 1)::INTEGER]::BIGINT AS weight,
         source_size * {MAX_EPOCHS} AS cap FROM src
), levels AS (
  SELECT *, cap::DOUBLE / weight AS ratio,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE AS level
  FROM weighed WINDOW o AS (ORDER BY cap::DOUBLE / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goals AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT level FROM levels WHERE ratio > level ORDER BY ratio, level LIMIT 1) * weight, cap)) AS target
  FROM levels
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs,
    CASE WHEN source_size > 0 THEN round(target)::BIGINT % source_size ELSE 0 END AS budget FROM goals
), keyed AS (
  SELECT s.doc_id, s.source, s.size,
    -ln((('0x' || substr(md5(coalesce(s.doc_id::VARCHAR, '')), 1, 13))::BIGINT + 1) / {float(2**52 + 1)!r}::DOUBLE) / coalesce(l.w, 1.0) AS key
  FROM sized s LEFT JOIN (SELECT doc_id, max(CASE WHEN quality = 1 THEN {GOOD} ELSE {BAD} END)::DOUBLE AS w FROM labels
                          WHERE quality IS NOT NULL GROUP BY doc_id) l USING (doc_id)
), summed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM keyed
)
SELECT k.doc_id, k.size, p.source_size, p.target, (p.epochs * k.size + greatest(0, least(k.size, p.budget - k.ahead)))::BIGINT AS taken
FROM summed k JOIN plan p ON k.source IS NOT DISTINCT FROM p.source
"""
