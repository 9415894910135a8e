"""Multi-party chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered with that speaker as the
assistant, the others as named users and system turns as they are; the mask marks the
characters to train on, the speaker's own turns with their end marks.

A rendering is one row.  Only a dialogue of more than ``PART`` characters, which no row
should hold, goes on in further parts, cut at turn boundaries; each begins with the
conversation's first system turn again.  Offsets are two-level prefix sums: within blocks of
``BLOCK`` turn numbers, and over the blocks' totals, so that no task sees all turns of a long
conversation.  Blocks in which more than ``CROWD`` turns share few numbers, or have none, are
split further by the hash that orders equal turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from artifact_scan.llm.store import broadcast_if_small, table, written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
SYSTEM = ("system",)
PART, BLOCK, CROWD = 1 << 24, 64, 4096


def _content(text: str):
    """The text, with a space put into what would read as a mark; null is empty."""
    return F.replace(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit("<|"), F.lit("< |"))


def _read(turns: DataFrame) -> DataFrame:
    """(key, conv_id, turn, by, content, tie): cleaned turns; ``tie`` orders those of equal numbers."""
    turns = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("by"), _content("text").alias("content"))
    turns = turns.withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    return turns.withColumn("tie", F.md5(F.concat("by", F.lit("\x1f"), "content").cast("binary")))


def _segment(role, name):
    head = F.concat(F.lit(OPEN), role, F.when(name.isNotNull(), F.concat(F.lit(" name="), F.replace(name, F.lit("<|"), F.lit("< |")))).otherwise(""), F.lit("\n"))
    return F.concat(head, "content", F.lit(CLOSE)), F.length(head).cast("long")


def _rotated(turns: DataFrame, system: tuple[str, ...]) -> DataFrame:
    """``turns`` once for each participant of their conversation, with speaker, role, name, trained, segment and content_at."""
    speakers = turns.where(~F.col("by").isin(*system)).groupBy("key", F.col("by").alias("speaker")).agg(F.lit(1).alias("_")).drop("_")
    seen = turns.join(speakers, "key")
    own, sys = F.col("by") == F.col("speaker"), F.col("by").isin(*system)
    seen = seen.withColumn("role", F.when(sys, "system").when(own, "assistant").otherwise("user"))
    seen = seen.withColumn("name", F.when(F.col("role") == "user", F.col("by"))).withColumn("trained", own)
    segment, at = _segment(F.col("role"), F.col("name"))
    return seen.withColumn("segment", segment).withColumn("content_at", at)


def rotate(turns: DataFrame, system: tuple[str, ...] = SYSTEM) -> DataFrame:
    """A row for each turn and participant of its conversation: who says what, as whom, and whether it is trained on.

    (conv_id, speaker, turn, role, name, trained, segment, content_at).  Turns are ordered by
    number (null last), those of equal numbers by a hash of role and text; rows that repeat a turn
    all stay.  A null role is the participant ``unknown``; rows of null conv_id are one
    conversation.  A conversation with system turns only has no participants and gives no rows.
    """
    return _rotated(_read(turns), system).select("conv_id", "speaker", "turn", "role", "name", "trained", "segment", "content_at")


def render(turns: DataFrame, system: tuple[str, ...] = SYSTEM, part: int = PART, crowd: int = CROWD) -> DataFrame:
    """(conv_id, speaker, part, n_turns, text, mask, n_trained): the renderings.

    ``mask`` lists begin:end offsets into the part's text, separated by spaces; ``n_turns`` does
    not count a repeated system turn; other columns are not read; an empty table gives none.
    """
    read = _read(turns).withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(2**62)))
    crowded = written(read.groupBy("key", "block").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("key", "block", F.lit(True).alias("split")), "chat-crowds")
    finer = F.concat(F.lpad(F.coalesce(F.col("turn") - F.col("block") * BLOCK, F.lit(0)).cast("string"), 2, "0"), F.substring("tie", 1, 3))
    read = read.join(broadcast_if_small(crowded), ["key", "block"], "left").withColumn("sub", F.when(F.col("split"), finer).otherwise("")).drop("split")

    seen = _rotated(read, system).withColumn("size", F.length("segment").cast("long"))
    order = Window.partitionBy("key", "speaker", "block", "sub").orderBy(F.col("turn").asc_nulls_last(), "tie", "by", "content").rowsBetween(Window.unboundedPreceding, -1)
    seen = seen.withColumn("inner", F.coalesce(F.sum("size").over(order), F.lit(0)))
    blocks = seen.groupBy("key", "speaker", "block", "sub").agg(F.sum("size").alias("total"))
    before = Window.partitionBy("key", "speaker").orderBy("block", "sub").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("total").over(before), F.lit(0))).drop("total")
    seen = seen.join(blocks, ["key", "speaker", "block", "sub"]).withColumn("start", F.col("before") + F.col("inner"))
    seen = seen.withColumn("part", F.floor(F.col("start") / part))
    rows = F.sort_array(F.collect_list(F.struct("start", "segment", "content_at", "trained")))
    parts = seen.groupBy("key", "conv_id", "speaker", "part").agg(rows.alias("rows"))

    first = F.min(F.struct(F.col("turn").isNull().alias("late"), "turn", "tie", "by", "content"))["content"]
    opening = read.where(F.col("by").isin(*system)).groupBy("key").agg(first.alias("content"))
    opening = opening.select("key", _segment(F.lit("system"), F.lit(None).cast("string"))[0].alias("opening"))
    later = parts.where("part > 0").join(opening, "key", "left").withColumn("opening", F.coalesce("opening", F.lit("")))
    parts = parts.where("part = 0").withColumn("opening", F.lit("")).unionByName(later)

    begin = F.element_at("rows", 1)["start"] - F.length("opening")
    spans = F.transform(
        F.filter("rows", lambda r: r["trained"]),
        lambda r: F.concat_ws(":", (r["start"] - begin + r["content_at"]).cast("string"), (r["start"] - begin + F.length(r["segment"]) - 1).cast("string")),
    )
    trained = F.aggregate(F.filter("rows", lambda r: r["trained"]), F.lit(0).cast("long"), lambda s, r: s + F.length(r["segment"]) - 1 - r["content_at"])
    return parts.select(
        "conv_id",
        "speaker",
        "part",
        F.size("rows").cast("long").alias("n_turns"),
        F.concat("opening", F.array_join(F.transform("rows", lambda r: r["segment"]), "")).alias("text"),
        F.array_join(spans, " ").alias("mask"),
        trained.alias("n_trained"),
    )


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(table(spark, sf_dir, "conversations"))


ORACLE_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS by_, replace(coalesce(text, ''), '<|', '< |') AS content FROM conversations
), speakers AS (
  SELECT DISTINCT conv_id, by_ AS speaker FROM turns WHERE by_ NOT IN ('system')
), seen AS (
  SELECT t.conv_id, speaker, turn, by_, content, by_ = speaker AS trained,
    '{OPEN}' || CASE WHEN by_ = 'system' THEN 'system' WHEN by_ = speaker THEN 'assistant' ELSE 'user name=' || replace(by_, '<|', '< |') END || chr(10) AS head
  FROM turns t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id
), placed AS (
  SELECT *, head || content || '{CLOSE.strip()}' || chr(10) AS segment, length(head) + length(content) + {len(CLOSE)} AS size FROM seen
), starts AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS LAST, md5(by_ || chr(31) || content), by_, content ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM placed
), opening AS (
  SELECT conv_id, '{OPEN}system' || chr(10) || arg_min(content, struct_pack(late := turn IS NULL, turn := turn, tie := md5(by_ || chr(31) || content))) || '{CLOSE.strip()}' || chr(10) AS opening
  FROM turns WHERE by_ = 'system' GROUP BY conv_id
), parts AS (
  SELECT s.*, start // {PART} AS part, CASE WHEN start // {PART} > 0 THEN coalesce(opening, '') ELSE '' END AS opening,
    min(start) OVER (PARTITION BY s.conv_id, speaker, start // {PART}) AS begin_ FROM starts s LEFT JOIN opening o ON o.conv_id IS NOT DISTINCT FROM s.conv_id
)
SELECT conv_id, speaker, part, count(*) AS n_turns, opening || string_agg(segment, '' ORDER BY start) AS text,
  coalesce(string_agg(CASE WHEN trained THEN (start - begin_ + length(opening) + length(head)) || ':' || (start - begin_ + length(opening) + size - 1) END, ' ' ORDER BY start), '') AS mask,
  coalesce(sum(CASE WHEN trained THEN size - 1 - length(head) END), 0)::BIGINT AS n_trained
FROM parts GROUP BY conv_id, speaker, part, opening
"""
