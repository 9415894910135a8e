"""Substring dedup: a count-min prefilter, then exact grouping of the windows it leaves.

A window is 50 consecutive words.  Its key in the sketch is its anchor: the least hash of
the 25-word runs inside it.  Equal windows have equal anchors, so a count over anchors is
never below the count over windows, and neighbouring windows share an anchor, which makes
the sketch's input about a fourteenth of the words.

Texts with equal word sequences need no windows: all but the one with the least id lose
every word if they are 50 words long.  So only one text of each sequence, the one with the
least id, goes on, and what is counted is in how many of those an anchor occurs.

Sketch  ``ROWS`` rows of counters.  A partition adds up its own counters (map-side), a shuffle
        merges them, and counters of two or more are written; an anchor is estimated repeated
        if its counter in every row is.  A row has ``SPACE`` counters for each anchor of the
        corpus and only those in use are stored, so the sketch grows with the data and is
        never gathered: anchors meet their counters in a shuffled join.  Each row counts only
        what the row before left, of which no repeated anchor is missing, so it loses none.
Windows windows of estimated anchors are grouped exactly, by 96 bits of hash, for their least
        document; a join returns to each occurrence whether it is a repeat.
Cut     texts with repeats are cut.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from artifact_scan.llm.store import maybe_among, table, written
from artifact_scan.llm.words import Words, covered, inside, mix, run_hashes, slices, split, word_hashes

WINDOW, ANCHOR = 50, 25
ROWS, SPACE = 2, 16
EMPTY = hashlib.sha256(b"").hexdigest()


def anchors(hashes: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> np.ndarray:
    """For each run of ``window`` words, the least hash of the ``anchor``-word runs inside it."""
    least = run_hashes(hashes, anchor)
    want = window - anchor + 1
    span = 1
    while span * 2 <= want:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = want - span
    return np.minimum(least[:-rest], least[rest:]) if rest else least


def _kept_words(words: Words, d: int, keep: np.ndarray | None = None) -> bytes:
    text = words.data[words.bounds[d] : words.bounds[d + 1]].tobytes().split()
    return b" ".join(text if keep is None else [w for w, k in zip(text, keep) if k])


def _texts(words: Words) -> list[bytes]:
    """SHA-256 of each text's words joined by one space."""
    return [hashlib.sha256(_kept_words(words, d)).digest() for d in range(len(words.bounds) - 1)]


def _tag_of(sha: bytes) -> int:
    """31 bits that tell apart texts of one id."""
    return int.from_bytes(sha[:4], "big") >> 1


def _tag(sha: str):
    """``_tag_of`` as an expression."""
    return F.shiftright(F.conv(F.hex(F.substring(sha, 1, 4)), 16, 10).cast("long"), 1)


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """The different values of each of ``n`` owners as a list column; ``owner`` ascends."""
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    offsets = np.searchsorted(owner[new], np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[new].view(np.int64)))


def _first_pass(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, n_words, sha, anchors) of each text: its word sequence's SHA-256 and its different anchors."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                words = split(part.column("text"))
                hashes = word_hashes(words)
                good = np.flatnonzero(inside(words, window))
                least, doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                if len(good):
                    least, doc = anchors(hashes, window, window // 2)[good], words.doc()[good]
                    new = np.ones(len(good), bool)
                    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
                    least, doc = least[new], doc[new]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(words.counts, pa.int64()), pa.array(_texts(words), pa.binary()), _lists(least, doc, part.num_rows)],
                    ["doc_id", "n_words", "sha", "anchors"],
                )

    return docs.mapInArrow(run, "doc_id long, n_words long, sha binary, anchors array<long>")


def _estimated(sequences: DataFrame, rows: int, space: float) -> DataFrame:
    """(doc_id, tag, anchors) of the texts with anchors that the sketch estimates to occur in two of them."""
    total = sequences.agg(F.sum(F.size("anchors"))).first()[0] or 0
    bits = min(63, max(4, math.ceil(math.log2(max(1, space * total)))))
    found = sequences.select(F.col("first").alias("doc_id"), _tag("sha").alias("tag"), F.explode("anchors").alias("anchor"))
    for row in range(rows):
        found = found.withColumn("cell", F.shiftrightunsigned(F.xxhash64("anchor", F.lit(row)), 64 - bits))
        counters = written(found.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell"), f"substrings-sketch-{row}")
        found = written(found.join(counters.hint("shuffle_hash"), "cell", "left_semi").drop("cell"), f"substrings-left-{row}")
    return found.groupBy("doc_id", "tag").agg(F.collect_list("anchor").alias("anchors"))


def _listed(part: pa.RecordBatch, keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Selects the anchors listed in their text's row."""
    lists = part.column("anchors")
    known = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    salt = mix(np.arange(1, len(lists) + 1, dtype=np.uint64))
    return np.isin(mix(keys ^ salt[owner]), mix(known ^ np.repeat(salt, np.diff(lists.offsets.to_numpy()))))


def _windows(texts: DataFrame, window: int) -> DataFrame:
    """(w, x, doc_id, at, more) for each (doc_id, tag, text, anchors) and window with a listed anchor.

    w, x: 96 bits of hash; at: 32 bits of the text's SHA-256, then the window's position;
    more: further positions of the same window in the text.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                words = split(part.column("text"))
                good = inside(words, window)
                doc, tags = words.doc(), part.column("tag").to_numpy()
                meant = np.array([_tag_of(s) for s in _texts(words)], np.int64) == tags  # else another text of the same id
                where = np.flatnonzero(good & meant[doc[: len(good)]]) if len(good) else np.zeros(0, np.int64)
                if not len(where):
                    continue
                hashes = word_hashes(words)
                least = anchors(hashes, window, window // 2)[where]
                new = np.ones(len(where), bool)
                new[1:] = (least[1:] != least[:-1]) | (doc[where[1:]] != doc[where[:-1]])
                hit = _listed(part, least[new], doc[where[new]])
                where = where[hit[np.cumsum(new) - 1]]
                if not len(where):
                    continue
                w = run_hashes(hashes, window, 1)[where]
                x = (run_hashes(hashes, window, 2)[where] >> np.uint64(32)).astype(np.int64)
                d = doc[where]
                order = np.lexsort((where, x, w, d))
                w, x, d, where = w[order], x[order], d[order], where[order]
                head = np.ones(len(w), bool)
                head[1:] = (w[1:] != w[:-1]) | (x[1:] != x[:-1]) | (d[1:] != d[:-1])
                starts = np.flatnonzero(head)
                ends = np.append(starts[1:], len(w))
                pos = (where - words.first[d]).astype(np.int32)
                more = [None] * len(starts)
                for i in np.flatnonzero(ends - starts > 1):
                    more[i] = pos[starts[i] + 1 : ends[i]].tobytes()
                arrays = [w[starts].view(np.int64), x[starts], part.column("doc_id").to_numpy()[d[starts]], (tags[d[starts]] << 32) | pos[starts]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), pa.array(more, pa.binary())], ["w", "x", "doc_id", "at", "more"])

    return texts.mapInArrow(run, "w long, x long, doc_id long, at long, more binary")


def _cut(texts: DataFrame, window: int) -> DataFrame:
    """(doc_id, tag, n_removed, kept_sha256, kept) of texts with the positions of their repeats."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                words = split(part.column("text"))
                spots, more, tags = (part.column(c).to_pylist() for c in ("spots", "more", "tag"))
                ids = part.column("doc_id").to_pylist()
                out: list[list] = [[], [], [], [], []]
                for d in range(part.num_rows):
                    if _tag_of(hashlib.sha256(_kept_words(words, d)).digest()) != tags[d]:
                        continue  # another text of the same id
                    n = int(words.counts[d])
                    flags = np.zeros(n, bool)
                    flags[np.asarray(spots[d], np.int64)] = True
                    for extra in more[d]:
                        flags[np.frombuffer(extra, np.int32)] = True
                    gone = covered(flags, window, n)
                    kept = _kept_words(words, d, ~gone)
                    for column, value in zip(out, (ids[d], tags[d], int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode())):
                        column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "tag", "n_removed", "kept_sha256", "kept"])

    return texts.mapInArrow(run, "doc_id long, tag long, n_removed long, kept_sha256 string, kept string")


def dedup(docs: DataFrame, window: int = WINDOW, texts: bool = True, rows: int = ROWS, space: float = SPACE) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]), one row for each row of ``docs``.

    ``kept`` is null where no word goes (the text stands as it is).  Rows of null id are
    sources of nothing and lose nothing; null text counts as empty.  Rows that share an id
    are judged each by its own text and do not remove from one another.  Other columns of
    ``docs`` are not read.  ``rows`` and ``space`` size the sketch and do not change the result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = written(_first_pass(docs, window), "substrings-1")
    named, long = F.col("doc_id").isNotNull(), F.col("n_words") >= window
    sequences = first.where(named & long).groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.first("anchors").alias("anchors"))
    sequences = written(sequences, "substrings-texts")
    lists = written(_estimated(sequences, rows, space), "substrings-lists")
    joined = maybe_among(docs, lists.select("doc_id"), "doc_id").join(lists.hint("merge"), "doc_id").select("doc_id", "tag", "text", "anchors")
    found = written(_windows(joined, window), "substrings-2")
    # Aggregates are written before they are joined: a join of plain shuffles can split a hot key.
    least = found.groupBy("w", "x").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    least = written(least.select("w", "x", "least"), "substrings-repeated")
    repeats = found.join(least, ["w", "x"]).where("doc_id > least")
    spots = repeats.groupBy("doc_id", F.shiftright("at", 32).alias("tag")).agg(
        F.collect_list(F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")).alias("spots"), F.collect_list("more").alias("more")
    )
    spots = written(spots, "substrings-3")
    cut = _cut(maybe_among(docs, spots.select("doc_id"), "doc_id").join(spots.hint("merge"), "doc_id").select("doc_id", "tag", "text", "spots", "more"), window)
    cut = written((cut if texts else cut.drop("kept")).dropDuplicates(["doc_id", "tag"]), "substrings-cut")

    base = first.select("doc_id", "n_words", "sha")
    copies = written(sequences.where("n > 1").select("sha", "first"), "substrings-copies")
    base = base.where(named).join(copies, "sha", "left").unionByName(base.where(~named), allowMissingColumns=True)
    all_ = base.withColumn("tag", _tag("sha")).join(cut, ["doc_id", "tag"], "left")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)) & long
    out = [
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
    ]
    return all_.select(*out, *([F.when(copy, "").otherwise(F.col("kept")).alias("kept")] if texts else []))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), texts=False)


ORACLE_SQL = rf"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), starts AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM docs WHERE len(ws) >= {WINDOW}
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i : i + {WINDOW - 1}], ' ') AS content FROM starts
), firsts AS (
  SELECT content, min(doc_id) AS least FROM windows GROUP BY content HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS i FROM windows JOIN firsts USING (content) WHERE least < doc_id
), words AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM docs
), kept AS (
  SELECT words.doc_id, count(gone.i) AS n_removed, string_agg(CASE WHEN gone.i IS NULL THEN word END, ' ' ORDER BY words.i) AS kept
  FROM words LEFT JOIN gone USING (doc_id, i) GROUP BY words.doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""
