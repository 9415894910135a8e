"""Quality rules: rule statistics of whole texts and an isolation forest over them.

Statistics become rates: counts over a text's words, characters or lines, with one count
and a few words more than were seen.  A count of a short text says little, so each tree is
grown on rates drawn from what the counts allow (a gamma distribution for each), not on the
bare quotients.  Trees split a random statistic at a random place between a node's least and
greatest values.  A document's path is that of a row put into the tree: where it lies outside
a node's values, the node's split would have fallen between it and them with the probability
that the gap has in the range so extended, and would have isolated it there.  The mean of
that over the trees is exact; documents with short paths are anomalous.

The forest is grown from half of the labelled good rows that pass the base rules; the
threshold is the one that separates the other half from the labelled bad rows best while
it rejects at most ``MAX_FALSE`` of the good ones.  Growing and calibrating use at most
``MAX_LABELLED`` labelled rows, those with the least hashes of their ids; statistics and
verdicts cover every row.  Without labelled rows of both kinds only the base rules apply.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from artifact_scan.llm.store import table
from artifact_scan.llm.words import covered, inside, mix, run_hashes, slices, span_hashes, split, word_hashes

MAX_LABELLED = 20_000
TREES, SAMPLE, SEED = 200, 256, 7
MAX_FALSE = 0.002
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?")] = True


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _seen_twice(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs elsewhere too, and whether it occurs earlier."""
    order = np.argsort(keys, kind="stable")
    equal = keys[order[1:]] == keys[order[:-1]]
    again, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = equal
    again[order[:-1]] = equal
    return again | later, later


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """int64 statistics of each text; null and empty texts count 0 throughout."""
    words = split(column)
    data, bounds = words.data, words.bounds
    n = len(bounds) - 1
    hashes = word_hashes(words)
    salt = mix(np.arange(1, n + 1, dtype=np.uint64))
    out = {"n_words": words.counts}
    space = (data == 32) | ((data >= 9) & (data <= 13))
    out["word_chars"] = _per_text(((data & 0xC0) != 0x80) & ~space, bounds)
    out["n_symbols"] = _per_text(_SYMBOL[data], bounds)

    # A line begins at a text's begin or after \n and ends before \n or at the text's end.
    breaks = np.flatnonzero(data == 10)
    begins = np.sort(np.concatenate([bounds[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([bounds[1:], breaks]))
    text_of = np.searchsorted(bounds[1:], ends, "left")
    worded = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, begins)
    begins, ends, text_of = begins[worded], ends[worded], text_of[worded]
    _, later = _seen_twice(span_hashes(data, begins, ends) ^ salt[text_of] if len(begins) else np.zeros(0, np.uint64))
    out["n_dup_lines"] = np.bincount(text_of[later], minlength=n)
    out["n_lines"] = np.bincount(text_of, minlength=n)

    repeated = np.zeros(0, bool)
    if len(hashes) >= WINDOW:
        good = np.flatnonzero(inside(words, WINDOW))
        runs = run_hashes(hashes, WINDOW)[good] ^ salt[words.doc()[good]]
        flags = np.zeros(len(hashes), bool)
        flags[good] = _seen_twice(mix(runs))[0]
        repeated = covered(flags, WINDOW, len(hashes))
    out["n_repeat_words"] = _per_text(repeated, words.first) if len(repeated) else np.zeros(n, np.int64)

    out["n_upper"] = _per_text(_UPPER[data], bounds)
    out["n_marks"] = _per_text(_MARK[data], bounds)
    doubled = np.zeros(len(hashes), bool)
    doubled[1:] = hashes[1:] == hashes[:-1]
    doubled[words.first[:-1][words.counts > 0]] = False
    out["n_doubled"] = _per_text(doubled, words.first)
    return {k: v.astype(np.int64) for k, v in out.items()}


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_doubled")
VERDICTS = ("base_failed", "anomaly", "kept")


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


#: (count, what it is counted in, how much of that is added).
RATES = (("n_symbols", "word_chars", 200), ("n_upper", "word_chars", 200), ("n_marks", "word_chars", 200), ("n_doubled", "n_words", 30), ("n_dup_lines", "n_lines", 5), ("n_repeat_words", "n_words", 30))


def features(s: dict[str, np.ndarray], rng: np.random.Generator | None = None) -> np.ndarray:
    """The rates and the mean length of a word; with ``rng``, rates drawn from what the counts allow."""
    count = lambda k: rng.gamma(s[k] + 1.0) if rng is not None else s[k] + 1.0
    rates = [count(k) / (s[n] + extra) for k, n, extra in RATES]
    return np.stack([*rates, (s["word_chars"] + 150.0) / (s["n_words"] + 30.0)], 1).astype(np.float32)


@dataclass
class Forest:
    """Trees as arrays of shape (trees, nodes); a leaf is its own child and has no bounds."""

    feature: np.ndarray
    split: np.ndarray
    low: np.ndarray  # the node's least and greatest value of its feature
    high: np.ndarray
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray  # of a path that ends here
    levels: int
    norm: float
    threshold: float = 2.0

    def paths(self, x: np.ndarray) -> np.ndarray:
        """The mean path length of each row."""
        out = np.empty(len(x))
        tree = np.arange(len(self.feature))
        for at in range(0, len(x), 512):
            part = x[at : at + 512]
            row = np.arange(len(part))[:, None]
            node = np.zeros((len(part), len(tree)), np.int64)
            reached, total = np.ones(node.shape, np.float32), np.zeros(node.shape, np.float32)
            for level in range(self.levels):
                value = part[row, self.feature[tree, node]]
                low, high = self.low[tree, node], self.high[tree, node]
                gap = np.maximum(low - value, 0) + np.maximum(value - high, 0)
                apart = gap / (high - low + gap)
                total += reached * apart * (level + 1)
                reached *= 1 - apart
                node = np.where(value < self.split[tree, node], self.left[tree, node], self.right[tree, node])
            out[at : at + 512] = (total + reached * self.length[tree, node]).mean(1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / expected length), 0 to 1; high is anomalous."""
        return 2.0 ** (-self.paths(x) / self.norm)


def _expected(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n values."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow(s: dict[str, np.ndarray], trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> Forest:
    rng = np.random.default_rng(seed)
    n = len(s["n_words"])
    sample = min(sample, n)
    levels = max(1, int(np.ceil(np.log2(max(2, sample)))))
    nodes = 2 ** (levels + 1)
    shape = (trees, nodes)
    feature, cut, length = np.zeros(shape, np.int64), np.zeros(shape, np.float32), np.zeros(shape, np.float32)
    bounds = np.full(shape, -np.inf, np.float32), np.full(shape, np.inf, np.float32)
    left = np.tile(np.arange(nodes), (trees, 1))
    right = left.copy()
    for t in range(trees):
        free = 1
        chosen = rng.choice(n, sample, replace=False)
        todo = [(0, features({k: v[chosen] for k, v in s.items()}, rng), 0)]
        while todo:
            node, rows, depth = todo.pop()
            low, high = rows.min(0), rows.max(0)
            wide = np.flatnonzero(high > low)
            if depth == levels or len(rows) <= 1 or not len(wide):
                length[t, node] = depth + _expected(len(rows))
                continue
            f = int(rng.choice(wide))
            at = np.float32(rng.uniform(low[f], high[f]))
            below = rows[:, f] < at
            if not below.any() or below.all():  # the split fell on a bound
                at = high[f]
                below = rows[:, f] < at
            feature[t, node], cut[t, node], bounds[0][t, node], bounds[1][t, node] = f, at, low[f], high[f]
            left[t, node], right[t, node] = free, free + 1
            todo += [(free, rows[below], depth + 1), (free + 1, rows[~below], depth + 1)]
            free += 2
    return Forest(feature, cut, *bounds, left, right, length, levels, max(_expected(sample), 1e-9))


def calibrate(good: np.ndarray, bad: np.ndarray, max_false: float = MAX_FALSE) -> float:
    """The threshold that rejects most of the bad scores above it and at most ``max_false`` of the good ones.

    It lies just below the least of the bad scores so rejected: what no label has shown stays.
    """
    good, bad = np.sort(good), np.sort(bad)
    floor = good[min(len(good) - 1, int(np.ceil(len(good) * (1 - max_false))))]
    above = bad[bad > floor]
    if not len(above):
        return float(good[-1]) + 1e-9
    return float(above[0] - 0.1 * (above[0] - floor))


def _labelled(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` labelled rows, those with the least hashes of their ids: the same rows on every run."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.join(F.broadcast(known), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Forest | None:
    """The calibrated forest, or None without labelled rows of both kinds. The driver gets ``limit`` rows of numbers."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                s = statistics(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("quality"), *(pa.array(s[k]) for k in STATISTICS)], ["quality", *STATISTICS])

    schema = "quality int, " + ", ".join(f"{k} long" for k in STATISTICS)
    rows = _labelled(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), labels, limit)
    # Sorted, as floating-point and random choices must not depend on the order of tasks.
    got = rows.select(F.col("quality").cast("int"), "text").mapInArrow(run, schema).toPandas().sort_values(["quality", *STATISTICS])
    got = got[~base_failed({k: got[k].to_numpy() for k in STATISTICS})]
    known, quality = {k: got[k].to_numpy() for k in STATISTICS}, got["quality"].to_numpy()
    if (quality == 1).sum() < 2 or not (quality == 0).any():
        return None
    # Every other good row is grown on, the rest and the bad ones set the threshold.
    grown = np.zeros(len(got), bool)
    grown[np.flatnonzero(quality == 1)[::2]] = True
    forest = grow({k: v[grown] for k, v in known.items()})
    scores = forest.score(features(known))
    forest.threshold = calibrate(scores[(quality == 1) & ~grown], scores[quality == 0])
    return forest


def judge(docs: DataFrame, forest: Forest | None, without: tuple[str, ...] = ()) -> DataFrame:
    """Every row of ``docs``, but for the columns in ``without``, with the statistics, base_failed, anomaly (double) and kept.

    Null and empty texts have no words, so they fail the base rules; long texts count whole.
    Columns of ``docs`` that have one of these names are replaced; rows that repeat an id are judged
    each by its text, repeated rows get equal verdicts, and a score at the threshold is rejected.
    """
    docs = docs.drop(*STATISTICS, *VERDICTS)
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    columns = [c for c in docs.columns if c not in without]

    def run(batches):
        model = shared.value
        for batch in batches:
            for part in slices(batch):
                s = statistics(part.column("text"))
                failed = base_failed(s)
                score = model.score(features(s)) if model else np.zeros(len(failed))
                kept = ~failed & (score < model.threshold if model else True)
                arrays = [*(part.column(c) for c in columns), *(pa.array(s[k]) for k in STATISTICS), pa.array(failed), pa.array(score), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(arrays, [*columns, *STATISTICS, *VERDICTS])

    schema = docs.select(*columns).schema
    for k in STATISTICS:
        schema = schema.add(k, "long")
    return docs.mapInArrow(run, schema.add("base_failed", "boolean").add("anomaly", "double").add("kept", "boolean"))


def quality(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """``judge`` with a forest fitted on the labelled rows of ``docs``."""
    return judge(docs, fit(docs, labels, limit))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")), without=("text",))
