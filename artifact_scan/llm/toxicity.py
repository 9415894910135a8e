"""Toxicity by a weighted finite-state pattern grammar over clauses.

Texts are cut into letter runs (tokens) and clauses.  A lexicon tags tokens: insults are
word stems learned from labelled rows, each with its log odds; threats, targets,
negations and reporting words are short fixed lists.  Five transducers read a clause's
tags and mark its insults and threats:

insult     an insult is matched if it stands in a clause with other words, never alone; a
           clause of one word goes on in the next, as in shouted or tabled words
threat     a threat is matched if it has a target, never alone
target     a target stands within ``REACH`` tokens before or after
negation   a negation stands within ``REACH`` tokens before
report     a reporting word stands anywhere in the clause

They are composed into one machine that reads forwards and, as targets and reports may
follow what they concern, one that reads backwards; a match has the marks of both.  All
clauses with an insult or a threat run through the machines side by side, a token a step.
A match weighs its log odds times a factor for each of its marks.  The sum over a text's
matches, on a logarithmic scale, passes a logistic curve.  Curve and factors are fitted on
the labelled rows; a factor keeps its prior value where they tell nothing, and is bounded,
so that negated and reported matches always weigh less and targeted ones never do.

Learning uses at most ``MAX_LABELLED`` rows of at most ``MAX_FIT_BYTES`` bytes each, those
with the least hashes of their ids among the rows that are not held out; every text is
scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from artifact_scan.llm.jaccard_join import shingle_sets, signatures
from artifact_scan.llm.store import table
from artifact_scan.llm.words import Words, mix, slices, span_hashes, split, split_bytes, text_buffer

MAX_LABELLED, MAX_FIT_BYTES = 8_000, 1 << 16
MIN_STEM, MAX_STEM = 3, 12  # bytes
ALPHA = 0.01  # chance of any false stem, over all candidates
MAX_IMPURITY = 0.1

# The grammar's closed word classes, in four languages.
THREATS = "kill hurt destroy beat stab shoot burn crush tuer frapper töten schlagen matar golpear".split()
TARGETS = "you your he she they them him her these those people tu vous ils elles du dich ihr euch usted ustedes ellos".split()
NEGATIONS = "not never no don't doesn't isn't ne pas jamais nicht kein keine nie nunca jamás".split()
REPORTS = "said says wrote quoted called claims dit écrit sagte schrieb dijo escribió".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = TAGS = range(6)
TARGETED, NEGATED, REPORTED, ACCOMPANIED = 1, 2, 4, 8  # marks
REACH = 4  # tokens over which a negation or a target acts
THREAT_WEIGHT = 3.0
#: Of each mark: the factor's prior and its bounds.
FACTORS = {TARGETED: (1.3, 1.0, 3.0), NEGATED: (0.4, 0.05, 0.8), REPORTED: (0.5, 0.05, 0.8)}

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), 39, *range(128, 256)]] = True
_CLAUSE = np.zeros(256, bool)
_CLAUSE[list(b".,;:!?\n|()")] = True


@dataclass(frozen=True)
class Transducer:
    """arcs[state, tag] = (next state, marks put on the token read)."""

    start: int
    arcs: dict[tuple[int, int], tuple[int, int]]

    def compose(self, other: Transducer) -> Transducer:
        """Both machines in step: states are pairs, marks are united."""
        pairs = {(self.start, other.start): 0}
        arcs: dict[tuple[int, int], tuple[int, int]] = {}
        todo = [(self.start, other.start)]
        while todo:
            a, b = todo.pop()
            for tag in TAGS:
                (a2, m), (b2, n) = self.arcs[a, tag], other.arcs[b, tag]
                if (a2, b2) not in pairs:
                    pairs[a2, b2] = len(pairs)
                    todo.append((a2, b2))
                arcs[pairs[a, b], tag] = (pairs[a2, b2], m | n)
        return Transducer(0, arcs)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """(next state, marks) by state and tag."""
        n = 1 + max(state for state, _ in self.arcs)
        both = np.array([[self.arcs[state, tag] for tag in TAGS] for state in range(n)])
        return both[:, :, 0], both[:, :, 1]


def _near(trigger: int, mark: int, reach: int = REACH) -> Transducer:
    """Marks what is read at most ``reach`` tokens after a trigger."""
    return Transducer(0, {(s, t): (reach if t == trigger else max(0, s - 1), mark if s else 0) for s in range(reach + 1) for t in TAGS})


def _after(triggers: tuple[int, ...], mark: int) -> Transducer:
    """Marks whatever is read after a trigger."""
    return Transducer(0, {(s, t): (1 if t in triggers else s, mark if s else 0) for s in (0, 1) for t in TAGS})


def _kept(tag: int, need: int, machine: Transducer) -> Transducer:
    """The machine with ``need`` taken off other tags than ``tag``: who needs a mark to match."""
    return Transducer(machine.start, {(s, t): (n, m if t == tag else m & ~need) for (s, t), (n, m) in machine.arcs.items()})


INSULTING = _kept(INSULT, ACCOMPANIED, _after(tuple(TAGS), ACCOMPANIED))
THREATENING = _kept(THREAT, ACCOMPANIED, _near(TARGET, ACCOMPANIED))
TARGETING, NEGATING, REPORTING = _near(TARGET, TARGETED), _near(NEGATION, NEGATED), _after((REPORT,), REPORTED)
FORWARD = INSULTING.compose(THREATENING).compose(TARGETING).compose(NEGATING).compose(REPORTING).tables()
BACKWARD = INSULTING.compose(THREATENING).compose(TARGETING).compose(REPORTING).tables()


def marks_of(tags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The marks of every token of the clauses ``starts``:``ends``, read both ways, all clauses a token a step."""
    out = np.zeros(len(tags), np.int64)
    order = np.argsort(starts - ends, kind="stable")
    starts, ends = starts[order], ends[order]
    sizes = ends - starts
    for (step, marks), first, way in ((FORWARD, starts, 1), (BACKWARD, ends - 1, -1)):
        state = np.zeros(len(starts), np.int64)
        n = len(starts)
        for t in range(int(sizes.max(initial=0))):
            while sizes[n - 1] <= t:  # the longest come first
                n -= 1
            at = first[:n] + way * t
            read = tags[at]
            out[at] |= marks[state[:n], read]
            state[:n] = step[state[:n], read]
    return out


def lower(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals of UTF-8 bytes in lower case."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    out[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 32
    return out


def tokens(column: pa.Array) -> Words:
    """Letter runs, lower-cased."""
    data, bounds = text_buffer(column)
    return split_bytes(lower(data), bounds, ~_LETTER)


def _fixed(words: list[str]) -> np.ndarray:
    joined = "".join(words).encode()
    ends = np.cumsum([len(w.encode()) for w in words])
    return span_hashes(np.frombuffer(joined, np.uint8), np.concatenate([[0], ends[:-1]]), ends)


@dataclass
class Model:
    stems: dict[bytes, tuple[bool, float]]  # stem -> (whole word, weight)
    intercept: float
    slope: float
    factors: dict[int, float] = field(default_factory=lambda: {mark: prior for mark, (prior, _, _) in FACTORS.items()})

    def __post_init__(self):
        """Sorted hash tables: whole words by their hash, stems by length."""
        self.closed = {}
        for tag, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
            for h in _fixed(words):
                self.closed[int(h)] = (tag, THREAT_WEIGHT if tag == THREAT else 0.0)
        self.prefix: dict[int, dict[int, float]] = {}
        for stem, (whole, weight) in self.stems.items():
            h = int(span_hashes(np.frombuffer(stem, np.uint8), np.array([0]), np.array([len(stem)]))[0])
            if whole:
                self.closed[h] = (INSULT, weight)
            else:
                self.prefix.setdefault(len(stem), {})[h] = weight

    def matches(self, column: pa.Array) -> np.ndarray:
        """The weight of each text's matches by their marks but the last: (texts, 8)."""
        words = tokens(column)
        n, total = len(words.bounds) - 1, len(words.starts)
        out = np.zeros((n, ACCOMPANIED))
        if not total:
            return out
        tags, weights = np.zeros(total, np.int8), np.zeros(total)
        keys = np.array(sorted(self.closed), np.uint64)
        kinds = np.array([self.closed[int(k)][0] for k in keys], np.int8)
        values = np.array([self.closed[int(k)][1] for k in keys])
        hashes = span_hashes(words.data, words.starts, words.ends)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        hit = keys[at] == hashes
        tags[hit], weights[hit] = kinds[at[hit]], values[at[hit]]
        size = words.ends - words.starts
        for length, table_ in self.prefix.items():
            long = np.flatnonzero(size >= length)
            keys = np.array(sorted(table_), np.uint64)
            h = span_hashes(words.data, words.starts[long], words.starts[long] + length)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[at] == h
            tags[long[hit]] = INSULT
            weights[long[hit]] = [table_[int(k)] for k in h[hit]]
        hot = np.flatnonzero((tags == INSULT) | (tags == THREAT))
        if not len(hot):
            return out
        # A clause ends at a mark between two tokens and at a text's end; a word between marks goes on in the next clause.
        doc = words.doc()
        clause = np.searchsorted(np.flatnonzero(_CLAUSE[words.data]), words.starts)
        begins = np.concatenate([[True], (clause[1:] != clause[:-1]) | (doc[1:] != doc[:-1])])
        starts = np.flatnonzero(begins)
        alone = np.diff(np.append(starts, total)) == 1
        fresh = np.concatenate([[True], ~alone[:-1] | (doc[starts[1:]] != doc[starts[1:] - 1])])
        starts = starts[fresh]
        ends = np.append(starts[1:], total)
        read = np.unique(np.searchsorted(starts, hot, "right") - 1)
        marks = marks_of(tags, starts[read], ends[read])[hot]
        hot, marks = hot[marks & ACCOMPANIED > 0], marks[marks & ACCOMPANIED > 0]
        np.add.at(out, (doc[hot], marks & ~ACCOMPANIED), weights[hot])
        return out

    def evidence(self, column: pa.Array) -> np.ndarray:
        """The weighted sum of each text's matches."""
        return self.matches(column) @ weights_of(self.factors)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.intercept + self.slope * np.log1p(evidence))))


def weights_of(factors: dict[int, float]) -> np.ndarray:
    """The product of the factors of each set of marks."""
    return np.array([np.prod([f for mark, f in factors.items() if marks & mark] or [1.0]) for marks in range(ACCOMPANIED)])


def _counts(hashes: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, an index of it, toxic texts, other texts) of each distinct hash."""
    order = np.lexsort((doc, hashes)).astype(np.int32)
    h, d = hashes[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d, order = h[new], d[new], order[new]
    del new
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    bad = np.add.reduceat(toxic[d], starts) if len(h) else starts
    return h[starts], order[starts], bad, np.diff(np.append(starts, len(h))) - bad


def learn_stems(column: pa.Array, toxic: np.ndarray) -> dict[bytes, tuple[bool, float]]:
    """Stems whose texts are toxic far more often than chance allows, as short as they stay specific.

    A stem that a longer one replaces without losing texts gives way to it, so a stem is a whole
    common word part and not a chance beginning.
    """
    words = tokens(column)
    doc, size = words.doc().astype(np.int32), (words.ends - words.starts).astype(np.int32)
    rate = float(np.clip(toxic.mean(), 1e-6, 1 - 1e-6))
    found: dict[bytes, tuple[bool, int, int]] = {}
    tested = 0
    for length in range(MIN_STEM, MAX_STEM + 1):
        long = np.flatnonzero(size >= length).astype(np.int32)
        cut = words.starts[long] + length
        # Between characters only: the next byte must not continue one.
        inner = np.append(words.data, 0)[cut]
        long = long[((inner & 0xC0) != 0x80) | (cut == words.ends[long])]
        del cut, inner
        h = span_hashes(words.data, words.starts[long], words.starts[long] + length)
        for whole in (False, True):
            pick = np.flatnonzero(size[long] == length) if whole else np.arange(len(long))
            _, at, bad, good = _counts(mix(h[pick] + np.uint64(whole)), doc[long[pick]], toxic)
            tested += len(at)
            for i in np.flatnonzero((bad >= 3) & (good <= MAX_IMPURITY * (bad + good))):
                s = words.starts[long[pick[at[i]]]]
                found[words.data[s : s + length].tobytes() + (b"$" if whole else b"")] = (whole, int(bad[i]), int(good[i]))
    need = np.log(max(1, tested) / ALPHA)
    found = {k: v for k, v in found.items() if v[1] * np.log(1 / rate) - v[2] * np.log(1 / (1 - rate)) - (v[2] and v[2] * np.log((v[1] + v[2]) / v[2] * np.e)) > need}
    chosen: dict[bytes, tuple[bool, float]] = {}
    for stem in sorted(found, key=lambda k: (len(k), k)):
        whole, bad, good = found[stem]
        if any(stem.startswith(c) for c, (w, _) in chosen.items() if not w):
            continue
        longer = [k for k in found if len(k) > len(stem) and k.startswith(stem) and found[k][1] >= 0.97 * bad]
        if longer and not whole:
            continue
        chosen[stem] = (whole, float(np.log((bad + 0.5) / (good + 0.5)) - np.log(rate / (1 - rate))))
    return {k.rstrip(b"$") if w else k: (w, weight) for k, (w, weight) in chosen.items()}


def fit_curve(evidence: np.ndarray, toxic: np.ndarray, penalty: float = 1e-2) -> tuple[float, float]:
    """Intercept and slope of a logistic curve, by Newton steps with a small ridge on both."""
    x = np.stack([np.ones(len(evidence)), np.log1p(evidence)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(2), x.T @ (toxic - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit_factors(matches: np.ndarray, toxic: np.ndarray, strength: float = 2.0) -> dict[int, float]:
    """The factors of least loss, by descent along each in turn; ``strength`` ties their logarithms to those of the priors."""
    factors = {mark: prior for mark, (prior, _, _) in FACTORS.items()}

    def loss() -> float:
        x = np.log1p(matches @ weights_of(factors))
        a, b = fit_curve(np.expm1(x), toxic)
        z = a + b * x
        return float(np.logaddexp(0, np.where(toxic, -z, z)).sum()) + strength * sum(np.log(f / FACTORS[m][0]) ** 2 for m, f in factors.items())

    for mark, (prior, low, high) in [*FACTORS.items()] * 2:
        tried = []
        for value in sorted({prior, factors[mark], *np.geomspace(low, high, 9)}):
            factors[mark] = float(value)
            tried.append((loss(), float(value)))
        factors[mark] = min(tried)[1]
    return factors


def _different(texts: list[str], toxic: list[int], bands: int = 10) -> dict[str, int]:
    """Texts that are no near copies of an earlier one: chance counts must not see a copied text as many.

    Near copies are guessed from pairs of minimum hashes; a wrong guess costs a training row.
    """
    once: dict[str, int] = {}
    seen: set[tuple] = set()
    for at in range(0, len(texts), 512):
        part = texts[at : at + 512]
        sets, bounds = shingle_sets(split(pa.array(part, pa.large_string())))
        rows = signatures(sets, bounds, 2 * bands).reshape(-1, bands, 2)
        for text, label, row, size in zip(part, toxic[at : at + 512], rows.tolist(), np.diff(bounds)):
            keys = [(i, *pair) for i, pair in enumerate(row)] if size else []
            if size and seen.isdisjoint(keys):
                once[text] = label
            seen.update(keys)
    return once


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Model:
    """A model from at most ``limit`` labelled rows; the driver gets their texts. Without labels nothing is toxic."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.where(F.octet_length("text") <= MAX_FIT_BYTES).join(F.broadcast(known), "doc_id").select("doc_id", "toxic", "text").toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
    once = _different(rows.column("text").to_pylist(), rows.column("toxic").to_pylist())
    del rows
    toxic = np.array(list(once.values()), np.int64)
    if not len(toxic) or toxic.min() == toxic.max():
        return Model({}, -4.0, 0.0)
    column = pa.array(list(once), pa.large_string())
    stems = learn_stems(column, toxic)
    lexicon = Model(stems, 0.0, 0.0)
    matches = np.concatenate([lexicon.matches(column.slice(at, 256)) for at in range(0, len(column), 256)])
    factors = fit_factors(matches, toxic)
    return Model(stems, *fit_curve(matches @ weights_of(factors), toxic), factors)


def held_out(doc_id):
    """Rows never learned from: crc32 of the id as text, modulo 5, is 0. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence), one row for each row of ``docs`` (doc_id, text).

    Null and empty texts, and texts without a match, get the curve's score at no evidence.  Rows
    that repeat an id are scored each; a null id is kept and not held out; other columns of
    ``docs`` are not read; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            for part in slices(batch):
                evidence = model.evidence(part.column("text"))
                p = model.score(evidence)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(evidence)], ["doc_id", "score", "predicted", "evidence"]
                )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = docs.mapInArrow(run, "doc_id long, score double, predicted int, evidence double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
