"""Benchmark decontamination by latent semantic retrieval.

Texts become overlapping passages of ``SPAN`` blocks of ``BLOCK`` tokens (lower-cased
runs of letters and digits).  Their TF-IDF matrix A over the benchmark's terms is factored by a
distributed randomised SVD: tasks add up ``A.T @ (A @ Q)`` for a thin Q, the driver
orthonormalises the sums (terms x ``RANK`` numbers, whatever the corpus), power steps
sharpen them, and the last sum gives the leading right singular vectors by Nystroem's
formula.  Passages and passages of the benchmark's items are compared by cosine in the
space of those vectors.  Where a passage comes near an item, the longest common
subsequence of item and surrounding text says how much of the item stands there in order,
and the words of its last sentence, the answer, must be there too: insertions, omissions
and replaced words do not hide a copy.

The cosine alone misses copies (many items for the rank, terms too common for the
matrix), so a second way leads to the same checks and misses none: an item of n tokens
that must share ``need`` of them has at least k of its n - need + k rarest ones, its
anchors, near every passage that can pass (``Anchors``).  Whatever led to a passage, the
subsequence is only computed where enough of the item's tokens stand around it at all.

The first pass keeps only the benchmark's terms of each text, a few per cent; document
frequencies and the SVD read those.  The second pass reads the texts again and searches
and verifies in place, so no text is ever shuffled.  Two scans serve ``MAX_ITEMS`` items,
which bounds what is broadcast; a larger benchmark is read in rounds of so many.  Texts
longer than ``LONG`` tokens are searched in overlapping pieces, which bounds memory.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from artifact_scan.llm.store import table, written
from artifact_scan.llm.toxicity import _LETTER, lower
from artifact_scan.llm.words import Words, one_blas_thread, slices, split_bytes, text_buffer, word_hashes

BLOCK, SPAN = 16, 3
MAX_ITEMS = 10_000
COMMON = 0.05  # a term in more than this share of the items is a stop term,
LEAST_TERMS = 8  # unless its item has fewer terms left
MAX_DF = 0.002  # terms in a larger share of the passages tell little; an item's rarest stay
RANK, POWER, SEED = 128, 1, 11
MIN_COSINE = 0.45
MIN_LCS, MIN_ANSWER = 0.6, 0.5
SEARCH_SLICE, LONG = 1 << 19, 1 << 17  # bytes of text, and tokens of one text, searched at a time

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def tokens(column: pa.Array) -> Words:
    """Runs of letters and digits, lower-cased."""
    data, bounds = text_buffer(column)
    return split_bytes(lower(data), bounds, ~(_LETTER | _DIGIT))


class Table:
    """A sorted table of hashes, entered by their leading bits."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.shift = np.uint64(64 - min(20, 3 + len(hashes).bit_length()))
        self.first = np.searchsorted(hashes >> self.shift, np.arange(2 ** (64 - int(self.shift)), dtype=np.uint64)).astype(np.int32)
        self.steps = int(np.diff(self.first, append=len(hashes)).max(initial=0))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, indexes in the table) of the hashes that are in it."""
        if not len(self.hashes):
            return (np.zeros(0, np.int64),) * 2
        at = self.first[hashes >> self.shift]
        found = np.full(len(hashes), -1, np.int32)
        for k in range(self.steps):
            there = np.minimum(at + k, len(self.hashes) - 1)
            np.copyto(found, there, where=self.hashes[there] == hashes)
        hit = np.flatnonzero(found >= 0)
        return hit, found[hit].astype(np.int64)


@dataclass
class Items:
    """Benchmark items of one round: token hashes, answers and the term table."""

    ids: list[int]
    tokens: list[np.ndarray]
    answers: list[np.ndarray]
    numbers: list[np.ndarray]  # tokens with a digit in the last sentence
    terms: np.ndarray  # sorted hashes
    vocabulary: np.ndarray = field(init=False)  # sorted hashes of all tokens
    first: np.ndarray = field(init=False)  # bounds of each item's different tokens
    token: np.ndarray = field(init=False)  # their numbers in the vocabulary
    weight: np.ndarray = field(init=False)  # how often they occur in the item
    needed: np.ndarray = field(init=False)
    reach: np.ndarray = field(init=False)
    term_table: Table = field(init=False)
    table: Table = field(init=False)  # of the vocabulary
    places: dict[int, dict[int, int]] = field(init=False, default_factory=dict)  # of items already checked

    def __post_init__(self):
        own = [np.unique(t, return_counts=True) for t in self.tokens]
        none = np.zeros(0, np.uint64)
        self.vocabulary = np.unique(np.concatenate([none, *self.tokens]))
        self.term_table, self.table = Table(self.terms), Table(self.vocabulary)
        self.first = np.concatenate([[0], np.cumsum([len(v) for v, _ in own])]).astype(np.int64)
        self.token = np.searchsorted(self.vocabulary, np.concatenate([none, *(v for v, _ in own)]))
        self.weight = np.concatenate([np.zeros(0, np.int64), *(n for _, n in own)])
        self.needed = np.array([self.need(j) for j in range(len(self.tokens))], np.int64)
        self.reach = np.array([reach_of(len(t)) for t in self.tokens], np.int64)

    def need(self, j: int) -> int:
        """The least number of item j's tokens that makes a share of MIN_LCS."""
        n = len(self.tokens[j])
        return next(c for c in range(int(MIN_LCS * n), n + 1) if c / n >= MIN_LCS)

    @classmethod
    def of(cls, rows: list[tuple[int, str]], common: float = COMMON) -> Items:
        rows = [(i, t) for i, t in rows if t]
        words = tokens(pa.array([t for _, t in rows], pa.large_string()))
        hashes = word_hashes(words)
        ids, lists, answers, numbers = [], [], [], []
        count: dict[int, int] = {}
        for d, (i, _) in enumerate(rows):
            own = hashes[words.first[d] : words.first[d + 1]]
            if not len(own):
                continue
            ids.append(i)
            lists.append(own)
            start = _sentence_at(words, d)
            answers.append(own[max(0, min(start, len(own) - 4)) :])
            numbers.append(own[start:][_numeric(words, d)[start:]])
            for h in np.unique(own).tolist():
                count[h] = count.get(h, 0) + 1
        limit = max(2, common * len(ids))
        chosen: set[int] = set()
        for own in lists:
            ranked = sorted(set(own.tolist()), key=lambda h: (count[h], h))
            rare = [h for h in ranked if count[h] <= limit]
            chosen.update(rare if len(rare) >= LEAST_TERMS else ranked[:LEAST_TERMS])
        return cls(ids, lists, answers, numbers, np.array(sorted(chosen), np.uint64))

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, term numbers) of the hashes that are terms."""
        return self.term_table.find(hashes)

    def enough(self, first: np.ndarray, pos: np.ndarray, token: np.ndarray, doc: np.ndarray, item: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Whether enough of the item's tokens stand around each passage (text, item, block) for the subsequence to pass.

        pos, token: where the vocabulary's tokens stand in the texts, which begin at ``first``.
        """
        size = int(first[-1])
        key = np.sort(token * (size + 1) + pos)
        out = np.zeros(len(doc), bool)
        step = max(1, (1 << 20) // max(1, int(np.diff(self.first).max(initial=1))))
        for at in range(0, len(doc), step):
            j = item[at : at + step]
            lo, hi = around(first, self.reach, doc[at : at + step], j, block[at : at + step])
            count = self.first[j + 1] - self.first[j]
            owner = np.repeat(np.arange(len(j)), count)
            own = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - self.first[j], count)
            base = self.token[own] * (size + 1)
            found = np.minimum(np.searchsorted(key, base + lo[owner]), len(key) - 1)
            there = (key[found] >= base + lo[owner]) & (key[found] < base + hi[owner])
            out[at : at + step] = np.bincount(owner, self.weight[own] * there, minlength=len(j)) >= self.needed[j]
        return out


def around(first: np.ndarray, reach: np.ndarray, doc: np.ndarray, item: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that are read around each passage for its item."""
    begin = first[doc] + block * BLOCK
    return np.maximum(first[doc], begin - reach[item]), np.minimum(first[doc + 1], begin + SPAN * BLOCK + reach[item])


def reach_of(n: int) -> int:
    """How many tokens before and after a passage are read with it for an item of n tokens."""
    return max(BLOCK, n - SPAN * BLOCK + BLOCK)


@dataclass
class Anchors:
    """Tokens by item without which an item cannot stand in a place, and how many must be there."""

    first: np.ndarray  # bounds of the postings of each token of the vocabulary
    item: np.ndarray
    weight: np.ndarray  # how often the token occurs in the item
    least: np.ndarray  # by item
    reach: np.ndarray  # by item

    @classmethod
    def of(cls, known: Items, df: np.ndarray) -> Anchors:
        """The rarest tokens of each item by document frequency, words that are no terms last."""
        tokens_, items, weights, least = [], [], [], []
        for j, own in enumerate(known.tokens):
            token, weight = (x[known.first[j] : known.first[j + 1]] for x in (known.token, known.weight))
            cost = np.full(len(token), np.iinfo(np.int64).max)
            at, term = known.lookup(known.vocabulary[token])
            cost[at] = df[term]
            order = np.lexsort((token, cost))
            need = int(known.needed[j])
            sums = np.cumsum(weight[order])
            n = int(np.searchsorted(sums, len(own) - need + max(1, need // 3))) + 1
            tokens_.append(token[order[:n]])
            weights.append(weight[order[:n]])
            items.append(np.full(n, j))
            least.append(int(sums[n - 1]) - len(own) + need)
        token = np.concatenate(tokens_)
        order = np.argsort(token, kind="stable")
        first = np.searchsorted(token[order], np.arange(len(known.vocabulary) + 1))
        return cls(first, np.concatenate(items)[order], np.concatenate(weights)[order], np.array(least), known.reach)

    def places(self, first: np.ndarray, hit: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, block) of every passage whose surroundings hold enough of an item's anchors.

        hit, token: where the vocabulary's tokens stand in the texts, which begin at ``first``.
        """
        lo, count = self.first[token], self.first[token + 1] - self.first[token]
        posting = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - lo, count)
        item, pos = self.item[posting], np.repeat(hit, count)
        order = np.argsort(item, kind="stable")
        posting, item, pos = posting[order], item[order], pos[order]
        size = int(first[-1]) + 1
        key, sums = item * size + pos, np.concatenate([[0], np.cumsum(self.weight[posting])])
        # Tokens that end a stretch, as long as is read around a passage, with enough anchors.
        doc = np.searchsorted(first, pos, "right") - 1
        around = self.reach[item]
        begin = np.maximum(first[doc], pos - SPAN * BLOCK - 2 * around + 1)
        good = sums[1:] - sums[np.searchsorted(key, item * size + begin)] >= self.least[item]
        item, pos, doc, around = item[good], pos[good], doc[good], around[good]
        # The passages around which those are read, each once: both ends rise with the token.
        passages = passages_of(-(-np.diff(first) // BLOCK))
        base = np.concatenate([[0], np.cumsum(passages)])
        rel = pos - first[doc]
        low = np.maximum(0, (rel - SPAN * BLOCK - around) // BLOCK + 1)
        high = np.minimum(passages[doc] - 1, (rel + around) // BLOCK)
        low, high = (item * base[-1] + base[doc] + v for v in (low, high))
        low[1:] = np.maximum(low[1:], high[:-1] + 1)
        count = np.maximum(0, high - low + 1)
        item, doc = np.repeat(item, count), np.repeat(doc, count)
        block = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - low, count) - item * base[-1] - base[doc]
        begin = first[doc] + block * BLOCK - self.reach[item]
        end = np.minimum(first[doc + 1], begin + SPAN * BLOCK + 2 * self.reach[item])
        begin = np.maximum(first[doc], begin)
        lo, hi = np.searchsorted(key, item * size + begin), np.searchsorted(key, item * size + end)
        enough = np.flatnonzero(sums[hi] - sums[lo] >= self.least[item])
        # Of those, the ones with enough different anchors: only the first of each in the place counts.
        order = np.argsort(posting, kind="stable")
        again = posting[order][1:] == posting[order][:-1]
        before = np.full(len(posting), -1)
        before[order[1:][again]] = order[:-1][again]
        kept = []
        for part in np.split(enough, range(1 << 12, len(enough), 1 << 12)):
            count = hi[part] - lo[part]
            owner = np.repeat(np.arange(len(part)), count)
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - lo[part], count)
            there = np.bincount(owner, self.weight[posting[at]] * (before[at] < lo[part][owner]), minlength=len(part))
            kept.append(part[there >= self.least[item[part]]])
        enough = np.concatenate(kept)
        return doc[enough], item[enough], block[enough]


def _sentence_at(words: Words, d: int) -> int:
    """The first token of a text's last sentence; a point or colon between digits ends none."""
    lo, hi = int(words.first[d]), int(words.first[d + 1])
    data = words.data[words.bounds[d] : words.ends[hi - 1]]
    stops = np.flatnonzero(np.isin(data[:-1], list(b".!?:\n")))
    stops = stops[~(_DIGIT[data[np.maximum(stops - 1, 0)]] & _DIGIT[data[stops + 1]])] + words.bounds[d]
    return int(np.searchsorted(words.starts[lo:hi], stops[-1])) if len(stops) else 0


def _numeric(words: Words, d: int) -> np.ndarray:
    """Which tokens of a text have a digit."""
    lo, hi = int(words.first[d]), int(words.first[d + 1])
    digits = np.concatenate([[0], np.cumsum(_DIGIT[words.data[words.bounds[d] : words.bounds[d + 1]]])])
    return digits[words.ends[lo:hi] - words.bounds[d]] > digits[words.starts[lo:hi] - words.bounds[d]]


def places_of(item: np.ndarray) -> dict[int, int]:
    """For each token the bits of its places in the item."""
    where: dict[int, int] = {}
    for i, h in enumerate(item.tolist()):
        where[h] = where.get(h, 0) | 1 << i
    return where


def lcs(where: dict[int, int], n: int, region: list[int]) -> int:
    """Length of the longest common subsequence of a region and an item of n tokens, bit-parallel over the item."""
    full = (1 << n) - 1
    v = full
    for h in region:
        m = where.get(h)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def _terms_of(docs: DataFrame, items) -> DataFrame:
    """(n_blocks, blocks, terms) of each text that has a term: where each occurrence stands."""

    def run(batches):
        known = items.value
        for batch in batches:
            for part in slices(batch):
                words = tokens(part.column("text"))
                at, term = known.lookup(word_hashes(words)) if len(words.starts) else (np.zeros(0, np.int64),) * 2
                doc = words.doc()[at]
                block = (at - words.first[doc]) // BLOCK
                edges = np.searchsorted(doc, np.arange(part.num_rows + 1))
                n = -(-words.counts // BLOCK)
                rows = np.flatnonzero(words.counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(n[rows].astype(np.int64)),
                        pa.array([block[edges[d] : edges[d + 1]].astype(np.uint32).tobytes() for d in rows], pa.binary()),
                        pa.array([term[edges[d] : edges[d + 1]].astype(np.uint32).tobytes() for d in rows], pa.binary()),
                    ],
                    ["n_blocks", "blocks", "terms"],
                )

    return docs.mapInArrow(run, "n_blocks long, blocks binary, terms binary")


def passages_of(n_blocks: np.ndarray) -> np.ndarray:
    """A text of up to SPAN blocks is one passage; else each block but the last ones begins one."""
    return np.maximum(1, n_blocks - SPAN + 1)


def _unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, int]:
    """(global block, term, number of blocks) of all occurrences; SPAN - 1 empty blocks part the texts."""
    n = batch.column("n_blocks").to_numpy() + SPAN - 1
    base = np.concatenate([[0], np.cumsum(n)])
    blocks = [np.frombuffer(b, np.uint32) for b in batch.column("blocks").to_pylist()]
    count = [len(b) for b in blocks]
    block = np.concatenate(blocks).astype(np.int64) + np.repeat(base[:-1], count) if blocks else np.zeros(0, np.int64)
    term = np.frombuffer(b"".join(batch.column("terms").to_pylist()), np.uint32).astype(np.int64)
    return block + SPAN - 1, term, int(base[-1]) + SPAN - 1


def _frequencies(found: DataFrame, n_terms: int) -> tuple[np.ndarray, int]:
    """In how many passages each term occurs, and the number of passages."""

    def run(batches):
        total, df = 0, np.zeros(n_terms, np.int64)
        for part in (batch.slice(at, 1024) for batch in batches for at in range(0, batch.num_rows, 1024)):
            total += int(passages_of(part.column("n_blocks").to_numpy()).sum())
            block, term, _ = _unpack(part)
            # An occurrence in block b is in the SPAN passages that begin at b - SPAN + 1 to b; those that an
            # earlier occurrence of the term is in too are not counted again.
            key = np.sort((term << 32) | block)
            gap = np.full(len(key), SPAN)
            gap[1:] = np.minimum(np.diff(key), SPAN)  # another term is further away than any block
            df += np.bincount(key >> 32, gap, minlength=n_terms).astype(np.int64)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, n_terms)), pa.array(np.append(df[some], total))], ["term", "df"])

    out = np.zeros(n_terms + 1, np.int64)
    for r in found.mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row a term
        out[r["term"]] = r["df"]
    return out[:-1], int(out[-1])


def _window(x: np.ndarray, n: int) -> np.ndarray:
    """The sum of each row and the ``n`` - 1 rows after it."""
    out = x.copy()
    for k in range(1, n):
        out[:-k] += x[k:]
    return out


def _latent(block: np.ndarray, term: np.ndarray, n: int, idf: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared TF-IDF norm, projection on the basis) of the passage that begins at each of ``n`` blocks; ``block`` ascends."""
    sums, square = np.zeros((n + SPAN, basis.shape[1]), np.float32), np.zeros(n + SPAN)
    if len(block):
        starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        rows = basis[term]
        rows *= idf[term][:, None]
        sums[block[starts]] = np.add.reduceat(rows, starts, axis=0)
        square[block[starts]] = np.add.reduceat(idf[term] ** 2, starts)
    return _window(square, SPAN)[:n], _window(sums, SPAN)[:n]


def _gram_times(found: DataFrame, idf: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``A.T @ (A @ q)`` over all passages, rows of A scaled to length 1."""
    shared = found.sparkSession.sparkContext.broadcast((idf.astype(np.float32), q.astype(np.float32)))
    shape, shards = q.shape, 32

    def add(batches):
        one_blas_thread()
        idf, q = shared.value
        total = np.zeros(shape, np.float64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                block, term, n = _unpack(batch.slice(at, 256))
                used = idf[term] > 0
                block, term = block[used], term[used]
                if not len(block):
                    continue
                square, x = _latent(block, term, n, idf, q)
                x /= np.maximum(square, 1e-30).astype(np.float32)[:, None]
                # Back from passages to the blocks they hold, and from those to terms.
                back = _window(x[::-1], SPAN)[::-1]
                order = np.argsort(term, kind="stable")
                starts = np.flatnonzero(np.concatenate([[True], term[order][1:] != term[order][:-1]]))
                some = term[order][starts]
                total[some] += np.add.reduceat(back[block[order]], starts, axis=0) * idf[some][:, None]
        parts = np.array_split(total, shards)
        yield pa.RecordBatch.from_arrays([pa.array(range(shards), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["shard", "part"])

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for shard, part in zip(batch.column("shard").to_pylist(), batch.column("part").to_pylist()):
                values = np.frombuffer(part, np.float64)
                sums[shard] = sums[shard] + values if shard in sums else values
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["shard", "part"])

    kind = "shard int, part binary"
    got = found.mapInArrow(add, kind).repartition(shards, "shard").mapInArrow(merge, kind).collect()  # terms x RANK numbers in all
    return np.concatenate([np.frombuffer(r["part"], np.float64) for r in sorted(got, key=lambda r: r["shard"])]).reshape(shape) if got else np.zeros(shape)


def singular_basis(gram_times, n: int, rank: int = RANK, power: int = POWER, seed: int = SEED) -> np.ndarray:
    """The leading right singular vectors of A (terms x rank); ``gram_times(q)`` is ``A.T @ (A @ q)``.

    A randomised range finder with power steps; the last product serves Nystroem's formula, so
    ``power`` + 1 products are all.
    """
    rank = min(rank, n)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, rank)))[0]
    for _ in range(power):
        q = np.linalg.qr(gram_times(q))[0]
    y = gram_times(q)
    shift = 1e-9 * max(np.linalg.norm(y), 1e-30)
    y = y + shift * q
    small = q.T @ y
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    half = vectors / np.sqrt(np.maximum(values, shift))
    return np.linalg.svd(y @ half, full_matrices=False)[0]


def _pieces(first: np.ndarray, reach: int):
    """(texts, lo, hi, first) for all texts, or for overlapping pieces of a text that is too long for one step."""
    total = int(first[-1])
    if total <= LONG or len(first) > 2:
        yield 0, total, first
        return
    overlap = -(-(2 * reach + SPAN * BLOCK) // BLOCK) * BLOCK
    step = max(LONG // BLOCK * BLOCK, 2 * overlap)
    for lo in range(0, max(1, total - overlap), step):
        hi = min(total, lo + step + overlap)
        yield lo, hi, np.array([0, hi - lo])


def _search(docs: DataFrame, items, model) -> DataFrame:
    def run(batches):
        one_blas_thread()
        known = items.value
        idf, basis, queries, owner, anchors = model.value
        as_term = np.full(len(known.vocabulary), -1)
        at, number = known.lookup(known.vocabulary)
        as_term[at] = number
        rows_at_once = max(16, (1 << 20) // max(1, len(queries)))
        reach = int(known.reach.max(initial=0))
        for batch in batches:
            for part in slices(batch, limit=SEARCH_SLICE):
                words = tokens(part.column("text"))
                if not len(words.starts):
                    continue
                every = word_hashes(words)
                best: dict[tuple[int, int], tuple[float, int, float, float]] = {}
                for lo, hi, first in _pieces(words.first, reach):
                    hashes = every[lo:hi]
                    pos, token = known.table.find(hashes)
                    term = as_term[token]
                    used = np.flatnonzero((term >= 0) & (idf[term] > 0))
                    at, term = pos[used], term[used]
                    base = np.concatenate([[0], np.cumsum(-(-np.diff(first) // BLOCK) + SPAN - 1)])
                    doc = np.searchsorted(first, at, "right") - 1
                    block = base[doc] + (at - first[doc]) // BLOCK + SPAN - 1
                    _, x = _latent(block, term, int(base[-1]) + SPAN - 1, idf, basis)
                    length = np.linalg.norm(x, axis=1)
                    full = np.flatnonzero(length > 0)
                    found = [anchors.places(first, pos, token)]
                    for k in range(0, len(full), rows_at_once):
                        rows = full[k : k + rows_at_once]
                        near = np.nonzero((x[rows] / length[rows, None]) @ queries.T >= MIN_COSINE)
                        begin = rows[near[0]]
                        d = np.searchsorted(base, begin, "right") - 1
                        found.append((d, owner[near[1]], begin - base[d] - SPAN + 1))
                    d, j, b = (np.concatenate(c).astype(np.int64) for c in zip(*found))
                    if not len(d):
                        continue
                    key = np.sort((d * len(known.ids) + j) * (int(base[-1]) + SPAN) + b + SPAN)
                    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
                    rest, b = np.divmod(key, int(base[-1]) + SPAN)
                    (d, j), b = np.divmod(rest, len(known.ids)), b - SPAN
                    good = known.enough(first, pos, token, d, j, b)
                    for d_, j_, b_ in zip(d[good].tolist(), j[good].tolist(), b[good].tolist()):
                        v = x[base[d_] + b_ + SPAN - 1]
                        norm = np.linalg.norm(v)
                        cosine = float((queries[owner == j_] @ v).max(initial=0.0) / norm) if norm > 0 else 0.0
                        _check(known, first, hashes, d_, b_, j_, cosine, best)
                if best:
                    ids = part.column("doc_id").to_pylist()
                    rows_ = [(ids[d], known.ids[j], *v) for (d, j), v in best.items()]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows_)], ["doc_id", "item_id", "cosine", "common", "lcs", "answer"])

    return docs.mapInArrow(run, "doc_id long, item_id long, cosine double, common long, lcs double, answer double")


def _check(known: Items, first: np.ndarray, hashes: np.ndarray, d: int, block: int, j: int, cosine: float, best: dict) -> None:
    """Verifies item j around a passage and keeps the best of its places in text d."""
    have = best.get((d, j))
    if have and have[2] == 1.0:
        return
    lo, hi = around(first, known.reach, d, j, block)
    region = hashes[lo:hi].tolist()
    seen = set(region)
    share_of = lambda tokens: sum(h in seen for h in tokens.tolist()) / len(tokens)
    there = share_of(known.answers[j])
    if len(known.numbers[j]):
        there = min(there, share_of(known.numbers[j]))
    if there < MIN_ANSWER:
        return
    n = len(known.tokens[j])
    if j not in known.places:
        known.places[j] = places_of(known.tokens[j])
    common = lcs(known.places[j], n, region)
    share = common / n
    if share >= MIN_LCS and (not have or share > have[2]):
        best[d, j] = (cosine, common, share, there)


def contaminated(docs: DataFrame, benchmark: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """(doc_id, item_id, cosine, common, lcs, answer): each text and benchmark item that stands in it.

    common counts the item's tokens found in order, lcs is their share, answer the share of its
    last sentence's tokens, or of its numbers where fewer of those are there; of a text's places
    the one of the largest share counts, the first of equals.  An item of one token stands in
    every text with that token.  Null texts and items, and those without letters or digits, match
    nothing; texts of any length are searched whole; rows that repeat an id are searched each, and
    repeated result rows are merged; other columns are not read; empty tables give an empty
    result.  ``max_items`` bounds what is broadcast at a time and does not change the result but
    for the cosines, whose space is that of a round's items.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    rest = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    last = None
    while True:
        page = rest if last is None else rest.where((F.col("item_id") > last[0]) | (F.col("item_id") == last[0]) & (F.col("text") > F.lit(last[1])))
        rows = [(r["item_id"], r["text"]) for r in page.orderBy("item_id", "text").limit(max_items).collect()]
        if not rows:
            break
        last = rows[-1]
        known = Items.of(rows)
        if len(known.terms):
            found = _round(docs, known)
            out = found if out is None else out.unionByName(found)
        if len(rows) < max_items:
            break
    if out is None:
        return spark.createDataFrame([], "doc_id long, item_id long, cosine double, common long, lcs double, answer double")
    return out.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("cosine", "common", "lcs", "answer")))


def _specific(known: Items, df: np.ndarray, n: int) -> np.ndarray:
    """The terms that enter the matrix: rare ones, and the rarest of each item."""
    use = df <= MAX_DF * n
    for own in known.tokens:
        _, term = known.lookup(np.unique(own))
        if use[term].sum() < LEAST_TERMS:
            use[term[np.lexsort((term, df[term]))][:LEAST_TERMS]] = True
    return use


def _round(docs: DataFrame, known: Items) -> DataFrame:
    context = docs.sparkSession.sparkContext
    items = context.broadcast(known)
    found = written(_terms_of(docs, items), "terms")
    df, n = _frequencies(found, len(known.terms))
    idf = np.where(_specific(known, df, n), np.log((n + 1) / (df + 1)) + 1e-3, 0.0)
    basis = singular_basis(lambda q: _gram_times(found, idf, q), len(idf))
    queries, owner = _queries(known, idf, basis)
    model = context.broadcast((idf.astype(np.float32), basis.astype(np.float32), queries.astype(np.float32), owner, Anchors.of(known, df)))
    return _search(docs, items, model)


def _queries(known: Items, idf: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, items) of the items' passages: an item longer than a passage is cut as the texts are, at every other block."""
    rows, owner = [], []
    for j, own in enumerate(known.tokens):
        for lo in range(0, max(1, len(own) - SPAN * BLOCK + 2 * BLOCK), 2 * BLOCK):
            _, term = known.lookup(own[lo : lo + SPAN * BLOCK])
            v = (basis[term] * idf[term][:, None]).sum(0)
            norm = np.linalg.norm(v)
            if norm > 0:
                rows.append(v / norm)
                owner.append(j)
    return np.array(rows).reshape(-1, basis.shape[1]), np.array(owner, np.int64)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
