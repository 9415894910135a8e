"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

A text's set is that of its five-word shingles (a text of one to four words has one
shingle, all its words).  Texts with equal sets form a class and enter once.  Each class
stands in ``TREES`` tries under its label of ``DEPTH`` minimum hashes; the tries are kept
as one table sorted by tree and label, in which classes that share a prefix are
neighbours.  What shares no prefix of use with either neighbour leaves at once.

Classes that share a whole label meet first.  Then the prefix is shortened step by step.
The similarities found so far tell how many pairs prefixes of that length miss (a pair of
similarity s meets with probability ``meeting(s, length)``, so each one found stands for
1 / that many), and shortening ends when the recall so estimated reaches ``RECALL``, or at
the length at which even pairs at the threshold reach it.  Sets of classes that several
tries or lengths bring together again are dropped before any signature moves.

Classes that meet are compared by whole signatures, whose agreement estimates the
similarity; pairs within ``SIGMAS`` standard errors of the threshold are candidates, of
which a spanning forest is emitted.  In a crowd of more than ``BUCKET_BLOCK`` classes all are
first compared with the least one: those very near to it leave with an edge, and by the
triangle inequality whatever they link to gets an edge too.  The rest elect again while they
are many (``BLOCKS``, at most ``ELECTIONS`` times), and what is left is compared in blocks.

Exact verification takes each connected component of candidates.  Small ones are counted
at once.  In large ones, classes at a distance of at most half the threshold's from the
least class are linked to each other for sure and are only counted; pairs with any other
class are compared in blocks of bounded size.  Links are exact, no pair is ever a row,
and nothing is capped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from artifact_scan.llm.components import components
from artifact_scan.llm.groups import forest, grouped
from artifact_scan.llm.store import broadcast_if_small, maybe_among, table, written
from artifact_scan.llm.words import Words, inside, mix, one_blas_thread, run_hashes, slices, split, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL, SIGMAS = 32, 8, 0.9999, 4.5
BUCKET_BLOCK = 512  # classes compared with each other in one step
ELECTIONS, BLOCKS, NEAR = 8, 16, 0.9  # in crowds beyond that, while more than BLOCKS such steps' rows are left; and the estimated similarity with which a class leaves
SET_BLOCK, CLASS_BLOCK = 1 << 17, 1024  # shingles, and classes, verified against each other in one step

_U = np.uint64


def meeting(similarity: float, length: int, trees: int = TREES) -> float:
    """The probability that two classes share a prefix of that length in some trie."""
    return 1 - (1 - similarity**length) ** trees


def prefix_length(threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix with which a pair at the threshold meets with the target recall: none shorter is ever needed."""
    length = depth
    while length > 1 and meeting(threshold, length, trees) < recall:
        length -= 1
    return length


def shingle_sets(words: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each text, and their bounds."""
    hashes, counts = word_hashes(words), words.counts
    good = np.flatnonzero(inside(words, n))
    values, doc = run_hashes(hashes, n)[good] if len(good) else np.zeros(0, np.uint64), words.doc()[good]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        whole = np.full(len(short), 0x5851F42D4C957F2D, np.uint64)
        for k in range(n - 1):
            has = counts[short] > k
            whole[has] = mix(whole[has] * _U(3) ^ hashes[words.first[short[has]] + k])
        values, doc = np.concatenate([values, whole]), np.concatenate([doc, short])
    order = np.argsort(values, kind="stable")
    few = np.uint16 if len(counts) < 1 << 16 else np.int64
    order = order[np.argsort(doc[order].astype(few), kind="stable")]
    values, doc = values[order], doc[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    values, doc = values[new], doc[new]
    return values, np.searchsorted(doc, np.arange(len(counts) + 1))


def signatures(values: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """``size`` 16-bit minimum hashes of each set; an empty set's are 0."""
    sizes = np.diff(bounds)
    out = np.zeros((len(sizes), size), np.uint16)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    x = (values >> _U(32)).astype(np.uint32)
    seeds = mix(np.arange(1, size + 1, dtype=np.uint64))
    at = bounds[:-1][full]
    for i in range(size):
        a, b = np.uint32(int(seeds[i]) & 0xFFFFFFFF | 1), np.uint32(int(seeds[i]) >> 32)
        y = x * a
        y ^= b
        least = np.minimum.reduceat(y, at)
        out[full, i] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def _prints(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two fingerprints of each set; an empty set's are 0."""
    n, full = np.diff(bounds), np.flatnonzero(np.diff(bounds))
    prints = np.zeros((2, len(n)), np.uint64)
    for i in (0, 1):
        if len(full):
            prints[i, full] = np.add.reduceat(mix(values ^ _U(0x9D39247E33776D41 * (i + 1) & 0xFFFFFFFFFFFFFFFF)), bounds[:-1][full])
    return prints.view(np.int64)


def printed(docs: DataFrame, name: str = "print") -> DataFrame:
    """``docs`` with the first fingerprint of each text's set as column ``name``."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield part.append_column(name, pa.array(_prints(*shingle_sets(split(part.column("text"))))[0]))

    return docs.mapInArrow(run, docs.select("*").schema.add(name, "long"))


def _sketch(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, signature, short); f1 and f2 identify the set.

    ``short`` has eight bits of each minimum hash, enough to compare whole signatures: different
    hashes agree in them by chance in one of 256 places, which loses no pair.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                values, bounds = shingle_sets(split(part.column("text")))
                n, prints = np.diff(bounds), _prints(values, bounds)
                rows = signatures(values, bounds, size)
                packed = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (rows, rows.astype(np.uint8))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(prints[0]), pa.array(prints[1]), *packed],
                    ["doc_id", "n_shingles", "f1", "f2", "signature", "short"],
                )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, signature binary, short binary")


def _matrix(column: pa.Array, size: int, kind: type = np.uint8) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, size)


def _labels(classes: DataFrame, trees: int, depth: int) -> DataFrame:
    """(tree, hi, lo, class_id): each class under its label in each trie; hi and lo hold four minimum hashes each."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                sigs = np.zeros((part.num_rows, trees, 8), ">u2")
                sigs[:, :, :depth] = _matrix(part.column("signature"), trees * depth, np.uint16).reshape(-1, trees, depth)
                words = sigs.view(">u8").astype(np.int64)
                tree = np.tile(np.arange(trees, dtype=np.int32), part.num_rows)
                ids = np.repeat(part.column("class_id").to_numpy(), trees)
                arrays = [tree, words[:, :, 0].reshape(-1), words[:, :, 1].reshape(-1), ids]
                yield pa.RecordBatch.from_arrays([*map(pa.array, arrays)], ["tree", "hi", "lo", "class_id"])

    return classes.select("class_id", "signature").mapInArrow(run, "tree int, hi long, lo long, class_id long")


def _tries(labels: DataFrame, least: int) -> DataFrame:
    """Labels in sorted order with ``shared``, the longest prefix shared with a neighbour; those below ``least`` are left out.

    A partition's first and last rows do not see their neighbours outside and count as sharing all.
    """

    def run(batches):
        held, before = None, 8
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([*([held] if held is not None else []), batch]).combine_chunks().to_batches()[0]
            hi, lo = (rows.column(c).to_numpy().astype(">i8").view(">u2").reshape(-1, 4) for c in ("hi", "lo"))
            label = np.concatenate([rows.column("tree").to_numpy()[:, None].astype(np.int64), hi, lo], 1)
            equal = np.logical_and.accumulate(label[1:] == label[:-1], 1)
            common = np.maximum(0, equal.sum(1) - 1)  # without the tree
            shared = np.maximum(np.concatenate([[before], common]), np.concatenate([common, [8]]))
            keep = np.flatnonzero(shared[:-1] >= least)
            yield rows.take(pa.array(keep)).append_column("shared", pa.array(shared[keep].astype(np.int32)))
            held, before = rows.slice(rows.num_rows - 1), int(common[-1]) if len(common) else before
        if held is not None:
            yield held.append_column("shared", pa.array([8], pa.int32()))

    sorted_ = labels.repartitionByRange("tree", "hi", "lo", "class_id").sortWithinPartitions("tree", "hi", "lo", "class_id")
    return sorted_.mapInArrow(run, "tree int, hi long, lo long, class_id long, shared int")


def _branches(tries: DataFrame, length: int) -> DataFrame:
    """(branch, class_id) of the classes that may share a prefix of that length, by a hash of tree and prefix."""
    mask = lambda n: (-1 << 16 * (4 - n)) if n > 0 else 0
    hi, lo = (F.col(c).bitwiseAND(F.lit(mask(n)).cast("long")) for c, n in (("hi", min(length, 4)), ("lo", length - 4)))
    return tries.where(F.col("shared") >= length).select(F.xxhash64("tree", hi, lo).alias("branch"), "class_id")


def _block_pairs(df: DataFrame, blocks: str) -> DataFrame:
    """Each row once for every pair (bi <= bj) of its group's ``blocks`` blocks that holds its own."""
    own = F.pmod(F.xxhash64("class_id"), F.col(blocks)).cast("int")
    df = df.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int"))))
    return df.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other")).drop("other")


_EDGES = "a long, b long, agree int"


def _candidates(met: DataFrame, size: int, least: int) -> DataFrame:
    """Spanning edges (a, b) of the pairs that agree in at least ``least`` of ``size`` signature places; agree: a's most."""

    def run(batches):
        for rows, starts, ends in grouped(batches, ["branch", "bi", "bj"]):
            ids, block = rows.column("class_id").to_numpy(), rows.column("block").to_numpy()
            same = rows.column("bi").to_numpy() == rows.column("bj").to_numpy()
            sigs = _matrix(rows.column("signature"), size)
            found: list[list] = [[], [], []]
            for lo, hi in zip(starts, ends):
                s, n = sigs[lo:hi], hi - lo
                if n < 2:
                    continue
                if n == 2:
                    agree = int((s[0] == s[1]).sum())
                    if agree >= least and (same[lo] or block[lo] != block[lo + 1]):
                        for column, value in zip(found, (ids[lo + 1], ids[lo], agree)):
                            column.append(value)
                    continue
                links, most = np.zeros((n, n), bool), np.zeros(n, np.int32)
                step = max(1, (1 << 22) // (n * size))
                for at in range(0, n, step):
                    agree = (s[at : at + step, None, :] == s[None, :, :]).sum(2, dtype=np.int32)
                    agree[np.arange(len(agree)), np.arange(at, at + len(agree))] = 0
                    if not same[lo]:
                        agree *= block[lo + at : lo + at + len(agree), None] != block[None, lo:hi]
                    links[at : at + step], most[at : at + step] = agree >= least, agree.max(1)
                root = forest(links)
                tied = np.flatnonzero(root != np.arange(n))
                for column, value in zip(found, (ids[lo:hi][tied], ids[lo:hi][root[tied]], most[tied])):
                    column.extend(value)
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.int32())], ["a", "b", "agree"])

    met = met.repartition("branch", "bi", "bj").sortWithinPartitions("branch", "bi", "bj")
    return met.select("branch", "bi", "bj", "block", "class_id", "signature").mapInArrow(run, _EDGES)


def slack(similarity: float, size: int) -> float:
    """``SIGMAS`` standard errors of the similarity that ``size`` minimum hashes estimate."""
    return SIGMAS * float(np.sqrt(max(0.0, similarity * (1 - similarity)) / size))


def reach_of(threshold: float, size: int) -> float:
    """The least estimated similarity to an elected class of whatever links to a class that left with ``NEAR``.

    The similarity is one less a metric: distances add up at most.
    """
    true = max(0.0, NEAR - slack(NEAR, size)) - (1 - threshold)
    return max(0.0, true - slack(true, size)) if true > 0 else 0.0


def _elected(led: DataFrame, signed: DataFrame, size: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(edges, rows that stay) of crowds' rows (branch, class_id, head), each compared with its crowd's least class.

    Crowds of several tries mostly have the same least class, so pairs of a class and a head are
    taken once before signatures move.
    """
    near, far = int(np.ceil(NEAR * size)), int(np.floor(reach_of(threshold, size) * size))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                agree = (_matrix(part.column("signature"), size) == _matrix(part.column("best"), size)).sum(1, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column("class_id"), part.column("head"), pa.array(agree)], ["class_id", "head", "agree"])

    led = led.where("class_id <> head")
    pairs = written(led.select("class_id", "head").distinct(), "jaccard-pairs")
    best = signed.select(F.col("class_id").alias("head"), F.col("signature").alias("best"))
    both = pairs.join(signed, "class_id").join(best.join(pairs.select("head").distinct(), "head", "left_semi"), "head").select("class_id", "head", "signature", "best")
    told = written(both.mapInArrow(run, "class_id long, head long, agree int"), "jaccard-elected")
    edges = told.where(F.col("agree") >= far).select(F.col("class_id").alias("a"), F.col("head").alias("b"), "agree")
    return edges, written(led.join(told.where(F.col("agree") < near).select("class_id", "head"), ["class_id", "head"]).select("branch", "class_id"), "jaccard-stay")


def _met(rows: DataFrame, classes: DataFrame, size: int, threshold: float) -> DataFrame:
    """Candidate edges (a, b, agree) of classes that meet: ``rows`` has branch, class_id, and the branch's n and head."""
    least = int(np.floor(size * (threshold - slack(threshold, size))))
    signed = classes.select("class_id", F.col("short").alias("signature"))
    few = rows.where(F.col("n") <= BUCKET_BLOCK).select("branch", "class_id", F.lit(1).cast("long").alias("blocks"))
    found = _candidates(_block_pairs(few, "blocks").join(signed, "class_id"), size, least)
    left = rows.where(F.col("n") > BUCKET_BLOCK)
    if left.isEmpty():
        return found
    for _ in range(ELECTIONS):
        edges, stay = _elected(left, signed, size, threshold)
        found = found.unionByName(edges)
        heads = written(stay.groupBy("branch").agg(F.min("class_id").alias("head"), F.count("*").alias("n")).where("n > 1"), "jaccard-heads")
        left = stay.join(heads, "branch")
        if (heads.agg(F.max("n")).first()[0] or 0) <= BLOCKS * BUCKET_BLOCK:
            break
        left = written(left, "jaccard-left")
    blocks = left.withColumn("blocks", F.ceil(F.col("n") / BUCKET_BLOCK)).drop("n", "head")
    return found.unionByName(_candidates(_block_pairs(blocks, "blocks").join(signed, "class_id"), size, least))


def _recall(edges: DataFrame, size: int, threshold: float, length: int, trees: int) -> float | None:
    """The estimated share of linked classes that prefixes of that length bring together; None if none was found."""
    best = edges.groupBy("a").agg(F.max("agree").alias("agree")).withColumn("s", F.col("agree") / size).where(F.col("s") >= threshold)
    chance = 1 - F.pow(1 - F.pow("s", F.lit(length)), F.lit(trees))
    n, total = best.agg(F.count("*"), F.sum(1 / chance)).first()
    return n / total if n else None


def _forest(classes: DataFrame, threshold: float, trees: int, depth: int, recall: float) -> DataFrame:
    """Candidate edges (a, b) of all lengths of prefixes that the target recall needs."""
    size, shortest = trees * depth, prefix_length(threshold, trees, depth, recall)
    tries = written(_tries(_labels(classes, trees, depth), shortest), "jaccard-tries")
    edges = seen = None
    for length in range(depth, shortest - 1, -1):
        branches = _branches(tries, length)
        told = F.xxhash64("class_id"), F.xxhash64("class_id", F.lit(1))
        crowd = branches.groupBy("branch").agg(F.count("*").alias("n"), *(F.bit_xor(t).alias(c) for t, c in zip(told, "xy")), F.min("class_id").alias("head")).where("n > 1")
        crowd = crowd.groupBy("n", "x", "y").agg(F.min("branch").alias("branch"), F.min("head").alias("head"))
        crowd = written(crowd if seen is None else crowd.join(seen.select("n", "x", "y"), ["n", "x", "y"], "left_anti"), "jaccard-crowds")
        rows = written(branches.join(crowd.select("branch", "n", "head"), "branch"), "jaccard-met")
        found = written(_met(rows, classes, size, threshold), "jaccard-edges")
        edges, seen = (found, crowd) if edges is None else (edges.unionByName(found), seen.unionByName(crowd))
        if length > shortest and (_recall(edges, size, threshold, length, trees) or 0.0) >= recall:
            break
    return edges.select("a", "b")


def _sets(texts: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                values, bounds = shingle_sets(split(part.column("text")))
                sets = pa.array([values[lo:hi].tobytes() for lo, hi in zip(bounds[:-1], bounds[1:])], pa.binary())
                columns = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), sets], [*columns, "shingles"])

    return texts.mapInArrow(run, texts.drop("text").schema.add("shingles", "binary"))


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each pair of sets shares, the diagonal left at 0."""
    n = len(sets)
    if n == 2:
        k = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[0, k], [k, 0]], np.int64)
    values, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    runs = np.diff(np.append(starts, len(values)))
    often = np.repeat(runs > 1, runs)
    column = np.repeat(np.cumsum(runs > 1) - 1, runs)[often]
    owner = owner[often]
    out = np.zeros((n, n), np.float32)  # exact for sets of less than 2 ** 24 values
    step = max(64, (1 << 21) // n)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        lo, hi = np.searchsorted(column, (at, at + step))
        grid = np.zeros((n, step), np.float32)
        grid[owner[lo:hi], column[lo:hi] - at] = 1
        out += grid @ grid.T
    np.fill_diagonal(out, 0)
    return out.astype(np.int32)


def _verified(blocks: DataFrame, threshold: float) -> DataFrame:
    """(class_id, texts, documents, peer): exact links in each pair of blocks; peer is the least class linked in it."""

    def run(batches):
        one_blas_thread()
        for rows, starts, ends in grouped(batches, ["root", "bi", "bj"]):
            ids, block = rows.column("class_id").to_numpy(), rows.column("block").to_numpy()
            weight = rows.column("members").to_numpy()
            same = rows.column("bi").to_numpy() == rows.column("bj").to_numpy()
            raw = rows.column("shingles")
            found: list[list[np.ndarray]] = [[], [], [], []]
            for lo, hi in zip(starts, ends):
                if hi - lo < 2:
                    continue
                sets = [np.frombuffer(raw[i].as_buffer(), np.uint64) for i in range(lo, hi)]
                n = np.array([len(s) for s in sets])
                shared = shared_counts(sets)
                links = np.zeros(shared.shape, bool)
                for i in range(0, len(n), 128):  # a few rows at a time, as the quotients take eight bytes each
                    own = shared[i : i + 128]
                    links[i : i + 128] = own / np.maximum(1, n[i : i + 128, None] + n[None, :] - own) >= threshold
                if not same[lo]:
                    links &= block[lo:hi, None] != block[None, lo:hi]
                tied = np.flatnonzero(links.any(1))
                if len(tied):
                    root = forest(links)
                    for column, value in zip(found, (ids[lo:hi][tied], links[tied].sum(1), links[tied] @ weight[lo:hi], ids[lo:hi][root[tied]])):
                        column.append(value)
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in found], ["class_id", "texts", "documents", "peer"])

    blocks = blocks.repartition("root", "bi", "bj").sortWithinPartitions("root", "bi", "bj")
    return blocks.select("root", "bi", "bj", "block", "class_id", "members", "shingles").mapInArrow(run, "class_id long, texts long, documents long, peer long")


def _core(sets: DataFrame, threshold: float) -> DataFrame:
    """``sets`` of large components with ``core``: whether a class is so near to the least one that all such are linked."""
    heads = sets.groupBy("root").agg(F.min("class_id").alias("class_id"))
    heads = written(heads.join(sets.select("root", "class_id", F.col("shingles").alias("best")), ["root", "class_id"]).withColumnRenamed("class_id", "head"), "jaccard-centres")
    # Distances d and e to the centre with d + e <= 1 - threshold; similarity s is 1 - distance.
    least = 1 - (1 - threshold) / 2

    def run(batches):
        for batch in batches:
            for part in (batch.slice(at, 256) for at in range(0, batch.num_rows, 256)):
                flags = []
                for a, b in zip(part.column("shingles"), part.column("best")):
                    x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (a, b))
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    flags.append(both / (len(x) + len(y) - both) >= least)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names if c != "best"), pa.array(flags, pa.bool_())], [*(c for c in part.schema.names if c != "best"), "core"])

    joined = sets.join(heads, "root")
    return joined.mapInArrow(run, joined.drop("best").schema.add("core", "boolean"))


def _large(sets: DataFrame, threshold: float) -> DataFrame:
    """``_verified`` for components of more than one block: pairs within the core are counted, others compared in blocks."""
    told = written(_core(sets, threshold), "jaccard-cores")
    size = lambda flag: F.greatest(F.ceil(F.coalesce(F.sum(F.when(flag, F.col("n_shingles"))), F.lit(0)) / SET_BLOCK), F.ceil(F.count_if(flag) / CLASS_BLOCK))
    sums = told.groupBy("root").agg(F.count_if("core").alias("n"), F.sum(F.when(F.col("core"), F.col("members"))).alias("all"), size(F.col("core")).alias("cores"), size(~F.col("core")).alias("rests"))
    sums = written(sums, "jaccard-sums")
    rows = told.join(broadcast_if_small(sums), "root")
    inner = rows.where("core and n > 1").select("class_id", (F.col("n") - 1).alias("texts"), (F.col("all") - F.col("members")).alias("documents"), F.col("head").alias("peer"))
    # Blocks of the rest come first; a core block meets those only.
    own = F.pmod(F.xxhash64("class_id"), F.when(F.col("core"), F.col("cores")).otherwise(F.col("rests"))) + F.when(F.col("core"), F.col("rests")).otherwise(0)
    rows = rows.withColumn("block", own.cast("int"))
    last = (F.when(F.col("core"), F.col("rests")).otherwise(F.col("rests") + F.col("cores")) - 1).cast("int")
    rows = rows.where(last >= 0).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    rows = rows.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))
    return inner.unionByName(_verified(rows, threshold))


def join(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, copy_id, n_links, n_linked_texts), one row for each row of ``docs``.

    Two documents are linked if their shingle sets' Jaccard similarity is ``threshold`` or more.
    class_id is the least id reached over links, copy_id the least id with an equal set;
    n_links counts the other documents linked to this one, copies included, n_linked_texts the
    linked classes.  Documents without words, or of null id, link to nothing and keep their own
    id.  Rows that repeat an id with the same words count as copies, with other words as documents
    of their own; an empty table gives none.
    """
    return linked(docs, threshold, trees, depth, recall).drop("print", "group")


def linked(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """``join`` with the print of each row's set and of its group's; both are 0 for rows that link to nothing.

    Within, a class goes by the print of its set, as an id may have several texts.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not 1 <= depth <= 8:
        raise ValueError("labels hold 1 to 8 minimum hashes")
    base = written(_sketch(docs, trees * depth), "jaccard-sketch")
    named = base.where("doc_id is not null and n_shingles > 0")
    classes = named.groupBy("f1", "f2").agg(F.min("doc_id").alias("lead"), F.count("*").alias("members"))
    lead = classes.select(F.col("lead").alias("doc_id"), F.col("f1").alias("g1"), F.col("f2").alias("g2"), "members")
    classes = named.join(lead, "doc_id").where("f1 = g1 and f2 = g2").dropDuplicates(["doc_id", "f1", "f2"])
    classes = written(classes.select(F.col("f1").alias("class_id"), F.col("doc_id").alias("lead"), "f1", "f2", "members", "n_shingles", "signature", "short"), "jaccard-classes")

    found = components(_forest(classes, threshold, trees, depth, recall)).withColumnRenamed("node", "class_id")
    parts = written(found.join(classes.select("class_id", "lead", "members", "n_shingles"), "class_id"), "jaccard-parts")
    blocks = written(parts.groupBy("root").agg(((F.sum("n_shingles") > SET_BLOCK) | (F.count("*") > CLASS_BLOCK)).alias("large")), "jaccard-sizes")
    parts = written(parts.join(blocks, "root").withColumnRenamed("lead", "doc_id"), "jaccard-members")
    texts = printed(maybe_among(docs, parts.select("doc_id"), "doc_id")).withColumnRenamed("print", "class_id")
    texts = texts.join(parts.hint("merge"), ["doc_id", "class_id"]).dropDuplicates(["doc_id", "class_id"]).drop("doc_id")
    sets = written(_sets(texts), "jaccard-sets")
    zero = F.lit(0).cast("int")
    verified = _verified(sets.where("not large").withColumns({"block": zero, "bi": zero, "bj": zero}), threshold)
    if not blocks.where("large").isEmpty():
        verified = verified.unionByName(_large(sets.where("large").drop("large"), threshold))
    verified = written(verified, "jaccard-links")
    counts = verified.groupBy("class_id").agg(F.sum("texts").alias("texts"), F.sum("documents").alias("documents"))
    roots = components(verified.select(F.col("class_id").alias("a"), F.col("peer").alias("b"))).withColumnRenamed("node", "class_id")
    roots = written(roots.join(classes.select("class_id", "lead"), "class_id"), "jaccard-roots")
    roots = roots.drop("lead").join(roots.groupBy("root").agg(F.min("lead").alias("least")), "root")

    told = classes.select("class_id", "lead", "f1", "f2", "members").join(counts, "class_id", "left").join(roots, "class_id", "left")
    told = told.drop("class_id").withColumnRenamed("lead", "copy_id")
    key = base.select("doc_id", "n_shingles", "f1", "f2")
    some, none = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.lit(0).cast("long")
    tied = key.where(some).join(told, ["f1", "f2"]).select(
        "doc_id",
        F.coalesce("least", "copy_id").alias("class_id"),
        "copy_id",
        (F.col("members") - 1 + F.coalesce("documents", none)).alias("n_links"),
        F.coalesce("texts", none).alias("n_linked_texts"),
        F.col("f1").alias("print"),
        F.coalesce("root", "f1").alias("group"),
    )
    alone = key.where(~some).select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), none.alias("n_links"), none.alias("n_linked_texts"), none.alias("print"), none.alias("group"))
    return tied.unionByName(alone)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
