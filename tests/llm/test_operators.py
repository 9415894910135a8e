"""Each operator against brute force or known answers, and its edge cases: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from artifact_scan.llm import chat, decontamination, jaccard_join, licenses, mixing, quality, sharding, substring_dedup, toxicity, url_filters
from artifact_scan.llm import words as w
from artifact_scan.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string"


def vocabulary(seed, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def corpus(seed=1, n=60):
    """Random texts with exact copies, near copies and shared passages."""
    rng, vocab = random.Random(seed), vocabulary(seed)
    passage = " ".join(rng.choice(vocab) for _ in range(70))
    texts = []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(20, 200))]
        if i % 7 == 3:
            words = texts[rng.randrange(len(texts))].split()
        elif i % 7 == 5:
            words = texts[rng.randrange(len(texts))].split()
            words[rng.randrange(len(words))] = "changed"
        elif i % 7 == 6:
            words[10:10] = passage.split()
        texts.append(" ".join(words))
    return texts


EDGES = [(None, "a text without an id " * 20, "s"), (900, None, "s"), (901, "", None), (902, " \t\n ", "s"), (903, "one", "s"), (904, "two words", "s"), (905, "two words", "s"), (906, "x " * 30_000, "s")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 % 61, t, f"s{i % 3}") for i, t in enumerate(corpus())]
    return spark.createDataFrame(rows + EDGES, DOCS).repartition(4)


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t\x0b\x1c ß", max_size=30)), max_size=8))
@settings(max_examples=60, deadline=None)
def test_split_and_hash(texts):
    words = w.split(pa.array(texts, pa.string()))
    expected = [WORD.findall(t or "") for t in texts]
    found = [words.data[s:e].tobytes().decode() for s, e in zip(words.starts, words.ends)]
    assert found == [x for t in expected for x in t]
    assert words.counts.tolist() == [len(t) for t in expected]
    hashes = w.word_hashes(words)
    assert len(set(hashes.tolist())) == len(set(found))
    runs, inside = w.run_hashes(hashes, 3), w.inside(words, 3)
    seen = {}
    for i in np.flatnonzero(inside):
        assert seen.setdefault(tuple(found[i : i + 3]), runs[i]) == runs[i]


def brute_statistics(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    count = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    cover = {j for i in range(len(words) - 4) if count[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover)]


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab #|\né", max_size=80)), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_quality_statistics(texts):
    s = quality.statistics(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert [int(s[k][i]) for k in quality.STATISTICS[:5]] == brute_statistics(t)


def brute_path(forest, t, x, node=0, depth=0):
    """The mean path length of a row put into a tree, node by node."""
    if forest.left[t, node] == node:
        return float(forest.length[t, node])
    f = forest.feature[t, node]
    low, high = float(forest.low[t, node]), float(forest.high[t, node])
    gap = max(low - x[f], x[f] - high, 0.0)
    apart = gap / (high - low + gap)
    below = forest.left[t, node] if x[f] < forest.split[t, node] else forest.right[t, node]
    return apart * (depth + 1) + (1 - apart) * brute_path(forest, t, x, below, depth + 1)


def test_isolation_forest():
    rng = np.random.default_rng(5)
    s = {k: rng.poisson(30 if k == "n_words" else 150 if k == "word_chars" else 4, 300) for k in quality.STATISTICS}
    forest = quality.grow(s, trees=7, sample=64)
    x = quality.features({k: np.concatenate([v[:20], v[:20] * 3, v[:5] * 40, v[:1] * 0]) for k, v in s.items()})
    assert np.allclose(forest.paths(x), [np.mean([brute_path(forest, t, row.astype(float)) for t in range(7)]) for row in x], rtol=1e-4)
    for t in range(7):  # splits are plain: strictly within the values of the node's rows
        inner = forest.left[t] != np.arange(forest.left.shape[1])
        assert (forest.low[t, inner] <= forest.split[t, inner]).all() and (forest.split[t, inner] <= forest.high[t, inner]).all()
    # The verdict of the query is the score against the threshold.
    forest.threshold = float(np.median(forest.score(x)))
    far = quality.features({k: np.full(1, 3000) if k == "n_symbols" else v[:1] for k, v in s.items()})
    assert forest.score(far)[0] > forest.score(x[:20]).max()


def test_quality_threshold():
    good, bad = np.linspace(0.3, 0.5, 1001), np.array([0.2, 0.505, 0.6, 0.7])
    assert 0.49 < quality.calibrate(good, bad, 0.002) < 0.505
    assert quality.calibrate(good, np.array([0.1]), 0.002) > 0.5


def test_quality_verdicts(spark, docs):
    rng, vocab = random.Random(3), vocabulary(3)
    good = [(i, " ".join(rng.choice(vocab) for _ in range(80)), "s") for i in range(120)]
    bad = [(200 + i, " ".join(rng.choice(vocab) + "$$$" for _ in range(80)), "s") for i in range(30)]
    table = spark.createDataFrame(good + bad + EDGES, DOCS).withColumn("kept", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1) for i in range(0, 120, 2)] + [(200 + i, 0) for i in range(0, 30, 2)] + [(None, 1), (3, None)], "doc_id long, quality int")
    rows = {r["doc_id"]: r for r in quality.quality(table, labels).collect()}
    assert len(rows) == len(good + bad + EDGES)
    assert sum(rows[i]["kept"] for i in range(120)) >= 118
    assert not any(rows[200 + i]["kept"] for i in range(30))
    assert all(rows[i]["base_failed"] and not rows[i]["kept"] for i in (900, 901, 902, 903, 906))
    assert quality.quality(table.where("false"), labels).count() == 0
    assert quality.fit(table, labels.where("false")) is None


@pytest.mark.parametrize("space", [16, 0.01])
def test_substring_dedup(spark, docs, space):
    """With a sketch of the usual size, and with one so small that its counters collide."""
    docs = docs.withColumn("sha", F.lit("clash")).withColumn("kept", F.lit(1))
    data = docs.collect()
    first = {}
    for r in data:
        words = WORD.findall(r["text"] or "")
        for i in range(len(words) - 49):
            k = tuple(words[i : i + 50])
            if r["doc_id"] is not None:
                first[k] = min(first.get(k, r["doc_id"]), r["doc_id"])
    expected = Counter()
    for r in data:
        words, gone = WORD.findall(r["text"] or ""), set()
        for i in range(len(words) - 49):
            if r["doc_id"] is not None and first[tuple(words[i : i + 50])] < r["doc_id"]:
                gone |= set(range(i, i + 50))
        kept = " ".join(x for i, x in enumerate(words) if i not in gone)
        expected[(r["doc_id"], len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    found = substring_dedup.dedup(docs, texts=False, space=space)
    assert Counter(map(tuple, found.collect())) == expected
    assert any(k[2] for k in expected)
    assert substring_dedup.dedup(docs.where("false")).count() == 0


def test_substring_dedup_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, "s"), (1, text, "s"), (1, "other " + text, "s"), (2, "more " + text, "s")]
    found = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.dedup(spark.createDataFrame(rows, DOCS)).collect())
    assert found == {(1, 80, 0): 2, (1, 81, 0): 1, (2, 81, 80): 1}


def brute_links(rows, threshold=0.8):
    sets = {}
    for d, t in rows:
        x = WORD.findall(t or "")
        sets[d] = {tuple(x[i : i + 5]) for i in range(len(x) - 4)} if len(x) > 4 else {tuple(x)} if x else set()
    links = defaultdict(set)
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold:
                links[a].add(b)
                links[b].add(a)
    root = {}
    for a in sorted(sets):
        todo = [a]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = a
                todo += links[x]
    return links, root


def test_jaccard_join(spark, docs):
    table = docs.dropDuplicates(["doc_id"]).withColumn("class_id", F.lit("clash"))
    rows = {r["doc_id"]: r for r in jaccard_join.join(table).collect()}
    links, root = brute_links([(r["doc_id"], r["text"]) for r in table.where("doc_id is not null").collect()])
    assert {d: r["n_links"] for d, r in rows.items() if d is not None} == {d: len(links[d]) for d in root}
    assert {d: r["class_id"] for d, r in rows.items() if d is not None} == root
    assert rows[None]["n_links"] == 0 and rows[905]["class_id"] == 904
    assert jaccard_join.join(table.where("false")).count() == 0


def test_jaccard_large_groups_split(spark, monkeypatch):
    """Groups beyond the block sizes give the same links."""
    rng, base = random.Random(5), [f"w{i}" for i in range(120)]
    rows = []
    for d in range(60):
        words = list(base)
        for _ in range(rng.randint(1, 3)):
            words[rng.randrange(120)] = f"x{rng.randrange(1000)}"
        rows.append((d, " ".join(words), "s"))
    monkeypatch.setattr(jaccard_join, "BUCKET_BLOCK", 7)
    monkeypatch.setattr(jaccard_join, "SET_BLOCK", 900)
    monkeypatch.setattr(jaccard_join, "CLASS_BLOCK", 9)
    found = {r["doc_id"]: r for r in jaccard_join.join(spark.createDataFrame(rows, DOCS)).collect()}
    links, root = brute_links([r[:2] for r in rows])
    assert {d: r["n_links"] for d, r in found.items()} == {d: len(links[d]) for d in root}
    assert {d: r["class_id"] for d, r in found.items()} == root


def test_jaccard_crowds_of_all_kinds(spark, monkeypatch):
    """Crowds whose members are near to the least one, near to others only, and far: order of rows and blocks do not matter."""
    rng = random.Random(8)
    rows = []
    for d in range(150):
        base = [f"w{i}" for i in range(100)] if d % 3 else [f"v{i}" for i in range(100)]
        for _ in range(rng.choice((0, 1, 2, 4, 8))):
            base[rng.randrange(100)] = f"x{rng.randrange(10_000)}"
        rows.append((rng.randrange(200) if d % 10 == 0 else 1000 + d, " ".join(base), "s"))
    first = {}
    for d, t, _ in rows:
        first.setdefault(d, t)
    rows = [r for r in rows if first[r[0]] == r[1]]
    links, root = brute_links([r[:2] for r in {r[0]: r for r in rows}.values()])
    for block, order in ((4, 1), (4, -1), (1000, 1)):
        monkeypatch.setattr(jaccard_join, "BUCKET_BLOCK", block)
        monkeypatch.setattr(jaccard_join, "CLASS_BLOCK", 5 if block == 4 else 1000)
        monkeypatch.setattr(jaccard_join, "BLOCKS", 2 if order == 1 else 1000)
        found = {r["doc_id"]: r for r in jaccard_join.join(spark.createDataFrame(rows[::order], DOCS)).collect()}
        assert {d: r["n_links"] for d, r in found.items()} == {d: len(links[d]) for d in root}
        assert {d: r["class_id"] for d, r in found.items()} == root


def test_jaccard_recall_on_many_rows(spark):
    """A few thousand rows at all similarities about the threshold, some ids repeated with other texts."""
    rng, vocab = random.Random(12), vocabulary(12, 3000)
    rows = []
    for i in range(3000):
        if i % 2 or not rows:
            words = [rng.choice(vocab) for _ in range(rng.randint(30, 90))]
        else:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((i, " ".join(words)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    holders = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            holders[x].add(i)
    links = {i: {j for x in s for j in holders[x] if j != i and len(s & sets[j]) / len(s | sets[j]) >= 0.8} for i, s in sets.items()}
    table = [(i // 2 if i % 50 == 0 else i, t, "s") for i, t in rows]  # some rows get the id of another
    got = Counter((r["doc_id"], r["n_links"]) for r in jaccard_join.join(spark.createDataFrame(table, DOCS)).collect())
    expected = Counter((d, len(links[i])) for (d, _, _), (i, _) in zip(table, rows))
    assert sum((got & expected).values()) >= 0.99 * len(rows)


def test_forest_shortens_until_recall():
    n = jaccard_join.prefix_length(0.8, 32, 8, 0.9999)
    assert jaccard_join.meeting(0.8, n) >= 0.9999 > jaccard_join.meeting(0.8, n + 1)
    assert 0 < jaccard_join.reach_of(0.8, 256) < 0.8


def test_tries_know_their_neighbours():
    rng = np.random.default_rng(4)
    labels = rng.integers(0, 3, (400, 9)).astype(np.int64)
    labels[:, 0] %= 2
    labels = labels[np.lexsort(labels.T[::-1])]
    pack = lambda x: x.astype(">u2").copy().view(">u8").astype(np.int64)[:, 0]
    rows = pa.RecordBatch.from_arrays([pa.array(labels[:, 0].astype(np.int32)), pa.array(pack(labels[:, 1:5])), pa.array(pack(labels[:, 5:])), pa.array(np.arange(400))], ["tree", "hi", "lo", "class_id"])

    class Frame:
        def repartitionByRange(self, *_):
            return self

        def sortWithinPartitions(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    found = {}
    for out in jaccard_join._tries(Frame(), 3)(rows.slice(at, 7) for at in range(0, 400, 7)):
        found |= dict(zip(out.column("class_id").to_pylist(), out.column("shared").to_pylist()))
    for i in range(400):
        near = [labels[j] for j in (i - 1, i + 1) if 0 <= j < 400]
        common = max(next((k for k in range(9) if a[k] != labels[i][k]), 9) - 1 for a in near)
        assert found.get(i, 0) == (8 if i in (0, 399) else common if common >= 3 else 0)


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 5), (200, 201), (7, 7), (201, 200), (None, 3)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {**{i: 0 for i in range(21)}, 100: 0, 200: 200, 201: 200}


def test_decontamination(spark):
    rng, vocab = random.Random(7), vocabulary(7, 3000)
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(text(30)) + ". " + " ".join(text(6))) for i in range(20)]
    rows = [(i, " ".join(text(150)), "s") for i in range(80)]
    rows.append((500, " ".join(text(60)) + " " + items[3][1] + " " + " ".join(text(60)), "s"))
    changed = items[4][1].split()
    for i in (2, 9, 15, 21):
        changed[i] = "other"
    rows.append((501, " ".join(text(40)) + " " + " ".join(changed[:20] + ["really"] + changed[20:]).upper(), "s"))
    rows += EDGES
    table, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items + [(99, None), (98, ""), (None, "x")], "item_id long, text string")
    table, bench = table.withColumn("item_id", F.lit("clash")), bench.withColumn("doc_id", F.lit("clash")).withColumn("cosine", F.lit(1))
    found = {(r["doc_id"], r["item_id"]): r for r in decontamination.contaminated(table, bench).collect()}
    assert set(found) == {(500, 3), (501, 4)}
    assert found[500, 3]["lcs"] == 1.0 and found[501, 4]["lcs"] < 1.0
    assert decontamination.contaminated(table, bench.where("false")).count() == 0
    assert decontamination.contaminated(table.where("false"), bench).count() == 0


@pytest.mark.parametrize(("n", "words"), [(1000, 12), (40, 1000)])
def test_decontamination_misses_no_copy(spark, n, words):
    """Verbatim copies of many short items, and of items much longer than a passage."""
    rng, vocab = random.Random(3), vocabulary(3, 20_000)
    weights = [1 / (i + 2) for i in range(len(vocab))]
    text = lambda k: " ".join(rng.choices(vocab, weights, k=k))
    items = [(i, text(words)) for i in range(n)]
    rows = [(i, text(40) + " " + t + " " + text(40), "s") for i, t in items] + [(n + i, text(500), "s") for i in range(200)]
    found = decontamination.contaminated(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in found.where("doc_id = item_id and lcs = 1").collect()} == set(range(n))


def test_decontamination_pages_repeated_items(spark):
    """Rounds smaller than the rows of one item id."""
    rng, vocab = random.Random(9), vocabulary(9, 3000)
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i // 3, text(30)) for i in range(6)]
    rows = [(i, f"{text(40)} {t} {text(40)}", "s") for i, (_, t) in enumerate(items)]
    found = decontamination.contaminated(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items + items[:2], "item_id long, text string"), max_items=2)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(i, i // 3) for i in range(6)}


def test_decontamination_numbers_and_single_words(spark):
    rng, vocab = random.Random(13), vocabulary(13, 3000)
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(0, "What is 37 * 48? 1776"), (1, "zyzzyva"), (2, "314159 271828 161803"), (3, "The answer: 3.14"), (4, "+ - *")]
    texts = ["what is 37 * 48? 1776", "what is 37 of it", "what is it", "a ZYZZYVA.", "zyzzyvas", "314159, 271828, 161803", "314159 only", "the answer: 3.14", "the answer: 2.71", "+ - *"]
    rows = [(i, f"{text(40)} {t} {text(40)}", "s") for i, t in enumerate(texts)]
    found = decontamination.contaminated(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(0, 0), (3, 1), (5, 2), (7, 3)}


def brute_contaminated(known, words, hashes, ids=None):
    """Every passage of every text against every item, without any search."""
    found = {}
    for d, n in enumerate(decontamination.passages_of(-(-words.counts // decontamination.BLOCK))):
        for j, b in ((j, b) for j in range(len(known.ids)) for b in range(n)):
            best = {}
            decontamination._check(known, words.first, hashes, d, b, j, 0.0, best)
            if best:
                found[d, j, b] = best[d, j]
    return found


def test_anchors_lead_to_every_passage_that_passes():
    rng = random.Random(5)
    for vocab in (vocabulary(5, 12), vocabulary(5, 150)):
        items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice((1, 2, 3, 7, 30, 130))))) for i in range(40)]
        texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 150))) for _ in range(10)]
        texts += [" ".join(x for x in f"{texts[i]} {items[i][1]} {texts[-i]}".split() if rng.random() < 0.8) for i in range(10)]
        known = decontamination.Items.of(items)
        words = decontamination.tokens(pa.array(texts))
        hashes = w.word_hashes(words)
        df = np.array([rng.randint(0, 9) for _ in known.terms])
        pos, token = known.table.find(hashes)
        led = decontamination.Anchors.of(known, df).places(words.first, pos, token)
        good = known.enough(words.first, pos, token, *led)
        passing = set(brute_contaminated(known, words, hashes))
        assert passing and passing <= set(zip(*(v[good].tolist() for v in led)))


def paraphrased(rng, vocab, item, share):
    """``share`` of the tokens but the last four replaced, dropped or preceded by another."""
    out = []
    for i, x in enumerate(item):
        if i < len(item) - 4 and rng.random() < share:
            out += rng.choice([[rng.choice(vocab)], [], [rng.choice(vocab), x]])
        else:
            out.append(x)
    return out


@pytest.mark.parametrize("pieces", [False, True])
def test_decontamination_against_brute_force(spark, monkeypatch, pieces):
    """The query's own path on paraphrases of all degrees; long texts also cut into pieces."""
    if pieces:
        monkeypatch.setattr(decontamination, "LONG", 64)
        monkeypatch.setattr(decontamination, "SEARCH_SLICE", 1)
    rng, vocab = random.Random(17), vocabulary(17, 800)
    weights = [1 / (i + 3) for i in range(len(vocab))]
    text = lambda n: rng.choices(vocab, weights, k=n)
    items = [text(rng.choice((8, 20, 40, 90))) for _ in range(60)]
    rows = [(i, " ".join(text(70) + paraphrased(rng, vocab, item, (i % 7) / 10) + text(rng.choice((0, 30, 300))))) for i, item in enumerate(items)]
    rows += [(100 + i, " ".join(text(200))) for i in range(40)]
    bench = [(i, " ".join(x)) for i, x in enumerate(items)]
    known = decontamination.Items.of(bench)
    words = decontamination.tokens(pa.array([t for _, t in rows]))
    brute = brute_contaminated(known, words, w.word_hashes(words))
    expected = {(rows[d][0], known.ids[j]) for d, j, _ in brute}
    found = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), max_items=25)
    found = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert len(expected) > 40
    assert expected <= found  # passages may also begin before a text, which brute force leaves out
    assert all(a == b or (a, b) in expected for a, b in found)


def test_singular_basis():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((300, 12)) * (2.0 ** -np.arange(12)) @ np.linalg.qr(rng.standard_normal((40, 12)))[0].T
    exact = np.linalg.svd(a)[2][:6].T
    basis = decontamination.singular_basis(lambda q: a.T @ (a @ q), 40, rank=10)
    assert np.allclose(np.abs(np.sum(exact * basis[:, :6], 0)), 1, atol=1e-6)


@given(st.lists(st.integers(0, 4), max_size=30), st.lists(st.integers(0, 4), min_size=1, max_size=20))
@settings(max_examples=60, deadline=None)
def test_lcs(region, item):
    row = [0] * (len(item) + 1)
    for x in region:
        new = [0]
        for j, y in enumerate(item):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    assert decontamination.lcs(decontamination.places_of(np.array(item, np.uint64)), len(item), region) == row[-1]


def test_toxicity(spark):
    rng, vocab = random.Random(11), vocabulary(11)
    rows, labels = [], []
    for i in range(300):
        words, toxic = [rng.choice(vocab) for _ in range(40)], i % 5 == 0
        if toxic:
            words[rng.randrange(40)] = rng.choice(["grobnak", "zultfish"])
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(toxic)))
    table = spark.createDataFrame(rows + EDGES, DOCS).withColumn("score", F.lit("clash"))
    model = toxicity.fit(table, spark.createDataFrame(labels + [(None, 1), (1, None)], "doc_id long, toxic int"))
    found = {r["doc_id"]: r for r in toxicity.score(table, model).collect()}
    assert len(found) == len(rows) + len(EDGES)
    assert all(found[i]["predicted"] == t for i, t in labels)
    assert any(found[i]["held_out"] for i, _ in labels) and not found[None]["held_out"]
    assert found[900]["predicted"] == found[901]["predicted"] == 0
    assert toxicity.score(table.where("false"), model).count() == 0


def brute_marks(tags):
    """What each transducer says of each insult and threat of a clause, by its definition."""
    t, out = toxicity, {}
    for i, tag in enumerate(tags):
        near = lambda kind, lo, hi, i=i: any(tags[k] == kind for k in range(max(0, lo), min(len(tags), hi)) if k != i)
        targeted = near(t.TARGET, i - t.REACH, i + t.REACH + 1)
        matched = len(tags) > 1 if tag == t.INSULT else targeted if tag == t.THREAT else False
        if matched:
            out[i] = targeted * t.TARGETED | near(t.NEGATION, i - t.REACH, i) * t.NEGATED | near(t.REPORT, 0, len(tags)) * t.REPORTED
    return out


@given(st.lists(st.lists(st.integers(0, 5), min_size=1, max_size=14), min_size=1, max_size=5))
@settings(max_examples=200, deadline=None)
def test_clause_grammar(clauses):
    tags = np.array([x for c in clauses for x in c])
    ends = np.cumsum([len(c) for c in clauses])
    marks = toxicity.marks_of(tags, ends - [len(c) for c in clauses], ends)
    for c, end in zip(clauses, ends):
        own = marks[end - len(c) : end]
        found = {i: int(m) & ~toxicity.ACCOMPANIED for i, m in enumerate(own) if m & toxicity.ACCOMPANIED and c[i] in (toxicity.INSULT, toxicity.THREAT)}
        assert found == brute_marks(c)


def test_sentences_in_their_contexts():
    model = toxicity.Model({b"idiot": (False, 2.0)}, -3.0, 4.0)
    e = lambda text: float(model.evidence(pa.array([text]))[0])
    assert e("idiot") == e("Idiot!") == e("kill") == e("I will kill time.") == 0
    assert e("WHAT!! AN!! IDIOT!!") == e("what | an | idiot") == e("What an idiot") > 0
    assert e("You idiot") > e("What an idiot") > 0 and e("You are an idiot.") > e("The man is an idiot.")
    assert 0 < e("He is not an idiot.") < e("He is an idiot.")
    assert 0 < e("She said that he is an idiot.") < e("She knows that he is an idiot.")
    assert e("He is an idiot, she said.") == e("He is an idiot.")  # another clause
    assert 0 < e("He is an idiot she said") < e("He is an idiot she is")
    assert 0 < e("I will not kill you.") < e("I will kill you.")
    assert 0 < e("He wrote: I will kill you.") == e("I will kill you.") > e("He wrote I will kill you.")


def test_factors_follow_the_labels():
    """Where negated insults are labelled harmless, the factor falls; where they are labelled toxic, it rises to its bound."""
    rng = np.random.default_rng(1)
    matches = np.zeros((400, toxicity.ACCOMPANIED))
    matches[:100, 0] = rng.uniform(1, 6, 100)
    matches[100:200, toxicity.NEGATED] = rng.uniform(1, 6, 100)
    toxic = np.zeros(400, np.int64)
    toxic[:100] = 1
    low = toxicity.fit_factors(matches, toxic)[toxicity.NEGATED]
    toxic[100:200] = 1
    high = toxicity.fit_factors(matches, toxic)[toxicity.NEGATED]
    assert low < high and 0.05 <= low < 0.4 <= high <= 0.8


def test_licenses(spark):
    lines = {1: "Released under the MIT License.", 2: "Licensed under the Apache License, Version 2.0.", 3: "This work is licensed under the GNU General Public License, version 3.", 4: "Licensed under CC BY-NC 4.0."}
    lines |= {5: "This file is distributed\nunder the terms of\nthe GNU GPL v3 or later", 6: "A BSD-style licence.", 7: "Released under the MIT\r\nLicense"}
    rows = [(d, f"Some text here.\n{x}\n\nMore text.", "s") for d, x in lines.items()] + [(1, f"Some text here.\n{lines[1]}\n\nMore text.", "s")] * 2
    rows += [(10, "He renewed his license to drive a car.", "s"), (11, "Er kam mit der Bahn. Mit ihr", "s"), (12, "lost her driver's license", "s")]
    rows += [(20, "Licensed under the Eclipse Public License 2.0.", "s"), (21, "Boost Software License - Version 1.0", "s"), *EDGES]
    table = spark.createDataFrame(rows, DOCS).withColumn("family", F.lit("clash"))
    found = Counter(tuple(r)[:3] for r in licenses.scan(table).collect())
    assert found == Counter({(d, 1, f): 1 for d, f in {1: "mit", 2: "apache-2.0", 3: "gpl", 4: "cc-by-nc", 5: "gpl", 6: "bsd", 7: "mit"}.items()} | {(20, 0, "unknown"): 1, (21, 0, "unknown"): 1})
    assert {r["doc_id"] for r in licenses.scan(table).where("confirmed").collect()} >= {1, 2, 3, 4, 7}
    assert licenses.scan(table.where("false")).count() == 0


def test_licences_the_model_has_not_met():
    assert licenses.strangers() < 0.15


def test_url_filters(spark):
    canonical = '<html><link rel="canonical" href="{}"></html>'
    rows = [
        (1, "http://a.net/x", ""), (2, "https://Sub.Example.NET/en/x?q#f", ""), (3, "http://xnet/", ""), (4, None, None), (5, "no scheme", ""), (6, "http://b.com/p", canonical.format("http://a.net/x")),
        (7, "http://c.com/q", canonical.format("//b.com/p")), (8, "http://example.com/de/1", ""), (9, "http://d.org/fr/1", canonical.format("http://a.net/x")), (10, "http://e.com/1", '<meta http-equiv="refresh" content="0; url=http://f.com/1">'),
        (11, "https://f.com/1#top", ""), (12, "http://g.com/a/b", canonical.format("c")), (13, "http://g.com/a/c", ""), (14, "http://net", ""), (1, "http://a.net/x", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("verdict", F.lit("clash"))
    found = {r["page_id"]: r for r in url_filters.judge(pages).collect()}
    assert (found[1]["rule"], found[1]["verdict"]) == ("net/", "block")
    assert (found[2]["host"], found[2]["path"], found[2]["rule"], found[2]["verdict"]) == ("sub.example.net", "/en/x", "example.net/en/", "allow")
    assert found[3]["rule"] is None and found[4]["host"] == found[4]["path"] == "" and found[5]["verdict"] == "allow"
    assert found[8]["verdict"] == "block" and found[14]["rule"] is None
    assert found[9]["verdict"] == "allow"  # its own rule
    assert found[6]["verdict"] == found[7]["verdict"] == "allow"  # 9 is explicitly allowed and an alias of 1
    without = {r["page_id"]: r["verdict"] for r in url_filters.judge(pages.where("coalesce(page_id, 0) <> 9")).collect()}
    assert without[6] == without[7] == "block" and without[10] == without[11] == "allow"
    moved = spark.createDataFrame([("http://f.com/1", "http://a.net/x"), (None, "x")], "from_url string, to_url string")
    assert {r["page_id"]: r["verdict"] for r in url_filters.judge(pages.where("coalesce(page_id, 0) <> 9"), redirects=moved).collect()}[10] == "block"
    assert url_filters.judge(pages.where("false")).count() == 0
    two = [(1, "http://p.com/", canonical.format("http://q.com/") + canonical.format("http://r.com/")), (2, "http://q.com/", ""), (3, "http://r.com/", ""), (4, "http://s.net/", canonical.format("http://r.com/")), (None, None, None)]
    found = {r["page_id"]: r["verdict"] for r in url_filters.judge(spark.createDataFrame(two, "page_id long, url string, html string")).collect()}
    assert found == {1: "block", 2: "block", 3: "block", 4: "block", None: "allow"}  # every link of a page counts


def test_mixing(spark, docs):
    sized = mixing.sizes(docs.withColumn("size", F.lit("clash")))
    assert Counter(r["size"] for r in sized.collect()) == Counter(len(WORD.findall(r["text"] or "")) for r in docs.collect())
    rows = mixing.mix(sized, spark.createDataFrame([(3, 2.0), (6, 0.5)], "doc_id long, weight double"), bins=8).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(sized, spark.createDataFrame([(3, 2.0), (6, 0.5)], "doc_id long, weight double"), bins=64).collect()), key=str)
    source = defaultdict(int)
    for r in sized.collect():
        source[r["source"]] += r["size"]
    names = sorted((s for s in source if s is not None)) + ([None] if None in source else [])
    total, open_, target = sum(source.values()), dict(zip(names, [5, 2, 1] * 9)), {}
    while True:
        rest = total - sum(target.values())
        over = [s for s in open_ if rest * open_[s] / sum(open_.values()) > 3 * source[s]]
        if not over:
            target |= {s: rest * v / sum(open_.values()) for s, v in open_.items()}
            break
        for s in over:
            target[s] = 3 * source[s]
        for s in over:
            del open_[s]
    taken = defaultdict(int)
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[round(r["target"], 6)] += r["taken"]
    for s in names:
        assert taken[round(target[s], 6)] == round(target[s])
    assert mixing.mix(sized.where("false")).count() == 0


def test_mixed_documents(spark):
    docs = spark.createDataFrame([(1, "s", "a b c d", 7, "x"), (2, "s", "e f", 3, "x"), (3, "s", "g", 1, "x")], "doc_id long, source string, text string, n_chars long, _row string")
    keyed = docs.drop("_row").withColumn("row", mixing.row_key())
    taken = {1: 6, 2: 2, 3: 0}
    plan = spark.createDataFrame([(r["doc_id"], r["row"], len(r["text"].split()), taken[r["doc_id"]]) for r in keyed.collect()], "doc_id long, row long, size long, taken long")
    assert Counter(map(tuple, mixing.mixed(docs.drop("_row"), plan).collect())) == {(1, "s", "a b c d", 7): 1, (1, "s", "a b", 3): 1, (2, "s", "e f", 3): 1}


def test_mixed_rows_without_ids_of_their_own(spark):
    """Null ids and sources, ids shared by different texts and equal rows: as many words come out as are planned."""
    rows = [(None, None, "a b c"), (None, "s", "d e"), (1, "s", "f g h i"), (1, "s", "j k"), (1, "t", "j k"), (2, "t", "l m n"), (2, "t", "l m n"), (3, "t", None), (4, "t", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    plan = mixing.mix(mixing.sizes(docs))
    out = mixing.mixed(docs, plan).collect()
    assert sum(len(r["text"].split()) for r in out) == sum(r["taken"] for r in plan.collect()) > 0
    assert {(r["doc_id"], r["source"]) for r in out} <= {r[:2] for r in rows}
    assert all(r["text"] in {t for _, _, t in rows} or any((t or "").startswith(r["text"]) for _, _, t in rows) for r in out)
    assert mixing.mixed(docs.where("false"), mixing.mix(mixing.sizes(docs.where("false")))).count() == 0


def test_sharding(spark, docs):
    shards, size = 5, 101
    table = sharding.lookup_table(shards, size)
    number = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:13], 16)
    walks = [[(number(f"offset/{s}") + j * (number(f"skip/{s}") % (size - 1) + 1)) % size for j in range(size)] for s in range(shards)]
    owner = {}
    for turn in range(size):
        owner[next(x for x in walks[turn % shards] if x not in owner)] = turn % shards
    assert table == [owner[i] for i in range(size)]
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1
    placed = sharding.place(docs.withColumn("shard", F.lit("clash"))).collect()
    assert len(placed) == docs.count()
    full = sharding.lookup_table()
    assert all(r["slot"] == number("" if r["doc_id"] is None else str(r["doc_id"])) % sharding.TABLE_SIZE and r["shard"] == full[r["slot"]] for r in placed)
    with pytest.raises(ValueError):
        sharding.lookup_table(5, 100)
    assert sharding.place(docs.where("false")).count() == 0


def test_write_shards(spark, docs, tmp_path):
    placed = sharding.place(docs, shards=3, size=31)
    sharding.write_shards(placed, str(tmp_path / "out"), spread=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r["doc_id"], r["text"], r["shard"]) for r in back.collect()) == Counter((r["doc_id"], r["text"], r["shard"]) for r in placed.collect())


def test_chat(spark):
    rows = [(1, 0, "system", "rules"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", "ho"), (1, 3, "ann", None), (2, 0, "ann", ""), (None, 0, "x", "y"), (3, 0, "system", "only"), (4, 1, None, "q"), (4, 1, None, "q")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("speaker", F.lit("clash"))
    found = {(r["conv_id"], r["speaker"]): r for r in chat.render(turns).collect()}
    assert set(found) == {(1, "ann"), (1, "bob"), (2, "ann"), (None, "x"), (4, "unknown")}
    r = found[1, "bob"]
    assert r["text"] == "<|im_start|>system\nrules<|im_end|>\n<|im_start|>user name=ann\nhi < |im_end|><|im_end|>\n<|im_start|>assistant\nho<|im_end|>\n<|im_start|>user name=ann\n<|im_end|>\n"
    assert [r["text"][int(a) : int(b)] for a, b in (x.split(":") for x in r["mask"].split())] == ["ho<|im_end|>"]
    assert found[4, "unknown"]["n_turns"] == 2
    assert chat.render(turns.where("false")).count() == 0


def test_chat_long_dialogues(spark):
    """Parts of a dialogue that no row holds, each with the first system turn; crowded blocks split further."""
    rng = random.Random(2)
    rows = [(1, 0, "system", "rules"), *((1, rng.choice([1, 1, 1, 2, 70, None]), rng.choice(["ann", "bob"]), f"turn {i}") for i in range(200)), (2, None, "ann", "x"), (2, None, "ann", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {(r["conv_id"], r["speaker"]): r for r in chat.render(turns).collect()}
    assert whole == {(r["conv_id"], r["speaker"]): r for r in chat.render(turns, crowd=3).collect()}
    assert whole[1, "ann"]["n_turns"] == 201 and whole[2, "ann"]["n_turns"] == 2
    opening = "<|im_start|>system\nrules<|im_end|>\n"
    parts = sorted(chat.render(turns, part=500, crowd=3).where("conv_id = 1 and speaker = 'bob'").collect(), key=lambda r: r["part"])
    assert len(parts) > 5 and all(r["text"].startswith(opening) for r in parts)
    assert opening + "".join(r["text"].removeprefix(opening) for r in parts) == whole[1, "bob"]["text"]
    for r in [*parts, *whole.values()]:
        spans = [r["text"][int(a) : int(b)] for a, b in (x.split(":") for x in r["mask"].split())]
        assert all(re.fullmatch(r"(turn \d+|x)<\|im_end\|>", x) for x in spans) and sum(map(len, spans)) == r["n_trained"]
