"""The pipeline on a small corpus, stage by stage against what each must do to its input."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_operators import WORD, brute_links, vocabulary

from artifact_scan.llm import jaccard_join, sharding


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, vocab = random.Random(21), vocabulary(21, 2000)
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(36)) for i in range(12)]
    rows = [(i, text(rng.randint(60, 160)), f"s{i % 4}") for i in range(120)]
    rows += [(200 + i, rows[i][1], "s0") for i in range(10)]
    rows += [(220 + i, rows[30 + i][1] + " tail", "s1") for i in range(10)]
    rows += [(240 + i, text(50) + " " + items[i][1] + " " + text(50), "s2") for i in range(6)]
    rows += [(260 + i, " ".join(x + "%%%" for x in text(80).split()), "s3") for i in range(20)] + [(300, None, "s0"), (301, "", "s0")]
    path = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(i, 1, 0) for i in range(0, 120, 2)] + [(260 + i, 0, 0) for i in range(0, 20, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    outs = []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        docs = spark.createDataFrame(out.collect(), out.schema)
        outs.append(docs.collect())
    clean, single, decontaminated, mixed, placed = outs
    ids = lambda rows: {r["doc_id"] for r in rows}
    assert not ids(clean) & {*range(260, 280), 300, 301} and len(ids(clean) & set(range(120))) >= 118
    _, root = brute_links([(r["doc_id"], r["text"]) for r in clean])
    assert ids(single) == set(root.values()) and len(single) == len(ids(single))
    assert ids(single) - ids(decontaminated) == {240 + i for i in range(6)} & ids(single)
    size = {r["doc_id"]: len(WORD.findall(r["text"])) for r in decontaminated}
    words = sum(len(WORD.findall(r["text"])) for r in mixed)
    assert abs(words - sum(size.values())) <= 4 and ids(mixed) <= ids(decontaminated)
    assert max(Counter(r["doc_id"] for r in mixed).values()) <= 3 + 1
    assert len(placed) == len(mixed) and {r["shard"] for r in placed} <= set(range(sharding.SHARDS))
    for rows in outs[:4]:
        assert list(rows[0].asDict()) == ["doc_id", "text", "lang", "source", "n_chars"]


def test_near_duplicates_of_repeated_ids(spark):
    """Rows that share an id but not their text: each text stays unless it has a copy of its own."""
    rng, vocab = random.Random(4), vocabulary(4, 2000)
    a, b, c, d = (" ".join(rng.choice(vocab) for _ in range(80)) for _ in range(4))
    rows = [(1, a), (1, b), (2, a + " tail"), (3, b + " tail"), (4, c), (4, d), (4, d), (5, ""), (5, ""), (6, a), (6, c + " tail")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = jaccard_join.join(docs).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == Counter(
        {(1, 1, 2): 1, (1, 1, 1): 1, (2, 1, 2): 1, (3, 1, 1): 1, (4, 4, 1): 3, (5, 5, 0): 2, (6, 1, 2): 1, (6, 4, 1): 1}
    )
    out = corpus_pipeline.near_duplicates(spark, docs, None).collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter([(1, a), (1, b), (4, c), (4, d), (5, "")])


def test_stages_on_odd_tables(spark, tables):
    """Null and repeated ids, empty tables, and columns with names that the operators use."""
    extra = {"kept": 1, "print": "p", "_cell": 2, "row": 3, "n_words": 4, "anomaly": 0.5}
    docs = spark.read.parquet(f"{tables}/documents.parquet").withColumns({c: F.lit(v) for c, v in extra.items()})
    item = spark.read.parquet(f"{tables}/benchmark.parquet").first()["text"]
    some = docs.where("doc_id = 3").first()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.where("false"), tables)
        assert out.count() == 0 and out.columns[: len(docs.columns)] == docs.columns, name
        if name != "sharding":
            got = stage(spark, docs, tables)
            assert got.columns == docs.columns and got.select(*extra).distinct().collect() == [tuple(extra.values())], name
    row = lambda i, t: (i, t, *list(some)[2:])
    leaks = spark.createDataFrame([row(None, f"{some['text']} {item}"), row(None, some["text"]), row(7, f"{some['text']} {item}"), row(7, some["text"]), row(8, None)], docs.schema)
    assert Counter(r["doc_id"] for r in corpus_pipeline.decontaminate(spark, leaks, tables).collect()) == {None: 1, 7: 1, 8: 1}
    kept = corpus_pipeline.near_duplicates(spark, leaks, tables).collect()
    assert Counter(r["doc_id"] for r in kept) == {None: 2, 7: 2, 8: 1}
    assert {r["doc_id"] for r in corpus_pipeline.quality_rules(spark, leaks, tables).collect()} == {None, 7}
    assert corpus_pipeline.mix_sources(spark, leaks, tables).count() == 4


def test_run_agrees(spark, tables):
    first = corpus_pipeline.run(spark, tables)
    assert first.where(F.col("slot").isNull()).count() == 0 and first.count() > 0
