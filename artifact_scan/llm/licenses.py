"""License scans by a trained paragraph classifier (native).

A paragraph is a line together with those it is wrapped over: a line that does not end a
sentence goes on in the next.  The distinct one- and two-word n-grams of every paragraph
are looked up in the weight table of a sparse multinomial logistic regression, which tells
the licence families, ``unknown`` (a notice of some other licence) and ``none`` apart.
N-grams of stop words only are no features, so ordinary paragraphs have none and end there.

The model is trained on the driver from the templates below, cut, padded and with words
dropped; the class ``unknown`` on notices of invented licences.  Its temperature is fitted
on further variants, and so is the probability under which a prediction is ``unknown``: all
but ``LOST`` of the right ones reach it.  ``strangers`` holds families out in turn and tells
how many notices of a family that the model has not met still pass for another.
A prediction is confirmed if enough of the words of one of the family's templates stand in
the paragraph.

Scoring is joins and aggregations only.  The table that is broadcast holds the model; its
size is that of this file's lists, not of the data.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from artifact_scan.llm.store import table

# Common notices of each family.
TEMPLATES = {
    "mit": ["released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software", "the software is provided as is without warranty of any kind express or implied", "mit style license", "spdx license identifier mit"],
    "apache-2.0": ["licensed under the apache license version 2.0", "you may not use this file except in compliance with the apache license", "apache 2.0 license", "spdx license identifier apache 2.0"],
    "gpl": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 2", "redistribute it and or modify it under the terms of the gnu general public license", "distributed under gplv3", "this file is gplv3", "released under the gplv2", "gnu gpl v3 or later", "under the gnu gpl version 2", "spdx license identifier gpl 3.0 or later"],
    "lgpl": ["licensed under the gnu lesser general public license", "redistribute it under the terms of the gnu lesser general public license", "distributed under lgplv3", "gnu lgpl v2.1 or later", "spdx license identifier lgpl 2.1"],
    "agpl": ["licensed under the gnu affero general public license", "under the terms of the gnu affero general public license version 3", "distributed under agplv3", "gnu agpl v3", "spdx license identifier agpl 3.0"],
    "bsd": ["licensed under the bsd 3 clause license", "redistribution and use in source and binary forms with or without modification are permitted", "redistributions of source code must retain the above copyright notice", "distributed under the bsd license", "bsd style license", "spdx license identifier bsd 2 clause"],
    "mpl": ["subject to the terms of the mozilla public license v 2.0", "licensed under the mozilla public license version 2.0", "released under mpl 2.0", "spdx license identifier mpl 2.0"],
    "cc-by": ["licensed under cc by 4.0", "licensed under a creative commons attribution 4.0 international license"],
    "cc-by-sa": ["licensed under cc by sa 4.0", "licensed under a creative commons attribution sharealike 4.0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4.0", "licensed under a creative commons attribution noncommercial 4.0 international license"],
    "cc0": ["released under cc0 1.0 universal public domain dedication", "to the extent possible under law the author has waived all copyright", "spdx license identifier cc0 1.0"],
    "public-domain": ["this is free and unencumbered software released into the public domain", "dedicated to the public domain"],
    "proprietary": ["copyright all rights reserved", "all rights reserved no part may be reproduced without written permission", "confidential and proprietary all rights reserved"],
}
#: Families so alike that one held out would pass for another: they are held out together.
ALIKE = (("gpl", "lgpl", "agpl"), ("cc-by", "cc-by-sa", "cc-by-nc", "cc0"))
# Notices of licences without a family here; {} is the licence's name.
STRANGERS = [
    "licensed under the {} license version 2.0", "licensed under the {} public license", "distributed under the {} license", "released under the terms of the {} license", "subject to the {} software license version 1.0",
    "this file is made available under the {} public license 2.0", "see the {} license for the terms that apply", "spdx license identifier {} 1.0", "{} style license", "{} license", "use of this work is governed by the {} license",
    "redistribute it under the terms of the {} license", "you may not use this file except in compliance with the {} license",
]
# What holds a word of licences and is no notice, and German sentences with the word mit.
OTHER = [
    "the driver must carry a valid license at all times", "she lost her fishing license last summer", "the debate on copyright law went on for hours", "he lost his driver s license in march", "a marriage license was issued by the town",
    "a poetic license that few readers would grant", "the committee discussed licensing fees for music", "his license to practise was renewed", "the license fee will rise next year", "the pilot s license had expired",
    "copyright is a subject of the second chapter", "the public domain was explained in the lecture", "a license plate was found near the road", "the general public was invited", "the public may attend", "creative people work in commons rooms",
    "permission was granted by the school to leave early", "licensed electricians may do this work", "the rights of workers were reserved by treaty", "software is sold in this shop", "the apache helicopter landed", "all seats are reserved",
    "sie kam mit der bahn und mit ihm", "mit und der die", "er ist mit dem hund in der stadt", "mit einer", "das ist mit ihr", "students at mit study hard", "free of charge for all visitors", "the warranty covers two years", "version 2.0 was announced", "the source of the river",
    "the terms and conditions of the contract apply", "under the terms of the agreement the land was sold", "see the terms of service of the shop",
]
FILLER = "the and of in file see project source code work author part page text note terms here with more about its".split()
# Words that alone, or with each other, are no features.
STOP = frozenset("a an the and or of in on to for by with from at as is are was were be been it its this that these those you your he she they we may not no any all under with without which one".split())
CONFIRMED, LOST, SEED = 0.6, 0.02, 5


WORD = r"[a-z0-9]+(?:\.[a-z0-9]+)*"  # points within a number or a name belong to it


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def _grams(words: list[str]) -> set[str]:
    pairs = {f"{a} {b}" for a, b in zip(words, words[1:]) if not (a in STOP and b in STOP)}
    return {w for w in words if w not in STOP} | pairs


def _name(rng: np.random.Generator) -> str:
    """The name of no licence."""
    return " ".join("".join(rng.choice(["ka", "lo", "ri", "ten", "mu", "so", "vel", "pra", "do", "shi", "eb", "ur"], rng.integers(2, 4))) for _ in range(rng.integers(1, 3)))


def _variants(rng: np.random.Generator, each: int) -> list[tuple[set[str], str]]:
    """Templates and others with words dropped at random and filler around them."""
    out = []
    strangers = [("unknown", t) for t in STRANGERS for _ in range(3)]
    for family, text in [(f, t) for f, texts in TEMPLATES.items() for t in texts] + strangers + [("none", t) for t in OTHER]:
        for k in range(each):
            own = words_of(text.replace("{}", _name(rng)).replace("license", "licence" if k % 5 == 4 else "license"))
            keep = [w for w in own if rng.random() > (0.25 if k else 0.0)] or own
            before = list(rng.choice(FILLER, rng.integers(0, 6))) if k else []
            after = list(rng.choice(FILLER, rng.integers(0, 12))) if k else []
            out.append((_grams(before + keep + after), family))
    for _ in range(4 * each):
        out.append((_grams(list(rng.choice(FILLER, rng.integers(1, 20)))), "none"))
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


class _Rows:
    """Variants as a matrix over a vocabulary, the intercept last."""

    def __init__(self, rows: list[tuple[set[str], str]], at: dict[str, int], families: list[str]):
        self.x = np.zeros((len(rows), len(at) + 1), np.float32)
        self.x[:, -1] = 1
        for i, (grams, _) in enumerate(rows):
            self.x[i, [at[g] for g in grams if g in at]] = 1
        self.y = np.array([families.index(f) for _, f in rows])


def _train(rows: _Rows, n: int, steps: int, leave: list[int] = []) -> np.ndarray:
    """Weights (n-grams and intercept, classes), without the rows of the classes in ``leave``."""
    some = ~np.isin(rows.y, leave)
    x, target = rows.x[some], np.eye(n, dtype=np.float32)[rows.y[some]]
    w = np.zeros((x.shape[1], n), np.float32)
    closed = np.zeros(n, np.float32)
    closed[leave] = -1e9
    for _ in range(steps):
        w += np.float32(2.0) * (x.T @ (target - _softmax(x @ w + closed)) / len(x) - np.float32(1e-4) * w)
    w[:, leave] = 0
    return w


def _prepared() -> tuple[list[str], dict[str, int], _Rows, _Rows]:
    """(classes, vocabulary, rows to train on, further rows)."""
    rng = np.random.default_rng(SEED)
    train, held = _variants(rng, 16), _variants(rng, 8)
    families = [*TEMPLATES, "unknown", "none"]
    count: dict[str, int] = {}
    for grams, _ in train:
        for g in grams:
            count[g] = count.get(g, 0) + 1
    at = {g: i for i, g in enumerate(sorted(g for g, n in count.items() if n > 2))}
    return families, at, _Rows(train, at, families), _Rows(held, at, families)


@lru_cache(maxsize=1)
def model() -> tuple[list[str], dict[str, list[float]], list[float], float]:
    """(classes, weights by n-gram, intercepts, least probability): logits already divided by the temperature."""
    families, at, rows, other = _prepared()
    w = _train(rows, len(families), 250)
    w[:-1][np.abs(w[:-1]).max(1) < 0.1] = 0  # sparse: n-grams that tell little leave the table
    z = other.x @ w
    loss = lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(z)), other.y], 1e-12)).mean()
    temperature = float(min(np.geomspace(0.2, 5, 40), key=loss))
    p = _softmax(z / temperature)
    known = (p.argmax(1) == other.y) & (other.y < len(TEMPLATES))
    least = float(np.quantile(p.max(1)[known], LOST))
    w = w / temperature
    table_ = {g: [round(float(v), 4) for v in w[i]] for g, i in at.items() if np.abs(w[i]).max() > 0}
    return families, table_, [round(float(v), 4) for v in w[-1]], round(least, 6)


def strangers() -> float:
    """The share of notices of families held out in turn that pass for another family."""
    families, _, rows, other = _prepared()
    least, passed = model()[3], []
    for group in [*ALIKE, *((f,) for f in TEMPLATES if not any(f in g for g in ALIKE))]:
        leave = [families.index(f) for f in group]
        z = other.x[np.isin(other.y, leave)] @ _train(rows, len(families), 100, leave)
        z[:, leave] = -1e9
        p = _softmax(z)
        passed.append((p.argmax(1) < len(TEMPLATES)) & (p.max(1) >= least))
    return float(np.concatenate(passed).mean())


def _templates() -> dict[str, list[list[str]]]:
    """For each family the words of its templates but stop words."""
    return {f: [sorted(set(words_of(t)) - STOP) for t in texts] for f, texts in TEMPLATES.items()}


def _table() -> list[tuple[str, list[float]]]:
    """(gram, logits): also words of templates that tell nothing, which the comparison needs. The empty n-gram holds the intercepts."""
    families, weights, intercepts, _ = model()
    grams = sorted(set(weights) | {w for texts in _templates().values() for words in texts for w in words})
    return [("", intercepts), *((g, weights.get(g, [0.0] * len(families))) for g in grams)]


# A line end that a paragraph goes on over: the line does not end a sentence, and neither it nor the next is empty.
_GOES_ON = r"\n(?<=[^.!?:;\n\r]\n|[^.!?:;\n\r]\r\n)(?![\n\r])"
# The same for RE2, which does not look around: twice, as matches do not overlap.
_WRAP = r"([^.!?:;\n\r])\r?\n([^\n\r])"


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, row, paragraph, line) of all paragraphs; ``row`` tells apart rows of one id."""
    joined = F.regexp_replace("text", _GOES_ON, " ")
    return docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(F.split(joined, "\n")).alias("paragraph", "line"))


def _features(lines: DataFrame, grams: list[str]) -> DataFrame:
    """``grams``: the distinct n-grams of each line that are in the model; lines without any are left out."""
    single, double = [g for g in grams if g and " " not in g], [g for g in grams if " " in g]
    # Each array goes through a generator of one row: what reads a generator's column does not compute it again.
    once = lambda df, name, array: df.select(*df.columns, F.explode_outer(F.array(array)).alias(name))
    lines = once(lines, "words", F.regexp_extract_all(F.lower("line"), F.lit(WORD), F.lit(0))).drop("line")
    # Pairs are only made where a single word is known: every pair in the model holds one.
    lines = once(lines, "some", F.filter("words", lambda w: w.isin(single))).where(F.size("some") > 0)
    pairs = F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words")), lambda a, b: F.concat(a, F.lit(" "), b))
    pairs = F.when(F.size("words") > 1, F.filter(pairs, lambda g: g.isin(double))).otherwise(F.array().cast("array<string>"))
    return once(lines, "grams", F.array_distinct(F.concat(F.array(F.lit("")), "some", pairs))).drop("words", "some")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, family, probability, similarity, confirmed): a row for each paragraph that is a notice.

    ``family`` is unknown for notices of other licences and where no family reaches the calibrated
    probability; of families with equal logits the first counts.  Null and empty texts have no
    paragraphs; very long lines are scored whole; rows that repeat an id and text give their
    paragraphs once; columns other than doc_id and text are not read; an empty table gives none.
    """
    spark = docs.sparkSession
    families, _, _, least = model()
    rows = _table()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lines = _features(paragraphs(docs), [g for g, _ in rows])
    key = ["doc_id", "row", "paragraph"]
    lookup = F.broadcast(spark.createDataFrame(rows, "gram string, logits array<double>"))
    hits = lines.select(*key, F.explode("grams").alias("gram")).join(lookup, "gram")
    # Sums of decimals do not depend on the order of their terms; repeated rows are divided out.
    sums = [F.sum(F.col("logits")[i].cast("decimal(18,4)")).alias(f"z{i}") for i in range(len(families))]
    scored = hits.groupBy(*key).agg(*sums, F.collect_set("gram").alias("grams"), F.count_if(F.col("gram") == "").alias("copies"))
    scored = scored.withColumn("z", F.array(*((F.col(f"z{i}") / F.col("copies")).cast("double") for i in range(len(families)))))
    total = F.aggregate("z", F.lit(0.0), lambda s, v: s + F.exp(v - F.array_max("z")))
    best = F.element_at(F.array(*map(F.lit, families)), F.array_position("z", F.array_max("z")).cast("int"))
    scored = scored.withColumn("best", best).withColumn("probability", F.round(1 / total, 6)).where("best <> 'none'")
    shared = lambda words: F.size(F.array_intersect("grams", F.array(*map(F.lit, words)))) / len(words)
    near = [F.when(F.col("best") == f, F.greatest(*map(shared, texts)) if len(texts) > 1 else shared(texts[0])) for f, texts in _templates().items()]
    similarity = F.round(F.coalesce(*near, F.lit(0.0)), 6)
    known = (F.col("probability") >= least) & (F.col("best") != "unknown")
    return scored.select(
        "doc_id",
        "paragraph",
        F.when(known, F.col("best")).otherwise("unknown").alias("family"),
        "probability",
        similarity.alias("similarity"),
        (known & (similarity >= CONFIRMED)).alias("confirmed"),
    )


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def oracle_sql() -> str:
    families, _, _, least = model()
    rows = ", ".join(f"('{g}', {logits})" for g, logits in _table())
    templates = ", ".join(f"('{f}', {words})" for f, texts in _templates().items() for words in texts)
    wrap = f"'{_WRAP}', '\\1 \\2', 'g'"
    return f"""
WITH lookup(gram, logits) AS (VALUES {rows}),
families AS (SELECT unnest({families}) AS family, unnest(range(1, {len(families) + 1})) AS i),
templates(best, ws) AS (VALUES {templates}),
split AS (SELECT DISTINCT doc_id, text, string_split(regexp_replace(regexp_replace(text, {wrap}), {wrap}), chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, text, unnest(ls) AS line, unnest(range(len(ls))) AS paragraph FROM split),
cut AS (
  SELECT doc_id, text, paragraph, regexp_extract_all(lower(line), '{WORD}') AS ws FROM lines
), grams AS (
  SELECT doc_id, text, paragraph, unnest(list_distinct([''] || ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS gram FROM cut
), hits AS (SELECT doc_id, text, paragraph, gram, logits FROM grams JOIN lookup USING (gram)),
held AS (SELECT doc_id, text, paragraph, list(gram) AS gs FROM hits GROUP BY ALL HAVING count(*) FILTER (gram <> '' AND NOT contains(gram, ' ')) > 0),
sums AS (
  SELECT doc_id, text, paragraph, i, family, sum(logits[i]::DECIMAL(18,4))::DOUBLE AS z FROM hits SEMI JOIN held USING (doc_id, text, paragraph), families GROUP BY ALL
), soft AS (
  SELECT doc_id, text, paragraph, arg_min(family, struct_pack(a := -z, b := i)) AS best, round(1 / list_sum(list_transform(list(z ORDER BY i), lambda v: exp(v - m))), 6) AS probability
  FROM (SELECT *, max(z) OVER (PARTITION BY doc_id, text, paragraph) AS m FROM sums) GROUP BY doc_id, text, paragraph, m
), near AS (
  SELECT doc_id, text, paragraph, best, max(len(list_intersect(gs, ws)) / len(ws)) AS similarity FROM soft JOIN held USING (doc_id, text, paragraph) JOIN templates USING (best) GROUP BY ALL
), told AS (
  SELECT doc_id, paragraph, best, probability, round(coalesce(similarity, 0.0::DOUBLE), 6) AS similarity, probability >= {least} AND best <> 'unknown' AS known
  FROM soft LEFT JOIN near USING (doc_id, text, paragraph, best) WHERE best <> 'none'
)
SELECT doc_id, paragraph::INTEGER AS paragraph, CASE WHEN known THEN best ELSE 'unknown' END AS family, probability, similarity, known AND similarity >= {CONFIRMED} AS confirmed FROM told
"""
