"""Text rules over every surface of a bundle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from artifact_scan.config import DEFAULT, Config
from artifact_scan.functions.regex import Pattern, matches, to_java
from artifact_scan.functions.text import escalate, quoted
from artifact_scan.operators import findings as fd
from artifact_scan.rules.loader import NEGATION, Rule, patterns


def surfaces(parts: DataFrame, bundles: DataFrame | None = None) -> DataFrame:
    """(bundle_id, kind, file, section, parts, surface, code, text): contents, all paths, and git metadata, in that order.

    ``code`` is the language of executable files.

    ``parts`` are components.  Primary files come first, then other files but assets.
    """
    columns = ["bundle_id", "kind", "file", "section", "parts", "surface", "code", "text"]
    none = F.lit(None).cast("string").alias("code")
    rows = parts.where(F.col("surface").isNotNull() & F.col("text").isNotNull())
    contents = rows.select("bundle_id", "kind", F.col("path").alias("file"), F.when(F.col("is_primary"), 0).otherwise(1).alias("section"), "parts", "surface", F.when(F.col("executable"), F.col("language")).alias("code"), "text")
    names = parts.select("bundle_id", "kind", F.col("path").alias("file"), F.lit(2).alias("section"), "parts", F.lit("body").alias("surface"), none, F.col("path").alias("text"))
    out = contents.unionByName(names)
    if bundles is not None and "git_metadata" in bundles.columns:
        kinds = parts.select("bundle_id", "kind").distinct()
        told = bundles.select("bundle_id", F.posexplode("git_metadata").alias("n", "key", "text")).where("text <> ''").join(kinds, "bundle_id")
        file = F.concat(F.lit("git:"), "key")
        out = out.unionByName(told.select("bundle_id", "kind", file.alias("file"), F.lit(3).alias("section"), F.array(F.lpad(F.col("n").cast("string"), 6, "0")).alias("parts"), F.lit("body").alias("surface"), none, "text"))
    return out.select(*columns)


def applicable(rules: list[Rule]) -> dict[int, str]:
    """For each rule the rows, by surface and kind, that it applies to, in SQL."""
    when = {}
    for i, r in enumerate(rules):
        some = [f"{c} in ({', '.join(map(quoted, values))})" for c, values in (("surface", r.surfaces), ("kind", r.kinds)) if "any" not in values]
        when[i] = " and ".join(some) or "true"
    return when


def rule_matches(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """A row for each match of each rule that applies to its row's surface and kind, with ``negated``."""
    return negated(matches(rows, "text", patterns(rules), applicable(rules)), rules)


def negated(found: DataFrame, rules: list[Rule]) -> DataFrame:
    """Matches with ``negated``: whether a word before it in its clause forbids what a negatable rule's match says."""
    negatable = [i for i, r in enumerate(rules) if r.negatable]
    return found.withColumn("negated", F.col("rule").isin(*negatable) & F.col("clause").rlike(to_java(NEGATION)))


def rule_table(found: DataFrame, rules: list[Rule]) -> DataFrame:
    """Matches with their rule's columns; the corpus is a fixed list, so the join is a broadcast."""
    rows = [(i, r.id, r.category, r.severity, r.confidence, r.description, r.remediation, r.language, r.escalate_for_claude_md) for i, r in enumerate(rules)]
    schema = "rule int, rule_id string, category string, rule_severity string, confidence string, risk string, remediation string, rule_language string, escalates boolean"
    return found.join(F.broadcast(found.sparkSession.createDataFrame(rows, schema)), "rule")


def adjusted_severity():
    """Information only in references and under a negation; one step up in an always-loaded memory file."""
    return (
        F.when((F.col("surface") == "reference") | F.col("negated"), F.lit("info"))
        .when((F.col("kind") == "claude_md") & F.col("escalates"), escalate(F.col("rule_severity")))
        .otherwise(F.col("rule_severity"))
    )


def findings(rows: DataFrame, rules: list[Rule], config: Config = DEFAULT, found: DataFrame | None = None) -> DataFrame:
    """``found`` may give the rules' matches in ``rows``."""
    found = rule_table(rule_matches(rows, rules) if found is None else negated(found, rules), rules)
    order = F.struct(
        F.lit(0).alias("layer"), F.col("section"), F.col("parts"), F.col("rule").alias("n0"), F.col("pattern_ord").alias("n1"), F.col("match_ord").alias("n2")
    )
    return fd.make(
        found, order=order, rule=F.col("rule_id"), category=F.col("category"), severity=adjusted_severity(), confidence=F.col("confidence"),
        file=F.col("file"), line=F.col("line"), evidence=F.col("line_text"), risk=F.col("risk"), remediation=F.col("remediation"),
        layer="static_rules", language=F.col("rule_language"), config=config,
    )


def single(sources: list[tuple[str, str]]) -> list[Pattern]:
    """One pattern a rule, for layers that are not rule files."""
    return [Pattern(i, 0, p) for i, (_, p) in enumerate(sources)]
