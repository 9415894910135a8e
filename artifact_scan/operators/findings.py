"""The findings table: its shape, how rows are made, merged, scored and judged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from artifact_scan.config import CONFIDENCE_FACTOR, DEFAULT, SEVERITIES, SEVERITY_WEIGHT, Config
from artifact_scan.functions.text import clip, confidence_rank, mapping, severity_rank

COLUMNS = (
    "bundle_id", "seq", "id", "category", "severity", "confidence", "file", "line", "evidence", "risk", "remediation", "source_layer", "language", "raised_by",
)


def seq(layer: int, section: int, file_parts: Column, *order: Column | int) -> Column:
    """A total order of a bundle's findings: layer, section, file, then up to three numbers."""
    numbers = [F.lit(o).cast("int") if isinstance(o, int) else o.cast("int") for o in (*order, 0, 0, 0)[:3]]
    return F.struct(
        F.lit(layer).alias("layer"), F.lit(section).alias("section"), F.coalesce(file_parts, F.array().cast("array<string>")).alias("parts"),
        *(n.alias(f"n{i}") for i, n in enumerate(numbers)),
    )


def make(df: DataFrame, *, order: Column, rule: Column, category, severity, confidence, file: Column, line: Column | None, evidence: Column, risk, remediation, layer: str, suffix: str = "", language=None, raised_by=None, config: Config = DEFAULT) -> DataFrame:
    """Findings from rows; plain strings stand for literals."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    line = F.lit(None).cast("int") if line is None else line.cast("int")
    place = F.when(line.isNull(), file).otherwise(F.concat(file, F.lit(":"), line.cast("string")))
    return df.select(
        "bundle_id",
        order.alias("seq"),
        F.concat(lit(rule), F.lit("@"), place, F.lit(suffix)).alias("id"),
        lit(category).alias("category"),
        lit(severity).alias("severity"),
        lit(confidence).alias("confidence"),
        file.alias("file"),
        line.alias("line"),
        clip(evidence, config.evidence).alias("evidence"),
        lit(risk).alias("risk"),
        lit(remediation).alias("remediation"),
        F.lit(layer).alias("source_layer"),
        lit(language).alias("language"),
        lit(raised_by).alias("raised_by"),
    )


def dedupe(findings: DataFrame) -> DataFrame:
    """The strongest finding of each (file, line, category), the first of equals, with ``ord``, the place of the first seen.

    An aggregation with map-side combine, not a window: a place with very many findings is no hot task.
    """
    rest = [c for c in COLUMNS if c not in ("bundle_id", "file", "line", "category", "seq")]
    best = F.min(F.struct((-severity_rank(F.col("severity"))).alias("s"), (-confidence_rank(F.col("confidence"))).alias("c"), "seq", *rest))
    out = findings.groupBy("bundle_id", "file", "line", "category").agg(best.alias("best"), F.min("seq").alias("ord"))
    return out.select("bundle_id", "ord", "file", "line", "category", "best.seq", *(f"best.{c}" for c in rest))


def weight(severity: Column, confidence: Column) -> Column:
    return F.element_at(mapping(SEVERITY_WEIGHT), severity).cast("double") * F.element_at(mapping(CONFIDENCE_FACTOR), confidence)


def verdicts(merged: DataFrame) -> DataFrame:
    """(bundle_id, score, verdict, n_findings, a count for each severity) of merged findings.

    The score adds doubles in the order of findings, as the cut to an integer depends on it;
    a bundle's findings are bounded by the limits on its files.
    """
    strong = (F.col("severity") == "critical") & (confidence_rank(F.col("confidence")) >= 1)
    some = severity_rank(F.col("severity")) >= 2
    rows = F.sort_array(F.collect_list(F.struct("ord", weight(F.col("severity"), F.col("confidence")).alias("w"))))
    out = merged.groupBy("bundle_id").agg(
        rows.alias("rows"),
        F.max(strong).alias("strong"),
        F.max(some).alias("some"),
        F.count("*").alias("n_findings"),
        *(F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in reversed(SEVERITIES)),
    )
    total = F.aggregate("rows", F.lit(0.0), lambda a, r: a + r["w"])
    verdict = F.when(F.col("strong"), "DO_NOT_INSTALL").when(F.col("some"), "CAUTION").otherwise("CLEAN")
    return out.select("bundle_id", F.least(F.lit(100), total.cast("int")).alias("score"), verdict.alias("verdict"), "n_findings", *(f"n_{s}" for s in reversed(SEVERITIES)))


def summary() -> Column:
    return F.format_string("%s: %d findings (%d critical, %d high, %d medium)", "verdict", "n_findings", "n_critical", "n_high", "n_medium")
