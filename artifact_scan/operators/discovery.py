"""What a bundle is: its primary file, kind and scope, and the type of each file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from artifact_scan.config import EXECUTABLE, PRIMARY_FILES
from artifact_scan.functions.text import basename, language, parts


def primaries(files: DataFrame, bundles: DataFrame | None = None) -> DataFrame:
    """(bundle_id, kind, primary_path, scope): a recognised name by priority, depth and path, else the declared or first file."""
    path = F.col("path")
    priority = F.lit(None).cast("int")
    for n, (name, _) in enumerate(PRIMARY_FILES):
        priority = F.when(basename(path) == name, n).otherwise(priority)
    found = files.select("bundle_id", priority.alias("priority"), F.size(parts(path)).alias("depth"), parts(path).alias("parts"), "path")
    best = F.min(F.when(F.col("priority").isNotNull(), F.struct("priority", "depth", "path")))
    out = found.groupBy("bundle_id").agg(best.alias("best"), F.min(F.struct("parts", "path")).alias("first"))
    declared = F.lit(None).cast("string")
    if bundles is not None and "primary_path" in bundles.columns:
        out, declared = out.join(bundles.select("bundle_id", F.col("primary_path").alias("declared")), "bundle_id", "left"), F.col("declared")
    kind = F.coalesce(F.element_at(F.array(*(F.lit(k) for _, k in PRIMARY_FILES)), F.col("best.priority") + 1), F.lit("skill"))
    primary = F.coalesce("best.path", declared, "first.path")
    out = out.select("bundle_id", kind.alias("kind"), primary.alias("primary_path"))
    p = parts(F.col("primary_path"))
    project = (F.size(p) == 1) | ((F.size(p) == 2) & (p[0] == ".claude"))
    return out.withColumn("scope", F.when(F.col("kind") == "claude_md", F.when(project, "project").otherwise("nested")))


def components(files: DataFrame, found: DataFrame) -> DataFrame:
    """Files with their bundle's kind and primary_path, and type, language, executable, is_primary, is_doc, surface, parts."""
    path, p = F.col("path"), parts(F.col("path"))
    rows = files.join(found, "bundle_id").withColumn("language", language(path)).withColumn("parts", p)
    rows = rows.withColumn("executable", F.coalesce(F.col("language").isin(*EXECUTABLE), F.lit(False))).withColumn("is_primary", path == F.col("primary_path"))
    kind = (
        F.when(F.col("is_primary"), "manifest")
        .when(F.array_contains("parts", "scripts") | F.col("executable"), "script")
        .when(F.array_contains("parts", "references"), "reference")
        .when(F.array_contains("parts", "assets"), "asset")
        .otherwise("other")
    )
    rows = rows.withColumn("type", kind).withColumn("is_doc", F.col("language").isNull() | F.col("language").isin("markdown", "text"))
    surface = (
        F.when(F.col("is_primary"), F.when(F.col("is_doc"), "body").otherwise("script"))
        .when(F.col("type") == "script", "script")
        .when(F.col("type").isin("reference", "other"), "reference")
    )
    return rows.withColumn("surface", surface)
