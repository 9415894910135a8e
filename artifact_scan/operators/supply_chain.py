"""Dependencies: parsed, joined with advisories, compared with popular names; and downloads from moving branches."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from artifact_scan.config import DEFAULT, POPULAR, Config
from artifact_scan.functions.regex import Pattern, matches
from artifact_scan.functions.text import basename, strip
from artifact_scan.functions.udf import on_text
from artifact_scan.operators import findings as fd

# Patterns in RE2 syntax.
REQUIREMENT = r"^[\t\n\f\r ]*([A-Za-z0-9_.\-]+)[\t\n\f\r ]*(==|>=|<=|~=|>|<)[\t\n\f\r ]*([A-Za-z0-9_.\-]+)"
MUTABLE = r"(?i)(git\+https?://[^\s]+@(main|master|head|develop|trunk)\b|(curl|wget)\s+https?://[^\s]*/(main|master|HEAD)/)"
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


@on_text("array<string>")
def _toml(text: str) -> list[str]:
    try:
        found = tomllib.loads(text).get("project", {}).get("dependencies", [])
    except (ValueError, AttributeError, RecursionError):
        return []
    return [x for x in found if isinstance(x, str)] if isinstance(found, list) else []


def _specs(rows: DataFrame) -> DataFrame:
    name, operator, version = (F.regexp_extract("spec", REQUIREMENT, i) for i in (1, 2, 3))
    return rows.where(F.col("spec").rlike(REQUIREMENT)).select(
        "bundle_id", "file", "parts", name.alias("name"), F.when(operator == "==", version).alias("version"), F.lit("PyPI").alias("ecosystem"), F.col("n").cast("int").alias("line"), F.lit(0).alias("section"), F.col("n").cast("int").alias("n")
    )


def dependencies(files: DataFrame) -> DataFrame:
    """(bundle_id, file, parts, name, version, ecosystem, line, section, n, dep_key) of requirements.txt, pyproject.toml and package.json.

    Files that cannot be parsed have none.
    """
    base = files.where("text is not null").select("bundle_id", F.col("path").alias("file"), "parts", basename(F.col("path")).alias("base"), "text")
    lines = base.where("base = 'requirements.txt'").select("bundle_id", "file", "parts", F.posexplode(F.split("text", LINE_END)).alias("i", "spec"))
    lines = lines.withColumn("n", F.col("i") + 1).where((strip(F.col("spec")) != "") & ~F.startswith(strip(F.col("spec")), F.lit("#")))
    toml = base.where("base = 'pyproject.toml'").select("bundle_id", "file", "parts", F.posexplode(_toml("text")).alias("i", "spec"))
    toml = _specs(toml.withColumn("n", F.col("i") + 1)).withColumn("line", F.lit(1))
    parsed = base.where("base = 'package.json'").withColumn("v", F.try_parse_json("text"))
    npm = None
    for section, key in enumerate(("dependencies", "devDependencies")):
        held = parsed.select("bundle_id", "file", "parts", F.posexplode(F.try_variant_get("v", f"$.{key}", "map<string,variant>")).alias("n", "name", "raw"))
        text = F.when(F.schema_of_variant("raw") == "STRING", F.try_variant_get("raw", "$", "string"))
        one = held.select("bundle_id", "file", "parts", "name", F.ltrim(text, F.lit("^~>=< ")).alias("version"), F.lit("npm").alias("ecosystem"), F.lit(1).alias("line"), F.lit(section).alias("section"), "n")
        npm = one if npm is None else npm.unionByName(one)
    out = _specs(lines).unionByName(toml).unionByName(npm)
    return out.withColumn("dep_key", F.concat_ws(":", "ecosystem", "name", F.coalesce("version", F.lit("None"))))


def advisory_matches(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """Versioned dependencies with each advisory (dep_key, advisory_id[, ordinal]) on them.

    Without an ordinal, the advisories of one dependency are ordered by their ids.
    """
    if "ordinal" not in advisories.columns:
        order = Window.partitionBy("dep_key").orderBy("advisory_id")  # the few advisories of one release
        advisories = advisories.withColumn("ordinal", F.row_number().over(order))
    return deps.where("version is not null and version <> ''").join(advisories.select("dep_key", "advisory_id", F.col("ordinal").cast("int").alias("ordinal")), "dep_key")


def batch_results(batches: DataFrame) -> DataFrame:
    """(dep_key, advisory_id, ordinal) of (queries array<string>, results array<array<string>>): the n-th result answers the n-th query.

    A reply with another number of results than queries fails the job: nothing tells which belong together.
    """
    same = F.assert_true(F.size("queries") == F.size("results"), "a reply must have a result for each query")
    rows = batches.where(same.isNull()).select(F.explode(F.arrays_zip("queries", "results")).alias("z"))
    return rows.select(F.col("z.queries").alias("dep_key"), F.posexplode("z.results").alias("ordinal", "advisory_id")).select("dep_key", "advisory_id", "ordinal")


def typosquats(deps: DataFrame) -> DataFrame:
    """Names one edit away from a popular name, with the least such name. The popular names are a fixed list."""
    rows = [(e, p) for e, names in POPULAR.items() for p in names]
    popular = F.broadcast(deps.sparkSession.createDataFrame(rows, "eco string, popular string"))
    odd = deps.join(popular, (F.col("ecosystem") == F.col("eco")) & (F.col("name") == F.col("popular")), "left_anti")
    near = odd.join(popular, (F.col("ecosystem") == F.col("eco")) & (F.levenshtein("name", "popular") == 1))
    return near.groupBy(*deps.columns).agg(F.min("popular").alias("popular"))


def mutable_refs(parts: DataFrame) -> DataFrame:
    """The first download from a moving branch of each file but assets."""
    rows = parts.where("type <> 'asset' and text is not null").select("bundle_id", F.col("path").alias("file"), "parts", "text")
    return matches(rows, "text", [Pattern(0, 0, MUTABLE)]).where("match_ord = 1")


def findings(parts: DataFrame, advisories: DataFrame | None, unavailable: str | None = None, config: Config = DEFAULT, refs: DataFrame | None = None) -> DataFrame:
    """``advisories`` None means that the service was not asked; ``unavailable`` tells why it did not answer; ``refs`` may give the moving downloads."""
    chain, file, line = "supply_chain", F.col("file"), F.col("line")
    refs = mutable_refs(parts) if refs is None else refs.where("match_ord = 1")
    out = fd.make(refs, order=fd.seq(4, 0, F.col("parts")), rule=F.lit("supply.mutable_ref"), category=chain, severity="medium", confidence="medium", file=file, line=line, evidence=F.col("match"), risk="What is downloaded can change after review.", remediation="Pin to a commit.", layer=chain, config=config)
    deps = dependencies(parts)
    order = lambda s: fd.seq(4, s, F.col("parts"), F.col("section"), F.col("n"))
    squats = typosquats(deps)
    out = out.unionByName(
        fd.make(squats, order=order(1), rule=F.concat(F.lit("supply.typosquat."), "name"), category=chain, severity="medium", confidence="low", file=file, line=line,
                evidence=F.concat("name", F.lit(" (looks like "), "popular", F.lit(")")), risk="The name imitates a popular package.", remediation="Check the package's name.", layer=chain, config=config)
    )
    if unavailable is not None:
        rows = parts.where("is_primary").select("bundle_id", "parts", F.col("path").alias("file"))
        out = out.unionByName(
            fd.make(rows, order=fd.seq(4, 2, F.col("parts")), rule=F.lit("supply.osv_unavailable"), category=chain, severity="info", confidence="low", file=file, line=None, evidence=F.lit(unavailable[:120]), risk="Dependencies were not checked for known flaws.", remediation="Scan again when the advisories can be read.", layer=chain, config=config)
        )
    if advisories is not None and unavailable is None:
        hit = advisory_matches(deps, advisories)
        # Section, place in the file and place among the advisories make one number each.
        order_ = fd.seq(4, 3, F.col("parts"), F.col("section"), F.col("n"), F.col("ordinal"))
        out = out.unionByName(
            fd.make(hit, order=order_, rule=F.concat(F.lit("supply.osv_vuln."), "name"), category=chain, severity="high", confidence="high", file=file, line=line,
                    evidence=F.concat("name", F.lit("=="), "version", F.lit(" → "), "advisory_id"), risk=F.concat(F.lit("A known flaw: "), "advisory_id"), remediation="Upgrade to a corrected version.", layer=chain, config=config)
        )
    return out
