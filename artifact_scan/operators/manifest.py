"""Frontmatter checks of skills and agents, and imports of memory files."""

from __future__ import annotations

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from artifact_scan.config import DEFAULT, Config
from artifact_scan.functions.regex import Pattern, matches, to_java
from artifact_scan.functions.text import normalized, strip
from artifact_scan.functions.udf import on_text
from artifact_scan.operators import findings as fd

# Patterns in RE2 syntax.
DYNAMIC = r"!`[^`]+`"
ARGUMENTS = r"\$(ARGUMENTS|\{ARGUMENTS\}|[1-9])"
SHELL_HINT = r"(?i)(```\s*(ba)?sh|!`|\bcurl\b|\bwget\b|\bbash\b|\bsh -c\b|\beval\b|\bsubprocess\b|\bos\.system\b)"
BROAD_BASH = r"(?i)bash\s*\(\s*\*\s*\)"
UNSCOPED_BASH = r"(?i)(^|[,\[\s])bash($|[,\]\s])"
HIJACK = r"(?i)(for (all|every|any) (task|request|prompt|query|conversation)|always use this|use this (skill )?(for )?(everything|all|any))"
SENSITIVE = r"(?i)(\.ssh|\.aws|\.config|\.netrc|\.npmrc|/etc/|id_rsa|\.env|credentials)"
IMPORT = r"(?:^|\s)@([^\s]+)"
TRAILING = ",;:)]}>\"'"

FRONTMATTER = (
    "struct<present:boolean,malformed:boolean,body:string,raw:string,name:string,tools:string,has_model:boolean,model:string,"
    "context:string,agent:string,hidden:boolean,has_description:boolean,description:string>"
)


def split_fences(text: str) -> tuple[str, str] | None:
    """(raw, body) of a text that begins with a closed ``---`` block."""
    lines = text.splitlines()
    if not lines or lines[0].strip() != "---":
        return None
    end = next((i for i, line in enumerate(lines[1:], 1) if line.strip() == "---"), None)
    return None if end is None else ("\n".join(lines[1:end]), "\n".join(lines[end + 1 :]))


def _too_deep(raw: str, limit: int) -> bool:
    depth = 0
    for c in raw:
        depth = depth + 1 if c in "[{" else max(0, depth - 1) if c in "]}" else depth
        if depth > limit:
            return True
    return any(len(line) - len(line.lstrip(" ")) > limit for line in raw.splitlines())


def parse_frontmatter(text: str, config: Config = DEFAULT) -> dict:
    """The fixed fields that checks read, with presence kept apart from null."""
    empty = dict.fromkeys(("name", "tools", "model", "context", "agent", "description"))
    out = {"present": False, "malformed": False, "body": text, "raw": None, "has_model": False, "hidden": False, "has_description": False, **empty}
    cut = split_fences(text)
    if cut is None:
        return out
    out |= {"present": True, "malformed": True, "raw": cut[0], "body": cut[1]}
    if len(cut[0].encode("utf-8", "ignore")) > config.max_yaml_bytes or _too_deep(cut[0], config.max_yaml_depth):
        return out
    try:
        data = yaml.safe_load(cut[0])
    except (yaml.YAMLError, RecursionError, ValueError):
        return out
    if not isinstance(data, dict):
        return out
    tools = data.get("allowed-tools")
    return out | {
        "malformed": False,
        "name": str(data["name"]) if data.get("name") else None,
        "tools": None if "allowed-tools" not in data else ", ".join(map(str, tools)) if isinstance(tools, (list, tuple)) else str(tools),
        "has_model": "model" in data,
        "model": str(data.get("model")),
        "context": str(data.get("context", "")),
        "agent": str(data["agent"]) if data.get("agent") else None,
        "hidden": bool(data.get("disable-model-invocation")) and data.get("user-invocable") is False,
        "has_description": "description" in data,
        "description": str(data.get("description", "")),
    }


_frontmatter = on_text(FRONTMATTER)(parse_frontmatter)


def with_frontmatter(rows: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """``fm`` for each text; only texts whose first line is a fence go to Python."""
    fenced = F.col("text").rlike(r"\A[^\S\n]*---[^\S\n]*(\n|\r|\z)")
    plain = F.struct(
        F.lit(False).alias("present"), F.lit(False).alias("malformed"), F.col("text").alias("body"), F.lit(None).cast("string").alias("raw"), F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("string").alias("tools"), F.lit(False).alias("has_model"), F.lit(None).cast("string").alias("model"), F.lit(None).cast("string").alias("context"),
        F.lit(None).cast("string").alias("agent"), F.lit(False).alias("hidden"), F.lit(False).alias("has_description"), F.lit(None).cast("string").alias("description"),
    )
    return rows.where(fenced).withColumn("fm", _frontmatter("text", config)).unionByName(rows.where(~fenced).withColumn("fm", plain))


def _raw() -> Column:
    return F.coalesce("fm.raw", F.lit(""))


def broad_tools(tools: Column) -> Column:
    star = strip(tools)
    return tools.rlike(to_java(BROAD_BASH)) | tools.rlike(to_java(UNSCOPED_BASH)) | (star == "*") | tools.contains(", *") | F.startswith(star, F.lit("*"))


def skill_findings(rows: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The frontmatter checks; ``rows`` are primary documents of skills and agents with ``fm``."""
    fm = lambda c: F.col(f"fm.{c}")
    file, parts = F.col("file"), F.col("parts")
    validation, agency = "manifest_validation", "excessive_agency"
    checks = [
        (0, "manifest.malformed_frontmatter", fm("malformed"), validation, "medium", "high", F.when(_raw() != "", F.substring(_raw(), 1, 120)).otherwise("malformed frontmatter"), "The frontmatter cannot be read, so what the skill may do is unknown.", "Repair the YAML block."),
        (0, "manifest.missing_frontmatter", ~fm("present"), validation, "medium", "medium", F.lit("no frontmatter block"), "Without frontmatter the skill declares neither tools nor purpose.", "Add name, description and a narrow list of tools."),
        (1, "manifest.allowed_tools_broad", F.coalesce(broad_tools(fm("tools")), F.lit(False)), agency, "high", "high", F.concat(F.lit("allowed-tools: "), fm("tools")), "The tool grant lets the skill run any shell command.", "Grant named commands only."),
        (4, "manifest.model_override", fm("has_model"), validation, "medium", "medium", F.concat(F.lit("model: "), fm("model")), "Another model may be weaker or less careful.", "Leave the choice of model to the user."),
        (5, "manifest.context_fork", F.coalesce(F.lower(strip(fm("context"))) == "fork", F.lit(False)), agency, "medium", "medium", F.concat(F.lit("context/agent: "), F.coalesce(F.nullif(fm("context"), F.lit("")), fm("agent"), F.lit("None"))), "A forked agent acts out of the user's sight.", "Keep spawned work under review."),
        (6, "manifest.hidden_invocation", fm("hidden"), validation, "medium", "low", F.lit("disable-model-invocation + user-invocable: false"), "The two settings together hide when the skill runs.", "Let the user see it run."),
        (7, "manifest.missing_description", fm("present") & ~fm("malformed") & ~fm("has_description"), validation, "medium", "medium", F.lit("no description"), "It is not told what the skill is for.", "Describe the purpose narrowly."),
        (8, "manifest.trigger_hijack", F.coalesce(fm("description").rlike(to_java(HIJACK)), F.lit(False)), "trigger_abuse", "medium", "medium", F.concat(F.lit("description: "), fm("description")), "The description claims every request.", "Name the task the skill is for."),
    ]
    fired = F.array(*(F.when(c, F.struct(F.lit(n).alias("n"), F.lit(rule).alias("rule"), F.lit(cat).alias("category"), F.lit(sev).alias("severity"), F.lit(conf).alias("confidence"), ev.alias("evidence"), F.lit(risk).alias("risk"), F.lit(fix).alias("fix"))) for n, rule, c, cat, sev, conf, ev, risk, fix in checks))
    hit = rows.select("bundle_id", "file", "parts", F.explode(F.filter(fired, lambda x: x.isNotNull())).alias("c"))
    c = lambda x: F.col(f"c.{x}")
    return fd.make(hit, order=fd.seq(1, 0, parts, c("n")), rule=c("rule"), category=c("category"), severity=c("severity"), confidence=c("confidence"), file=file, line=F.lit(1), evidence=c("evidence"), risk=c("risk"), remediation=c("fix"), layer="manifest", config=config)


def dynamic_commands(rows: DataFrame) -> DataFrame:
    """A row for each ``!`…``` directive, in the frontmatter and then in the body; lines count within each."""
    texts = F.array(F.struct(F.lit(0).alias("surface"), _raw().alias("text")), F.struct(F.lit(1).alias("surface"), F.col("fm.body").alias("text")))
    both = rows.select("bundle_id", "file", "parts", F.explode(texts).alias("t")).select("bundle_id", "file", "parts", "t.surface", "t.text")
    return matches(both, "text", [Pattern(0, 0, DYNAMIC)])


def arguments_in_shell(rows: DataFrame) -> DataFrame:
    """The first argument substitution of texts that also run a shell."""
    joined = rows.withColumn("text", F.concat(_raw(), F.lit("\n"), "fm.body")).where(F.col("text").rlike(to_java(SHELL_HINT)))
    return matches(joined.select("bundle_id", "file", "parts", "text"), "text", [Pattern(0, 0, ARGUMENTS)]).where("match_ord = 1")


def import_tokens(rows: DataFrame) -> DataFrame:
    """(…, n, token) of ``@path`` references of (bundle_id, file, text)."""
    found = F.regexp_extract_all("text", F.lit(to_java(IMPORT)), 1)
    tokens = rows.select("bundle_id", "file", F.posexplode(found).alias("n", "token"))
    tokens = tokens.withColumn("token", F.rtrim("token", F.lit(TRAILING)))
    return tokens.where(F.col("token").contains("/") | F.col("token").contains(".") | F.startswith("token", F.lit("~")))


def classify_imports(tokens: DataFrame, files: DataFrame) -> DataFrame:
    """Tokens with kind, target and resolved."""
    token = F.col("token")
    folder = F.regexp_extract("file", r"\A(.*)/[^/]*\z", 1)
    inside = normalized(folder, token)
    kind = F.when(token.contains("://"), "remote").when(F.startswith(token, F.lit("~")) | F.startswith(token, F.lit("/")), "out_of_tree").when(inside.isNull(), "out_of_tree").otherwise("in_tree")
    out = tokens.withColumn("kind", kind).withColumn("target", F.when(kind == "in_tree", F.when(inside == "", ".").otherwise(inside)).otherwise(token))
    there = files.select("bundle_id", F.col("path").alias("target"), F.lit(True).alias("there")).distinct()
    return out.join(there, ["bundle_id", "target"], "left").withColumn("resolved", F.coalesce((F.col("kind") == "in_tree") & F.col("there"), F.lit(False))).drop("there")


def imports(primary: DataFrame, files: DataFrame) -> DataFrame:
    """(bundle_id, ord, raw, target, kind, resolved): imports of the primary file and of what it imports, once each."""
    near = classify_imports(import_tokens(primary.select("bundle_id", "file", "text")), files).withColumn("hop", F.array(F.lit(0), F.lit(0)))
    order = F.struct("hop", "n")
    follow = near.where("resolved").groupBy("bundle_id", F.col("target").alias("path")).agg(F.min("n").alias("via"), F.first("file").alias("from"))
    deeper = follow.where("path <> from").join(files, ["bundle_id", "path"])
    far = classify_imports(import_tokens(deeper.select("bundle_id", F.col("path").alias("file"), "text")), files)
    far = far.join(follow.select("bundle_id", F.col("path").alias("file"), "via"), ["bundle_id", "file"]).withColumn("hop", F.array(F.lit(1), F.col("via"))).drop("via")
    every = near.unionByName(far.select(*near.columns))
    best = F.min(F.struct(order.alias("ord"), "token", "resolved"))
    out = every.groupBy("bundle_id", "target", "kind").agg(best.alias("b"))
    return out.select("bundle_id", "b.ord", F.concat(F.lit("@"), "b.token").alias("raw"), "target", "kind", "b.resolved")


def import_findings(found: DataFrame, found_primary: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Imports from outside the bundle."""
    rows = found.where("kind <> 'in_tree'").join(found_primary.select("bundle_id", F.col("primary_path").alias("file")), "bundle_id")
    sensitive = F.col("target").rlike(to_java(SENSITIVE))
    risk = F.concat(F.when(F.col("kind") == "remote", "A remote").otherwise("An out-of-tree"), F.lit(" import puts foreign text into what is always loaded."), F.when(sensitive, " Its target is a sensitive path.").otherwise(""))
    order = F.struct(F.lit(1).alias("layer"), F.lit(1).alias("section"), F.array().cast("array<string>").alias("parts"), F.element_at("ord.hop", 1).alias("n0"), F.element_at("ord.hop", 2).alias("n1"), F.col("ord.n").alias("n2"))
    return fd.make(rows, order=order, rule=F.concat(F.lit("manifest.import_"), "kind"), category="context_poisoning", severity="high", confidence=F.when(sensitive, "high").otherwise("medium"), file=F.col("file"), line=F.lit(1), evidence=F.col("raw"), risk=risk, remediation="Import reviewed files of the bundle only.", layer="manifest", config=config)


def findings(primary: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """All checks of ``primary`` (bundle_id, kind, file, parts, is_doc, text): skills and agents that are documents."""
    rows = with_frontmatter(primary.where("kind in ('skill', 'agents') and is_doc and text is not null"), config)
    dynamic, arguments = dynamic_commands(rows), arguments_in_shell(rows)
    order = F.struct(F.lit(1).alias("layer"), F.lit(0).alias("section"), F.col("parts"), F.lit(2).alias("n0"), F.col("surface").alias("n1"), F.col("match_ord").alias("n2"))
    execution = "command_execution"
    return (
        skill_findings(rows, config)
        .unionByName(fd.make(dynamic, order=order, rule=F.lit("manifest.dynamic_command"), category=execution, severity="critical", confidence="high", file=F.col("file"), line=F.col("line"), evidence=F.col("match"), risk="The directive runs a command while the skill loads.", remediation="Do not run commands from the document.", layer="manifest", config=config))
        .unionByName(fd.make(arguments, order=fd.seq(1, 0, F.col("parts"), 3), rule=F.lit("manifest.arguments_in_shell"), category=execution, severity="high", confidence="medium", file=F.col("file"), line=F.col("line"), evidence=F.col("line_text"), risk="User input is put into a shell command.", remediation="Check arguments and pass them without a shell.", layer="manifest", config=config))
    )
