"""Invisible and direction-changing characters, mixed scripts, and encoded payloads with a second scan."""

from __future__ import annotations

import base64
import binascii
import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from artifact_scan.config import DEFAULT, Config
from artifact_scan.functions.regex import Pattern, matches
from artifact_scan.functions.text import BIDI, ZERO_WIDTH, first_line_with
from artifact_scan.functions.udf import on_text
from artifact_scan.operators import findings as fd
from artifact_scan.operators import scripts
from artifact_scan.operators.static import applicable, rule_table
from artifact_scan.rules.loader import Rule, patterns

# What may be an encoded payload, and how much of it must be printable.
BASE64, HEX = "[A-Za-z0-9+/]{16,}={0,2}", "(?:[0-9a-fA-F]{2}){16,}"
PRINTABLE = 0.85
_ENCODINGS = (("base64", re.compile(BASE64)), ("hex", re.compile(HEX)))


def decode(encoding: str, candidate: str, config: Config = DEFAULT) -> str | None:
    """The candidate's text, if it decodes to at least four mostly printable characters."""
    try:
        raw = base64.b64decode(candidate, validate=True) if encoding == "base64" else bytes.fromhex(candidate)
    except (ValueError, binascii.Error):
        return None
    text = raw[: config.max_decoded_bytes].decode("utf-8", "replace")
    good = sum(c.isprintable() or c in "\t\n\r" for c in text)
    return text if len(text) >= 4 and good >= PRINTABLE * len(text) else None


def blobs(text: str, config: Config = DEFAULT) -> list[dict]:
    """Decoded payloads, each followed by those inside it, up to the depth and the number allowed."""
    out: list[dict] = []

    def look(text: str, depth: int) -> None:
        for encoding, pattern in _ENCODINGS:
            for m in pattern.finditer(text):
                if len(out) >= config.max_blobs:
                    return
                inner = decode(encoding, m.group(), config)
                if inner is not None:
                    out.append({"encoding": encoding, "text": inner, "snippet": m.group()[:80], "depth": depth})
                    if depth < config.max_decode_depth:
                        look(inner, depth + 1)

    look(text, 1)
    return out


_blobs = on_text("array<struct<encoding:string,text:string,snippet:string,depth:int>>")(blobs)


def decoded(rows: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(…, n, encoding, text, snippet, depth) of texts with payloads; only texts with a candidate go to Python."""
    some = rows.where(F.col("text").rlike(BASE64) | F.col("text").rlike(HEX))
    keep = [c for c in rows.columns if c != "text"]
    return some.select(*keep, F.posexplode(_blobs("text", config)).alias("n", "blob")).select(*keep, "n", "blob.*")


def candidates(rows: DataFrame) -> DataFrame:
    """(…, encoding, n, candidate): what may be encoded, before decoding."""
    keep = [c for c in rows.columns if c != "text"]
    each = [rows.select(*keep, F.lit(e).alias("encoding"), F.posexplode(F.regexp_extract_all("text", F.lit(p), 0)).alias("n", "candidate")) for e, p in (("base64", BASE64), ("hex", HEX))]
    return each[0].unionByName(each[1])


def mixed_token(text: str) -> str | None:
    """The first token with letters of two of the Latin, Cyrillic and Greek scripts."""
    for token in text.split():
        if token.isascii():
            continue
        scripts_ = {unicodedata.name(c, "").split(" ")[0] for c in token if c.isalpha()}
        if len(scripts_ & {"LATIN", "CYRILLIC", "GREEK"}) > 1:
            return token
    return None


_mixed = on_text("string")(mixed_token)


def anomalies(rows: DataFrame) -> DataFrame:
    """(…, rule, line) of invisible and direction-changing characters."""
    keep = [c for c in rows.columns if c != "text"]
    rows = rows.where(F.col("text").rlike(f"[{ZERO_WIDTH}{BIDI}]"))
    found = F.array(
        F.struct(F.lit("obfuscation.zero_width").alias("rule"), first_line_with(F.col("text"), ZERO_WIDTH).alias("line")),
        F.struct(F.lit("obfuscation.bidi_override").alias("rule"), first_line_with(F.col("text"), BIDI).alias("line")),
    )
    return rows.select(*keep, F.explode(found).alias("a")).select(*keep, "a.rule", "a.line").where("line is not null")


def findings(rows: DataFrame, rules: list[Rule], config: Config = DEFAULT, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """All checks of (bundle_id, kind, file, section, parts, surface, text); references are information only, scripts only decoded.

    ``keep`` may store what several checks read: the decoded payloads.
    """
    order = lambda *n: F.struct(F.lit(3).alias("layer"), "section", "parts", *((x if not isinstance(x, int) else F.lit(x)).cast("int").alias(f"n{i}") for i, x in enumerate(n)))
    native = lambda s: F.when(F.col("surface") == "reference", "info").otherwise(s)
    file, obf = F.col("file"), "obfuscation"
    prose = rows.where(F.col("surface").isin("body", "reference"))
    odd = anomalies(prose)
    bidi = F.col("rule") == "obfuscation.bidi_override"
    out = fd.make(
        odd, order=order(0, F.when(bidi, 1).otherwise(0), 0), rule=F.col("rule"), category=obf, severity=native(F.when(bidi, "high").otherwise("medium")), confidence="high", file=file, line=F.col("line"),
        evidence=F.when(bidi, "direction-changing characters").otherwise("invisible characters"), risk=F.when(bidi, "Shown and parsed text differ.").otherwise("Text can be hidden from readers."), remediation="Remove the characters.", layer=obf, config=config,
    )
    mixed = prose.where(F.col("text").rlike(r"[^\x00-\x{36F}]")).withColumn("token", _mixed("text")).where("token is not null")
    out = out.unionByName(
        fd.make(mixed, order=order(0, 2, 0), rule=F.lit("obfuscation.script_mixing"), category=obf, severity=native("medium"), confidence="medium", file=file, line=F.lit(1),
                evidence=F.concat(F.lit("mixed-script token: "), "token"), risk="Letters of several scripts imitate a trusted word.", remediation="Use one script in a word.", layer=obf, config=config)
    )
    found = keep(decoded(rows.select("bundle_id", "kind", "file", "section", "parts", "text"), config))
    out = out.unionByName(
        fd.make(found, order=order(1, F.col("n"), 0), rule=F.lit("obfuscation.encoded_payload"), category=obf, severity="info", confidence="medium", file=file, line=F.lit(1),
                evidence=F.concat("encoding", F.lit(" payload: "), "snippet"), risk="Encoded text escapes review.", remediation="Ship content in the clear.", layer=obf, config=config)
    )
    inner = found.select("bundle_id", "kind", "file", "section", "parts", F.col("n").alias("blob"), "encoding", F.lit("body").alias("surface"), "text")
    marked = lambda c: F.concat(F.lit("("), "encoding", F.lit("-decoded) "), c)
    # Rules and shell signatures look at a payload in one pass.
    n = len(rules)
    both = keep(matches(inner, "text", [*patterns(rules), *(Pattern(n + p.rule, 0, p.source) for p in scripts.PATTERNS)], applicable(rules)))
    signs = both.where(f"rule >= {n} and match_ord = 1").withColumn("rule", F.col("rule") - n)
    shell = scripts.signature_columns(signs.unionByName(scripts.fallback(inner).withColumn("match_ord", F.lit(1)).drop("text"), allowMissingColumns=True))
    out = out.unionByName(
        fd.make(shell, order=order(1, F.col("blob"), F.col("rule") + 1), rule=F.col("rule_id"), category="command_execution", severity=F.col("severity"), confidence="high", file=file, line=F.col("line"),
                evidence=marked("match"), risk=F.col("risk"), remediation=scripts.FIX, layer=obf, suffix=".decoded", config=config)
    )
    told = rule_table(both.where(f"rule < {n}"), rules)
    # Rule, pattern and match in the order of a rule file, after the shell signatures; no number of matches runs over.
    told = told.withColumn("again", F.dense_rank().over(Window.partitionBy("bundle_id", "file", "blob").orderBy("rule", "pattern_ord", "match_ord")) + 99)
    return out.unionByName(
        fd.make(told, order=order(1, F.col("blob"), F.col("again")), rule=F.concat("rule_id", F.lit(".decoded")), category=F.col("category"), severity=F.col("rule_severity"), confidence=F.col("confidence"), file=file,
                line=F.lit(1), evidence=marked("line_text"), risk=F.col("risk"), remediation=F.col("remediation"), layer=obf, language=F.col("rule_language"), config=config)
    )
