"""RE2 patterns as Java patterns with the same matches, and matching with positions.

Spark has no ``finditer``: ``matches`` puts marks around each match, splits at them and
folds over the pieces, which gives line, clause and evidence.  Texts that
match nothing, nearly all, only pay for plain searches: a pattern is tried where one of
the literals that any of its matches must hold occurs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from artifact_scan.functions.text import quoted

BEGIN, END = "\ue000", "\ue001"  # private use; taken out of texts first
_BOUNDARY = "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def to_java(pattern: str) -> str:
    """Unicode case folding, ASCII word boundaries, ``\\s`` without ``\\v``, ``.`` that stops at ``\\n`` only, and an end that is the end."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            nxt = pattern[i + 1]
            out.append({"s": r"\t\n\f\r " if inside else r"[\t\n\f\r ]", "b": _BOUNDARY if not inside else r"\b"}.get(nxt, c + nxt))
            i += 2
            continue
        if c == "[":
            inside = True
        elif c == "]":
            inside = False
        out.append(r"\z" if c == "$" and not inside else c)
        i += 1
    text = "".join(out)
    return text.replace("(?i)", "(?iud)", 1) if text.startswith("(?i)") else "(?d)" + text


@dataclass(frozen=True)
class Pattern:
    """A pattern and its place in the order of findings."""

    rule: int
    ordinal: int
    source: str

    @property
    def java(self) -> str:
        return to_java(self.source)


def _alternatives(items) -> list[str] | None:
    """The literals of which a match of a parsed sequence must hold one, the longest such choice."""
    best, run = None, ""

    def better(found):
        nonlocal best
        if found and all(found) and (best is None or min(map(len, found)) > min(map(len, best))):
            best = found

    for op, value in [*items, (None, None)]:
        name = str(op)
        if name == "LITERAL":
            run += chr(value)
            continue
        better([run] if run else None)
        run = ""
        if name == "SUBPATTERN":
            better(_alternatives(value[3]))
        elif name == "BRANCH":
            options = [_alternatives(b) for b in value[1]]
            better([x for o in options for x in o] if all(options) else None)
        elif name == "MAX_REPEAT" and value[0] > 0:
            better(_alternatives(value[2]))
    return best


@lru_cache(maxsize=None)
def required(pattern: str) -> tuple[str, ...]:
    """Lower-case literals of which any text that the RE2 pattern matches holds one; empty if there is no such set."""
    found = _alternatives(list(re._parser.parse(pattern)))  # type: ignore[attr-defined]
    return tuple(dict.fromkeys(x.lower() for x in found)) if found else ()


def lowered(text: Column) -> Column:
    """Lower case as case-insensitive matching sees it: the long s counts as s."""
    return F.translate(F.lower(text), "\u017f", "s")


def hits(text: str, low: str, patterns: list[Pattern], when: dict[int, str] | None = None) -> Column:
    """The numbers of the patterns that column ``text`` (``low`` in lower case) matches; ``when`` limits a rule to rows, in SQL."""
    flags = []
    for n, p in enumerate(patterns):
        tests = [when[p.rule]] if when and p.rule in when else []
        if literals := required(p.source):
            tests.append(" or ".join(f"contains({low}, {quoted(x)})" for x in literals))
        flags.append(f"case when {' and '.join(f'({t})' for t in [*tests, f'rlike({text}, {quoted(p.java)})'])} then {n} end")
    return F.expr(f"filter(array({', '.join(flags)}), x -> x is not null)")


def _plain(piece: Column) -> Column:
    return F.replace(piece, F.lit(END))


def _before(pieces: str) -> Column:
    """For each match its line, what stands before it since the last end of a clause, and since the last end of a line.

    One pass over the pieces: each match's state follows from the one before, cut at the last
    separator, not by a pattern anchored at the end, which would try every start.
    """

    def step(states: Column, piece: Column) -> Column:
        last, plain = F.element_at(states, -1), _plain(piece)
        clauses = F.translate(plain, ".;:!?", "\n\n\n\n\n")
        since = lambda text, old: F.when(F.contains(text, F.lit("\n")), F.substring_index(text, "\n", -1)).otherwise(F.concat(old, text))
        line = last["line"] + F.length(plain) - F.length(F.replace(plain, F.lit("\n")))
        return F.concat(states, F.array(F.struct(line.alias("line"), since(clauses, last["clause"]).alias("clause"), since(plain, last["tail"]).alias("tail"))))

    start = F.array(F.struct(F.lit(1).alias("line"), F.lit("").alias("clause"), F.lit("").alias("tail")))
    states = F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), start, step)
    return F.slice(states, 2, F.size(pieces))


def _after(pieces: str) -> Column:
    """For each match what stands from its begin to the end of its line."""

    def step(heads: Column, piece: Column) -> Column:
        plain = _plain(piece)
        head = F.when(F.contains(plain, F.lit("\n")), F.substring_index(plain, "\n", 1)).otherwise(F.concat(plain, F.element_at(heads, -1)))
        return F.concat(heads, F.array(head))

    heads = F.aggregate(F.reverse(F.slice(pieces, 2, F.size(pieces))), F.array(F.lit("")), step)
    return F.slice(F.reverse(heads), 1, F.size(pieces) - 1)


def matches(df: DataFrame, text: str, patterns: list[Pattern], when: dict[int, str] | None = None) -> DataFrame:
    """A row for each match: columns of ``df`` but the text, and rule, pattern_ord, match_ord, line, clause, line_text, match.

    ``clause`` is what stands before the match since the last of ``. ; : ! ?`` or line end.
    """
    spark = df.sparkSession
    clean = F.translate(F.col(text), BEGIN + END, "")
    found = df.withColumn("_text", clean).withColumn("_low", lowered(F.col("_text")))
    found = found.withColumn("_hits", hits("_text", "_low", patterns, when)).drop("_low", text)
    # The outer form, as the optimizer would compute the array once more to filter the inner one's input.
    found = found.withColumn("_hit", F.explode_outer("_hits")).drop("_hits").where("_hit is not null")
    known = spark.createDataFrame([(n, p.rule, p.ordinal, p.java) for n, p in enumerate(patterns)], "_hit int, rule int, pattern_ord int, _java string")
    found = found.join(F.broadcast(known), "_hit")  # one row a pattern of the corpus
    pieces = F.split(F.regexp_replace(F.col("_text"), F.col("_java"), F.lit(BEGIN + "$0" + END)), BEGIN, -1)
    found = found.withColumn("_pieces", pieces).drop("_text")
    each = F.arrays_zip(_before("_pieces").alias("before"), _after("_pieces").alias("after"), F.slice("_pieces", 2, F.size("_pieces")).alias("piece"))
    found = found.withColumn("_each", each).drop("_pieces").select("*", F.posexplode("_each").alias("_pos", "_at")).drop("_each")
    match_ord, match = (F.col("_pos") + 1).alias("match_ord"), F.substring_index("_at.piece", END, 1).alias("match")
    return found.select(
        *[c for c in df.columns if c != text],
        "rule",
        "pattern_ord",
        match_ord,
        F.col("_at.before.line").alias("line"),
        F.col("_at.before.clause").alias("clause"),
        F.concat("_at.before.tail", "_at.after").alias("line_text"),
        match,
    )
