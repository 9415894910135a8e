"""Scalar expressions on text and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from artifact_scan.config import CONFIDENCES, LANGUAGES, SEVERITIES

# Code points of invisible and of direction-changing characters.
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff\u2060"
BIDI = "\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"
BLANK = r"[\s\x0B\x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def quoted(text: str) -> str:
    """A string literal of Spark's SQL. Long tables and pattern lists are written as SQL: a call to the JVM for each part would cost more than the query."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strings(values) -> Column:
    return F.expr(f"array({', '.join(map(quoted, values))})")


def mapping(table: dict) -> Column:
    plain = lambda x: quoted(x) if isinstance(x, str) else f"{x}D" if isinstance(x, float) else str(x)
    return F.expr(f"map({', '.join(plain(x) for pair in table.items() for x in pair)})")


def strip(text: Column) -> Column:
    """Without white space, as Unicode sees it, at both ends."""
    return F.regexp_replace(text, rf"\A{BLANK}+|{BLANK}+\z", "")


def clip(text: Column, limit: int = 240) -> Column:
    text = strip(text)
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def lossy(content: Column, limit: int) -> Column:
    """The first ``limit`` bytes as text, with U+FFFD for what is not UTF-8."""
    return F.make_valid_utf8(F.substring(content, 1, limit).cast("string"))


def rank(value: Column, order: tuple[str, ...]) -> Column:
    return F.array_position(strings(order), value).cast("int") - 1


def severity_rank(value: Column) -> Column:
    return rank(value, SEVERITIES)


def confidence_rank(value: Column) -> Column:
    return rank(value, CONFIDENCES)


def escalate(value: Column) -> Column:
    """The next severity; critical stays."""
    return F.element_at(strings(SEVERITIES), F.least(severity_rank(value) + 2, F.lit(len(SEVERITIES))))


def parts(path: Column) -> Column:
    return F.split(path, "/")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def language(path: Column) -> Column:
    """By the last suffix; a name that only begins with a dot has none."""
    suffix = F.lower(F.regexp_extract(basename(path), r"[^/](\.[^./]+)\z", 1))
    return F.try_element_at(mapping(LANGUAGES), suffix)


def safe_basename(name: Column) -> Column:
    """The last path part, null where it is blank or dots only."""
    last = strip(F.substring_index(F.replace(name, F.lit("\\"), F.lit("/")), "/", -1))
    return F.when((last != "") & ~last.rlike(r"\A\.+\z"), last)


def is_remote_url(url: Column) -> Column:
    """https, http, git or ssh urls, and user@host:path; never what begins with a dash."""
    scheme = F.lower(F.substring_index(url, "://", 1))
    colon, slash = F.instr(url, ":"), F.instr(url, "/")
    scp = (F.instr(url, "://") == 0) & (F.instr(url, "@") > 0) & (colon > 0) & ((slash == 0) | (colon < slash))
    return ~F.startswith(url, F.lit("-")) & (((F.instr(url, "://") > 0) & scheme.isin("https", "http", "git", "ssh")) | scp)


def first_line_with(text: Column, characters: str) -> Column:
    """The line of the first character of a set, null if there is none."""
    head = F.regexp_extract(text, rf"(?s)\A(.*?)[{characters}]", 1)
    lines = F.length(head) - F.length(F.replace(head, F.lit("\n"))) + 1
    return F.when(text.rlike(f"[{characters}]"), lines)


def normalized(folder: Column, token: Column) -> Column:
    """``token`` against ``folder`` with . and .. resolved; null where it leaves the root."""
    pieces = F.split(F.concat_ws("/", F.when(folder != "", folder), token), "/")
    none = F.lit(None).cast("array<string>")
    step = lambda s, p: (
        F.when(s.isNull(), none)
        .when((p == "") | (p == "."), s)
        .when(p == "..", F.when(F.size(s) > 0, F.slice(s, 1, F.greatest(F.lit(0), F.size(s) - 1))).otherwise(none))
        .otherwise(F.concat(s, F.array(p)))
    )
    return F.array_join(F.aggregate(pieces, F.array().cast("array<string>"), step), "/")
