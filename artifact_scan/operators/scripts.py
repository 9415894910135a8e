"""Shell signatures, pipelines into shells, and dangerous Python calls. Code is parsed, never run."""

from __future__ import annotations

import ast
import re
import shlex
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from artifact_scan.config import DEFAULT, Config
from artifact_scan.functions.regex import Pattern, matches
from artifact_scan.functions.udf import on_text
from artifact_scan.operators import findings as fd

# Fixed values: (id, severity, pattern in RE2 syntax); risks are this project's own words.
SIGNATURES = (
    ("shell.reverse_socat", "critical", r"(?i)socat\b.{0,80}(tcp|tcp4|tcp6):.{0,80}exec", "socat hands a shell to a remote host."),
    ("shell.reverse_nc", "critical", r"(?i)\bnc\b.{0,30}\s-e\b", "netcat runs a program for a remote host."),
    ("shell.reverse_devtcp", "critical", r"(?i)(ba)?sh\b.{0,40}/dev/tcp/", "A shell is tied to a network socket."),
    ("shell.interactive_reverse", "critical", r"(?i)(ba|z)?sh\s+-i\b.{0,40}(>&|/dev/tcp|\|)", "An interactive shell is redirected elsewhere."),
    ("shell.download_pipe_shell", "high", r"(?i)(curl|wget|fetch)\b.{0,200}\|\s*(sudo\s+)?(ba|z)?sh\b", "A download goes straight into a shell."),
    ("shell.persistence_write", "high", r"(?i)>>?\s*[~/]?[^\s]*(\.bashrc|\.zshrc|\.bash_profile|\.profile|\.ssh/|/\.git/hooks/)", "Start-up, key or hook files are written."),
    ("shell.xattr_clear", "medium", r"(?i)xattr\s+-c\b", "Quarantine attributes are cleared."),
)
DOWNLOADERS, SHELLS = ("curl", "wget", "fetch"), ("sh", "bash", "zsh", "dash", "ksh")
FIX = "Take the command out; download, review and run in separate steps."
PIPE = next(i for i, s in enumerate(SIGNATURES) if s[0] == "shell.download_pipe_shell")
NETWORK_PREFIXES, NETWORK_CALLS = ("requests.", "httpx.", "aiohttp.", "urllib."), ("urlopen", "sendall")


PATTERNS = [Pattern(i, 0, s[2]) for i, s in enumerate(SIGNATURES)]


def signature_matches(rows: DataFrame) -> DataFrame:
    """The first match of each signature in each text."""
    return matches(rows, "text", PATTERNS).where("match_ord = 1")


def signature_columns(found: DataFrame) -> DataFrame:
    table = found.sparkSession.createDataFrame([(i, s[0], s[1], s[3]) for i, s in enumerate(SIGNATURES)], "rule int, rule_id string, severity string, risk string")
    return found.join(F.broadcast(table), "rule")


def pipeline_into_shell(text: str) -> str | None:
    """`downloader | … | shell` over any distance, as the commands' first words; None if there is none or it cannot be parsed."""
    text = re.sub(r"(^|\s)#[^\n]*", r"\1", text.replace("\\\n", " "))
    try:
        lexer = shlex.shlex(text, posix=True, punctuation_chars="|;&()\n")
        lexer.whitespace, lexer.commenters = " \t\r", ""
        words = list(lexer)
    except ValueError:
        return None
    names: list[str] = []
    fresh = True
    for word in [*words, ";"]:
        if word and set(word) <= set("|;&()\n"):
            if word != "|":
                if names and names[0] in DOWNLOADERS and any(n in SHELLS for n in names[1:]):
                    return " | ".join(names)
                names = []
            fresh = True
        elif fresh and not ("=" in word and word.split("=")[0].isidentifier()):
            names.append(word)
            fresh = False
    return None


_pipeline = on_text("string")(pipeline_into_shell)


def _dotted(node: ast.expr) -> str:
    """The dotted name of a call's function; what is no name counts as empty."""
    names = []
    while isinstance(node, ast.Attribute):
        names.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        names.append(node.id)
    return ".".join(reversed(names))


def python_calls(source: str) -> list[tuple[str, str, int, str]]:
    """(rule, severity, line, evidence) of dangerous calls in breadth-first order; [] for what cannot be parsed."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            nodes = list(ast.walk(ast.parse(source)))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out = []
    secret, sink = False, 0
    for node in nodes:
        secret |= isinstance(node, ast.Attribute) and node.attr == "environ"
        if not isinstance(node, ast.Call):
            continue
        name = _dotted(node.func)
        secret |= name in ("os.getenv", "os.environ.get")
        if name.startswith(NETWORK_PREFIXES) or name.rpartition(".")[2] in NETWORK_CALLS or "socket" in name:
            sink = node.lineno
        shell = any(k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True for k in node.keywords)
        severity = None
        if name in ("os.system", "os.popen", "eval", "exec") or (name.startswith("subprocess.") and shell):
            severity = "high"
        elif name in ("compile", "__import__"):
            severity = "medium"
        if severity:
            out.append(("ast.python." + name.replace(".", "_"), severity, node.lineno, f"{name}(...)"))
    if secret and sink:
        out.append(("taint.source_to_network", "critical", sink, "environment values reach a network call"))
    return out


@on_text("array<struct<rule:string,severity:string,line:int,evidence:string>>")
def _calls(text: str) -> list[dict]:
    return [{"rule": r, "severity": s, "line": n, "evidence": e} for r, s, n, e in python_calls(text)]


def _shell(rows: DataFrame, config: Config, found: DataFrame | None) -> DataFrame:
    found = signature_columns(signature_matches(rows) if found is None else found.where("match_ord = 1"))
    return fd.make(
        found, order=fd.seq(2, 0, F.col("parts"), F.col("rule")), rule=F.col("rule_id"), category="command_execution", severity=F.col("severity"),
        confidence="high", file=F.col("file"), line=F.col("line"), evidence=F.col("match"), risk=F.col("risk"), remediation=FIX, layer="ast_shell", config=config,
    )


def fallback(rows: DataFrame) -> DataFrame:
    """Pipelines that the signature misses. Only texts that name a downloader, a pipe and a shell go to Python."""
    maybe = rows.where(F.col("text").rlike(r"\b(curl|wget|fetch)\b") & F.col("text").contains("|") & F.col("text").rlike(r"\b(sh|bash|zsh|dash|ksh)\b"))
    maybe = maybe.where(~F.col("text").rlike(Pattern(0, 0, SIGNATURES[PIPE][2]).java))
    return maybe.withColumn("match", _pipeline("text")).where("match is not null").withColumn("rule", F.lit(PIPE)).withColumn("line", F.lit(1))


def findings(parts: DataFrame, config: Config = DEFAULT, found: DataFrame | None = None) -> DataFrame:
    """Shell and Python files; other languages have no findings here. ``found`` may give the signatures' matches."""
    code = parts.where("executable and text is not null").select("bundle_id", F.col("path").alias("file"), "parts", "language", "text")
    shell = code.where("language = 'shell'").drop("language")
    more = signature_columns(fallback(shell))
    out = _shell(shell, config, found).unionByName(
        fd.make(
            more, order=fd.seq(2, 0, F.col("parts"), 99), rule=F.col("rule_id"), category="command_execution", severity=F.col("severity"), confidence="high",
            file=F.col("file"), line=F.col("line"), evidence=F.col("match"), risk=F.col("risk"), remediation=FIX, layer="ast_shell", config=config,
        )
    )
    calls = code.where("language = 'python'").select("bundle_id", "file", "parts", F.posexplode(_calls("text")).alias("n", "call"))
    taint = F.col("call.rule") == "taint.source_to_network"
    calls = calls.withColumn("taint", taint)
    common = dict(rule=F.col("call.rule"), severity=F.col("call.severity"), file=F.col("file"), line=F.col("call.line"), evidence=F.col("call.evidence"), config=config)
    order = fd.seq(2, 0, F.col("parts"), F.col("n"))
    return out.unionByName(
        fd.make(calls.where("not taint"), order=order, category="command_execution", confidence="high", risk="The call runs a shell or code from text.", remediation="Avoid the call, or pass fixed arguments without a shell.", layer="ast_python", **common)
    ).unionByName(
        fd.make(calls.where("taint"), order=order, category="data_exfiltration", confidence="medium", risk="Environment values are read where data is sent out.", remediation="Do not send environment or secret values to other hosts.", layer="taint", **common)
    )
