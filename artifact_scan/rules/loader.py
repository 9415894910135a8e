"""Rules from YAML files: the built-in corpus, or any folder of files of the same shape."""

from __future__ import annotations

from dataclasses import dataclass, fields
from pathlib import Path

import yaml

from artifact_scan.functions.regex import Pattern

CORPUS = Path(__file__).with_name("corpus.yaml")
# Fixed value: what marks a statement as forbidden rather than asked for.
NEGATION = r"(?i)\b(never|don't|dont|do not|avoid|must not|should not|ніколи|никогда)\b"


@dataclass(frozen=True)
class Rule:
    id: str
    category: str
    severity: str
    confidence: str
    description: str
    remediation: str
    patterns: tuple[str, ...]
    surfaces: tuple[str, ...] = ("any",)
    kinds: tuple[str, ...] = ("any",)
    escalate_for_claude_md: bool = False
    negatable: bool = False
    language: str | None = None

    def applies_to(self, surface: str, kind: str | None) -> bool:
        return ("any" in self.surfaces or surface in self.surfaces) and (kind is None or "any" in self.kinds or kind in self.kinds)


def load(path: Path = CORPUS) -> list[Rule]:
    """The rules of a file, or of all ``*.yaml`` files of a folder in the order of their names; other keys are ignored."""
    files = sorted(path.glob("*.yaml")) if path.is_dir() else [path]
    entries = [e for f in files for e in yaml.safe_load(f.read_text(encoding="utf-8")) or []]
    known = {f.name for f in fields(Rule)}
    return [Rule(**{k: tuple(v) if isinstance(v, list) else v for k, v in e.items() if k in known}) for e in entries]


def patterns(rules: list[Rule]) -> list[Pattern]:
    return [Pattern(i, k, p) for i, r in enumerate(rules) for k, p in enumerate(r.patterns)]
