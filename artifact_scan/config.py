"""Limits and fixed tables of the engine."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Limits of one scan; every value can be replaced by the caller."""

    # The limits that a scan has where the caller gives none.
    max_total_bytes: int = 25 * 1024 * 1024
    max_files: int = 2000
    max_file_bytes: int = 5 * 1024 * 1024
    max_yaml_bytes: int = 256 * 1024
    max_yaml_depth: int = 32
    max_decoded_bytes: int = 2 * 1024 * 1024
    max_decode_depth: int = 2
    max_blobs: int = 64
    min_votes: int = 1
    evidence: int = 240


DEFAULT = Config()

# Ranked and named domains of the data model.
SEVERITIES = ("info", "low", "medium", "high", "critical")
CONFIDENCES = ("low", "medium", "high")
CATEGORIES = (
    "prompt_injection", "command_execution", "data_exfiltration", "excessive_agency", "secret_exposure", "supply_chain",
    "context_poisoning", "obfuscation", "trigger_abuse", "tool_poisoning", "manifest_validation",
)
SEVERITY_WEIGHT = {"critical": 40, "high": 20, "medium": 8, "low": 2, "info": 0}
CONFIDENCE_FACTOR = {"high": 1.0, "medium": 0.7, "low": 0.4}
PRIMARY_FILES = (("SKILL.md", "skill"), ("AGENTS.md", "agents"), ("CLAUDE.md", "claude_md"))
LANGUAGES = {
    ".py": "python", ".sh": "shell", ".bash": "shell", ".zsh": "shell", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".rb": "ruby", ".pl": "perl", ".ps1": "powershell", ".md": "markdown", ".txt": "text",
    ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".toml": "toml",
}
EXECUTABLE = ("python", "shell", "javascript", "typescript", "ruby", "perl", "powershell")
IGNORED_DIRS = ("__pycache__", ".git", ".venv", ".pytest_cache", ".ruff_cache", "node_modules", ".mypy_cache")
POPULAR = {
    "PyPI": ("requests", "numpy", "pandas", "flask", "django", "urllib3", "setuptools", "pyyaml", "cryptography", "boto3"),
    "npm": ("react", "lodash", "express", "axios", "chalk", "commander", "debug", "moment"),
}
SARIF_LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}
LAYERS = ("static_rules", "manifest", "scripts", "obfuscation", "supply_chain", "judge")
