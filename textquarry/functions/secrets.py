"""Credential shapes. Only the kind and place of a match ever leave these functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textquarry.functions.paths import is_env_file

# Kind and public token format.
SECRET_PATTERNS = {
    "a private key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "a GitHub token": r"gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}",
    "an AWS access key": r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    "a Google API key": r"AIza[0-9A-Za-z_-]{35}",
    "a Slack token": r"xox[abeoprs]-[A-Za-z0-9-]{10,}",
}
ENV_FILE = "an environment file"
ANY_SECRET = "|".join(f"(?:{pattern})" for pattern in SECRET_PATTERNS.values())
REDACTED = "[redacted]"


def secret_kinds(text: Column, path: Column | None = None) -> Column:
    """Array of the kinds found in the text, plus the environment-file kind by path."""
    found = [F.when(text.rlike(pattern), kind) for kind, pattern in SECRET_PATTERNS.items()]
    if path is not None:
        found.append(F.when(is_env_file(path), ENV_FILE))
    return F.array_compact(F.array(*found))


def redact(text: Column) -> Column:
    return F.regexp_replace(text, ANY_SECRET, REDACTED)


def redaction_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(ANY_SECRET))
