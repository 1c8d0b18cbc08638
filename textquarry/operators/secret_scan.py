"""Secret scan of newly written text. Findings name kind and place, never the match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.functions import secrets


def scan_secrets(df: DataFrame, text_col: str = "new_text", path_col: str = "path") -> DataFrame:
    """One row per finding."""
    keep = [c for c in df.columns if c not in (text_col, "old_text")]
    return df.select(
        *keep, F.explode(secrets.secret_kinds(F.col(text_col), F.col(path_col))).alias("kind")
    )


def redact_secrets(df: DataFrame, text_col: str = "content") -> DataFrame:
    return df.withColumn("redactions", secrets.redaction_count(F.col(text_col))).withColumn(
        text_col, secrets.redact(F.col(text_col))
    )
