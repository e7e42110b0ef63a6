"""Saving summary tables by name."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame


def save_table(table: DataFrame, folder: str, name: str, kind: str = "csv") -> str:
    """Write a report as one CSV or JSON file below ``folder/name``.

    Reports have one row per reported line, hence the single output file.
    """
    if kind not in ("csv", "json"):
        raise ValueError(f"unknown kind {kind!r}, use 'csv' or 'json'")
    path = f"{folder.rstrip('/')}/{name}"
    writer = table.coalesce(1).write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.json(path)
    return path


def save_evaluation(evaluation: Mapping[str, DataFrame], folder: str, slug: str) -> dict[str, str]:
    """Write per-class table, confusion and summary of one evaluation under one name."""
    return {
        "per_class": save_table(evaluation["per_class"], folder, f"{slug}_per_class"),
        "confusion": save_table(evaluation["confusion"], folder, f"{slug}_confusion"),
        "summary": save_table(evaluation["summary"], folder, f"{slug}_summary", "json"),
    }
