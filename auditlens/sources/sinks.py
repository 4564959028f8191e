"""Result files."""

from __future__ import annotations

from pyspark.sql import DataFrame

from auditlens.operators.triage import export_rows


def write_csv(rows: DataFrame, path: str) -> None:
    """The triage export: header, every cell quoted, quotes doubled."""
    export_rows(rows).write.csv(path, header=True, quoteAll=True, escape='"')


def write_json(summary: DataFrame, results: DataFrame, path: str) -> None:
    """Summary and results side by side, one JSON object per line."""
    summary.write.json(f"{path}/summary")
    results.write.json(f"{path}/results")
