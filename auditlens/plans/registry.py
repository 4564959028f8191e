"""All registered queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from auditlens.plans import core, io, ml

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {**core.QUERIES, **io.QUERIES, **ml.QUERIES}
