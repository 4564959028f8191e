"""What the operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlens.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> SparkSession:
    """The session, with a checkpoint folder set where the cluster names none."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return spark


def content_key(value: Column) -> list[Column]:
    """128 bits that stand for a value; equal values have equal keys. Null stays null."""
    keep = lambda c: F.when(value.isNotNull(), c)
    return [keep(F.xxhash64(value)).alias("_k1"), keep(F.xxhash64(F.lit(1), value)).alias("_k2")]


def held_out(id_col: str) -> Column:
    """Whether a row may not be learned from: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(False))


#: Characters whose results are handed back together, which bounds a worker's memory.
HANDED_BACK = 4_000_000


def in_parts(texts: Iterable[str | None], size: int = HANDED_BACK) -> Iterator[list[str]]:
    """The texts in order, some at a time; null counts as empty."""
    part, length = [], 0
    for text in texts:
        part.append(text or "")
        length += len(part[-1])
        if length >= size:
            yield part
            part, length = [], 0
    if part:
        yield part


def each_text(make: Callable[[], Callable[[list[str]], Iterable[tuple]]], schema: str) -> Callable:
    """A pandas UDF over one text column, with `;` between the result's fields. Null is empty.

    make() runs once a task and returns the function from some texts to one row a text. The
    UDF is marked non-deterministic, so that Spark evaluates it once a row also where several
    filters and columns use its result.
    """
    fields = [part.strip() for part in schema.split(";")]
    names = [field.split()[0] for field in fields]

    @F.pandas_udf(", ".join(fields))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        work = make()
        for batch in batches:
            for texts in in_parts(batch):
                yield pd.DataFrame(list(work(texts)), columns=names)

    return run.asNondeterministic()
