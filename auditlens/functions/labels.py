"""Label cells: coercion to a class id and choice of the label column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlens import constants as K

# A class id, optionally written as a code, at the start of a text cell.
CODE_PATTERN = r"(?iU)^\s*c?\s*([0-4])\b"


def coerce_text(cell: Column) -> Column:
    return F.regexp_extract(cell, CODE_PATTERN, 1).try_cast("int")


def coerce_number(cell: Column) -> Column:
    rounded = F.rint(cell.cast("double"))
    return F.when(rounded.between(0, 4), rounded.cast("int"))


def coerce_label(cell: Column, data_type: T.DataType) -> Column:
    """The class id a cell of this type stands for, else null. Booleans never do."""
    if isinstance(data_type, T.StringType):
        return coerce_text(cell)
    if isinstance(data_type, T.NumericType):
        return coerce_number(cell)
    return F.lit(None).cast("int")


def coerce_variant(cell: Column) -> Column:
    """The same for a cell whose type differs from row to row."""
    kind = F.schema_of_variant(cell)
    number = F.try_variant_get(cell, "$", "double")
    return (
        F.when(kind == "STRING", coerce_text(F.try_variant_get(cell, "$", "string")))
        .when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), coerce_number(number))
    )


def with_label(
    df: DataFrame, keys: tuple[str, ...] = K.LABEL_KEYS, label: str = "label"
) -> DataFrame:
    """Adds label and label_key from the first key that has a usable cell.

    The label columns themselves are dropped, so nothing downstream can see them.
    """
    present = [k for k in keys if k in df.columns]
    cells = {k: coerce_label(F.col(f"`{k}`"), df.schema[k].dataType) for k in present}
    null = F.lit(None)
    value = F.coalesce(*cells.values(), null.cast("int"))
    used = F.coalesce(
        *[F.when(c.isNotNull(), F.lit(k)) for k, c in cells.items()], null.cast("string")
    )
    return (
        df.withColumns({"_label": value, "_label_key": used})
        .drop(*present)
        .withColumnsRenamed({"_label": label, "_label_key": "label_key"})
    )


def with_variant_label(
    df: DataFrame, event: str = "event", keys: tuple[str, ...] = K.LABEL_KEYS
) -> DataFrame:
    """The same for events held as a variant, where a cell's type differs from row to row."""
    cells = {
        k: coerce_variant(F.try_variant_get(F.col(event), f"$.{k}", "variant")) for k in keys
    }
    used = F.coalesce(*[F.when(c.isNotNull(), F.lit(k)) for k, c in cells.items()])
    return df.withColumns({"label": F.coalesce(*cells.values()), "label_key": used})
