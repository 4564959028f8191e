"""Class weights, minority top-up and feature noise."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlens import constants as K
from auditlens.functions.features import with_features
from auditlens.session import materialise


def class_weights(df: DataFrame, label: str = "label", alpha: float = K.SERVED_ALPHA) -> DataFrame:
    """(N / (K * n_c)) ** alpha per class, divided by the smallest; 1 for alpha <= 0.

    The window runs over one row per class.
    """
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    everything = Window.partitionBy(F.lit(0))
    raw = F.pow(F.sum("n").over(everything) / (F.count("*").over(everything) * F.col("n")),
                F.lit(float(max(alpha, 0.0))))
    return counts.withColumn("_raw", raw).select(
        label, "n", (F.col("_raw") / F.min("_raw").over(everything)).alias("weight")
    )


def with_sample_weight(
    df: DataFrame, label: str = "label", alpha: float = K.SERVED_ALPHA
) -> DataFrame:
    """Adds `weight` by a lookup of the fitted class weights, one number per class."""
    if alpha <= 0:
        return df.withColumn("weight", F.lit(1.0))
    fitted = {r[label]: r.weight for r in class_weights(df, label, alpha).collect()}
    case = reduce(
        lambda c, kv: F.when(F.col(label) == kv[0], kv[1]).otherwise(c), fitted.items(), F.lit(1.0)
    )
    return df.withColumn("weight", case)


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) worked out of the parts, the same on every retry."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    digest = F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))
    # 52 bits, so that any row of any class can be drawn
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def _draw(options: tuple[tuple, ...], u: Column, field: int) -> Column:
    """Pick options[i][field], where the last entry of an option is its weight."""
    total = sum(o[-1] for o in options)
    case, reached = None, 0.0
    for option in options[:-1]:
        reached += option[-1]
        hit = u < F.lit(reached / total)
        value = F.lit(option[field])
        case = F.when(hit, value) if case is None else case.when(hit, value)
    last = F.lit(options[-1][field])
    return last if case is None else case.otherwise(last)


def _by_class(build) -> Column:
    case = None
    for c in K.AUGMENT_CLASSES:
        hit = F.col("label") == c
        case = F.when(hit, build(c)) if case is None else case.when(hit, build(c))
    return case


#: What is drawn for a minted event.
DRAWS = ("event", "identity", "ip", "code", "denied", "day", "hour", "minute")

#: Slots of a class that one task makes.
SLOTS_A_TASK = 250_000


def mint_events(slots: DataFrame, seed: int = 1234) -> DataFrame:
    """Audit events for (label, n) slots of the thin classes.

    Only fields that real events carry are set. Times are weekday business
    hours, so that no artificial off-hours signal is made up.
    """
    # A draw is a hash, worked out once a slot and not at every option it is compared with.
    drawn = slots.select(
        "label",
        "n",
        *[uniform(seed, F.col("label"), F.col("n"), d).alias(f"_u_{d}") for d in DRAWS],
    )

    def u(name: str) -> Column:
        return F.col(f"_u_{name}")

    def error(c: int) -> Column:
        rate, codes = K.MINT_ERRORS[c]
        if not codes:
            return F.lit(None).cast("string")
        code = F.element_at(
            F.array(*[F.lit(x) for x in codes]),
            (F.floor(u("code") * len(codes)) + 1).cast("int"),
        )
        return F.when(u("denied") < rate, code)

    day = (F.floor(u("day") * 5) + 10).cast("string")
    hour = F.lpad((F.floor(u("hour") * 9) + 9).cast("string"), 2, "0")
    minute = F.lpad(F.floor(u("minute") * 60).cast("string"), 2, "0")
    return drawn.select(
        "label",
        "n",
        F.concat(F.lit("2023-07-"), day, F.lit("T"), hour, F.lit(":"), minute, F.lit(":00Z")).alias(
            "eventTime"
        ),
        _by_class(lambda c: _draw(K.MINT_EVENTS[c], u("event"), 0)).alias("eventName"),
        _by_class(lambda c: _draw(K.MINT_EVENTS[c], u("event"), 1)).alias("eventSource"),
        F.concat(F.lit("203.0.113."), (F.floor(u("ip") * 253) + 1).cast("string")).alias(
            "sourceIPAddress"
        ),
        F.lit(K.MINT_USER_AGENT).alias("userAgent"),
        F.struct(
            _by_class(lambda c: _draw(K.MINT_IDENTITIES[c], u("identity"), 0)).alias("type"),
            F.lit(K.MINT_ACCOUNT).alias("accountId"),
            F.lit("false").alias("mfaAuthenticated"),
        ).alias("userIdentity"),
        F.lit(K.MINT_ACCOUNT).alias("recipientAccountId"),
        _by_class(error).alias("errorCode"),
    ).withColumn("event_time", F.col("eventTime").try_cast("timestamp_ntz"))


def top_up_slots(train: DataFrame, target: int = K.AUGMENT_TARGET) -> DataFrame:
    """One (label, n) row per missing row of a thin class that the data has.

    The slots come from a range in as many tasks as the target asks for, and stay there: what
    they are joined with is one row a class, which goes to them.
    """
    present = (
        train.filter(F.col("label").isin(*K.AUGMENT_CLASSES))
        .groupBy("label")
        .agg(F.count("*").alias("have"))
        .filter(F.col("have") < target)
    )
    spark = train.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-target // SLOTS_A_TASK))
    wanted = (
        spark.range(0, target, 1, tasks)
        .withColumnRenamed("id", "n")
        .withColumn("label", F.explode(F.array(*[F.lit(c) for c in K.AUGMENT_CLASSES])))
    )
    return wanted.join(F.broadcast(present), "label").filter(F.col("n") < target - F.col("have")).select(
        "label", "n"
    )


def top_up(
    train: DataFrame, target: int = K.AUGMENT_TARGET, seed: int = 1234
) -> DataFrame:
    """Training rows plus minted rows; train has label and the 32 features.

    Only for the training part of a split: the test part must stay as it is.
    """
    minted = with_features(mint_events(top_up_slots(train, target), seed))
    columns = ["label", *K.FEATURES]
    return (
        train.select(*columns, F.lit(False).alias("minted"))
        .unionByName(minted.select(*columns, F.lit(True).alias("minted")))
    )


def missing(counts: dict[int, int], target: int = K.AUGMENT_TARGET) -> dict[int, int]:
    """By thin class that there are rows of, how many rows are missing to the target."""
    return {
        c: target - counts[c] for c in K.AUGMENT_CLASSES if 0 < counts.get(c, 0) < target
    }


def top_up_folds(
    rows: DataFrame,
    missing: list[dict[int, int]],
    columns: list[str],
    mark: Callable[[Column], Column],
    seed: int = 1234,
) -> DataFrame:
    """Rows of all folds plus what `top_up` mints for any training part, each slot once.

    rows: columns, label and fold. missing: by fold left out, the rows missing of a class. A
    minted row's fold is mark(folds), where folds has a bit for every training part it is in.
    """
    most = {c: max(m.get(c, 0) for m in missing) for c in K.AUGMENT_CLASSES}
    most = {c: n for c, n in most.items() if n}
    if not most:
        return rows.select(*columns, "label", "fold")
    spark = rows.sparkSession
    target = max(most.values())
    tasks = max(spark.sparkContext.defaultParallelism, -(-target // SLOTS_A_TASK))

    def below(wanted: dict[int, int]) -> Column:
        """Whether a slot is one of its class's first."""
        hits = [(F.col("label") == c) & (F.col("n") < n) for c, n in wanted.items() if n]
        return reduce(lambda a, b: a | b, hits, F.lit(False))

    slots = (
        spark.range(0, target, 1, tasks)
        .withColumnRenamed("id", "n")
        .withColumn("label", F.explode(F.array(*[F.lit(c) for c in most])))
        .filter(below(most))
    )
    folds = sum(
        (F.when(below(m), F.lit(1 << i)).otherwise(F.lit(0)) for i, m in enumerate(missing)),
        F.lit(0),
    )
    minted = with_features(mint_events(slots, seed)).withColumn("fold", mark(folds))
    # minted once, however often the rows are read
    kept = materialise(minted.select(*columns, "label", "fold"), "minted")
    return rows.select(*columns, "label", "fold").unionByName(kept)


def with_noise(
    df: DataFrame, columns: list[str], id_col: str, scale: float = 0.25, seed: int = 42
) -> DataFrame:
    """Adds normal noise by the Box-Muller rule, the same on every retry."""

    def unit(name: str, part: int) -> Column:
        return F.lit(1.0) - uniform(seed, F.col(id_col), name, part)  # in (0, 1]

    def normal(name: str) -> Column:
        return F.sqrt(-2.0 * F.log(unit(name, 0))) * F.cos(2.0 * F.pi() * unit(name, 1))

    return df.withColumns({c: F.col(c) + scale * normal(c) for c in columns})
