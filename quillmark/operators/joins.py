"""Joins by time: the last row before a moment, and overlapping periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, bucket_days: int = 1, prefix: str = "last_") -> DataFrame:
    """``left`` with the columns of the last row of ``right`` of the same key at or before its time, named with ``prefix``; nulls where there is none.

    Of rows of one key and time in ``right`` the greatest by its other columns is taken.
    Rows without a key or a time match nothing. Both sides are laid in one order by time and
    the last right row is carried on; no pairs are made. A key's rows are dealt out by
    ``bucket_days`` of time, and what comes into a bucket is carried over from a table of one
    row a bucket, so that a key with very many rows is sorted in parts.
    """
    values = [c for c in right.columns if c not in on]
    none = F.lit(None)

    def start(time: str) -> Column:
        return F.floor(F.unix_date(F.col(time).cast("date")) / bucket_days)

    a = left.withColumn("__left", F.struct(*left.columns)).select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(on)], F.col(left_time).alias("__t"), "__left")
    b = right.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(on)], F.col(right_time).alias("__t"), F.struct(right_time, *[c for c in values if c != right_time]).alias("__right"))
    keys = [f"__k{i}" for i in range(len(on))]
    usable = F.col("__t").isNotNull()
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    a = a.withColumn("__usable", usable).withColumn("__b", F.when(F.col("__usable"), start("__t")))
    b = b.where(usable).withColumn("__b", start("__t"))
    both = a.select(*keys, "__t", "__b", "__left", none.cast(b.schema["__right"].dataType).alias("__right"), "__usable")
    both = both.unionByName(b.select(*keys, "__t", "__b", none.cast(a.schema["__left"].dataType).alias("__left"), "__right", F.lit(True).alias("__usable")))
    # rows without key or time get a partition of their own each, so that they meet nowhere
    apart = F.when(~F.col("__usable"), F.monotonically_increasing_id())
    both = both.withColumn("__apart", apart)
    order = Window.partitionBy(*keys, "__b", "__apart").orderBy("__t", F.col("__left").isNotNull(), "__right").rowsBetween(Window.unboundedPreceding, 0)
    within = both.withColumn("__own", F.last("__right", ignorenulls=True).over(order)).where("__left IS NOT NULL")
    # one row a bucket: its last right row, carried on to the buckets after it
    last = b.groupBy(*keys, "__b").agg(F.max("__right").alias("__last"))
    wanted = a.where("__usable").select(*keys, "__b").distinct().withColumn("__last", none.cast(b.schema["__right"].dataType)).withColumn("__ask", F.lit(True))
    steps = last.withColumn("__ask", F.lit(False)).unionByName(wanted).groupBy(*keys, "__b").agg(F.max("__last").alias("__last"), F.max("__ask").alias("__ask"))
    earlier = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = steps.withColumn("__before", F.last("__last", ignorenulls=True).over(earlier)).where("__ask AND __before IS NOT NULL").select(*keys, "__b", "__before")
    out = within.join(carried, [*keys, "__b"], "left")
    found = F.when(F.col("__usable"), F.coalesce("__own", "__before"))
    return out.select("__left.*", *[found[c].alias(f"{prefix}{c}") for c in values])


def overlapping(left: DataFrame, right: DataFrame, on: Sequence[str], left_period: tuple[str, str], right_period: tuple[str, str], base: int = 3600, levels: int = 24) -> DataFrame:
    """Pairs of rows with equal keys whose periods (start, end), both ends within, overlap; the columns of both sides, those of ``right`` that clash prefixed ``right_``.

    Periods are laid into bins: one of length n goes to the level whose bins of
    ``base`` * 2^level seconds are at least as long, and so into two bins at most; of two
    periods the shorter one is looked for in the bins of the longer one's level. So a row
    is repeated at most twice for each level in use on the other side, however long it is,
    and the join is on equal bins. A pair that shares two bins is reported in the bin in
    which its overlap begins. Periods with a null or reversed end, and null keys, overlap nothing.
    """
    clash = {c: f"right_{c}" if c in left.columns and c not in on else c for c in right.columns}

    def laid(df: DataFrame, period: tuple[str, str], names: dict[str, str], side: str) -> DataFrame:
        kept = F.struct(*[F.col(c).alias(names[c]) for c in df.columns])
        begin, end = (F.unix_micros(F.col(c).cast("timestamp")) for c in period)
        rows = df.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(on)], kept.alias(side), begin.alias("__s"), end.alias("__e")).where("__s <= __e")
        size = F.greatest((F.col("__e") - F.col("__s")) / (base * 1_000_000), F.lit(1.0))
        return rows.withColumn("__own", F.least(F.ceil(F.log2(size)), F.lit(levels)).cast("int"))

    a, b = laid(left, left_period, {c: c for c in left.columns}, "__l"), laid(right, right_period, clash, "__r")
    used = {r[0] for r in a.select("__own").distinct().unionByName(b.select("__own").distinct()).distinct().collect()}  # levels + 1 at most
    keys = [f"__k{i}" for i in range(len(on))]

    def binned(rows: DataFrame, side: str, s: str, e: str) -> DataFrame:
        rows = rows.withColumn("__level", F.explode(F.filter(F.array(*map(F.lit, sorted(used))), lambda x: x >= F.col("__own"))))
        width = F.lit(base * 1_000_000) * F.pow(F.lit(2.0), F.col("__level")).cast("long")
        rows = rows.withColumn("__w", width)
        bins = F.sequence(F.floor(F.col("__s") / F.col("__w")), F.floor(F.col("__e") / F.col("__w")))
        return rows.withColumn("__bin", F.explode(bins)).select(*keys, side, F.col("__s").alias(s), F.col("__e").alias(e), F.col("__own").alias(f"{side}_own"), "__level", "__bin", F.col("__w").alias(f"{side}_w"))

    if not used:
        used = {0}
    pairs = binned(a, "__l", "__ls", "__le").join(binned(b, "__r", "__rs", "__re"), [*keys, "__level", "__bin"])
    at = F.greatest("__ls", "__rs")
    pairs = pairs.where((F.col("__level") == F.greatest("__l_own", "__r_own")) & (F.col("__ls") <= F.col("__re")) & (F.col("__rs") <= F.col("__le")) & (F.floor(at / F.col("__l_w")) == F.col("__bin")))
    return pairs.select("__l.*", *[F.col("__r")[clash[c]].alias(clash[c]) for c in right.columns if c not in on])
