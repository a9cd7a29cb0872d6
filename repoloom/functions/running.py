"""Running totals that do not put a whole group into one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from repoloom.runtime import stage


def _same(keys: list[str]) -> Column:
    """Equality of ``keys`` between sides l and r, in which nulls are a value like others."""
    same = [F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in keys if k != "_slice"]
    if "_slice" in keys:  # never null
        same.append(F.col("l._slice") == F.col("r._slice"))
    return reduce(Column.__and__, same)


def running_totals(
    df: DataFrame, group: list[str], order: list[str], totals: dict[str, Column]
) -> DataFrame:
    """Add, per name in ``totals``, the sum over the rows *before* this one.

    Rows are range-partitioned on ``group + order`` and written once, so that
    a group of any size is spread over slices. Groups that cross slices get
    the sum of their earlier slices as an offset. At most one group crosses a
    slice border, so the offset table has fewer than two rows per slice
    whatever the data; that bound is what allows broadcasting it.
    """
    names = list(totals)
    inputs = [c.alias(f"_in_{n}") for n, c in totals.items()]
    ranged = df.select("*", *inputs).repartitionByRange(*[F.col(c) for c in group + order])
    ranged, _ = stage(ranged.withColumn("_slice", F.spark_partition_id()), "ranged")

    per_slice = ranged.groupBy(*group, "_slice").agg(*[F.sum(f"_in_{n}").alias(f"_in_{n}") for n in names])
    spread = per_slice.groupBy(*group).agg(F.count("*").alias("_slices"))
    if group:
        crossing = per_slice.alias("l").join(spread.filter("_slices > 1").drop("_slices").alias("r"), _same(group), "left_semi")
    else:
        crossing = per_slice
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = crossing.select(
        *group, "_slice", *[F.sum(f"_in_{n}").over(earlier).alias(f"_off_{n}") for n in names]
    )

    inside = (
        Window.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    local = ranged.select("*", *[F.sum(f"_in_{n}").over(inside).alias(f"_loc_{n}") for n in names])
    out = local.alias("l").join(F.broadcast(offsets).alias("r"), _same([*group, "_slice"]), "left")
    zero = lambda n, p: F.coalesce(F.col(f"{p}{n}"), F.lit(0))
    return out.select(
        *[F.col(f"l.`{c}`") for c in df.columns],
        *[(zero(n, "_off_") + zero(n, "_loc_")).alias(n) for n in names],
    )


def previous_rows(df: DataFrame, group: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Add ``prev``: ``columns`` of the preceding row of the group (null at its start).

    Sliced like :func:`running_totals`; only the last row before each slice
    border travels between slices.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in group + order])
    ranged, _ = stage(ranged.withColumn("_slice", F.spark_partition_id()), "ranged")
    value = F.struct(*columns)
    ends = ranged.groupBy(*group, "_slice").agg(F.max_by(value, F.struct(*order)).alias("_end"))
    spread = ends.groupBy(*group).agg(F.count("*").alias("_slices")).filter("_slices > 1").drop("_slices")
    crossing = ends.alias("l").join(spread.alias("r"), _same(group), "left_semi")
    border = crossing.select(*group, "_slice", F.lag("_end").over(Window.partitionBy(*group).orderBy("_slice")).alias("_border"))
    inside = Window.partitionBy(*group, "_slice").orderBy(*order)
    local = ranged.withColumn("_local", F.lag(value).over(inside))
    joined = local.alias("l").join(F.broadcast(border).alias("r"), _same([*group, "_slice"]), "left")
    return joined.select(*[F.col(f"l.`{c}`") for c in df.columns], F.coalesce("_local", "_border").alias("prev"))


def ranks(df: DataFrame, group: list[str], order: list[str], cap: int | None = None) -> DataFrame:
    """Add ``pos``, the place of each row in its group from 1.

    With ``cap`` only the first rows stay: a window, as Spark cuts each group
    before the shuffle. Without, every row is kept and a group of any size is
    spread over slices. Rows of equal order get their places in any order.
    """
    if cap is not None:
        window = Window.partitionBy(*group).orderBy(*order)
        return df.withColumn("pos", F.row_number().over(window).cast("bigint")).filter(F.col("pos") <= cap)
    return running_totals(df, group, order, {"pos": F.lit(1).cast("bigint")}).withColumn("pos", F.col("pos") + 1)
