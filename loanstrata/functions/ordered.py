"""Order-based results (quantiles, running totals, equal groups) with no task that holds a whole group.

For quantiles and running totals, a window over a whole group, or an array of its values, is used only when a row count
has shown it to fit one task. Beyond that, quantiles are selected between brackets that a sketch gives, and for running totals values are
counted, cut into ordered pieces of a size a task can sort, and the totals of the pieces are added in front. Brackets and cut points only
decide who counts and sorts what; the results do not depend on them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanstrata.session import LOOKUP_ROWS, pin, small_table

TASK_ROWS = 2_000_000
# Most cut points the driver holds at once.
DRIVER_NUMBERS = 4_000_000
# Least accuracy of the sketch that brackets quantiles: its ranks err by one part in so many.
BRACKET_ACCURACY = 10_000


def long_values(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """Wide to long `(keep..., feature, value)`, nulls left out; one narrow pass."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns
    ])
    rows = df.select(*(keep or []), F.explode(pairs).alias("_p"))
    return rows.select(*(keep or []), "_p.feature", "_p.value").where(F.col("value").isNotNull())


def with_piece(df: DataFrame, keys: list[str], value: str, task_rows: int = TASK_ROWS,
               rows: int | None = None) -> tuple[DataFrame, int]:
    """Adds `_piece`, an ordered split of every key group; also returns how many pieces were planned.

    Cut points are one mergeable sketch per group, read to the driver as literals so that every later evaluation
    sees the same ones.
    """
    rows = df.count() if rows is None else rows
    pieces = math.ceil(rows / task_rows)
    if pieces <= 1:
        return df.withColumn("_piece", F.lit(0)), 1
    side = math.ceil(math.sqrt(pieces))
    probs = [i / (side * side) for i in range(1, side * side)]
    cuts = df.groupBy(*keys).agg(F.percentile_approx(value, probs, 20 * side * side).alias("_cuts"))
    held = small_table(cuts, max(1, DRIVER_NUMBERS // (side * side)))
    # With more groups than the driver should hold, the cut points are written instead, and joined by key.
    small = held is not None
    held = held if small else pin(cuts)
    heads = F.array(*[F.get("_cuts", F.lit((i + 1) * side - 1)) for i in range(side - 1)])
    blocks = F.array(*[F.slice("_cuts", i * side + 1, side - 1) for i in range(side)])
    held = held.select(*keys, heads.alias("_heads"), blocks.alias("_blocks"))
    if keys:
        named = held
        for key in keys:
            named = named.withColumnRenamed(key, f"_{key}")
        condition = None
        for key in keys:
            term = df[key].eqNullSafe(named[f"_{key}"])
            condition = term if condition is None else condition & term
        side_table = F.broadcast(named) if small else named
        joined = df.join(side_table, condition).drop(*[f"_{key}" for key in keys])
    else:
        found = held.collect()[0]
        joined = df.withColumns({"_heads": F.lit(list(found["_heads"])), "_blocks": F.array(*[
            F.lit(list(b)) for b in found["_blocks"]])})
    v = F.col(value)
    # Two levels of side - 1 comparisons each: first the block, then the piece within the block.
    block = F.size(F.filter("_heads", lambda c: c <= v))
    fine = F.size(F.filter(F.get("_blocks", block), lambda c: c <= v))
    placed = joined.withColumn("_piece", block * side + fine)
    return placed.drop("_heads", "_blocks"), side * side


def value_totals(df: DataFrame, keys: list[str], value: str, sums: dict[str, Column],
                 task_rows: int = TASK_ROWS, rows: int | None = None) -> DataFrame:
    """One row per distinct value of each group with its sums, and their running totals before the value.

    Adds `<name>` (the sum at the value), `<name>_before` and `<name>_all` for every entry of `sums`. Ties are
    folded before the first shuffle, so a value held by a third of the rows costs one row per task.
    """
    cut, pieces = with_piece(df, keys, value, task_rows, rows)
    counted = cut.groupBy(*keys, "_piece", value).agg(*[c.alias(n) for n, c in sums.items()])
    # Beyond one piece the sums are written, so that making the input is not repeated for the totals of the pieces.
    counted = counted if pieces == 1 else pin(counted)
    inside = Window.partitionBy(*keys, "_piece").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = counted
    for name in sums:
        local = local.withColumn(f"{name}_before", F.coalesce(F.sum(name).over(inside), F.lit(0)))
    if pieces == 1:
        whole = Window.partitionBy(*keys)
        for name in sums:
            local = local.withColumn(f"{name}_all", F.sum(name).over(whole))
        return local.drop("_piece")
    # One row per piece and group, summed from the folded rows: the input itself is not read again.
    totals = counted.groupBy(*keys, "_piece").agg(*[F.sum(n).alias(n) for n in sums])
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = totals.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_piece").alias("_at"), *[
        F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_{n}_off") for n in sums
    ], *[F.sum(n).over(whole).alias(f"{n}_all") for n in sums])
    held = small_table(offsets, LOOKUP_ROWS)
    side = offsets if held is None else F.broadcast(held)
    condition = local["_piece"] == side["_at"]
    for key in keys:
        condition = condition & local[key].eqNullSafe(side[f"_{key}"])
    out = local.join(side, condition)
    for name in sums:
        out = out.withColumn(f"{name}_before", F.col(f"{name}_before") + F.col(f"_{name}_off"))
    return out.drop("_piece", "_at", *[f"_{k}" for k in keys], *[f"_{n}_off" for n in sums])


def quantiles(df: DataFrame, columns: list[str], probs: list[float], by: list[str] | None = None,
              task_rows: int = TASK_ROWS, rows: int | None = None) -> DataFrame:
    """Exact interpolated quantiles: one row per group and column, `q` aligned with `probs`.

    All columns in one job. Null values are left out; a column with no value in a group has no row. `rows` saves the
    count where the caller knows it.
    """
    by = by or []
    rows = df.count() if rows is None else rows
    values = long_values(df, columns, by)
    keys = [*by, "feature"]
    if rows <= task_rows:
        # A column of at most `task_rows` doubles is sorted as one array, several times faster than `percentile`.
        arrays = values.groupBy(*keys).agg(F.sort_array(F.collect_list("value")).alias("_v"))
        spot = lambda at: F.get("_v", at.cast("int"))
        found = []
        for p in probs:
            position = F.lit(float(p)) * (F.size("_v") - 1)
            low = F.floor(position)
            found.append(spot(low) + (position - low) * (spot(F.ceil(position)) - spot(low)))
        return arrays.select(*keys, F.array(*found).alias("q"))
    selected = selected_quantiles(df, columns, probs, by, max(BRACKET_ACCURACY, math.ceil(4 * len(probs) * rows / task_rows)))
    if selected is not None:
        return selected
    ranked = value_totals(values, keys, "value", {"n": F.count(F.lit(1))}, task_rows, rows * len(columns))
    spots = []
    for p in probs:
        position = F.lit(float(p)) * (F.col("n_all") - 1)
        low, high = F.floor(position), F.ceil(position)
        holds = lambda at: (F.col("n_before") <= at) & (at < F.col("n_before") + F.col("n"))
        at_low = F.max(F.when(holds(low), F.col("value")))
        at_high = F.max(F.when(holds(high), F.col("value")))
        share = F.max(position - low)
        spots.append(at_low + share * (at_high - at_low))
    return ranked.groupBy(*keys).agg(F.array(*spots).alias("q"))


def selected_quantiles(df: DataFrame, columns: list[str], probs: list[float], by: list[str], accuracy: int) -> DataFrame | None:
    """Exact quantiles in two passes that shuffle counts, not values; None when there are more groups than the driver should hold.

    One sketch per group and column brackets every quantile. The second pass counts each value inside a bracket, and the
    rows between brackets as a whole with their smallest and largest value; ranks over those counts name the value at a
    position. Also None if a position fell between brackets after all, as a sketch of NaN may let it.
    """
    reach = 2 / accuracy
    ends = [min(max(p + off, 0.0), 1.0) for p in probs for off in (-reach, reach)]
    value = lambda c: F.col(c).cast("double")
    named = [F.col(k).alias(f"_by{i}") for i, k in enumerate(by)]
    sketches = df.groupBy(*named).agg(*[F.percentile_approx(value(c), ends, accuracy).alias(f"_e{i}") for i, c in enumerate(columns)])
    held = small_table(sketches, max(1, min(LOOKUP_ROWS, DRIVER_NUMBERS // (len(ends) * len(columns)))))
    if held is None:
        return None
    groups = [(*[r[f"_by{i}"] for i in range(len(by))], [_brackets(r[f"_e{i}"]) for i in range(len(columns))]) for r in held.collect()]
    pairs = F.array(*[F.struct(F.lit(i).alias("_f"), value(c).alias("_v")) for i, c in enumerate(columns)])
    if by:
        kind = T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))
        side = F.broadcast(df.sparkSession.createDataFrame(groups, T.StructType([*held.schema.fields[:len(by)], T.StructField("_ends", kind)])))
        condition = F.lit(True)
        for i, key in enumerate(by):
            condition = condition & df[key].eqNullSafe(side[f"_by{i}"])
        wide = df.join(side, condition)
    else:
        wide = df.withColumn("_ends", F.array(*[F.array(*[F.lit(e) for e in both]) for both in groups[0][0]]))
    rows = wide.select(*by, "_ends", F.explode(pairs).alias("_p")).where(F.col("_p._v").isNotNull()).select(
        *by, "_p.*", F.get("_ends", F.col("_p._f")).alias("_ends"))
    # Odd zones are inside a bracket. A filter over an array stays small code, however many brackets there are.
    begun = F.size(F.filter(F.get("_ends", F.lit(0)), lambda low: low <= F.col("_v")))
    rows = rows.withColumn("_a", begun).withColumn("_zone", 2 * F.col("_a") - F.coalesce(
        F.col("_v") <= F.get(F.get("_ends", F.lit(1)), F.col("_a") - 1), F.lit(False)).cast("int"))
    keys = [*by, "_f"]
    counted = rows.groupBy(*keys, "_zone", F.when(F.col("_zone") % 2 == 1, F.col("_v")).alias("_at")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    order = Window.partitionBy(*keys).orderBy("_zone", "_at").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.withColumns({"_before": F.coalesce(F.sum("_n").over(order), F.lit(0)),
                                  "_all": F.sum("_n").over(Window.partitionBy(*keys))})
    spots = []
    for p in probs:
        position = F.lit(float(p)) * (F.col("_all") - 1)
        low, high = F.floor(position), F.ceil(position)

        def at(place: Column) -> Column:
            inside = (F.col("_before") <= place) & (place < F.col("_before") + F.col("_n"))
            first = (F.col("_lo") == F.col("_hi")) | (place == F.col("_before"))
            last = place == F.col("_before") + F.col("_n") - 1
            return F.max(F.when(inside & first, F.col("_lo")).when(inside & last, F.col("_hi")))

        spots.append(at(low) + F.max(position - low) * (at(high) - at(low)))
    name = F.get(F.array(*[F.lit(c) for c in columns]), F.col("_f")).alias("feature")
    found = ranked.groupBy(*keys).agg(F.array(*spots).alias("q")).select(*by, name, "q")
    done = found.collect()
    if any(q is None for r in done for q in r["q"]):
        return None
    return df.sparkSession.createDataFrame(done, found.schema)


def _brackets(ends: list[float] | None) -> list[list[float]]:
    """Lower and upper ends of the brackets, overlapping ones as one; a column without values gets one it never uses."""
    lows: list[float] = []
    highs: list[float] = []
    for low, high in zip(ends[::2], ends[1::2]) if ends else [(0.0, 0.0)]:
        if highs and low <= highs[-1]:
            highs[-1] = max(highs[-1], high)
        else:
            lows, highs = [*lows, low], [*highs, high]
    return [lows, highs]


def quantile_values(df: DataFrame, columns: list[str], probs: list[float], task_rows: int = TASK_ROWS,
                    rows: int | None = None) -> dict[str, list[float]]:
    """`quantiles` without groups, read to the driver: columns x probs numbers, for use as literals."""
    return {r["feature"]: list(r["q"]) for r in quantiles(df, columns, probs, None, task_rows, rows).collect()}


def rank_values(values: DataFrame, column: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """Adds `rank`, the 1-based position of every row by a column of distinct values of any sortable type.

    Beyond one task, rows are range-partitioned and written, so that the partition of a row is fixed before its rank
    within the partition and the sizes of the earlier partitions are added up.
    """
    rows = values.count()
    if rows <= task_rows:
        return values.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(column)))
    pieces = math.ceil(rows / task_rows)
    placed = pin(values.repartitionByRange(pieces, column).withColumn("_piece", F.spark_partition_id()))
    sizes = placed.groupBy("_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy().orderBy("_piece").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    # One row per piece.
    offsets = F.broadcast(sizes.select("_piece", before.alias("_off")))
    inside = F.row_number().over(Window.partitionBy("_piece").orderBy(column))
    return placed.join(offsets, "_piece").withColumn("rank", F.col("_off") + inside).drop("_piece", "_off")


def ranked_groups(df: DataFrame, keys: list[str], value: str, tie: str, groups: int = 10,
                  task_rows: int = TASK_ROWS, rows: int | None = None) -> DataFrame:
    """Adds `bucket`, the equal-count group 1..groups of each row by `(value, tie)`, per key group.

    One way for every size: rows are range-partitioned by (keys, value, tie) and written, so that a row's place is fixed
    before its position inside the partition and the sizes of the earlier partitions are added up. The first
    n % groups groups hold one row more. Nulls come first, NaN last; keys, values and ties may have any sortable type.
    `rows` and `task_rows` only set the number of partitions.
    """
    by = [*keys, value, tie]
    held = df.repartitionByRange(math.ceil(rows / task_rows) or 1, *by) if rows is not None else df.repartitionByRange(*by)
    placed = pin(held.withColumn("_piece", F.spark_partition_id()))
    sizes = placed.groupBy(*keys, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row per key group and partition.
    offsets = sizes.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_piece").alias("_at"), before.alias("_off"),
                           F.sum("_n").over(whole).alias("_all"))
    inside = placed.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_piece").orderBy(value, tie)))
    condition = inside["_piece"] == offsets["_at"]
    for key in keys:
        condition = condition & inside[key].eqNullSafe(offsets[f"_{key}"])
    ranked = inside.join(offsets, condition).withColumn("_rank", F.col("_off") + F.col("_r") - 1)
    size, extra = F.floor(F.col("_all") / groups), F.col("_all") % groups
    # The larger groups come first; past them, ranks are counted in groups of the smaller size.
    wide = extra * (size + 1)
    bucket = F.when(F.col("_rank") < wide, F.floor(F.col("_rank") / (size + 1))).otherwise(
        extra + F.floor(F.try_divide(F.col("_rank") - wide, size)))
    return ranked.withColumn("bucket", (bucket + 1).cast("int")).drop(
        "_piece", "_at", "_off", "_all", "_r", "_rank", *[f"_{k}" for k in keys])
