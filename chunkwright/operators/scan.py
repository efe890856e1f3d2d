"""Running values, neighbours, totals and exact quantiles along groups of any size.

A group of up to `most` rows is one window partition. Longer groups (at most rows / `most` of them, so that their keys and
totals may be broadcast) are cut into ranges of their order, which are tasks of their own; what a range needs from the
ranges before it is one row per range. Rows that the order leaves equal go by their other columns, so that results
don't depend on the cut. A null key is a group like any other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, MapType, VariantType

from chunkwright.sources.stores import kept

#: Rows of a group that one task may hold.
MOST = 1 << 20
#: For each kind of running value: the aggregate, and how two neighbouring parts make one.
KINDS: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, lambda a, b: a + b),
    "count": (F.count, lambda a, b: a + b),
    "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
}


def long_groups(rows: DataFrame, group: list[str], most: int = MOST, source: DataFrame | None = None) -> DataFrame | None:
    """Keys of the groups of more than `most` rows; None if there is none.

    `source` may be a table with at least as many rows, which is quick to count: where it is short, nothing else is looked at.
    """
    if source is not None and source.count() <= most:
        return None
    if not group:
        return rows.sparkSession.range(1).select() if rows.count() > most else None
    counted = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > most).drop("_rows")
    return None if counted.isEmpty() else kept(counted)


def matched(rows: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join with a small table whose keys may be null; adds its other columns."""
    if not on:
        return rows.crossJoin(F.broadcast(keys)) if how in ("left", "inner") else rows if how == "left_semi" else rows.limit(0)  # one row
    renamed = keys.select(*[F.col(c).alias(f"_key_{c}") for c in on], *[c for c in keys.columns if c not in on])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in on])
    return rows.join(F.broadcast(renamed), same, how).drop(*[f"_key_{c}" for c in on])


class Ask:
    """Stands for long groups that are not known yet."""


#: What long groups a function is given: their keys, None if there is none, or Ask, to find them (a pass over the rows).
Long = DataFrame | None | type[Ask]


def by_size(rows: DataFrame, group: list[str], whole: Callable[[DataFrame], DataFrame], cut: Callable[[DataFrame], DataFrame], most: int = MOST, long: Long = Ask) -> DataFrame:
    """`whole` of the rows in groups up to `most` rows, `cut` of the others.

    Steps that follow each other on ever fewer rows may share the long groups of the first one.
    """
    long = long_groups(rows, group, most) if long is Ask else long
    if long is None:
        return whole(rows)
    if not group:
        return cut(rows)
    return whole(matched(rows, long, group, "left_anti")).unionByName(cut(matched(rows, long, group, "left_semi")))


def _orderable(kind: DataType) -> bool:
    return not isinstance(kind, MapType | VariantType)


def total_order(rows: DataFrame, group: list[str], order: list[str | Column]) -> list[Column]:
    """The order, then all other columns by name."""
    named = {c for c in order if isinstance(c, str)}
    rest = sorted(f.name for f in rows.schema.fields if f.name not in named and f.name not in group and not f.name.startswith("_range") and _orderable(f.dataType))
    return [F.col(c) if isinstance(c, str) else c for c in order] + [F.col(c) for c in rest]


def ranged(rows: DataFrame, group: list[str], order: list[str | Column], per: int = MOST, unique: bool = False) -> DataFrame:
    """The rows with `_range`: ranges of (group, order) of about `per` rows each, numbered in that order.

    The table is written once, as bounds are drawn from a sample and must not be drawn again.
    """
    n = max(1, -(-rows.count() // per))
    dealt = rows.repartitionByRange(n, *[F.col(c) for c in group], *(order if unique else total_order(rows, group, order)))
    return kept(dealt.withColumn("_range", F.spark_partition_id()))


def running(rows: DataFrame, group: list[str], order: list[str | Column], values: dict[str, tuple[Column, str]], before: bool = False, most: int = MOST, long: Long = Ask, unique: bool = False) -> DataFrame:
    """Adds running values {name: (column, kind)} along each group, up to each row or (`before`) up to the row ahead of it.

    A value of no rows, or of nulls alone, is null (a count 0). `unique`: the order leaves no rows equal for which it matters.
    """
    frame = (Window.unboundedPreceding, -1 if before else 0)

    def along(table: DataFrame, keys: list[str]) -> dict[str, Column]:
        w = Window.partitionBy(*keys).orderBy(*(order if unique else total_order(table, keys, order))).rowsBetween(*frame)
        return {name: KINDS[kind][0](col).over(w) for name, (col, kind) in values.items()}

    def whole(table: DataFrame) -> DataFrame:
        return table.withColumns(along(table, group))

    def cut(table: DataFrame) -> DataFrame:
        part = ranged(table, group, order, most, unique)
        sums = part.groupBy(*group, "_range").agg(*[KINDS[kind][0](col).alias(f"_part_{name}") for name, (col, kind) in values.items()])
        earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        folded = {"sum": F.sum, "count": F.sum, "xor": F.bit_xor, "max": F.max}
        carry = kept(sums.select(*group, "_range", *[folded[kind](f"_part_{name}").over(earlier).alias(f"_carry_{name}") for name, (_, kind) in values.items()]))
        local = part.withColumns(along(part, [*group, "_range"]))
        met = matched(local, carry, [*group, "_range"], "left")
        joined = {name: F.coalesce(KINDS[kind][1](F.col(name), F.col(f"_carry_{name}")), F.col(name), F.col(f"_carry_{name}")) for name, (_, kind) in values.items()}
        return met.withColumns(joined).drop("_range", *[f"_carry_{name}" for name in values])

    return by_size(rows, group, whole, cut, most, long)


def shifted(rows: DataFrame, group: list[str], order: list[str | Column], values: dict[str, tuple[str, int, object]], most: int = MOST, long: Long = Ask) -> DataFrame:
    """Adds {name: (column, -1 or 1, default)}: the value of the row before or after along each group, the default where there is none."""

    def along(table: DataFrame, keys: list[str], defaults: bool) -> dict[str, Column]:
        w = Window.partitionBy(*keys).orderBy(*total_order(table, keys, order))
        return {name: (F.lag if side < 0 else F.lead)(col, 1, default if defaults else None).over(w) for name, (col, side, default) in values.items()}

    def whole(table: DataFrame) -> DataFrame:
        return table.withColumns(along(table, group, True))

    def cut(table: DataFrame) -> DataFrame:
        part = ranged(table, group, order, most)
        keys = [*group, "_range"]
        w = Window.partitionBy(*keys).orderBy(*total_order(part, keys, order))
        marks = {"_head": F.lag(F.lit(1)).over(w).isNull(), "_tail": F.lead(F.lit(1)).over(w).isNull()}
        local = part.withColumns(along(part, keys, False) | marks)
        ends = local.groupBy(*keys).agg(*[F.max(F.when(F.col("_tail" if side < 0 else "_head"), F.struct(F.col(col).alias("v")))).alias(f"_edge_{name}") for name, (col, side, _) in values.items()])
        chain = Window.partitionBy(*group).orderBy("_range")
        halo = kept(ends.select(*keys, *[(F.lag if side < 0 else F.lead)(f"_edge_{name}").over(chain).alias(f"_halo_{name}") for name, (_, side, _) in values.items()]))
        met = matched(local, halo, keys, "left")
        out = {}
        for name, (_, side, default) in values.items():
            there = F.col(f"_halo_{name}")
            out[name] = F.when(F.col("_head" if side < 0 else "_tail"), F.when(there.isNotNull(), there["v"]).otherwise(F.lit(default))).otherwise(F.col(name))
        return met.withColumns(out).drop("_range", "_head", "_tail", *[f"_halo_{name}" for name in values])

    return by_size(rows, group, whole, cut, most, long)


def with_totals(rows: DataFrame, group: list[str], totals: dict[str, Column], most: int = MOST, long: Long = Ask) -> DataFrame:
    """Adds aggregates (plain ones, nothing around them) of each group to its rows: by a window, or for long groups by their aggregated row, which is broadcast."""

    def whole(table: DataFrame) -> DataFrame:
        w = Window.partitionBy(*group)
        return table.withColumns({name: col.over(w) for name, col in totals.items()})

    def cut(table: DataFrame) -> DataFrame:
        found = table.groupBy(*group).agg(*[col.alias(name) for name, col in totals.items()])
        return matched(table, kept(found), group, "inner")

    return by_size(rows, group, whole, cut, most, long)


def place_of(share: float, n: Column) -> Column:
    """The place (from 1) of the least element that has at least this share of n elements at or below it."""
    return F.greatest(F.lit(1).cast("bigint"), n - F.floor(n - F.lit(share) * n))


def at_places(rows: DataFrame, group: list[str], value: str, places: dict[str, Callable[[Column], Column]], most: int = MOST, splits: int = 32, long: Long = Ask) -> DataFrame:
    """One row per group: {name: the element at a place in ascending order} and `n`, the count that the places are functions of.

    Exact at any size. Each round narrows every long group's search: sketched cut points, which are elements, are
    counted exactly (rows below each and equal to each, added up before they are shuffled), and what lies between the two around
    the wanted place goes on. A search of at most `most` rows ends in one sort. Nulls don't count; a group of nulls alone gives nulls.
    """
    rows = rows.select(*group, F.col(value).alias("_v"))

    def whole(table: DataFrame) -> DataFrame:
        w = Window.partitionBy(*group)
        ranked = table.withColumns({"_n": F.count("_v").over(w), "_i": F.row_number().over(w.orderBy(F.col("_v").asc_nulls_last()))})
        found = [F.max(F.when(F.col("_i") == place(F.col("_n")), F.col("_v"))).alias(name) for name, place in places.items()]
        return ranked.groupBy(*group).agg(*found, F.count("_v").alias("n"))

    def cut(table: DataFrame) -> DataFrame:
        table = kept(table)
        counts = kept(table.groupBy(*group).agg(F.count("_v").alias("_n")))
        one = [counts.where("_n > 0").select(*group, F.lit(name).alias("_name"), place(F.col("_n")).alias("_place"), F.col("_n").alias("_open")) for name, place in places.items()]
        kind = table.schema["_v"].dataType
        # a search: the place that is wanted among the elements strictly between two bounds (null: no bound)
        search = kept(reduce(DataFrame.unionByName, one).withColumns({"_lo": F.lit(None).cast(kind), "_hi": F.lit(None).cast(kind)}))
        done = []
        within = (F.col("_lo").isNull() | (F.col("_v") > F.col("_lo"))) & (F.col("_hi").isNull() | (F.col("_v") < F.col("_hi")))
        keys = [*group, "_name"]
        while not (wide := search.where(F.col("_open") > most)).isEmpty():
            met = matched(table.where("_v is not null"), wide, group, "inner").where(within)
            shares = [(k + 1) / (splits + 1) for k in range(splits)]
            cuts = kept(met.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("_v", shares, 100 * splits)).alias("_cuts")))
            state = kept(matched(wide, cuts, keys, "inner"))
            met = matched(table.where("_v is not null"), state, group, "inner").where(within)
            below = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
            step = (2 * below + F.coalesce((F.get("_cuts", below) == F.col("_v")).cast("int"), F.lit(0))).alias("_step")
            tally = met.groupBy(*keys, step).agg(F.count(F.lit(1)).alias("_m"))
            order = Window.partitionBy(*keys).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
            tally = tally.withColumn("_under", F.coalesce(F.sum("_m").over(order), F.lit(0)))
            hit = matched(tally, state, keys, "inner").where("_place > _under and _place <= _under + _m")
            own = F.floor(F.col("_step") / 2).cast("int")
            hit = kept(hit.withColumns({"_at": F.get("_cuts", own), "_prev": F.get("_cuts", F.when(own > 0, own - 1)), "_exact": F.col("_step") % 2 == 1}))
            done.append(hit.where("_exact").select(*keys, F.col("_at").alias("_v")))
            narrower = hit.where("not _exact").select(*keys, (F.col("_place") - F.col("_under")).alias("_place"), F.col("_m").alias("_open"), F.coalesce("_prev", "_lo").alias("_lo"), F.coalesce("_at", "_hi").alias("_hi"))
            search = kept(search.where(F.col("_open") <= most).unionByName(narrower))
        left = matched(table.where("_v is not null"), search, group, "inner").where(within)
        ranked = left.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy("_v")))
        done.append(ranked.where("_i = _place").select(*keys, "_v"))
        found = reduce(DataFrame.unionByName, done)
        out = kept(found.groupBy(*group).agg(*[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in places]))
        return matched(counts.withColumnRenamed("_n", "n"), out, group, "left").select(*group, *places, "n")

    return by_size(rows, group, whole, cut, most, long)


def quantile(rows: DataFrame, group: list[str], value: str, share: float, name: str = "edge", most: int = MOST, long: Long = Ask) -> DataFrame:
    """One row per group: the exact quantile of a value, between two elements in proportion."""
    at = lambda n: F.lit(share) * (n - 1)

    def whole(table: DataFrame) -> DataFrame:
        return table.groupBy(*group).agg(F.percentile(value, share).alias(name))

    def cut(table: DataFrame) -> DataFrame:
        found = at_places(table, group, value, {"_low": lambda n: F.floor(at(n)) + 1, "_high": lambda n: F.ceil(at(n)) + 1}, most)
        part = at(F.col("n")) - F.floor(at(F.col("n")))
        return found.select(*group, (F.col("_low") + (F.col("_high") - F.col("_low")) * part).alias(name))

    return by_size(rows, group, whole, cut, most, long)
