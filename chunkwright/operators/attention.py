"""Hybrid temporal attention: TF-IDF blended with banded and anchored similarity along time, per group."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from chunkwright.functions.scalar import clamp, dot, l2_normalise, min_max
from chunkwright.operators import scan
from chunkwright.operators.temporal import intro_ramp

TAU, BAND = 45.0, 90.0
#: Dimensions that are summed side by side; longer vectors take several such blocks.
WIDE = 8
#: Rows of a span of time that is one group of the grouped map.
PER_CELL = 4096


def _sums_in_reach(cells: DataFrame, tau: float, band: float, wide: int, most: int) -> DataFrame:
    """(_g, _t, _k, _sum): for each time the sums over the band around it, from (_g, _t, _k, _s0, _s1, ...): vector sums of single times.

    The decay exp(-|a - b| / tau) is a product of a factor of either end, so that a sum over a window is a difference of running sums. Those run
    within buckets as wide as the band, with factors about the bucket's origin, which keeps them small: a time needs its own bucket, the
    end of the bucket before (from t - band on) and the beginning of the bucket after (up to t + band). It asks them by rows that are sorted in
    among theirs.
    """
    own = F.floor(F.col("_t") / band).cast("bigint")
    zero = {f"_s{i}": F.lit(0.0) for i in range(wide)}
    # _kind: 0 stands before rows of its time, 2 after them
    asked = [
        cells.withColumns(zero | {"_b": own - 1, "_at": F.col("_t") - band, "_kind": F.lit(0)}),
        cells.withColumns({"_b": own, "_at": F.col("_t"), "_kind": F.lit(1)}),
        cells.withColumns(zero | {"_b": own + 1, "_at": F.col("_t") + band, "_kind": F.lit(2)}),
    ]
    events = asked[0].unionByName(asked[1]).unionByName(asked[2]).withColumn("_x", (F.col("_t") - F.col("_b") * band) / tau)
    terms = {f"_{name}{i}": F.expr(f"_s{i} * exp({sign}_x)") for i in range(wide) for name, sign in (("up", ""), ("down", "-"))}
    keys = ["_g", "_b", "_k"]
    long = scan.long_groups(events.select(*keys), keys, most)
    sums = scan.with_totals(events, keys, {f"_all{n}": F.sum(col) for n, col in terms.items()}, most, long)
    sums = scan.running(sums, keys, ["_at", "_kind"], {n: (col, "sum") for n, col in terms.items()}, most=most, long=long, unique=True)
    # before the time: from its own bucket what has run up to it, from the one before what is left; after it the other way round
    before = "CASE _kind WHEN 1 THEN _up{0} WHEN 0 THEN _all_up{0} - _up{0} ELSE 0D END"
    after = "CASE _kind WHEN 1 THEN _all_down{0} - _down{0} WHEN 2 THEN _down{0} ELSE 0D END"
    parts = sums.selectExpr("_g", "_t", "_k", *[f"exp(-_x) * {before} + exp(_x) * {after} AS _s{{0}}".format(i) for i in range(wide)])
    return parts.groupBy("_g", "_t", "_k").agg(F.array(*[F.sum(f"_s{i}") for i in range(wide)]).alias("_sum"))


def band_attention(rows: DataFrame, group: str, t: str, features: str, tau: float = TAU, band: float = BAND, most: int = scan.MOST) -> DataFrame:
    """Adds `local`: summed cosine with the rows at most `band` away (itself included), decayed by distance.

    No row meets another one: unit vectors are summed for each time, and those sums along the band (see `_sums_in_reach`), so that work and shuffles are in
    proportion to rows and dimensions however many rows share a time or a band. A bucket of more than `most` different times is cut.

    Rows with a null group, time or feature array meet nothing, themselves neither, and are left out; shorter arrays, nulls and NaN in them count as
    zeros. A band of over 300 tau is refused, as its factors leave the range of numbers.
    """
    if band > 300 * tau:
        raise ValueError("a band of over 300 tau")
    good = rows.where(F.col(group).isNotNull() & F.col(t).isNotNull() & F.col(features).isNotNull())
    size = good.agg(F.max(F.size(features))).first()[0] or 0
    wide = max(1, min(size, WIDE))
    blocks = max(1, -(-size // wide))
    unit = l2_normalise(F.transform(features, lambda x: F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0))))
    filled = F.concat(unit, F.array_repeat(F.lit(0.0), wide * blocks))
    cut = good.select(F.col(group).alias("_g"), F.col(t).alias("_t"), filled.alias("_u"))
    cut = cut.select("_g", "_t", F.posexplode(F.transform(F.array(*map(F.lit, range(blocks))), lambda k: F.slice("_u", k * wide + 1, wide))).alias("_k", "_part"))
    cells = scan.kept(cut.groupBy("_g", "_t", "_k").agg(*[F.sum(F.get("_part", F.lit(i))).alias(f"_s{i}") for i in range(wide)]))
    near = _sums_in_reach(cells, tau, band, wide, most)
    near = scan.kept(near.groupBy("_g", "_t").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_sum"))), lambda p: p["_sum"])).alias("_near")))  # one entry a block
    # both sides are plain tables, so that a time with very many rows is split
    met = good.join(near, (F.col(group) == F.col("_g")) & (F.col(t) == F.col("_t")))
    return met.select(*rows.columns, dot(filled, F.slice(F.concat("_near", F.array_repeat(F.lit(0.0), wide * blocks)), 1, F.size(filled))).alias("local"))


def band_of(when: np.ndarray, x: np.ndarray, own: np.ndarray, tau: float, band: float, tile: int = 512) -> np.ndarray:
    """Summed, decayed products of the `own` rows with the rows at most `band` away; times ascend. Tiles of `tile` by 8 * `tile` products are held at once."""
    out = np.zeros(len(own))
    for i in range(0, len(own), tile):
        mine = own[i : i + tile]
        low, high = np.searchsorted(when, when[mine[0]] - 1.001 * band), np.searchsorted(when, when[mine[-1]] + 1.001 * band, "right")
        for j in range(low, high, 8 * tile):
            near = slice(j, min(high, j + 8 * tile))
            apart = np.abs(when[mine][:, None] - when[near][None, :])
            out[i : i + tile] += np.where(apart <= band, (x[mine] @ x[near].T) * np.exp(-apart / tau), 0).sum(1)
    return out


def band_in_groups(rows: DataFrame, group: str, t: str, features: str, tau: float = TAU, band: float = BAND, most: int = scan.MOST, per: int = PER_CELL) -> DataFrame:
    """The same as `band_attention` as a grouped map: a group of the map is a span of a group's time with about `per` rows and the rows within the band around it.

    Spans are as wide as the band at least, so that a row goes to its own and at most two others. Where times are so dense that a span has over 16 * `per` rows
    its sums are those of `band_attention`, so that no task holds more.
    """
    good = rows.where(F.col(group).isNotNull() & F.col(t).isNotNull() & F.col(features).isNotNull())
    known = scan.with_totals(good, [group], {"_t0": F.min(t), "_t1": F.max(t), "_n": F.count(F.lit(1))}, most)
    width, since = F.greatest(F.lit(band), (F.col("_t1") - F.col("_t0")) * per / F.col("_n")), F.col(t) - F.col("_t0")
    cell = F.floor(since / width).cast("bigint")
    reach = 1.001 * band
    cells = F.array(cell, F.when(since - cell * width <= reach, cell - 1), F.when((cell + 1) * width - since <= reach, cell + 1))
    dealt = known.select(*rows.columns, F.explode(F.filter(cells, lambda c: c.isNotNull())).alias("_cell"), cell.alias("_home"))
    dealt = scan.kept(dealt.withColumn("_own", F.col("_cell") == F.col("_home")).drop("_home"))
    dense = scan.long_groups(dealt, [group, "_cell"], 16 * per)
    thin = dealt if dense is None else scan.matched(dealt, dense, [group, "_cell"], "left_anti")

    names = rows.columns

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(t)
        when = table[t].to_numpy().astype(float)
        lists = table[features].combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        x = np.zeros((len(when), size.max()))
        x[np.arange(x.shape[1]) < size[:, None]] = np.nan_to_num(lists.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(float), nan=0.0, posinf=np.inf, neginf=-np.inf)
        x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-10
        own = np.flatnonzero(table["_own"].to_numpy())
        return table.take(pa.array(own)).select(names).append_column("local", pa.array(band_of(when, x, own, tau, band)))

    schema = StructType([*rows.schema.fields, StructField("local", DoubleType())])
    out = thin.groupBy(group, "_cell").applyInArrow(run, schema)
    if dense is None:
        return out
    crowded = scan.matched(dealt, dense, [group, "_cell"], "left_semi").withColumn("_both", F.struct(group, "_cell"))
    return out.unionByName(band_attention(crowded, "_both", t, features, tau, band, most).where("_own").select(*rows.columns, "local"))


def anchors(rows: DataFrame, group: str, t: str, score: str, features: str, most: int = scan.MOST, long: scan.Long = scan.Ask) -> DataFrame:
    """Three anchor rows per group: the best of the first 15 % (or the row after them if all are weak), the middle, the last.

    Rows at one time go by score, then by features.
    """
    long = scan.long_groups(rows, [group], most) if long is scan.Ask else long
    rows = rows.select(group, t, score, features)
    placed = scan.running(rows, [group], [t, score, features], {"_i": (F.lit(1), "count")}, most=most, long=long).withColumn("_i", F.col("_i") - 1)
    placed = scan.with_totals(placed, [group], {"_n": F.count(F.lit(1))}, most, long).withColumn("_head", F.greatest(F.lit(1), F.floor(F.col("_n") * 0.15).cast("int")))
    placed = scan.with_totals(placed, [group], {"_best": F.max(F.when(F.col("_i") < F.col("_head"), F.col(score)))}, most, long)
    place = F.min(F.when((F.col("_i") < F.col("_head")) & (F.col(score) == F.col("_best")), F.col("_i")))
    placed = scan.with_totals(placed, [group], {"_first": place}, most, long)
    placed = placed.withColumn("_peak", F.when(F.col("_best") < 0.05, F.col("_head")).otherwise(F.col("_first")))
    wanted = F.array(F.col("_peak").cast("int"), F.floor(F.col("_n") / 2).cast("int"), (F.col("_n") - 1).cast("int"))
    hits = F.size(F.filter(wanted, lambda x: x == F.col("_i")))
    return placed.withColumn("hits", hits).where("hits > 0").select(group, t, F.col(features).alias("anchor"), "hits")


def hybrid_attention(rows: DataFrame, group: str, t: str, score: str, features: str, most: int = scan.MOST, banded: Callable[..., DataFrame] = band_attention) -> DataFrame:
    """(group, t, hybrid_score); `banded` gives the part along the band; groups of fewer than five rows keep their score. Rows without features are left out."""
    rows = rows.where(F.col(features).isNotNull() & F.col(group).isNotNull() & F.col(t).isNotNull())
    long = scan.long_groups(rows, [group], most)
    found = anchors(rows, group, t, score, features, most, long).groupBy(group).agg(F.collect_list(F.struct("anchor", "hits")).alias("_anchors"))  # three at most
    local = scan.kept(banded(rows.select(group, t, score, features), group, t, features, most=most)).join(scan.kept(found), group)
    local = local.withColumn("_unit", l2_normalise(features))
    overall = F.aggregate("_anchors", F.lit(0.0), lambda s, a: s + a["hits"] * dot(F.col("_unit"), l2_normalise(a["anchor"])))
    raw = local.select(group, t, score, (F.col("local") + overall / 3).alias("_raw"))
    totals = {"_n": F.count(F.lit(1)), "_t0": F.min(t), "_t1": F.max(t), "_s0": F.min(score), "_s1": F.max(score), "_r0": F.min("_raw"), "_r1": F.max("_raw")}
    raw = scan.with_totals(raw, [group], totals, most, long)  # of a group's rows
    alpha = clamp(F.lit(0.55) - F.lit(0.0015) * (F.col("_t1") - F.col("_t0")), 0.35, 0.55)
    mixed = alpha * min_max(F.col(score), F.col("_s0"), F.col("_s1")) + (1 - alpha) * min_max(F.col("_raw"), F.col("_r0"), F.col("_r1"))
    ramped = intro_ramp(raw.select(group, t, score, "_n", mixed.alias("_mixed")), group, t, most=most, long=long)
    return ramped.select(group, t, F.when(F.col("_n") < 5, F.col(score)).otherwise(F.col("_mixed") * F.col("ramp")).alias("hybrid_score"))


def attention_kernel(pdf, t: str = "t", score: str = "score", features: str = "features"):  # noqa: ANN001, ANN201
    """The same for one group in numpy, in squares of its rows: what tests hold the plan against."""
    pdf = pdf[pdf[features].notna()].sort_values(t)
    if len(pdf) < 5:
        return pdf.assign(hybrid_score=pdf[score].astype(float))
    when, values, n = pdf[t].to_numpy(float), pdf[score].to_numpy(float), len(pdf)
    x = np.stack(pdf[features].to_numpy()).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-10
    span = when[-1] - when[0]
    head = max(1, int(n * 0.15))
    peak = head if values[:head].max() < 0.05 else int(values[:head].argmax())
    apart = np.abs(when[:, None] - when[None, :])
    raw = np.where(apart <= BAND, (x @ x.T) * np.exp(-apart / TAU), 0).sum(1) + (x @ x[[peak, n // 2, n - 1]].T).mean(1)

    def scaled(v: np.ndarray) -> np.ndarray:
        return 0.1 + 0.9 * (v - v.min()) / (v.max() - v.min()) if v.max() != v.min() else np.full(len(v), 0.5)

    alpha = min(max(0.55 - 0.0015 * span, 0.35), 0.55)
    ramp = np.ones(n)
    intro = when < min(30.0, 0.1 * span)
    ramp[intro] = np.linspace(0.7, 1.0, intro.sum())
    return pdf.assign(hybrid_score=(alpha * scaled(values) + (1 - alpha) * scaled(raw)) * ramp)
