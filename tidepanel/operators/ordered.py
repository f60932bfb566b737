"""Exact ranks, row numbers and quantiles for groups of any size, by one plan.

A window over a group sorts the whole group in one task. Here a group is cut where its own sketch says (``percentile_approx``,
mergeable and bounded), and what has to be exact is counted:

* **Ranks.** The cuts make slots: below the first cut, equal to it, between the first and the second, and so on. One
  aggregate counts the rows of every slot. A row that equals a cut has its rank from these counts alone; a value that many rows
  share always is a cut. All others are ranked by a window inside their open slot, which holds about one row in ``CUTS``.
* **Bins** of a percentile rank need no rank per row: the smallest value of each bin is found like a quantile.
* **Quantiles.** Two bounds around a quantile, wider than the sketch's error, leave a few rows per thousand. Their distinct values are counted and summed in order, behind the number of rows below the lower bound.
* **Row numbers** need an order among equal values: rows are dealt out by range of (group, order, id), and a place is the number
  of rows in the group's earlier ranges plus those before it in its own. Where rows are numbered anyway, the same ranges give ranks.
* **Cells** rank several values of stored rows with the least moved: every row knows its slots from the cuts, without a shuffle, so
  a value's rows meet once, in their slot, and only with the columns that are still needed. Nothing between is stored.

No join meets a value, no task sorts a group, and rows without a value are spread like any others.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.scale import freeze, null_safe_join, settled

CUTS = 32
ACCURACY = 1000  # of the sketches: one part in so many of a group's rows
CELL_ACCURACY = 4 * CUTS  # where cuts only have to make slots of like size
# distances from a quantile's place, as shares, and the rows from which each is more than two rows and twice the sketch's error
MARGINS = (0.004, 0.02, 0.1, 1.0)
LEAST_ROWS = (1000, 120, 24)
GRID = 40
TOP_SHARE = 0.999999  # the highest share of a percentile rank that is binned


# -- ranks ---------------------------------------------------------------------------


def slot_of(value: Column, cuts: Column) -> Column:
    """Number of the slot: odd for a value that is a cut, even between cuts."""
    smaller = F.size(F.filter(cuts, lambda c: c < value))
    return F.when(value.isNotNull(), 2 * smaller + F.array_contains(cuts, value).cast("int"))


def add_rank(
    df: DataFrame, keys: Sequence[str], value: str, out: str, ascending: bool = True, share: bool = False
) -> DataFrame:
    """Add the average-tie rank of ``value`` in the row's group; ``share`` divides it by the count.

    ``df`` is read more than once and must give the same rows each time (:func:`tidepanel.scale.settled`).
    """
    keys = list(keys)
    x = F.col(value)
    narrow = df.select(*keys, value).where(x.isNotNull())
    steps = [i / CUTS for i in range(1, CUTS)]
    cuts = narrow.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(x, steps, ACCURACY)).alias("_cuts"))
    slotted = null_safe_join(narrow, cuts, keys).withColumn("_slot", slot_of(x, F.col("_cuts")))
    sizes = slotted.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("n"), F.max(x).alias("v"))
    # a row per slot from here on, 2 * CUTS at most in a group; every cut is a value of the group, so odd slots have rows
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("_slot")) - F.col("n")
    listed = F.array_sort(F.collect_list(F.struct("_slot", "below", "n", "v")))
    slots = sizes.withColumn("below", before).groupBy(*keys).agg(listed.alias("_list"), F.sum("n").alias("_total"))
    cut_values = F.transform(F.filter("_list", lambda s: s["_slot"] % 2 == 1), lambda s: s["v"])
    by_slot = F.map_from_entries(F.transform("_list", lambda s: F.struct(s["_slot"], F.struct(s["below"].alias("below"), s["n"].alias("n")))))
    slots = slots.select(*keys, "_total", cut_values.alias("_cuts"), by_slot.alias("_slots"))
    work = null_safe_join(df, slots, keys).withColumn("_slot", slot_of(x, F.col("_cuts")))
    work = work.withColumn("_at", F.element_at("_slots", F.col("_slot"))).drop("_slots", "_cuts")
    counted = F.col("_slot").isNull() | (F.col("_slot") % 2 == 1)  # rows that need no order, dealt out by their content
    spread = F.when(counted, F.pmod(F.xxhash64(*df.columns), F.lit(CUTS)) + 1).otherwise(F.lit(0))
    work = work.withColumn("_spread", spread.cast("int"))
    inside = Window.partitionBy(*keys, "_slot", "_spread").orderBy(value)
    peers = F.count(F.lit(1)).over(inside.rangeBetween(Window.currentRow, Window.currentRow))
    among = F.when(F.col("_slot") % 2 == 1, (F.col("_at.n") + 1) / 2.0).otherwise(F.rank().over(inside) + (peers - 1) / 2.0)
    rank = F.col("_at.below") + among
    if not ascending:
        rank = F.col("_total") + 1 - rank
    if share:
        rank = rank / F.col("_total")
    return work.withColumn(out, F.when(x.isNotNull(), rank)).drop("_slot", "_at", "_spread", "_total")


def add_ranks(
    df: DataFrame,
    keys: Sequence[str],
    columns: Mapping[str, str],
    ascending: bool = True,
    share: bool = False,
    row: Sequence[str] | None = None,
) -> DataFrame:
    """Add average-tie ranks ``{out: column}`` in the row's group.

    One column is ranked on the rows themselves. Several become one long table of (row, column, value), ranked together and
    joined back once by ``row``, columns that name a row; without them rows are numbered.
    """
    keys = list(keys)
    if len(columns) == 1:
        ((out, x),) = columns.items()
        return add_rank(settled(df), keys, x, out, ascending, share)
    work = settled(df) if row else freeze(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    row = list(row or ["_row"])
    pairs = F.array(*[F.struct(F.lit(out).alias("_out"), F.col(x).alias("_value")) for out, x in columns.items()])
    rest = [k for k in keys if k not in row]
    long = work.select(*row, *rest, F.inline(pairs)).where(F.col("_value").isNotNull())
    ranked = add_rank(long, [*keys, "_out"], "_value", "_rank", ascending, share)
    wide = ranked.groupBy(*row).agg(*[F.max(F.when(F.col("_out") == out, F.col("_rank"))).alias(out) for out in columns])
    return null_safe_join(work, wide, row).drop("_row")


# -- quantiles -----------------------------------------------------------------------


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: Mapping[str, float],
    more: Mapping[str, Column] | None = None,
    grid: str | None = None,
) -> DataFrame:
    """Quantiles per group with linear interpolation, the number of values as ``total``, and ``more`` aggregates.

    A NULL key is a group of its own; groups without any value have a total of 0. ``df`` must be settled. ``grid`` names an
    array of approximate quantiles to keep, for :func:`median_of_distances`.
    """
    points = [i / GRID for i in range(1, GRID)] if grid else []
    sketch = _sketch(df, keys, value, quantiles.values(), more, points, grid)
    rows = _with_stats(df.select(*keys, F.col(value).alias("_v")), sketch.select(*keys, "_ends"), list(keys))
    kept = ["total", *(more or {}), *([grid] if grid else [])]
    return _selected(rows, keys, quantiles, sketch.select(*keys, *kept))


def rank_edges(df: DataFrame, keys: Sequence[str], value: str, edges: Mapping[str, tuple[int, int]]) -> DataFrame:
    """Per group and ``{name: (j, bins)}`` where bin ``j`` of the percentile rank begins, as ``(at, after)``.

    The bin of a value, ``floor(share * bins)`` of its average-tie rank as a share below 1, grows with the value, so the
    smallest value of bin ``j`` or a later one tells rows apart without a rank for each of them. With ``after`` these are the
    values above ``at``, else those from ``at`` on. ``df`` must be settled.
    """
    keys, v = list(keys), F.col("_v")
    sketch = _sketch(df, keys, value, [j / bins for j, bins in edges.values()])
    rows = _with_stats(df.select(*keys, F.col(value).alias("_v")), sketch.select(*keys, "_ends"), keys)
    counted = null_safe_join(_counted(rows, keys, len(edges)), sketch.select(*keys, "total"), keys)
    # the same arithmetic as a rank of the row
    share = (F.col("_end") - F.col("_n") + (F.col("_n") + 1) / 2.0) / F.col("total")
    j, bins = (F.array(*[F.lit(e[i]) for e in edges.values()])[F.col("_q")] for i in (0, 1))
    reached = v.isNotNull() & (F.floor(F.least(share, F.lit(TOP_SHARE)) * bins) >= j)
    least = counted.groupBy(*keys, "_q").agg(F.min(F.when(reached, v)).alias("_v"))
    least = least.groupBy(*keys).agg(*[F.max(F.when(F.col("_q") == i, v)).alias(f"_least_{i}") for i in range(len(edges))])
    found = null_safe_join(sketch, least, keys)
    # a value that many rows share may be the upper bound and still lie below the edge: then the next one is the first
    edge = lambda i: F.struct(F.coalesce(f"_least_{i}", F.col("_ends")[2 * i + 1]).alias("at"), F.isnull(f"_least_{i}").alias("after"))
    return found.select(*keys, *[edge(i).alias(n) for i, n in enumerate(edges)])


def _sketch(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    places: Sequence[float],
    more: Mapping[str, Column] | None = None,
    points: Sequence[float] = (),
    grid: str | None = None,
) -> DataFrame:
    """Per group the ``total`` of values, ``_ends`` (two bounds around each place), ``more`` aggregates and quantiles at ``points``.

    It is stored, so that Spark knows its size before it joins it with the rows: those of a small one are not shuffled.
    """
    # bounds at several distances; the nearest that is safe for the group's size holds
    ends = [min(1.0, max(0.0, q + side * m)) for q in places for m in MARGINS for side in (-1, 1)]
    sketch = df.groupBy(*keys).agg(
        F.count(value).alias("total"),
        F.percentile_approx(value, [*ends, *points], ACCURACY).alias("_all"),
        *[a.alias(n) for n, a in (more or {}).items()],
    )
    safe = F.when(F.col("total") >= LEAST_ROWS[0], 0)
    for i, rows in enumerate(LEAST_ROWS[1:], 1):
        safe = safe.when(F.col("total") >= rows, i)
    sketch = sketch.withColumn("_at", 2 * safe.otherwise(len(LEAST_ROWS)))
    near = F.array(*[F.col("_all")[F.col("_at") + (2 * len(MARGINS) * i + side)] for i in range(len(places)) for side in (0, 1)])
    kept = ["total", *(more or {}), near.alias("_ends")]
    if grid:
        kept.append(F.slice("_all", len(ends) + 1, len(points)).alias(grid))
    return freeze(sketch.select(*keys, *kept), "sketch")


def _counted(rows: DataFrame, keys: Sequence[str], places: int) -> DataFrame:
    """The distinct values ``_v`` between the bounds ``_ends`` of each place ``_q``, how many rows have them and the rows up to them.

    Rows below the bounds count as one value before all others; those above do not matter.
    """
    v, ends = F.col("_v"), F.col("_ends")
    part = lambda i: F.when(v <= ends[2 * i + 1], F.struct(F.lit(i).alias("_q"), F.when(v >= ends[2 * i], v).alias("_v")))
    each = rows.select(*keys, F.inline(F.array_compact(F.array(*[part(i) for i in range(places)]))))
    counted = each.groupBy(*keys, "_q", "_v").agg(F.count(F.lit(1)).alias("_n"))
    return counted.withColumn("_end", F.sum("_n").over(Window.partitionBy(*keys, "_q").orderBy(F.col("_v").asc_nulls_first())))


def _selected(rows: DataFrame, keys: Sequence[str], quantiles: Mapping[str, float], groups: DataFrame) -> DataFrame:
    """``groups`` (a stored row per group, with its ``total``) and the quantiles of ``_v`` between the bounds ``_ends`` of ``rows``."""
    keys = list(keys)
    counted = _counted(rows, keys, len(quantiles))
    counted = null_safe_join(counted, groups.select(*keys, "total"), keys) if keys else counted.crossJoin(groups.select("total"))
    place = F.array(*[F.lit(float(q)) for q in quantiles.values()])[F.col("_q")] * (F.col("total") - 1)
    value_at = lambda p: F.max(F.when((p >= F.col("_end") - F.col("_n")) & (p < F.col("_end")), F.col("_v")))
    two = counted.groupBy(*keys, "_q").agg(value_at(F.floor(place)).alias("_lo"), value_at(F.ceil(place)).alias("_hi"), F.max(place).alias("_p"))
    a, b, p = F.col("_lo"), F.col("_hi"), F.col("_p")
    two = two.withColumn("_x", F.when(a == b, a).otherwise((F.ceil(p) - p) * a + (p - F.floor(p)) * b))
    found = two.groupBy(*keys).agg(*[F.max(F.when(F.col("_q") == i, F.col("_x"))).alias(n) for i, n in enumerate(quantiles)])
    out = null_safe_join(groups, found, keys) if keys else groups.crossJoin(found)
    missed = lambda n: F.when(F.col(n).isNull() & (F.col("total") > 0), F.raise_error(F.lit("a sketch missed its quantile")).cast("double"))
    return out.withColumns({n: missed(n).otherwise(F.col(n)) for n in quantiles})


def median_of_distances(df: DataFrame, keys: Sequence[str], value: str, centres: DataFrame, centre: str, grid: str, out: str) -> DataFrame:
    """``centres`` (a row per group, with ``total`` and a ``grid`` of the value) and the median distance of ``value`` to ``centre``.

    Bounds of the median come from the grid: the share of values within a distance d is known from the points between
    centre - d and centre + d, up to a step of the grid on each side and the sketch's error.
    """
    keys, c, points = list(keys), F.col(centre), F.col(grid)
    centres = freeze(centres, "centres")
    error = F.lit(2.0 / ACCURACY) + 4.0 / F.col("total")
    bounds = centres.withColumn("_far", F.transform(points, lambda g: F.abs(g - c)))
    within = lambda d: F.size(F.filter("_far", lambda e: e <= d))
    surely_less = F.array_max(F.filter("_far", lambda d: (within(d) + 1) / GRID + error <= 0.5))
    surely_more = F.array_min(F.filter("_far", lambda d: (within(d) - 1) / GRID - error >= 0.5))
    ends = F.array(F.coalesce(surely_less, F.lit(0.0)), F.coalesce(surely_more, F.lit(float("inf"))))
    bounds = freeze(bounds.select(*keys, ends.alias("_ends"), c.alias("_c")), "bounds")
    rows = _with_stats(df.select(*keys, F.col(value).alias("_v")), bounds, keys).withColumn("_v", F.abs(F.col("_v") - F.col("_c")))
    return _selected(rows, keys, {out: 0.5}, centres.drop(grid))


def _with_stats(df: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the columns of its group's row in ``stats``; without keys there is one row."""
    if keys:
        return null_safe_join(df, stats, keys)
    row = stats.select(F.struct(*stats.columns).alias("s")).scalar()
    return df.withColumn("_one", row).select(*df.columns, *[F.col("_one")[c].alias(c) for c in stats.columns])


# -- row numbers ---------------------------------------------------------------------

PART = "_part"


def by_range(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``df`` dealt out by range of keys and order, with its range number ``_part``; stored, so that ranges stay."""
    return freeze(df.repartitionByRange(*keys, *order).withColumn(PART, F.spark_partition_id()), name)


def _before(x: str, window) -> Column:
    return F.coalesce(F.sum(x).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def offsets(ranged: DataFrame, keys: Sequence[str], size: Column) -> DataFrame:
    """Per group and range the sizes of earlier ranges (``_in_earlier``) and of the group (``_total``): a row per range at most."""
    sizes = ranged.groupBy(*keys, PART).agg(size.alias("_n"))
    group = Window.partitionBy(*keys)
    return sizes.select(*keys, PART, _before("_n", group.orderBy(PART)).alias("_in_earlier"), F.sum("_n").over(group).alias("_total"))


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], row_id: str, out: str, total: str | None = None, rank: str | None = None
) -> DataFrame:
    """Add the 1-based place of each row in its group by ``order``, then by ``row_id``, and the group's ``total`` rows.

    ``row_id`` must be unique within a group, so equal order values are dealt out as well. ``rank`` names the average-tie rank by
    a single order value, which must not be NULL. Rows are sorted inside their range before it is stored, so a place is the
    distance to the group's first row in the range behind the rows of earlier ranges, without a window. Equal values cross ranges
    only as the first or last value of a range; those ranks come from the ranges' ends, a row per range, the others from a window.
    """
    keys = list(keys)
    names = [f"_order_{i}" for i in range(len(order))]
    by = [*keys, *names, row_id]
    dealt = df.withColumns(dict(zip(names, order))).repartitionByRange(*by).sortWithinPartitions(*by)
    ranged = freeze(dealt.withColumns({PART: F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "numbered")
    ends = [F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")]
    if rank:
        x = names[0]
        # the last row of the lowest value, the first row of the highest
        ends += [f(F.struct(x, (-F.col("_at")).alias("at"))).alias(n) for f, n in ((F.min, "_lo"), (F.max, "_hi"))]
    group = Window.partitionBy(*keys)
    ranges = ranged.groupBy(*keys, PART).agg(*ends)
    ranges = ranges.withColumns({"_in_earlier": _before("_n", group.orderBy(PART)), "_total": F.sum("_n").over(group)})
    kept = ["_first", "_in_earlier", "_total"]
    if rank:
        ranges = _rank_ends(ranges, keys, x, kept)
        kept += ["_lo", "_lo_rank", "_hi", "_hi_rank"]
    # one key of its own that is never NULL, so that window and join share a shuffle
    which = F.struct(*keys, PART)
    work = ranged.withColumn("_range", which).drop(PART)
    if rank:
        ties = Window.partitionBy("_range").orderBy(x)
        peers = F.count(F.lit(1)).over(ties.rangeBetween(Window.currentRow, Window.currentRow))
        work = work.withColumn("_among", F.rank().over(ties) + (peers - 1) / 2.0)
    placed = work.join(ranges.select(which.alias("_range"), *kept), "_range")
    placed = placed.withColumn(out, F.col("_at") - F.col("_first") + F.col("_in_earlier") + 1)
    if rank:
        at_end = F.when(F.col(x) == F.col("_lo"), F.col("_lo_rank")).when(F.col(x) == F.col("_hi"), F.col("_hi_rank"))
        placed = placed.withColumn(rank, at_end.otherwise(F.col("_in_earlier") + F.col("_among"))).drop("_among")
    if total:
        placed = placed.withColumn(total, F.col("_total"))
    return placed.drop("_range", "_at", *kept, *names)


def _rank_ends(ranges: DataFrame, keys: list[str], x: str, kept: list[str]) -> DataFrame:
    """Ranges with their lowest and highest value and the average ranks of these, counted over all ranges that end in them."""
    lowest, highest = F.col(f"_lo.{x}"), F.col(f"_hi.{x}")
    to_highest = -F.col("_hi.at") - F.col("_first")  # rows before the highest value
    one = lowest == highest
    end = lambda side, v, before, n: F.struct(
        F.lit(side).alias("_side"), v.alias("_v"), (F.col("_in_earlier") + before + 1).alias("_place"), n.alias("_c")
    )
    both = F.array(
        end(0, lowest, F.lit(0), -F.col("_lo.at") - F.col("_first") + 1),
        end(1, highest, to_highest, F.when(one, F.lit(0)).otherwise(F.col("_n") - to_highest)),
    )
    same = Window.partitionBy(*keys, "_v")
    average = F.min("_place").over(same) + (F.sum("_c").over(same) - 1) / 2.0
    listed = ranges.select(*keys, PART, *kept, F.inline(both)).withColumn("_rank", average)
    side = lambda i, c: F.max(F.when(F.col("_side") == i, F.col(c)))
    return listed.groupBy(*keys, PART, *kept).agg(
        side(0, "_v").alias("_lo"), side(0, "_rank").alias("_lo_rank"), side(1, "_v").alias("_hi"), side(1, "_rank").alias("_hi_rank")
    )


# -- cells ---------------------------------------------------------------------------


def in_order(df: DataFrame, key: str, out: str) -> DataFrame:
    """``df`` stored in the order of ``key``, with a number ``out`` that grows with it (and is not gapless)."""
    return freeze(df.repartitionByRange(key).sortWithinPartitions(key).withColumn(out, F.monotonically_increasing_id()), "ordered")


def cut_groups(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], row: str | None = None, more: Mapping[str, Column] | None = None
) -> DataFrame:
    """A stored row per group: its keys, a number ``_group``, the cuts of each value, those of ``row``, and ``more`` aggregates.

    ``df`` must be settled, its values not NULL.
    """
    sketch = lambda c: F.percentile_approx(c, [i / CUTS for i in range(1, CUTS)], CELL_ACCURACY)
    found = [F.array_distinct(sketch(v)).alias(f"_cuts_{v}") for v in values]
    found += [sketch(row).alias("_rows")] if row else []
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"), *found, *[a.alias(n) for n, a in (more or {}).items()])
    # few rows: one per group
    return freeze(groups.repartition(1).withColumn("_group", F.monotonically_increasing_id()), "groups")


def with_cells(df: DataFrame, groups: DataFrame, keys: Sequence[str], values: Sequence[str], row: str, numbered: str | None = None) -> DataFrame:
    """Rows with a cell for each value in place of the keys; cells grow with the group and the value.

    A cell is an open slot; rows that equal a cut have the same rank wherever they are, so they are spread over ``CUTS`` cells by a
    hash of ``row``, or those of the value ``numbered`` by ranges of it (the ``_rows`` of :func:`cut_groups`).
    """
    lists = [f"_cuts_{v}" for v in values] + (["_rows"] if numbered else [])
    work = null_safe_join(df, groups.select(*keys, "_group", *lists), list(keys)).drop(*keys)
    smaller = lambda cuts, v: F.size(F.filter(cuts, lambda c: c < F.col(v)))
    for v in values:
        part = smaller("_rows", row) if v == numbered else F.pmod(F.xxhash64(row), F.lit(CUTS)).cast("int")
        work = work.withColumn("_i", smaller(f"_cuts_{v}", v))
        on_cut = F.get(f"_cuts_{v}", F.col("_i")).eqNullSafe(F.col(v))
        slot = (F.col("_group") * CUTS + F.col("_i")) * (2 * CUTS)
        work = work.withColumn(f"_cell_{v}", slot + F.when(on_cut, part + CUTS).otherwise(F.lit(0)))
    return work.drop("_group", "_i", *lists)


def cell_starts(celled: DataFrame, value: str) -> DataFrame:
    """Stored, per cell of the value: its ``_group``, the rows in the group's earlier cells, and the rank of rows that equal a cut."""
    cell = F.col("_cell")
    sizes = celled.groupBy(F.col(f"_cell_{value}").alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_group", F.floor(cell / (2 * CUTS * CUTS)))
    sizes = sizes.withColumn("_earlier", _before("_n", Window.partitionBy("_group").orderBy("_cell")))
    same = Window.partitionBy(F.floor(cell / CUTS))  # the cells of rows that equal a cut are neighbours
    rank = F.min("_earlier").over(same) + (F.sum("_n").over(same) + 1) / 2.0
    on_cut = F.pmod(F.floor(cell / CUTS), F.lit(2)) == 1
    return freeze(sizes.select("_cell", "_group", "_earlier", F.when(on_cut, rank).alias("_shared")), "cells")


def ranked_in_cells(celled: DataFrame, starts: DataFrame, value: str, rank: str, place: str | None = None, row: str | None = None) -> DataFrame:
    """Add the ``_group``, the average-tie ``rank`` of the value in it, and the ``place`` by (value, ``row``); the cell is dropped."""
    work = celled.withColumnRenamed(f"_cell_{value}", "_cell")
    if place:  # first, so that the ranks need no other sort
        work = work.withColumn(place, F.row_number().over(Window.partitionBy("_cell").orderBy(value, row)))
    inside = Window.partitionBy("_cell").orderBy(value)
    peers = F.count(F.lit(1)).over(inside.rangeBetween(Window.currentRow, Window.currentRow))
    work = work.withColumn(rank, F.rank().over(inside) + (peers - 1) / 2.0).join(starts, "_cell")
    work = work.withColumn(rank, F.coalesce("_shared", F.col("_earlier") + F.col(rank)))
    if place:
        work = work.withColumn(place, F.col("_earlier") + F.col(place))
    return work.drop("_cell", "_earlier", "_shared")


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """Add ``{out: sum of a whole-numbered column over the earlier rows of the group}``; ``order`` must tell rows apart.

    Rows are dealt out by range of (group, order) and summed where they lie, behind the totals of the group's earlier ranges.
    """
    keys, names = list(keys), list(sums)
    ranged = by_range(df.withColumns({f"_sum_{n}": c for n, c in sums.items()}), keys, order, "totals")
    inside = Window.partitionBy(*keys, PART).orderBy(*order)
    totals = ranged.groupBy(*keys, PART).agg(*[F.sum(f"_sum_{n}").alias(f"_all_{n}") for n in names])
    ranges = Window.partitionBy(*keys).orderBy(PART)
    earlier = totals.select(*keys, PART, *[_before(f"_all_{n}", ranges).alias(f"_all_{n}") for n in names])
    placed = null_safe_join(ranged.withColumns({f"_in_{n}": _before(f"_sum_{n}", inside) for n in names}), earlier, [*keys, PART])
    out = {n: F.col(f"_in_{n}") + F.col(f"_all_{n}") for n in names}
    return placed.withColumns(out).drop(PART, *[f"{h}_{n}" for n in names for h in ("_in", "_all", "_sum")])
