"""Order-dependent work that no single task may hold: running totals, positions, quantiles.

A window over a whole table, or over one hot key, runs in one task. Here the order column
is cut into buckets first: each bucket is summed on its own, bucket totals (a short table)
give the offsets, and both are joined. Results are exact; only the cut points are estimates.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from chartspark.session import scratch_dir

MIN_BUCKETS, MAX_BUCKETS = 16, 8192
BLOCK_ROWS = 1_000_000
HOT_ROWS = 10_000_000
#: Accuracy of the sketches that bracket quantiles: ranks are right within rows / SKETCH.
SKETCH = 100_000


def split_points(df: DataFrame, column: str, rows_per_bucket: int = BLOCK_ROWS) -> list[float]:
    """Inner cut points of a numeric column, so many that a bucket holds about `rows_per_bucket` rows.

    One aggregation; at most MAX_BUCKETS numbers reach the driver. They only decide how the
    work is spread, never what comes out.
    """
    # One text literal instead of thousands of number literals in the plan.
    listed = ",".join(str(i / MAX_BUCKETS) for i in range(1, MAX_BUCKETS))
    probabilities = F.split(F.lit(listed), ",").cast("array<double>")
    value = F.col(column).cast("double")
    row = df.agg(F.count(value).alias("n"), F.percentile_approx(value, probabilities, F.lit(2 * MAX_BUCKETS)).alias("p")).first()
    if not row.n:
        return []
    wanted = min(max(row.n // rows_per_bucket, MIN_BUCKETS), MAX_BUCKETS)
    return sorted({row.p[i * MAX_BUCKETS // wanted - 1] for i in range(1, wanted)})


def with_bucket(df: DataFrame, column: str, splits: Sequence[float], out: str = "_bucket") -> DataFrame:
    """Bucket number of `column` between the cut points."""
    if not splits:
        return df.withColumn(out, F.lit(0.0))
    edges = [float("-inf"), *splits, float("inf")]
    cast = df.withColumn("_cut", F.col(column).cast("double"))
    bucketed = Bucketizer(splits=edges, inputCol="_cut", outputCol=out, handleInvalid="keep")
    return bucketed.transform(cast).drop("_cut")


def running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, Column],
    splits: Sequence[float] | None = None,
    block: int | None = None,
    totals: bool = False,
) -> DataFrame:
    """Add inclusive running sums of `values` within `by`, ordered by `order`.

    Buckets are cut on the first order column: at `splits`, else every `block` units of it
    (for a column known to be dense), else at cut points measured first.
    With `totals`, `<name>_total` carries the sum over the whole group.
    """
    by = list(by)
    base = _keyed(df, by, order[0], splits, block).withColumns({f"_v_{name}": expr for name, expr in values.items()})

    inside = Window.partitionBy("_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = base.withColumns({f"_r_{name}": F.sum(f"_v_{name}").over(inside) for name in values})

    short = base.groupBy("_key").agg(*[F.sum(f"_v_{name}").alias(f"_s_{name}") for name in values])
    group = _group_window(by)
    before = group.orderBy("_key._bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = short.select(
        F.col("_key").alias("_k"),
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in values],
        *[F.sum(f"_s_{n}").over(group).alias(f"_t_{n}") for n in values if totals],
    )
    joined = rows.join(offsets, rows["_key"] == offsets["_k"], "inner")
    added = [(F.col(f"_r_{n}") + F.col(f"_o_{n}")).alias(n) for n in values]
    if totals:
        added += [F.col(f"_t_{n}").alias(f"{n}_total") for n in values]
    return joined.select(*[rows[c] for c in df.columns], *added)


def _keyed(df: DataFrame, by: Sequence[str], column: str, splits: Sequence[float] | None, block: int | None) -> DataFrame:
    """Add `_key`, a struct of the group columns and the bucket.

    One struct serves as window, group and join key alike: it is never null, its null fields
    compare equal, and the rows are shuffled on it once.
    """
    if block is not None:
        base = df.withColumn("_bucket", F.floor(F.col(column) / F.lit(block)))
    else:
        base = with_bucket(df, column, split_points(df, column) if splits is None else splits)
    return base.withColumn("_key", F.struct(*by, F.col("_bucket").cast("bigint").alias("_bucket"))).drop("_bucket")


def _group_window(by: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*[F.col("_key")[b] for b in by]) if by else Window.partitionBy(F.lit(0))


def _window(by: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))


def positions(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    out: str = "position",
    splits: Sequence[float] | None = None,
    block: int | None = None,
    total: str | None = None,
) -> DataFrame:
    """Add the 0-based position of each row within `by`, and the group size as `total`."""
    placed = running(df, by, order, {"_pos": F.lit(1)}, splits, block, totals=total is not None)
    placed = placed.withColumn(out, F.col("_pos") - 1).drop("_pos")
    return placed.withColumnRenamed("_pos_total", total) if total else placed


def value_counts(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """Non-null values of `x` with their multiplicity `_n`, per group."""
    return (
        df.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double")))
        .groupBy(*by, F.col(x).cast("double").alias("_x"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )


def ranked_values(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """Distinct values per group with `_n`, the inclusive running count `_c` and `_c_total`."""
    counts = value_counts(df, by, x)
    return running(counts, by, ["_x"], {"_c": F.col("_n")}, split_points(df, x), totals=True)


def quantiles_long(df: DataFrame, x: str, by: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """Exact linear-interpolation quantiles, one row per (group, p): `by…, p, q`.

    The built-in exact percentile holds all values of a group in one task. Here a bounded sketch
    per group brackets each quantile first. Then the values below a bracket are only counted, and the
    few inside it are ranked, so hardly a value is shuffled. The brackets are ten times as
    wide as the sketch's error, and open where that is under five ranks (at most SKETCH / 2 rows); a
    quantile outside of its bracket would fail the query.
    """
    by = list(by)
    value = F.col(x).cast("double")
    rows = df.where(value.isNotNull() & ~F.isnan(value)).select(*by, value.alias("_x"))
    points = sorted({float(p) for p in probabilities})
    margin = 10 / SKETCH

    wide = F.col("_rows") * margin >= 5

    def edge(place: int, closed: bool, open_at: str) -> Column:
        return F.when(wide & F.lit(closed), F.get("_s", F.lit(place))).otherwise(F.lit(float(open_at)))

    ends = [F.lit(min(max(q, 0.0), 1.0)) for p in points for q in (p - margin, p + margin)]
    sketched = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), F.percentile_approx("_x", F.array(*ends), F.lit(SKETCH)).alias("_s"))
    brackets = sketched.select(
        *by, "_rows",
        F.array(*[edge(2 * i, p > margin, "-inf") for i, p in enumerate(points)]).alias("_low"),
        F.array(*[edge(2 * i + 1, p < 1 - margin, "inf") for i, p in enumerate(points)]).alias("_high"))
    if by:
        bracketed = join_measured(rows, brackets, by)
    else:
        one = brackets.select(F.struct("_rows", "_low", "_high").alias("s")).scalar()
        bracketed = rows.withColumns({c: one[c] for c in ("_rows", "_low", "_high")})
    x_ = F.col("_x")

    def stretch(first: int, end: int) -> Column:
        """Number of the first bracket that ends at or after the value, by halving."""
        if first == end:
            return F.lit(first)
        middle = (first + end) // 2
        return F.when(x_ > F.get("_high", F.lit(middle)), stretch(middle + 1, end)).otherwise(stretch(first, middle))

    # Brackets are in order, so a value is inside one if it is inside that bracket. Any other
    # value becomes a null of the stretch before the bracket, and is counted there.
    placed = bracketed.withColumn("_at", stretch(0, len(points)))
    counted = placed.groupBy(*by, "_at", F.when(x_ >= F.get("_low", F.col("_at")), x_).alias("_x")).agg(
        F.count(F.lit(1)).alias("_n"), F.max("_rows").alias("_rows"))
    upward = _window(by).orderBy("_at", F.asc_nulls_first("_x")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_after", F.sum("_n").over(upward))

    def holding(place: Column) -> Column:
        """The value whose ranks, first up to after, hold this place."""
        return F.max(F.when((F.col("_after") - F.col("_n") <= place) & (place < F.col("_after")), F.col("_x")))

    def quantile(i: int, p: float) -> Column:
        place = F.lit(p) * (F.col("_count") - 1)
        low, high = F.col(f"_l{i}"), F.col(f"_h{i}")
        q = low + (place - F.floor(place)) * (high - low)
        failed = F.raise_error(F.lit("a quantile lies outside of its bracket")).cast("double")
        return F.struct(F.lit(p).alias("p"), F.when(low.isNull() | high.isNull(), failed).otherwise(q).alias("q"))

    neighbours = []
    for i, p in enumerate(points):
        place = F.lit(p) * (F.col("_rows") - 1)
        neighbours += [holding(F.floor(place)).alias(f"_l{i}"), holding(F.ceil(place)).alias(f"_h{i}")]
    found = ranked.groupBy(*by).agg(F.max("_rows").alias("_count"), *neighbours).where(F.col("_count").isNotNull())
    return found.select(*by, F.inline(F.array(*[quantile(i, p) for i, p in enumerate(points)])))


def quantiles(df: DataFrame, x: str, by: Sequence[str], named: Mapping[str, float], exact: bool = True) -> DataFrame:
    """One row per group with a column for each named quantile.

    `exact=False` trades exactness for a single pass with a bounded sketch per group.
    """
    if not exact:
        return df.groupBy(*by).agg(
            *[F.percentile_approx(F.col(x).cast("double"), p, F.lit(10000)).alias(n) for n, p in named.items()]
        )
    long = quantiles_long(df, x, by, sorted(set(named.values())))
    return long.groupBy(*by).agg(
        *[F.max(F.when(F.col("p") == F.lit(float(p)), F.col("q"))).alias(n) for n, p in named.items()]
    )


def previous_row(
    df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], block: int | None = None,
    splits: Sequence[float] | None = None,
) -> DataFrame:
    """Add `prev_<column>` from the row before, and `has_prev`, without one task per group.

    Blocks of the first order column are windowed on their own; the last row of each block
    is handed to the next one through a short table.
    """
    by = list(by)
    base = _keyed(df, by, order[0], splits, block)
    packed = F.struct(*[F.col(c) for c in columns])
    inside = Window.partitionBy("_key").orderBy(*order)
    rows = base.withColumns({"_here": F.lag(packed).over(inside), "_first": F.row_number().over(inside) == 1})
    ends = base.groupBy("_key").agg(F.max_by(packed, F.struct(*[F.col(c) for c in order])).alias("_end"))
    handed = ends.select(F.col("_key").alias("_k"), F.lag("_end").over(_group_window(by).orderBy("_key._bucket")).alias("_before"))
    joined = rows.join(handed, rows["_key"] == handed["_k"], "inner")
    found = F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_here"))
    return joined.select(
        *[rows[c] for c in df.columns],
        *[found[c].alias(f"prev_{c}") for c in columns],
        found.isNotNull().alias("has_prev"),
    )


def positions_by_value(df: DataFrame, value: str, row: str, ascending: bool = True, out: str = "position",
                       block: int | None = None) -> DataFrame:
    """0-based position when sorted by a small-range `value`, input order kept on ties.

    Many rows may share one value, so ties are counted in blocks of the row index; the
    offsets of the values come from a table with one row per distinct value.
    """
    placed = positions(df, [value], [row], "_within", block=block)
    order = F.asc("_value") if ascending else F.desc("_value")
    before = Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_rows")).select(
        "_value", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")
    )
    joined = placed.join(starts, placed[value].eqNullSafe(starts["_value"]))
    return joined.select(*[placed[c] for c in df.columns], (F.col("_within") + F.col("_start")).alias(out))


def ranked_desc(df: DataFrame, by: Sequence[str], value: str, out: str = "place") -> DataFrame:
    """Competition rank of `value` within `by`, largest first; equal values share a rank.

    Ranks are counted over distinct values, so a group of any size is spread over buckets.
    """
    counts = df.groupBy(*by, F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_neg", -F.col("_value"))
    run = running(counts, by, ["_neg"], {"_c": F.col("_n")}, split_points(counts, "_neg"))
    ranks = run.select(*[F.col(b).alias(f"_k_{b}") for b in by], "_value", (F.col("_c") - F.col("_n") + 1).alias(out))
    condition = df[value].eqNullSafe(ranks["_value"])
    for key in by:
        condition = condition & df[key].eqNullSafe(ranks[f"_k_{key}"])
    return df.join(ranks, condition, "inner").select(*[df[c] for c in df.columns], out)


def join_groups(rows: DataFrame, groups: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Attach one row per group to every row of it; null groups match.

    The group side is an aggregate. Adaptive execution broadcasts it when its measured size
    is small and splits hot groups of the other side when it is not.
    """
    if not by:
        raise ValueError("no group columns")
    renamed = groups.withColumnsRenamed({b: f"_k_{b}" for b in by})
    condition = F.lit(True)
    for key in by:
        condition = condition & rows[key].eqNullSafe(renamed[f"_k_{key}"])
    return rows.join(renamed, condition, how).drop(*[f"_k_{b}" for b in by])


def join_measured(rows: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """`join_groups` for an aggregate over a table with few, hot groups: the groups are stored first, so their size is known when the join is planned.

    A small list of groups is broadcast then, and no row is shuffled by a group that holds a third of them. With
    `join_groups` alone the rows are already on their way when the size turns out.
    """
    path = scratch_dir(rows.sparkSession, "groups")
    groups.write.parquet(path)
    return join_groups(rows, rows.sparkSession.read.schema(groups.schema).parquet(path), by)


def join_spread(rows: DataFrame, groups: DataFrame, by: Sequence[str], per_slice: int = HOT_ROWS) -> DataFrame:
    """`join_groups` for rows that are aggregated by the same keys afterwards.

    Such a join keeps every row of a group in one task, and adaptive execution leaves it so to
    save the later shuffle. Groups with more than `per_slice` rows are therefore cut into
    slices, and their one row on the group side is repeated per slice. There are at most
    rows / per_slice of them, so their list is broadcast.
    """
    hot = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > per_slice).select(
        *by, F.ceil(F.col("_size") / per_slice).alias("_slices"))
    tagged = join_groups(rows, F.broadcast(hot), by, "left")
    sliced = tagged.withColumn("_slice", F.pmod(F.xxhash64(*rows.columns), F.coalesce("_slices", F.lit(1)))).drop("_slices")
    repeated = join_groups(groups, F.broadcast(hot), by, "left").withColumn(
        "_slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_slices", F.lit(1)) - 1))).drop("_slices")
    return join_groups(sliced, repeated, [*by, "_slice"]).drop("_slice")


def top_by_draw(df: DataFrame, by: Sequence[str], draw: str, draw_range: int, n: int, slices: int = 1 << 16) -> DataFrame:
    """The n rows of each group with the smallest draws (even draws in [0, draw_range)).

    Slice counts tell which slices of the draw range are needed, so few rows beyond the
    sample are shuffled, however large a group is.
    """
    sliced = df.withColumn("_slice", F.floor(F.col(draw) / F.lit(draw_range // slices)))
    counts = sliced.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    needed = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).where(F.col("_before") < n)
    near = join_groups(sliced, needed.select(*by, "_slice"), [*by, "_slice"], "left_semi")
    first = F.row_number().over(group.orderBy(draw))
    return near.withColumn("_rn", first).where(F.col("_rn") <= n).select(*df.columns)
