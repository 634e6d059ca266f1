"""Near-duplicate vectors by NN-descent: a neighbour graph refined through neighbours of neighbours."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartspark.llm.common import stored, table
from chartspark.llm.components import components
from chartspark.llm.registry import query


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of unit length in double precision."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)
    # Dividing by the largest part first keeps squares of extreme numbers finite.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def usable(vector: Column) -> Column:
    """Not null, not zero, and every component a finite number."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def first_lists(points: DataFrame, count: int, dimension: int, neighbours: int, trees: int, seed: int) -> DataFrame:
    """Candidate links `(pid, id, sim)`: neighbours along `trees` random orders of the points.

    An order sorts the points by the signs of their projections, the bits of a random-projection tree. Range
    partitions with the point as last key split any number of points with equal signs.
    """
    bits = max(1, min(40, math.ceil(math.log2(max(2, count)))))
    span = 4 * neighbours

    def coded(batches):
        planes = np.random.default_rng(seed).standard_normal((trees, dimension, bits))
        for batch in batches:
            matrix = _matrix(batch.column("v"))
            for t in range(trees):
                code = ((matrix @ planes[t]) > 0) @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(code), t, dtype=np.int32)), pa.array(code), batch.column("pid"), batch.column("v")], names=["tree", "code", "pid", "v"])

    def near(batches):
        held = None

        def links(block, last):
            """Links inside stretches of `span` neighbours; the second half of the last one waits for what follows."""
            for a in range(0, block.num_rows, span // 2):
                if a + span > block.num_rows and not last:
                    return a
                part = block.slice(a, span)
                ids, matrix = part.column("pid").to_numpy(), _matrix(part.column("v"))
                tree = part.column("tree").to_numpy()
                sims = np.where((tree[:, None] == tree[None, :]) & (ids[:, None] != ids[None, :]), matrix @ matrix.T, -2.0)
                best = np.argsort(-sims, axis=1, kind="stable")[:, :neighbours]
                i = np.repeat(np.arange(len(ids)), best.shape[1])
                j = best.ravel()
                keep = sims[i, j] > -2
                out.append((ids[i[keep]], ids[j[keep]], sims[i[keep], j[keep]]))
            return block.num_rows

        out: list[tuple] = []

        def made():
            batch = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["pid", "id", "sim"])
            out.clear()
            return batch

        for batch in batches:
            whole = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
            block = whole.to_batches()[0] if whole.num_rows else batch
            held = pa.Table.from_batches([block.slice(links(block, False))])
            if out:
                yield made()
        if held is not None and held.num_rows:
            block = held.combine_chunks().to_batches()[0]
            links(block, True)
            if out:
                yield made()

    kind = points.schema["v"].dataType.simpleString()
    ordered = points.select("pid", "v").mapInArrow(coded, f"tree int, code long, pid long, v {kind}")
    parts = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = ordered.repartitionByRange(parts, "tree", "code", "pid").sortWithinPartitions("tree", "code", "pid")
    return ranged.mapInArrow(near, "pid long, id long, sim double")


def _kept(links: DataFrame, neighbours: int, threshold: float, growth: int) -> DataFrame:
    """The best `neighbours` of each point; a list full of links may hold `growth` times as many."""
    order = Window.partitionBy("pid").orderBy(F.desc("sim"), "id")
    ranked = links.groupBy("pid", "id").agg(F.max("sim").alias("sim")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= neighbours * growth)
    return ranked.where((F.col("rank") <= neighbours) | (F.col("sim") >= threshold))


def refined(points: DataFrame, lists: DataFrame, neighbours: int, threshold: float, growth: int = 1, emitted: int = 6) -> DataFrame:
    """New links between neighbours of the same point, in either direction: `(pid, id, sim)`.

    Each point's lists, as far as they may have grown, in both directions and so twice as long at most, meet once with their vectors; a pair goes
    on if it beats the last place of its own list, or is a link.
    """
    both = lists.select(F.col("pid").alias("center"), F.col("id").alias("member"), "sim").unionByName(
        lists.select(F.col("id").alias("center"), F.col("pid").alias("member"), "sim")).groupBy("center", "member").agg(F.max("sim").alias("sim"))
    order = Window.partitionBy("center").orderBy(F.desc("sim"), "member")
    near = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 2 * neighbours * growth).select("center", "member")
    last = lists.where(F.col("rank") == neighbours).select(F.col("pid").alias("member"), F.least("sim", F.lit(threshold)).alias("least"))
    known = points.select(F.col("pid").alias("member"), "v").join(last, "member", "left").select("member", "v", F.coalesce("least", F.lit(-2.0)).alias("least"))
    groups = near.join(known, "member").groupBy("center").agg(F.collect_list(F.struct("member", "least", "v")).alias("m"))

    def each(batches):
        for batch in batches:
            column = batch.column("m")
            flat, offsets = column.flatten(), column.offsets.to_numpy() - column.offsets[0].as_py()
            if not len(flat):
                continue
            ids, least, matrix = flat.field("member").to_numpy(), flat.field("least").to_numpy(), _matrix(flat.field("v"))
            out = []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                sims = matrix[a:b] @ matrix[a:b].T
                np.fill_diagonal(sims, -3.0)
                best = np.argsort(-sims, axis=1, kind="stable")[:, :emitted]
                i = np.repeat(np.arange(b - a), best.shape[1])
                j = best.ravel()
                keep = sims[i, j] > least[a:b][i]
                out.append((ids[a:b][i[keep]], ids[a:b][j[keep]], sims[i[keep], j[keep]]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["pid", "id", "sim"])

    return groups.select("m").mapInArrow(each, "pid long, id long, sim double")


def audited(points: DataFrame, found: DataFrame, threshold: float, sample: int) -> tuple[int, int]:
    """(links counted, links there are) of a stated sample of points, compared with all points; `found(pid, n)` holds the counts.

    Tasks return a number for each point of the sample, not the links.
    """
    drawn = points.orderBy(F.xxhash64("pid"), "pid").limit(sample).select("pid", "v").toArrow()
    if not drawn.num_rows:
        return 0, 0
    ids, matrix = drawn.column("pid").to_numpy(), _matrix(drawn.column("v").combine_chunks())
    shared = points.sparkSession.sparkContext.broadcast((ids, matrix))

    def each(batches):
        ids, matrix = shared.value
        total = np.zeros(len(ids), dtype=np.int64)
        for batch in batches:
            own, n = batch.column("pid").to_numpy(), batch.column("n").to_numpy()
            for at in range(0, len(own), 2048):
                part = batch.column("v").slice(at, 2048)
                links = (_matrix(part) @ matrix.T >= threshold) & (own[at : at + 2048, None] != ids[None, :])
                total += n[at : at + 2048] @ links
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["pid", "true"])

    true = points.select("pid", "n", "v").mapInArrow(each, "pid long, true long").groupBy("pid").agg(F.sum("true").alias("true"))
    row = true.join(found, "pid", "left").agg(F.sum(F.least("true", F.coalesce("n", F.lit(0)))).alias("k"), F.sum("true").alias("n")).first()
    return int(row.k), int(row.n)


def _centres(placed: DataFrame, dimension: int) -> DataFrame:
    """`(pid, v, radius)` of each component of `placed(root, pid, v)`: mean direction, named by the root, and the widest angle to it."""

    def sums(batches):
        for batch in batches:
            roots, place = np.unique(batch.column("root").to_numpy(), return_inverse=True)
            total = np.zeros((len(roots), dimension))
            np.add.at(total, place, _matrix(batch.column("v")))
            yield pa.RecordBatch.from_pydict({"root": roots, "s": pa.array(list(total), type=pa.list_(pa.float64()))})

    parts = placed.select("root", "v").mapInArrow(sums, "root long, s array<double>").select("root", F.posexplode("s").alias("i", "x"))
    whole = parts.groupBy("root", "i").agg(F.sum("x").alias("x")).groupBy("root").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s"))
    centres = stored(whole.select("root", F.transform("s", lambda e: e["x"]).alias("centre")).where(usable(F.col("centre"))), "nn-centres")

    def angles(batches):
        for batch in batches:
            cosine = np.einsum("ij,ij->i", _matrix(batch.column("v")), _matrix(batch.column("centre")))
            yield pa.RecordBatch.from_arrays([batch.column("root"), pa.array(np.arccos(np.clip(cosine, -1, 1)))], names=["root", "angle"])

    wide = placed.select("root", "v").join(centres, "root").select("root", "v", "centre").mapInArrow(angles, "root long, angle double").groupBy("root").agg(F.max("angle").alias("radius"))
    return stored(centres.join(wide, "root").select(F.col("root").alias("pid"), F.col("centre").alias("v"), "radius"), "nn-spheres")


def bridges(placed: DataFrame, dimension: int, threshold: float, neighbours: int, trees: int, block: int, seed: int) -> DataFrame:
    """Links `(a, b)` between different components of `placed(root, pid, v)`, one for each pair of blocks that has any.

    Components are candidates if their centres are near in lists of centres, and the angle between these allows a link beyond both
    radii. Candidates are compared point by point, in blocks.
    """
    spheres = _centres(placed, dimension)
    count = spheres.count()
    if count < 2:
        return placed.select(F.col("pid").alias("a"), F.col("pid").alias("b")).limit(0)
    lists = stored(_kept(first_lists(spheres, count, dimension, neighbours, trees, seed), neighbours, 2.0, 1), "nn-spheres-lists")
    lists = lists.select("pid", "id", "sim").unionByName(refined(spheres, lists, neighbours, 2.0))
    of = lambda side: spheres.select(F.col("pid").alias(side), F.col("radius").alias(f"{side}r"))
    near = lists.groupBy(F.least("pid", "id").alias("a"), F.greatest("pid", "id").alias("b")).agg(F.max("sim").alias("sim")).join(of("a"), "a").join(of("b"), "b")
    near = near.where(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), "sim"))) <= F.col("ar") + F.col("br") + math.acos(threshold) + 1e-6)
    pairs = stored(near.select(F.col("a").alias("left"), F.col("b").alias("right")), "nn-near")
    sized = placed.join(placed.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_b")), "root").withColumn("_own", F.pmod(F.xxhash64("pid"), F.col("_b")).cast("int"))
    blocks = sized.select("root", "_b").distinct()
    other = lambda side, mine: pairs.join(blocks.select(F.col("root").alias(side), F.col("_b").alias("_n")), side).withColumnRenamed(mine, "root")
    spread = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    lefts = other("right", "left").join(sized, "root").select(F.col("root").alias("left"), "right", F.col("_own").alias("x"), spread.alias("y"), F.lit(True).alias("l"), "pid", "v")
    rights = other("left", "right").join(sized, "root").select("left", F.col("root").alias("right"), spread.alias("x"), F.col("_own").alias("y"), F.lit(False).alias("l"), "pid", "v")

    def compare(cell):
        l, ids, matrix = cell["l"].to_numpy(zero_copy_only=False), cell["pid"].to_numpy(), _matrix(cell["v"].combine_chunks())
        links = matrix[l] @ matrix[~l].T >= threshold
        i, j = np.unravel_index(links.argmax(), links.shape) if links.any() else ([], [])
        return pa.table({"a": np.atleast_1d(ids[l][i]), "b": np.atleast_1d(ids[~l][j])})

    return lefts.unionByName(rights).groupBy("left", "right", "x", "y").applyInArrow(compare, "a long, b long")


def completed(points: DataFrame, members: DataFrame, threshold: float, block: int) -> DataFrame:
    """`(pid, n)`: exact number of links of every point inside its component, copies counted, itself not.

    A component is cut into blocks, and each pair of blocks is one matrix product in one task; only counts leave it.
    """
    sizes = members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_b"))
    placed = members.join(sizes, "root").join(points, "pid").withColumn("_own", F.pmod(F.xxhash64("pid"), F.col("_b")).cast("int"))
    cells = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_b") - 1))).select(
        "root", F.least("_own", "_other").alias("x"), F.greatest("_own", "_other").alias("y"), "_own", "pid", "n", "v")

    def count(cell):
        own, ids, n = cell["_own"].to_numpy(), cell["pid"].to_numpy(), cell["n"].to_numpy()
        x, y = cell["x"][0].as_py(), cell["y"][0].as_py()
        matrix = _matrix(cell["v"].combine_chunks())
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        links = (matrix[left] @ matrix[right].T >= threshold) & (ids[left][:, None] != ids[right][None, :])
        total = np.zeros(len(ids), dtype=np.int64)
        total[left] = links @ n[right]
        if x != y:
            total[right] = n[left] @ links
        return pa.table({"pid": ids, "n": total})

    return cells.groupBy("root", "x", "y").applyInArrow(count, "pid long, n long").groupBy("pid").agg(F.sum("n").alias("n"))


def _linked(points: DataFrame, dimension: int, threshold: float, neighbours: int, trees: int, rounds: int, recall: float, audit: int, block: int, seed: int) -> DataFrame:
    """`(pid, n, root)` for every one of `points(pid, n, v)`: links to other points, their copies counted, and component."""
    count = points.count()
    lists = stored(_kept(first_lists(points, count, dimension, neighbours, trees, seed), neighbours, threshold, 1), "nn-lists")
    reached = there = 0
    for i in range(rounds):
        more = refined(points, lists, neighbours, threshold, 2**i)
        lists = stored(_kept(lists.select("pid", "id", "sim").unionByName(more), neighbours, threshold, 2 ** (i + 1)), "nn-lists")
        links = lists.where(F.col("sim") >= threshold).select(F.col("pid").alias("a"), F.col("id").alias("b"))
        full = lists.where((F.col("sim") >= threshold) & (F.col("rank") >= neighbours)).select("pid").distinct()
        while True:
            members = stored(components(links, "nn-components").select(F.col("node").alias("pid"), "root"), "nn-members")
            placed = stored(members.join(full, "pid").join(points.select("pid", "v"), "pid").select("root", "pid", "v"), "nn-dense")
            found = stored(bridges(placed, dimension, threshold, 2 * neighbours, trees, 4 * block, seed + 1), "nn-bridges")
            if found.isEmpty():
                break
            links = stored(links.unionByName(found), "nn-links")
        inside = stored(completed(points, members, threshold, block), "nn-inside")
        reached, there = audited(points, inside, threshold, audit)
        if reached >= recall * there:
            counted = points.select("pid").join(members, "pid", "left").join(inside, "pid", "left")
            return counted.select("pid", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "pid").alias("root"))
    raise RuntimeError(f"{reached} of {there} audited links were found after {rounds} rounds, less than {recall}")


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, neighbours: int = 10,
                    trees: int = 8, rounds: int = 5, recall: float = 0.99, audit: int = 2048, block: int = 128, seed: int = 11) -> DataFrame:
    """`(vec_id, n_links, component_id)` for every row: links are other rows with a cosine of `threshold` or more.

    Equal vectors become one point first. The points' neighbour lists start from random orders and are refined in
    rounds through neighbours of neighbours; lists full of links may double in each round. Links form components. A full list may
    hide links to another component: components of such points whose centres and radii allow a link are compared point by
    point, until none is new. Inside a component every pair is then compared exactly, so counts are whole there and no
    pair below the threshold is linked. At last the counts of `audit` points are held against all points; below `recall` of their
    links another round follows, and after `rounds` of them the call fails.

    Vectors that are null, zero or hold null or non-finite components link with nothing; vectors of different lengths don't
    link with each other, each length is searched by itself. Repeated rows are vectors of their own and link with each other. The
    smallest identifier names a component; a null identifier never does if there is another. Other columns are ignored, an
    empty table gives an empty result.
    """
    rows = stored(vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v")).withColumn("row", F.monotonically_increasing_id()), "nn-rows")
    good = rows.where(usable(F.col("v")))
    # One point for equal vectors: named by its smallest row, carrying its copies and smallest identifier.
    points = stored(good.groupBy("v").agg(F.min("row").alias("pid"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least")), "nn-points")
    lengths = sorted(r.d for r in points.select(F.size("v").alias("d")).distinct().collect())
    linked = [_linked(points.where(F.size("v") == d).select("pid", "n", "v"), d, threshold, neighbours, trees, rounds, recall, audit, block, seed) for d in lengths]
    linked = reduce(DataFrame.unionByName, linked) if linked else points.select("pid", "n", F.col("pid").alias("root"))
    named = points.select("pid", "n", "least").join(linked.withColumnRenamed("n", "_links"), "pid")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    done = stored(named.join(least, "root").select("pid", (F.col("_links") + F.col("n") - 1).cast("long").alias("n_links"), "component_id"), "nn-done")
    keyed = stored(good.join(points.select("v", "pid"), "v").select("row", "pid"), "nn-keyed")
    result = keyed.join(done, "pid").select("row", "n_links", "component_id")
    return rows.select("row", "vec_id").join(result, "row", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))


@query("op1_nn_descent")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    found = near_duplicates(table(spark, sf, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
