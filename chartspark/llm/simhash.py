"""SimHash near-duplicates: a vantage-point tree over 64-bit fingerprints, queried exactly by triangle bounds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartspark.llm.common import map_rows, numbered, row_number, stored, table, text_bytes, where_row
from chartspark.llm.components import components
from chartspark.llm.registry import query

BITS = 64
CHUNK = 1 << 15


def fingerprint_of(text: bytes, words: int = 3, seed: int = 42) -> int:
    """SimHash of a text's word shingles, repeats included: a bit is 1 if set in over half of their hashes."""
    found = text.lower().split()
    if not found:
        return 0
    total, ones = max(1, len(found) - words + 1), np.zeros(BITS, dtype=np.int64)
    for at in range(0, total, CHUNK):
        part = found[at : at + CHUNK + words - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(words)), strict=False)) if len(found) >= words else [b" ".join(found)]
        hashes = np.array([xxhash.xxh64_intdigest(x, seed) for x in shingles], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(ones * 2 > total).tolist())


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """`(doc_id, fp)` for every row; a null or empty text has fingerprint 0."""

    def convert(rows):
        for row in rows:
            value = fingerprint_of(row["_t"], words)
            yield {"doc_id": row["doc_id"], "fp": value - (1 << 64) if value >> 63 else value}

    return map_rows(docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("_t")), convert, "doc_id long, fp long")


def plan_levels(sample: np.ndarray, depth: int, seed: int = 7) -> list[tuple[int, int, int]]:
    """Levels of the tree as (mask, vantage, threshold).

    Level i measures the Hamming distance to its vantage point on its own block of bits, and
    halves the points at the median of a bounded sample. Blocks are disjoint, so the triangle
    bounds of all levels add up: two fingerprints within r bits differ by at most r over all
    levels together, and a query needs only the leaves whose crossed boundaries cost r in sum.
    """
    depth = min(BITS // 2, depth) if len(sample) else 0
    if not depth:
        return []
    rng = np.random.default_rng(seed)
    order, levels = rng.permutation(BITS), []
    for bits in np.array_split(order, depth):
        mask = int(sum(1 << int(b) for b in bits))
        best = None
        for vantage in rng.choice(sample, min(8, len(sample)), replace=False):
            d = np.bitwise_count((sample ^ vantage) & np.uint64(mask))
            for t in range(len(bits)):
                share = float((d <= t).mean())
                if best is None or abs(share - 0.5) < best[0]:
                    best = (abs(share - 0.5), int(vantage), t)
        levels.append((mask, best[1], best[2]))
    return levels


def balls(fps: np.ndarray, levels: list[tuple[int, int, int]], radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, own leaf): every leaf that a fingerprint's ball meets.

    Crossing a level's boundary costs the distance left to it; crossings are added level by
    level as long as their sum fits into the radius.
    """
    rows, flips, spent = np.arange(len(fps)), np.zeros(len(fps), dtype=np.int64), np.zeros(len(fps), dtype=np.int64)
    code = np.zeros(len(fps), dtype=np.int64)
    for i, (mask, vantage, threshold) in enumerate(levels):
        d = np.bitwise_count((fps ^ np.uint64(vantage)) & np.uint64(mask)).astype(np.int64)
        code |= (d > threshold).astype(np.int64) << i
        cost = np.where(d > threshold, d - threshold, threshold + 1 - d)
        more = np.flatnonzero(spent + cost[rows] <= radius)
        rows, flips, spent = (np.concatenate(x) for x in (
            (rows, rows[more]), (flips, flips[more] | 1 << i), (spent, spent[more] + cost[rows[more]])))
    return rows, code[rows] ^ flips, code[rows]


def shards_of(fps: np.ndarray, levels: list[tuple[int, int, int]], radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, home): each fingerprint's own leaf and every smaller one that its ball meets. Of two leaves that see the same pair, only the smaller one is queried."""
    rows, leaf, own = balls(fps, levels, radius)
    keep = leaf <= own
    return rows[keep], leaf[keep], leaf[keep] == own[keep]


def with_shards(points: DataFrame, levels: list[tuple[int, int, int]], radius: int) -> DataFrame:
    """`(leaf, fp, home)`: every fingerprint in its own leaf, and as a query in each leaf that its ball meets."""

    def each(batches):
        import pyarrow as pa

        for batch in batches:
            fps = batch.column(0).to_numpy()
            for at in range(0, len(fps), 4096):
                part = fps[at : at + 4096]
                rows, leaf, home = shards_of(part.view(np.uint64), levels, radius)
                yield pa.RecordBatch.from_pydict({"leaf": leaf, "fp": part[rows], "home": home})

    return points.select("fp").mapInArrow(each, "leaf long, fp long, home boolean")


def pairs_within(points: np.ndarray, queries: np.ndarray, radius: int, leaf: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, point) pairs of places within `radius` bits, by a tree of the points' own: a cell's work grows little faster than its size."""
    levels = plan_levels(points[:: max(1, len(points) // 2048)], max(0, math.ceil(math.log2(max(1, len(points)) / leaf))))
    zero = np.zeros(len(points), dtype=np.int64)
    home = balls(points, levels, -1)[2] if levels else zero
    by_leaf = np.argsort(home, kind="stable")
    leaves, first = np.unique(home[by_leaf], return_index=True)
    first = np.append(first, len(points))
    for start in range(0, len(queries), 1 << 15):
        rows, met, _ = balls(queries[start : start + (1 << 15)], levels, radius)
        order = np.argsort(met, kind="stable")
        rows, met = rows[order] + start, met[order]
        for k, one in enumerate(leaves):
            own, asked = by_leaf[first[k] : first[k + 1]], rows[np.searchsorted(met, one) : np.searchsorted(met, one, side="right")]
            for a in range(0, len(asked), 512):
                for b in range(0, len(own), 1 << 14):
                    part = own[b : b + (1 << 14)]
                    i, j = np.nonzero(np.bitwise_count(queries[asked[a : a + 512], None] ^ points[None, part]) <= radius)
                    yield asked[a + i], part[j]


def linked_fingerprints(points: DataFrame, radius: int = 2, leaf: int = 1 << 15, cell: int = 1 << 30, sample: int = 4096) -> DataFrame:
    """Edges `(a, b)` whose components are exactly those of all pairs of fingerprints within `radius` bits.

    `points(fp)` holds distinct fingerprints. The shared tree has 16 leaves at least and goes on until a leaf has
    about `leaf` points; below it every cell searches a tree of its own, so a query goes to few places however
    large the table is. Leaves with more than `cell` pairs of point and query are cut into a grid of cells, so no
    task holds a whole hot leaf, and a cell returns a spanning forest of the pairs it verified, not the pairs.
    """
    count = points.count()
    some = points.orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()
    depth = max(4, math.ceil(math.log2(max(1, count) / leaf))) if count > 16 else 0
    levels = plan_levels(np.array([r.fp for r in some], dtype=np.int64).view(np.uint64), depth)
    shards = stored(with_shards(points, levels, radius), "simhash-shards")
    sizes = shards.groupBy("leaf").agg(F.sum(F.col("home").cast("long")).alias("_p"), F.count(F.lit(1)).alias("_a"))
    # Both sides are cut into pieces of about the root of `cell`, unless one is smaller than that.
    side = math.isqrt(cell)
    pieces = lambda n, other: F.ceil(F.col(n) / F.greatest(F.lit(side), F.lit(cell) / F.greatest(F.col(other), F.lit(1)))).cast("int")
    sized = shards.join(sizes.select("leaf", pieces("_p", "_a").alias("_h"), pieces("_a", "_p").alias("_q")), "leaf").where(F.col("_h") > 0)
    spread = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    mine = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    asked = sized.select("leaf", "fp", F.explode(spread("_h")).alias("hb"), mine("_q").alias("qb"), F.lit(False).alias("home"))
    homes = sized.where("home").select("leaf", "fp", mine("_h").alias("hb"), F.explode(spread("_q")).alias("qb"), F.lit(True).alias("home"))

    def forest(cell):
        import pyarrow as pa

        fp, home = cell["fp"].to_numpy(), cell["home"].to_numpy(zero_copy_only=False)
        points, queries = fp[home].view(np.uint64), fp[~home].view(np.uint64)
        every, place = np.unique(np.concatenate([points, queries]), return_inverse=True)
        h, q = place[: len(points)], place[len(points) :]
        label, held, size = np.arange(len(every)), [], 0

        def joined(pairs):
            """Labels after the pairs: the smallest place of each component."""
            nonlocal label
            u, v = (np.concatenate(x) for x in zip(*pairs, strict=True))
            while True:
                low = np.minimum(label[u], label[v])
                new = label.copy()
                for end in (u, v, label[u], label[v]):
                    np.minimum.at(new, end, low)
                new = new[new]
                if (new == label).all():
                    return
                label = new

        for i, j in pairs_within(points, queries, radius):
            keep = label[q[i]] != label[h[j]]
            held.append((q[i[keep]], h[j[keep]]))
            size += len(held[-1][0])
            if size > 1 << 20:
                joined(held)
                held, size = [], 0
        if size:
            joined(held)
        moved = np.flatnonzero(label != np.arange(len(every)))
        return pa.table({"a": every[moved].view(np.int64), "b": every[label[moved]].view(np.int64)})

    return homes.unionByName(asked).groupBy("leaf", "hb", "qb").applyInArrow(forest, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 2, words: int = 3) -> DataFrame:
    """`(doc_id, fp, component_id)` for every row of `docs`.

    Texts whose fingerprints differ in at most `radius` bits are linked; `component_id` is the
    smallest identifier reachable over links. Repeated rows stay repeated. Null and empty texts
    share fingerprint 0; a null identifier keeps its row but never names a component that has
    another identifier. Other columns are ignored. An empty table gives an empty result.
    """
    prints = stored(fingerprints(docs, doc_id, text, words), "simhash-prints")
    points = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-points")
    roots = components(linked_fingerprints(points.select("fp"), radius), "simhash-components")
    grouped = points.join(roots, points["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stored(grouped.join(smallest, "root").select("fp", "component_id"), "simhash-named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, radius: int = 2) -> DataFrame:
    """Rows of `docs` without near copies: of each component one row stays, that of the smallest identifier.

    Repeated rows of one identifier are copies too: one of them stays, whole. Rows without an
    identifier are kept if no row with one is linked to them, and then one of them stays. The
    columns are those of `docs`.
    """
    rows = numbered(docs, "simhash-rows")
    texts = rows.select(row_number().alias("row"), F.col("doc.doc_id").alias("own"), F.col("doc.text").alias("text"))
    groups = near_duplicates(texts, "row", "text", radius).select(F.col("doc_id").alias("row"), "component_id")
    chosen = texts.select("row", "own").join(groups, "row").groupBy("component_id").agg(F.min(F.struct(F.col("own").isNull(), "own", "row")).alias("first"))
    return where_row(rows, chosen.select("first.row"))


@query("op8_simhash_neardup")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    found = near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
