"""Near copies by exact Jaccard similarity of word shingles, found through a SimHash tree and banded min-hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartspark.llm import simhash, textarrays
from chartspark.llm.common import numbered, row_number, stored, text_bytes, where_row
from chartspark.llm.components import components

#: Longs of a text's parity signature.
LONGS = 8
#: Bytes of text whose sets are held at once; they take some 60 times as much.
HELD = 1 << 19


def shingle_sets(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    """Sorted different shingle hashes of each text; one of all its words if it has fewer than `shingle`, none if it has no words."""
    words = textarrays.words_of(texts)
    hashes, out = textarrays.shingles(words.hashes, shingle), []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        own = hashes[a : b - shingle + 1] if b - a >= shingle else textarrays.shingles(words.hashes[a:b], int(b - a)) if b > a else hashes[:0]
        out.append(np.unique(own))
    return out


def _parity(own: np.ndarray) -> np.ndarray:
    """Parity of the hashes that fall on each of the signature's bits: every bit in which two signatures differ is a hash that only one set has."""
    bits = np.bincount((own >> np.uint64(8)).astype(np.int64) & (64 * LONGS - 1), minlength=64 * LONGS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _print(own: np.ndarray) -> int:
    """SimHash of a set."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(own), 1 << 15):
        ones += np.unpackbits(own[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(own), bitorder="little").view(np.int64)[0])


def band_keys(sets: list[np.ndarray], bands: int, width: int) -> np.ndarray:
    """A row of `bands` keys for each set, which must not be empty: each stands for the sets' minima under `width` hash functions."""
    flat, first = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    keys = np.zeros((len(sets), bands), dtype=np.uint64)
    for band in range(bands):
        total = np.full(len(sets), np.uint64(band + 1))
        for f in range(width):
            total = total * textarrays.FACTOR + np.minimum.reduceat(textarrays.with_seed(flat, band * width + f), first)
        keys[:, band] = textarrays.mixed(total)
    return keys


def _marked(rows: DataFrame, shingle: int, bands: int, width: int) -> DataFrame:
    """`(row, n, d0, d1, fp, keys, s0 …)`: size of each text's set, two digests of it, its fingerprint, band keys and signature."""
    signs = [f"s{i}" for i in range(LONGS)]

    def each(batches):
        for batch in batches:
            for at, part in textarrays.chunks(batch.column("_t"), HELD):
                sets = shingle_sets(part, shingle)
                sums = [[int(textarrays.with_seed(s, k).sum(dtype=np.uint64)) if len(s) else 0 for s in sets] for k in (0, 1)]
                signature = np.array([_parity(s) for s in sets], dtype=np.int64).reshape(-1, LONGS)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys: list = [[]] * len(sets)
                if full:
                    for i, own in zip(full, band_keys([sets[i] for i in full], bands, width).view(np.int64), strict=True):
                        keys[i] = own
                yield pa.RecordBatch.from_arrays([
                    batch.column("row").slice(at, len(part)), pa.array([len(s) for s in sets], type=pa.int64()),
                    *(pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in sums), pa.array([_print(s) for s in sets], type=pa.int64()),
                    pa.array(keys, type=pa.list_(pa.int64())), *(pa.array(signature[:, i]) for i in range(LONGS))],
                    names=["row", "n", "d0", "d1", "fp", "keys", *signs])

    return rows.select("row", "_t").mapInArrow(each, "row long, n long, d0 long, d1 long, fp long, keys array<long>, " + ", ".join(f"{s} long" for s in signs))


def _sets(rows: DataFrame, shingle: int) -> DataFrame:
    def each(batches):
        for batch in batches:
            for at, part in textarrays.chunks(batch.column("_t"), HELD):
                held = [s.tobytes() for s in shingle_sets(part, shingle)]
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(at, len(part)), pa.array(held, type=pa.binary())], names=["row", "hashes"])

    return rows.select("row", "_t").mapInArrow(each, "row long, hashes binary")


def _possible(a: str, b: str, similarity: float) -> Column:
    """Neither the sizes nor the signatures of two texts rule the similarity out."""
    left, right = F.col(f"{a}n"), F.col(f"{b}n")
    differ = sum((F.bit_count(F.col(f"{a}s{i}").bitwiseXOR(F.col(f"{b}s{i}"))) for i in range(LONGS)), F.lit(0))
    return (F.least(left, right) >= F.greatest(left, right) * similarity - 1e-6) & (
        differ <= (left + right) * ((1 - similarity) / (1 + similarity)) + 1e-6)


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those `(a, b)` whose sets are similar enough. Only texts in these pairs have their sets written."""
    pairs = stored(pairs, "copies-pairs")
    needed = stored(pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct(), "copies-needed")
    sets = stored(_sets(texts.join(needed, "row", "left_semi"), shingle), "copies-sets")

    def each(batches):
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_py(), dtype=np.uint64) for c in ("x", "y"))
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(same >= similarity * (len(x) + len(y) - same) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, type=pa.bool_()))

    both = pairs.join(sets.select(F.col("row").alias("b"), F.col("hashes").alias("y")), "b").join(
        sets.select(F.col("row").alias("a"), F.col("hashes").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(each, "a long, b long")


def _near_prints(points: DataFrame) -> DataFrame:
    """`(a, b)`: points whose fingerprints the vantage-point tree puts together, each with the smallest point of its own or the joined fingerprint."""
    own = stored(points.groupBy("fp").agg(F.min("row").alias("first")), "copies-prints")
    edges = stored(simhash.linked_fingerprints(own.select("fp")), "copies-tree")
    equal = points.select("row", "fp").join(own, "fp").where(F.col("row") != F.col("first")).select(F.col("row").alias("a"), F.col("first").alias("b"))
    first = lambda side: own.select(F.col("fp").alias(side), F.col("first").alias(f"{side}_"))
    joined = edges.join(first("a"), "a").join(first("b"), "b")
    return equal.unionByName(joined.select(F.greatest("a_", "b_").alias("a"), F.least("a_", "b_").alias("b")))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """`labels(row, root)` after `links(a, b)` between rows."""
    ends = [labels.select(F.col("row").alias(c), F.col("root").alias(f"{c}_")) for c in ("a", "b")]
    joined = components(links.join(ends[0], "a").join(ends[1], "b").select(F.col("a_").alias("a"), F.col("b_").alias("b")), "copies-roots")
    joined = joined.select(F.col("node").alias("root"), F.col("root").alias("new"))
    return stored(labels.join(joined, "root", "left").select("row", F.coalesce("new", "root").alias("root")), "copies-labels")


def _unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """`(key, row, c, root)` of the keys whose rows are not yet in one component."""
    labelled = members.select("key", "row", "c").join(labels, "row")
    open_keys = labelled.groupBy("key").agg(F.min("root").alias("_l"), F.max("root").alias("_h")).where(F.col("_l") < F.col("_h")).select("key")
    return labelled.join(open_keys, "key")


def near_copies(rows: DataFrame, shingle: int = 5, similarity: float = 0.8, bands: int = 20, width: int = 5, block: int = 1024,
                pivots: int = 1) -> DataFrame:
    """`(row, root)` for every row of `rows(row, text)`: texts are linked whose shingle sets have a Jaccard similarity of `similarity` or more.

    Texts of equal sets count as one. Candidates are pairs that the vantage-point tree finds within two bits of SimHash, and pairs that share
    one of `bands` keys, each of `width` min-hashes: a pair at a similarity of exactly 0.8 shares one with probability 0.9996, a closer one sooner.
    First every text is compared with the smallest text of each of its keys, then `pivots` times with two texts drawn from each key that
    is not yet in one component, and at last all pairs of such a key are compared, in blocks, unless sizes or signatures rule them out. So a
    large group of copies costs a few comparisons for each member. Every pair is verified on its whole sets.

    Words are lower-cased (A-Z) and end at white space. Null and empty texts are equal. `row` must be different in every row.
    """
    texts = rows.select("row", text_bytes().alias("_t"))
    marked = stored(_marked(texts, shingle, bands, width), "copies-marked")
    signs = [f"s{i}" for i in range(LONGS)]
    same = stored(marked.groupBy("n", "d0", "d1").agg(F.min("row").alias("point"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "copies-points")
    near = stored(_near_prints(same.where(F.col("n") > 0).select(F.col("point").alias("row"), "fp")), "copies-near")
    keyed = stored(same.select(F.col("point").alias("row"), F.explode("keys").alias("key")), "copies-keys")
    shared = keyed.groupBy("key").agg(F.min("row").alias("low"), F.max("row").alias("high"), F.count(F.lit(1)).alias("c")).where(F.col("low") < F.col("high"))
    members = stored(keyed.join(shared.select("key", "low", "c"), "key"), "copies-members")
    met = members.select("row").unionByName(near.select(F.col("a").alias("row"))).unionByName(near.select(F.col("b").alias("row"))).distinct()
    known = stored(marked.select("row", "n", *signs).join(met, "row", "left_semi"), "copies-known")

    def of(side: str) -> DataFrame:
        return known.select(F.col("row").alias(side), F.col("n").alias(f"{side}n"), *(F.col(s).alias(f"{side}{s}") for s in signs))

    stars = members.where(F.col("row") > F.col("low")).select(F.col("row").alias("a"), F.col("low").alias("b")).unionByName(near).distinct()
    stars = stars.join(of("a"), "a").join(of("b"), "b").where(_possible("a", "b", similarity)).select("a", "b")
    links = stored(_verified(stars, texts, shingle, similarity), "copies-links")
    labels = _merged(members.select("row", F.col("row").alias("root")).distinct(), links)
    for i in range(pivots):
        unsettled = stored(_unsettled(members, labels), "copies-unsettled")
        if unsettled.isEmpty():
            break
        order = F.xxhash64("row", "key", F.lit(i))
        chosen = unsettled.groupBy("key").agg(*(f(c, order).alias(f"{c}{k}") for k, f in enumerate((F.min_by, F.max_by)) for c in ("row", "root")))
        rays = unsettled.join(chosen, "key").select("row", "root", F.inline(F.array(*(F.struct(F.col(f"row{k}").alias("to"), F.col(f"root{k}").alias("to_root")) for k in (0, 1)))))
        rays = rays.where(F.col("root") != F.col("to_root")).select(F.greatest("row", "to").alias("a"), F.least("row", "to").alias("b")).distinct()
        rays = rays.join(of("a"), "a").join(of("b"), "b").where(_possible("a", "b", similarity)).select("a", "b")
        more = stored(_verified(rays, texts, shingle, similarity), "copies-more")
        links, labels = links.unionByName(more), _merged(labels, more)
    cells = _unsettled(members, labels).join(known, "row").withColumn("_n", F.ceil(F.col("c") / block).cast("int"))
    cells = stored(cells.withColumn("_own", F.pmod(F.xxhash64("row"), F.col("_n")).cast("int")), "copies-cells")
    # A pair of blocks meets in one cell, the lower block as left side; inside a block the larger row is on the left.
    left = cells.select("key", F.col("_own").alias("x"), F.explode(F.sequence("_own", F.col("_n") - 1)).alias("y"), F.col("row").alias("a"),
                        F.col("root").alias("aroot"), F.col("n").alias("an"), *(F.col(s).alias(f"a{s}") for s in signs))
    right = cells.select("key", F.explode(F.sequence(F.lit(0), "_own")).alias("x"), F.col("_own").alias("y"), F.col("row").alias("b"),
                         F.col("root").alias("broot"), F.col("n").alias("bn"), *(F.col(s).alias(f"b{s}") for s in signs))
    rest = left.join(right, ["key", "x", "y"]).where(
        (F.col("aroot") != F.col("broot")) & ((F.col("x") != F.col("y")) | (F.col("a") > F.col("b"))) & _possible("a", "b", similarity))
    more = stored(_verified(rest.select("a", "b").distinct(), texts, shingle, similarity), "copies-more")
    final = components(links.unionByName(more), "copies-components")
    named = stored(same.join(final, F.col("point") == F.col("node"), "left").select("n", "d0", "d1", F.coalesce("root", "point").alias("root")), "copies-named")
    return marked.select("row", "n", "d0", "d1").join(named, ["n", "d0", "d1"]).select("row", "root")


def keep_first(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Rows of `docs` without near copies: of each component one row stays, that of the smallest identifier.

    Repeated rows of one identifier are copies too: one of them stays, whole. Rows without an
    identifier are kept if no row with one is linked to them, and then one of them stays. The
    columns are those of `docs`.
    """
    rows = numbered(docs, "copies-rows")
    texts = rows.select(row_number().alias("row"), F.col("doc.doc_id").alias("own"), F.col("doc.text").alias("text"))
    members = texts.select("row", "own").join(near_copies(texts, shingle, similarity), "row")
    chosen = members.groupBy("root").agg(F.min(F.struct(F.col("own").isNull(), "own", "row")).alias("first"))
    return where_row(rows, chosen.select("first.row"))
