"""Leading principal axes of wide vectors, without a dimension × dimension matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROUNDS = 200
TOLERANCE = 1e-9
#: Directions shorter than this, relative to the vector they come from, hold rounding errors only.
LEAST_PART = 1e-10


def _image(centred: DataFrame, column: str, block: np.ndarray) -> np.ndarray:
    """Scatter matrix of the rows times `block`, (dimension, width): each task adds up its rows, Spark the tasks."""
    dimension, width = block.shape
    names = [f"c{j}" for j in range(width)]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dimension, width))
        for batch in batches:
            rows = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
            total += rows.T @ (rows @ block)
        arrays = [pa.array(np.arange(dimension, dtype=np.int32)), *[pa.array(np.ascontiguousarray(total[:, j])) for j in range(width)]]
        yield pa.RecordBatch.from_arrays(arrays, names=["dimension", *names])

    parts = centred.select(column).mapInArrow(partial, "dimension int, " + ", ".join(f"{c} double" for c in names))
    sums = parts.groupBy("dimension").agg(*[F.sum(c).alias(c) for c in names]).collect()
    out = np.zeros((dimension, width))
    for r in sums:
        out[r["dimension"]] = r[1:]
    return out


def _new_directions(basis: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span what `vectors` add to `basis`."""
    found = basis
    for v in vectors.T:
        length = np.linalg.norm(v)
        if length == 0:
            continue
        v = v / length
        for _ in range(2):
            v = v - found @ (found.T @ v)
        rest = np.linalg.norm(v)
        if rest > LEAST_PART:
            v = v / rest
            v = v - found @ (found.T @ v)
            found = np.column_stack([found, v / np.linalg.norm(v)])
    return found[:, basis.shape[1]:]


def leading_axes(centred: DataFrame, column: str, dimension: int, k: int, width: int | None = None, seed: int = 0) -> np.ndarray:
    """First k principal axes, (dimension, k), of the centred vectors in `column`, by a restarted block iteration.

    A random block of `width` directions (default k + 8) is multiplied with the scatter matrix, one pass over the rows for each
    round. The part of the result outside the directions so far becomes the next block; the best axes inside them are the
    candidates. The iteration ends when the scatter matrix moves every candidate by less than 1e-9 of the largest variance, or when
    the directions fill the space. From k + 4 × width directions on, only the best k + width go on. The driver holds two
    matrices of dimension × (k + 5 × width) at most, and a task one of dimension × width. After 200 rounds it fails.

    Rows without any variance give arbitrary orthonormal axes. Axes of equal variance are one of the possible choices.
    """
    if not 0 < k <= dimension:
        raise ValueError(f"{k} axes of {dimension} dimensions")
    width = min(dimension, width or k + 8)
    draw = np.random.default_rng(seed)
    basis, image = np.zeros((dimension, 0)), np.zeros((dimension, 0))
    block = _new_directions(basis, draw.standard_normal((dimension, width)))
    for _ in range(MAX_ROUNDS):
        basis, image = np.column_stack([basis, block]), np.column_stack([image, _image(centred, column, block)])
        small = basis.T @ image
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        axes = basis @ turns
        moved = image @ turns
        rest = moved - axes * values
        lengths = np.linalg.norm(rest, axis=0)
        if basis.shape[1] == dimension or (basis.shape[1] >= k and lengths[:k].max() <= TOLERANCE * values[0]):
            return axes[:, :k]
        if basis.shape[1] >= k + 4 * width:
            basis, image = axes[:, :k + width], moved[:, :k + width]
        open_axes = np.argsort(-lengths[:max(k, width)], kind="stable")[:width]
        block = _new_directions(basis, rest[:, open_axes])
        if block.shape[1] == 0:  # the directions are closed under the scatter matrix; others may still hold variance
            block = _new_directions(basis, draw.standard_normal((dimension, min(width, dimension - basis.shape[1]))))
    raise RuntimeError(f"the principal axes did not settle in {MAX_ROUNDS} rounds")
