"""Tables, stored intermediate results and row keys shared by the operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartspark.session import BATCH_BYTES, scratch_dir, set_small_batches  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of BATCH_BYTES for what is run inside; the session's own setting is back afterwards."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write `df` below spark.checkpoint.dir and read it back: lineage ends here and no row is computed twice."""
    path = scratch_dir(df.sparkSession, label)
    with small_batches(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(taken: Iterable[str], name: str) -> str:
    """`name`, with underscores added until no column of `taken` has it, in whatever case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


#: Rows of a run.
RUN = 1 << 14


def numbered(docs: DataFrame, label: str, **more: Column) -> DataFrame:
    """`(doc, run, place, …)`: `docs` as one column, stored with a number for every row: run and place in it.

    The rows are stored in buckets by run, so what is joined to them by the run is the only side to be shuffled.
    Columns of `more` are computed from `doc`.
    """
    spark, row = docs.sparkSession, F.col("row")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.monotonically_increasing_id().alias("row"))
    rows = rows.select("doc", F.shiftright(row, RUN.bit_length() - 1).alias("run"), row.bitwiseAND(F.lit(RUN - 1)).cast("int").alias("place"),
                       *(c.alias(name) for name, c in more.items()))
    buckets, name = max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), f"rows_{uuid.uuid4().hex}"
    rows.write.bucketBy(buckets, "run").option("path", scratch_dir(spark, label)).format("parquet").saveAsTable(name)
    kept = spark.table(name)
    # The frame knows its files by now; the name is of no more use, and the files stay in the scratch folder.
    spark.sql(f"DROP TABLE {name}")
    return kept


def row_number() -> Column:
    """The number of a row of `numbered`."""
    return F.col("run") * RUN + F.col("place")


def where_row(rows: DataFrame, chosen: DataFrame, stay: bool = True) -> DataFrame:
    """Documents of `numbered` rows whose number is in `chosen(row)`, or is not. Each run gets a bitmap of its places; no text is shuffled."""
    bit = F.expr("shiftleft(1L, cast(row & 63 as int))")
    words = chosen.groupBy(F.shiftright("row", RUN.bit_length() - 1).alias("run"), F.shiftright(F.col("row").bitwiseAND(F.lit(RUN - 1)), 6).cast("int").alias("w")).agg(F.bit_or(bit).alias("b"))
    maps = words.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("w", "b"))).alias("_bits"))
    joined = rows.join(stored(maps, "rows-chosen").hint("shuffle_hash"), "run", "left")
    own = F.getbit(F.try_element_at("_bits", F.shiftright("place", 6)), F.col("place").bitwiseAND(F.lit(63)))
    return joined.where(F.coalesce(own == 1, F.lit(False)) == F.lit(stay)).select("doc.*")


def text_bytes(text: str | Column = "text") -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def crc_of_id(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the identifier as text; a null identifier counts as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def row_numbers() -> Iterator[int]:
    """Numbers that no other task gives out. Store the rows that carry them before using them twice."""
    first = TaskContext.get().partitionId() << 36
    while True:
        yield first
        first += 1


def map_rows(df: DataFrame, convert: Callable[[Iterator[dict]], Iterator[dict]], schema: T.StructType | str, rows: int = 2000) -> DataFrame:
    """Rows in, rows out, in Arrow batches of at most `rows` output rows.

    `convert` sees one iterator per task, so it may set up tables or caches first.
    """
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def each(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kind)
        names = [f.name for f in kind.fields]

        def source():
            for batch in batches:
                columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
                for i in range(batch.num_rows):
                    yield {name: column[i].as_py() for name, column in columns.items()}

        held: list[dict] = []
        for row in convert(source()):
            held.append(row)
            if len(held) >= rows:
                yield pa.RecordBatch.from_pydict({n: [r[n] for r in held] for n in names}, schema=arrow)
                held = []
        if held:
            yield pa.RecordBatch.from_pydict({n: [r[n] for r in held] for n in names}, schema=arrow)
        held.clear()
        # Workers are used again; what their buffers took goes back to the system.
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(each, kind)
