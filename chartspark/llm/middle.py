"""Fill-in-the-middle texts: cut in UTF-8 bytes, with a sparse index of the multibyte characters instead of decoded texts."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartspark.llm import textarrays
from chartspark.llm.common import table, text_bytes
from chartspark.llm.registry import query

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
#: Bytes beyond the first of a character, by its first byte; 0 for ASCII and continuation bytes.
EXCESS = np.array([0 if b < 0xC0 else 1 if b < 0xE0 else 2 if b < 0xF0 else 3 for b in range(256)], dtype=np.int64)


class Exceptions:
    """Where multibyte characters stand in a run of bytes, and how many bytes they have in excess.

    Between two exceptions a byte's place and its character's place differ by a constant, so ASCII stretches
    of any length take no memory, and a cut is converted by one binary search.
    """

    def __init__(self, data: np.ndarray):
        self.bytes_at = np.flatnonzero(data >= 0xC0)
        self.excess = np.concatenate([[0], np.cumsum(EXCESS[data[self.bytes_at]])])
        self.characters_at = self.bytes_at - self.excess[:-1]

    def characters(self, at: np.ndarray) -> np.ndarray:
        """Characters before the byte places `at`, which begin a character or end the data."""
        return at - self.excess[np.searchsorted(self.bytes_at, at)]

    def bytes(self, at: np.ndarray) -> np.ndarray:
        """Bytes before the character places `at`."""
        return at + self.excess[np.searchsorted(self.characters_at, at)]


def unit_starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Byte places where a unit begins: a run of ASCII letters, or any other character. No unit spans two texts, which begin at `begins`."""
    letter = LETTER[data]
    joined = np.zeros(len(data), dtype=bool)
    joined[1:] = letter[1:] & letter[:-1]
    joined[begins[begins < len(data)]] = False
    return np.flatnonzero(~joined & ((data & 0xC0) != 0x80))


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits from the identifier; a null one counts as the empty text."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))


def _transformed(texts: pa.Array, ids: list, rate: int, spm: int, seed: int, units: str) -> dict[str, list]:
    raw = [t.as_py() or b"" for t in texts]
    begins = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    index = Exceptions(data)
    if units == "words":
        starts = np.append(unit_starts(data, begins[:-1]), len(data))
        first = np.searchsorted(starts[:-1], begins)
    else:
        first = index.characters(begins)
    n = np.diff(first)
    drawn = np.array([draws(i, seed) for i in ids], dtype=np.int64).reshape(-1, 4)
    ends = np.sort(drawn[:, :2] % (n + 1)[:, None], axis=1) + first[:-1, None]
    cuts = starts[ends] if units == "words" else index.bytes(ends)
    places = index.characters(cuts) - index.characters(begins[:-1])[:, None]
    cuts -= begins[:-1, None]
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    out: dict[str, list] = {"n": n.tolist(), "form": [], "prefix_chars": [], "middle_chars": [], "output": []}
    for text, (a, b), (p, q), d in zip(raw, cuts.tolist(), places.tolist(), drawn.tolist(), strict=True):
        if not text or d[2] % 100 >= rate or any(m in text for m in marks):
            got = ("plain", None, None, text)
        else:
            parts = [marks[0] + text[:a], marks[1] + text[b:]]
            form = "spm" if d[3] % 100 < spm else "psm"
            got = (form, p, q - p, b"".join(parts[::-1] if form == "spm" else parts) + marks[2] + text[a:b])
        for name, value in zip(("form", "prefix_chars", "middle_chars", "output"), got, strict=True):
            out[name].append(value)
    return out


def fill_in_middle(docs: DataFrame, rate: int = 90, spm: int = 20, seed: int = 1, units: str = "words",
                   doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`(doc_id, n, form, prefix_chars, middle_chars, output)` for every row of `docs`.

    A text is cut at two of its units: with `units="words"` runs of ASCII letters and single other characters,
    with `units="characters"` code points. `n` counts the units. `rate` of 100 texts are reordered,
    `spm` of 100 of those with the suffix first; all draws are a hash of `seed` and identifier. `prefix_chars`
    and `middle_chars` count code points. Texts are cut as bytes and never decoded.

    Form `plain` leaves the text as it is: empty and null texts, texts that hold a mark, and those not drawn; its counts
    are null. A null identifier counts as the empty text. Repeated rows stay repeated. Other columns are ignored; an empty
    table gives an empty result.
    """
    if units not in ("words", "characters"):
        raise ValueError("units are words or characters")

    def each(batches):
        for batch in batches:
            for at, part in textarrays.chunks(batch.column("_t")):
                ids = batch.column("doc_id").slice(at, len(part))
                made = _transformed(part, ids.to_pylist(), rate, spm, seed, units)
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(made["n"], type=pa.int64()), pa.array(made["form"], type=pa.string()), pa.array(made["prefix_chars"], type=pa.int64()),
                    pa.array(made["middle_chars"], type=pa.int64()), pa.array(made["output"], type=pa.binary()).cast(pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("_t"))
    return rows.mapInArrow(each, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text before the transformation. Marks are found in order; no part holds one, and none overlaps itself."""
    after = lambda whole, part: F.substring(whole, F.length(part) + len(MIDDLE) + 1, F.length(whole))
    rest = F.substring(output, F.lit(len(PREFIX) + 1), F.length(output))
    one = F.when(form == "spm", F.substring_index(rest, PREFIX, 1)).otherwise(F.substring_index(rest, SUFFIX, 1))
    two = F.substring_index(after(rest, one), MIDDLE, 1)
    middle = after(after(rest, one), two)
    moved = F.when(form == "spm", F.concat(two, middle, one)).otherwise(F.concat(one, middle, two))
    return F.when(form == "plain", output).otherwise(moved)


OP12_SQL = """
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d
  FROM documents
), drawn AS (
  SELECT *, len(u) AS n, [('0x' || substr(d, 8 * i + 1, 8))::UBIGINT::BIGINT FOR i IN [0, 1, 2, 3]] AS h FROM cut
), formed AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
              WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""


@query("op12_fill_in_middle", OP12_SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
