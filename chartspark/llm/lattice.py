"""Document likelihood under a subword vocabulary, summed over all segmentations of every word."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartspark.llm.common import crc_of_id, map_rows, row_numbers, stored, table, text_bytes
from chartspark.llm.registry import query

MARK = "▁"
HELD = 300_000


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space."""
    return text.lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """`(word, c)`: all words of `docs(_t, held_out)` with their uses in rows that are not held out.

    Words are summed in each task, at most HELD different ones at a time, before the shuffle.
    """

    def convert(rows: Iterator[dict]) -> Iterator[dict]:
        seen: Counter = Counter()
        for row in rows:
            found = words_of(row["_t"])
            if row["held_out"]:
                for w in found:
                    seen.setdefault(w, 0)
            else:
                seen.update(found)
            if len(seen) > HELD:
                yield from ({"word": w, "c": c} for w, c in seen.items())
                seen.clear()
        yield from ({"word": w, "c": c} for w, c in seen.items())

    partial = map_rows(docs.select("_t", "held_out"), convert, "word binary, c long", rows=20_000)
    return partial.groupBy("word").agg(F.sum("c").alias("c"))


def piece_counts(words: DataFrame, path: str) -> dict[int, float]:
    """Uses of each vocabulary entry when every counted word is segmented; at most one number per entry of the vocabulary."""

    def convert(rows: Iterator[dict]) -> Iterator[dict]:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        seen: Counter = Counter()
        held: list[tuple[str, int]] = []

        def count():
            for ids, (_, c) in zip(model.encode([w for w, _ in held], num_threads=1), held, strict=True):
                for i in ids:
                    seen[i] += c
            held.clear()

        for row in rows:
            held.append((row["word"].decode(), row["c"]))
            if len(held) >= 2000:
                count()
        count()
        yield from ({"piece": i, "c": c} for i, c in seen.items())

    return {r.piece: r.c for r in map_rows(words, convert, "piece int, c long").groupBy("piece").agg(F.sum("c").alias("c")).collect()}


class Lattice:
    """Log10 probability of a word as the sum over all its segmentations into vocabulary entries.

    A word starts with the vocabulary's word mark. A character with no entry of its own can
    also be spelled by the byte entries, so every word has a segmentation.
    """

    def __init__(self, path: str, counts: dict[int, float], ends: int, smoothing: float = 0.1):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        total = sum(counts.values()) + ends + smoothing * (size + 1)
        self.pieces: dict[str, float] = {}
        self.bytes = [0.0] * 256
        for i in range(size):
            piece, p = model.id_to_piece(i), (counts.get(i, 0) + smoothing) / total
            if model.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = math.log(p)
            elif not (model.is_control(i) or model.is_unknown(i)) and MARK not in piece[1:]:
                self.pieces[piece] = math.log(p)
        self.end = math.log10((ends + smoothing) / total)
        #: Every beginning of an entry: its log probability if it is an entry itself, else None.
        self.begins: dict[str, float | None] = {}
        for piece, p in self.pieces.items():
            for j in range(2, len(piece)):
                self.begins.setdefault(piece[:j], None)
            if len(piece) > 1:
                self.begins[piece] = p
        self.single: dict[str, float] = {}

    def _one(self, char: str, first: bool) -> float:
        """A single character: as an entry, or spelled by bytes. The mark stands for a word's start only; inside a word it is spelled."""
        spelled = sum(self.bytes[b] for b in char.encode())
        p = self.pieces.get(char) if first or char != MARK else None
        return spelled if p is None else max(p, spelled) + math.log1p(math.exp(-abs(p - spelled)))

    def log10(self, word: str) -> float:
        text, n = MARK + word, len(word) + 1
        paths: list[list[float]] = [[] for _ in range(n + 1)]
        begins, single, exp, forward = self.begins, self.single, math.exp, 0.0
        for i in range(n):
            if i:
                held = paths[i]
                if len(held) == 1:
                    forward = held[0]
                else:
                    high = max(held)
                    forward = high + math.log(sum([exp(x - high) for x in held]))
            char = text[i]
            if i and (one := single.get(char)) is not None:
                paths[i + 1].append(forward + one)
            else:
                one = self._one(char, i == 0)
                if i and len(single) < HELD:
                    single[char] = one
                paths[i + 1].append(forward + one)
            if i and char == MARK:
                continue
            for j in range(i + 2, n + 1):
                p = begins.get(text[i:j], 1.0)
                if p is None:
                    continue
                if p > 0:
                    break
                paths[j].append(forward + p)
        held = paths[n]
        high = max(held)
        return (high + math.log(sum([exp(x - high) for x in held]))) / math.log(10)


def word_marginals(words: DataFrame, path: str, counts: dict[int, float], ends: int) -> DataFrame:
    """`(word, c, m)`: m is the word's log10 probability, computed once for each different word."""
    shared = words.sparkSession.sparkContext.broadcast(counts)

    def convert(rows: Iterator[dict]) -> Iterator[dict]:
        lattice = Lattice(path, shared.value, ends)
        for row in rows:
            yield {**row, "m": lattice.log10(row["word"].decode())}

    return map_rows(words, convert, "word binary, c long, m double", rows=20_000)


def scored(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", frequent: int = 50_000, held_out: int = 10) -> DataFrame:
    """Score every row: `doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`.

    Learns from the rows whose crc32 of the identifier as text is no multiple of `held_out`:
    counts of words and, through them, of vocabulary entries. `score` is the log10 probability of
    the whole text, the sum over its words of the lattice's marginal probability and one end.
    `base_score` adds the smoothed unigram probability of every word and the end.

    Marginals are computed once for each different word. At most `frequent` frequent words are looked up
    inside the tasks; all others are joined with the full table of words. Null and empty texts
    hold the end only; a null identifier counts as the empty text; repeated rows are counted and
    returned each; other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    crc = crc_of_id(doc_id)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("_t"), (crc % held_out == 0).alias("held_out"))
    words = stored(word_counts(rows), "lattice-words")
    ends = rows.where(~F.col("held_out")).count()
    total = words.where(F.col("c") > 0).agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    tokens, distinct = int(total.n) + ends, total.v + (ends > 0)
    below = math.log10(tokens + 0.1 * (distinct + 1))
    pieces = piece_counts(words.where(F.col("c") > 0), path)
    words = stored(word_marginals(words, path, pieces, ends), "lattice-marginals")
    # Few words are more frequent than one in two million, so few rows are sorted.
    often = words.where(F.col("c") >= tokens / 2e6).orderBy(F.desc("c"), "word").limit(frequent)
    shared = spark.sparkContext.broadcast({bytes(r.word): (r.c, r.m) for r in often.collect()})
    last = Lattice(path, pieces, ends).end

    def convert(source: Iterator[dict]) -> Iterator[dict]:
        number = row_numbers()
        known = {w: (math.log10(c + 0.1) - below, m) for w, (c, m) in shared.value.items() if c}
        end = math.log10(ends + 0.1) - below
        for row in source:
            found = words_of(row["_t"])
            score, sure, n_known, rare = last, end, int(ends > 0), []
            for w, n in Counter(found).items():
                both = known.get(w)
                if both is None:
                    rare.append({"word": w, "n": n})
                else:
                    sure += n * both[0]
                    score += n * both[1]
                    n_known += n
            yield {"row": next(number), "doc_id": row["doc_id"], "held_out": row["held_out"], "n_tokens": len(found) + 1,
                   "n_known": n_known, "base": sure, "score": score, "rare": rare}

    first = stored(map_rows(rows, convert, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, "
                            "rare array<struct<word: binary, n: long>>"), "lattice-first")
    rest = first.select("row", F.inline("rare")).join(words, "word").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("_known"), F.sum(F.col("n") * F.col("m")).alias("_score"),
        F.sum(F.col("n") * (F.log10(F.col("c") + F.lit(0.1)) - F.lit(below))).alias("_base"))
    return first.drop("rare").join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("_score", F.lit(0.0))).alias("score"))


@query("op7_lattice_likelihood")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return scored(table(spark, sf, "documents"), vocabulary_path())
