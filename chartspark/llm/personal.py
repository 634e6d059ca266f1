"""Personal data in texts: fixed forms, and identifiers that their contexts give away."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartspark.llm import textarrays
from chartspark.llm.common import fresh, map_rows, row_numbers, stored, table, text_bytes
from chartspark.llm.registry import query

KINDS = ["email", "ip", "card", "phone", "context"]
BASE = KINDS[:4]

#: The base forms. An address is searched from its "@", whose left side is a run of these characters.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
#: Possessive runs find what the plain ones do, as every run is taken whole; a run that fails from its start fails throughout.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile("[0-9]++")
LONGEST = 64


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        # The local part is the whole run to the left of the sign, back to the last match.
        start, width = at, 64
        while start > end and start == max(end, at - width // 8 if width > 64 else at):
            low = max(end, at - width)
            start = max((m.end() for m in NOT_LOCAL.finditer(text, low, at)), default=low)
            width *= 8
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _part(digits: str) -> bool:
    """At most 255, however many zeros lead."""
    digits = digits.lstrip("0")
    return len(digits) < 4 and int(digits or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed forms, sorted; each kind leftmost and non-overlapping on its own."""
    out = [(a, 0, b) for a, b in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(_part, m[0].split(".")))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out)


def _context(text: str, start: int, words: int) -> int:
    """Hash of the `words` words before the token that holds `start`; 0 if there are fewer."""
    while start and not text[start - 1] in " \t\n\r\x0b\x0c":
        start -= 1
    width = 64
    while True:
        before = text[max(0, start - width) : start].encode()
        found = before.split()
        if len(found) > words or start <= width:
            break
        width *= 8
    if len(found) < words:
        return 0
    hashes = np.array([textarrays.hash_word(w.lower()) for w in found[-words:]], dtype=np.uint64)
    return int(textarrays.shingles(hashes, words).view(np.int64)[0])


def _candidates(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Tokens with a digit that touch no base span, without the marks around them."""
    done, k = 0, 0
    by_end = sorted(base, key=lambda s: s[2])
    for m in DIGITS.finditer(text):
        if m.start() < done:
            continue
        start, end = m.start(), m.end()
        while start and start > m.start() - LONGEST and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and end < start + LONGEST + 1 and not text[end].isspace():
            end += 1
        done = end
        whole = text[start:end]
        if len(whole) > LONGEST or (start and not text[start - 1].isspace()):
            continue
        left = len(whole) - len(whole.lstrip("\"'([{<,.;:!?"))
        token = whole[left:].rstrip("\"')]}>,.;:!?")
        while k < len(by_end) and by_end[k][2] <= start:
            k += 1
        if len(token) >= 4 and not any(a < end for a, _, _ in by_end[k:]):
            yield start + left, start + left + len(token)


def occurrences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 2) -> DataFrame:
    """One row per text: `row, doc_id, base`, and `seen`: every entity and candidate with the hash of its context and form."""

    def convert(rows: Iterator[dict]) -> Iterator[dict]:
        number = row_numbers()
        for row in rows:
            t = row["_t"]
            base = base_spans(t)
            seen = [(a, b, k, True) for a, k, b in base] + [(a, b, 4, False) for a, b in _candidates(t, base)]
            yield {
                "row": next(number), "doc_id": row["doc_id"], "base": [{"kind": k, "start": a, "end": b} for a, k, b in base],
                "seen": [{"start": a, "end": b, "seed": s, "pattern": p, "instance": textarrays.hash_word(t[a:b].lower().encode()) - (1 << 63)}
                         for a, b, k, s in seen if (p := _context(t, a, words))]}

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    return map_rows(rows, convert, "row long, doc_id long, base array<struct<kind: int, start: long, end: long>>, "
                    "seen array<struct<start: long, end: long, seed: boolean, pattern: long, instance: long>>")


def pattern_totals(docs: DataFrame, patterns: DataFrame, text: str = "text", words: int = 2, bits: int = 20) -> DataFrame:
    """`(pattern, total)`: how often each context occurs in all texts, whatever follows it.

    A bit set of fixed size, made from the patterns, keeps other contexts out of the shuffle;
    what slips through is dropped by the join.
    """
    mask = (1 << bits) - 1
    marked = [r.m for r in patterns.select(F.col("pattern").bitwiseAND(F.lit(mask)).alias("m")).distinct().collect()]
    flags = np.zeros(1 << bits, dtype=bool)
    flags[np.array(marked, dtype=np.int64)] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(flags))

    def count(batches):
        flags = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            for _, part in textarrays.chunks(batch.column(0)):
                found = textarrays.words_of(part)
                hashes = textarrays.shingles(found.hashes, words)
                text_of = np.repeat(np.arange(len(part)), np.diff(found.first))
                if not len(hashes):
                    continue
                keep = (text_of[: len(hashes)] == text_of[words - 1 :]) & flags[(hashes & np.uint64(mask)).astype(np.int64)]
                value, n = np.unique(hashes[keep], return_counts=True)
                yield pa.RecordBatch.from_pydict({"pattern": value.view(np.int64), "n": n.astype(np.int64)})

    if not marked:
        return patterns.select("pattern", F.lit(0).cast("long").alias("total"))
    counted = docs.select(text_bytes(text)).mapInArrow(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("total"))
    return counted.join(patterns, "pattern", "left_semi")


def bootstrap(graph: DataFrame, totals: DataFrame, rounds: int = 3, support: int = 5, confidence: float = 0.6) -> DataFrame:
    """Patterns worth trusting, `(pattern, score)`, from `graph(pattern, instance, seed, n)`.

    In each round a pattern scores the share of its occurrences in all texts that are
    followed by trusted instances, provided that `support` different ones are; an instance scores
    the chance that one of its trusted patterns is right; seeds stay at 1.
    """
    worth = graph.withColumn("s", F.col("seed").cast("double"))
    for i in range(rounds):
        trusted = F.col("s") >= confidence
        patterns = worth.groupBy("pattern").agg(
            F.sum(F.col("s") * F.col("n")).alias("_good"), F.sum(trusted.cast("int")).alias("_support")
        ).join(totals, "pattern").select("pattern", F.least(F.lit(1.0), F.col("_good") / F.greatest("total", F.lit(1))).alias("score"), "_support")
        patterns = stored(patterns.where((F.col("_support") >= support) & (F.col("score") >= confidence)).select("pattern", "score"), "personal-patterns")
        if i + 1 < rounds:
            doubt = graph.join(patterns, "pattern").groupBy("instance").agg(F.exp(F.sum(F.log(F.greatest(F.lit(1e-12), 1 - F.col("score"))))).alias("_doubt"))
            worth = stored(graph.join(doubt, "instance", "left").withColumn(
                "s", F.when(F.col("seed"), 1.0).otherwise(1 - F.coalesce("_doubt", F.lit(1.0)))).drop("_doubt"), "personal-worth")
    return patterns


def extract(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 2, rounds: int = 3, support: int = 5, confidence: float = 0.6) -> DataFrame:
    """`row, doc_id, base, spans` for every row: arrays of `(kind, start, end)` in code points.

    `base` holds addresses, IP numbers, cards and phones by their form. They are the seeds: the
    `words` words before them are patterns. Tokens with a digit in a trusted pattern's place
    join `spans` as "context". Null and empty texts have no span. Repeated rows and null
    identifiers are searched on their own, other columns are ignored, an empty table gives
    an empty result. Tokens of more than LONGEST characters are no identifiers.
    """
    found = stored(occurrences(docs, doc_id, text, words), "personal-found")
    seen = found.select("row", F.inline("seen"))
    graph = seen.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("n"))
    # A pattern needs `support` different instances, some of them seeds or found by others; fewer never count.
    able = graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= support).select("pattern")
    graph = stored(graph.join(able, "pattern", "left_semi"), "personal-graph")
    totals = stored(pattern_totals(docs, graph.select("pattern").distinct(), text, words), "personal-totals")
    trusted = bootstrap(graph, totals, rounds, support, confidence)
    more = seen.where(~F.col("seed")).join(trusted, "pattern", "left_semi").groupBy("row").agg(
        F.collect_list(F.struct(F.lit(4).alias("kind"), "start", "end")).alias("_more"))
    return found.join(more, "row", "left").select("row", "doc_id", "base", F.concat(
        "base", F.coalesce("_more", F.array().cast("array<struct<kind: int, start: bigint, end: bigint>>"))).alias("spans"))


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", names[x["kind"]], x["start"], x["end"])), ",")


def masked_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every (start, end, kind) replaced by <KIND>; overlapping spans become one, named after the first."""
    out, at = [], 0
    for start, end, kind in sorted(spans):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame) -> DataFrame:
    """`docs` with personal data replaced by its kind in brackets; n_chars, if there is one, follows the text. Null texts stay null."""
    name, place = fresh(docs.columns, "_row"), fresh(docs.columns, "_spans")
    keyed = stored(docs.withColumn(name, F.monotonically_increasing_id()), "personal-rows")
    found = extract(keyed.select(F.col(name).alias("doc_id"), "text")).select(
        F.col("doc_id").alias(name), F.transform("spans", lambda s: F.struct(s["start"], s["end"], s["kind"])).alias(place))
    joined = keyed.join(found.where(F.size(place) > 0), name, "left").drop(name)

    def convert(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            spans = row.pop(place)
            if spans:
                row["text"] = masked_text(row["text"], [tuple(s.values()) for s in spans])
                if isinstance(row.get("n_chars"), int):
                    row["n_chars"] = len(row["text"])
            yield row

    return map_rows(joined, convert, docs.schema)


@query("op6_contextual_pii")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return extract(table(spark, sf, "documents")).select(
        "doc_id", *[count(k) for k in BASE], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
