"""Secrets in texts, and weak parts of credentials that stand near their counterparts. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartspark.llm.common import stored, table
from chartspark.llm.registry import query

#: The base kinds, in the order in which equal starts are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

#: Parts that mean little alone. An identifier names an account, an opaque run may be its secret, an endpoint the place to use them.
IDENTIFIER = r"""(?i:access_key_id|client_id|account|user_?name|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}"""
OPAQUE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{16,}"
ENDPOINT = r"""[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x00-\x20"'<>]+"""

BASE = ["assign", "access", "hex"]
WEAK = ["identifier", "opaque", "endpoint"]
KINDS = [*BASE, *WEAK]
PLACES = "array<struct<start: long, end: long, match: string>>"


def places(text: Column, pattern: str) -> Column:
    """`(start, end, match)` of the leftmost non-overlapping matches, in code points.

    The texts between the matches give the positions, so no match is looked up twice.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    step = lambda a, x: F.struct(
        (a["at"] + F.char_length(x["b"]) + F.char_length(x["m"])).alias("at"),
        F.concat(a["out"], F.array(F.struct(
            (a["at"] + F.char_length(x["b"])).alias("start"), (a["at"] + F.char_length(x["b"]) + F.char_length(x["m"])).alias("end"), x["m"].alias("match")))).alias("out"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(PLACES).alias("out"))
    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, m: F.struct(b.alias("b"), m.alias("m")))
    return F.when(text.rlike(pattern), F.aggregate(pairs, start, step, lambda a: a["out"])).otherwise(F.array().cast(PLACES))


def _long_enough(x: Column) -> Column:
    return F.char_length(F.regexp_extract(x["match"], ASSIGN, 2)) >= 6


def parts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: `row, doc_id` and an array of places for each kind, in one pass over the text."""
    t = F.col("_t")
    found = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"), F.monotonically_increasing_id().alias("row")
    ).select(
        "row", "doc_id", F.filter(places(t, ASSIGN), _long_enough).alias("assign"), places(t, ACCESS).alias("access"), places(t, HEX).alias("hex"),
        places(t, IDENTIFIER).alias("identifier"), places(t, OPAQUE).alias("opaque"), places(t, ENDPOINT).alias("endpoint"))
    return found.select("row", "doc_id", *[F.transform(k, lambda x: F.struct(x["start"], x["end"])).alias(k) for k in KINDS])


def linked(found: DataFrame, scope: int = 200) -> DataFrame:
    """Weak parts with their counterparts in scope: `(row, kind, start, end)`.

    An interval join over the starts within one text: an identifier needs a secret (assigned,
    hexadecimal or opaque) whose start is at most `scope` code points away, an opaque run an
    identifier or access key, and an endpoint one of each. Opaque runs inside another part are not
    parts of their own. Only texts with a weak part are shuffled, as positions.
    """
    tagged = F.concat(*[_tagged(k) for k in KINDS])
    weak = F.greatest(*[F.size(k) for k in WEAK]) > 0
    other = (F.size("assign") + F.size("access") + F.size("hex") + F.size("identifier") + F.size("opaque")) > 1
    each = found.where(weak & other).select("row", F.explode(tagged).alias("_p")).select("row", "_p.*")
    near = Window.partitionBy("row").orderBy("start").rangeBetween(-scope, scope)
    inside = Window.partitionBy("row").orderBy("start", F.desc("end"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    # An opaque run that overlaps an earlier part, or that another part starts in, is covered by it.
    named = each.where(F.col("kind") != KINDS.index("opaque")).unionByName(_uncovered(each, inside))
    is_name = F.col("kind").isin(KINDS.index("access"), KINDS.index("identifier"))
    is_secret = F.col("kind").isin(KINDS.index("assign"), KINDS.index("hex"), KINDS.index("opaque"))
    seen = named.withColumns({"_names": F.sum(is_name.cast("int")).over(near), "_secrets": F.sum(is_secret.cast("int")).over(near)})
    wanted = {"identifier": F.col("_secrets") > 0, "opaque": F.col("_names") > 0, "endpoint": (F.col("_names") > 0) & (F.col("_secrets") > 0)}
    keep = F.lit(False)
    for kind, test in wanted.items():
        keep = keep | ((F.col("kind") == KINDS.index(kind)) & test)
    return seen.where(keep).select("row", "kind", "start", "end")


def _tagged(kind: str) -> Column:
    return F.transform(kind, lambda x: F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def _uncovered(each: DataFrame, before) -> DataFrame:
    opaque = F.col("kind") == KINDS.index("opaque")
    after = Window.partitionBy("row").orderBy("start", F.desc("end"), "kind").rowsBetween(1, Window.unboundedFollowing)
    reach = F.max(F.when(~opaque, F.col("end"))).over(before)
    follow = F.min(F.when(~opaque, F.col("start"))).over(after)
    marked = each.withColumns({"_reach": reach, "_follow": follow})
    clear = (F.coalesce("_reach", F.lit(-1)) <= F.col("start")) & F.coalesce(F.col("_follow") >= F.col("end"), F.lit(True))
    return marked.where(opaque & clear).select(*each.columns)


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", names[x["kind"]], x["start"], x["end"])), ",")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = 200) -> DataFrame:
    """`doc_id, base, spans` for every row: arrays of `(kind, start, end)` in code points.

    `base` holds the assigned values, access keys and hexadecimal runs; `spans` adds the linked
    weak parts. Null and empty texts have none. Repeated rows and null identifiers are scanned
    on their own, other columns are ignored, and an empty table gives an empty result.
    """
    found = stored(parts(docs, doc_id, text), "secrets-parts")
    more = linked(found, scope).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("_more"))
    base = F.concat(*[_tagged(k) for k in BASE])
    return found.join(more, "row", "left").select("doc_id", *BASE, base.alias("base"), F.concat(
        base, F.coalesce("_more", F.array().cast("array<struct<kind: int, start: long, end: long>>"))).alias("spans"))


@query("op5_multipart_secrets")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return scan(table(spark, sf, "documents")).select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
