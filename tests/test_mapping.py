"""Column matching against a direct evaluation of its scoring rules."""

import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from chartspark.functions.text import STOP_WORDS
from chartspark.operators import mapping as ma

RAW = ["mcg", "gvh", "class", "alm_1", "petalWidth", "z9"]
TEXT = "Yeast: mcg (McGeoch signal score), gvh (von Heijne signal score), petalWidth (width of a petal, cm)"
NEEDED = ["McGeoch_Signal_Score", "class", "Score-ALM 1", "Petal_Width", "Unrelated_Thing", "Heijne score"]


def words(name):
    spaced = re.sub("([a-z])([A-Z])", r"\1 \2", name.replace("_", " ")).lower().replace("'s", "")
    return re.sub("[^a-z0-9]+", " ", spaced).strip()


def expected_score(target, candidate, raw):
    t, c = words(target), words(candidate)
    if not t or not c:
        return 0.0
    tt, ct, rt = ({w for w in words(x).split() if w not in STOP_WORDS} for x in (target, candidate, raw))
    best = max(
        len(tt & ct) / max(len(tt), len(ct)) if tt and ct else 0.0,
        SequenceMatcher(None, t, c).ratio(),
        0.85 if t in c or c in t else 0.0,
    )
    digits = [re.sub("[^0-9]", "", x) for x in (raw, target)]
    return best + 0.2 * (digits[0] == digits[1] != "") + 0.1 * (rt == tt != set())


@pytest.fixture(scope="module")
def matched(spark):
    rows = [(1, NEEDED, RAW, TEXT, {"forced": "z9"}), (2, ["forced", "lost", "x"], RAW, "", {"forced": "z9", "lost": "gone"}), (3, [], RAW, TEXT, {})]
    df = spark.createDataFrame(rows, "chart_id int, needed array<string>, raw array<string>, description string, overrides map<string,string>")
    return ma.match_columns(df, overrides="overrides").cache()


def test_scores(matched):
    got = {(r.needed, r.raw): r.score for r in ma.suggestions_long(matched.where("chart_id = 1"), "chart_id").collect()}
    aliases = {"mcg": ["McGeoch signal score"], "gvh": ["von Heijne signal score"], "petalWidth": ["width of a petal, cm"]}
    for needed in (n for n in NEEDED if n != "class"):
        scores = sorted(((-max(expected_score(needed, c, raw) for c in [raw, *aliases.get(raw, [])]), i, raw) for i, raw in enumerate(RAW)))
        top = [(needed, raw) for _, _, raw in scores[:5]]
        assert [k for k in got if k[0] == needed] and {k for k in got if k[0] == needed} == set(top)
        for minus, _, raw in scores[:5]:
            assert got[needed, raw] == pytest.approx(-minus)


def test_one_to_one_in_order(matched):
    got = {r.renamed: r for r in matched.where("chart_id = 1").select(F.inline("matches")).collect()}
    assert (got["McGeoch_Signal_Score"].raw, got["McGeoch_Signal_Score"].evidence) == ("mcg", "McGeoch signal score")
    assert (got["class"].raw, got["class"].score, got["class"].evidence) == ("class", 10.0, "exact")
    assert got["Score-ALM 1"].raw == "alm_1" and got["Petal_Width"].raw == "petalWidth" and got["Heijne score"].raw == "gvh"
    used = [r.raw for r in got.values()]
    assert len(used) == len(set(used))


def test_overrides_and_unresolved(matched):
    got = {r.renamed: (r.raw, r.evidence) for r in matched.where("chart_id = 2").select(F.inline("matches")).collect()}
    assert got["forced"] == ("z9", "manual") and got["lost"] == (None, "manual, absent")
    missing = {r.missing for r in ma.unresolved(matched.where("chart_id = 2"), "chart_id").collect()}
    assert "lost" in missing and "forced" not in missing
    assert matched.where("chart_id = 3").first().matches == []
