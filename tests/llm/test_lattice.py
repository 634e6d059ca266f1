import math
import zlib
from collections import Counter

import pytest

from chartspark.llm import lattice

SCHEMA = "doc_id long, text string, word string, c long, row string"


def plain_marginal(model, word):
    """Every segmentation, one by one."""
    text = lattice.MARK + word

    def spell(i):
        if i == len(text):
            return 1.0
        out = math.exp(sum(model.bytes[b] for b in text[i].encode())) * spell(i + 1)
        if i == 0 or text[i] != lattice.MARK:
            out += sum(math.exp(model.pieces[text[i:j]]) * spell(j) for j in range(i + 1, len(text) + 1) if text[i:j] in model.pieces)
        return out

    return math.log10(spell(0))


def test_forward_recursion_equals_all_segmentations():
    model = lattice.Lattice(lattice.vocabulary_path(), {i: i % 97 for i in range(3, 32000)}, 11)
    for word in ["the", "a", "ñandú", "10.5,", "▁x▁", "therè", "\U0001f600ok", "tokens"]:
        assert model.log10(word) == pytest.approx(plain_marginal(model, word), rel=1e-12)


def test_probabilities_of_entries_sum_to_one_with_the_end():
    model = lattice.Lattice(lattice.vocabulary_path(), {300: 5, 400: 2}, 3)
    assert sum(map(math.exp, model.pieces.values())) + sum(map(math.exp, model.bytes)) + 10**model.end <= 1 + 1e-9


def test_scores_against_plain_counts(spark):
    texts = ["The the cat", "cat\x0bSAT on mat", None, "", "  \t ", "rare words here " * 400, "the cat", "the cat", "ÀÉ àé ÀÉ"]
    data = [(i % 17, t, None, 1, "r") for i, t in enumerate(texts * 3)] + [(None, "the the", "w", None, None), (5, "x " * 30_000, "w", 2, "")]
    got = lattice.scored(spark.createDataFrame(data, SCHEMA), lattice.vocabulary_path(), frequent=3).collect()
    crc = lambda d: zlib.crc32(b"" if d is None else str(d).encode())
    counts = Counter()
    for d, t, *_ in data:
        if crc(d) % 10:
            counts.update([*(t or "").encode().lower().split(), b""])
    n, v = sum(counts.values()), len(counts)
    want = []
    for d, t, *_ in data:
        tokens = [*(t or "").encode().lower().split(), b""]
        want.append((str(d), crc(d) % 10 == 0, len(tokens), sum(counts[w] > 0 for w in tokens), n,
                     round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens), 6)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    assert all(r.score < 0 for r in got)
    by_text = {(r.n_tokens, round(r.score, 9)) for r in got if r.n_tokens == 1}
    assert len(by_text) == 1


def test_empty_table(spark):
    assert lattice.scored(spark.createDataFrame([], SCHEMA), lattice.vocabulary_path()).count() == 0
