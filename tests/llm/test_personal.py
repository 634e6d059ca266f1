import hashlib
import random
import re

import pytest

from chartspark.llm import personal

SCHEMA = "doc_id long, text string, row string, base string, n_chars string"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def plain_base(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and plain_luhn(d):
            out.append((m.start(), 2, m.end()))
    return sorted(out + [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15])


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    bits = ["a@b.co", "@", ".", "x.y%z", "1.2.3.4", "255", "256.", "0001.2.3.", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (555) 010-9999", "+", " ", "é", "\U0001f600",
            "-", "12", "bob+1@mail.example.org", "\n", "(", "@x", "a" * 70, "+49.30.1234567", "4222222222222", "٣"]
    out = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    return out + ["", "a" * 20_000, "1" * 20_000, "1." * 5000, ("a" * 600) + "@b.c d@e", "a@b@c.d", "a@b.c@d.e", "00000000255.1.1.1", "a@b..c"]


def test_base_against_plain_patterns(texts):
    for t in texts:
        assert personal.base_spans(t) == plain_base(t), repr(t[:200])


def plain_context(docs, words=2, rounds=3, support=5, confidence=0.6):
    """Every step on plain dictionaries."""
    total, edges, places = {}, {}, []
    for i, t in enumerate(docs):
        w = (t or "").encode().lower().split()
        for j in range(len(w) - words + 1):
            key = tuple(w[j : j + words])
            total[key] = total.get(key, 0) + 1
        base = plain_base(t or "")
        tokens = [(m.start(), m.end()) for m in re.finditer(r"[^ \t\n\r\x0b\x0c]+", t or "")]
        spans = [(a, b, True) for a, _, b in base]
        for a, b in tokens:
            if re.search("[0-9]", t[a:b]) and not any(x < b and a < y for x, _, y in base):
                left = len(t[a:b]) - len(t[a:b].lstrip("\"'([{<,.;:!?"))
                token = t[a + left : b].rstrip("\"')]}>,.;:!?")
                if len(token) >= 4:
                    spans.append((a + left, a + left + len(token), False))
        for a, b, seed in spans:
            before = [t[x:y].encode().lower() for x, y in tokens if y <= a][-words:]
            if len(before) == words:
                key, value = tuple(before), t[a:b].lower()
                n, s = edges.get((key, value), (0, False))
                edges[key, value] = (n + 1, s or seed)
                if not seed:
                    places.append((i, a, b, key))
    worth = {(k, v): float(s) for (k, v), (n, s) in edges.items()}
    for _ in range(rounds):
        good = {}
        for (k, v), (n, _) in edges.items():
            g, c = good.get(k, (0.0, 0))
            good[k] = (g + worth[k, v] * n, c + (worth[k, v] >= confidence))
        trusted = {k: min(1.0, g / total[k]) for k, (g, c) in good.items() if c >= support and g / total[k] >= confidence}
        doubt = {}
        for k, v in edges:
            if k in trusted:
                doubt[v] = doubt.get(v, 1.0) * max(1e-12, 1 - trusted[k])
        worth = {(k, v): 1.0 if s else 1 - doubt.get(v, 1.0) for (k, v), (n, s) in edges.items()}
    return {(i, a, b) for i, a, b, k in places if k in trusted}


def test_contexts_against_plain_dictionaries(spark):
    rng = random.Random(4)
    docs = [f"Please write to x{i}@mail.example.org and thanks" for i in range(20)] + [f"please WRITE to agent-{i}77 now" for i in range(6)]
    docs += [f"badge number agent-{i}77, seen" for i in range(6)] + ["badge number K199 there"]
    docs += [f"the price 10{i}5 of the price {i}@b.co" for i in range(6)] + ["the price is not known " * 5] * 5 + [None, "", "write to"]
    rng.shuffle(docs)
    frame = spark.createDataFrame([(i, t, "r", None, "5") for i, t in enumerate(docs)], SCHEMA)
    got = personal.extract(frame).collect()
    found = {(r.doc_id, s.start, s.end) for r in got for s in r.spans if s.kind == 4}
    assert found == plain_context(docs) and any("agent" in docs[i][a:b] for i, a, b in found) and any("K" in docs[i][a:b] for i, a, b in found)
    assert not any("price" in docs[i] for i, _, _ in found)
    masked = {r.text for r in personal.mask(frame).collect()}
    assert "Please write to <EMAIL> and thanks" in masked and any(t and "<CONTEXT>" in t for t in masked) and None in masked and "" in masked


def test_contract_query(spark, texts, tmp_path):
    rows = [(i if i % 9 else None, t, "r", None, "b") for i, t in enumerate([*texts[:300], None, None, texts[1], texts[1]])]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in personal.op6(spark, str(tmp_path)).collect())
    want = []
    for d, t, *_ in rows:
        base = plain_base(t or "")
        text = ",".join(f"{personal.KINDS[k]}:{a}:{b}" for a, k, b in base)
        want.append((str(d), *[sum(k == n for _, k, _ in base) for n in range(4)], hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert personal.extract(empty).count() == 0 and personal.mask(empty).count() == 0
