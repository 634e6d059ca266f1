import hashlib
import math
import random

from chartspark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, window string, mask string"


def sample():
    rng = random.Random(6)
    words = ["<|im_end|>", "<|im_start|>assistant\n", "&amp;", "&lt;|", "&", "<", "|", "<|", "hé", "\n", "\U0001f600", "ok ", "&#10;", ""]
    rows = []
    for conv in range(40):
        for turn in range(rng.randint(1, 14)):
            role = "system" if turn == 0 and conv % 3 == 0 else rng.choice(["user", "assistant", "assistant", None, "a\nb&#10;", "<|im_end|>"])
            rows.append((conv, turn, role, rng.choice([None, "".join(rng.choice(words) for _ in range(rng.randint(0, 60)))]), "w", None))
    rows += [(0, 3, "user", "tie", None, "m"), (0, 3, "user", "tie", None, "m"), (None, None, None, None, None, None), (90, 0, "assistant", "x" * 200_000, "", "")]
    return rows


def ordered(rows):
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    held = {}
    for r in rows:
        held.setdefault(r[0], []).append(r)
    return {c: [(r[2] or "", r[3] or "") for r in sorted(v, key=key)] for c, v in held.items()}


def test_windows_give_every_turn_back_and_each_target_once(spark):
    rows = sample()
    for budget in (40, 1024):
        got = {r.conv_id: r for r in chat.read_back(chat.conversation_windows(spark.createDataFrame(rows, SCHEMA), budget)).collect()}
        want = ordered(rows)
        assert got.keys() == want.keys()
        for conv, turns in want.items():
            assert got[conv].n_turns == len(turns)
            assert got[conv].turns == "".join(f"{r}\n{t}\n" for r, t in turns)
            assert got[conv].loss == "".join(t for r, t in turns if r == "assistant")


def test_spans_against_a_plain_loop(spark):
    rows, budget, history = sample(), 60, 2
    got = {}
    for w in chat.conversation_windows(spark.createDataFrame(rows, SCHEMA), budget, history).collect():
        got.setdefault(w.conv_id, []).append((w.window, w.text, w.context, w.tokens))
    esc = lambda s: s.replace("&", "&amp;").replace("<|", "&lt;|")
    for conv, turns in ordered(rows).items():
        lines = [f"<|im_start|>{esc(r)}".replace("\n", "&#10;") + f"\n{esc(t)}<|im_end|>\n" for r, t in turns]
        cost = [math.ceil(len(x) / 4) for x in lines]
        system = int(turns[0][0] == "system")
        total = lambda a, b: sum(cost[a:b]) + (sum(cost[:system]) if a else 0)  # noqa: B023, E731
        spans, first, new = [], 0, 0
        for i in range(len(lines)):
            if i > new and total(first, i + 1) > budget:
                spans.append((first, new, i))
                first, new = next((j for j in range(max(system, i - history), i + 1) if total(j, i + 1) <= budget), i), i
        spans.append((first, new, len(lines)))
        want = [(k, "".join((lines[:system] if a else []) + lines[a:e]), n - a + (system if a else 0), total(a, e)) for k, (a, n, e) in enumerate(spans)]
        assert sorted(got[conv]) == want


def test_contract_query(spark, tmp_path):
    spark.createDataFrame(sample(), SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    rows = {r.conv_id: r for r in chat.op9(spark, str(tmp_path)).collect()}
    own = "<|im_end|><|im_start|>assistant ok"
    assert rows[-1].turns_sha256 == hashlib.sha256(f"user\n{own}\nassistant\n{own}\n".encode()).hexdigest()
    assert rows[-1].loss_sha256 == hashlib.sha256(own.encode()).hexdigest() and rows[-1].loss_chars == len(own)


def test_empty_table(spark):
    assert chat.conversation_windows(spark.createDataFrame([], SCHEMA)).count() == 0
