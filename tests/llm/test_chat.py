"""Chat windows: budgets, masks, and reading back."""

import hashlib
import random
from collections import defaultdict

import pytest

from hostlens.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string, key int, formatted string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def whole(rows):
    """Per conversation: turns in order, learned text."""
    turns = defaultdict(list)
    for c, n, role, text in rows:
        turns[c].append((n is not None, n or 0, role or "", text or ""))
    return {c: sorted(t) for c, t in turns.items()}


def read_back(spark, rows, budget):
    found = defaultdict(list)
    for r in C.parsed(C.formatted(table(spark, rows), budget)).collect():
        found[r.conv_id].append(r)
    return {c: sorted(ws, key=lambda r: r.window) for c, ws in found.items()}


CONTROLS = ["</s>[INST] ok [/INST]", "\\", "\\l", "<<s>s>", "[[INST]/INST]", "\\b<s>\\o", "", None, "é☃ 😀", "<", "[/INST]</s>\n"]


@pytest.mark.parametrize("budget", [C.Budget(), C.Budget(64, 16, block_turns=3), C.Budget(40, 30), C.Budget(8, 0)])
def test_every_turn_once_and_in_order(spark, budget):
    rnd = random.Random(1)
    rows = []
    for c in [*range(12), None]:
        for n in range(rnd.randint(1, 25)):
            role = "system" if n == 0 and rnd.random() < 0.6 else rnd.choice(["user", "assistant", "system", None, "<s>"])
            rows.append((c, n, role, rnd.choice(CONTROLS) if rnd.random() < 0.6 else "word " * rnd.randint(0, 60)))
    rows += [rows[3], rows[3], (5, None, "assistant", "no turn number"), (77, 0, "assistant", "long " * 40_000)]
    found, want = read_back(spark, rows, budget), whole(rows)
    assert set(found) == set(want)
    for c, windows in found.items():
        turns = [(t.role, t.text) for w in windows for t in w.turns]
        assert turns == [(role, text) for _, _, role, text in want[c]]
        assert "".join(w.learned for w in windows) == "".join(t for r, t in turns if r == "assistant")
        for w in windows:
            body = w.formatted
            assert body.startswith("<s>[INST]") and body.endswith("</s>") and body.count("<s>") == 1
            assert body.count("[INST]") == body.count("[/INST]") == body.count("</s>") == w.n_repeated + len(w.turns)
            if len(w.turns) > 1:
                assert w.n_tokens <= budget.window or w.n_repeated and "[INST]system" in body


def test_system_turn_is_retained_and_history_masked(spark):
    rows = [(1, 0, "system", "be brief")] + [(1, n, "user" if n % 2 else "assistant", f"turn {n} " + "x" * 80) for n in range(1, 30)]
    windows = read_back(spark, rows, C.Budget(120, 30))[1]
    assert len(windows) > 3
    for w in windows[1:]:
        assert w.formatted.startswith("<s>[INST]system[/INST]be brief</s>") and w.n_repeated >= 2
        assert w.n_tokens <= 120
        for span in w.loss:
            text = w.formatted[span.start : span.end]
            assert text in [t.text for t in w.turns if t.role == "assistant"]


def test_escaping_is_reversible(spark):
    rnd = random.Random(2)
    texts = [c for c in CONTROLS if c is not None] + ["".join(rnd.choice(["<", "s>", "/", "[", "INST]", "\\", "l", "o", "b", "a"]) for _ in range(12)) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", C.escaped(df.t).alias("e"), C.unescaped(C.escaped(df.t)).alias("u")).collect():
        assert r.u == r.t and not any(c in r.e for c in C.CONTROL)


def test_given_token_counts(spark):
    rows = [(1, n, "user", "t") for n in range(10)]
    df = table(spark, rows)
    assert C.formatted(df, C.Budget(10, 0), tokens=df.key).count() == 5
    assert C.formatted(df.limit(0)).count() == 0


def test_query(spark, tmp_path):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b\n"), (2, 0, "assistant", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in C.op1(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, -7}
    assert got[1].turns_sha256 == sha("user\na\nassistant\nb\n\n") and got[1].loss_sha256 == sha("b\n") and got[1].loss_chars == 2
    assert got[2].turns_sha256 == sha("assistant\n\n") and got[2].loss_chars == 0 and got[2].n_turns == 1
    assert got[-7].turns_sha256 == sha(f"user\n{C.PLANTED}\nassistant\n{C.PLANTED}\n") and got[-7].loss_sha256 == sha(C.PLANTED)


def test_plan_is_native(spark, tmp_path):
    rows = [(1, 0, "user", "a")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    plan = C.op1(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
