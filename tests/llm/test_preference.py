"""Preference pairs against a plain rendering, and odd rows."""

from sparkdraft.llm import preference

SCHEMA = "pair_id long, side string, turn long, role string, text string, n int, prompt string"


def plain(rows):
    out = {}
    for p, side, turn, role, text in rows:
        if p is not None and turn is not None and side in ("chosen", "rejected"):
            out.setdefault(p, {"chosen": [], "rejected": []})[side].append((turn, role or "unknown", text or ""))
    result = {}
    for p, sides in out.items():
        a, b = ([t[1:] for t in sorted(sides[s])] for s in ("chosen", "rejected"))
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        show = lambda turns: "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)
        spans = lambda turns: [(len(show(turns[:i])) + len(f"<|{r}|>\n"), len(show(turns[: i + 1]))) for i, (r, _) in enumerate(turns) if r == "assistant"]
        result[p] = (n, show(a[:n]), show(a[n:]), show(b[n:]), spans(a[n:]), spans(b[n:]), n < len(a) and n < len(b))
    return result


def found(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return {r["pair_id"]: (r["n_prompt_turns"], r["prompt"], r["chosen"], r["rejected"], [tuple(s) for s in r["chosen_loss"]], [tuple(s) for s in r["rejected_loss"]], r["usable"]) for r in preference.preference_pairs(df).collect()}


def test_pairs(spark):
    both = lambda p, turns: [(p, side, i, r, t) for side in ("chosen", "rejected") for i, (r, t) in enumerate(turns)]
    rows = [
        *both(1, [("system", "be kind"), ("user", "hi é")]), (1, "chosen", 2, "assistant", "hello"), (1, "rejected", 2, "assistant", "go away"), (1, "chosen", 3, "user", "ok"), (1, "chosen", 4, "assistant", "bye"),
        *both(2, [("user", "same"), ("assistant", "same")]),
        (3, "chosen", 0, "user", "alone"), (3, "chosen", 1, "assistant", "yes"),
        *both(4, [("user", None), (None, "x")]), (4, "rejected", 5, "assistant", ""),
        (5, "chosen", 0, "user", "a"), (5, "rejected", 0, "user", "b"),
        (None, "chosen", 0, "user", "lost"), (6, "other", 0, "user", "lost"), (7, "chosen", None, "user", "lost"),
        *both(8, [("user", "twice")]), *both(8, [("user", "twice")]), (8, "chosen", 1, "assistant", "w " * 50_000), (8, "rejected", 1, "assistant", "v"),
    ]
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows)[1][0] == 2 and found(spark, rows)[2][6] is False


def test_a_pair_too_large_fails_by_name(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(preference, "MOST_CHARS", 200)
    rows = [(7, "chosen", i, "user", "x" * 10) for i in range(3)] + [(8, "rejected", i, "user", "x" * 50) for i in range(9)]
    assert set(found(spark, rows[:3])) == {7}
    with pytest.raises(ValueError, match="pair 8 has [0-9]+ characters, at most 200"):
        found(spark, rows)


def test_empty_table(spark):
    assert found(spark, []) == {}
