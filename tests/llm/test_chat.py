import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import DATA, duck_rows, rows
from treeline.llm import chat

PIECES = [*chat.CONTROL, "\\", "\\\\", " ", "\n", "a", "é😀", "[", "<", "/", "INST]", "s>"]
TEXT = st.lists(st.sampled_from(PIECES), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", ""]) | TEXT, TEXT), max_size=5))
def test_comes_back(turns):
    whole = "".join(chat.settle(r, t)[0] for r, t in turns)
    assert [(r, t) for r, t, *_ in chat.read_turns(whole)] == turns
    for r, t in turns:
        s, start, end = chat.settle(r, t)
        assert chat.unescape(s[start:end], r not in ("user", "system")) == t
        # no mark stands in the text but an escaped one
        assert all(chat._run(s, m.start() + start, start) % 2 for m in chat.CONTROLS.finditer(s[start:end]))


def test_only_conflicts_are_escaped():
    assert chat.settle("user", "plain [text] \\ <b>")[0] == "[INST] plain [text] \\ <b> [/INST]"
    assert chat.settle("assistant", "a</s>b\\")[0] == "[OUT] a\\</s>b\\\\</s>"
    with pytest.raises(ValueError):
        chat.parse("[INST] a [INST] b [/INST]")
    with pytest.raises(ValueError):
        chat.parse("[OUT] a")
    with pytest.raises(ValueError):
        chat.parse("a</s>")


def brute(table):
    by = {}
    for c, t, r, x in table:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", hashlib.md5((x or "").encode()).hexdigest(), x or ""))
    out = []
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for *_, r, _, x in turns if r == "assistant")
        n = sum(len(chat.settle(r, x)[0]) for *_, r, _, x in turns)
        said = "".join(f"{r}\n{x}\n" for *_, r, _, x in turns)
        out.append((c, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), n))
    return sorted(out, key=str)


@pytest.mark.parametrize("chars", [1, 200, 1 << 20])
def test_like_brute_force(spark, chars):
    rng = random.Random(3)
    pick = lambda: rng.choice([None, "", *("".join(rng.choices(PIECES, k=9)) for _ in range(5))])
    table = [(rng.choice([1, 1, 1, 2, None, *range(10, 60)]), rng.choice([None, *range(40)]), rng.choice([None, "user", "assistant", "system", "tool"]), pick()) for _ in range(600)]
    table += [(5, 0, "user", "same")] * 30 + [(6, 0, "assistant", "long</s> " * 50_000)]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").repartition(5).selectExpr("*", "1 AS pid", "2 AS part", "'m' AS mask", "'x' AS mark", "3 AS place", "true AS whole", "4 AS n_turns")
    chunks = chat.format_turns(df, chars)
    assert sorted((tuple(r) for r in chat.digests(chunks).collect()), key=str) == brute(table)
    assert chunks.filter("whole").count() > 0 and (chars > 1000 or chunks.filter("part > 0").count() > 0)


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_turns(df)).collect() == []


def test_matches_sql(spark):
    got = rows(chat.op13(spark, DATA))
    assert got == duck_rows(chat.op13_sql()) and any(r[0] == -1 for r in got[1])
