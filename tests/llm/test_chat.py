import random
from collections import defaultdict

import pytest

import __spark_entry__ as entry
from tabwarden.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = defaultdict(set)
    for conv, turn, role, text in rows:
        convs[conv].add((turn, role, text))

    def order(t):
        return tuple((x is not None, x if x is not None else 0) for x in t)

    listed = {c: tuple(t[1:] for t in sorted(ts, key=order)) for c, ts in convs.items()}
    out = []
    for c, own in listed.items():
        longer = any(len(o) > len(own) and o[:len(own)] == own for o in listed.values())
        same = [d for d, o in listed.items() if o == own]
        if not longer and c == (min(x for x in same if x is not None) if any(x is not None for x in same) else None):
            text = "".join(f"<|im_start|>{r if r is not None else 'unknown'}\n{t or ''}<|im_end|>\n" for r, t in own)
            out.append((c, len(own), len(same), text))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [2, 1024])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    rng = random.Random(block)
    rows = []
    for conv in range(60):
        n = rng.randint(1, 7)
        base = [(rng.choice(["user", "assistant"]), rng.choice("ab")) for _ in range(n)]
        rows += [(conv, k, *t) for k, t in enumerate(base)]
        for extra in range(rng.randint(0, 2)):  # snapshots of the same conversation
            rows += [(1000 + conv * 10 + extra, k, *t) for k, t in enumerate(base[: rng.randint(1, n)])]
    rows += [(500, None, None, None), (500, 3, "user", None), (None, 0, "user", "lost"), (None, 0, "user", "lost"),
             (501, 1, "user", "x"), (501, 1, "user", "y"), (501, -5, "user", "first"), (502, 0, "user", ""), (503, 9, "user", "z" * 50_000)]
    rng.shuffle(rows)
    turns = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", k int, conv string")
    got = sorted((tuple(r) for r in chat.format_chats(turns).collect()), key=repr)
    assert got == brute(rows)
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = entry.queries()["op6_chat"](spark, sf)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_no_python_in_the_plan(spark):
    plan = entry.queries()["op6_chat"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
