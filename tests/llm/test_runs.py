"""Runs against a plain loop, with blocks so small that runs cross many of them."""

import random

import pytest
from conftest import rows

from tallyrill.llm.runs import collapse_runs


def brute(data, gap, least):
    lines = {}
    for s, p, at, *same in data:
        if s is not None and p is not None:
            lines[s, p] = (at, tuple(same))
    out = []
    for s in {s for s, _ in lines}:
        seq = sorted(p for q, p in lines if q == s)
        run = [seq[0]]
        for p in seq[1:]:
            (a, x), (b, y) = lines[s, run[-1]], lines[s, p]
            if x == y and a is not None and b is not None and b - a <= gap:
                run.append(p)
            else:
                out.append((s, run))
                run = [p]
        out.append((s, run))
    return sorted(((s, r[0], r[-1], lines[s, r[0]][0], lines[s, r[-1]][0], len(r)) for s, r in out if len(r) >= least), key=repr)


@pytest.mark.parametrize("block", [1, 3, 5, 4096])
@pytest.mark.parametrize("least", [1, 2])
def test_runs(spark, block, least):
    rng = random.Random(block)
    data, at = [], 0
    for _ in range(400):
        at += rng.choice([0, 1, 1, 2, 9])
        data.append((rng.choice(["hot"] * 8 + ["a", None]), rng.choice([None, *range(150)]) if rng.random() < 0.9 else 7, at, rng.choice("xxxy"), rng.choice(["u", "u", "u", None])))
    seen, unique = set(), []
    for row in data:
        if row[:2] not in seen:
            seen.add(row[:2])
            unique.append(row)
    unique.sort(key=lambda r: (str(r[0]), r[1] if r[1] is not None else -1))
    times = iter(sorted(r[2] for r in unique))
    unique = [(s, p, next(times) if rng.random() < 0.97 else None, *v) for s, p, _, *v in unique]
    df = spark.createDataFrame(unique + unique[:40], "seq string, pos bigint, at bigint, a string, b string").selectExpr("*", "1 as n", "'clash' as sig", "0 as _block")
    got = collapse_runs(df, "seq", "pos", "at", ["a", "b"], 3, least, block)
    assert rows(got, "seq", "first_pos", "last_pos", "first_at", "last_at", "n_events") == brute(unique, 3, least)


def test_empty(spark):
    df = spark.createDataFrame([], "seq string, pos bigint, at bigint, a string")
    assert collapse_runs(df, "seq", "pos", "at", ["a"], 3).count() == 0


def test_hot_copies_are_one_event(spark):
    df = spark.createDataFrame([("s", 1, 5, "x")] * 500 + [("s", 2, 6, "x")], "seq string, pos bigint, at bigint, a string")
    assert rows(collapse_runs(df, "seq", "pos", "at", ["a"], 3), "first_pos", "last_pos", "n_events", "duration") == [(1, 2, 2, 1)]
