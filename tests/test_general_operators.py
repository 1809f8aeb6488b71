"""The general operators against brute force, with nulls, ties, repeats, empty tables and clashing column names."""

import json
import random
from collections import Counter

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyrill.functions import jsonindex
from tallyrill.functions.keys import epoch_nanos, log_lines, server_key, tool_key, verdict
from tallyrill.operators.entity_features import entity_features, entity_type_totals, type_list
from tallyrill.operators.heavy_keys import heavy_key_profile
from tallyrill.operators.nested import flatten_nested
from tallyrill.operators.ordering import ordered_positions
from tallyrill.operators.schema_drift import project_typed, schema_changes, settled_columns
from tallyrill.operators.snapshots import snapshot_changes


def test_readings(spark):
    df = spark.createDataFrame([("Audio-Kiln", "a__b__Send_Thread", " WARN "), (None, None, None), ("", "__", ""), ("É1", "x___y", "Block")], "server_name string, tool_name string, verdict string")
    assert [tuple(r) for r in df.select(server_key(), tool_key(), verdict()).collect()] == [("audiokiln", "sendthread", "warn"), ("", "", "pass"), ("", "", "pass"), ("1", "y", "block")]


def test_times(spark):
    df = spark.createDataFrame([("2026-01-01T00:00:00Z",), ("2026-01-01T00:00:00.123456789+00:00",), ("2026-01-01T02:00:00.5+02:00",), ("nonsense",), (None,), ("2026-01-01T00:00:00.1234567Z",)], "t string")
    base = 1767225600 * 10**9
    assert [r[0] for r in df.select(epoch_nanos("t")).collect()] == [base, base + 123456789, base + 500000000, None, None, base + 123456700]


def test_log_lines_count_copies_once(spark):
    df = spark.createDataFrame([("s", 1, "a", 1), ("s", 1, "a", 2), ("s", 2, "a", 3), (None, 1, "a", 4), ("s", None, "a", 5)], "session_id string, line_no bigint, server_name string, log_id int")
    assert rows(log_lines(df, k=server_key())) == [("s", 1, "a"), ("s", 2, "a")]


def test_heavy_keys_against_counting(spark):
    rng = random.Random(1)
    data = [(rng.choice(["hot"] * 6 + ["a", "b", None, ""]), rng.choice(["x"] * 3 + ["y", None]), rng.choice([None, *range(-5, 6)])) for _ in range(3000)]
    df = spark.createDataFrame(data, "k string, l string, v int").withColumn("bucket", F.lit("clash")).repartition(7)
    got = {(r["k"], r["l"]): (r["n_rows"], r["total_rows"], r["sum_v"], r["min_v"], r["max_v"]) for r in heavy_key_profile(df, ["k", "l"], ["v"], ["v"], ["v"], buckets=3).collect()}
    want = {}
    for k, l, v in data:
        want.setdefault((k, l), []).append(v)
    assert got == {key: (len(vs), len(data), sum(x for x in vs if x is not None), min((x for x in vs if x is not None), default=None), max((x for x in vs if x is not None), default=None)) for key, vs in want.items()}


def test_heavy_keys_flush_and_empty(spark, monkeypatch):
    import tallyrill.operators.heavy_keys as module

    acc = module._Accumulator(["sum"])
    for start in range(0, 100, 10):
        keys = [(str(i % 37),) for i in range(start, start + 10)]
        distinct = list(dict.fromkeys(keys))
        acc.add(distinct, __import__("numpy").array([distinct.index(k) for k in keys]), [None])
    taken, arrays = acc.take()
    assert dict(zip(taken, arrays[0].tolist())) == Counter((str(i % 37),) for i in range(100))
    assert heavy_key_profile(spark.createDataFrame([], "k string"), ["k"]).count() == 0


def test_entity_features(spark):
    data = [("e", "a", 3), ("e", "a", 5), ("e", "b", 1), ("e", None, 9), (None, "b", 2), ("f", "", 4), ("f", "zz", 6)]
    df = spark.createDataFrame(data, "entity string, kind string, at int").withColumn("_n", F.lit(1))
    got = rows(entity_features(df, "entity", {"kind": ["a", "b"]}, "at", F.xxhash64("at"), salts=3))
    assert got == sorted([("e", 4, 9, 2, 1), (None, 1, 2, 0, 1), ("f", 2, 6, 0, 0)], key=repr)
    assert type_list(df, ["kind"]) == {"kind": ["a", "b", "zz"]}
    with pytest.raises(ValueError):
        type_list(df, ["kind"], most=2)
    assert rows(entity_type_totals(df, "entity", "kind", "at", F.lit(7))) == sorted([("e", "a", 2, 5), ("e", "b", 1, 1), (None, "b", 1, 2), ("f", "zz", 1, 6)], key=repr)
    assert entity_features(df.limit(0), "entity", {"kind": ["a"]}, "at", F.lit(1)).count() == 0


def test_positions_across_blocks(spark):
    rng = random.Random(2)
    data = sorted({(rng.choice(["a", "b", None]), rng.randrange(60)) for _ in range(90)}, key=repr)
    df = spark.createDataFrame([(g, o, o * 10) for g, o in data], "g string, o int, c int")
    got = {(r["g"], r["o"]): (r["pos"], r["prev_c"], r["next_c"]) for r in ordered_positions(df, ["g"], ["o"], F.floor(F.col("o") / 7), "c").collect()}
    for g in ("a", "b", None):
        seq = sorted(o for h, o in data if h == g)
        for i, o in enumerate(seq):
            assert got[g, o] == (i + 1, seq[i - 1] * 10 if i else None, seq[i + 1] * 10 if i + 1 < len(seq) else None)


def brute_changes(snaps, items):
    """snaps: (source, time, id); items: (id, key, value)."""
    kept = {}
    for s, t, i in snaps:
        if s is not None and t is not None:
            kept[s, t] = min(i, kept.get((s, t), i))
    held = {}
    for i, k, v in items:
        held.setdefault(i, {}).setdefault(k, set()).add(v)
    out = []
    for s in {s for s, _ in kept}:
        chain = [kept[s, t] for t in sorted(t for q, t in kept if q == s)]
        for a, b in zip(chain, chain[1:]):
            old, new = held.get(a, {}), held.get(b, {})
            out += [(b, k, "added") for k in new.keys() - old.keys()] + [(b, k, "removed") for k in old.keys() - new.keys()] + [(b, k, "changed") for k in new.keys() & old.keys() if new[k] != old[k]]
    return sorted(out, key=repr)


def test_snapshots_against_sets(spark):
    rng = random.Random(3)
    snaps, items = [], []
    for i in range(120):
        snaps.append((rng.choice(["hot"] * 5 + ["a", "b", None]), rng.choice([None, *range(50)]), i))
        for _ in range(rng.randrange(5)):
            items.append((i, rng.choice(["x", "y", "z", None]), rng.choice(["1", "2", None])))
            items += [items[-1]] * (rng.random() < 0.2)
    s = spark.createDataFrame(snaps, "source string, taken_at int, snapshot_id bigint")
    t = spark.createDataFrame(items, "snapshot_id bigint, k string, v string").withColumn("bucket", F.lit(0))
    got = rows(snapshot_changes(s, t, ["k"], ["v"], F.floor(F.col("taken_at") / 6), buckets=5))
    assert got == brute_changes(snaps, items) and got
    assert snapshot_changes(s.limit(0), t.limit(0), ["k"], ["v"], F.lit(0)).count() == 0


def drift(spark, files):
    lines = [(feed, no, json.dumps(r) if isinstance(r, dict) else r) for feed, no, records in files for r in records]
    return rows(schema_changes(spark.createDataFrame(lines, "feed string, file_no bigint, record string").withColumn("field", F.lit("clash")), "feed", "file_no", "record"), "feed", "file_no", "change", "field", "new_field")


def test_drift_kinds(spark):
    ids = lambda n: [f"m-{random.Random(n * 10 + i).getrandbits(48):012x}" for i in range(6)]
    files = [
        ("f", 1, [{"id": x, "p": "one", "q": i, "gone": True} for i, x in enumerate(ids(1))]),
        ("f", 1, [{"id": x, "p": "one", "q": i, "gone": True} for i, x in enumerate(ids(1))]),  # a copy
        ("f", 3, [{"key": x, "p": "two", "q": str(i), "new": ["x"]} for i, x in enumerate(ids(3))] + ["{broken", None, "[]"]),
        ("f", 4, [{"key": x, "p": None, "q": 1} for x in ids(4)]),
        ("f", 5, [{"key": x, "p": "three", "q": 2.5} for x in ids(5)]),
        ("g", 1, [{"a": 1}]),
    ]
    assert drift(spark, files) == sorted(
        [("f", 3, "renamed", "id", "key"), ("f", 3, "removed", "gone", ""), ("f", 3, "added", "new", ""), ("f", 3, "type_changed", "q", ""), ("f", 4, "removed", "new", ""), ("f", 4, "type_changed", "q", ""), ("f", 5, "type_changed", "p", "")], key=repr
    )


def test_drift_empty(spark):
    assert drift(spark, [("f", 1, ["x"])]) == []
    assert schema_changes(spark.createDataFrame([], "feed string, file_no bigint, record string"), "feed", "file_no", "record").count() == 0


def test_project_typed(spark):
    df = spark.createDataFrame([(1, '{"n": "5", "b": "x"}'), (2, '{"m": "z", "b": {"q": 1}}'), (3, "{"), (4, None)], "id int, r string")
    got = {r["id"]: r for r in project_typed(df, "r", ["id"], {"n": ("int", ("n", "m"))}).collect()}
    assert (got[1]["n"], got[1]["other"], got[1]["failed_casts"]) == (5, '{"b":"x"}', [])
    assert got[2]["n"] is None and [tuple(f) for f in got[2]["failed_casts"]] == [("n", "m", "z")]
    assert [tuple(f) for f in got[3]["failed_casts"]] == [("", "", "{")] and len(got) == 4
    both = spark.createDataFrame([(1, '{"m": 1, "n": null, "it\'s \\"q\\"": [1]}'), (2, '{"n": 2, "m": 3}')], "id int, r string")
    assert [tuple(r) for r in project_typed(both, "r", ["id"], {"n": ("int", ("n", "m"))}).orderBy("id").drop("failed_casts").collect()] == [(1, 1, '{"it\'s \\"q\\"":[1]}'), (2, 2, '{"m":3}')]


def test_columns_from_what_is_found(spark):
    """A rename that no list names reaches its column, and a column has the type most of its values have."""
    app = lambda i: ["desk", "code", "web"][i % 3]
    files = [
        ("f", 1, [{"platform_name": app(i), "size": i, "share": 0.5, "on": True, "id": f"m-{i:06x}"} for i in range(9)]),
        ("f", 2, [{"agent kind": app(i), "size": str(i) if i else "many", "share": 1, "on": False, "id": f"m-{i:06x}"} for i in range(8)] + ["{broken"]),
        ("g", 1, [{"agent kind": "web", "size": 3, "file_no": 7, "list": [1]}]),
    ]
    lines = [(feed, no, json.dumps(r) if isinstance(r, dict) else r) for feed, no, records in files for r in records]
    df = spark.createDataFrame(lines, "feed string, file_no bigint, record string")
    columns = settled_columns(df, "feed", "file_no", "record", ["feed", "file_no"])
    assert columns["agent kind"] == ("string", ("agent kind", "platform_name"))
    assert {n: t for n, (t, _) in columns.items() if n in ("size", "share", "on", "file_no_", "list")} == {"size": "bigint", "share": "double", "on": "boolean", "file_no_": "bigint", "list": "string"}
    got = project_typed(df, "record", ["feed", "file_no"], columns).collect()
    name = next(n for n, (_, f) in columns.items() if "platform_name" in f)
    assert sum(r[name] is not None for r in got) == 18 and all(r["other"] in ("{}", None) for r in got)
    assert [tuple(f) for r in got for f in r["failed_casts"]] == [("size", "size", "many"), ("", "", "{broken")]
    with pytest.raises(ValueError, match="more than 2 fields"):
        settled_columns(df, "feed", "file_no", "record", most=2)
    assert settled_columns(df.limit(0), "feed", "file_no", "record") == {}


def test_many_fields_change_at_once(spark):
    """A file that replaces hundreds of fields pairs only those whose values are alike."""
    record = lambda old, i: {f"{'old' if old else 'new'}{n}": f"{n}-{(i * 7 + n) % 5}" for n in range(300)}
    got = drift(spark, [("f", 1, [record(True, i) for i in range(8)]), ("f", 2, [record(False, i) for i in range(8)])])
    assert got == sorted((("f", 2, "renamed", f"old{n}", f"new{n}") for n in range(300)), key=repr)


values = st.recursive(st.none() | st.booleans() | st.integers(-99, 99) | st.text(max_size=6), lambda kids: st.lists(kids, max_size=4) | st.dictionaries(st.sampled_from(["a", "b", 'c"', "d\\"]), kids, max_size=4), max_leaves=12)


@settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(values, st.booleans(), st.integers(0, 40), st.sampled_from(['"', "{", "}", "[", "]", ",", ":", "\\", "x", "\x01"])), min_size=1, max_size=6))
def test_index_reads_as_json_does(cases):
    texts = []
    for value, ascii_only, at, sign in cases:
        text = json.dumps(value, ensure_ascii=ascii_only)
        texts.append((text if at % 3 else text[: at % (len(text) + 1)] + sign + text[at % (len(text) + 1) :]).encode("utf-8", "surrogatepass"))
    index = jsonindex.build(texts)
    for i, text in enumerate(texts):
        try:
            want = json.loads(text.decode("utf-8", "surrogatepass"), parse_constant=lambda c: 1 / 0)
        except (ValueError, ZeroDivisionError):
            assert not index.ok[i]
            continue
        assert index.ok[i]
        top = [r for r in range(len(index.parent)) if index.text[r] == i and index.parent[r] == -1]
        assert len(top) == 1 and json.loads(index.raw(top[0]).decode("utf-8", "surrogatepass")) == want


ARRAYS = ("checks", "checks.names", "deep.list", "deep.list.inner.more")


def brute_flat(record_id, payload):
    def unwrap(v):
        if isinstance(v, str) and v.strip()[:1] in ("[", "{") and v.strip():
            try:
                return unwrap(json.loads(v)) if isinstance(json.loads(v), (list, dict)) else v
            except ValueError:
                return v
        return v

    def fields(v, prefix, pos):
        v = unwrap(v)
        for k, x in v.items() if isinstance(v, dict) else ():
            path = f"{prefix}.{k}" if prefix else k
            if path in ARRAYS:
                x = unwrap(x)
                for i, e in enumerate(x if isinstance(x, list) else [x]):
                    if e is not None:
                        yield record_id, path, ".".join(map(str, (*pos, i)))
                        yield from fields(e, path, (*pos, i))
            elif any(a.startswith(path + ".") for a in ARRAYS):
                yield from fields(x, path, pos)

    try:
        return list(fields(json.loads(payload), "", ())) if payload else []
    except ValueError:
        return []


def test_flatten_against_recursion(spark):
    rng = random.Random(4)

    def value(depth=0):
        kind = rng.random()
        if depth > 4 or kind < 0.3:
            return rng.choice([None, 1, "t", True, "", "[not", "[1, null]", '{"names": [3, {"names": 1}]}'])
        if kind < 0.6:
            return [value(depth + 1) for _ in range(rng.randrange(4))]
        made = {rng.choice(["checks", "names", "deep", "list", "inner", "more", "else"]): value(depth + 1) for _ in range(rng.randrange(5))}
        return json.dumps(made) if rng.random() < 0.2 else made

    data = [(i, rng.choice([json.dumps({"checks": value(), "deep": {"list": value()}}), json.dumps(value()), None, "", "{", '{"checks": [1]} x'])) for i in range(300)]
    data += [(7, '{"checks": [1], "checks": [2, 3]}'), (7, '{"checks": "[\\"a\\", \\"b\\"]"}'), (8, json.dumps({"checks": ["x" * 3_000_000]}))]
    df = spark.createDataFrame(data, "rid bigint, payload string").withColumn("path", F.lit("clash"))
    got = flatten_nested(df, "rid", "payload", ARRAYS)
    want = [x for i, p in data for x in brute_flat(i, p)]
    assert rows(got, "rid", "path", "pos") == sorted(want, key=repr)
    for r in got.where("parent_pos <> ''").limit(50).collect():
        assert r["pos"].startswith(r["parent_pos"] + ".") and r["path"].startswith(r["parent_path"] + ".")
