"""Cases past the cuts that operators once had: long documents, deep values, far differences."""

import json
import random

from conftest import rows
from pyspark.sql import functions as F

from tallyrill.operators import inventory as I
from tallyrill.operators import posture
from tallyrill.operators.schema_drift import schema_changes
from tallyrill.plans import catalogue
from tallyrill.sources import configs


def test_long_payloads_are_read(spark, tmp_path):
    long = json.dumps({"v": "x" * 100_000})
    spark.createDataFrame([(1, long), (2, long[:-1]), (3, "{}"), (4, None)], "scan_id int, payload string").write.parquet(str(tmp_path / "posture_scans.parquet"))
    assert rows(catalogue.queries()["json_statuses"](spark, str(tmp_path))) == [(1, "ok"), (2, "invalid_json"), (3, "ok"), (4, "missing")]
    df = spark.createDataFrame([("[1]",), ("[12]",)], "t string")
    assert rows(df.select(configs.json_status(F.octet_length("t"), F.col("t"), 3))) == [("ok",), ("too_large",)]


def test_broad_folders_and_governance(spark):
    extension = {"extensions": {"installations": [{"id": "e"}]}}
    hosts = {
        "root": {**extension, "settings": [{"allowed_directories": ["/"]}]},
        "home": {**extension, "settings": {"a": {"allowedDirectories": {"~": True, "/srv": True}}, "b": {"allowedDirectories": "C:\\Users\\u\\Documents\\"}}},
        "own": {**extension, "allowedDirectories": ["/home/u/x/.."]},
        "narrow": {**extension, "allowedDirectories": ["/srv/data", "", None]},
        "allowed": {**extension, "org": {"a.dxt:allowlistEnabled": "TRUE"}},
        "off": {**extension, "dxt:allowlistEnabled": False, "extensionAllowlist": ["e"], "list": [{"dxt:allowlistEnabled": True}]},
        "blocked": {**extension, "extensions-blocklist.json": {"entries": [{"id": "x"}]}},
        "empty": {**extension, "extensionBlocklist": {"items": [], "version": 1}},
    }
    df = spark.createDataFrame([(h, json.dumps(d), "/home/u/") for h, d in hosts.items()], "host string, text string, home string")
    facts = posture.host_facts(df, "text", home="home")
    assert rows(facts, "host", "facts.broad", "facts.governed") == [("allowed", 0, True), ("blocked", 0, True), ("empty", 0, False), ("home", 2, False), ("narrow", 0, False), ("off", 0, False), ("own", 1, False), ("root", 1, False)]
    fields = ("installed", "unsigned", "dangerous", "broad", "governed")
    checks = facts.select("host", F.explode(posture.flag_checks({f: F.col(f"facts.{f}") for f in fields})).alias("c")).where("c.category = 'extensions'").select("host", "c.*")
    assert rows(posture.score(checks, "host"), "host", "score") == [("allowed", 100), ("blocked", 100), ("empty", 88), ("home", 88), ("narrow", 88), ("off", 88), ("own", 88), ("root", 88)]
    assert rows(checks.where("check_name = 'DXT Extension Risk' and status = 'FAIL'"), "host") == [("home",), ("own",), ("root",)]
    assert posture.document_facts({"allowedDirectories": ["/home/u", ".", "c:/", "//", "/x/Desktop"]})["broad"] == 4
    assert dict(posture.flatten({"a": {"b": {"c": 1}}, "d": [{"e": 2}]})) == {"a": {"b": {"c": 1}}, "a.b": {"c": 1}, "a.b.c": 1, "d": [{"e": 2}]}


def test_deep_values_are_found(spark, tmp_path):
    payload = lambda levels: '{"a":' * levels + '{"count":1}' + "}" * levels
    spark.createDataFrame([(n, payload(n)) for n in (0, 5, 6, 12, 13)], "scan_id int, payload string").write.parquet(str(tmp_path / "posture_scans.parquet"))
    assert rows(catalogue.queries()["posture_values"](spark, str(tmp_path))) == [("count", "1", 4)]


def drift(spark, files):
    lines = [("f", no, json.dumps(r)) for no, records in enumerate(files) for r in records]
    return rows(schema_changes(spark.createDataFrame(lines, "feed string, file_no bigint, record string"), "feed", "file_no", "record"), "file_no", "change", "field", "new_field")


def words(seed, n=8):
    return ["".join(random.Random(f"{seed} {i}").choices("ghijklmnop", k=12)) for i in range(n)]


def test_shapes_to_the_end(spark):
    for least in (30, 3000):
        head = "some words " * least
        like = [[{"old": head + w + " (x/y)"} for w in words("a")], [{"new": head + w + " (x/y)"} for w in words("b")]]
        assert drift(spark, like) == [(1, "renamed", "old", "new")]
        unlike = [[{"old": head + w + " (x/y)"} for w in words("a")], [{"new": head + w + " <7>"} for w in words("b")]]
        assert drift(spark, unlike) == [(1, "added", "new", ""), (1, "removed", "old", "")]


def test_all_renames_of_a_file(spark):
    a, b = words("a"), words("b")
    files = [[{"o1": f"{x}@x.org", "o2": f"{y}@y.org"} for x, y in zip(a, b)], [{"n1": f"{x}@x.net", "n2": f"{y}@y.net"} for x, y in zip(words("c"), words("d"))]]
    assert drift(spark, files) == [(1, "renamed", "o1", "n1"), (1, "renamed", "o2", "n2")]
    three = [[{f"o{i}": f"{x}/{i}" for i in range(3)} for x in a], [{f"n{i}": f"{x}/{i}" for i in (1, 2)} for x in b]]
    assert [r[1] for r in drift(spark, three)] == ["removed", "renamed", "renamed"]


def test_guard_summary_and_skills(spark, tmp_path):
    plans = spark.createDataFrame([(["a", "b"], ["c"]), ([], None), (None, ["d"])], "migrated array<string>, native_disabled array<string>")
    assert rows(I.guard_summary(plans)) == [(3, 2, 2)] and rows(I.guard_summary(plans.limit(0))) == [(0, 0, 0)]
    paths = ["/s/x/skills/a/SKILL.md", "/s/skills-plugin/skills/b/SKILL.md", "/s/skills-plugin/Scheduled/c/SKILL.md", "C:\\s\\skills-plugin\\d\\SKILL.md", "/s/skills/e/skill.md", "/s/scheduled/README.md"]
    assert rows(I.skill_counts(spark.createDataFrame([(p,) for p in paths], "path string")), "total", "scheduled", "plugin", "session") == [(4, 1, 2, 1)]
    for path in ("skills/a/SKILL.md", "x/node_modules/skills/b/SKILL.md", "skills/SKILL.md", "skills/c/d/SKILL.md", "other/e/SKILL.md", "skills/f/README.md", "1/2/3/4/5/skills/g/SKILL.md", "1/2/3/4/5/6/skills/h/SKILL.md"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x")
    assert rows(configs.skill_files(spark, str(tmp_path)), "below") == [("1/2/3/4/5/skills/g/SKILL.md",), ("skills/a/SKILL.md",), ("x/node_modules/skills/b/SKILL.md",)]
