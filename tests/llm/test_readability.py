"""Reading levels: running text, syllables, cuts, and held-out accuracy on the labelled documents."""

import numpy as np
import pytest
from conftest import rows

from tallyrill.llm.readability import GRADES, fit_cuts, grades, profile, read_level, reading_levels, running_sentences, syllables, t_units

SIMPLE = "The cat sat on the mat. It was a big red cat. You can see it now. He ran to the shop and got a cup. " * 5
HARD = "Notwithstanding the epistemological indistinguishability of heterogeneous instrumentation, the jurisdictional canonicalization presupposes irreconcilable accountability throughout the evaluation of every authorization. " * 4


def test_running_text():
    text = "# Title here\n\nOne two, e.g. v1.2.3 three by Mr. Gate. Four!\n\n```sh\nrm x\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n- first item\n- second item\n\n2026-01-01T00:00:00Z mcp.tool_call x y\n{\"q\": \"dump of words\", \"a\": 1}\n"
    assert [" ".join(s) for s in running_sentences(text)] == ["One two e g three by Mr Gate", "Four", "first item", "second item"]


@pytest.mark.parametrize(("word", "count"), [("cat", 1), ("table", 2), ("tables", 2), ("make", 1), ("jumped", 1), ("wanted", 2), ("reading", 2), ("authorization", 5), ("information", 4), ("big-red", 2)])
def test_syllables(word, count):
    assert syllables(word) == count


def test_levels_follow_difficulty():
    stages = (fit_cuts(np.zeros(0), np.zeros(0)),) * len(GRADES)
    assert np.allclose(stages[0], (5.75, 9.25, 13, 17))
    assert read_level(profile(SIMPLE)[2], stages) < 3 < read_level(profile(HARD)[2], stages)
    chained = [s for s in running_sentences(SIMPLE.replace(". ", " and then "))]
    assert abs(grades(chained)[0] - grades(running_sentences(SIMPLE))[0]) < 6  # a chain of short clauses stays easy


def test_units():
    units = lambda text: [t_units(s) for s in running_sentences(text)]
    assert units("The red cat ran and the dog sat, so we left it. The cat and dog ran when the man came. He ran and sat.") == [3, 1, 1]


def test_one_label_moves_only_its_cuts():
    cuts = fit_cuts(np.array([12.0]), np.array([1.0]))
    assert cuts[0] >= 12 and list(cuts) == sorted(cuts)


def test_cuts_against_all_choices():
    rng = np.random.default_rng(3)
    levels = np.repeat([1, 2, 3, 4, 5], 12).astype(float)
    values = levels * 3 + rng.normal(0, 1.5, len(levels))
    cuts = fit_cuts(values, levels)
    assert list(cuts) == sorted(cuts)
    found = 1 + np.searchsorted(cuts, values, "right")
    assert np.abs(found - levels).mean() <= np.abs(1 + np.searchsorted([4.5, 7.5, 10.5, 13.5], values, "right") - levels).mean()


def test_rows(spark):
    docs = spark.createDataFrame([(1, SIMPLE), (2, HARD), (3, None), (4, ""), (5, "Too short a text."), (6, "Der Hund und die Katze sind nicht im Haus. " * 20), (7, "| a | b |\n" * 60), (8, "   "), (2, HARD), (9, SIMPLE * 400)], "doc_id bigint, text string").selectExpr("*", "9 as words")
    labels = spark.createDataFrame([(1, "r", 1), (2, "r", None), (99, "r", 3)], "doc_id bigint, rater string, level bigint")
    got = rows(reading_levels(docs, labels, "doc_id", "text", "level"))
    assert [i for i, _ in got] == [1, 2, 2, 9] and dict(got)[1] < dict(got)[2] and dict(got)[1] == dict(got)[9]
    assert reading_levels(docs.limit(0), labels, "doc_id", "text", "level").count() == 0
    assert reading_levels(docs, labels.limit(0), "doc_id", "text", "level").count() == 4


def test_held_out_accuracy():
    pd = pytest.importorskip("pandas")
    folder = "/root/testdata/sf0.1"
    try:
        labels, docs = pd.read_parquet(f"{folder}/reading_labels.parquet"), pd.read_parquet(f"{folder}/documents.parquet", columns=["doc_id", "text"])
    except OSError:
        pytest.skip("no test data")
    level = labels[labels["level"].notna()].groupby("doc_id")["level"].median()
    text = docs.drop_duplicates("doc_id").set_index("doc_id")["text"]
    found = [(p[2], y) for i, y in level.items() if i in text.index and (p := profile(text[i]))]
    x, y = np.array([f for f, _ in found]), np.array([v for _, v in found])
    train = np.arange(len(y)) % 2 == 0
    cuts = tuple(fit_cuts(x[train][:, i], y[train]) for i in range(x.shape[1]))
    error = np.abs(np.array([read_level(v, cuts) for v in x[~train]]) - y[~train])
    assert error.mean() < 0.3 and (error <= 1).mean() > 0.98  # raters err by one themselves
