"""Passages that stand in comments and in what looks like a tag."""

import random

from conftest import rows

from tallyrill.llm import leakage


def words(seed, n):
    return ["".join(random.Random(f"{seed} {i}").choices("ghijklmnop", k=12)) for i in range(n)]


def test_passages_in_comments_and_spans(spark):
    item = words("item", 60)
    passage = " ".join(item[10:35])
    texts = {
        "comment": f"Some text. <!-- {passage} --> More of it.",
        "marked": f"<!-- note: <b>{' '.join(item[10:20])}</b> <a href='http://x.org/some/long/path'>{' '.join(item[20:35])}</a> -->",
        "span": f"less <x {passage[:280]} > more",
        "loose": f"so a <b {passage} > c",
        "attribute": f'<img src="p.png" alt="{passage}">',
        "past": f"{' '.join(item[10:22])} <!-- {' '.join(words('other', 12))} --> {' '.join(item[22:35])}",
        "into": f"{' '.join(item[10:22])} <!-- {' '.join(item[22:35])} -->",
        "none": f"<!-- {' '.join(words('other', 40))} --> <p class='x y'>text</p>",
    }
    docs = spark.createDataFrame(list(texts.items()), "id string, text string")
    items = spark.createDataFrame([("i", " ".join(item)), ("hidden", f"<!-- {' '.join(item)} --> {' '.join(words('rest', 30))}")], "item string, text string")
    assert rows(leakage.find_leaks(docs, items, "id", "text", "item", "text")) == [(t, i) for t in sorted(texts) if t != "none" for i in ("hidden", "i")]
    assert leakage.readings("<p>a <i>b</i></p>") == [["a", "b"]] and leakage.readings("a<!-- -->b") == [["ab"]]
