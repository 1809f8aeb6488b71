"""The reading level that running English text demands of its reader.

Running text is what is left of a document without code, tables, log lines, dumps, headings and inline identifiers.
Its sentences, words and syllables, the last by hyphenation-style rules, give four classic school grades, each of which
is read on the scale of levels; their median is the document's level. The places of the levels on each grade's scale are
fitted on a bounded sample of labelled documents.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from statistics import median

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrill.session import cut

#: Words a document needs, and the share of its running text's sentences, by words, that has to be English.
LEAST_WORDS, ENGLISH_SHARE = 50, 0.5

#: Most labelled documents the cuts are fitted on.
LABELLED = 20_000

#: Common words that tell English from its neighbours.
ENGLISH = frozenset("the a an and or but of to in on at for from with by as is are was be been it its this that these those some any each every no not do does did you your he she they we i his her their our can will would should may must if when while because after before so who which what has have had there then than into out up over all more one now".split())
FOREIGN = frozenset("der die das und ist nicht ein eine den dem des auf mit für sich im bitte jede jeder danach niemand le la les des un une et est pas ne dans du pour sur avec que qui chaque personne ensuite el los las una y es no en del por con se al cada mañana después otra il lo gli di che non per sono".split()) - ENGLISH

#: Abbreviations whose dot ends no sentence.
ABBREVIATIONS = frozenset(("mr", "mrs", "ms", "dr", "st", "jr", "sr", "vs", "no", "sec", "fig", "cf", "eg", "ie", "e.g", "i.e", "etc", "approx", "a.m", "p.m", "inc", "ltd", "dept", "al", "vol", "pp"))

_FENCE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[ \t]*$|\Z)", re.M | re.S)
_ANSI = re.compile(r"\x1b\[[0-9;?]*[A-Za-z]")
_TAG = re.compile(r"<!--.*?-->|</?[a-zA-Z][^<>]*>", re.S)
_LINK = re.compile(r"!?\[([^\[\]]*)\]\([^()\s]*(?:\s\"[^\"]*\")?\)")
_JSON = re.compile(r"\{\s*\"(?:[^{}\"]|\"(?:[^\"\\]|\\.)*\")*\}", re.S)
_INLINE_CODE = re.compile(r"`[^`\n]*`")
#: Inline matter that is no running text, each looked for only where its mark is in the text.
_NOISE = (
    ("://", re.compile(r"https?://\S+")),
    ("(", re.compile(r"\((?:see |cf\.? )?[^()]{0,40}[0-9_][^()]{0,40}\)")),
    ("[", re.compile(r"\[[0-9a-fA-F]{4,}\]")),
    ("_", re.compile(r"\b\w+(?:_\w+)+\b")),
    ("-", re.compile(r"\b[a-z]+-\d+\b")),
    (".", re.compile(r"\bv?\d+(?:\.\d+)+\b")),
)
_ITEM = re.compile(r"^[ \t>]*(?:[-*+•]|\d+[.)])[ \t]+")
_HEADING = re.compile(r"^[ \t]*#{1,6}[ \t]|^[ \t]*(?:=+|-{3,}|\*{3,})[ \t]*$")
_LOG = re.compile(r"^\s*(?:\[?\d{4}-\d\d-\d\d[T ]\d\d:|\d\d:\d\d:\d\d|\||\+[-+]+\+|[{}\[\]]|\"[^\"]*\"\s*:|at \w+[.(]|\$ |>>> |(?:import|from|def|class|const|let|var|export|return) .*[=({;:]|\w+\s*=\s*\S+$)")
_LETTERS = re.compile(r"[^\W\d_]")
_WORDS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_DOT = re.compile(r"\.")
_INITIAL_NEXT, _NAME_NEXT = re.compile(r"\s?[A-Za-z]\."), re.compile(r"\s[A-Z]")
_END = re.compile(r"[.!?…]+[\"'”’)\]]*(?:\s+|$)|[。！？]")


def _dot(found: re.Match) -> str:
    """A dot, or a blank where it ends no sentence: after an abbreviation, between digits, behind initials."""
    text, at = found.string, found.start()
    before, after = text[max(0, at - 8) : at], text[at + 1 : at + 4]
    token = re.split(r"[^A-Za-z.]+", before)[-1].lower()
    last = before[-1:]
    if token in ABBREVIATIONS or (last.isdigit() and after[:1].isdigit()):
        return " "
    if last.isalpha() and not before[-2:-1].isalnum() and (_INITIAL_NEXT.match(after) or (last.isupper() and _NAME_NEXT.match(after))):
        return " "
    return "."


def running_sentences(text: str) -> list[list[str]]:
    """The sentences of a document's running text, each as its words."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "\x1b" in text:
        text = _ANSI.sub("", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKC", text) if unicodedata.category(c) != "Cf")
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n\n", text)
    if '"' in text:
        text = _JSON.sub(" ", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "](" in text:
        text = _LINK.sub(r"\1", text)
    if "`" in text:
        text = _INLINE_CODE.sub(" ", text)
    for mark, pattern in _NOISE:
        if mark in text:
            text = pattern.sub(" ", text)
    units, open_unit = [], []
    for line in [*text.split("\n"), ""]:
        if not line.strip() or _HEADING.match(line) or _LOG.match(line):
            if open_unit:
                units.append(" ".join(open_unit))
            open_unit = []
        elif item := _ITEM.match(line):
            if open_unit:
                units.append(" ".join(open_unit))
            open_unit = [line[item.end() :]]
        else:
            open_unit.append(line.strip(" \t>*"))
    sentences = []
    for unit in units:
        for part in _END.split(_DOT.sub(_dot, unit)):
            if part and (words := _WORDS.findall(part)):
                sentences.append(words)
    return sentences


_SILENT = re.compile(r"(?:[^laeiouy]es|[^aeiouytd]ed|[^laeiouy]e)$")
_VOWELS = re.compile(r"[aeiouy]+")
_SPLIT = re.compile(r"i[aou](?!us)|eo(?!u)|ua(?!r)|uou|ying|[aeiouy]ing|ism$|[^aeiouy]le$|[^aeiouy]les$")
_JOIN = re.compile(r"[cgst]i[aou]|[gq]u[aeiou]|eous$|[aeiou]ely|[^aeiou]eful|[^aeiou]ement|[^aeiou]eless")


@lru_cache(maxsize=200_000)
def syllables(word: str) -> int:
    """Syllables of an English word: vowel groups, split and joined as a hyphenation would."""
    word = word.lower().strip("'’")
    if "-" in word:
        return sum(map(syllables, word.split("-")))
    if len(word) <= 3:
        return 1
    stem = _SILENT.sub("", word) if not re.search(r"[^aeiouy]les?$", word) else word
    count = len(_VOWELS.findall(stem)) + len(_SPLIT.findall(stem)) - len(_JOIN.findall(stem))
    if re.search(r"[^aeiouy]les?$", word):
        count -= 1
    return max(1, count)


#: The coordinators that join T-units, and common first words of a clause that tell them from those that
#: join names or verbs.
COORDINATORS = frozenset("and but or so".split())
CLAUSE_STARTS = frozenset("the a an your each any some every that this then it you he she they we i all its my our".split())

#: Names of the grades that ``grades`` gives, in order.
GRADES = ("kincaid", "fog", "coleman_liau", "ari")


def t_units(sentence: list[str]) -> int:
    """T-units of a sentence: main clauses, each with all that depends on it. A chain of short main clauses is no harder
    than as many sentences, while a subordinate clause makes its unit longer."""
    low = [w.lower() for w in sentence]
    return 1 + sum(low[i] in COORDINATORS and low[i + 1] in CLAUSE_STARTS and low[i - 1] not in COORDINATORS for i in range(2, len(low) - 2))


def grades(sentences: list[list[str]]) -> list[float]:
    """School grades by Flesch-Kincaid, Gunning fog, Coleman-Liau and ARI, with T-units as the formulas' sentences."""
    words = [w for s in sentences for w in s]
    n, m = len(words), sum(map(t_units, sentences))
    beats = [syllables(w) for w in words]
    letters, total, hard = sum(map(len, words)), sum(beats), sum(b >= 3 for b in beats)
    return [
        0.39 * n / m + 11.8 * total / n - 15.59,
        0.4 * (n / m + 100 * hard / n),
        5.88 * letters / n - 29.6 * m / n - 15.8,
        4.71 * letters / n + 0.5 * n / m - 21.43,
    ]


def profile(text: str | None) -> tuple | None:
    """(words, English words, grades) of a document's running text; None where it has no English sentence."""
    sentences = running_sentences(text) if text else []
    english, words = [], 0
    for s in sentences:
        words += len(s)
        joined = " ".join(s).lower()
        low = joined.split(" ")
        own, other = sum(map(ENGLISH.__contains__, low)), sum(map(FOREIGN.__contains__, low))
        plain = len(low) if joined.isascii() else sum(map(str.isascii, low))
        if own > other and own >= 0.08 * len(low) and plain >= 0.8 * len(low):
            english.append(s)
    if not english:
        return None
    return words, sum(map(len, english)), grades(english)


#: School grades in the middle of elementary, middle and high school, college and graduate reading. Each stands beside
#: the labelled texts as half a text of its level, so that a few labels move the cuts and many leave no trace of them.
STAGES, STAGE_WEIGHT = (4.0, 7.5, 11.0, 15.0, 19.0), 0.5


def fit_cuts(values: np.ndarray, levels: np.ndarray) -> tuple[float, ...]:
    """The four cuts of one grade that read the labelled levels with the least absolute error; without labels those
    between the school stages."""
    x, level = np.r_[values, STAGES], np.r_[levels, np.arange(1, 6)]
    weight = np.r_[np.ones(len(values)), np.full(5, STAGE_WEIGHT)]
    order = np.argsort(x, kind="stable")
    x, level, weight, n = x[order], level[order], weight[order], len(x)
    cost = np.abs(level[None, :] - np.arange(1, 6)[:, None]) * weight
    upto = np.concatenate([np.zeros((5, 1)), np.cumsum(cost, axis=1)], axis=1)
    best, back = upto[0], []
    for k in range(1, 5):  # best[i]: least error of the first i texts in levels up to k
        gain = best - upto[k]
        lowest = np.minimum.accumulate(gain)
        back.append(np.maximum.accumulate(np.where(gain == lowest, np.arange(n + 1), 0)))
        best = lowest + upto[k]
    cuts, i = [], n
    for at in reversed(back):
        i = int(at[i])
        cuts.append(float((x[max(i - 1, 0)] + x[min(i, n - 1)]) / 2))
    return tuple(reversed(cuts))


def read_level(found: list[float], cuts: tuple[tuple[float, ...], ...]) -> int:
    """Each grade on the scale of the levels, between its cuts in proportion; the median of all, as a level."""
    scaled = []
    for value, c in zip(found, cuts):
        ends = np.array([2 * c[0] - c[1], *c, 2 * c[3] - c[2]])
        scaled.append(float(np.interp(value, np.maximum.accumulate(ends), [0.5, 1.5, 2.5, 3.5, 4.5, 5.5])))
    return int(min(5, max(1, np.floor(median(scaled) + 0.5))))


def reading_profiles(df: DataFrame, text_id: str, text: str) -> DataFrame:
    """(text_id, words, english_words, grades array<double>) of each text with an English sentence; row by row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, p) for i, t in enumerate(batch.column(1).to_pylist()) if (p := profile(t)) is not None]
            if found:
                columns = [batch.column(0).take(pa.array([i for i, _ in found])), pa.array([p[0] for _, p in found], pa.int64()), pa.array([p[1] for _, p in found], pa.int64()), pa.array([p[2] for _, p in found], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "words", "english_words", "grades"])

    kind = df.schema[text_id].dataType.simpleString()
    slim = df.select(F.col(text_id).alias("_id"), F.col(text).alias("_text")).where("_text is not null")
    return slim.mapInArrow(read, f"_id {kind}, words bigint, english_words bigint, grades array<double>").withColumnRenamed("_id", text_id)


def fitted_cuts(profiles: DataFrame, labels: DataFrame, text_id: str, level: str, most: int = LABELLED) -> tuple[tuple[float, ...], ...]:
    """Cuts of every grade, fitted on the profiles of labelled texts, however few: at most ``most``, picked by a hash of
    the id; of several raters the median counts. The school stages count beside them, see ``STAGES``."""
    given = labels.where(F.col(level).between(1, 5) & F.col(text_id).isNotNull()).groupBy(text_id).agg(F.median(level).alias("_level"))
    picked = given.orderBy(F.xxhash64(text_id), text_id).limit(most)  # at most ``most`` rows, so they can be broadcast
    rows = profiles.dropDuplicates([text_id]).join(F.broadcast(picked), text_id).select("grades", "_level").limit(most).collect()
    found, levels = np.array([r[0] for r in rows]).reshape(-1, len(GRADES)), np.array([float(r[1]) for r in rows])
    return tuple(fit_cuts(found[:, i], levels) for i in range(len(GRADES)))


def reading_levels(df: DataFrame, labels: DataFrame, text_id: str, text: str, level: str, least_words: int = LEAST_WORDS, english: float = ENGLISH_SHARE) -> DataFrame:
    """(text_id, level) of each text whose running text is mainly English and has ``least_words`` words or more.

    Null, empty and blank texts, and texts of code, tables or dumps alone, have no row; repeated rows repeat theirs.
    Texts are read once: their profiles, four numbers a text, are written to the checkpoint folder, and both the fit and
    the levels come from these. Other columns are ignored, whatever their names.
    """
    fit = cut(reading_profiles(df, text_id, text).where((F.col("words") >= least_words) & (F.col("english_words") >= F.col("words") * english)).select(text_id, "grades"))
    cuts = fitted_cuts(fit, labels, text_id, level)

    def to_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([read_level(g, cuts) for g in batch.column(1).to_pylist()], pa.int64())], names=["_id", "level"])

    kind = df.schema[text_id].dataType.simpleString()
    return fit.select(F.col(text_id).alias("_id"), "grades").mapInArrow(to_level, f"_id {kind}, level bigint").withColumnRenamed("_id", text_id)
