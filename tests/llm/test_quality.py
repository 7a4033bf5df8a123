"""Quality rules against plain Python."""

import math
import re
from collections import Counter

import pytest
import xxhash

from dishlens.llm import quality
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k: k + 5]) for k in range(len(words) - 4)]
    often = Counter(windows)
    covered = {p for k, w in enumerate(windows) if often[w] > 1 for p in range(k, k + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
        len(covered), failed,
    )


def chained(*values):
    seed = 42
    for v in values:
        raw = v.to_bytes(4, "little", signed=True) if isinstance(v, int) else v.encode()
        if isinstance(v, int):
            seed = _int_hash(v, seed)
        else:
            seed = xxhash.xxh64_intdigest(raw, seed)
    return seed


def _int_hash(v, seed):
    return xxhash.xxh64_intdigest(v.to_bytes(4, "little", signed=True), seed)


def grams(text):
    words = WORD.findall(text or "")
    bucket = lambda *x: (chained(*x) - (1 << 64 if chained(*x) >> 63 else 0)) % quality.BUCKETS
    return [g for k, w in enumerate(words) for g in (
        bucket(w), bucket(w[-3:], 3), *([bucket(w, words[k + 1])] if k + 1 < len(words) else []))]


def plain_scores(rows, trusted):
    raw, good = Counter(), Counter()
    for doc_id, text in rows:
        raw.update(grams(text))
        if doc_id in trusted:
            good.update(grams(text))
    share = sum(good.values()) / max(sum(raw.values()), 1)
    weight = {g: round(math.log((good[g] + quality.PRIOR) / (raw[g] * share + quality.PRIOR)) * 1e6) for g in raw}
    return {text or "": sum(weight[g] for g in grams(text)) / max(len(grams(text)), 1) / 1e6 for _, text in rows}


@pytest.fixture(scope="module")
def rows(odd):
    junk = [(100 + k, " ".join(w + "%%%" for w in prose(k, 30).split())) for k in range(12)]
    clean = [(200 + k, prose(k, 40).capitalize() + ".") for k in range(40)]
    more = [
        (300, "a b c d e f g h i j a b c d e f g h i j x"), (301, "spam " * 50), (302, "one\n\ntwo\none\n \none"),
        (303, "\x1cq\x0bw\x0ce\rr\tt  y "), (304, "a b c d e a b c d e a b c d e"), (305, "<|a|> & #*$%"),
        (306, prose(5, 4) + " " + prose(6, 5) + " " + prose(7, 30) + " " + prose(6, 5) + " " + prose(8, 5)),
        (307, " ".join([prose(9, 2000)] * 2 + [prose(10, 9000)])),
    ]
    return odd + junk + clean + more


@pytest.fixture(scope="module")
def labels(spark, rows):
    given = [(i, 1, 0) for i, _ in rows if i is not None and i >= 200] + [(k, 0, 0) for k in range(100, 112)]
    return spark.createDataFrame([*given, (200, 0, 0), (999, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")


def test_counts_scores_and_verdicts(docs_of, rows, labels):
    got = quality.scored(docs_of(rows).repartition(3), labels).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == Counter(
        (i, *plain_counts(t)) for i, t in rows)
    scores = plain_scores(rows, {i for i, _ in rows if i is not None and i > 200})
    texts = dict(rows)
    for r in got:
        if r.doc_id is not None:
            assert r.score == pytest.approx(scores[texts[r.doc_id] or ""], abs=3e-6)
        assert r.kept == (not r.base_failed and r.score >= quality.CUT)
    of = {r.doc_id: r for r in got}
    assert not any(of[k].kept for k in range(100, 112)) and all(of[k].kept for k in range(200, 240))


def test_windows_of_one_repeated_word(docs_of, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = [(1, "x " * n) for n in (1, 4, 5, 6, 9)]
    got = quality.scored(docs_of(rows), labels).collect()
    assert sorted((r.n_words, r.n_repeat_words) for r in got) == [(1, 0), (4, 0), (5, 0), (6, 6), (9, 9)]
    assert all(r.score == 0.0 for r in got)
    assert quality.scored(docs_of([]), labels).collect() == []


def test_no_python_and_no_texts_shuffled(docs_of, rows, labels):
    plan = quality.scored(docs_of(rows), labels)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and plan.count("Exchange hashpartitioning") == 1
