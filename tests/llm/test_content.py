"""Near-duplicates, language, toxicity, licences, secrets, benchmark items and the pipeline on small fixtures."""

import hashlib
import itertools
import math
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dishlens.llm import decontaminate, language, licenses, secrets, simhash, tokens, toxicity
from dishlens.llm.common import prepare
from dishlens.llm.queries import QUERIES

from .conftest import prose
from .definitions import component_of, fingerprint_of


def test_fingerprint_by_definition():
    for text in ("", "  ", "One", "one two", "A b C d e f g", "É x y z Ž", prose(5, 300)):
        assert simhash.fingerprint(text) & (2**64 - 1) == fingerprint_of(text)


def test_thresholds_hold_the_pigeonhole():
    rng = np.random.default_rng(3)
    for spread in (1, 40, 65536):
        counts = np.stack([np.bincount(rng.integers(0, spread, 5000), minlength=1 << 16) for _ in range(4)])
        parts = simhash.choose(counts)
        assert sum(t + 1 for _, _, t in parts) == simhash.REACH + 1
        assert all(t >= 0 for _, _, t in parts)
    costs = [[0, 5, 9, 30, 40], [0, 1, 2, 50, 90], [0, 7, 8, 9, 9]]
    best = min((sum(c[t] for c, t in zip(costs, ts)), ts) for ts in itertools.product(range(5), repeat=3) if sum(ts) == 4)
    assert simhash.allocate(costs, 3)[1] == best[0]


@pytest.mark.parametrize("group", [2048, 8])
def test_links_equal_brute_force(spark, monkeypatch, group):
    """Random fingerprints with chains and a dense ball; with small groups every hot group is split into blocks."""
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = np.random.default_rng(7)
    values = {int(v) for v in rng.integers(-(2**63), 2**63 - 1, 60)}
    for start in list(values)[:6]:
        at = start & (2**64 - 1)
        for _ in range(12):
            for bit in rng.choice(64, 3, replace=False):
                at ^= 1 << int(bit)
            values.add(at - 2**64 if at >= 2**63 else at)
    ball = 0x1234567890ABCDEF
    values |= {ball ^ sum(1 << b for b in bits) for bits in itertools.combinations(range(0, 60, 4), 2)}
    nodes = sorted(values)
    classes = spark.createDataFrame(pd.DataFrame({"fp": nodes}))
    got = {r.node: r.low for r in simhash.components(simhash.links(classes)).collect()}
    want = component_of(nodes)
    named = {}
    for n in nodes:
        named.setdefault(want[n], set()).add(got.get(n, n))
    assert all(len(v) == 1 for v in named.values()) and len({next(iter(v)) for v in named.values()}) == len(named)


def test_near_duplicates(docs_of, odd):
    base = prose(11, 400)
    rows = odd + [(20, base), (21, base + " tion"), (22, base.replace("sher", "Sher")), (23, base), (24, base.replace(" ing ", " other ", 1))]
    got = simhash.near_duplicates(docs_of(rows)).collect()
    prints = [fingerprint_of(t or "") for _, t in rows]
    root = component_of(sorted(set(prints)))
    low = {}
    for (doc_id, _), p in zip(rows, prints):
        low[root[p]] = min([x for x in (low.get(root[p]), doc_id) if x is not None], default=None)
    want = sorted(((d, f"{p:016x}", low[root[p]]) for (d, _), p in zip(rows, prints)), key=repr)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=repr) == want
    kept = [r.doc_id for r in simhash.one_of_each(docs_of(rows)).collect()]
    assert sorted(k for k in kept if k is not None) == sorted({low[root[p]] for p in prints} - {None})
    assert simhash.near_duplicates(docs_of([])).collect() == []


def test_language(docs_of, odd):
    text = {"aa": "kala mata sula ", "bb": "grrt pwsk zzvd ", "cc": "éàù çèâ ûîô "}
    rows = [(k, (t * (1 + k % 5)) + prose(k, 2), lang) for k in range(90) for lang, t in [list(text.items())[k % 3]]]
    rows += [(1000 + k, t, None) for k, (_, t) in enumerate(odd)] + [(None, "kala sula mata", "aa"), (2000, "123 !?", "aa")]
    got = {(r.doc_id, r.held_out): r for r in language.identify(docs_of(rows)).collect()}
    assert len(got) == len(rows)
    for (doc_id, held), r in got.items():
        assert held == (doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        if doc_id is not None and doc_id < 90:
            assert r.lang_pred == ["aa", "bb", "cc"][doc_id % 3]
    assert got[2000, got_held(2000)].lang_pred == "und" and got[1000, got_held(1000)].lang_pred == "und"
    alone = language.identify(docs_of([(1, "abc", None)])).first()
    assert (alone.lang_pred, alone.score) == ("und", 0.0)
    assert language.identify(docs_of([])).collect() == []


def got_held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def toxic_rows():
    bad = ["scumly", "trashor", "idiotan"]
    rows, labels = [], []
    for k in range(480):
        words = prose(k, 40).split() + [f"w{k}x"]
        if k % 6 == 0:
            words.insert(5, bad[k % 18 // 6])
        rows.append((k, " ".join(words)))
        labels.append((k, int(k % 6 == 0)))
    return rows, labels


def test_toxicity(spark, docs_of, odd):
    rows, labels = toxic_rows()
    rows += [(1000 + k, t) for k, (_, t) in enumerate(odd)] + [(None, "scumly"), (2000, rows[0][1]), (2001, rows[0][1])]
    given = spark.createDataFrame([(*r, 1) for r in labels] + [(1, None, None), (None, 1, 1)], "doc_id long, toxic int, quality int")
    got = toxicity.toxicity(docs_of(rows), given).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[k].predicted == y for k, y in labels) and by[2000].score == by[2001].score
    assert all(0 <= r.score <= 1 for r in got) and by[1001].predicted == 0
    assert set(by[0].evidence) <= {k for k, y in labels if y}
    kept = toxicity.without_toxic(docs_of(rows), given)
    assert kept.columns == docs_of([]).columns
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 480} == {k for k, y in labels if not y}
    none = given.filter("false")
    assert {(r.score, r.predicted) for r in toxicity.toxicity(docs_of(rows[:3]), none).collect()} == {(0.0, 0)}
    assert toxicity.toxicity(docs_of([]), given).collect() == []


def test_block_max_search_is_exact(monkeypatch):
    monkeypatch.setattr(toxicity, "DENSE", 5)
    rng = np.random.default_rng(2)
    vectors = rng.random((700, 40)) * (rng.random((700, 40)) < 0.1)
    vectors[:250, 30:] = 0
    vectors /= np.maximum(np.sqrt((vectors**2).sum(1, keepdims=True)), 1e-9)
    vectors = vectors.astype(np.float32)
    rows = [(np.flatnonzero(v), v[np.flatnonzero(v)]) for v in vectors]
    index = toxicity.Index({}, np.ones(40), rows, np.zeros(700), np.arange(700)[::-1])
    opened, asked = [], [(np.sort(rng.choice(40, 4, replace=False)), rng.random(4)) for _ in range(60)]
    for (terms, weights), (at, cosine, n) in zip(asked, index.nearest(asked, 9), strict=True):
        opened.append(n)
        all_ = np.round(vectors[:, terms] @ weights, 6)
        want = sorted(((-c, 699 - k) for k, c in enumerate(all_) if c > 0))[:9]
        assert np.allclose([-c for c, _ in want], cosine, atol=2e-6)
        assert np.allclose(all_[699 - index.ids[at]], cosine, atol=2e-6)
    assert min(opened) < index.n_blocks


def test_scores_and_evidence_by_definition(spark, docs_of):
    """300 texts against all examples by plain cosines, no index."""
    rows, labels = toxic_rows()
    docs, given = docs_of(rows), spark.createDataFrame([(*r, 1) for r in labels], "doc_id long, toxic int, quality int")
    index = toxicity.learn(docs, given, toxicity.teaching())
    of = {t: k for t, k in index.terms.items()}
    vectors, names = {}, {k: t for k, t in rows}
    counts = lambda t: Counter(of[x] for x in toxicity.terms_of(t) if x in of)
    for k, t in rows:
        raw = {x: (1 + math.log(n)) * index.weight[x] for x, n in counts(t).items()}
        size = math.sqrt(sum(w * w for w in raw.values()))
        vectors[k] = {x: w / size for x, w in raw.items()}
    label = dict(labels)
    examples = [k for k in names if zlib.crc32(str(k).encode()) % 3 != 1]
    base = sum(label[k] for k in examples) / len(examples)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, given).collect()}
    for k in list(names)[:300]:
        near = sorted((-round(sum(w * vectors[e].get(x, 0) for x, w in vectors[k].items()), 5), e) for e in examples)[:15]
        votes = [1 / (max(1 + c, 0) + toxicity.NEAR) ** 2 for c, _ in near]
        want = (sum(v * label[e] for v, (_, e) in zip(votes, near, strict=True)) + toxicity.PRIOR * base) / (sum(votes) + toxicity.PRIOR)
        assert got[k].score == pytest.approx(want, abs=0.02)
        if k in examples:
            assert got[k].evidence[0] == k


def test_copies_of_toxic_examples_of_their_own_wording(spark, docs_of):
    """44 labelled toxic documents share no word that marks them; their copies are found by the neighbours alone."""
    own = lambda k: " ".join(f"q{chr(97 + (k * 7 + i) % 26)}{chr(97 + (k + i * 5) % 26)}{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for i in range(30))
    rows, labels = toxic_rows()
    taught = [k for k in range(5000, 5200) if zlib.crc32(str(k).encode()) % 3 != 1][:44]
    rows += [(k, own(k)) for k in taught] + [(k + 1000, own(k)) for k in taught]
    given = spark.createDataFrame([(*r, 1) for r in labels] + [(k, 1, 1) for k in taught], "doc_id long, toxic int, quality int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs_of(rows), given).collect()}
    for k in taught:
        assert got[k + 1000].predicted == 1 and got[k + 1000].evidence[0] == k and got[k + 1000].score == got[k].score


def test_licenses(spark):
    body = prose(3, 80)
    files = [
        (1, "a/b/LICENSE", "Licensed under the Apache License, Version 2.0."), (2, "a/b/c/x", body), (3, "a/y", body),
        (4, "a/b/c/z", body + "\nReleased under the MIT License."), (5, "LICENSE", "All rights reserved."), (6, None, body),
        (7, "q/r", None), (8, "a/b/w", prose(4, 200) + ". Licensed under CC BY-NC 4.0. " + prose(5, 30)),
        (9, "a/b/NOTICE", "Licensed under the Apache License, Version 2.0."),
    ]
    df = spark.createDataFrame([(*f, "k") for f in files], "doc_id long, path string, text string, directory string")
    got = {r.doc_id: (r.own_license, r.license, r.inherited_from) for r in licenses.scan_licenses(df).collect()}
    assert got[2] == (None, "apache-2.0", "a/b") and got[3] == (None, "all-rights-reserved", "")
    assert got[4][:2] == ("mit", "mit") and got[6] == (None, None, None) and got[7][1] == "all-rights-reserved"
    assert got[8][0] == "cc-by-nc" and got[1][0] == "apache-2.0" and len(got) == len(files)
    assert licenses.scan_licenses(df.filter("false")).collect() == []


def whole_files():
    """Complete licence files: the title, and for long licences a body of which no paragraph is a template."""
    body = "\n\n".join(prose(k, 120) + "." for k in range(6))
    mit, bsd, isc = (list(x) for x in (licenses._MIT, licenses._BSD, licenses._ISC))
    reserved = "Copyright (c) 2024, Jane Doe. All rights reserved."
    files = [
        ("apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004\n\n" + body),
        ("gpl-2", "GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n" + body),
        ("gpl-3", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n" + body),
        ("lgpl", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999\n\n" + body),
        ("lgpl", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\n" + body),
        ("mpl-2.0", "Mozilla Public License Version 2.0\n==================================\n\n" + body),
        ("cc0", "Creative Commons Legal Code\n\nCC0 1.0 Universal\n\n" + body),
        ("artistic-2.0", "The Artistic License 2.0\n\n" + body),
        ("isc", "ISC License\n\nCopyright (c) 2024 Jane Doe\n\n" + "\n\n".join(isc)),
        ("mit", "MIT License\n\n" + reserved + "\n\n" + "\n\n".join(mit)), ("mit", reserved + "\n\n" + "\n\n".join(mit)),
        ("bsd", reserved + "\n\n" + "\n\n".join(bsd)), ("bsd", "BSD License\n\nAll rights reserved.\n\n" + "\n\n".join(bsd)),
        ("all-rights-reserved", "All rights reserved."),
    ]
    return [(want, text) for want, text in files]


def test_complete_licence_files_speak_for_their_directories(spark):
    files = whole_files()
    rows = [(2 * k, f"d{k}/LICENSE", text) for k, (_, text) in enumerate(files)] + [
        (2 * k + 1, f"d{k}/src/x", prose(k + 40, 60)) for k in range(len(files))]
    rows += [(900, "e/empty", ""), (901, "e/long", "\n".join(prose(k, 50) for k in range(300))), (902, "e/long", "x"), (902, "e/long", "x")]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").repartition(3)
    got = licenses.scan_licenses(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for k, (want, _) in enumerate(files):
        assert (by[2 * k].own_license, by[2 * k].license_file) == (want, True), want
        assert (by[2 * k + 1].own_license, by[2 * k + 1].license, by[2 * k + 1].inherited_from) == (None, want, f"d{k}")
    assert by[900].license is None and by[901].license is None and by[902].license is None


def test_segments_by_plain_cosine():
    """Every line of the files above against every template by a plain definition."""
    idf = np.linspace(1, 9, len(licenses._vocabulary()))
    matcher = licenses.Matcher(idf, 9.5)
    place = licenses._vocabulary()
    for _, text in whole_files():
        for line in text.split("\n")[:12]:
            counts = Counter(licenses.words(line))
            if not counts:
                continue
            weigh = lambda c: {w: n * (idf[place[w]] if w in place else 9.5) for w, n in c.items()}
            v = weigh(counts)
            size = lambda x: math.sqrt(sum(a * a for a in x.values()))
            best = 0.0
            for name in sorted(licenses.TEMPLATES):
                for wording in licenses.TEMPLATES[name]:
                    t = weigh(Counter(licenses.words(wording)))
                    best = max(best, sum(v[w] * t.get(w, 0) for w in v) / size(v) / size(t))
            assert matcher.cosine(line)[0] == pytest.approx(best, abs=1e-9)
            if best >= licenses.SURE:
                assert matcher.scan(line)[1] == pytest.approx(best, abs=1e-9)


def test_license_segments(spark):
    def wrapped(text, prefix=""):
        return "\n".join(prefix + line for line in textwrap.wrap(text, 72))

    mit, bsd, gpl = licenses._MIT, licenses._BSD, licenses._gnu("General", 3)[1]
    texts = [
        ("Copyright 2024 Jane Doe. Licensed under the MIT License.", "mit", False),
        ("See below for terms. Released under the MIT License.", "mit", False),
        (wrapped(gpl, "# "), "gpl-3", True), (gpl, "gpl-3", True), (wrapped(gpl.replace("version 3", "version 2"), " * "), "gpl-2", True),
        (wrapped("".join(licenses._APACHE), "// "), "apache-2.0", True), (wrapped(licenses._MPL), "mpl-2.0", True),
        ("MIT License\n\nCopyright (c) 2024 Jane Doe\n\n" + "\n\n".join(map(wrapped, mit)), "mit", True),
        ("\n\n".join(mit), "mit", True), (mit[0], "mit", True),
        ("Copyright (c) 2024, Jane Doe\n\n" + "\n\n".join(map(wrapped, bsd)), "bsd", True),
        (prose(8, 50) + "\nThis work is licensed under the\nGNU General Public License, version 2. " + prose(9, 40), "gpl-2", False),
        ("The licence of the car and the version of the work are in the house.", None, False),
    ]
    rows = [(k, f"d{k}/x", t) for k, (t, _, _) in enumerate(texts)] + [(100 + k, f"p{k}/x", prose(k, 60)) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    assert [got[k].own_license for k in range(len(texts))] == [name for _, name, _ in texts]
    assert all(got[k].license_file for k, (_, _, file) in enumerate(texts) if file)
    assert not any(got[100 + k].own_license for k in range(200))


def plain_spans(text):
    pattern = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    found = [(m.start(), 0, m.end(), "assign") for m in pattern.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def test_secrets(docs_of, odd):
    texts = [t or "" for _, t in odd] + [
        'é API_KEY: "abcdefghijkl" token=short AKIA' + "A1" * 8 + " x" + "0f" * 9, "AKIASHORT AKIAAKIA" + "B" * 12,
        "client_id = web-front7 then Zk8Qw93LmNpX77rTuVa2 at https://db.example.com/x",  # three weak parts
        "client_id = web-front7 and nothing else", "only Zk8Qw93LmNpX77rTuVa2 here",
        "client_id = web-front7\n\nZk8Qw93LmNpX77rTuVa2",  # another paragraph
        "client_id = web-front7 " + "x " * 300 + "Zk8Qw93LmNpX77rTuVa2",  # too far
    ]
    got = {r.doc_id: r for r in secrets.find_secrets(docs_of(list(enumerate(texts)))).collect()}
    for k, text in enumerate(texts):
        spans = plain_spans(text)
        want = ",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in spans)
        assert got[k].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [got[k].n_assign, got[k].n_access, got[k].n_hex] == [sum(s[1] == n for s in spans) for n in range(3)]
        assert set(want.split(",")) - {""} <= set(got[k].spans.split(","))
    n = len(odd) + 2
    assert [("linked" in got[k].spans) for k in range(n, n + 5)] == [True, False, False, False, False]
    assert re.findall(r"linked_\w+", got[n].spans) == ["linked_id", "linked_secret", "linked_endpoint"]
    clean = {r.doc_id: r for r in secrets.redact(docs_of([*enumerate(texts), (99, None)])).collect()}
    assert "Zk8Q" not in clean[n].text and clean[n].n_chars == len(clean[n].text) and clean[n + 1].text == texts[n + 1]
    assert clean[99].text is None and not any(plain_spans(r.text or "") for r in clean.values())
    assert secrets.find_secrets(docs_of([])).collect() == []


ITEMS = [
    (1, "A train leaves town with Anna and covers 120 km in 3 hours, so how fast does Anna travel on her way to Paris today?"),
    (2, "Erble thonou was reath onti leer sher ouat, hely ndes blet andor wher ing tion eres thon."), (3, ""), (4, "Short item here"),
    (5, None), (2, "Erble thonou was reath onti leer sher ouat, hely ndes blet andor wher ing tion eres thon."),
]


def test_decontamination(spark, docs_of, odd):
    asked = ITEMS[0][1]
    again = asked.replace("Anna", "Bob").replace("120", "95").replace("km", "miles").replace("Paris", "Rome")
    mixed = asked.replace("with Anna", "with Bob").replace("120", "95")  # one name stands for two
    rows = odd + [
        (30, prose(1, 50) + ". " + asked + " " + prose(2, 9)), (31, "Well. " + again), (32, "Well. " + mixed),
        (33, "x\n" + ITEMS[1][1].upper()), (34, "And a Short item here too"), (35, "Well. " + ITEMS[1][1] + " " + ITEMS[1][1]),
        (None, asked),
    ]
    items = spark.createDataFrame([(*i, "t") for i in ITEMS], "item_id long, text string, hash string")
    got = {(r.doc_id, r.item_id, r.same_values) for r in decontaminate.contaminated(docs_of(rows), items).collect()}
    assert {(30, 1, True), (31, 1, False), (35, 2, True), (34, 4, True), (None, 1, True)} <= got
    assert not any(d == 32 for d, _, _ in got) and all(d is None or d >= 30 for d, _, _ in got)
    kept = decontaminate.without_benchmark(docs_of(rows), items)
    assert kept.columns == docs_of([]).columns
    assert {r.doc_id for r in kept.collect()} >= {r[0] for r in odd} | {32}
    assert decontaminate.contaminated(docs_of([]), items).collect() == []
    assert decontaminate.contaminated(docs_of(rows), items.filter("false")).collect() == []


def edited(text, how, at):
    """The text with a word inserted before, deleted at or put in place of the words at these places."""
    words = text.split()
    for k in sorted(at, reverse=True):
        words[k: k + (how != "insert")] = [] if how == "delete" else ["zzq"]
    return " ".join(words)


def letters(seed, n):
    return " ".join(hashlib.sha256(f"{seed} {k}".encode()).hexdigest().translate(str.maketrans("0123456789", "ghijklmnop"))[:6] for k in range(n))


def test_decontamination_finds_edited_items(spark, docs_of):
    items = [(n, letters(n, n), "t") for n in (8, 12, 15, 22, 38, 59)]
    rows, want = [], set()
    for n, text, _ in items:
        places = [[n // 2]] + ([[n // 3, 2 * n // 3]] if n >= 15 else [])
        for how, at in itertools.product(("insert", "delete", "replace"), places):
            want.add((len(rows), n))
            rows.append((len(rows), prose(n, 20) + ". " + edited(text, how, at) + " " + prose(n + 1, 20)))
    halves = [(1000 + n, prose(n, 9) + " " + " ".join(t.split()[: n // 3]) + " " + prose(n, 9)) for n, t, _ in items]
    benchmark = spark.createDataFrame(items, "item_id long, text string, hash string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs_of(rows + halves), benchmark).collect()}
    assert got == want


def test_decontamination_whatever_the_case(spark, docs_of):
    items = [ITEMS[0], (2, ITEMS[1][1]), (6, "Bob met Anna Maria Lund in Old Rome. Then Carl Berg, of New York, left with Eva on 3 trains")]
    copies = {"upper": str.upper, "lower": str.lower, "title": str.title, "stops": lambda t: "and " + t.replace(".", "")}
    rows, want = [], set()
    for item, text in items:
        for change in copies.values():
            want.add((len(rows), item, True))
            rows.append((len(rows), "well " + prose(item, 12) + " " + change(text) + " " + prose(item + 1, 12)))
    rows += [(100, "x\n" + ITEMS[1][1].upper())]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.same_values) for r in decontaminate.contaminated(docs_of(rows), benchmark).collect()}
    assert got == want | {(100, 2, True)}


def test_decontamination_tolerates_single_slots(spark, docs_of):
    items = [
        (1, "The girl called Anna walked home while little Anna sang and then her friend saw Anna near the old mill by the lake"),
        (2, "A jug holds 3 cups of milk and a bowl holds 5 cups of water so which of the two vessels must be filled more often"),
        (3, "The baker sells 2 loaves to every child and 2 buns to every parent who comes so how much bread is left in the evening"),
        (4, "It takes 7 minutes to walk from the farm to the well and then the whole way back again takes 7 minutes as well"),
        (5, "When Anna met Carl at the gate she told him that Anna would leave and Carl would stay in the house for good"),
    ]
    text = dict(items)
    copies = [
        (10, 1, text[1].replace("saw Anna", "saw Ana")), (20, 2, text[2].replace("3", "4").replace("5", "4")),
        (30, 3, text[3].replace("2 loaves", "3 loaves").replace("2 buns", "7 buns")),
        (40, 4, text[4].replace("7 minutes to", "8 minute to").replace("7 minutes as", "9 mins as")),
        (50, 5, text[5].replace("Anna", "Eva").replace("Carl", "Otto")),
    ]
    mixed = [(60, "well " + text[5].replace("met Carl", "met Otto").replace("Anna would", "Eva would"))]  # no name stays itself
    rows = [(d, "well " + t + " " + prose(d, 9)) for d, _, t in copies] + mixed
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.same_values) for r in decontaminate.contaminated(docs_of(rows), benchmark).collect()}
    assert got == {(d, i, False) for d, i, _ in copies}


def test_decontamination_of_short_items(spark, docs_of):
    items = [
        (1, "42"), (2, "Yes."), (3, "Paris"), (4, "12 km"), (5, "It weighs about 12 kg"), (6, ""), (7, "The answer is Paris"),
        (8, "Add these " + " ".join(str(k) for k in range(100, 120))),
    ]
    rows = [
        (k, f"so {k + 3} men said yes. They saw Rome " + prose(k, 20) + f" and {k} km on") for k in range(20)
    ] + [
        (100, "in all it weighs about 12 kg now"), (101, "in all it weighs about 13 kg now"), (102, "so the answer is Paris here"),
        (103, "so the answer is Rome here"), (104, " ".join(str(k) for k in range(500, 560))), (105, "we " + items[7][1].lower()),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.same_values) for r in decontaminate.contaminated(docs_of(rows), benchmark).collect()}
    assert got == {(100, 5, True), (102, 7, True), (105, 8, True)}
    assert {r.item_id for r in decontaminate.undecidable(benchmark).collect()} == {1, 2, 3, 4}
    kept = {r.doc_id for r in decontaminate.without_benchmark(docs_of(rows), benchmark).collect()}
    assert kept == {r[0] for r in rows} - {100, 102, 105}


def test_pipeline(spark, docs_of, tmp_path):
    rows, labels = toxic_rows()
    asked = ITEMS[0][1]
    rows = [(k, t + f" tail{k} " + prose(k + 50, 30)) for k, t in rows] + [(1500, asked), (1501, "password = Abcdef123456789 ok"), (1502, "password = Abcdef123456789 ok")]
    docs = docs_of(rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(*r, 1) for r in labels], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(ITEMS[:1], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
        kept[name] = {r.doc_id: r.text for r in at.collect()}
    bad = {k for k, y in labels if y}
    assert set(kept["toxicity"]) == {r[0] for r in rows} - bad
    clean = [(k, t) for k, t in rows if k not in bad]
    root = component_of(sorted({fingerprint_of(t) for _, t in clean}))
    low = {}
    for k, t in clean:
        low.setdefault(root[fingerprint_of(t)], k)
    assert set(kept["near_duplicates"]) == set(low.values()) and 1502 not in low.values()
    assert set(kept["benchmark"]) == set(low.values()) - {1500}
    assert kept["secrets"][1501] == "[secret] ok"
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(kept["secrets"])


def test_terms_are_counted_for_many_texts_at_once(monkeypatch):
    """op7: a run's equal chunks are looked up once; numbers and counts are those of each text by itself."""
    given = ["", " ", "Straße, straße... STRASSE", "Σας ΑΣ ΑΣ.", "½ Ⅷ x²y", "über_straße Übergänge, İs foo-bar foobarbaz", "a\x00b\n\na\tA", "---", ""] * 20
    terms = {t: k for k, t in enumerate(sorted({t for text in given for t in toxicity.terms_of(text)} - {"a"}))}
    alone, asked = toxicity.lookup(terms), []
    for held in (terms, {}):
        counts = toxicity.TermCounts(held)
        counts.other = lambda text, other=counts.other: asked.append(text) or other(text)
        found = []
        for numbers, times, bounds in counts.runs(pa.array(given)):
            found += [dict(zip(numbers[a:b].tolist(), times[a:b].tolist(), strict=True)) for a, b in zip(bounds, bounds[1:])]
        assert found == [dict(Counter(alone(t))) if held else {} for t in given]
    assert len(asked) < 40
    monkeypatch.setattr(tokens, "RUN_BYTES", 30)
    assert sum(len(bounds) - 1 for *_, bounds in toxicity.TermCounts(terms).runs(pa.array(given))) == len(given)


def test_texts_go_to_python_by_bytes(spark):
    """pipeline: a session that says nothing of batches gets some of a few MB, in each of the ways that the stages use."""
    bare, key = spark.newSession(), "spark.sql.execution.arrow.maxBytesPerBatch"
    bare.conf.unset(key)
    bare.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    prepare(bare)
    docs = bare.range(0, 64, 1, 1).select("id", F.expr("repeat('lorem ipsum ', 50000)").alias("text"))  # 38 MB

    def frames(batches):
        for pdf in batches:
            yield pd.DataFrame({"n": [len(pdf)]})

    def arrow(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    rows = F.pandas_udf(lambda text: pd.Series(len(text), text.index), "long")
    found = [docs.mapInPandas(frames, "n long"), docs.mapInArrow(arrow, "n long"), docs.select(rows("text").alias("n"))]
    assert all(max(r.n for r in df.collect()) <= 16 for df in found)
    bare.conf.set(key, "5m")
    assert prepare(bare).conf.get(key) == "5m"


def test_registered():
    import __spark_entry__ as driver

    assert {f"op{n}" for n in range(1, 11)} == {n.split("_")[0] for n in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(driver.queries())
