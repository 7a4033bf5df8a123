"""Sharding, fingerprints, token files and packing against plain Python."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from dishlens.llm import merkle, packing, shard_tree, tokens, wavelet
from dishlens.llm.queries import TOKENIZER
from dishlens.llm.tokens import WordEncoder, encoder

from .conftest import prose

TREE = shard_tree.balanced(16)


def plain_place(doc_id, tree):
    def draw(path, weight):
        seed = 42 if doc_id is None else xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True), 42)
        bits = xxhash.xxh64_intdigest(path.encode(), seed) >> 11
        return -np.log((bits + 0.5) * 2.0**-53) / weight

    path, node = "", tree
    while isinstance(node, dict):
        name = min((n for n in node if shard_tree._weight(node[n]) > 0), key=lambda n: draw(f"{path}/{n}", shard_tree._weight(node[n])))
        path, node = f"{path}/{name}", node[name]
    return int(path.rsplit("/", 1)[1])


def test_shards(docs_of, odd):
    got = shard_tree.shard_documents(docs_of(odd), TREE, 16, buckets=3).collect()
    assert len(got) == len(odd)
    want = Counter()
    for doc_id, text in odd:
        raw = (text or "").encode()
        want[doc_id, len(raw) + 1, zlib.crc32(raw), plain_place(doc_id, TREE), plain_place(doc_id, shard_tree.grown(TREE, 16))] += 1
    assert Counter((r.doc_id, r.size, r.text_crc32, r["shard"], r.grown_shard) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shard_tree.shard_documents(docs_of([]), TREE, 16).collect() == []


def test_shards_move_only_within_changed_subtrees(spark):
    ids = spark.range(4000).withColumnRenamed("id", "doc_id")
    heavier = {r: {k: dict(s) for k, s in racks.items()} for r, racks in TREE.items()}
    heavier["region1"]["rack2"][9] = 3.0
    zero = {r: {k: dict(s) for k, s in racks.items()} for r, racks in TREE.items()}
    zero["region0"]["rack0"][2] = 0.0
    df = shard_tree.placed(ids, "doc_id", TREE, "a")
    for name, tree in (("b", shard_tree.grown(TREE, 16)), ("c", heavier), ("d", zero)):
        df = shard_tree.placed(df, "doc_id", tree, name)
    rows = df.collect()
    assert all(r.b in (r.a, 16) for r in rows) and 100 < sum(r.b == 16 for r in rows) < 400
    of = {n: (g, k) for g, racks in TREE.items() for k, s in racks.items() for n in s}
    for r in rows:
        if r.a != r.c and of[r.a][0] == of[r.c][0]:  # within a region: into the rack or the shard that grew
            assert of[r.c] == of[9] and (of[r.a] != of[9] or r.c == 9)
        if r.a != r.c and of[r.a][0] != of[r.c][0]:
            assert of[r.c][0] == of[9][0]
        assert r.d != 2
        if r.a != 2 and of[r.a][0] == "region1":
            assert r.a == r.d
    with pytest.raises(ValueError):
        shard_tree.grown(TREE, 3)


def test_fingerprints(docs_of, odd):
    rows = [r for r in odd if r[0] is not None] + [(None, "zz"), (6, "x" * 500)] + [(None, prose(k, 5)) for k in range(9)] + [(None, "zz")]
    got = merkle.document_fingerprints(docs_of(rows), docs_per_range=3).collect()
    mixed = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) >> 12
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, mixed(r[1]), r[1]))
    want = Counter()
    for (doc_id, text), (_, after) in zip(order, order[1:] + order[:1]):
        new = merkle.edited(text, after)
        want[doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), merkle.tree(text)[0].hex(), merkle.tree(new)[0].hex()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert merkle.document_fingerprints(docs_of([])).collect() == []
    assert merkle.document_fingerprints(docs_of([(1, "abc")])).first().near_next == 1.0


def test_trees_locate_edits():
    a = "One two.\nThree four, five.\n\nSix seven.\nEight."
    b = a.replace("seven", "nine")
    assert merkle.tree(a)[0] != merkle.tree(b)[0]
    where = merkle.first_difference(merkle.tree(a), merkle.tree(b))
    node = merkle.tree(a)
    for k in where[:3]:
        node = node[2][k]
    assert node[2].startswith("Six seven") and len(where) == 4
    assert merkle.first_difference(merkle.tree(a), merkle.tree(a)) == ()
    assert 0.6 < merkle.likeness(merkle.tree(a), merkle.tree(b)) < 1
    assert merkle.likeness(merkle.tree(""), merkle.tree("")) == 1.0 and merkle.likeness(merkle.tree(""), merkle.tree("x")) == 0.0


def long_text(seed):
    return "\n".join(", ".join(prose(seed * 1000 + 7 * k + j, 6) for j in range(5)) + "." for k in range(60)) + "\n"


def test_an_edit_opens_no_other_branch():
    """An edit in one paragraph opens its section, the paragraph and the clause; all other clauses stay unseen."""
    text = long_text(1)
    own = merkle.tree(text)
    assert len(own[2]) > 3  # several sections, without a blank line
    lines = text.split("\n")
    for at in (0, 17, 40, 59):
        changed = lines[:]
        changed[at] = changed[at].replace(" ", " q", 1)
        other = merkle.tree("\n".join(changed))
        same, edits, seen = merkle.compare(own, other)
        wide = max(len(x[2]) for x in own[2])
        assert seen <= 1 + 2 * (len(own[2]) + 2) + 2 * 2 * (wide + 2) + 2 * 6 + 2 * merkle.LONGEST
        assert len({e[:3] for e in edits}) <= 3 and 0.97 < merkle.likeness(own, other) < 1
        assert merkle.likeness(own, other) == merkle.likeness(other, own)


def test_likeness_and_edits_by_definition():
    """Removed, added and moved paragraphs; all edits are named, and what is matched is equal and in order."""
    lines = long_text(2).splitlines(keepends=True)
    size = sum(map(len, lines))
    own = merkle.tree("".join(lines))
    for new, share in (
        (lines[:20] + lines[23:], 1 - sum(map(len, lines[20:23])) / size),
        (lines[:20] + lines[40:] , sum(map(len, lines[:20] + lines[40:])) / size),
        (lines[30:] + lines[:30], 0.4), (lines[:5], sum(map(len, lines[:5])) / size), ([x.upper() for x in lines], 0.0),
    ):
        near = merkle.likeness(own, merkle.tree("".join(new)))
        assert near <= share + 0.2 and (near >= share - 0.2 or share == 0.4)
    draw = random.Random(5)
    for _ in range(200):
        a = [merkle._leaf(draw.choice("abcdefgh")) for _ in range(draw.randrange(9))]
        b = [merkle._leaf(draw.choice("abcdefgh")) for _ in range(draw.randrange(9))]
        pairs = merkle.matched(a, b)
        assert all(a[i][0] == b[j][0] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    short = "abcdefgh ijklm"
    assert merkle.likeness(merkle.tree(short), merkle.tree(merkle.edited(short, "zzzz"))) > 0.5


def test_encoder_equals_library():
    tokenizer, ours = Tokenizer.from_file(TOKENIZER), encoder(TOKENIZER)
    for text in ("", "  ", "It's 5kg, We'LL go.\tX\r\ny", "İstanbul Σας ΑΣ é ́b", "<|endoftext|>a b", "A$$$ b.** c'd 中文 \x1c x", "ÀÖßÿ."):
        assert ours.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_texts_are_encoded_together():
    """op4: a run's equal chunks are found and encoded once, whatever the texts they stand in."""
    tokenizer = Tokenizer.from_file(TOKENIZER)
    given = ["", " ", "Big Öl, öl... BIG", "×a÷ a÷ ÿß-- ẞ Á", "it's 'S x\x00y", "big\n\nöl,\tbig\r", "--- --- 12ab", ""] * 40
    ours, asked = WordEncoder(TOKENIZER), []
    for cache in (ours.words, ours.chunks):
        cache.fill = lambda word, fill=cache.fill: asked.append(word) or fill(word)
    got = [ids[a:b].tolist() for ids, bounds in ours.runs(pa.array(given)) for a, b in zip(bounds, bounds[1:])]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in given]
    assert len(asked) == len(set(asked)) < 25 and {"big", "öl"} <= set(asked)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(tokens, "RUN_BYTES", 20)
        sizes = [len(bounds) - 1 for _, bounds in ours.runs(pa.array(given).slice(3, 30))]
    assert sum(sizes) == 30 and max(sizes) < 8


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for n, top in ((0, 2), (1, 5), (511, 40), (512, 65536), (1300, 3)):
        ids = rng.integers(0, top, n).astype(np.uint16)
        matrix = wavelet.WaveletMatrix.build(ids)
        assert (matrix.decoded() == ids).all()
        for at in range(0, n, 37):
            token = int(ids[at])
            before = int((ids[:at] == token).sum())
            assert matrix.access(at) == token and matrix.rank(token, at) == before and matrix.select(token, before) == at
        assert matrix.select(65535, n) is None and matrix.rank(7, n) == int((ids == 7).sum())
    with pytest.raises(IndexError):
        matrix.access(n)


def test_shard_files_round_trip(spark, docs_of, odd, tmp_path, monkeypatch):
    monkeypatch.setattr(wavelet, "BLOCK", 400)  # blocks end inside shards
    path, docs = str(tmp_path / "shards"), docs_of(odd)
    wavelet.write_shards(docs, path, TOKENIZER, 2, docs_per_shard=4)
    shards, ours = wavelet.read_shards(spark, path), encoder(TOKENIZER)
    ids = {}
    for n, (doc_id, text) in enumerate(odd):
        ids[n] = (doc_id, np.append(ours.ids(text or ""), np.uint16(2)))
    order = sorted(ids.values(), key=lambda r: (r[0] is not None, r[0] or 0, r[1].tobytes()))
    at, want = 0, []
    for doc_id, x in order:
        want.append((doc_id, at, len(x), zlib.crc32(x.astype("<u4").tobytes())))
        at += len(x)
    got = [tuple(r) for r in wavelet.document_digests(shards).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    token = int(order[-1][1][0])
    places = {(d, int(k)) for d, x in order for k in np.flatnonzero(x == token)}
    assert {tuple(r) for r in wavelet.occurrences(shards, token).collect()} == places
    assert {r.token: r.n for r in wavelet.token_counts(shards, [token, 2]).collect()}[2] >= len(odd)
    assert wavelet.encoded_digests(docs_of([]), TOKENIZER, 2).collect() == []


def test_packing_is_best_fit_decreasing():
    for seed in range(300):
        rng = random.Random(seed)
        capacity = rng.choice([7, 20, 50])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 60))]
        room: list[int] = []
        for length in sorted(lengths, reverse=True):
            fits = [(r, k) for k, r in enumerate(room) if r >= length]
            if fits:
                room[min(fits)[1]] -= length
            else:
                room.append(capacity - length)
        counts = Counter(lengths)
        runs, bins = packing.best_fit_decreasing(counts, capacity)
        held = defaultdict(list)
        for length, n in counts.items():
            own = sorted(r for r in runs if r[0] == length)
            for k in range(n):
                _, first, start, each, offset = [r for r in own if r[1] <= k][-1]
                held[start + (k - first) // each].append((offset + (k - first) % each * length, length))
        left = []
        for parts in held.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            left.append(capacity - at)
        assert bins == len(held) == len(room) and sorted(left) == sorted(room)


def test_packed_documents(docs_of, odd):
    got = packing.pack_documents(docs_of(odd), TOKENIZER, 1, 64).collect()
    ours, want = encoder(TOKENIZER), Counter()
    for doc_id, text in odd:
        ids = np.append(ours.ids(text or ""), np.uint16(1)).astype("<u4")
        for k in range(0, len(ids), 64):
            part = ids[k: k + 64]
            want[doc_id, k // 64, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 64
    assert packing.pack_documents(docs_of([]), TOKENIZER, 1, 64).collect() == []


def test_words_go_with_the_task(spark, docs_of):
    """op4, op5: workers live on for other steps, so what an encoder remembered must not stay in them."""
    docs = docs_of([(k, prose(k, 20) + f" word{k} x{k}y") for k in range(40)]).coalesce(1)

    def asked(batches):
        for _ in batches:
            found = tokens.encoder(TOKENIZER)
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([len(found.words) + len(found.chunks)])], ["pid", "n"])

    def used(batches):
        with tokens.task_encoder(TOKENIZER) as ours:
            for batch in batches:
                n = sum(len(ids) for ids, _ in ours.runs(batch.column("text")))
                yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([n])], ["pid", "n"])

    assert docs.select("text").mapInArrow(used, "pid long, n long").first().n > 400
    assert packing.pieces(docs, TOKENIZER, 1, 64).count() >= 40
    assert all(r.n == 0 for r in docs.select("text").mapInArrow(asked, "pid long, n long").collect())
