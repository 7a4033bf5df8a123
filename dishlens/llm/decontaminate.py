"""Benchmark decontamination by template canonicalisation.

Tokens of a text become a template: numbers, names and units turn into typed placeholders that remember their
value, all other words are lower-cased. Windows of a fifth of an item's template tokens, `SHORTEST` to `WINDOW` of them
(items of fewer than `WINDOW` tokens: the whole item), are hashed; documents and benchmark items meet in a hash join on them. Only document windows that a bitmap of
all benchmark windows lets pass are shuffled: the bitmap has one size whatever the benchmark's, and
what passes by chance is refused by the join, and a window that has too few passing ones around it for any alignment
is not shuffled. Each window is also hashed with its names as lower-cased words, a second key of the same join, so copies
in capitals or small letters, or without full stops, are found although they show other names. Matches of an item whose distances within a document differ from a common one by `BAND` tokens at
most make an alignment, so inserted and deleted words don't part it. It counts where it covers at least `COVERAGE` of the
item's windows (and `FEW_COVERED` of its tokens, if it has fewer than `FEW`) and the slots agree: `MOSTLY` of the
values are equal, or names that come more than once, in the item or in the document, stand for one and the same name at more than
`STEADY` of their places. Numbers and units may take any values, as those of a question asked anew may coincide. An item asked with
other numbers, names or units is thus found, and told from an exact copy. Values other than those equal for `MOSTLY` are
believed only where the alignment holds `LITERALS` literal words and `COVERAGE` of the item's.

Items of fewer than `WINDOW` tokens count only with all values equal. Those of them with fewer than `LITERALS` words (numbers
and units are none), such as '42' or 'Yes.', can't be told from chance: they are not decidable and match nothing;
`undecidable` lists them and a warning gives their number.

Rows: null and empty texts have no windows; null ids of documents are kept as null, repeated documents and items
give as many rows; items without a word match nothing; empty tables give empty results; extra
columns are ignored. Of several alignments of an item within a document the best counts.
"""

from __future__ import annotations

import logging
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dishlens.llm.common import WordCache, texts, written

WINDOW, COVERAGE, BITS = 8, 0.5, 24
#: Narrowest window of items of WINDOW tokens or more, and tokens by which shifts of one alignment may differ from its centre.
SHORTEST, BAND = 3, 3
#: Of items of fewer tokens than FEW the windows must also cover this share of the tokens.
FEW, FEW_COVERED = 14, 0.75
#: Share of equal values that is enough, and share of the places of repeated names that must be more than met, both ways.
MOSTLY, STEADY = 0.75, 0.5
#: Words, not counting numbers and units, that a match needs if its values differ or the item is shorter than WINDOW.
LITERALS = 3

#: Words that are units after a number.
UNITS = frozenset(
    "% mm cm m km in inch inches ft foot feet yard yards mile miles mg g kg t ton tons lb lbs pound pounds oz ounce "
    "ounces ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day "
    "days week weeks month months year years usd eur dollar dollars euro euros cent cents kb mb gb tb hz khz mhz ghz "
    "w kw mw v a k c f degree degrees percent mph kmh".split()
)
_LOG = logging.getLogger(__name__)
_NUMBER = re.compile(r"[+\-$€£]?(\d+(?:[.,:/]\d+)*)(%|[A-Za-z]{0,3})")
_EDGE = re.compile(r"^[^\w$€£+%-]+|[^\w%]+$")
_PLACE = {kind: np.uint64(xxhash.xxh64_intdigest(f"<{kind}>", 1)) for kind in ("number", "name", "unit")}
NUM, CAP, UNIT, END, EMPTY = 1, 2, 4, 8, 16
_PRIME = np.uint64(0x9E3779B185EBCA87)


def _facts(chunk: str) -> tuple[int, int, str]:
    """(hash of the literal, flags, value) of a chunk between blanks."""
    if chunk == "\n":
        return 0, EMPTY | END, ""
    value = _EDGE.sub("", chunk)
    flags = END if chunk[-1:] in ".!?" or chunk[-2:-1] in ".!?" else 0
    if not value:
        return 0, flags | EMPTY, ""
    if _NUMBER.fullmatch(value):
        flags |= NUM
    elif value[0].isupper():
        flags |= CAP
    if value.lower() in UNITS:
        flags |= UNIT
    return xxhash.xxh64_intdigest(value.lower(), 1), flags, value


class Templates:
    """Turns texts into template hashes; facts of chunks are kept in arrays and looked up by number."""

    def __init__(self, limit: int = 500_000):
        self.limit = limit
        self.reset()

    def reset(self) -> None:
        self.number = WordCache(self._add, self.limit + 1)
        self.hashes, self.flags = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.uint8)

    def _add(self, chunk: str) -> int:
        at = len(self.number)
        if at == len(self.hashes):
            self.hashes, self.flags = np.resize(self.hashes, 2 * at), np.resize(self.flags, 2 * at)
        self.hashes[at], self.flags[at], _ = _facts(chunk)
        return at

    def __call__(self, text: str) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[str]]:
        """(hash, kind) of the text's tokens, with names as placeholders and, if there are any, as words; and the chunks.

        Kind 0 is a literal, else NUM, CAP or UNIT.
        """
        parts = text.replace("\n", " \n ").replace("\t", " ").split(" ")
        if len(self.number) + len(parts) > self.limit:
            self.reset()
        self.number.limit = self.limit + len(parts)
        ids = np.fromiter(map(self.number.__getitem__, parts), np.int64, len(parts))
        flags, hashes = self.flags[ids], self.hashes[ids]
        # a token starts a sentence if since the last token something has ended one
        ends = np.concatenate([[1], np.cumsum((flags & END) > 0)])[: len(ids)]
        solid = np.flatnonzero((flags & EMPTY) == 0)
        flags, hashes, ends = flags[solid], hashes[solid], ends[solid]
        # `ends` counts ends before a token; one within the previous token's own chunk is among them
        starts = np.concatenate([[True], ends[1:] > ends[:-1]])[: len(solid)]
        number = (flags & NUM) > 0
        unit = (flags & UNIT > 0) & np.concatenate([[False], number[:-1]])[: len(solid)] & ~number
        name = (flags & CAP > 0) & ~starts & ~unit
        kind = np.where(number, NUM, np.where(unit, UNIT, np.where(name, CAP, 0))).astype(np.uint8)
        plain = np.where(number, _PLACE["number"], np.where(unit, _PLACE["unit"], hashes))
        forms = [(np.where(name, _PLACE["name"], plain), kind)]
        if name.any():
            forms.append((plain, np.where(name, 0, kind).astype(np.uint8)))
        return forms, [parts[i] for i in solid] if kind.any() else []


def width_of(n: int) -> int:
    """Tokens of a window of an item of `n` tokens: two edited words leave half of the windows from 14 tokens on."""
    return n if n < WINDOW else max(SHORTEST, min(WINDOW, (n + 1) // 5))


def window_hashes(hashes: np.ndarray, widths: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(width, mixed hashes of the runs of `width` tokens) for each of the widths, which ascend."""
    out = np.zeros(len(hashes), np.uint64)
    for width in range(1, max(widths, default=0) + 1):
        n = len(hashes) - width + 1
        if n <= 0:
            return
        out = out[:n] * _PRIME + hashes[width - 1:]
        if width in widths:
            mixed = out + np.uint64(width)
            mixed ^= mixed >> np.uint64(29)
            yield width, mixed * np.uint64(0xBF58476D1CE4E5B9)


def _value(chunk: str) -> str:
    return _EDGE.sub("", chunk).lower()


def item_windows(benchmark: DataFrame) -> DataFrame:
    """Every window of every item; `literals` are the places of its literal words.

    (item_id, item_pos, n_windows, n_tokens, n_words, n_literals, width, hash, literals, item_slots)
    """
    columns = {
        "item_id": "long", "item_pos": "int", "n_windows": "int", "n_tokens": "int", "n_words": "int", "n_literals": "int",
        "width": "int", "hash": "long", "literals": "array<int>",
        "item_slots": "array<struct<at: int, kind: int, value: string>>",
    }

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        templates = Templates()
        for pdf in batches:
            rows = []
            for item, text in zip(pdf["item_id"], pdf["text"], strict=True):
                forms, parts = templates(text)
                n, seen = len(forms[0][0]), set()
                n_words, n_literals = int((forms[-1][1] == 0).sum()), int((forms[0][1] == 0).sum())
                for hashes, kind in forms:
                    for width, found in window_hashes(hashes, [width_of(n)] if n else []):
                        for at, h in enumerate(found.view(np.int64).tolist()):
                            if (at, h) in seen:  # a window without names
                                continue
                            seen.add((at, h))
                            slots = [
                                {"at": k, "kind": int(kind[k]), "value": _value(parts[k])}
                                for k in range(at, at + width) if kind[k]
                            ]
                            words = [k for k in range(at, at + width) if not kind[k]]
                            rows.append((item, at, len(found), n, n_words, n_literals, width, h, words, slots))
            yield pd.DataFrame(rows, columns=list(columns))

    given = benchmark.filter(F.col("item_id").isNotNull()).select(
        F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    return given.mapInPandas(run, ", ".join(f"{name} {kind}" for name, kind in columns.items()))


def _decidable() -> Column:
    return (F.col("n_tokens") >= WINDOW) | (F.col("n_words") >= LITERALS)


def undecidable(benchmark: DataFrame) -> DataFrame:
    """(item_id, n_tokens, n_words) of the items too short to tell a copy from chance; no document is matched with them."""
    return item_windows(benchmark).filter(~_decidable()).select("item_id", "n_tokens", "n_words").distinct()


def _bitmap(windows: DataFrame) -> np.ndarray:
    """2^BITS flags of the items' window hashes, gathered as bitmaps of 32,768 flags (2 MB in all)."""
    slot = F.shiftrightunsigned("hash", 64 - BITS) + 1
    rows = windows.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")
    ).collect()
    flags = np.zeros(1 << BITS, np.uint8)
    for row in rows:
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little")
        start = (row["bucket"] - 1) * len(bits)
        flags[start: start + len(bits)] = bits
    return np.packbits(flags, bitorder="little")


def _dense(passed: np.ndarray, reach: int, least: int) -> np.ndarray:
    """Positions that pass and have `least` such positions, themselves among them, within `reach`."""
    at = np.flatnonzero(passed)
    if least > 1 and len(at):
        near = np.searchsorted(at, at + reach, "right") - np.searchsorted(at, at - reach, "left")
        at = at[near >= least]
    return at


def document_windows(docs: DataFrame, flags: np.ndarray, demands: dict[int, tuple[int, int]]) -> DataFrame:
    """(row, doc_id, pos, hash, doc_slots) of the documents' windows that the bitmap lets pass.

    `demands` has for each width (reach, least): an alignment has at least `least` windows, no two further apart than
    `reach`; windows with fewer passing ones around them belong to none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(flags)
    widths = sorted(demands)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        templates, flags = Templates(), np.unpackbits(sent.value, bitorder="little").astype(bool)
        for pdf in batches:
            rows = []
            for row, doc_id, text in pdf.itertuples(index=False, name=None):
                forms, parts = templates(text)
                for found in zip(*[window_hashes(hashes, widths) for hashes, _ in forms], strict=True):
                    width = found[0][0]
                    passed = [flags[(h >> np.uint64(64 - BITS)).astype(np.int64)] for _, h in found]
                    dense = _dense(np.logical_or.reduce(passed), *demands[width])
                    for n, ((_, kind), (_, h), ok) in enumerate(zip(forms, found, passed, strict=True)):
                        at = dense[ok[dense] & (h[dense] != found[0][1][dense])] if n else dense[ok[dense]]
                        if len(at):
                            doc = None if pd.isna(doc_id) else int(doc_id)
                            for k, one in zip(at.tolist(), h[at].view(np.int64).tolist(), strict=True):
                                rows.append((row, doc, k, one, [_value(parts[j]) for j in range(k, k + width) if kind[j]]))
            if rows:
                out = pd.DataFrame(rows, columns=["row", "doc_id", "pos", "hash", "doc_slots"])
                yield out.astype({"doc_id": "Int64"})

    # a number of its own tells repeated ids apart; it need not be the same when a task runs again
    numbered = texts(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return numbered.mapInPandas(run, "row long, doc_id long, pos int, hash long, doc_slots array<string>")


def _steady(pairs: list[tuple[str, str]]) -> float:
    """Of the places whose left value comes more than once the share that have that value's commonest right one."""
    groups: dict[str, Counter] = {}
    for left, right in pairs:
        groups.setdefault(left, Counter())[right] += 1
    repeated = [c for c in groups.values() if c.total() > 1]
    return sum(max(c.values()) for c in repeated) / sum(c.total() for c in repeated) if repeated else 1.0


def _agree(names: list[tuple[str, str]]) -> bool:
    """Whether the (item's, document's) names of an alignment may stand for one another."""
    return _steady(names) > STEADY and _steady([(doc, item) for item, doc in names]) > STEADY


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, matched, n_windows, coverage, same_values): documents that hold an item, or it with other values."""
    every = written(item_windows(benchmark), "items")
    items = every.filter(_decidable())
    short = every.filter(~_decidable()).select("item_id").distinct().count()
    if short:
        _LOG.warning("%d benchmark items are too short to be decided; undecidable() lists them", short)
    # items have few widths: at most WINDOW
    demands = {
        r["width"]: (r["windows"] + 2 * BAND, max(1, r["least"]))
        for r in items.groupBy("width").agg(
            F.max("n_windows").alias("windows"), F.ceil(F.min("n_windows") * coverage - 1e-9).alias("least")
        ).collect()
    }
    found = written(document_windows(docs, _bitmap(items), demands), "windows")
    key = ["row", "doc_id", "item_id", "center"]
    shift = F.col("pos") - F.col("item_pos")
    met = found.join(items, "hash").withColumn("center", F.explode(F.sequence(shift - BAND, shift + BAND)))
    # what is collected is bounded by an item's windows and the band
    covered = F.array_distinct(
        F.flatten(F.transform(F.collect_set("item_pos"), lambda p: F.sequence(p, p + F.max("width") - 1)))
    )
    runs = met.groupBy(*key).agg(
        F.least(F.size(F.collect_set("item_pos")), F.size(F.collect_set("pos"))).alias("matched"),
        F.max("n_windows").alias("n_windows"), F.max("n_tokens").alias("n_tokens"), F.size(covered).alias("covered"),
        F.max("n_literals").alias("n_literals"), F.size(F.array_distinct(F.flatten(F.collect_set("literals")))).alias("literals"),
    ).withColumn("coverage", F.col("matched") / F.col("n_windows")).filter(
        (F.col("coverage") >= coverage) & ((F.col("n_tokens") >= FEW) | (F.col("covered") >= FEW_COVERED * F.col("n_tokens")))
    )
    kept = runs.select(*[F.col(k).alias(f"_{k}") for k in key])
    pair = F.explode(F.arrays_zip("item_slots", "doc_slots")).alias("p")
    slots = met.filter(F.size("item_slots") > 0).join(kept, _equal(key), "left_semi").select(
        *key, F.abs(shift - F.col("center")).alias("off"), pair
    ).select(*key, "off", "p.item_slots.*", F.col("p.doc_slots").alias("doc"))
    # shifts of a band may give a slot several values: an equal one counts first, then the nearest to the centre
    rank = F.struct(F.col("value") == F.col("doc"), -F.col("off"), F.col("doc"))
    told = slots.groupBy(*key, "at", "kind", "value").agg(F.max_by("doc", rank).alias("doc"))
    agree = F.udf(lambda names: _agree([tuple(n) for n in names]), "boolean")
    same, name = F.col("value") == F.col("doc"), F.when(F.col("kind") == CAP, F.struct("value", "doc"))
    agreed = told.groupBy(*key).agg(
        F.collect_list(name).alias("_names"), F.bool_and(same).alias("_same"), F.avg(same.cast("int")).alias("_equal")
    ).select(*[F.col(k).alias(f"_{k}") for k in key], "_names", "_same", "_equal")
    # other values are only believed where words speak for the item
    enough = F.col("literals") >= F.greatest(F.lit(LITERALS), F.col("n_literals") * coverage)
    held = runs.join(agreed, _equal(key), "left").filter(
        F.coalesce("_same", F.lit(True)) | (F.col("n_tokens") >= WINDOW) & (
            (F.col("_equal") >= MOSTLY) | enough & agree(F.coalesce("_names", F.array()))
        )
    )
    best = F.max(F.struct("matched", F.coalesce("_same", F.lit(True)).alias("same"), "n_windows", "coverage")).alias("b")
    return held.groupBy("row", "doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", F.col("b.matched").alias("matched"), F.col("b.n_windows").alias("n_windows"),
        F.col("b.coverage").alias("coverage"), F.col("b.same").alias("same_values"),
    )


def _equal(key: list[str]) -> Column:
    """Null-safe equality of columns with those of the same name behind an underscore."""
    both = F.lit(True)
    for k in key:
        both = both & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return both


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item; rows without an id stay, as no decision names them."""
    bad = contaminated(docs, benchmark).filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, F.col("doc_id") == F.col("_bad"), "left_anti")
