"""Secrets: plain patterns, and credentials of several parts linked by an interval join within scopes.

Base spans are certain by their form: assignments, access keys, long hexadecimal runs. Weak candidates
are not: an access identifier (`user=`, `client id:`), a mixed run of letters and digits, an endpoint (url or
host:port). They are reported only where complementary parts, a secret (weak or base) and an access
identifier (weak or base), or a secret and an endpoint, lie in one scope: the same paragraph, at most `REACH`
code points apart. The join is a sweep over the text's intervals in order of their start, so a text with very many
candidates costs its sort, not its pairs.

Offsets are code points, ends exclusive. Null and empty texts have no spans and the checksum of the empty
string; equal rows give equal results; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dishlens.llm.common import texts

REACH = 400
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "linked_id", "linked_secret", "linked_endpoint")

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_WEAK_ID = re.compile(
    r"""(?:client|user|account|login|key)[_\x20-]?(?:id|name)?["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""",
    re.IGNORECASE | re.ASCII,
)
_WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?![A-Za-z0-9+/_-])", re.ASCII)
_ENDPOINT = re.compile(
    r"(?:https?|ftp|jdbc:\w+|postgres|mysql|redis|mongodb|amqp)://[^\s\"'<>]+|(?<![\w.])[a-z0-9-]+(?:\.[a-z0-9-]+)+:\d{2,5}\b",
    re.ASCII,
)
#: What `_ENDPOINT` or `_WEAK_ID` needs to match at all; plain substring tests are much cheaper than the patterns.
_ENDPOINT_HINT, _ID_HINT, _DIGIT = ("://", ":"), ("=", ":"), re.compile("[0-9]")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Certain spans by start, then in the order of the kinds."""
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=_place)


def _place(span: Span) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


def _mixed(value: str) -> bool:
    """Letters of both cases and digits, as generated keys have."""
    return any(c.isdigit() for c in value) and any(c.islower() for c in value) and any(c.isupper() for c in value)


def linked_spans(text: str, base: list[Span], reach: int = REACH) -> list[Span]:
    """Weak candidates with a complementary part in their scope."""
    secrets, ids, ends = [], [], []
    if _DIGIT.search(text):
        secrets = [(m.start(), m.end(), "linked_secret") for m in _WEAK_SECRET.finditer(text) if _mixed(m[0])]
        if _ENDPOINT_HINT[1] in text:
            ends = [(m.start(), m.end(), "linked_endpoint") for m in _ENDPOINT.finditer(text)]
    if any(mark in text for mark in _ID_HINT):
        ids = [(m.start(1), m.end(1), "linked_id") for m in _WEAK_ID.finditer(text)]
    taken = [(s, e) for s, e, _ in base]
    # a weak candidate inside a certain span or an endpoint says nothing of its own
    secrets = _outside(secrets, taken + [(s, e) for s, e, _ in ends])
    ids = _outside(ids, taken)
    any_secret = secrets + [x for x in base if x[2] != "access"]
    any_id = ids + [x for x in base if x[2] == "access"]
    if not any_secret or not (any_id or ends):
        return []
    breaks = [m.start() for m in re.finditer(r"\n\s*\n", text)]
    kept = _met(ids, any_secret, breaks, reach) | _met(ends, any_secret, breaks, reach)
    kept |= _met(secrets, any_id + ends, breaks, reach)
    return sorted(kept, key=_place)


def _outside(spans: list[Span], others: list[tuple[int, int]]) -> list[Span]:
    """Spans that overlap none of the others; both are disjoint or nested, so running ends suffice."""
    if not spans or not others:
        return spans
    others = sorted(others)
    starts, far, ends = [s for s, _ in others], 0, []
    for _, e in others:
        far = max(far, e)
        ends.append(far)
    return [x for x in spans if not (k := bisect.bisect_left(starts, x[1])) or ends[k - 1] <= x[0]]


def _met(spans: list[Span], others: list[Span], breaks: list[int], reach: int) -> set[Span]:
    """Interval join: spans with one of the others in the same paragraph, at most `reach` code points away."""
    if not spans or not others:
        return set()
    others = sorted(others)
    starts, far, before = [s for s, _, _ in others], -1, []
    for _, e, _ in others:
        far = max(far, e)
        before.append(far)
    kept = set()
    for span in spans:
        at = bisect.bisect_left(breaks, span[0])
        low = breaks[at - 1] if at else -1
        high = breaks[at] if at < len(breaks) else float("inf")
        first = bisect.bisect_left(starts, span[0])
        after = first < len(starts) and starts[first] <= span[1] + reach and starts[first] < high
        ahead = first > 0 and before[first - 1] >= span[0] - reach and before[first - 1] > low
        if after or ahead:
            kept.add(span)
    return kept


def joined(spans: list[Span]) -> str:
    return ",".join([f"{kind}:{start}:{end}" for start, end, kind in spans])


def find_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every whole text. No shuffle."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                base = base_spans(text)
                spans = sorted(base + linked_spans(text, base, reach), key=_place)
                kinds = [k for _, _, k in base]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append((*[kinds.count(k) for k in BASE], digest, joined(spans)))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])
            yield out.assign(doc_id=pdf["doc_id"].to_numpy())[["doc_id", *out.columns]]

    return texts(docs).mapInPandas(
        scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )


def redacted(text: str | None, mark: str = "[secret]", reach: int = REACH) -> str | None:
    """The text with every reported secret, key or identifier replaced; endpoints stay."""
    if not text:
        return text
    base = base_spans(text)
    spans = [x for x in base + linked_spans(text, base, reach) if x[2] != "linked_endpoint"]
    if not spans:
        return text
    out, at = [], 0
    for start, end, _ in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """The documents with secrets replaced and n_chars set anew; a null text stays null, other columns stay."""

    @F.pandas_udf("string")
    def clean(text: pd.Series) -> pd.Series:
        return text.map(lambda t: redacted(t, reach=reach), na_action="ignore")

    out = docs.withColumn("text", clean("text"))
    if "n_chars" in docs.columns:
        changed = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text"))
        out = out.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return out
