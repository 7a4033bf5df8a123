"""Token ids of whole texts by a public tokenizer file, each distinct word encoded once per task."""

from __future__ import annotations

import string
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from dishlens.llm.common import WordCache

#: Letters that lower-case one to one and that no normal form changes.
LETTERS = string.ascii_letters + "".join(chr(c) for c in range(0xC0, 0x100) if chr(c) not in "×÷")
MARKS = string.punctuation
_PLAIN = r"^[A-Za-zÀ-ÖØ-öø-ÿ]+[!-/:-@\[-`{-~]*$"
#: Bytes of texts whose chunks are held at once.
RUN_BYTES = 4 << 20


def gathered(values: np.ndarray, size: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The values of the runs named by `places`, one after another; run k is the next size[k] of the values."""
    first, count = (size.cumsum() - size)[places], size[places]
    ends = count.cumsum()
    return values[np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]


def text_runs(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in runs of about RUN_BYTES; a longer text is a run of its own."""
    ends = pc.binary_length(texts).to_numpy(zero_copy_only=False).cumsum(dtype=np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + RUN_BYTES, "right")))
        yield texts.slice(at, to - at)
        at = to


def distinct_chunks(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct chunks between blanks of all texts, the number of each chunk in turn, and where each text's chunks start."""
    for blank in "\n\t\r":
        texts = pc.replace_substring(texts, blank, " ")
    parts = pc.split_pattern(texts, " ")
    found = parts.flatten().dictionary_encode()
    return found.dictionary, found.indices.to_numpy(), parts.offsets.to_numpy()


def plain_chunks(chunks: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Lower-cased letters and marks of chunks that are plain letters with marks behind, and the places of the other chunks."""
    plain = pc.match_substring_regex(chunks, _PLAIN)
    held = pc.if_else(plain, chunks, pa.scalar("", chunks.type))
    other = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
    return pc.utf8_lower(pc.utf8_rtrim(held, MARKS)), pc.utf8_ltrim(held, LETTERS), other


class WordEncoder:
    """ids(text) equals the tokenizer's encode(text, add_special_tokens=False).

    The tokenizer drops white space and never joins what it parts, so a text's ids are those of its
    chunks between blanks in turn. A chunk of plain letters with marks behind it is the ids of the
    lower-cased letters, which go straight to the tokenizer's model as the characters that stand for
    their bytes, and of the run of marks. Everything else goes to the tokenizer as it stands.
    Texts are parted and their distinct chunks found by Arrow, a run of texts at a time.
    The caches are cleared when they hold `limit` entries, so a worker's memory is bounded.
    """

    def __init__(self, file: str, limit: int = 200_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(file)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        stand = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.bytes = str.maketrans({c: stand(c)[0][0] for c in LETTERS if not c.isascii()})
        self.pairs = [n.to_bytes(2, "little") for n in range(1 << 16)]
        self.chunks = WordCache(self._chunk, limit)
        self.words = WordCache(self._word, 2 * limit)

    def _word(self, word: str) -> bytes:
        found = self.tokenizer.model.tokenize(word if word.isascii() else word.translate(self.bytes))
        return b"".join([self.pairs[t.id] for t in found])

    def _chunk(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u2").tobytes()

    def _known(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks one after another, and how many each has."""
        *found, other = plain_chunks(chunks)
        letters, marks = (x.dictionary_encode() for x in found)
        parts = [self.words[w] if w else b"" for found in (letters, marks) for w in found.dictionary.to_numpy(zero_copy_only=False)]
        places = np.stack([letters.indices.to_numpy(), marks.indices.to_numpy() + len(letters.dictionary)], 1)
        places[other, 0] = len(parts) + np.arange(len(other))
        parts += [self.chunks[chunks[int(k)].as_py()] for k in other]
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 2
        ids = gathered(np.frombuffer(b"".join(parts), "<u2"), size, places.ravel())
        return ids, size[places].sum(1)

    def _run(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        chunks, chunk, offsets = distinct_chunks(texts)
        known, size = self._known(chunks)
        return gathered(known, size, chunk), np.append(0, size[chunk].cumsum())[offsets]

    def runs(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each run of texts in turn the ids of all, and where each text starts and the last one ends."""
        return map(self._run, text_runs(texts))

    def ids(self, text: str) -> np.ndarray:
        return self._run(pa.array([text], "string"))[0]

    def forget(self) -> None:
        self.chunks.clear()
        self.words.clear()


_encoders: dict[str, WordEncoder] = {}


def encoder(file: str) -> WordEncoder:
    """The worker's encoder for a file; it outlives the task."""
    if file not in _encoders:
        _encoders[file] = WordEncoder(file)
    return _encoders[file]


@contextmanager
def task_encoder(file: str) -> Iterator[WordEncoder]:
    """The worker's encoder for one task; what it remembers goes with the task, as the worker lives on for other steps."""
    found = encoder(file)
    try:
        yield found
    finally:
        found.forget()
