"""Plain definitions that tests compare with."""

import re

import xxhash


def fingerprint_of(text: str) -> int:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[k: k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def component_of(nodes: list[int], reach: int = 3) -> dict[int, int]:
    root = {n: n for n in nodes}
    bits = [(n, n & (2**64 - 1)) for n in nodes]

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for k, (n, a) in enumerate(bits):
        for m, b in bits[:k]:
            if (a ^ b).bit_count() <= reach:
                p, q = find(n), find(m)
                root[max(p, q)] = min(p, q)
    return {n: find(n) for n in nodes}
