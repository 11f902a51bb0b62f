"""Brute-force versions that several tests use."""

import re

import numpy as np
import xxhash


def brute_fingerprint(text, shingle=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    parts = [" ".join(w[i:i + shingle]) for i in range(max(1, len(w) - shingle + 1))] if w else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(values, bits):
    """Smallest index of each value's class."""
    values = np.array(values, dtype=np.uint64)
    near = [np.flatnonzero(np.bitwise_count(v ^ values) <= bits) for v in values]
    label = np.arange(len(values))
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return label
        label = new
