"""Hashed word shingles of texts, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from .common import as_bytes, mix, slices

_WORDS_KEPT = 100_000
_P = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """8-byte hashes of words, bounded."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > _WORDS_KEPT:
            self.clear()
        self[word] = got = xxhash.xxh3_64_digest(word)
        return got


_words = _Words()


def forget() -> None:
    """Free the words' hashes: workers live on between stages."""
    _words.clear()


def shingles(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, ascending, one text after another, and how many each has.

    Words are runs of what isn't ASCII white space, A-Z in lower case. A text with fewer words than a shingle
    has its whole sequence as one; without words it has none.
    """
    get = _words.__getitem__
    split = [t.lower().split() for t in texts]
    sizes = np.array([len(x) for x in split], np.int64)
    flat = np.frombuffer(b"".join(b"".join(map(get, x)) for x in split), np.uint64)
    sums = np.zeros(max(0, len(flat) - words + 1), np.uint64)
    for k in range(words):
        sums = sums * _P + mix(flat[k : k + len(sums)] + np.uint64(k)) if k else mix(flat[: len(sums)])
    sums = mix(sums)
    out, at = [], 0
    for n in sizes.tolist():
        if n >= words:
            own = np.sort(sums[at : at + n - words + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        elif n:
            whole = np.full(1, n, np.uint64)
            for k in range(at, at + n):
                whole = mix(whole ^ flat[k : k + 1]) * _P
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.array([len(x) for x in out], np.int64)


def shingle_sets(words: int):
    """Batches of (id, text) into (id, grams): each text's distinct shingles, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            flat, sizes = shingles(as_bytes(batch.column("text")), words)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(flat.view(np.int64)))], ["id", "grams"])
        forget()

    return run
