"""Near-duplicate documents: MinHash bands find candidates, odd sketches weigh them, full shingle sets decide.

1. One scan computes for each document the hash of its shingle set, band keys of its MinHash samples, and the
   odd sketch: the samples folded into a parity bitmap. The number of ones in the XOR of two sketches estimates how
   many samples differ, precisely so for high similarities. A second parity bitmap is folded from the whole set: two
   sets differ in at least as many shingles as the XOR has ones, so this one never rules out a link.
2. Documents with equal sets form a class; only its smallest doc_id goes on, so copies are never expanded.
3. Band buckets give candidate links by sketch similarity, which are confirmed on the full sets (see buckets.py): never
   all pairs of a bucket, but every link that banding finds takes effect.

With 40 bands of 5 samples a pair at the threshold of 0.8 is missed with a probability of 1.3e-7, and the sketch
rule (five deviations) rules out about as few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import link_buckets
from .common import as_bytes, fresh, handing_back, mix, slices, small, stage
from .shingling import forget, shingles

BANDS, ROWS, SKETCH_BITS, SET_BITS = 40, 5, 512, 1024
_WORD_OF = SKETCH_BITS // 64
_P = np.uint64(0x9E3779B97F4A7C15)


def _multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _P) | np.uint64(1)


def minhashes(flat: np.ndarray, sizes: np.ndarray, samples: int) -> np.ndarray:
    """MinHash values, a row for each nonempty set."""
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    out = np.empty((len(starts), samples), np.uint64)
    scratch = np.empty_like(flat)
    for k, m in enumerate(_multipliers(samples)):
        np.multiply(flat, m, out=scratch)
        np.add(scratch, mix(m[None])[0], out=scratch)
        np.bitwise_xor(scratch, scratch >> np.uint64(31), out=scratch)
        out[:, k] = np.minimum.reduceat(scratch, starts)
    return out


def odd_sketches(mins: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity bitmaps of the samples, as rows of 64-bit words."""
    n, samples = mins.shape
    at = (mix(mins + np.arange(samples, dtype=np.uint64) * _P) % np.uint64(bits)).astype(np.int64)
    counts = np.bincount((np.arange(n)[:, None] * bits + at).ravel(), minlength=n * bits).reshape(n, bits)
    return np.packbits((counts & 1).astype(bool), axis=1, bitorder="little").view(np.uint64)


def set_sketches(flat: np.ndarray, sizes: np.ndarray, bits: int = SET_BITS) -> np.ndarray:
    """Parity bitmaps of whole nonempty sets, as rows of 64-bit words."""
    sizes = sizes[sizes > 0]
    at = np.repeat(np.arange(len(sizes)), sizes) * bits + (mix(flat ^ _P) % np.uint64(bits)).astype(np.int64)
    counts = np.bincount(at, minlength=len(sizes) * bits).reshape(len(sizes), bits)
    return np.packbits((counts & 1).astype(bool), axis=1, bitorder="little").view(np.uint64)


def most_odd(percent: int, samples: int, bits: int = SKETCH_BITS) -> int:
    """Ones in the XOR of two sketches that a pair at the threshold exceeds once in some million times."""
    p = percent / 100
    differ = 2 * (samples * (1 - p) + 5 * np.sqrt(samples * p * (1 - p)))
    mean = bits * (1 - np.exp(-2 * differ / bits)) / 2
    return int(np.ceil(mean + 3 * np.sqrt(mean)))


def _signatures(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1 << 20):
            flat, sizes = shingles(as_bytes(batch.column("text")), words)
            full = np.flatnonzero(sizes)
            keys, sets, sketches = np.zeros((len(sizes), bands), np.int64), np.zeros((len(sizes), 2), np.uint64), [b""] * len(sizes)
            if len(full):
                mins = minhashes(flat, sizes, bands * rows)
                folded = np.zeros((len(full), bands), np.uint64)
                for k in range(rows):
                    folded = mix(folded * _P + mins[:, k::rows])
                keys[full] = mix(folded + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)).view(np.int64)
                starts = (np.cumsum(sizes) - sizes)[full]
                sets[full, 0], sets[full, 1] = np.add.reduceat(mix(flat), starts), np.bitwise_xor.reduceat(mix(flat + _P), starts)
                for d, row in zip(full.tolist(), np.hstack([odd_sketches(mins), set_sketches(flat, sizes)])):
                    sketches[d] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), *(pa.array(sets[:, k].view(np.int64)) for k in (0, 1)), pa.array(sketches, pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(0, len(sizes) * bands + 1, bands), pa.int32()), pa.array(keys.ravel()))],
                ["doc_id", "n", "s1", "s2", "sketch", "bands"],
            )
        forget()

    return run


def _rule(most: int, percent: int):
    """Ones in the XOR of two sample sketches; over `most` where these, the sets' sketches or sizes rule a link out."""

    def odd(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, *places) -> np.ndarray:
        ones = np.bitwise_count(a ^ b)
        odd, differ = ones[..., :_WORD_OF].sum(axis=-1, dtype=np.int32), ones[..., _WORD_OF:].sum(axis=-1, dtype=np.int64)
        odd[(100 * np.minimum(n, m) < percent * np.maximum(n, m)) | ((100 + percent) * differ > (100 - percent) * (n + m))] = most + 1
        return odd

    return odd


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Groups of documents linked by the Jaccard similarity of their word shingles, at least `percent` / 100.

    Returns doc_id, n_shingles, component_id (the smallest doc_id reachable over links) and kept
    (doc_id = component_id), a row for each row of `docs`; other columns play no part. A document without words is
    linked with nothing. Rows that repeat a doc_id get its result each and are kept or dropped alike. A null doc_id
    is linked with nothing, in no component and kept. An empty table gives an empty result.
    """
    signs = stage(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(handing_back(_signatures(words, bands, rows)), "doc_id long, n long, s1 long, s2 long, sketch binary, bands array<long>"), "signatures")
    full = signs.filter("n > 0 and doc_id is not null")
    classes = stage(full.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("id")), "classes")
    heads = stage(full.join(classes.select("id"), F.col("doc_id") == F.col("id"), "left_semi").select(F.col("doc_id").alias("id"), "n", "sketch", "bands").dropDuplicates(["id"]), "heads")
    most = most_odd(percent, bands * rows)
    keyed = heads.select("id", F.explode("bands").alias("key"), F.lit(0).alias("at"), F.lit(True).alias("heavy"))
    found = link_buckets(docs, keyed, heads, _rule(most, percent), most, words, percent)
    heads_of = classes.join(found, "id", "left").select("s1", "s2", "n", F.coalesce("component", "id").alias("component"))
    out = signs.select("doc_id", "n", "s1", "s2").join(heads_of, ["s1", "s2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Rows of `docs` but for those whose component has a smaller doc_id: one document of each group stays."""
    (key,) = fresh(docs, "_gone")
    gone = stage(near_duplicates(docs, words, percent).filter("not kept").select(F.col("doc_id").alias(key)).distinct(), "near_copies")
    return docs.join(small(gone), F.col("doc_id").cast("long") == F.col(key), "left_anti")
