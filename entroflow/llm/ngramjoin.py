"""N-gram Jaccard join: documents whose sets of word n-grams are similar, by rare-first prefix filtering.

1. One scan counts all documents' n-grams in a fixed number of hashed counters and tells each document's set by its size and
   a 128-bit hash. Documents with equal sets form a class; only its smallest doc_id goes on.
2. All n-grams are ordered by their counter, the rarest first, then by their hash. Two sets that are similar enough share one
   of the first n - ceil(t n) + 1 of each: a second scan keeps these prefixes, and for each document the
   number of its n-grams in each of 64 parts of the hash range. The counters decide the order alone, so how many n-grams
   share one decides no result; an n-gram far more frequent than the noise of its counter comes late in every set.
3. Documents join on prefix n-grams that several have. Of a pair that meets there the length filter (sizes), the positional
   filter (what may still follow the n-gram in either) and the suffix filter (two sets differ in at least as many n-grams as
   their parts' numbers do) exclude what can't be a link; the rest is verified on full sets, each pair once (see buckets.py).

Every filter is exact: no link is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .buckets import link_buckets
from .common import as_bytes, handing_back, mix, slices, small, stage
from .shingling import forget, shingles

WORDS, PERCENT = 4, 85
#: Counters of n-grams (4 bytes each), and the stripes in which tasks add them up.
COUNTERS, STRIPES = 1 << 20, 64
#: Tasks' counters of one stripe that are added up by one task at first.
ADDED = 64
#: Parts of the hash range of the suffix filter.
PARTS = 64
#: An n-gram whose counter is above 4 times the mean, within these bounds, is counted before its documents meet.
HEAVY = (1000, 1_000_000)
_MOST = 4096
_CAP = np.int64(2**32 - 1)


def _counter(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def _sized(words: int):
    """A row for each document, and at the end of a partition a row for each stripe of counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, task = np.zeros(COUNTERS, np.int64), TaskContext.get().partitionId()
        names = ["doc_id", "n", "s1", "s2", "task", "stripe", "counts"]
        none = lambda n, kind: pa.nulls(n, kind)
        for batch in slices(batches):
            flat, sizes = shingles(as_bytes(batch.column("text")), words)
            counts += np.bincount(_counter(flat), minlength=COUNTERS)
            full, sets = np.flatnonzero(sizes), np.zeros((len(sizes), 2), np.uint64)
            if len(full):
                starts = (np.cumsum(sizes) - sizes)[full]
                sets[full, 0], sets[full, 1] = np.add.reduceat(mix(flat), starts), np.bitwise_xor.reduceat(mix(flat + np.uint64(0x9E3779B97F4A7C15)), starts)
            n = len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), *(pa.array(sets[:, k].view(np.int64)) for k in (0, 1)), none(n, pa.int32()), none(n, pa.int32()), none(n, pa.binary())], names)
        forget()
        if counts.any():
            packed = np.minimum(counts, _CAP).astype("<u4").reshape(STRIPES, -1)
            ids = [none(STRIPES, pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([*ids, pa.array([task] * STRIPES, pa.int32()), pa.array(range(STRIPES), pa.int32()), pa.array([row.tobytes() for row in packed], pa.binary())], names)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the counters of each stripe in this partition; stripes come sorted."""
    now, total = None, np.zeros(COUNTERS // STRIPES, np.int64)
    pack = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.minimum(total, _CAP).astype("<u4").tobytes()], pa.binary())], ["stripe", "counts"])
    for batch in batches:
        for stripe, counts in zip(batch.column("stripe").to_pylist(), batch.column("counts")):
            if stripe != now:
                if now is not None:
                    yield pack()
                now, total = stripe, np.zeros(COUNTERS // STRIPES, np.int64)
            total += np.frombuffer(counts.as_buffer(), "<u4")
    if now is not None:
        yield pack()


def _frequencies(rows: DataFrame) -> np.ndarray:
    """The counters of all documents: added up by stripe in two steps; COUNTERS numbers reach the driver."""
    part = rows.select("stripe", "counts", F.floor(F.col("task") / ADDED).alias("some")).repartition(F.col("stripe"), F.col("some")).sortWithinPartitions("stripe")
    whole = part.select("stripe", "counts").mapInArrow(_added, "stripe int, counts binary").repartition(F.col("stripe")).sortWithinPartitions("stripe")
    out = np.zeros((STRIPES, COUNTERS // STRIPES), np.uint32)
    for r in whole.mapInArrow(_added, "stripe int, counts binary").collect():
        out[r["stripe"]] = np.frombuffer(r["counts"], "<u4")
    return out.ravel()


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of n elements, in the common order, a set must share one of to be similar to another: n - ceil(t n) + 1."""
    return np.where(n > 0, n - -(-percent * n // 100) + 1, 0)


def _prefixes(words: int, percent: int, counters, heavy: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counters.value
        for batch in slices(batches):
            flat, sizes = shingles(as_bytes(batch.column("text")), words)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            # Rarest first: 24 bits of the counter, 40 of the hash; sets come sorted by hash, so a stable sort breaks ties by it.
            place = (np.minimum(table[_counter(flat)], (1 << 24) - 1).astype(np.uint64) << np.uint64(40)) | (mix(flat) >> np.uint64(24))
            order = np.lexsort((place, doc))
            take = prefix_length(sizes, percent)
            at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            chosen = order[at < np.repeat(take, sizes)]
            kept, light = flat[chosen], np.bincount(doc[chosen], weights=table[_counter(flat[chosen])] <= heavy, minlength=len(sizes)).astype(np.int32)
            cell = doc * PARTS + (mix(flat ^ np.uint64(0xD1342543DE82EF95)) % np.uint64(PARTS)).astype(np.int64)
            parts = np.minimum(np.bincount(cell, minlength=len(sizes) * PARTS), 2**16 - 1).astype("<u2").reshape(len(sizes), PARTS)
            prefix = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(take)), pa.int32()), pa.array(kept.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes), pa.array([row.tobytes() for row in parts], pa.binary()), prefix, pa.array(light)], ["id", "n", "sketch", "prefix", "light"])
        forget()

    return run


def _rule(percent: int):
    """Length, positional and suffix filter: the share in which two sets differ at least, over _MOST where they can't be linked."""

    def far(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        n, m = np.asarray(n, np.int64), np.asarray(m, np.int64)
        need = -(-percent * (n + m) // (100 + percent))  # common elements of a link
        differ = np.abs(a.view("<u2").astype(np.int32) - b.view("<u2").astype(np.int32)).sum(axis=-1, dtype=np.int64)
        out = (differ * (_MOST - 1) // (n + m)).astype(np.int32)
        out[(100 * np.minimum(n, m) < percent * np.maximum(n, m)) | (np.minimum(n - i, m - j) < need) | ((n + m - differ) // 2 < need)] = _MOST + 1
        return out

    return far


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Groups of documents linked by the Jaccard similarity of their word n-grams, at least `percent` / 100 (from 1 on).

    Returns doc_id, n_shingles (the set's size) and component_id (the smallest doc_id reachable over links, itself
    included), a row for each row of `docs`; other columns play no part. Words are runs of what isn't ASCII white space, A-Z in lower
    case; a text of fewer than `words` words has its whole sequence as one n-gram. A null or empty text, or one of white
    space, has none and is linked with nothing. Ids tell documents apart: rows that repeat an id are linked as one of them is. A null
    doc_id is linked with nothing and in no component. An empty table gives an empty result.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be above 0 and at most 100")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stage(texts.mapInArrow(handing_back(_sized(words)), "doc_id long, n long, s1 long, s2 long, task int, stripe int, counts binary"), "ngram_sets")
    sized = rows.filter("stripe is null")
    classes = stage(sized.filter("n > 0 and doc_id is not null").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("id")), "ngram_classes")
    counts = _frequencies(rows.filter("stripe is not null"))
    heavy = int(np.clip(4 * counts.mean(), *HEAVY))
    counters = docs.sparkSession.sparkContext.broadcast(counts)  # 4 MB
    prefixes = texts.filter("doc_id is not null").withColumnRenamed("doc_id", "id").mapInArrow(handing_back(_prefixes(words, percent, counters, heavy)), "id long, n long, sketch binary, prefix array<long>, light int")
    heads = prefixes.filter("n > 0").join(small(classes.select("id")), "id", "left_semi")
    twice = sized.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1")
    heads = stage(heads if twice.isEmpty() else heads.dropDuplicates(["id"]), "ngram_heads")
    keyed = heads.select("id", "light", F.posexplode("prefix").alias("at", "key")).withColumn("heavy", F.col("at") >= F.col("light"))  # the rarest come first
    found = link_buckets(texts, keyed, heads, _rule(percent), _MOST, words, percent)
    heads_of = classes.join(found, "id", "left").select("s1", "s2", "n", F.coalesce("component", "id").alias("component"))
    out = sized.join(heads_of, ["s1", "s2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
