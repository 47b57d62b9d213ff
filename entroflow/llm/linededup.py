"""Line dedup with a sharded minimal perfect hash.

One pass counts, for every distinct line key, its documents. Keys found in enough documents (all others would only
fill the arrays that every document probes) go into
shards by hash; for each shard one task builds a minimal perfect hash (levels of packed bitmaps, ranked by word) that
indexes three plain arrays: fingerprints, document counts and the largest doc_id. The shards are written
to the shared folder, which Python workers open by its URI (local and mounted folders, hdfs, s3, gs, abfs). Documents
probe those arrays; lines are never joined.

An index that a worker can hold is probed where the documents are read. A larger one is probed where its shards
are: the distinct keys of each block of documents are dealt to the shards, every task reads a shard once, and what is
found comes back as one small folder a block, which the documents' own pass opens. Both ways give the same rows.

A probe compares 64 fingerprint bits besides the slot, which is itself drawn from the other 64 bits of a
128-bit hash, so a foreign line is taken for a listed one with probability 2**-64.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, as_bytes, fresh, map_batches, mix, slices, stage, stage_path, without

MIN_CHARS, MIN_DOCS = 40, 5
#: Keys in a shard, at most about, and bytes of a key once built: 3 bits of maps with ranks, 8 + 2 + 8 in the arrays.
SHARD_KEYS, KEY_BYTES = 1_000_000, 19
#: Bytes of shards that a Python worker holds; the keys of documents are dealt to the shards of a larger index.
HELD_BYTES = 128 << 20
#: Counts are kept in 16 bits.
MOST_COUNT = 65_535
#: Bits of a row's number within its block of documents, and the tasks that may share one shard's probes.
BLOCK_BITS, SALTS = 16, 8


def _hash(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _long_key(line: bytes, least: int) -> bytes | None:
    """The key of a line, or None if it has under `least` code points. bytes.strip() and lower() treat ASCII only."""
    key = line.strip()
    if len(key) < least or (len(key) < 4 * least and not key.isascii() and len(key.decode("utf-8", "replace")) < least):
        return None
    return key.lower()


def slots_build(h1: np.ndarray, h2: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """A minimal perfect hash of distinct (h1, h2): bits of each level, packed bitmaps, and the slot of each key."""
    base = h1 ^ mix(h2)
    live, sizes, maps, slot, placed = np.arange(len(base)), [], [], np.zeros(len(base), np.int64), 0
    while len(live):
        if len(sizes) == 200:
            raise ValueError("two keys share all hash bits")
        n = max(64, -(-int(len(live) * 1.6) // 64) * 64)
        at = (mix(base[live] + np.uint64(len(sizes) * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(n)).astype(np.int64)
        single = np.bincount(at, minlength=n) == 1
        mine = single[at]
        rank = np.cumsum(single) - 1 + placed
        slot[live[mine]] = rank[at[mine]]
        placed += int(single.sum())
        sizes.append(n)
        maps.append(np.packbits(single, bitorder="little"))
        live = live[~mine]
    return sizes, np.concatenate(maps) if maps else np.zeros(0, np.uint8), slot


class Shard:
    """The arrays of one shard, ready to be probed; bitmaps stay packed, with the rank of each 64-bit word."""

    def __init__(self, row: dict):
        self.sizes = row["sizes"]
        self.words = np.frombuffer(row["bits"], np.uint64)
        self.ranks = (np.cumsum(np.bitwise_count(self.words), dtype=np.int64) - np.bitwise_count(self.words)).astype(np.int32)
        self.prints, self.last = np.frombuffer(row["prints"], np.uint64), np.frombuffer(row["last"], np.int64)
        self.count = np.frombuffer(row["counts"], np.uint16)
        self.nbytes = sum(x.nbytes for x in (self.words, self.ranks, self.prints, self.last, self.count))

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 if the fingerprint says it isn't listed."""
        base, out, live, first = h1 ^ mix(h2), np.full(len(h1), -1, np.int64), np.arange(len(h1)), 0
        for k, n in enumerate(self.sizes):
            at = mix(base[live] + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(n)
            word, bit = (at >> np.uint64(6)).astype(np.int64) + first, np.uint64(1) << (at & np.uint64(63))
            own = self.words[word]
            hit = (own & bit) != 0
            out[live[hit]] = self.ranks[word[hit]] + np.bitwise_count(own[hit] & (bit[hit] - np.uint64(1)))
            live, first = live[~hit], first + n // 64
            if not len(live):
                break
        got = out >= 0
        out[got] = np.where(self.prints[out[got]] == h2[got], out[got], -1)
        return out


def _line_keys(batch: pa.RecordBatch, least: int) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
    """Every document's lines; document and line number of each long one, and the two halves of its key's hash."""
    lines, where, hashes = [x.split(b"\n") for x in as_bytes(batch.column("text"))], [], []
    for d, own in enumerate(lines):
        for k, line in enumerate(own):
            if (key := _long_key(line, least)) is not None:
                where.append((d, k))
                hashes.append(_hash(key))
    h = np.frombuffer(b"".join(hashes), np.uint64).reshape(-1, 2)
    return lines, np.array(where, np.int64).reshape(-1, 2), h[:, 0].copy(), h[:, 1].copy()


def _count_lines(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            seen: dict[bytes, list[int]] = {}
            ids = batch.column("doc_id").fill_null(NULL_ID).to_pylist()
            for doc, text in zip(ids, as_bytes(batch.column("text"))):
                for key in {k for x in text.split(b"\n") if (k := _long_key(x, least)) is not None}:
                    got = seen.setdefault(_hash(key), [0, NULL_ID])
                    got[0] += 1
                    got[1] = max(got[1], doc)
            if seen:
                h = np.frombuffer(b"".join(seen), np.int64).reshape(-1, 2)
                n = np.array(list(seen.values()), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(n[:, 0]), pa.array(n[:, 1])], ["h1", "h2", "n", "last"])

    return run


def _build(table: pa.Table) -> pa.Table:
    h1, h2 = (table.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
    sizes, bits, slot = slots_build(h1, h2)
    arrays = {}
    for name, values in (("prints", h2), ("counts", np.minimum(table.column("n").to_numpy(), MOST_COUNT).astype(np.uint16)), ("last", table.column("last").to_numpy())):
        arrays[name] = np.zeros(len(h1), values.dtype)
        arrays[name][slot] = values
    row = {"shard": [table.column("shard")[0].as_py()], "sizes": [sizes], "bits": [bits.tobytes()]} | {k: [v.tobytes()] for k, v in arrays.items()}
    return pa.table(row, schema=pa.schema([("shard", pa.int64()), ("sizes", pa.list_(pa.int64())), *((k, pa.binary()) for k in ("bits", "prints", "counts", "last"))]))


def build_index(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS) -> tuple[str, int, int]:
    """Count every line key and write the sharded index; returns its folder, its number of shards (0: no key is listed) and of keys."""
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_count_lines(min_chars), "h1 long, h2 long, n long, last long")
    listed = rows.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("last").alias("last")).filter(F.col("n") >= min_docs)
    listed = stage(listed, "listed_lines")
    keys = listed.count()
    shards = -(-keys // shard_keys)
    path = stage_path(docs.sparkSession, "line_shards")
    if shards:
        built = listed.withColumn("shard", F.pmod("h1", F.lit(shards))).groupBy("shard").applyInArrow(_build, "shard long, sizes array<long>, bits binary, prints binary, counts binary, last binary")
        built.withColumn("part", F.col("shard")).write.partitionBy("part").parquet(path)
    return path, shards, keys


def _read_part(path: str, part: int) -> pa.Table | None:
    """The rows of one folder of a table in the shared folder that is parted by `part`; None if there are none."""
    fs, root = pa.fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
    tables = []
    for x in fs.get_file_info(pa.fs.FileSelector(f"{root}/part={part}", allow_not_found=True)):
        if x.path.endswith(".parquet"):
            with fs.open_input_file(x.path) as f:
                tables.append(pq.ParquetFile(f).read())
    return pa.concat_tables(tables) if tables else None


class Index:
    """Shards read from the shared folder as they are needed: all are held, or the latest alone."""

    def __init__(self, path: str, shards: int, least: int, hold: bool = True):
        self.path, self.shards, self.least, self.hold, self.held = path, shards, min(least, MOST_COUNT), hold, {}

    def shard(self, k: int) -> Shard | None:
        if k not in self.held:
            if not self.hold:
                self.held.clear()
            table = _read_part(self.path, k)
            self.held[k] = table and Shard(table.to_pylist()[0])
        return self.held[k]

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether enough documents hold each key, and the largest doc_id that holds it. Shards are visited one after another."""
        found, last = np.zeros(len(h1), bool), np.zeros(len(h1), np.int64)
        if not self.shards:
            return found, last
        where = np.mod(h1.view(np.int64), self.shards)
        for k in np.unique(where).tolist():
            if shard := self.shard(k):
                at = np.flatnonzero(where == k)
                slot = shard.probe(h1[at], h2[at])
                at, slot = at[slot >= 0], slot[slot >= 0]
                found[at], last[at] = shard.count[slot] >= self.least, shard.last[slot]
        return found, last


class Told:
    """What the shards told of one block's keys, sorted by hash."""

    def __init__(self, path: str, part: int):
        table = _read_part(path, part)
        h1, h2, last = (table.column(c).to_numpy() for c in ("h1", "h2", "last")) if table else (np.zeros(0, np.int64),) * 3
        order = np.argsort(h1.view(np.uint64))
        self.h1, self.h2, self.last = h1.view(np.uint64)[order], h2.view(np.uint64)[order], last[order]

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, last = np.zeros(len(h1), bool), np.zeros(len(h1), np.int64)
        at, end = np.searchsorted(self.h1, h1, "left"), np.searchsorted(self.h1, h1, "right")
        while (live := np.flatnonzero(at < end)).size:  # once, unless keys share 64 bits
            hit = self.h2[at[live]] == h2[live]
            found[live[hit]], last[live[hit]] = True, self.last[at[live[hit]]]
            at[live] += 1
        return found, last


def _block_keys(least: int):
    """The distinct long keys of each block of documents, a slice at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=16 << 20):
            _, at, h1, h2 = _line_keys(batch, least)
            rows = np.stack([batch.column("part").to_numpy()[at[:, 0]], h1.view(np.int64), h2.view(np.int64)], 1)
            rows = np.unique(rows, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, k].copy()) for k in range(3)], ["part", "h1", "h2"])

    return run


def _ask_shards(index: Callable[[], Index]):
    """Rows sorted by shard against the shards' arrays: those that are listed, with the largest doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = index()
        for batch in batches:
            part, h1, h2 = (batch.column(c).to_numpy() for c in ("part", "h1", "h2"))
            found, last = shards.probe(h1.view(np.uint64), h2.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(x[found]) for x in (part, h1, h2, last)], ["part", "h1", "h2", "last"])

    return run


def _deal(docs: DataFrame, part: str, path: str, shards: int, least: int, min_docs: int) -> str:
    """Deal the keys of blocks to the shards, and write what those tell, parted by block; returns the folder."""
    keys = docs.select(F.col(part).alias("part"), "text").mapInArrow(_block_keys(least), "part long, h1 long, h2 long")
    dealt = keys.withColumn("shard", F.pmod("h1", F.lit(shards))).repartition("shard", F.pmod("part", F.lit(SALTS))).sortWithinPartitions("shard")
    told = dealt.mapInArrow(_ask_shards(lambda: Index(path, shards, min_docs, hold=False)), "part long, h1 long, h2 long, last long")
    out = stage_path(docs.sparkSession, "told_lines")
    told.repartition("part").write.partitionBy("part").parquet(out)
    return out


def _drop_lines(least: int, blocks: Callable[[pa.RecordBatch], Iterator[tuple[pa.RecordBatch, Index | Told]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in slices(batches, most=16 << 20):
            for batch, index in blocks(whole):
                ids = batch.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)
                lines, at, h1, h2 = _line_keys(batch, least)
                found, last = index.probe(h1, h2)
                drop: dict[int, set[int]] = {}
                for d, k in at[found & (last != ids[at[:, 0]])].tolist():
                    drop.setdefault(d, set()).add(k)
                kept = [b"\n".join(x for k, x in enumerate(own) if k not in drop[d]) if d in drop else b"\n".join(own) for d, own in enumerate(lines)]
                columns = {n: batch.column(n) for n in batch.schema.names}
                columns["text"] = pa.array(kept, pa.binary()).cast(pa.string())
                columns["n_lines"] = pa.array([len(x) for x in lines], pa.int64())
                columns["n_dropped"] = pa.array([len(drop.get(d, ())) for d in range(len(lines))], pa.int64())
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _held(path: str, shards: int, min_docs: int):
    """Every slice of documents with the one index that the worker holds."""
    index: list[Index] = []

    def blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Index]]:
        if not index:
            index.append(Index(path, shards, min_docs))
        yield batch, index[0]

    return blocks


def _told(path: str, part: str):
    """Slices of documents cut at the bounds of blocks, each with what the shards told of its block."""
    latest: dict[int, Told] = {}

    def blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Told]]:
        own = batch.column(part).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
        for a, b in zip(cuts, cuts[1:]):
            k = int(own[a])
            if k not in latest:
                latest.clear()
                latest[k] = Told(path, k)
            yield batch.slice(a, b - a), latest[k]

    return blocks


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS, held_bytes: int = HELD_BYTES) -> DataFrame:
    """Drop lines that many documents share, but in the largest doc_id that holds each.

    A line's key is the line without ASCII white space at its ends, A-Z in lower case; keys of at least
    `min_chars` code points found in at least `min_docs` documents count as repeated. Returns the columns of
    `docs`, `text` holding the lines that stay (never null), with n_lines (before) and n_dropped; columns
    of those two names in the input are replaced. A null or empty text is one empty line. Rows count as
    documents, so a repeated row counts twice; rows that share the largest doc_id all keep the line; a null
    doc_id is below every other. An empty table gives an empty result. An index of more than `held_bytes` is
    probed shard by shard (see above); the documents are then written to the shared folder once, in blocks.
    """
    docs = without(docs, "n_lines", "n_dropped").withColumn("doc_id", F.col("doc_id").cast("long"))
    part = fresh(docs, "block")[0]
    path, shards, keys = build_index(docs, min_chars, min_docs, shard_keys)
    if keys * KEY_BYTES <= held_bytes or not shards:
        return map_batches(docs, _drop_lines(min_chars, _held(path, shards, min_docs)), "n_lines long, n_dropped long")
    docs = stage(docs.withColumn(part, F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)), "line_blocks")
    told = _deal(docs, part, path, shards, min_chars, min_docs)
    return map_batches(docs, _drop_lines(min_chars, _told(told, part)), "n_lines long, n_dropped long").drop(part)
