"""Links within buckets of documents: candidate links by a rule over short sketches, confirmed on full shingle sets.

A bucket is a key that several documents have. It is cut into chunks of bounded size, each with the bucket's smallest id.
A chunk yields a maximum spanning forest over the pairs that the rule doesn't exclude (at most a link fewer than
members), never all pairs. Links are confirmed on full sets, each pair once. Where a forest link fails, or a bucket has several chunks, and
the bucket's members lie in several components, all remaining pairs between components are weighed block by block
(members of the bucket's largest one against the others only) and those that the rule doesn't exclude are confirmed too. So every
link of a bucket takes effect. What is known of a key, and the sets of documents with very many partners, are joined so that no key's
rows meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fits, handing_back, hot_join, mix, small, stage
from .graph import components
from .shingling import shingle_sets

#: Members of a bucket that one task compares at once.
CHUNK = 512
#: Pairs of a document that one task joins its set to.
PARTNERS = 256

#: rule(sketches, sketch, sizes, size, places, place): a score for each pair, lower is nearer; above `most` it can't be a link.
Rule = Callable[..., np.ndarray]


def _forest(ids: np.ndarray, sketch: np.ndarray, size: np.ndarray, at: np.ndarray, rule: Rule, most: int) -> list[tuple[int, int]]:
    """Minimum spanning forest (Prim) over the pairs that the rule doesn't exclude. Equal scores go by a hash of the pair, so
    that the buckets of a group of documents mostly agree on its links."""
    own, most = mix(ids.astype(np.uint64)), (most + 1) << 20
    m, links = len(size), []
    best, by, out = np.full(m, most, np.int64), np.zeros(m, np.int64), np.ones(m, bool)
    k = 0
    for _ in range(m):
        out[k] = False
        if best[k] < most:
            links.append((int(by[k]), k))
        far = (rule(sketch, sketch[k], size, size[k], at, at[k]).astype(np.int64) << 20) | (mix(own ^ own[k]) >> np.uint64(44)).astype(np.int64)
        nearer = out & (far < best)
        best[nearer], by[nearer] = far[nearer], k
        left = np.flatnonzero(out)
        if len(left):
            k = int(left[np.argmin(best[left])])
    return links


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[dict, np.ndarray]]:
    """Columns and group starts of sorted batches; a group is never cut."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def flush(last: bool):
        nonlocal held, rows
        table = pa.Table.from_batches(held)
        cols = {n: table.column(n).combine_chunks() for n in table.column_names}
        at = np.zeros(table.num_rows, bool)
        at[:1] = True
        for k in keys:
            v = cols[k].to_numpy(zero_copy_only=False)
            at[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(at)
        whole = table.num_rows if last else int(starts[-1])
        held, rows = ([] if last else table.slice(whole).to_batches()), table.num_rows - whole
        if whole:
            data = {n: c.slice(0, whole) for n, c in cols.items()}
            return {n: (np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(whole, -1) if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False)) for n, c in data.items()}, np.append(starts[starts < whole], whole)
        return None

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 20_000 and (got := flush(False)):
                yield got
    if rows and (got := flush(True)):
        yield got


def _links(pairs: list[np.ndarray]) -> pa.RecordBatch:
    key, u, v = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in range(3))
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["key", "u", "v"])


def _chunk_forests(rule: Rule, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, starts in _groups(batches, ["key", "chunk"]):
            found, sizes = [], np.diff(starts)
            two = starts[:-1][sizes == 2]
            if len(two):
                ok = two[rule(c["sketch"][two], c["sketch"][two + 1], c["n"][two], c["n"][two + 1], c["at"][two], c["at"][two + 1]) <= most]
                found.append((c["key"][ok], c["id"][ok], c["id"][ok + 1]))
            for a, b in zip(starts[:-1][sizes > 2].tolist(), starts[1:][sizes > 2].tolist()):
                if links := _forest(c["id"][a:b], c["sketch"][a:b], c["n"][a:b], c["at"][a:b], rule, most):
                    at = np.array(links) + a
                    found.append((c["key"][at[:, 0]], c["id"][at[:, 0]], c["id"][at[:, 1]]))
            yield _links(found)

    return run


def _block_pairs(rule: Rule, most: int):
    """Pairs between components, of blocks that hold sides 0 and 1 (only side 0: within)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, starts in _groups(batches, ["key", "i", "j"]):
            found = []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                own = {n: v[a:b] for n, v in c.items()}
                left, right = np.flatnonzero(own["side"] == 0), np.flatnonzero(own["side"] == (own["i"][0] != own["j"][0]))
                for k in left.tolist():
                    other = right[(own["component"][right] != own["component"][k]) & ((own["i"][0] != own["j"][0]) | (right > k))]
                    ok = rule(own["sketch"][other], own["sketch"][k], own["n"][other], own["n"][k], own["at"][other], own["at"][k]) <= most
                    if ok.any():
                        found.append((own["key"][other[ok]], np.full(int(ok.sum()), own["id"][k]), own["id"][other[ok]]))
            yield _links(found)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, id, at), sorted, of the keys that several rows have, with their number and smallest id."""
    for c, starts in _groups(batches, ["key"]):
        sizes = np.diff(starts)
        members, hub = np.repeat(sizes, sizes), np.repeat(c["id"][starts[:-1]], sizes)
        kept = members > 1
        yield pa.RecordBatch.from_arrays([pa.array(v[kept]) for v in (c["key"], c["id"], c["at"], members, hub)], ["key", "id", "at", "members", "hub"])


def confirm(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Check links (u, v), each once in a staged table, on full shingle sets: u, v, linked.

    Each pair is a key of its own: both sets are sent to it, so a document of very many pairs is no task's burden. Where
    the pairs are too many for a broadcast, its rows are dealt by salt before its set joins them.
    """
    ids = stage(pairs.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").count(), "pair_ids")
    chosen = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(small(ids), "id")
    sets = stage(chosen.select("id", "text").mapInArrow(handing_back(shingle_sets(words)), "id long, grams array<long>"), "pair_sets")

    def side(end: str, name: str) -> DataFrame:
        own = sets.select(F.col("id").alias(end), F.col("grams").alias(name))
        if fits(pairs):
            return own.join(F.broadcast(pairs.select("u", "v")), end)
        busy = small(stage(ids.filter(F.col("count") > PARTNERS).select(F.col("id").alias(end), F.ceil(F.col("count") / PARTNERS).cast("int").alias("salts")), "busy_ids"))
        salt = F.pmod(F.xxhash64("u", "v"), F.coalesce("salts", F.lit(1))).cast("int")
        left = pairs.select("u", "v").join(busy, end, "left").withColumn("salt", salt).drop("salts")
        right = own.join(busy, end, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
        return left.join(right, [end, "salt"]).drop("salt")

    both = side("u", "a").join(side("v", "b"), ["u", "v"])
    common = F.size(F.array_intersect("a", "b")).cast("long")
    sized = both.select("u", "v", common.alias("common"), (F.size("a") + F.size("b")).alias("total"))
    linked = 100 * F.col("common") >= percent * (F.col("total") - F.col("common"))
    return sized.groupBy("u", "v").agg(F.bool_or(linked).alias("linked"))  # rows that repeat an id count once


def link_buckets(docs: DataFrame, keyed: DataFrame, heads: DataFrame, rule: Rule, most: int, words: int, percent: int) -> DataFrame:
    """id, component (the smallest id) of the documents that links within buckets reach; others are missing.

    keyed: key, id, at (the key's place in the document) and heavy: whether very many rows might have the key. Rows of
    other keys meet by key; heavy keys are counted first and their rows never do. heads, staged: id (once), n, sketch. docs: doc_id, text.
    """
    light = keyed.filter("not heavy").select("key", "id", "at").repartition(F.col("key")).sortWithinPartitions("key", "id")
    heavy = keyed.filter("heavy").select("key", "id", "at")
    counted = heavy.groupBy("key").agg(F.count("*").alias("members"), F.min("id").alias("hub")).filter("members > 1")
    counted = stage(counted.withColumn("rows", F.col("members")), "buckets")
    kept = light.mapInArrow(handing_back(_shared), "key long, id long, at int, members long, hub long")
    members = stage(kept.unionByName(hot_join(heavy, counted, ["key"], "rows").select(*kept.columns)), "members")
    buckets = members.filter("id = hub").select("key", "members", F.col("members").alias("rows"))
    chunks = F.ceil(F.col("members") / CHUNK).cast("int")
    placed = members.withColumn("chunk", F.explode(F.when(F.col("id") == F.col("hub"), F.sequence(F.lit(0), chunks - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), chunks).cast("int")))))
    placed = placed.join(heads.select("id", "n", "sketch"), "id").select("key", "chunk", "id", "n", "at", "sketch")
    dealt = placed.repartition(F.col("key"), F.col("chunk")).sortWithinPartitions("key", "chunk", "id")
    forest = stage(dealt.mapInArrow(handing_back(_chunk_forests(rule, most)), "key long, u long, v long"), "forest")
    first = stage(confirm(docs, stage(forest.select("u", "v").distinct(), "pairs"), words, percent), "confirmed")
    found = stage(components(first.filter("linked").select("u", "v")), "components")

    # Buckets where the forest doesn't settle everything: all pairs of different components, block by block.
    failed = forest.join(first.filter("not linked"), ["u", "v"], "left_semi").select("key").distinct()
    unsettled = buckets.join(failed.withColumn("failed", F.lit(True)), "key", "left").filter(F.col("failed") | (F.col("members") > CHUNK))
    unsettled = stage(unsettled.select("key", "rows"), "unsettled")
    left = hot_join(members, unsettled, ["key"], "rows").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    left = stage(left.select("key", "id", "at", "component"), "open_members")
    # A bucket's largest component needs no pairs of its own: its blocks meet those of the bucket's other members alone.
    parts = left.groupBy("key", "component").agg(F.count("*").alias("rows"))
    parts = parts.groupBy("key").agg(F.max_by("component", F.struct("rows", "component")).alias("major"), F.max("rows").alias("most"), F.sum("rows").alias("all"))
    others, own = F.ceil((F.col("all") - F.col("most")) / CHUNK).cast("int"), F.ceil(F.col("most") / CHUNK).cast("int")
    parts = stage(parts.filter("all > most").select("key", "major", others.alias("others"), own.alias("own"), "all"), "open_keys")
    if parts.isEmpty():
        return found
    spread = hot_join(left, parts, ["key"], "all")
    minor, hashed = F.col("component") != F.col("major"), F.xxhash64("id")
    block = F.when(minor, F.pmod(hashed, F.col("others"))).otherwise(F.col("others") + F.pmod(hashed, F.col("own"))).cast("int")
    meets = F.sequence(F.lit(0), F.col("others") + F.when(minor, F.col("own")).otherwise(0) - 1)
    spread = spread.withColumn("block", block).withColumn("with", F.explode(meets))
    spread = spread.select("key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), F.expr("int(block > with)").alias("side"), "id", "at", "component")
    spread = spread.join(heads.select("id", "n", "sketch"), "id").repartition(F.col("key"), F.col("i"), F.col("j")).sortWithinPartitions("key", "i", "j", "id")
    more = spread.mapInArrow(handing_back(_block_pairs(rule, most)), "key long, u long, v long").select("u", "v").distinct()
    more = stage(more.join(first, ["u", "v"], "left_anti"), "more_pairs")
    if more.isEmpty():
        return found
    ends = confirm(docs, more, words, percent).filter("linked").select("u", "v")
    for end in ("u", "v"):
        ends = ends.join(found.select(F.col("id").alias(end), F.col("component").alias(f"{end}c")), end, "left")
    joined = components(ends.select(F.coalesce("uc", "u").alias("u"), F.coalesce("vc", "v").alias("v")))
    every = found.unionByName(joined.select("id", F.col("id").alias("component"))).dropDuplicates(["id", "component"])
    every = every.join(joined.select(F.col("id").alias("component"), F.col("component").alias("least")), "component", "left")
    return every.groupBy("id").agg(F.min(F.coalesce("least", "component")).alias("component"))
