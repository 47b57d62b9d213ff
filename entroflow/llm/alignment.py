"""Cross-tokenizer alignment: which tokens of two vocabularies lie over one another, and how often in the corpus.

Texts fall into chunks at single spaces, where both tokenizers always end a token; a task encodes each distinct chunk of a batch
once and knows its tokens, groups and links from then on.

1. One scan gives for each batch of documents their digests and, for each stripe of A ids, the batch's linked id pairs with the
   documents that hold them: packed arrays, a few bytes for each document's pair.
2. The pairs are partitioned by stripe. A task adds the batches' numbers of documents into the stripe's dense matrix of A ids by B ids
   (np.add.at); a row's maximum is its best count. The batches of a stripe are dealt to several tasks first, whose
   sums are added up after.
3. The links, partitioned by the same stripes, meet the stripe's counts and become sums by document, which
   join the documents' digests by batch. Batches of a stripe are dealt to several tasks here too, so a token that every document
   holds is nobody's bottleneck.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import handing_back, slices, small, stage

#: A ids of a stripe: its dense matrix of 64-bit counts has so many rows and a column for each B id (66 MB for 32,000).
STRIPE_IDS = 256
#: Bytes of text of a batch; chunks that a task remembers.
BATCH_BYTES, REMEMBERED = 8 << 20, 300_000
#: Batches whose pairs of a stripe one task adds up.
DEALT = 64
FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")

# Fixed values of the byte-level alphabet: bytes that stand for themselves; the others follow from code point 256 on.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_OTHER = [b for b in range(256) if b not in set(_PLAIN)]
_BYTE_OF = {chr(b): b for b in _PLAIN} | {chr(256 + k): b for k, b in enumerate(_OTHER)}
# Fixed value: how byte-level files split texts, where they name no pattern of their own.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CHUNK = re.compile(r"(?<=[^ ]) (?=\S)")


class _Pair:
    """The two tokenizers: ids of a list of texts without special tokens, and the bytes of each id."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as f:
            file = json.load(f)
        split = file.get("pre_tokenizer") or {}
        if file["model"].get("type") != "BPE" or file.get("normalizer") or split.get("type") != "ByteLevel" or not split.get("use_regex", True) or split.get("add_prefix_space"):
            raise ValueError(f"{a_path}: not a byte-level BPE file of the plain kind")
        special = {t["content"] for t in file.get("added_tokens", ())}
        self.a_bytes = {i: bytes(_BYTE_OF[c] for c in token) for token, i in file["model"]["vocab"].items() if token not in special}
        merged = [b"".join(bytes(_BYTE_OF[c] for c in x) for x in (m.split(" ") if isinstance(m, str) else m)) for m in file["model"]["merges"]]
        ranks = {v: k for k, v in self.a_bytes.items()}
        order = [ranks[m] for m in merged]
        if order != sorted(order) or len(set(order)) != len(order):
            raise ValueError(f"{a_path}: ids don't follow the order of merges")
        self.a = tiktoken.Encoding("a", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        size = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(k) for k in range(size)]
        if any(re.search("[^▁]▁", p) for p in pieces) or self.b.encode("a b") != self.b.encode("a") + self.b.encode("b"):
            raise ValueError(f"{b_path}: pieces go on past a space, or spaces aren't kept")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.width = size
        self.a_size, self.b_size = (np.zeros(n, np.int64) for n in (max(self.a_bytes) + 1, size))
        for k, v in self.a_bytes.items():
            self.a_size[k] = len(v)
        self.b_size[:] = [len(v) for v in self.b_bytes]
        # An id in a group's text with what follows it: another of its side, or the other side or the next group.
        self.symbols = [b"%d%b" % (k, x) for n, ends in ((len(self.a_size), (b",", b"|")), (size, (b",", b";"))) for k in range(n) for x in ends]
        self.symbol_size = np.array([len(v) for v in self.symbols], np.int64)


_loaded: dict[tuple[str, str], _Pair] = {}


def _pair(a_path: str, b_path: str) -> _Pair:
    if (a_path, b_path) not in _loaded:
        _loaded.clear()
        _loaded[a_path, b_path] = _Pair(a_path, b_path)
    return _loaded[a_path, b_path]


class _Chunks:
    """What is known of chunks: numbers of tokens, groups and links, the text of their groups, and their links."""

    def __init__(self, pair: _Pair):
        self.pair, self.at, self.texts = pair, {}, []
        self.numbers, self.links, self.start = np.zeros((0, 4), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, chunks: list[str]) -> None:
        """Add chunks (each begins with a space), all at once; one whose bytes don't come back from both sides has no text."""
        p, raw = self.pair, [c.encode() for c in chunks]
        a, b = [p.a.encode_ordinary(c) for c in chunks], p.b.encode([c[1:] for c in chunks], num_threads=1)
        good = self._good(raw, a, b)
        sizes = np.array([(len(x), len(y)) for x, y in zip(a, b)], np.int64).reshape(-1, 2)
        sizes[~good] = 0
        if not good.all():
            a, b = ([x for x, ok in zip(side, good) if ok] for side in (a, b))
        a, b = (np.fromiter(itertools.chain.from_iterable(side), np.int64, int(n)) for side, n in zip((a, b), sizes.sum(0)))
        numbers, links, codes, cuts = self._over(a, b, sizes)
        text = b"".join([p.symbols[c] for c in codes.tolist()])
        ends = np.append(0, np.cumsum(p.symbol_size[codes]))[cuts]
        for k, chunk in enumerate(chunks):
            self.at[chunk] = len(self.at)
        self.texts += [text[i:j] if ok else None for ok, i, j in zip(good.tolist(), [0, *ends.tolist()], ends.tolist())]
        self.start = np.concatenate([self.start, len(self.links) + np.cumsum(numbers[:, 3]) - numbers[:, 3]])
        self.numbers, self.links = np.concatenate([self.numbers, numbers]), np.concatenate([self.links, links])

    def _good(self, raw: list[bytes], a: list[list[int]], b: list[list[int]]) -> np.ndarray:
        a_bytes, b_bytes = self.pair.a_bytes, self.pair.b_bytes
        return np.array([r == b"".join([a_bytes[k] for k in x]) == b"".join([b_bytes[k] for k in y]) for r, x, y in zip(raw, a, b)], bool)

    def _over(self, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Numbers of each chunk, all links, the symbols of all groups' texts and where each chunk's end. Both sides have the same bytes."""
        p = self.pair
        a_end, b_end = np.cumsum(p.a_size[a]), np.cumsum(p.b_size[b])
        # B tokens from the one that holds an A token's first byte to the one that holds its last.
        first, last = np.searchsorted(b_end, a_end - p.a_size[a], "right"), np.searchsorted(b_end, a_end, "left")
        n = last - first + 1
        links = np.repeat(a, n) * p.width + b[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]
        a_last, b_last = np.isin(a_end, b_end, assume_unique=True), np.isin(b_end, a_end, assume_unique=True)
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        # A group's A tokens, then its B tokens.
        a_upto, b_upto = np.append(0, np.flatnonzero(a_last) + 1), np.append(0, np.flatnonzero(b_last) + 1)
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + b_upto[a_group]] = 2 * a + a_last
        codes[np.arange(len(b)) + a_upto[b_group + 1]] = 2 * (b + len(p.a_size)) + b_last
        a_cut = np.cumsum(sizes[:, 0])
        sums = lambda v: np.diff(np.append(0, np.append(0, np.cumsum(v))[a_cut]))
        return np.column_stack([sizes, sums(a_last), sums(n)]), links, codes, a_cut + np.cumsum(sizes[:, 1])


def _split(texts: pa.Array) -> list[list[str]]:
    """Chunks of each text with a space before it, each chunk with its space; none for a null or empty text."""
    out = []
    for t in texts.to_pylist():
        if not t:
            out.append([])
            continue
        parts = (" " + t).split(" ")[1:]
        if "" not in parts and not any(w[0].isspace() for w in parts):
            out.append([" " + w for w in parts])
        else:
            cut = _CHUNK.split(" " + t)
            out.append([cut[0], *(" " + w for w in cut[1:])])
    return out


def _linked(a_path: str, b_path: str):
    """Rows of two kinds: a batch's digests (stripe null), and its links of one stripe of A ids."""
    names = ["batch", "stripe", "ids", "numbers", "pairs", "counts", "docs", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, done = _Chunks(_pair(a_path, b_path)), 0
        for batch in slices(batches, most=BATCH_BYTES):
            for start in range(0, batch.num_rows, 2**16):
                part = batch.slice(start, 2**16)
                number = (TaskContext.get().partitionId() << 32) + done
                done += 1
                if len(known.at) > REMEMBERED:
                    known = _Chunks(known.pair)
                yield from _of_batch(part, known, number, names)

    return run


def _of_batch(part: pa.RecordBatch, known: _Chunks, number: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    texts, width = _split(part.column("text")), known.pair.width
    new = list({c for t in texts for c in t if c not in known.at})
    for k in range(0, len(new), 20_000):
        known.learn(new[k : k + 20_000])
    get = known.at.__getitem__
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.fromiter((get(c) for t in texts for c in t), np.int64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(texts)), sizes)
    bad = np.array([t is None for t in known.texts], bool)
    whole = sizes > 0
    whole[doc[bad[flat]]] = False
    keep = whole[doc]
    flat, doc, numbers = flat[keep], doc[keep], known.numbers
    sums = np.stack([np.bincount(doc, weights=numbers[flat, k], minlength=len(texts)) for k in range(4)], 1).astype(np.int64)
    digests, text_of, own, a = [], known.texts, flat.tolist(), 0
    for z in np.cumsum(np.bincount(doc, minlength=len(texts))).tolist():
        digests.append(hashlib.sha256(b"".join([text_of[c] for c in own[a:z]])[:-1]).hexdigest() if z > a else "")
        a = z
    # (document, chunk) with its number, then (pair, document) with the times that they are linked.
    both, times = np.unique(doc * len(known.texts) + flat, return_counts=True)
    doc, flat = both // max(len(known.texts), 1), both % max(len(known.texts), 1)
    n = numbers[flat, 3]
    pair = known.links[np.repeat(known.start[flat] - np.cumsum(n) + n, n) + np.arange(n.sum())]
    key, times = (pair << 16) | np.repeat(doc, n), np.repeat(times, n)
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    times = np.add.reduceat(times, start) if len(start) else times
    key = key[start]
    pair, doc = key >> 16, (key & 0xFFFF).astype("<u2")
    begin = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
    pairs, counts = pair[begin], np.diff(np.append(begin, len(pair)))
    stripe = pairs // (STRIPE_IDS * width)
    cut = np.flatnonzero(np.append(True, stripe[1:] != stripe[:-1])) if len(stripe) else np.zeros(0, np.int64)
    cut_end, row_end = np.append(cut[1:], len(pairs)), np.append(begin, len(pair))
    told = json.dumps({"ids": part.column("doc_id").to_pylist(), "digests": digests}).encode()
    rows = [(number, None, told, sums.astype("<i8").tobytes(), None, None, None, None)]
    for a, z in zip(cut.tolist(), cut_end.tolist()):
        i, j = int(row_end[a]), int(row_end[z])
        local = pairs[a:z] - stripe[a] * STRIPE_IDS * width
        rows.append((number, int(stripe[a]), None, None, local.astype("<u4").tobytes(), counts[a:z].astype("<u4").tobytes(), doc[i:j].tobytes(), times[i:j].astype("<u4").tobytes()))
    kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 6)
    for k in range(0, len(rows), 32):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 32]), kinds)], names)


def _blocks(width: int):
    """Add the counts of each stripe in this partition into its dense matrix: the pairs that occur, their counts, and row maxima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, now = np.zeros(STRIPE_IDS * width, np.int64), None

        def out() -> pa.RecordBatch:
            pairs = np.flatnonzero(block)
            counts, best = block[pairs], block.reshape(STRIPE_IDS, width).max(1)
            got = pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in (pairs.astype("<u4"), counts.astype("<i8"), best.astype("<i8")))], ["stripe", "pairs", "counts", "best"])
            block[pairs] = 0
            return got

        for batch in batches:
            for stripe, pairs, counts in zip(batch.column("stripe").to_pylist(), batch.column("pairs"), batch.column("counts")):
                if stripe != now:
                    if now is not None:
                        yield out()
                    now = stripe
                pairs = np.frombuffer(pairs.as_buffer(), "<u4")
                np.add.at(block, pairs, np.frombuffer(counts.as_buffer(), "<i8" if len(counts.as_buffer()) == 8 * len(pairs) else "<u4").astype(np.int64))
        if now is not None:
            yield out()

    return run


def _scored(width: int):
    """Links of a stripe against its counts (which come first): by batch and document the best links and the sum of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = counts = best = np.zeros(0, np.int64)
        for batch in batches:
            out = []
            cols = {n: batch.column(n) for n in batch.schema.names}
            for k, side in enumerate(cols["side"].to_pylist()):
                if side == 0:
                    pairs, counts, best = (np.frombuffer(cols[c][k].as_buffer(), t) for c, t in (("pairs", "<u4"), ("counts", "<i8"), ("best", "<i8")))
                    continue
                own, held = np.frombuffer(cols["pairs"][k].as_buffer(), "<u4"), np.frombuffer(cols["counts"][k].as_buffer(), "<u4")
                docs, times = np.frombuffer(cols["docs"][k].as_buffer(), "<u2"), np.frombuffer(cols["times"][k].as_buffer(), "<u4").astype(np.int64)
                count = counts[np.searchsorted(pairs, own)]
                top = count == best[own // width]
                count, top = np.repeat(count, held), np.repeat(top, held)
                n = int(docs.max()) + 1
                sums, tops = np.zeros(n, np.int64), np.zeros(n, np.int64)
                np.add.at(sums, docs, count * times)
                np.add.at(tops, docs, top * times)
                at = np.flatnonzero(sums)
                out.append((cols["batch"][k].as_py(), at.astype("<u2").tobytes(), tops[at].astype("<i8").tobytes(), sums[at].astype("<i8").tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), *[pa.binary()] * 3))], ["batch", "docs", "tops", "sums"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each batch (their digests come first) with the sums over all stripes."""
    now = numbers = told = None

    def out() -> pa.RecordBatch:
        columns = [pa.array(told["ids"], pa.int64()), *(pa.array(numbers[:, k]) for k in range(4)), pa.array(best), pa.array(sums), pa.array(told["digests"], pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", *FIELDS[:-1], "groups_sha256"])

    best = sums = None
    for batch in batches:
        cols = {n: batch.column(n) for n in batch.schema.names}
        for k, number in enumerate(cols["batch"].to_pylist()):
            if cols["ids"][k].is_valid:
                if now is not None:
                    yield out()
                now, told = number, json.loads(cols["ids"][k].as_py())
                numbers = np.frombuffer(cols["numbers"][k].as_buffer(), "<i8").reshape(-1, 4)
                best, sums = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
            else:
                at = np.frombuffer(cols["docs"][k].as_buffer(), "<u2")
                best[at] += np.frombuffer(cols["tops"][k].as_buffer(), "<i8")
                sums[at] += np.frombuffer(cols["sums"][k].as_buffer(), "<i8")
    if now is not None:
        yield out()


def _links(docs: DataFrame, a_path: str, b_path: str) -> tuple[DataFrame, DataFrame, int]:
    """Staged links by batch and stripe, the counts by stripe, and the number of B ids."""
    width = _pair(a_path, b_path).width
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fields = "batch long, stripe int, ids binary, numbers binary, pairs binary, counts binary, docs binary, times binary"
    rows = stage(texts.mapInArrow(handing_back(_linked(a_path, b_path)), fields), "links")
    counted = "stripe int, pairs binary, counts binary, best binary"
    held = rows.filter("stripe is not null").select("stripe", "pairs", "counts", F.pmod(F.xxhash64("batch"), F.lit(DEALT)).alias("deal"))
    some = held.repartition(F.col("stripe"), F.col("deal")).sortWithinPartitions("stripe").mapInArrow(_blocks(width), counted)
    whole = some.select("stripe", "pairs", "counts").repartition(F.col("stripe")).sortWithinPartitions("stripe")
    return rows, stage(whole.mapInArrow(handing_back(_blocks(width)), counted), "stripe_counts"), width


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """How the tokens of two tokenizers lie over one another in each text, and how common its links are in the corpus.

    a_path: a byte-level BPE file (tokenizers' JSON) that encodes space + text; b_path: a sentencepiece model that puts a space before
    the text. Both without special tokens, whose strings are plain text. Returns doc_id and n_a, n_b (tokens), n_groups
    (cuts at byte offsets where both end a token), n_links (pairs of an A and a B token that share bytes), n_best (links whose id pair
    is held by as many documents as any of its A id's), count_sum (over links, the documents that hold the pair) and
    groups_sha256 (of `a1,a2|b1;...`), a row for each row of docs. Other columns play no part; repeated rows are documents of their own,
    and a null doc_id counts as one. A null or empty text, or one that either side doesn't give back byte by byte, has
    zeros and ''. An empty table gives an empty result. Texts without a space are chunks of their own, however long.
    """
    rows, counts, width = _links(docs, a_path, b_path)
    deal = F.pmod(F.xxhash64("batch"), F.lit(DEALT)).cast("long")
    none = F.lit(None).cast("binary")
    links = rows.filter("stripe is not null").select("stripe", deal.alias("deal"), F.lit(1).alias("side"), "batch", "pairs", "counts", "docs", "times", none.alias("best"))
    # A stripe's counts go to each of its deals.
    blocks = counts.select("stripe", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALT - 1).cast("long"))).alias("deal"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("batch"), "pairs", "counts", none.alias("docs"), none.alias("times"), "best")
    held = small(links.select("stripe", "deal").distinct())  # fewer than stripes x DEALT rows
    blocks = blocks.join(held, ["stripe", "deal"], "left_semi").select(*links.columns)
    met = links.unionByName(blocks).repartition(F.col("stripe"), F.col("deal")).sortWithinPartitions("stripe", "deal", "side")
    scored = met.mapInArrow(handing_back(_scored(width)), "batch long, docs binary, tops binary, sums binary")
    told = rows.filter("stripe is null").select("batch", F.lit(0).alias("side"), "ids", "numbers", none.alias("docs"), none.alias("tops"), none.alias("sums"))
    scored = scored.select("batch", F.lit(1).alias("side"), none.alias("ids"), none.alias("numbers"), "docs", "tops", "sums")
    both = told.unionByName(scored).repartition(F.col("batch")).sortWithinPartitions("batch", "side")
    return both.mapInArrow(handing_back(_summed), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def pair_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """a, b, documents: the id pairs that are linked anywhere, and how many documents hold each. The alignment table itself."""
    _, counts, width = _links(docs, a_path, b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stripe, pairs, counts in zip(batch.column("stripe").to_pylist(), batch.column("pairs"), batch.column("counts")):
                at = np.frombuffer(pairs.as_buffer(), "<u4").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((stripe * STRIPE_IDS + at // width).astype(np.int32)), pa.array((at % width).astype(np.int32)), pa.array(np.frombuffer(counts.as_buffer(), "<i8"))], ["a", "b", "documents"])

    return counts.select("stripe", "pairs", "counts").mapInArrow(run, "a int, b int, documents long")
