"""BPE encoding and decoding by speculation and verification.

Texts fall into chunks at white space. For every chunk not met before, greedy longest match proposes the
tokens of its words; then one vectorised check looks at all adjacent pairs of all proposals at once and asks
whether the merge order could leave that pair standing side by side. A word whose pairs all pass is encoded;
only the others undergo exact merging. Results are kept per chunk in a bounded table of each Python worker.

The vocabulary file (JSON of the tokenizers library, BPE) is a parameter; nothing is trained. Files whose rules part texts
at white space are encoded chunk by chunk; for others the library's own rules part whole texts into words. A file
with features that merging here doesn't know (dropout, byte fallback, unknown tokens, and so on) is an error.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, map_batches, slices, without

#: Chunks remembered by a Python worker; the table is halved when it grows beyond. Longer chunks aren't remembered.
CACHE_CHUNKS, CACHE_LETTERS = 160_000, 256
#: Words of more letters are merged one by one, in time n log n; shorter ones all at once, a merge of each in a round.
LONG_WORD = 256
#: White space to str.split() which the vocabularies' \s does not match.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_NEVER = 2**40
#: Letters by which the longest token of a beginning is looked up.
_HEAD = 4
# The word-splitting rule of the vocabulary file.
_SPLIT_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for chunks of printable ASCII and Latin letters whose lower case is one letter.
_LATIN = "\u00df-\u00f6\u00f8-\u012f\u0131-\u017f"
_PLAIN = re.compile("[\x21-\x7e\u00c0-\u00d6\u00d8-\u012f\u0131-\u017f]+")
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^a-z0-9{_LATIN}]+")
#: Byte-level letters of the UTF-8 bytes of Latin letters: printable bytes stand for themselves, others follow 255.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTE = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_LETTERS = {c: "".join(_BYTE[b] for b in chr(c).encode()) for c in range(0xC0, 0x180)}


class Codec:
    """Encoder and decoder of one vocabulary file with word ends and byte-level letters."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        known = {"type": ("BPE",), "dropout": (None, 0), "unk_token": (None,), "continuing_subword_prefix": (None, ""), "byte_fallback": (None, False), "ignore_merges": (None, False)}
        odd = [f"model.{k} = {model.get(k)!r}" for k, own in known.items() if model.get(k) not in own]
        odd += [f"added token {x['content']!r}: {k}" for x in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized") if x.get(k)]
        if odd or not spec.get("pre_tokenizer"):
            raise ValueError(f"{path}: can't be encoded here: {', '.join(odd) or 'no pre_tokenizer'}")
        # Without a decoder only the rules are needed: no second copy of the vocabulary.
        rules = Tokenizer.from_file(path) if spec.get("decoder") else Tokenizer.from_str(json.dumps(spec | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None}))
        self.normalize = rules.normalizer.normalize_str if spec.get("normalizer") else str
        self.split = rules.pre_tokenizer.pre_tokenize_str
        self.library = rules if spec.get("decoder") else None
        self.end, self.ids = model.get("end_of_word_suffix") or "", model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pieces = [""] * (max([*self.ids.values(), *self.special.values()]) + 1)
        for piece, i in [*self.ids.items(), *self.special.items()]:
            pieces[i] = piece
        self.texts = pa.array(pieces, pa.string())
        self.reach: dict[str, int] = {}
        for x in self.ids:
            x = x.removesuffix(self.end)
            if len(x) >= _HEAD:
                self.reach[x[:_HEAD]] = max(len(x), self.reach.get(x[:_HEAD], 0))
        self._orders(model["merges"])
        self.cache: dict[str, bytes] = {}
        self.word_cache: dict[str, bytes] = {}
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        first = (spec["pre_tokenizer"].get("pretokenizers") or [{}])[0]
        #: Whether the file's rules are those that words_of() knows: they part texts at white space.
        self.plain = kinds == ["NFC", "Replace", "Lowercase"] and first.get("pattern") == {"Regex": _SPLIT_RULE}

    def _orders(self, merges: list) -> None:
        """Orders: single letters first, then each merge's product by rank. Tables are indexed by order."""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        made = {a + b: r for r, (a, b) in reversed(list(enumerate(pairs)))}
        singles = [x for x in self.ids if x not in made]
        self.order = {x: i for i, x in enumerate(singles)} | {x: len(singles) + r for x, r in made.items()}
        n = len(singles) + len(pairs)
        self.left, self.right = np.arange(n), np.arange(n)
        self.id_of = np.zeros(n, np.uint32)
        for x, o in self.order.items():
            self.id_of[o] = self.ids[x]
            if x in made:
                self.left[o], self.right[o] = (self.order[y] for y in pairs[made[x]])
        keys = np.array([self.order[a] << 32 | self.order[b] for a, b in pairs], np.int64)
        values = np.array([len(singles) + r for r in range(len(pairs))])
        first = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_order = np.append(keys[first], np.int64(2**62)), np.append(values[first], 0)

    @functools.cached_property
    def by_pair(self) -> dict[int, int]:
        """Order of each pair's product, the earliest of equal pairs'; made for the first long word."""
        return dict(zip(self.pair_keys[-2::-1].tolist(), self.pair_order[-2::-1].tolist()))

    def propose(self, word: str) -> list[int]:
        """Greedy longest match; orders of the tokens, empty if a letter is unknown."""
        out, at, n, order, end, reach = [], 0, len(word), self.order, self.end, self.reach
        while at < n:
            # No token is longer than those that begin with the same letters; of other beginnings none has so many letters.
            left = n - at
            most = min(left, reach.get(word[at : at + _HEAD], _HEAD - 1)) if left >= _HEAD else left
            for stop in range(at + most, at, -1):
                got = order.get(word[at:] + end if stop == n else word[at:stop])
                if got is not None:
                    out.append(got)
                    at = stop
                    break
            else:
                return []
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging could leave tokens a and b (orders) adjacent, all pairs at once.

        Undoes the two tokens' merges from the last to the first, always the later one; if at some moment the
        parts that touch form a merge of their own that comes before the one just undone, the pair can't stand.
        """
        a, b, ok = a.astype(np.int64), b.astype(np.int64), np.ones(len(a), bool)
        limit = np.full(len(a), 2**31, np.int64)
        live = np.arange(len(a))
        while len(live):
            x, y, most = a[live], b[live], limit[live]
            key = x << 32 | y
            at = np.searchsorted(self.pair_keys, key)
            bad = (self.pair_keys[at] == key) & (self.pair_order[at] < most)
            ok[live[bad]] = False
            undo_left = x > y
            whole_x, whole_y = self.right[x] == x, self.left[y] == y
            undo_left = np.where(whole_x & ~whole_y, False, np.where(whole_y & ~whole_x, True, undo_left))
            done = bad | (whole_x & whole_y)
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left, y, self.left[y])
            # of equal merges the one further left comes first
            limit[live] = np.where(undo_left, x, y + 1)
            live = live[~done]
        return ok

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Order of what each pair merges to, _NEVER if it doesn't."""
        key = a << 32 | b
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_order[at], _NEVER)

    def merge_long(self, word: str) -> np.ndarray:
        """Exact merging of one word: a queue of pairs by rank, then place, over a linked list of its tokens."""
        token = [o for k, c in enumerate(word) if (o := self.order.get(c + self.end if k == len(word) - 1 else c)) is not None]
        n = len(token)
        if n < 2:
            return self.id_of[np.array(token, np.int64)]
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        at = np.array(token, np.int64)
        ranks = self._rank(at[:-1], at[1:])
        queue = [(r, k) for k, r in enumerate(ranks.tolist()) if r != _NEVER]
        heapq.heapify(queue)
        get = lambda a, b: self.by_pair.get(a << 32 | b)
        while queue:
            r, k = heapq.heappop(queue)
            other = after[k]
            if token[k] < 0 or other < 0 or get(token[k], token[other]) != r:
                continue
            token[k], token[other] = r, -1
            after[k] = after[other]
            if after[k] >= 0:
                before[after[k]] = k
                if (new := get(r, token[after[k]])) is not None:
                    heapq.heappush(queue, (new, k))
            if before[k] >= 0 and (new := get(token[before[k]], r)) is not None:
                heapq.heappush(queue, (new, before[k]))
        return self.id_of[np.array([o for o in token if o >= 0], np.int64)]

    def merge(self, words: list[str]) -> list[np.ndarray]:
        """Exact merging, all words at once: each round merges in every word its pair of lowest rank, leftmost first."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(words)
        letters = [[o for k, c in enumerate(w) if (o := self.order.get(c + self.end if k == len(w) - 1 else c)) is not None] for w in words]
        sizes = np.array([len(x) for x in letters], np.int64)
        token = np.fromiter((o for x in letters for o in x), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        last = np.append(owner[1:] != owner[:-1], True)[: len(owner)]
        rank = np.full(len(token), _NEVER, np.int64)
        inner = np.flatnonzero(~last)
        rank[inner] = self._rank(token[inner], token[inner + 1])
        while len(token):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(rank, starts)
            size = np.diff(np.append(starts, len(owner)))
            done = best == _NEVER
            for s, n in zip(starts[done].tolist(), size[done].tolist()):
                out[owner[s]] = self.id_of[token[s : s + n]]
            live = np.repeat(~done, size)
            hit = np.flatnonzero(live & (rank == np.repeat(best, size)))
            hit = hit[np.append(True, owner[hit][1:] != owner[hit][:-1])[: len(hit)]]
            token[hit] = rank[hit]
            live[hit + 1] = False
            last[hit] = last[hit + 1]
            changed = np.zeros(len(token), bool)
            changed[hit] = True
            changed[hit[hit > 0] - 1] = True
            token, owner, rank, last, changed = (x[live] for x in (token, owner, rank, last, changed))
            at = np.flatnonzero(changed)
            ends = last[at]
            rank[at[ends]] = _NEVER
            at = at[~ends]
            rank[at] = self._rank(token[at], token[at + 1])
        return out

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Packed ids of each word."""
        proposals = [self.propose(w) for w in words]
        sizes = np.array([len(x) for x in proposals], np.int64)
        flat = np.fromiter((o for x in proposals for o in x), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        good = sizes > 0
        if len(flat) > 1:
            inner = owner[1:] == owner[:-1]
            fails = owner[1:][inner][~self.compatible(flat[:-1][inner], flat[1:][inner])]
            good[fails] = False
        packed, ends = self.id_of[flat].tobytes(), 4 * np.cumsum(sizes)
        out = [packed[a:z] for a, z in zip((ends - 4 * sizes).tolist(), ends.tolist())]
        failing = []
        for k in np.flatnonzero(~good).tolist():
            if len(words[k]) > LONG_WORD:
                out[k] = self.merge_long(words[k]).tobytes()
            else:
                failing.append(k)
        for k, got in zip(failing, self.merge([words[k] for k in failing])):
            out[k] = got.tobytes()
        return out

    def words_of(self, chunk: str) -> list[str]:
        """A chunk's words in byte-level letters. Plain Latin is split here, by the same rule; the rest by the library."""
        if chunk.isascii() and chunk.isalpha():
            return [chunk.lower()]
        if _PLAIN.fullmatch(chunk):
            return [w if w.isascii() else w.translate(_LETTERS) for w in _PARTS.findall(chunk.lower())]
        return [w for w, _ in self.split(self.normalize(chunk))]

    def _learn_words(self, split: list[list[str]]) -> None:
        """Encode words into the word cache."""
        words = list({w for own in split for w in own}.difference(self.word_cache))
        self.word_cache.update(zip(words, self.encode_words(words)))

    def learn(self, chunks: list[str]) -> None:
        """Encode chunks into the cache."""
        split = [self.words_of(c) for c in chunks]
        self._learn_words(split)
        get = self.word_cache.__getitem__
        self.cache.update((c, get(own[0]) if len(own) == 1 else b"".join(map(get, own))) for c, own in zip(chunks, split))

    def encode_plain(self, text: str) -> list[str]:
        """Chunks of a text without special tokens; a text with odd white space is one chunk."""
        return [text] if _ODD_SPACE.search(text) else text.split()

    def forget(self, most: int) -> None:
        """Let tables of more than `most` entries keep the first half of these: frequent chunks come early."""
        for kept in (self.cache, self.word_cache):
            if len(kept) > most:
                for c in list(itertools.islice(kept, most // 2, None)):
                    del kept[c]

    def encode(self, texts: list[str], remember: int = CACHE_CHUNKS) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers. remember: entries of the tables kept between calls."""
        self.forget(remember)
        split, odd = [], []
        for text in texts:
            parts: list[str | bytes] = []
            segments = self.special_split.split(text) if any(x in text for x in self.special) else [text]
            for k, seg in enumerate(segments):
                if k % 2:
                    parts.append(np.uint32(self.special[seg]).tobytes())
                elif self.plain:
                    parts += self.encode_plain(seg)
                else:
                    parts += [w for w, _ in self.split(self.normalize(seg))]
            split.append(parts)
            odd.append(len(segments) > 1)
        known = self.cache if self.plain else self.word_cache
        new = [c for c in {c for parts in split for c in parts}.difference(known) if isinstance(c, str)]
        if self.plain:
            self.learn(new)
        else:
            self._learn_words([new])
        get = known.__getitem__
        out = [b"".join(map(get, parts)) if not special else b"".join(c if type(c) is bytes else get(c) for c in parts) for parts, special in zip(split, odd)]
        if any(len(c) > CACHE_LETTERS for c in new):
            for kept in (self.cache, self.word_cache):
                for c in [c for c in kept if len(c) > CACHE_LETTERS]:
                    del kept[c]
        return out

    def decode(self, ids: list[bytes]) -> pa.Array:
        """Texts of packed ids, by the file's decoder; pieces are joined by a space where it has none."""
        if self.library:
            return pa.array(self.library.decode_batch([np.frombuffer(x, "<u4").tolist() for x in ids], skip_special_tokens=False), pa.string())
        ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
        taken = self.texts.take(pa.array(np.frombuffer(b"".join(ids), "<u4")))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), taken), " ")


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _round_trip(path: str, decode: bool, remember: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in slices(batches, most=1 << 19):
            packed = own.encode(as_text(batch.column("text")), remember)
            columns = {n: batch.column(n) for n in batch.schema.names}
            columns["n_tokens"] = pa.array([len(x) // 4 for x in packed], pa.int64())
            columns["ids"] = pa.array(packed, pa.binary())
            if decode:
                columns["decoded"] = own.decode(packed)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
        own.forget(remember // 8)  # the worker lives on, in other stages too

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in slices(batches, "ids"):
            columns = {n: batch.column(n) for n in batch.schema.names}
            columns["decoded"] = own.decode(batch.column("ids").fill_null(b"").to_pylist())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def encode(docs: DataFrame, vocabulary: str, decode: bool = False, remember: int = CACHE_CHUNKS) -> DataFrame:
    """Encode `text`: adds n_tokens and ids (binary: little-endian 32-bit integers), with decode=True also decoded.

    remember: chunks and words that a Python worker remembers, about 0.4 KB each: memory against time, never the result.
    No special tokens are added; their strings in a text are encoded as themselves. A null or empty text has
    no ids. Rows are kept as they are, repeated or not, and so are other columns, whatever their names; those named
    as the added ones are replaced. A text of any length is encoded whole. No shuffle; an empty table gives an empty result.
    """
    docs = without(docs, "n_tokens", "ids", "decoded")
    return map_batches(docs, _round_trip(vocabulary, decode, remember), "n_tokens long, ids binary" + ", decoded string" * decode)


def decode(df: DataFrame, vocabulary: str) -> DataFrame:
    """Decode `ids` (as encode() packs them; null is none) into the column decoded, special tokens included."""
    df = without(df, "decoded")
    return map_batches(df, _decode(vocabulary), "decoded string")


def ids_array(ids: F.Column) -> F.Column:
    """Packed ids as array<long>, with built-in functions."""

    def one(k: F.Column) -> F.Column:
        digits = F.hex(F.substring(ids, 4 * k + F.lit(1), F.lit(4)))
        return F.conv(F.concat(*(F.substring(digits, at, 2) for at in (7, 5, 3, 1))), 16, 10).cast("long")

    return F.when(F.length(ids) > 0, F.transform(F.sequence(F.lit(0), (F.length(ids) / 4).cast("int") - 1), one)).otherwise(F.array().cast("array<long>"))
