"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated scores.

Fitting takes a bounded sample of labelled documents (FIT_DOCUMENTS, those of the smallest hash of doc_id; fewer if
their whole texts have more than FIT_LETTERS letters together). Every
token has a fixed sparse random index vector; a word's vector is its own index vector plus those of its
neighbours, summed over the sample. Words the sample doesn't hold enough of are represented by their shape
(letter cases, digits and signs, runs shortened). A document is the mean and the spread of its tokens' vectors and the
mean product of neighbouring tokens' (of unit length), by component, which tells repetition from prose. A two-layer
network is trained on these in numpy and its logits are divided by a temperature that fits a part held back.
Scoring is one scan without a shuffle; the model is of bounded size and travels by broadcast.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, map_batches, slices, stage, without

FIT_DOCUMENTS, FIT_LETTERS, VOCABULARY, WIDTH, HIDDEN, THRESHOLD = 4000, 40_000_000, 20_000, 48, 24, 0.3
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_SHAPES = ((re.compile(r"[^\W\d_]+"), None), (re.compile(r"\d+"), "0"))
_KEPT = 100_000


def shape(token: str) -> str:
    """Letters by case (runs shortened), digits as 0, signs as they are, runs of one sign as two; of the whole token."""
    out = _SHAPES[0][0].sub(lambda m: "a" if m[0].islower() else "A" if m[0].isupper() else "Aa", token)
    return "\0" + re.sub(r"(.)\1+", r"\1\1", _SHAPES[1][0].sub("0", out))


def index_vector(token: str) -> np.ndarray:
    """The token's fixed random vector: eight places of plus or minus one, each from 16 bits of the token's hash."""
    bits = np.frombuffer(xxhash.xxh3_128_digest(token), np.uint16)
    out = np.zeros(WIDTH, np.float32)
    np.add.at(out, (bits >> 1) % WIDTH, 2.0 * (bits & 1) - 1)
    return out


@dataclass
class Model:
    """Word rows, their vectors (the last row stands for unknown shapes) and the network."""

    rows: dict[str, int]
    vectors: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    default: float

    def __post_init__(self):
        self.shrink = 1 / np.maximum(np.linalg.norm(self.vectors, axis=1), 1e-9)

    def pool(self, texts: list[str], cache: dict[str, int]) -> np.ndarray:
        """A row for each text: mean and spread of its tokens' vectors and mean product of neighbours', zeros without tokens."""
        out = np.zeros((len(texts), 3 * WIDTH), np.float32)
        if len(cache) > _KEPT:
            cache.clear()
        split = [t.split() if t.isascii() and not _ODD.search(t) else _TOKEN.findall(t) for t in texts]
        new = {x for own in split for x in own}.difference(cache)
        for token in new:
            cache[token] = self.rows.get(token, -1) if token in self.rows else self.rows.get(shape(token), len(self.vectors) - 1)
        sizes, get = np.array([len(own) for own in split], np.int64), cache.__getitem__
        at = np.fromiter((r for own in split for r in map(get, own)), np.int64, int(sizes.sum()))
        for token in [t for t in new if len(t) > 64]:
            del cache[token]
        if len(at):
            # Counts by (text, row): sorted keys and the lengths of their runs; then a sum for each text.
            keys = np.sort(np.repeat(np.arange(len(texts)), sizes) * len(self.vectors) + at)
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            text, row = np.divmod(keys[first], len(self.vectors))
            starts = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
            weight = (np.diff(np.append(first, len(keys))) / sizes[text]).astype(np.float32)[:, None]
            has, own = text[starts], self.vectors[row]
            mean, square = (np.add.reduceat(weight * x, starts) for x in (own, own * own))
            out[has, :WIDTH], out[has, WIDTH : 2 * WIDTH] = mean, np.sqrt(np.maximum(square - mean * mean, 0))
            owner = np.repeat(np.arange(len(texts)), sizes)
            for a in range(0, len(at) - 1, 20_000):  # in blocks: a text may be long
                b = min(a + 20_000, len(at) - 1)
                text, left, right = owner[a:b], at[a:b], at[a + 1 : b + 1]
                scale = self.shrink[left] * self.shrink[right] * (text == owner[a + 1 : b + 1])
                product = self.vectors[left] * self.vectors[right] * scale[:, None]
                starts = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
                out[text[starts], 2 * WIDTH :] += np.add.reduceat(product, starts)
            out[:, 2 * WIDTH :] /= np.maximum(sizes - 1, 1)[:, None]
        return out

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum((pooled - self.center) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def scores(self, texts: list[str], cache: dict[str, int]) -> np.ndarray:
        z = np.clip(self.logits(self.pool(texts, cache)).astype(np.float64) / self.temperature, -40, 40)
        return np.where([bool(t) for t in texts], 1 / (1 + np.exp(-z)), self.default)


_ODD = re.compile("[\x1c-\x1f]")


def _word_vectors(texts: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Rows of words and shapes, and their vectors. Texts are held as numbers of distinct tokens, not as lists of strings."""
    number: dict[str, int] = {}
    split = [np.fromiter((number.setdefault(x, len(number)) for x in _TOKEN.findall(t)), np.int32) for t in texts]
    tokens = list(number)
    form: dict[str, int] = {}
    shape_of = np.array([form.setdefault(shape(x), len(form)) for x in tokens], np.int64)
    df, shapes = np.zeros(len(tokens), np.int64), np.zeros(len(form), np.int64)
    for own in split:
        df[np.unique(own)] += 1
        shapes[np.unique(shape_of[own])] += 1
    often = lambda names, n, least: sorted((x for x, k in zip(names, n.tolist()) if k >= least), key=lambda x: (-n[names[x]], x))[:VOCABULARY]
    names = often(number, df, 5) + often(form, shapes, 3)
    rows = {w: k for k, w in enumerate(names)}
    index = np.stack([*(index_vector(w) for w in names), np.zeros(WIDTH, np.float32)])
    row_of = np.array([rows.get(x, rows.get(s, len(names))) for x, s in zip(tokens, np.array(list(form), object)[shape_of].tolist() if tokens else [])], np.int64)
    sums = np.zeros_like(index)
    for own in split:
        at = row_of[own]
        for a in range(0, max(len(at) - 1, 0), 50_000):  # in blocks: a text may be long
            left, right = at[a : a + 50_000], at[a + 1 : a + 50_001]
            left = left[: len(right)]
            np.add.at(sums, left, index[right])
            np.add.at(sums, right, index[left])
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    return rows, index / np.sqrt(8) + sums / np.maximum(norm, 1e-9)


def fit(texts: list[str], labels: list[int], epochs: int = 80, seed: int = 3) -> Model:
    """Fit on labelled texts; with a class missing every score is the share of label 1 (a half without rows)."""
    y = np.array(labels, np.float32)
    share = float(y.mean()) if len(y) else 0.5
    rows, vectors = _word_vectors(texts)
    z, e = np.zeros(3 * WIDTH, np.float32), np.zeros((3 * WIDTH, HIDDEN), np.float32)
    model = Model(rows, vectors, z, z + 1, e, np.zeros(HIDDEN, np.float32), np.zeros(HIDDEN, np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3))), 1.0, share)
    if len(y) < 2 or not 0 < share < 1:
        return model
    cache: dict[str, int] = {}
    x = np.concatenate([model.pool(texts[a : a + 16], cache) for a in range(0, len(texts), 16)])
    model.center, model.scale = x.mean(0), x.std(0) + 1e-3
    x = (x - model.center) / model.scale
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    train, held = order[len(y) // 6 :], order[: len(y) // 6]
    p = [rng.normal(0, (2 / x.shape[1]) ** 0.5, e.shape), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.array(0.0)]
    m, v, t = [0.0] * 4, [0.0] * 4, 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(train), max(1, len(train) // 128)):
            h = np.maximum(x[at] @ p[0] + p[1], 0)
            d = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - y[at]) / len(at)
            dh = d[:, None] * p[2] * (h > 0)
            t += 1
            for k, g in enumerate((x[at].T @ dh + 1e-4 * p[0], dh.sum(0), h.T @ d + 1e-4 * p[2], d.sum())):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.005 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    model.w1, model.b1, model.w2, model.b2 = p[0].astype(np.float32), p[1].astype(np.float32), p[2].astype(np.float32), float(p[3])
    z = np.maximum(x[held] @ p[0] + p[1], 0) @ p[2] + p[3]
    loss = lambda temp: float(np.mean(np.logaddexp(0, z / temp) - y[held] * z / temp)) if len(held) else 0.0
    model.temperature = float(min(np.geomspace(0.5, 8, 60), key=loss))
    return model


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, documents: int = FIT_DOCUMENTS) -> Model:
    """Fit on at most `documents` labelled rows outside the held-out fifth, whole texts: those of the smallest hash of doc_id.

    Rows without a label of 0 or 1, or without an id, are no examples; a repeated id is one.
    """
    one = labels.filter("quality in (0, 1) and doc_id is not null").filter(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("k")).agg(F.min("quality").alias("y"))
    chosen = one.orderBy(F.xxhash64("k"), "k").limit(documents)
    rows = docs.select(F.col("doc_id").cast("long").alias("k"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "k")  # `documents` rows at most
    rows = stage(rows.groupBy("k", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text")), "fit_sample")
    # Of whole texts, as many of the smallest hashes as have FIT_LETTERS letters together (one at least).
    sized = rows.select("k", F.xxhash64("k").alias("h"), F.length("text").cast("long").alias("n")).orderBy("h", "k").collect()
    ends = np.cumsum([r["n"] for r in sized])
    keys = [r["k"] for r, end in zip(sized, ends) if end <= FIT_LETTERS] or [r["k"] for r in sized[:1]]
    got = rows.filter(F.col("k").isin(keys)).orderBy(F.xxhash64("k"), "k").toArrow().to_pydict() if keys else {"text": [], "y": []}
    return fit(got["text"], [int(y) for y in got["y"]])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Add score (0 to 1, higher: better) and predicted (1 from THRESHOLD) to `docs`, reading nothing but whole texts.

    Null and empty texts score the share of label 1 in the fit. Rows are kept as they are, repeated ones alike; columns
    of the added names are replaced, others carried along whatever their names; an empty table gives an empty result.
    """
    docs = without(docs, "score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cache = shared.value, {}
        for batch in slices(batches, most=1 << 18):
            s = own.scores(as_text(batch.column("text")), cache)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    return map_batches(docs, run, "score double, predicted int")


def crc32(doc_id: int) -> int:
    """The same remainder's source in Python, for tests."""
    return zlib.crc32(str(doc_id).encode())
