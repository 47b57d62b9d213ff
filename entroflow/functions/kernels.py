"""Numeric kernels as Column expressions: guarded logarithms, entropies, argmin, normalisation, softmax.

Everything is double. Logarithms are floored, zero sums and non-finite sums become uniform, ties go to the first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The floor of logarithms and sums, and the sigmoid of the effective dimension.
EPS = 2.220446049250313e-16
ALPHA = 0.48303294517787015
BETA = 2.236559493796657
GAMMA = -1.1385870064168448

Array = Column | str


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safelog(x, tol: float = EPS) -> Column:
    """log(max(x, tol))."""
    return F.log(F.greatest(_col(x).cast("double"), F.lit(tol)))


def safelog_array(a: Array, tol: float = EPS) -> Column:
    return F.transform(_col(a), lambda v: safelog(v, tol))


def array_sum(a: Array) -> Column:
    return F.aggregate(_col(a), F.lit(0.0), lambda s, v: s + v.cast("double"))


def entropy(a: Array, tol: float = EPS) -> Column:
    """-sum w log w of an array."""
    return -array_sum(F.transform(_col(a), lambda w: w * safelog(w, tol)))


def entropy_of(column, tol: float = EPS) -> Column:
    """The same over the rows of a column, as an aggregate."""
    return -F.sum(_col(column) * safelog(column, tol))


def cross_entropy(a: Array, b: Array, tol: float = EPS) -> Column:
    """-sum a log b; arrays of unlike sizes raise an error."""
    a, b = _col(a), _col(b)
    value = -array_sum(F.zip_with(a, b, lambda x, y: x * safelog(y, tol)))
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("cross_entropy: arrays differ in size")).cast("double"))


def assign_closest(distances: Array) -> Column:
    """1-based place of the smallest distance, the first on a tie."""
    d = _col(distances)
    return F.array_position(d, F.array_min(d)).cast("int")


def one_hot(k, n: int) -> Column:
    """0/1 array with a one at the 1-based place k."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (i == _col(k)).cast("double"))


def share(value, total, n) -> Column:
    """value / total, or 1 / n where the total is tiny, NaN or infinite."""
    value, total, n = _col(value), _col(total), _col(n)
    bad = total.isNull() | (total <= EPS) | F.isnan(total) | (total == float("inf"))
    return F.when(bad, 1.0 / n).otherwise(value / F.when(bad, F.lit(1.0)).otherwise(total))


def normalise(a: Array) -> Column:
    """An array scaled to sum 1; uniform where the sum is no use; empty stays empty."""
    a = _col(a)
    return F.transform(a, lambda v: share(v.cast("double"), array_sum(a), F.size(a)))


def softmax(a: Array, prefactor: float = 1.0) -> Column:
    """exp(v / prefactor), scaled to sum 1; uniform if all are -Infinity. prefactor must be positive."""
    if not prefactor > 0:
        raise ValueError("softmax: prefactor must be positive")
    a = _col(a)
    top = F.array_max(a)
    shifted = F.when(top == float("-inf"), F.transform(a, lambda v: F.lit(0.0))).otherwise(F.transform(a, lambda v: F.exp((v - top) / prefactor)))
    return normalise(shifted)


def effective_dimension(a: Array, normalised: bool = False) -> Column:
    """exp(entropy): 0 for an empty array, 1 for one entry whatever its value; divided by the size if normalised."""
    a = _col(a)
    d = F.when(F.size(a) == 0, 0.0).when(F.size(a) == 1, 1.0).otherwise(F.exp(entropy(a)))
    return F.when(F.size(a) == 0, 0.0).otherwise(d / F.greatest(F.size(a), F.lit(1))) if normalised else d


def digamma(n) -> Column:
    """Digamma of a positive integer column, absolute error below 1e-10: harmonic sum below 10, expansion from there."""
    n = _col(n)
    harmonic, small = 0.0, F.lit(None).cast("double")
    for k in range(1, 10):
        small = F.when(n == k, F.lit(harmonic - 0.5772156649015329)).otherwise(small)
        harmonic += 1 / k
    x = F.greatest(n.cast("double"), F.lit(10.0))
    q = 1.0 / (x * x)
    return F.when(n < 10, small).otherwise(F.log(x) - 0.5 / x - q * (1 / 12 - q * (1 / 120 - q * (1 / 252 - q / 240))))


def hash_uniform(seed: int, tag: str, *key) -> Column:
    """A uniform in (0, 1) from a seed and a row's key, whatever the partitioning: md5's first 48 bits."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(tag), *(_col(k).cast("string") for k in key))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)


def get_eff(eps, d: int, normalised: bool = False) -> Column:
    """Effective dimension that a regularisation strength leads to, of d features."""
    if d < 1:
        raise ValueError("get_eff: d must be at least 1")
    eps = _col(eps)
    eff = 1 / d + (1 - 1 / d) / F.pow(1 + F.exp(-BETA * (F.log(eps) - GAMMA)), F.lit(ALPHA))
    eff = F.when(eps > 0, eff).otherwise(F.raise_error(F.lit("get_eff: eps must be positive")).cast("double"))
    return eff if normalised else eff * d


def get_eps(eff, d: int, normalised: bool = False) -> Column:
    """The inverse: the floor's value up to 1 / d, Infinity from 1."""
    if d < 1:
        raise ValueError("get_eps: d must be at least 1")
    f = _col(eff) if normalised else _col(eff) / d
    inner = F.greatest(F.least(f, F.lit(1 - 1e-15)), F.lit(1 / d + 1e-15))
    base = F.pow((1 - 1 / d) / (inner - 1 / d), F.lit(1 / ALPHA)) - 1
    eps = F.exp(GAMMA - F.log(base) / BETA)
    return F.when(f <= 1 / d, F.lit(EPS)).when(f >= 1, F.lit(float("inf"))).otherwise(eps)
