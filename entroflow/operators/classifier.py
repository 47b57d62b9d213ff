"""The entropy-regularised classifier: clusters, feature weights and class probabilities learned together.

One iteration is one scan (see steps.statistics) and a few sums on the driver. A fitted model is small and predicts as a
projection. Clusters that empty are dropped, and the model returned is the pruned one.
"""

from __future__ import annotations

import json
import math
import time
import warnings
from dataclasses import asdict, dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import EPS, hash_uniform
from ..sources.staging import staged
from . import prep, steps
from .information import feature_information, positions


def _normalised(v: np.ndarray) -> np.ndarray:
    total = v.sum()
    return v / total if np.isfinite(total) and total > EPS else np.full(len(v), 1 / max(len(v), 1))


def converged(iteration: int, max_iter: int, before: float, now: float, tol: float) -> bool:
    """The budget is used up, or the loss changed by no more than tol of itself; never before the first iteration."""
    if iteration >= max_iter:
        return True
    return iteration > 0 and before != 0 and abs((now - before) / before) <= tol


@dataclass
class Report:
    iterations: int
    losses: list[float]
    n_params: float
    classes_seen: list
    seconds: dict[str, float]


@dataclass
class Model:
    """A fitted model: parameters, what it was fitted with, and the report."""

    parameters: steps.Parameters
    settings: EspaClassifier
    report: Report

    def predict(self, df: DataFrame) -> DataFrame:
        """Add k (cluster) and probabilities (array over classes): labels play no part, no shuffle. Streams work alike."""
        return steps.with_distribution(steps.assign(df, self.parameters), self.parameters)

    def predict_mode(self, df: DataFrame) -> DataFrame:
        """Add prediction: the likeliest class, the first on a tie."""
        out = self.predict(df)
        best = F.array_position("probabilities", F.array_max("probabilities")).cast("int")
        return out.withColumn("prediction", F.element_at(F.lit(self.parameters.classes), best))

    def fitted_params(self, spark) -> dict[str, DataFrame]:
        p = self.parameters
        return {
            "C": spark.createDataFrame([(k + 1, [float(v) for v in c]) for k, c in enumerate(p.centroids)], "k int, c array<double>"),
            "W": spark.createDataFrame([(d + 1, float(w)) for d, w in enumerate(p.importances)], "d int, w double"),
            "L": spark.createDataFrame([(k + 1, [float(v) for v in row]) for k, row in enumerate(p.probabilities)], "k int, l array<double>"),
        }

    def feature_importances(self) -> dict[str, float]:
        p = self.parameters
        names = p.features if isinstance(p.features, list) else [f"{p.features}_{d + 1}" for d in range(p.width)]
        return {n: 1 - math.exp(-p.width * w) for n, w in zip(names, p.importances)}

    def training_losses(self, spark) -> DataFrame:
        return spark.createDataFrame([(i + 1, v) for i, v in enumerate(self.report.losses)], "iteration int, loss double")


def n_params(p: steps.Parameters) -> float:
    """Effective dimension x (clusters + 1) + (classes - 1) x clusters."""
    d = 1.0 if p.width == 1 else math.exp(steps.entropy_of(p.importances))
    return d * (p.clusters + 1) + (len(p.classes) - 1) * p.clusters


#: What tools that drive models may rely on.
TRAITS = {
    "human_name": "Entropy-regularised classifier",
    "features": "numeric columns or one array column, without null or NaN",
    "label": "any column of few values",
    "iteration_parameter": "max_iter",
    "supports_weights": True,
    "supports_training_losses": True,
    "reports_feature_importances": True,
    "reporting_operations": ("predict",),
}


#: Seeds whose distances a pass computes before they are written.
SEEDS_HELD = 16
PACKAGE = {"name": "entroflow", "models": ("EspaClassifier", "MinMaxScaler", "QuantileTransformer"), "license": "see the repository", "is_pure_spark": True}


class FitLog:
    """The state of a fit, written as one JSON row for each iteration kept: parameters, losses, and what they belong to."""

    def __init__(self, spark, path: str, settings: EspaClassifier, p: steps.Parameters, rows: int, every: int):
        if every < 1:
            raise ValueError("every must be at least 1")
        self.spark, self.path, self.every = spark, path.rstrip("/"), every
        # Settings that may change between a stopped fit and its continuation don't tell fits apart.
        told = {k: v for k, v in asdict(settings).items() if k not in ("max_iter", "tol", "verbosity")}
        self.mark = json.dumps([told, p.features, p.classes, p.width, rows], default=str, sort_keys=True)

    def last(self) -> dict | None:
        """The latest state of this very fit, if there is one; one of another fit is an error."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        states = [json.loads(r[0]) for r in self.spark.read.text(self.path, wholetext=True).collect()]  # a small row for each state kept
        if any(s["mark"] != self.mark for s in states):
            raise ValueError(f"{self.path} holds the state of another fit")
        return max(states, key=lambda s: s["iteration"], default=None)

    def keep(self, p: steps.Parameters, iteration: int, before: float, now: float, losses: list[float], seconds: dict) -> None:
        if iteration % self.every:
            return
        parameters = {"centroids": p.centroids, "importances": p.importances, "probabilities": p.probabilities}
        state = {"mark": self.mark, "iteration": iteration, "before": before, "now": now, "losses": losses, "seconds": seconds, "parameters": parameters}
        self.spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("append").text(self.path)


@dataclass(frozen=True)
class EspaClassifier:
    """Settings. eps_c weighs labels (0: blind to them), eps_w the entropy of feature weights (infinite: uniform)."""

    clusters: int = 3
    eps_c: float = 1e-2
    eps_w: float = 1e-1
    kpp_init: bool = True
    mi_init: bool = True
    unbias: bool = True
    max_iter: int = 200
    tol: float = 1e-8
    seed: int = 0
    lowering: str = "arrow"
    verbosity: int = 1
    initial: dict = field(default_factory=dict)

    def __post_init__(self):
        for ok, what in ((self.clusters > 0, "clusters > 0"), (0 <= self.eps_c < math.inf, "0 <= eps_c < infinity"), (self.eps_w > 0, "eps_w > 0"), (self.max_iter > 0, "max_iter > 0"), (self.tol > 0, "tol > 0"), (self.lowering in ("arrow", "expr"), "lowering is arrow or expr")):
            if not ok:
                raise ValueError(f"EspaClassifier: needs {what}")

    def fit(self, df: DataFrame, features: list[str] | str, label: str, key: list[str], weight: str | None = None, classes: list | None = None, resume: str | None = None, every: int = 1) -> Model:
        """Fit on `features` (numeric columns, or one array column) and `label`; `key` tells rows apart for the seeds.

        A null, NaN or infinite feature, an array of another length, a null label, and a weight that isn't numeric or is null are
        errors. classes: all levels, in order (default: those that occur). resume: a folder where the fit's state is written
        after every `every` iterations; a fit of the same settings that finds one there goes on from it.
        """
        started = time.monotonic()
        data, p, w, rows = self._prepare(df, features, label, key, weight, classes)
        log = FitLog(df.sparkSession, resume, self, p, rows, every) if resume else None
        if log and (kept := log.last()):
            return self._train(data, p.change(**kept["parameters"]), label, w, rows, kept["now"], self.max_iter, kept["seconds"], log, kept)
        p = self._initialise(data, p, label, key, w, rows)
        guess = data.withColumn("_g", F.floor(hash_uniform(self.seed, "cluster", *key) * self.clusters).cast("int") + 1)
        first = self._loss(steps.statistics(guess, p, label, self.eps_c, rows, w, self.lowering, "_g"), p, rows)
        return self._train(data, p, label, w, rows, first, self.max_iter, {"initialisation": time.monotonic() - started}, log)

    def update(self, model: Model, df: DataFrame, label: str, key: list[str], weight: str | None = None, extra_iter: int | None = None) -> Model:
        """Continue a fit for extra_iter iterations. If more than max_iter or tol changed since, it is fitted afresh."""
        if replace(model.settings, max_iter=self.max_iter, tol=self.tol, verbosity=self.verbosity) != self:
            return self.fit(df, model.parameters.features, label, key, weight, model.parameters.classes)
        data, _, w, rows = self._prepare(df, model.parameters.features, label, key, weight, model.parameters.classes)
        more = self._train(data, model.parameters, label, w, rows, model.report.losses[-1], extra_iter or self.max_iter, {})
        a, b = model.report, more.report
        seconds = {k: a.seconds.get(k, 0) + b.seconds.get(k, 0) for k in a.seconds | b.seconds}
        more.report = replace(b, iterations=a.iterations + b.iterations, losses=a.losses + b.losses, seconds=seconds)
        return more

    def _prepare(self, df, features, label, key, weight, classes):
        wide = isinstance(features, str)
        known = df if wide else prep.numeric_features(df, features)
        odd_value = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
        bad = F.col(features).isNull() | F.exists(features, odd_value) if wide else F.exists(F.array(*(F.col(f) for f in features)), odd_value)
        width = F.size(features) if wide else F.lit(len(features))
        if weight:
            # Checked, and scaled to sum 1; uniform where the sum is no use.
            known = prep.normalised_weights(known.withColumn("_weight", F.col(weight)), "_weight", "_weight")
        # The narrow matrix is written once: every iteration reads it, whatever becomes of executors.
        columns = dict.fromkeys([*([features] if wide else features), label, *key, *(["_weight"] if weight else [])])
        data = staged(known.select(*columns), "training_rows")
        classes = classes or prep.classes_of(data, label)
        known_label = F.coalesce(F.col(label).isin(classes), F.lit(False)) if len(classes) <= 100 else F.col(label).isNotNull()
        rows, odd, unlabelled, least, most = data.agg(F.count("*"), F.count_if(F.coalesce(bad, F.lit(True))), F.count_if(~known_label), F.min(width), F.max(width)).first()
        if len(classes) > 100:
            unlabelled += data.select(label).distinct().filter(F.col(label).isNotNull()).join(data.sparkSession.createDataFrame([(c,) for c in classes], data.select(label).schema), label, "left_anti").count()
        if odd or unlabelled:
            raise ValueError(f"{odd} rows have a null, NaN or infinite feature, {unlabelled} a label outside the classes")
        if least != most:
            raise ValueError(f"arrays of {least} to {most} features")
        if self.clusters > rows:
            raise ValueError(f"{self.clusters} clusters for {rows} rows")
        w: Column | None = F.col("_weight") if weight else None
        p = steps.Parameters(features, classes, [[0.0] * most] * self.clusters, [1 / most] * most, [[1 / len(classes)] * len(classes)] * self.clusters)
        return data, p, w, rows

    def _initialise(self, data, p, label, key, w, rows):
        if self.initial:
            p = p.change(**self.initial)
        elif self.mi_init and math.isfinite(self.eps_w):
            scores = {r["feature"]: r["mi"] for r in feature_information(data, p.features, label, key, noise=self.seed).collect()}
            names = p.features if isinstance(p.features, list) else positions(p.features, p.width)
            p = p.change(importances=_normalised(np.array([scores[f] for f in names])).tolist())
        shares = {r["class"]: r["l"] for r in steps.priors(data, label, p.classes).collect()}
        p = p.change(probabilities=[[shares[c] for c in p.classes]] * self.clusters)
        return p if "centroids" in self.initial else p.change(centroids=(self._seeds_kpp if self.kpp_init else self._seeds_random)(data, p, key))

    def _seeds_random(self, data, p, key):
        """Rows of the smallest hashes: distinct rows, uniformly."""
        row = F.transform(p.features, lambda v: v.cast("double")) if isinstance(p.features, str) else F.array(*p.columns())
        got = data.select(row.alias("x"), hash_uniform(self.seed, "seed", *key).alias("u"), *key).orderBy("u", *key).limit(self.clusters).collect()
        return [list(r["x"]) for r in got]

    def _seeds_kpp(self, data, p, key):
        """Each next seed drawn in proportion to the weighted squared distance to the nearest one: one aggregate a seed.

        The distance to the nearest of the seeds so far is written with the rows after every SEEDS_HELD seeds, so that a pass
        weighs only those since: work and writes grow with the number of seeds, not its square.
        """
        row = F.transform(p.features, lambda v: v.cast("double")) if isinstance(p.features, str) else F.array(*p.columns())
        rows, chosen, recent = data.select(row.alias("x"), *(F.col(c).alias(f"key{n}") for n, c in enumerate(key)), F.lit(None).cast("double").alias("far")), [], []
        names = [f"key{n}" for n in range(len(key))]
        for i in range(self.clusters):
            u = hash_uniform(self.seed, f"seed{i}", *names)
            if recent:
                own = F.array_min(steps.distances(p.change(features="x", centroids=recent, probabilities=[[1.0]] * len(recent))))
                near = F.least(F.coalesce("far", F.lit(float("inf"))), own)
                if len(recent) == SEEDS_HELD:
                    rows, near, recent = staged(rows.withColumn("far", near), "seed_distances"), F.col("far"), []
            else:
                near = F.col("far")
            score = F.when(near > 0, -F.log(u) / F.when(near > 0, near).otherwise(1.0)) if chosen else u
            got = rows.select(score.alias("s"), "x", *names).filter("s is not null").agg(F.min_by("x", F.struct("s", *names))).first()[0]
            chosen.append(list(got) if got else list(chosen[0]))
            recent.append(chosen[-1])
        return chosen

    def _loss(self, stats, p, rows) -> float:
        """Loss of the rows' given clusters under p as it is."""
        w = np.array(p.importances)
        far = sum(float(w @ q) for _, _, q, _ in stats.values())
        told = sum(float(n @ np.log(np.maximum(p.probabilities[k], EPS))) for k, (_, _, _, n) in stats.items())
        return far - self.eps_c / rows * told - (0 if math.isinf(self.eps_w) else self.eps_w * steps.entropy_of(p.importances))

    def _step(self, stats, p, rows) -> tuple[steps.Parameters, float]:
        """Prune, then W from old centroids, then C and L; and the loss after them."""
        alive = sorted(stats)
        s, r, q, n = (np.array([stats[k][j] for k in alive]) for j in range(4))
        old = np.array([p.centroids[k] for k in alive])
        if math.isinf(self.eps_w):
            w = np.full(p.width, 1 / p.width)
        else:
            z = -q.sum(0) / self.eps_w
            w = _normalised(np.exp(z - z.max()))
        has = (s > 0)[:, None]
        moved = np.divide(r, s[:, None], out=np.zeros_like(r), where=has)
        c = np.where(has, old + moved, 0.0)
        probs = n / n.sum(1, keepdims=True)
        far = float(w @ np.where(has, q - r * moved, 0.0).sum(0))
        told = float((n * np.log(np.maximum(probs, EPS))).sum())
        new = p.change(centroids=c.tolist(), importances=w.tolist(), probabilities=probs.tolist())
        return new, far - self.eps_c / rows * told - (0 if math.isinf(self.eps_w) else self.eps_w * steps.entropy_of(new.importances))

    def _train(self, data, p, label, w, rows, now, budget, seconds, log: FitLog | None = None, kept: dict | None = None) -> Model:
        losses, before, iteration = ([*kept["losses"]], kept["before"], kept["iteration"]) if kept else ([], math.inf, 0)
        started, stats = time.monotonic(), {}
        while not converged(iteration, budget, before, now, self.tol):
            stats = steps.statistics(data, p, label, self.eps_c, rows, w, self.lowering)
            before = now
            p, now = self._step(stats, p, rows)
            iteration += 1
            losses.append(now)
            if log:
                log.keep(p, iteration, before, now, losses, seconds)
            if self.verbosity > 0 and iteration > 1 and now > before + 1e-10:
                warnings.warn(f"the loss rose from {before} to {now} in iteration {iteration}", stacklevel=3)
        exceeded = iteration >= budget
        if exceeded and self.verbosity > 0 and budget > 1:
            warnings.warn(f"no convergence within {budget} iterations", stacklevel=3)
        seconds["training"] = time.monotonic() - started
        if self.unbias and not exceeded:
            started = time.monotonic()
            stats = steps.statistics(data, p, label, 0.0, rows, w, self.lowering)
            alive = sorted(stats)
            n = np.array([stats[k][3] for k in alive])
            p = p.change(centroids=[p.centroids[k] for k in alive], probabilities=(n / n.sum(1, keepdims=True)).tolist())
            seconds["unbias"] = time.monotonic() - started
        stats = stats or steps.statistics(data, p, label, self.eps_c, rows, w, self.lowering)  # a continued fit that had ended
        rows_of = sum((n for _, _, _, n in stats.values()), np.zeros(len(p.classes)))
        seen = [c for c, n in zip(p.classes, rows_of) if n > 0]
        return Model(p, self, Report(iteration, losses, n_params(p), seen, seconds))
