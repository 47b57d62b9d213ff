"""Registered queries over the reference tables, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import frames
from ..functions import kernels as K
from ..operators import prep, steps
from ..operators.classifier import EspaClassifier, n_params
from ..operators.information import feature_information, mutual_information
from ..operators.scalers import MinMaxScaler, QuantileTransformer, melt
from ..sources.tables import document_features, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(x: Column | str) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6)


EPS = repr(K.EPS)
LOG = f"ln(greatest({{}}, {EPS}))"

# ---------------------------------------------------------------------------------------------- kernels


@query(f"SELECT s_suppkey, round({LOG.format('s_acctbal')}, 6) AS v FROM supplier")
def safelog(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", r6(K.safelog("s_acctbal")).alias("v"))


@query(f"SELECT s_suppkey, round({LOG.format('s_acctbal')} + 2 * {LOG.format('0.0')} + 4 * {LOG.format('s_nationkey::DOUBLE')}, 6) AS v FROM supplier")
def safelog_array(spark: SparkSession, d: str) -> DataFrame:
    a = K.safelog_array(F.array(F.col("s_acctbal"), F.lit(0.0), F.col("s_nationkey").cast("double")))
    return table(spark, d, "supplier").withColumn("a", a).select("s_suppkey", r6(F.col("a")[0] + 2 * F.col("a")[1] + 4 * F.col("a")[2]).alias("v"))


_P = "(abs(s_acctbal) / 20000)"


@query(f"SELECT s_suppkey, round(-({_P} * {LOG.format(_P)} + (1 - {_P}) * {LOG.format('1 - ' + _P)}), 6) AS v FROM supplier")
def entropy(spark: SparkSession, d: str) -> DataFrame:
    p = F.abs("s_acctbal") / 20000
    return table(spark, d, "supplier").select("s_suppkey", r6(K.entropy(F.array(p, 1 - p, F.lit(0.0)))).alias("v"))


@query(f"SELECT s_suppkey, round(-({_P} * {LOG.format('0.25')} + (1 - {_P}) * {LOG.format('0.0')}), 6) AS v FROM supplier")
def cross_entropy(spark: SparkSession, d: str) -> DataFrame:
    p = F.abs("s_acctbal") / 20000
    return table(spark, d, "supplier").select("s_suppkey", r6(K.cross_entropy(F.array(p, 1 - p), F.array(F.lit(0.25), F.lit(0.0)))).alias("v"))


# A long matrix: nations by market segments, balances. Ties go to the smaller nation.
_LONG = "m AS (SELECT c_nationkey AS i, c_mktsegment AS j, sum(c_acctbal) AS v FROM customer GROUP BY ALL)"


def _long(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("i"), F.col("c_mktsegment").alias("j")).agg(F.sum("c_acctbal").alias("v"))


@query(f"WITH {_LONG} SELECT j, arg_min(i, abs(v - 5000))::INT AS k FROM m GROUP BY j")
def assign_closest(spark: SparkSession, d: str) -> DataFrame:
    return frames.assign_closest(_long(spark, d).withColumn("v", F.abs(F.col("v") - 5000))).select("j", F.col("k").cast("int").alias("k"))


_NEAR = "CASE WHEN abs(s_acctbal) <= abs(s_acctbal - 4000) AND abs(s_acctbal) <= abs(s_acctbal - 8000) THEN 1 WHEN abs(s_acctbal - 4000) <= abs(s_acctbal - 8000) THEN 2 ELSE 3 END"


def _near() -> Column:
    return K.assign_closest(F.array(*(F.abs(F.col("s_acctbal") - c) for c in (0, 4000, 8000))))


@query(f"SELECT s_suppkey, ({_NEAR})::INT AS k FROM supplier")
def assign_closest_vec(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", _near().alias("k"))


@query(f"SELECT s_suppkey, (k = 1)::DOUBLE AS g1, (k = 2)::DOUBLE AS g2, (k = 3)::DOUBLE AS g3 FROM (SELECT s_suppkey, {_NEAR} AS k FROM supplier)")
def assign_onehot(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "supplier").withColumn("g", K.one_hot(_near(), 3))
    return g.select("s_suppkey", *(F.col("g")[k].alias(f"g{k + 1}") for k in range(3)))


@query(f"SELECT k::INT AS k, count(*) AS n FROM (SELECT {_NEAR} AS k FROM supplier) GROUP BY k")
def assign_sparse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").withColumn("k", _near()).groupBy("k").agg(F.count("*").alias("n"))


def _stochastic(by: str) -> str:
    return f"WITH {_LONG} SELECT i, j, round(CASE WHEN sum(v) OVER w <= {EPS} THEN 1.0 / count(*) OVER w ELSE v / sum(v) OVER w END, 6) AS v FROM m WINDOW w AS (PARTITION BY {by})"


@query(_stochastic("j"))
def left_stochastic(spark: SparkSession, d: str) -> DataFrame:
    return frames.left_stochastic(_long(spark, d)).withColumn("v", r6("v"))


@query(_stochastic("i"))
def right_stochastic(spark: SparkSession, d: str) -> DataFrame:
    return frames.right_stochastic(_long(spark, d)).withColumn("v", r6("v"))


@query("SELECT n_nationkey, round(n_nationkey / (n_nationkey + 3.0), 6) AS a, round(3 / (n_nationkey + 3.0), 6) AS b, 0.5::DOUBLE AS c FROM nation")
def normalise(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").withColumn("x", K.normalise(F.array(F.col("n_nationkey").cast("double"), F.lit(3.0)))).withColumn("z", K.normalise(F.array(F.lit(0.0), F.lit(0.0))))
    return n.select("n_nationkey", r6(F.col("x")[0]).alias("a"), r6(F.col("x")[1]).alias("b"), F.col("z")[0].alias("c"))


@query(f"WITH {_LONG}, e AS (SELECT i, j, exp((v - max(v) OVER (PARTITION BY j)) / 20000) AS v FROM m) SELECT i, j, round(v / sum(v) OVER (PARTITION BY j), 6) AS v FROM e")
def softmax(spark: SparkSession, d: str) -> DataFrame:
    return frames.softmax(_long(spark, d), ["j"], prefactor=20000.0).withColumn("v", r6("v"))


@query("SELECT n_nationkey, round(1 / (1 + exp((3 - n_nationkey) / 2.0)), 6) AS a, round(1 / (1 + exp((n_nationkey - 3) / 2.0)), 6) AS b FROM nation")
def softmax_vec(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").withColumn("x", K.softmax(F.array(F.col("n_nationkey").cast("double"), F.lit(3.0)), 2.0))
    return n.select("n_nationkey", r6(F.col("x")[0]).alias("a"), r6(F.col("x")[1]).alias("b"))


@query(f"SELECT s_suppkey, round(exp(-({_P} * {LOG.format(_P)} + (1 - {_P}) * {LOG.format('1 - ' + _P)})), 6) AS v, 1.0::DOUBLE AS one, 0.0::DOUBLE AS none FROM supplier")
def effective_dimension(spark: SparkSession, d: str) -> DataFrame:
    p = F.abs("s_acctbal") / 20000
    return table(spark, d, "supplier").select("s_suppkey", r6(K.effective_dimension(F.array(p, 1 - p))).alias("v"), K.effective_dimension(F.array(F.lit(7.0))).alias("one"), K.effective_dimension(F.array().cast("array<double>")).alias("none"))


_U = "((('0x' || substr(md5(concat('{}:{}:', {})), 1, 12))::BIGINT + 0.5) / 281474976710656)"


@query(f"SELECT o_orderkey, round({_U.format(7, 'u', 'o_orderkey')}, 6) AS u FROM orders")
def get_rng(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", r6(K.hash_uniform(7, "u", "o_orderkey")).alias("u"))


_EFF = f"(1.0 / 6 + (1 - 1.0 / 6) / pow(1 + exp(-{K.BETA} * (ln({{}}) - ({K.GAMMA}))), {K.ALPHA}))"


@query(f"SELECT n_nationkey, round(6 * {_EFF.format('((n_nationkey + 1) / 10.0)')}, 6) AS v FROM nation")
def get_eff(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", r6(K.get_eff((F.col("n_nationkey") + 1) / 10.0, 6)).alias("v"))


_F = "((n_nationkey + 1) / 5.0 / 6)"  # n_nationkey 4 is the boundary 1 / D itself, where the strength is the smallest


@query(f"SELECT n_nationkey, CASE WHEN n_nationkey <= 4 THEN 0.0 WHEN {_F} >= 1 THEN -1.0 ELSE round(exp({K.GAMMA} - ln(pow((1 - 1.0 / 6) / ({_F} - 1.0 / 6), 1 / {K.ALPHA}) - 1) / {K.BETA}), 6) END AS v FROM nation")
def get_eps(spark: SparkSession, d: str) -> DataFrame:
    eps = K.get_eps((F.col("n_nationkey") + 1) / 5.0, 6)
    return table(spark, d, "nation").select("n_nationkey", F.when(eps == float("inf"), -1.0).otherwise(r6(eps)).alias("v"))


# ---------------------------------------------------------------------------------------- transformers

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_MM = "s AS (SELECT " + ", ".join(f"min({c}) AS a{n}, max({c}) AS b{n}" for n, c in enumerate(LINE, 1)) + " FROM lineitem)"
_BASE = _MM + ", f AS (SELECT " + ", ".join(f"({c} - a{n}) / (b{n} - a{n}) AS x{n}" for n, c in enumerate(LINE, 1)) + ", l_returnflag AS y, l_quantity AS w FROM lineitem, s)"


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(min({c}), 6) AS lo, round(max({c}), 6) AS hi FROM lineitem" for c in LINE))
def minmax_fit(spark: SparkSession, d: str) -> DataFrame:
    return MinMaxScaler.fit_plan(table(spark, d, "lineitem"), LINE).select("feature", r6("min").alias("lo"), r6("max").alias("hi"))


QUERIES["minmax_params"], ORACLES["minmax_params"] = minmax_fit, ORACLES["minmax_fit"]


def _scaled(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(*LINE, "l_returnflag")
    return MinMaxScaler().fit(lines, LINE).transform(lines.withColumn("w", F.col("l_quantity")), carry=["l_returnflag", "w"]).withColumnsRenamed({c: f"x{n}" for n, c in enumerate(LINE, 1)} | {"l_returnflag": "y"})


_PAIR = ["c_acctbal", "c_nationkey"]


@query("SELECT c_custkey, " + ", ".join(f"round(2 * ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())::DOUBLE - 1, 6) AS x{n}" for n, c in enumerate(_PAIR, 1)) + " FROM customer")
def minmax_transform(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", *_PAIR)
    out = MinMaxScaler((-1.0, 1.0)).fit(rows, _PAIR).transform(rows, carry=["c_custkey"])
    return out.select("c_custkey", *(r6(c).alias(f"x{n}") for n, c in enumerate(_PAIR, 1)))


@query("SELECT o_orderkey, round(o_totalprice, 4) AS v FROM orders")
def minmax_inverse(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    scaler = MinMaxScaler((-1.0, 1.0)).fit(rows, ["o_totalprice"])
    return scaler.inverse_transform(scaler.transform(rows, carry=["o_orderkey"]), carry=["o_orderkey"]).select("o_orderkey", F.round("o_totalprice", 4).alias("v"))


_KNOTS = "k AS (SELECT v, row_number() OVER (ORDER BY v) AS rank, count(*) OVER () AS n FROM (SELECT DISTINCT c_acctbal AS v FROM customer))"


def _fitted(spark: SparkSession, d: str) -> QuantileTransformer:
    return QuantileTransformer().fit(table(spark, d, "customer"), ["c_acctbal"])


@query(f"WITH {_KNOTS} SELECT 'c_acctbal' AS feature, rank, round(v, 6) AS value FROM k")
def quantile_fit(spark: SparkSession, d: str) -> DataFrame:
    return _fitted(spark, d).knots.select("feature", "rank", r6("value").alias("value"))


QUERIES["quantile_params"], ORACLES["quantile_params"] = quantile_fit, ORACLES["quantile_fit"]


@query(f"WITH {_KNOTS} SELECT c_custkey, round((rank - 1) / (n - 1.0), 6) AS p FROM customer JOIN k ON v = c_acctbal")
def quantile_transform(spark: SparkSession, d: str) -> DataFrame:
    return _fitted(spark, d).transform(table(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_custkey"]).select("c_custkey", r6("c_acctbal").alias("p"))


@query(
    f"""WITH {_KNOTS}, q AS (SELECT s_suppkey, s_acctbal AS x, (SELECT max(v) FROM k WHERE v <= s_acctbal) AS lo, (SELECT min(v) FROM k WHERE v >= s_acctbal) AS hi FROM supplier)
    SELECT s_suppkey, round(CASE WHEN q.lo IS NULL THEN 0.0 WHEN q.hi IS NULL THEN 1.0 WHEN q.lo = q.hi THEN (a.rank - 1) / (a.n - 1.0) ELSE (a.rank - 1 + (x - q.lo) / (q.hi - q.lo)) / (a.n - 1.0) END, 6) AS p
    FROM q LEFT JOIN k a ON a.v = q.lo"""
)
def quantile_interp(spark: SparkSession, d: str) -> DataFrame:
    new = melt(table(spark, d, "supplier").withColumnRenamed("s_acctbal", "c_acctbal"), ["s_suppkey"], ["c_acctbal"])
    return _fitted(spark, d).transform_long(new).select("s_suppkey", r6("v").alias("p"))


@query("SELECT s_suppkey, 0.5::DOUBLE AS p FROM supplier")
def quantile_empty(spark: SparkSession, d: str) -> DataFrame:
    none = QuantileTransformer().fit(table(spark, d, "supplier").filter("s_acctbal is null"), ["s_acctbal"])
    return none.transform_long(melt(table(spark, d, "supplier"), ["s_suppkey"], ["s_acctbal"])).select("s_suppkey", F.col("v").alias("p"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN 0.0 WHEN n_nationkey = 5 THEN 0.5 ELSE 1.0 END::DOUBLE AS p FROM nation")
def quantile_single(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    one = QuantileTransformer().fit(nation.filter("n_nationkey = 5"), ["n_nationkey"])
    return one.transform_long(melt(nation, ["n_nationkey"], ["n_nationkey"]).withColumn("n_nationkey", F.col("n_nationkey"))).select("n_nationkey", F.col("v").alias("p"))


@query(
    f"""WITH {_KNOTS}, q AS (SELECT n_nationkey, n_nationkey / 20.0 AS p FROM nation), a AS (SELECT n_nationkey, least(1.0, greatest(0.0, p)) * ((SELECT max(n) FROM k) - 1) + 1 AS pos FROM q)
    SELECT n_nationkey, round(lo.v + (pos - floor(pos)) * (hi.v - lo.v), 6) AS v FROM a JOIN k lo ON lo.rank = floor(pos) JOIN k hi ON hi.rank = ceil(pos)"""
)
def quantile_inverse(spark: SparkSession, d: str) -> DataFrame:
    long = table(spark, d, "nation").select("n_nationkey", F.lit("c_acctbal").alias("feature"), (F.col("n_nationkey") / 20.0).alias("v"))
    return _fitted(spark, d).inverse_long(long).select("n_nationkey", r6("v").alias("v"))


# ------------------------------------------------------------------------------------- labels and weights


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def selectrows(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").withColumnRenamed("c_custkey", "o_custkey")
    return prep.select_rows(table(spark, d, "orders"), keys, ["o_custkey"]).select("o_orderkey")


@query("SELECT o_orderkey, round(1e4 * o_totalprice / (SELECT sum(o_totalprice) FROM orders), 6) AS w FROM orders")
def format_weights(spark: SparkSession, d: str) -> DataFrame:
    return prep.normalised_weights(table(spark, d, "orders"), "o_totalprice").select("o_orderkey", r6(1e4 * F.col("w")).alias("w"))


_PI = ("5-LOW", "1-URGENT", "none")


@query("SELECT o_orderkey, " + ", ".join(f"(o_orderpriority = '{c}')::DOUBLE AS p{n}" for n, c in enumerate(_PI)) + " FROM orders")
def get_pi(spark: SparkSession, d: str) -> DataFrame:
    pi = table(spark, d, "orders").withColumn("p", prep.one_hot_label("o_orderpriority", list(_PI)))
    return pi.select("o_orderkey", *(F.col("p")[n].alias(f"p{n}") for n in range(len(_PI))))


# ------------------------------------------------------------------------ training steps, of a fixed model

X, CLASSES, EPS_C, EPS_W = ["x1", "x2", "x3", "x4"], ["A", "N", "R"], 0.01, 0.1
CENTROIDS = [[0.2, 0.3, 0.5, 0.4], [0.7, 0.6, 0.3, 0.5], [0.5, 0.2, 0.8, 0.6]]
IMPORTANCES = [0.4, 0.3, 0.2, 0.1]
PROBABILITIES = [[0.5, 0.3, 0.2], [0.2, 0.5, 0.3], [0.3, 0.2, 0.5]]


def _fixed() -> steps.Parameters:
    return steps.Parameters(X, CLASSES, CENTROIDS, IMPORTANCES, PROBABILITIES)


def _assigned(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    lines = _scaled(spark, d)
    rows = lines.count()
    return steps.assign(lines, _fixed(), EPS_C, rows, "y", F.lit(1.0 / rows)), rows


def _params_sql(name: str) -> str:
    cols = [f"{v}::DOUBLE AS c{k}_{d}" for k, c in enumerate(CENTROIDS, 1) for d, v in enumerate(c, 1)]
    cols += [f"{v}::DOUBLE AS w_{d}" for d, v in enumerate(IMPORTANCES, 1)]
    cols += [f"{v}::DOUBLE AS l{k}_{m}" for k, row in enumerate(PROBABILITIES, 1) for m, v in enumerate(row, 1)]
    return f"{name} AS (SELECT {', '.join(cols)})"


def _own(k_to_value) -> str:
    return "CASE k " + " ".join(f"WHEN {k} THEN {k_to_value(k)}" for k in (1, 2, 3)) + " END"


def _label(k: int) -> str:
    return "CASE y " + " ".join(f"WHEN '{c}' THEN {LOG.format(f'l{k}_{m}')}" for m, c in enumerate(CLASSES, 1)) + " END"


def _assign_sql(name: str, p: str, eps_c: float = EPS_C) -> str:
    far = [" + ".join(f"w_{d} * (x{d} - c{k}_{d}) * (x{d} - c{k}_{d})" for d in range(1, 5)) + f" - {eps_c} * ({_label(k)})" for k in (1, 2, 3)]
    return f"{name} AS (SELECT *, CASE WHEN d1 <= d2 AND d1 <= d3 THEN 1 WHEN d2 <= d3 THEN 2 ELSE 3 END AS k FROM (SELECT f.*, {p}.*, " + ", ".join(f"{x} AS d{k}" for k, x in enumerate(far, 1)) + f" FROM f, {p}))"


def _step_sql(i: int) -> str:
    """One iteration: p{i} to p{i+1} by way of g{i}, and loss{i+1}."""
    q = [f"avg(({_own(lambda k, d=d: f'x{d} - c{k}_{d}')}) * ({_own(lambda k, d=d: f'x{d} - c{k}_{d}')})) AS q{d}" for d in range(1, 5)]
    c = [f"avg(x{d}) FILTER (k = {k}) AS c{k}_{d}" for k in (1, 2, 3) for d in range(1, 5)]
    n = [f"(count(*) FILTER (k = {k} AND y = '{y}'))::DOUBLE / count(*) FILTER (k = {k}) AS l{k}_{m}" for k in (1, 2, 3) for m, y in enumerate(CLASSES, 1)]
    e = [f"exp((least(q1, q2, q3, q4) - q{d}) / {EPS_W}) AS e{d}" for d in range(1, 5)]
    new = [x.split(" AS ")[1] for x in c + n]
    w = [f"e{d} / (e1 + e2 + e3 + e4) AS w_{d}" for d in range(1, 5)]
    far = " + ".join(f"p.w_{d} * ({_own(lambda k, d=d: f'g.x{d} - p.c{k}_{d}')}) * ({_own(lambda k, d=d: f'g.x{d} - p.c{k}_{d}')})" for d in range(1, 5))
    told = _own(lambda k: "CASE y " + " ".join(f"WHEN '{y}' THEN {LOG.format(f'p.l{k}_{m}')}" for m, y in enumerate(CLASSES, 1)) + " END")
    h = " + ".join(f"w_{d} * {LOG.format(f'w_{d}')}" for d in range(1, 5))
    return f"""{_assign_sql(f"g{i}", f"p{i}")}, s{i} AS (SELECT {", ".join(q + c + n)} FROM g{i}), e{i} AS (SELECT *, {", ".join(e)} FROM s{i}), p{i + 1} AS (SELECT {", ".join(new + w)} FROM e{i}),
    loss{i + 1} AS (SELECT avg({far} - {EPS_C} * ({told})) + {EPS_W} * (SELECT {h} FROM p{i + 1}) AS loss FROM g{i} g, p{i + 1} p)"""


_FIX = f"WITH {_BASE}, {_params_sql('p0')}, {_assign_sql('g', 'p0')} "
_TWO = f"WITH {_BASE}, {_params_sql('p0')}, {_step_sql(0)}, {_step_sql(1)} "


# lineitem has no key: rows are told apart by their feature values.
_ROW = ", ".join(f"round(x{n}, 6) AS x{n}" for n in range(1, 5))


def _by_row(df: DataFrame, *more) -> DataFrame:
    return df.groupBy(*(r6(x).alias(x) for x in X), "y", "k", *more).agg(F.count("*").alias("n"))


@query(_FIX + f"SELECT {_ROW}, y, k::INT AS k, count(*) AS n FROM g GROUP BY ALL")
def update_G(spark: SparkSession, d: str) -> DataFrame:
    return _by_row(_assigned(spark, d)[0])


@query("SELECT y, l FROM (SELECT l_returnflag AS y, round(count(*) / (SELECT count(*) FROM lineitem)::DOUBLE, 6) AS l FROM lineitem GROUP BY 1)")
def init_priors(spark: SparkSession, d: str) -> DataFrame:
    return steps.priors(table(spark, d, "lineitem"), "l_returnflag", CLASSES).select(F.col("class").alias("y"), r6("l").alias("l"))


@query(f"SELECT k, count(*) AS n FROM (SELECT (floor({_U.format(0, 'cluster', 'o_orderkey')} * 4) + 1)::INT AS k FROM orders) GROUP BY k")
def init_affiliation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").withColumn("k", F.floor(K.hash_uniform(0, "cluster", "o_orderkey") * 4).cast("int") + 1).groupBy("k").agg(F.count("*").alias("n"))


@query(f"SELECT round(o_totalprice, 6) AS v FROM orders ORDER BY {_U.format(0, 'seed', 'o_orderkey')} LIMIT 3")
def init_centroids_random(spark: SparkSession, d: str) -> DataFrame:
    seeds = EspaClassifier(kpp_init=False)._seeds_random(table(spark, d, "orders"), _one(), ["o_orderkey"])
    return spark.createDataFrame([(round(float(s[0]), 6),) for s in seeds], "v double")


def _one() -> steps.Parameters:
    return steps.Parameters(["o_totalprice"], ["O"], [[0.0]] * 3, [1.0], [[1.0]] * 3)


@query(
    f"""WITH a AS (SELECT arg_min(o_totalprice, {_U.format(0, 'seed0', 'o_orderkey')}) AS v FROM orders),
    b AS (SELECT arg_min(o_totalprice, -ln({_U.format(0, 'seed1', 'o_orderkey')}) / pow(o_totalprice - a.v, 2)) AS v FROM orders, a WHERE o_totalprice <> a.v),
    c AS (SELECT arg_min(o_totalprice, -ln({_U.format(0, 'seed2', 'o_orderkey')}) / least(pow(o_totalprice - a.v, 2), pow(o_totalprice - b.v, 2))) AS v FROM orders, a, b WHERE o_totalprice <> a.v AND o_totalprice <> b.v)
    SELECT round(v, 6) AS v FROM (SELECT v FROM a UNION ALL SELECT v FROM b UNION ALL SELECT v FROM c)"""
)
def init_centroids_kpp(spark: SparkSession, d: str) -> DataFrame:
    seeds = EspaClassifier()._seeds_kpp(table(spark, d, "orders"), _one(), ["o_orderkey"])
    return spark.createDataFrame([(round(float(s[0]), 6),) for s in seeds], "v double")


_GAPS = "(SELECT CASE WHEN l_linenumber % 3 = 1 THEN 2 WHEN l_linenumber % 3 = 2 THEN 4 ELSE 5 END AS k FROM lineitem)"


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.when(F.col("l_linenumber") % 3 == 1, 2).when(F.col("l_linenumber") % 3 == 2, 4).otherwise(5).alias("k"))


@query(f"SELECT k::INT AS k, count(*) AS n, (row_number() OVER (ORDER BY k))::INT AS new_k FROM {_GAPS} GROUP BY k")
def find_empty(spark: SparkSession, d: str) -> DataFrame:
    return steps.nonempty(_gaps(spark, d), 5)


@query(f"SELECT (row_number() OVER (ORDER BY k))::INT AS k, count(*) AS n FROM {_GAPS} t GROUP BY t.k")
def remove_empty(spark: SparkSession, d: str) -> DataFrame:
    return steps.drop_empty(_gaps(spark, d), 5).groupBy("k").agg(F.count("*").alias("n"))


@query(f"WITH {_BASE}, {_params_sql('p0')}, {_step_sql(0)} SELECT unnest(['x1', 'x2', 'x3', 'x4']) AS feature, unnest([round(w_1, 6), round(w_2, 6), round(w_3, 6), round(w_4, 6)]) AS w FROM p1")
def update_W(spark: SparkSession, d: str) -> DataFrame:
    g, rows = _assigned(spark, d)
    return steps.update_importances(g, _fixed(), F.lit(1.0 / rows), EPS_W).select("feature", r6("w").alias("w"))


@query(_FIX + "SELECT k::INT AS k, " + ", ".join(f"round(sum(w * x{d}) / sum(w), 6) AS x{d}" for d in range(1, 5)) + " FROM g GROUP BY k")
def update_C(spark: SparkSession, d: str) -> DataFrame:
    c = steps.update_centroids(_assigned(spark, d)[0], _fixed(), F.col("w"))
    return c.select("k", *(r6(x).alias(x) for x in X))


@query(_FIX + "SELECT k::INT AS k, y, round(count(*) / sum(count(*)) OVER (PARTITION BY k), 6)::DOUBLE AS l FROM g GROUP BY k, y")
def update_L(spark: SparkSession, d: str) -> DataFrame:
    return steps.update_probabilities(_assigned(spark, d)[0], "y", CLASSES).select("k", F.col("class").alias("y"), r6("l").alias("l"))


_H = -sum(w * math.log(w) for w in IMPORTANCES)


@query(_FIX + f"SELECT round(avg({_own(lambda k: f'd{k}')}) - {EPS_W * _H!r}, 6) AS loss FROM g")
def calc_loss(spark: SparkSession, d: str) -> DataFrame:
    g, rows = _assigned(spark, d)
    return steps.loss(g, _fixed(), "y", F.lit(1.0 / rows), rows, EPS_C, EPS_W).select(r6("loss").alias("loss"))


_BLIND = f"WITH {_BASE}, {_params_sql('p0')}, {_assign_sql('g', 'p0', 0.0)} "


@query(_BLIND + "SELECT k::INT AS k, count(*) AS n, " + ", ".join(f"round(avg({_own(lambda k, m=m: f'l{k}_{m}')}), 6) AS p{m}" for m in (1, 2, 3)) + " FROM g GROUP BY k")
def update_P(spark: SparkSession, d: str) -> DataFrame:
    p = steps.assign(_scaled(spark, d), _fixed()).withColumn("p", steps.class_distribution(_fixed()))
    return p.groupBy("k").agg(F.count("*").alias("n"), *(r6(F.avg(F.col("p")[m - 1])).alias(f"p{m}") for m in (1, 2, 3)))


@query(_BLIND + f"SELECT {_ROW}, y, k::INT AS k, count(*) AS n FROM g GROUP BY ALL")
def predict_core(spark: SparkSession, d: str) -> DataFrame:
    return _by_row(steps.assign(_scaled(spark, d), _fixed()))


@query(_BLIND + "SELECT k::INT AS k, y, round(count(*) / sum(count(*)) OVER (PARTITION BY k), 6)::DOUBLE AS l FROM g GROUP BY k, y")
def unbias(spark: SparkSession, d: str) -> DataFrame:
    """Label-blind clusters and their class shares, as after a fit."""
    blind = steps.assign(_scaled(spark, d), _fixed())
    return steps.update_probabilities(blind, "y", CLASSES).filter("l > 0").select("k", F.col("class").alias("y"), r6("l").alias("l"))


# ----------------------------------------------------------------------------------------- fitted models


def _two(spark: SparkSession, d: str, lowering: str = "arrow"):
    """Two iterations from the fixed centroids, importances and class priors replaced by the fixed probabilities."""
    lines = _scaled(spark, d).select(*X, "y")
    rows = lines.count()
    settings = EspaClassifier(eps_c=EPS_C, eps_w=EPS_W, max_iter=2, unbias=False, lowering=lowering, verbosity=0)
    return settings._train(lines, _fixed(), "y", None, rows, 0.0, 2, {})


@query(_TWO + "SELECT 1 AS iteration, round(loss, 6) AS loss FROM loss1 UNION ALL SELECT 2, round(loss, 6) FROM loss2")
def fit_loop(spark: SparkSession, d: str) -> DataFrame:
    return _two(spark, d).training_losses(spark).select("iteration", r6("loss").alias("loss"))


@query(ORACLES["fit_loop"])
def training_losses(spark: SparkSession, d: str) -> DataFrame:
    return _two(spark, d, "expr").training_losses(spark).select("iteration", r6("loss").alias("loss"))


@query(_TWO + " UNION ALL ".join(f"SELECT {k} AS k, " + ", ".join(f"round(c{k}_{n}, 6) AS c{n}" for n in range(1, 5)) + ", " + ", ".join(f"round(l{k}_{m}, 6) AS l{m}" for m in (1, 2, 3)) + " FROM p2" for k in (1, 2, 3)))
def fitted_params(spark: SparkSession, d: str) -> DataFrame:
    p = _two(spark, d).fitted_params(spark)
    both = p["C"].join(p["L"], "k")
    return both.select("k", *(r6(F.col("c")[n - 1]).alias(f"c{n}") for n in range(1, 5)), *(r6(F.col("l")[m - 1]).alias(f"l{m}") for m in (1, 2, 3)))


@query("SELECT DISTINCT l_returnflag AS y FROM lineitem WHERE l_returnflag <> 'A'")
def classes_seen(spark: SparkSession, d: str) -> DataFrame:
    """Of the declared classes those that the rows of a fit have: A is declared, but its rows are left out."""
    lines = _scaled(spark, d).select(*X, "y").filter("y <> 'A'")
    report = EspaClassifier(eps_c=EPS_C, eps_w=EPS_W, max_iter=1, verbosity=0, initial=_START).fit(lines, X, "y", X, classes=CLASSES).report
    return spark.createDataFrame([(y,) for y in report.classes_seen], "y string")


@query(_TWO + "SELECT unnest(['x1', 'x2', 'x3', 'x4']) AS feature, unnest([" + ", ".join(f"round(1 - exp(-4 * w_{n}), 6)" for n in range(1, 5)) + "]) AS importance FROM p2")
def feature_importances(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(k, round(v, 6)) for k, v in _two(spark, d).feature_importances().items()], "feature string, importance double")


@query(_TWO + "SELECT round(exp(-(" + " + ".join(f"w_{n} * {LOG.format(f'w_{n}')}" for n in range(1, 5)) + ")) * 4 + 2 * 3, 6) AS n FROM p2")
def model_n_params(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(round(n_params(_two(spark, d).parameters), 6),)], "n double")


QUERIES["n_params"], ORACLES["n_params"] = QUERIES.pop("model_n_params"), ORACLES.pop("model_n_params")
_LAST = _TWO + f", {_assign_sql('h', 'p2', 0.0)} "


@query(_LAST + f"SELECT {_ROW}, y, k::INT AS k, " + ", ".join(f"round({_own(lambda k, m=m: f'l{k}_{m}')}, 6) AS p{m}" for m in (1, 2, 3)) + ", count(*) AS n FROM h GROUP BY ALL")
def predict(spark: SparkSession, d: str) -> DataFrame:
    out = _two(spark, d).predict(_scaled(spark, d))
    return _by_row(out, *(r6(F.col("probabilities")[m - 1]).alias(f"p{m}") for m in (1, 2, 3)))


@query(_LAST + ", b AS (SELECT y, CASE WHEN a >= b AND a >= c THEN 'A' WHEN b >= c THEN 'N' ELSE 'R' END AS prediction FROM (SELECT y, " + ", ".join(f"{_own(lambda k, m=m: f'l{k}_{m}')} AS {n}" for m, n in ((1, "a"), (2, "b"), (3, "c"))) + " FROM h)) SELECT y, prediction, count(*) AS n FROM b GROUP BY ALL")
def predict_mode(spark: SparkSession, d: str) -> DataFrame:
    return _two(spark, d).predict_mode(_scaled(spark, d)).groupBy("y", "prediction").agg(F.count("*").alias("n"))


DOC_X = ["letters", "variety", "size"]


def _documents(spark: SparkSession, d: str) -> DataFrame:
    docs = document_features(spark, d)
    return MinMaxScaler().fit(docs, DOC_X).transform(docs, carry=["doc_id", "quality"])


# A fit from given centroids and importances starts with the class frequencies as every cluster's probabilities.
_START = {"centroids": CENTROIDS, "importances": IMPORTANCES}
_PRIOR = "p0 AS (SELECT " + ", ".join([f"{v}::DOUBLE AS c{k}_{n}" for k, c in enumerate(CENTROIDS, 1) for n, v in enumerate(c, 1)] + [f"{v}::DOUBLE AS w_{n}" for n, v in enumerate(IMPORTANCES, 1)] + [f"avg((y = '{y}')::INT) AS l{k}_{m}" for k in (1, 2, 3) for m, y in enumerate(CLASSES, 1)]) + " FROM f)"


@query(
    f"WITH {_BASE}, {_PRIOR}, {_step_sql(0)}, {_assign_sql('h', 'p1', 0.0)} SELECT k::INT AS k, "
    + ", ".join(f"round(any_value(CASE k WHEN 1 THEN c1_{n} WHEN 2 THEN c2_{n} ELSE c3_{n} END), 6) AS c{n}" for n in range(1, 5))
    + ", " + ", ".join(f"round(avg((y = '{y}')::INT), 6) AS l{m}" for m, y in enumerate(CLASSES, 1)) + " FROM h GROUP BY k"
)
def fit(spark: SparkSession, d: str) -> DataFrame:
    """A fit that converges after one iteration and is then unbiased: centroids and class probabilities."""
    settings = EspaClassifier(eps_c=EPS_C, eps_w=EPS_W, max_iter=5, tol=1e3, verbosity=0, initial=_START)
    p = settings.fit(_scaled(spark, d).select(*X, "y"), X, "y", X).fitted_params(spark)
    return p["C"].join(p["L"], "k").select("k", *(r6(F.col("c")[n - 1]).alias(f"c{n}") for n in range(1, 5)), *(r6(F.col("l")[m - 1]).alias(f"l{m}") for m in (1, 2, 3)))


@query(f"WITH {_BASE}, {_PRIOR}, {_step_sql(0)}, {_step_sql(1)} SELECT 1 AS iteration, round(loss, 6) AS loss FROM loss1 UNION ALL SELECT 2, round(loss, 6) FROM loss2")
def update(spark: SparkSession, d: str) -> DataFrame:
    """A fit of one iteration continued by another: the losses of both."""
    settings, lines = EspaClassifier(eps_c=EPS_C, eps_w=EPS_W, max_iter=1, tol=1e-12, verbosity=0, unbias=False, initial=_START), _scaled(spark, d).select(*X, "y")
    model = settings.update(settings.fit(lines, X, "y", X), lines, "y", X, extra_iter=1)
    return model.training_losses(spark).select("iteration", r6("loss").alias("loss"))


@query(
    f"""WITH v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), c AS (SELECT vec_id + 1 AS k, d, x AS c FROM v WHERE vec_id < 5),
    f AS (SELECT vec_id, k, sum((x - c) * (x - c)) AS far FROM v JOIN c USING (d) GROUP BY vec_id, k), g AS (SELECT vec_id, arg_min(k, (far, k)) AS k FROM f GROUP BY vec_id),
    q AS (SELECT d, avg((x - c) * (x - c)) AS q FROM v JOIN g USING (vec_id) JOIN c USING (k, d) GROUP BY d), e AS (SELECT d, exp((min(q) OVER () - q) / {EPS_W}) AS e FROM q), w AS (SELECT d, e / sum(e) OVER () AS w FROM e),
    c1 AS (SELECT k, d, avg(x) AS c FROM v JOIN g USING (vec_id) GROUP BY k, d), f1 AS (SELECT vec_id, any_value(label) AS label, k, sum(w * (x - c) * (x - c)) AS far FROM v JOIN c1 USING (d) JOIN w USING (d) GROUP BY vec_id, k)
    SELECT vec_id, arg_min(k, (far, k))::INT AS k FROM f1 GROUP BY vec_id"""
)
def fit_vectors(spark: SparkSession, d: str) -> DataFrame:
    """A fit on an array column (64 features, 10 classes) of one iteration from five given rows: each row's cluster."""
    vectors = table(spark, d, "embeddings")
    start = [r["embedding"] for r in vectors.filter("vec_id < 5").orderBy("vec_id").collect()]  # the five seeds
    width = len(start[0])
    settings = EspaClassifier(clusters=5, eps_c=EPS_C, eps_w=EPS_W, max_iter=1, verbosity=0, initial={"centroids": start, "importances": [1 / width] * width})
    return settings.fit(vectors, "embedding", "label", ["vec_id"]).predict(vectors).select("vec_id", "k")


_VECTORS = "SELECT 'embedding_' || d AS feature, label, x / nullif(stddev_pop(x) OVER (PARTITION BY d), 0) AS v, vec_id AS id FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings)"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    p = EspaClassifier(max_iter=5, verbosity=0).fit(docs, DOC_X, "quality", ["doc_id"]).fitted_params(spark)
    return p["C"].join(p["L"], "k")


# -------------------------------------------------------------------------------------- mutual information


def _psi(n: str) -> str:
    h, cases = 0.0, []
    for k in range(1, 10):
        cases.append(f"WHEN {n} = {k} THEN {h - 0.5772156649015329!r}")
        h += 1 / k
    x = f"({n})::DOUBLE"
    return f"(CASE {' '.join(cases)} ELSE ln({x}) - 1 / (2 * {x}) - 1 / (12 * pow({x}, 2)) + 1 / (120 * pow({x}, 4)) - 1 / (252 * pow({x}, 6)) END)"


def _mi_sql(values: str) -> str:
    """The pairwise form: every row against every other."""
    return f"""WITH t AS ({values}), s AS (SELECT *, count(*) OVER (PARTITION BY feature, label) AS n_c FROM t), r AS (SELECT * FROM s WHERE n_c > 1),
    d AS (SELECT a.feature, a.id, a.label, a.v, a.n_c, least(3, a.n_c - 1) AS k, abs(a.v - b.v) AS gap, row_number() OVER (PARTITION BY a.feature, a.id ORDER BY abs(a.v - b.v)) AS place FROM r a JOIN r b ON a.feature = b.feature AND a.label = b.label AND a.id <> b.id),
    q AS (SELECT feature, id, label, v, n_c, k, gap AS radius FROM d WHERE place = k),
    m AS (SELECT q.feature, q.id, any_value(q.n_c) AS n_c, any_value(q.k) AS k, count(*) AS m FROM q JOIN r b ON b.feature = q.feature AND (CASE WHEN radius > {EPS} THEN abs(b.v - q.v) < radius * (1 - 1e-11) ELSE abs(b.v - q.v) <= {EPS} END) GROUP BY q.feature, q.id)
    SELECT feature, round(greatest(0.0, {_psi('count(*)')} + avg({_psi('k')}) - avg({_psi('n_c')}) - avg({_psi('m')})), 5) AS mi FROM m GROUP BY feature"""


@query(_mi_sql("SELECT 'c_acctbal' AS feature, c_mktsegment AS label, c_acctbal AS v, c_custkey AS id FROM customer"))
def mi_cd(spark: SparkSession, d: str) -> DataFrame:
    long = table(spark, d, "customer").select(F.lit("c_acctbal").alias("feature"), F.col("c_mktsegment").alias("label"), F.col("c_acctbal").alias("v"), F.col("c_custkey").alias("id"))
    return mutual_information(long).select("feature", F.round("mi", 5).alias("mi"))


def _per_sd(c: str) -> str:
    return f"SELECT '{c}' AS feature, c_mktsegment AS label, {c} / (SELECT stddev_pop({c}) FROM customer) AS v, c_custkey AS id FROM customer"


@query(_mi_sql(_per_sd("c_acctbal")))
def mi_feature(spark: SparkSession, d: str) -> DataFrame:
    return feature_information(table(spark, d, "customer"), ["c_acctbal"], "c_mktsegment", ["c_custkey"]).select("feature", F.round("mi", 5).alias("mi"))


@query(_mi_sql(_per_sd("c_acctbal") + " UNION ALL " + _per_sd("c_nationkey")))
def mi_matrix(spark: SparkSession, d: str) -> DataFrame:
    return feature_information(table(spark, d, "customer"), ["c_acctbal", "c_nationkey"], "c_mktsegment", ["c_custkey"]).select("feature", F.round("mi", 5).alias("mi"))


@query(f"SELECT feature, round(CASE WHEN s <= {EPS} THEN 0.5 ELSE mi / s END, 3) AS w FROM (SELECT *, sum(mi) OVER () AS s FROM ({ORACLES['mi_matrix'].replace(', 5) AS mi', ', 12) AS mi')}))")
def init_weights(spark: SparkSession, d: str) -> DataFrame:
    mi = feature_information(table(spark, d, "customer"), ["c_acctbal", "c_nationkey"], "c_mktsegment", ["c_custkey"])
    every = Window.partitionBy()  # a row for each feature
    return mi.select("feature", F.round(K.share(F.col("mi"), F.sum("mi").over(every), F.count("*").over(every)), 3).alias("w"))


@query(_mi_sql(_VECTORS))
def mi_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The places of an array column, all at once."""
    return feature_information(table(spark, d, "embeddings"), "embedding", "label").select("feature", F.round("mi", 5).alias("mi"))
