"""Shared plumbing: the shared work folder, written stages, bounded batches and hashing."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes (8 a field, strings and arrays as long as they are) up to which a staged table is broadcast; beyond, a shuffle join.
BROADCAST_BYTES = 16 << 20
#: Stands for a null doc_id inside numpy arrays; below every real id.
NULL_ID = -(2**63)

_MINE: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares: spark.checkpoint.dir. Unset, a local master (tests) gets a temporary one; a cluster is an error."""
    conf = spark.sparkContext.getConf()
    if named := conf.get("spark.checkpoint.dir"):
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", conf.get("spark.master", "")):
        raise ValueError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _MINE:
        _MINE[app] = tempfile.mkdtemp(prefix="entroflow-")
        atexit.register(shutil.rmtree, _MINE[app], ignore_errors=True)
    return _MINE[app]


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/entroflow/{spark.sparkContext.applicationId}"


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{_own_folder(spark)}/{uuid.uuid4().hex}/{name}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and reread it: cuts lineage, survives lost executors."""
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_stages(spark: SparkSession) -> None:
    """Delete what this application has staged, once the results that rest on it are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fits(df: DataFrame) -> bool:
    """Whether a staged table's measured bytes are under the bound for a broadcast."""
    parts = [F.lit(8 * len(df.columns))]
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType | T.BinaryType):
            parts.append(F.coalesce(F.octet_length(col(f.name)), F.lit(0)))
        elif isinstance(f.dataType, T.ArrayType):
            parts.append(16 * F.coalesce(F.size(col(f.name)), F.lit(0)))
    measured = df.agg(F.sum(sum(parts[1:], parts[0]).cast("long"))).first()[0] or 0
    return measured <= BROADCAST_BYTES


def small(df: DataFrame) -> DataFrame:
    """Mark a staged table for broadcast if its measured bytes are under the bound, else leave it to a shuffle join."""
    return F.broadcast(df) if fits(df) else df


def col(name: str) -> Column:
    """A column by name, whatever letters the name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that `df` doesn't have, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def handing_back(run: Callable) -> Callable:
    """A function over Arrow batches that, at its end, gives free memory back: Python workers live on between stages."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return own


def map_batches(df: DataFrame, run: Callable, fields: str) -> DataFrame:
    """df.mapInArrow(run) for a function that adds fields (as DDL) at the end; columns may have any names."""
    more = T.StructType.fromDDL(fields).fields
    plain = df.toDF(*(c if c.isidentifier() else fresh(df, f"_c{k}")[0] for k, c in enumerate(df.columns)))  # mapInArrow looks columns up by name
    return plain.mapInArrow(handing_back(run), T.StructType([*plain.schema.fields, *more])).toDF(*df.columns, *(f.name for f in more))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about `most` bytes of `column`, and one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths) // most
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).fill_null(b"").to_pylist()


def as_text(column: pa.Array) -> list[str]:
    return column.fill_null("").to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def docs_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns whose names an operator is about to add, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select([col(c) for c in df.columns if c.lower() not in taken])


def hot_join(left: DataFrame, facts: DataFrame, key: list[str], count: str) -> DataFrame:
    """Inner join of staged tables on `key`, which `facts` holds once, with `count`, the rows of `left` that have it.

    Keys of more than a thousandth of all those rows (so fewer than a thousand keys) are joined by a broadcast, wherever
    their rows are; the others are shuffled without them. A small table of facts is broadcast whole. `count` is dropped.
    """
    if fits(facts):
        return left.join(F.broadcast(facts.drop(count)), key)
    total = facts.agg(F.sum(count)).first()[0] or 0
    bound = max(100, int(total) // 1000)
    hot, cold = facts.filter(F.col(count) > bound).drop(count), facts.filter(F.col(count) <= bound).drop(count)
    hot = F.broadcast(hot)  # fewer than a thousand rows, or rows of a table of fewer than 100,000
    return left.join(hot, key).unionByName(left.join(hot, key, "left_anti").join(cold, key))
