"""Written tables between steps: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes up to which a written table is broadcast.
BROADCAST_BYTES = 16 << 20

_MINE: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share. Unset, a local master gets a temporary folder; a cluster is an error."""
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


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/entroflow/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """Mark a written table for broadcast if its measured bytes are under the bound, else leave it to a shuffle join."""
    sizes = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    measured = df.agg(F.sum(sum(sizes, F.lit(8 * len(df.columns))).cast("long"))).first()[0] or 0
    return F.broadcast(df) if measured <= BROADCAST_BYTES else df
