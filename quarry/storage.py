"""Tables written between the steps of an iterative plan."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session, or where that is unset, in local mode only, one of our own.
    On a cluster a folder of one machine would be lost to the others, so there it must be set."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("quarry.shared.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("quarry.shared.dir", at)
    return at.rstrip("/") if "://" in at or at.startswith("hdfs:") else "file://" + at.rstrip("/")


#: Bytes of values of a side that is broadcast.
LIGHT = 16 << 20


def light(df: DataFrame, name: str = "t") -> DataFrame:
    """saved, and broadcast to what it is joined with if its values, as text, are LIGHT bytes at most."""
    df = saved(df, name)
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))).first()[0] or 0
    return F.broadcast(df) if size <= LIGHT else df


def saved(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes df's rows to the shared folder and reads them back: lineage ends there."""
    path = f"{shared(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
