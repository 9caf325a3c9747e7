"""Cutting the lineage of a frame, by a reliable checkpoint."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A folder that all executors share: that which spark.checkpoint.dir names; where none is named, one of the warehouse, or in a local session a
    temporary one."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir")
    if not where:
        local = sc.master.startswith("local[") or sc.master == "local"
        where = tempfile.mkdtemp(prefix="verbatlas-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints-{uuid.uuid4().hex}"
    return where


def cut(df: DataFrame) -> DataFrame:
    """``df`` written in the shared folder, and read from there."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
