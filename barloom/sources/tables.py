"""Cutting the lineage of intermediate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder of ``spark.checkpoint.dir`` (the warehouse where that is unset), with its partitions and their order."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir"))
    return df.checkpoint(eager=True)
