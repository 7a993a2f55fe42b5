"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import sitepanel
from sitepanel.session import scratch_path

# Functions travel with their tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sitepanel)

#: No file beside the rows: without Hadoop's native library the driver would start a process to set each file's
#: mode, which for a moment counts all of the driver's memory once more.
UNMARKED = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}


def durable(df: DataFrame, **options: str) -> DataFrame:
    """``df`` written once as Parquet below the shared folder and read back.

    Lineage ends there, so a lost executor costs nothing that was written and
    several readers don't compute the frame again.  The folder may be emptied
    when the results that were built on it are no longer read.  ``options`` are the writer's.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "llm")
    df.write.options(**UNMARKED, **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("*",)))
