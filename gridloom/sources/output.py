"""Output of a run: groups of records that grow, and the run's attributes."""

from __future__ import annotations

import importlib.metadata
import socket
import time
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def get_versions(packages: Iterable[str] = ("pyspark", "numpy", "pyarrow", "pandas")) -> dict[str, str]:
    """Versions of the packages a run depends on; "absent" for those that aren't there."""
    out = {}
    for p in packages:
        try:
            out[p] = importlib.metadata.version(p)
        except importlib.metadata.PackageNotFoundError:
            out[p] = "absent"
    return out


class OutputFile:
    """A folder with a Parquet table for each group, to which records are appended, and a table of attributes.

    A name that is taken gets the time appended. Attributes keep the host, versions, ``runfile``'s text and any more
    keywords as strings.
    """

    def __init__(self, spark: SparkSession, folder: str, name: str | None = None, runfile: str | None = None, **attrs: Any):
        self.spark = spark
        stem = name or time.strftime("%Y-%m-%d-%H%M%S")
        path = f"{folder.rstrip('/')}/{stem}"
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            path += time.strftime("-%Y-%m-%d-%H%M%S") + f"-{time.time_ns() % 1_000_000}"
        self.path = path
        values = {"hostname": socket.gethostname(), **{f"version_{k}": v for k, v in get_versions().items()}, **attrs}
        if runfile:
            with open(runfile) as f:
                values["runfile"] = f.read()
        spark.createDataFrame([(k, str(v)) for k, v in values.items()], "name string, value string").coalesce(1).write.parquet(f"{path}/attributes")
        self.columns: dict[str, list[str]] = {}

    def output(self, group: str, data: DataFrame | None = None, **values: Any) -> None:
        """Append one record of keyword values, or all rows of ``data``, to a group; every record has the columns of the first."""
        if data is None:
            names = sorted(values)
            data = self.spark.createDataFrame([tuple(values[n] for n in names)], names).coalesce(1)
        known = self.columns.setdefault(group, sorted(data.columns))
        if sorted(data.columns) != known:
            raise ValueError(f"group {group} has columns {known}, not {sorted(data.columns)}")
        data.select(*known).write.mode("append").parquet(f"{self.path}/{group}")

    def read(self, group: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{group}")
