"""Cutting the lineage of iterated plans."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.session import shared_folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder, so an executor's loss costs no more than the step since."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
