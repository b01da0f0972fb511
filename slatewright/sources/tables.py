"""Prepared tables in the shared folder of the session.

Positions and splits are computed once and written as parquet below the checkpoint
folder the cluster names; later jobs read columns and row groups they need.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from slatewright.session import ensure_checkpoint_dir

_written: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, source: str, name: str,
           build: Callable[[], DataFrame]) -> DataFrame:
    """``build()`` written once per application and source, read from then on."""
    key = (spark.sparkContext.applicationId, source, name)
    if key not in _written:
        digest = hashlib.md5(source.encode()).hexdigest()[:12]
        path = f"{ensure_checkpoint_dir(spark)}/prepared/{key[0]}/{digest}/{name}"
        build().write.mode("overwrite").parquet(path)
        _written[key] = path
    return spark.read.parquet(_written[key])
