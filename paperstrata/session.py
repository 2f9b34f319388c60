"""Sessions and tables, and how this package reaches Python workers."""

from __future__ import annotations

import atexit
import importlib.metadata
import math
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows that a task sorts or groups at once.
TASK_ROWS = 250_000

_shipped: set[str] = set()


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings that results rely on: UTC, adaptive execution."""
    builder = SparkSession.builder.master(master).appName("paperstrata")
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.ui.enabled": "false"}
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the session's Python workers, once a session, unless they have it: because it is installed, or because
    its folder is on PYTHONPATH. Operators with Python steps need it there."""
    here = Path(__file__).resolve().parents[1]
    app = spark.sparkContext.applicationId
    if app in _shipped or str(here) in map(os.path.realpath, os.environ.get("PYTHONPATH", "").split(os.pathsep)):
        return spark
    _shipped.add(app)
    try:
        importlib.metadata.distribution("paperstrata")
    except importlib.metadata.PackageNotFoundError:
        folder = tempfile.mkdtemp(prefix="package-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/paperstrata", "zip", here, "paperstrata"))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, *keys: str, rows: int = TASK_ROWS) -> DataFrame:
    """``df`` dealt to tasks of about ``rows`` rows, by ``keys`` or, without any, evenly, so that what a task holds doesn't grow with the
    table, and a table in one small file is still the work of many tasks. ``df`` is counted, which for stored tables takes no scan. Windows,
    groups and joins on equal ``keys`` stay in these tasks."""
    n, most = df.count(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(1, math.ceil(n / rows), min(most, math.ceil(n / 10_000))), *keys)
