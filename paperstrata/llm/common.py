"""What the corpus operators share: text rules, staged tables in the cluster's shared folder, and bounded broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The six characters that separate words: \x20 and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"
SPACES_RE = "[\\x20\\x09-\\x0D]+"

_roots: dict[str, str] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def text_of(col: str | Column) -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z and no other letter. ``lower`` does the same to pure ASCII text and is several times faster."""
    return F.when(F.char_length(col) == F.octet_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, UPPER.lower()))


def strip_spaces(col: Column) -> Column:
    return F.btrim(col, F.lit(SPACES))


def words_of(col: Column) -> Column:
    """The maximal runs of characters other than ``SPACES``, in order."""
    stripped = strip_spaces(col)
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, SPACES_RE))


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Internal column names that don't clash with columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_root(spark: SparkSession) -> str:
    """The folder for staged tables: under spark.checkpoint.dir, which all executors share. Where that setting is absent, a
    temporary folder takes its place on one machine, and on a cluster it is an error, since executors wouldn't see each
    other's files. The folder goes when the driver's Python ends."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not base:
            base = f"file://{tempfile.mkdtemp(prefix='stages-')}"
        _roots[app] = f"{base.rstrip('/')}/stages-{app}"
        atexit.register(_drop, spark, _roots[app])
    return _roots[app]


def _drop(spark: SparkSession, path: str) -> None:
    """Removes a staged table or the whole folder. A session that has ended already can't; its folder is then left to the
    cluster's own clean-up."""
    if spark.sparkContext._jsc is None:
        return
    with contextlib.suppress(OSError, Py4JError):  # the JVM may be gone
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Stage:
    """A table written to the shared folder. It cuts lineage: after a lost executor, readers go back to these files."""

    def __init__(self, df: DataFrame):
        self.spark, self.path = df.sparkSession, f"{shared_root(df.sparkSession)}/{uuid.uuid4().hex}"
        self.schema = df.schema
        df.write.parquet(self.path)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        _drop(self.spark, self.path)


def stage(df: DataFrame) -> DataFrame:
    return Stage(df).df


def small(df: DataFrame, rows: int) -> bool:
    """Whether ``df``, a staged or otherwise cheap table, has at most so many rows."""
    return df.count() <= rows


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has been counted to have at most ``rows`` rows, else for a shuffled join."""
    return F.broadcast(df) if small(df, rows) else df.hint("shuffle_merge")


def beside(rows: DataFrame, table: DataFrame, key: str, table_key: str, most: int, also: Column | None = None) -> DataFrame:
    """``rows`` joined with a staged ``table`` on equal keys, null meeting null (and on ``also``):
    broadcast if counted to have at most ``most`` rows."""
    on = rows[key].eqNullSafe(F.col(table_key))
    return rows.join(maybe_broadcast(table, most), on if also is None else on & also)


#: A key with at least this share of all rows is hot; there are at most so many hot keys, whatever the input.
HOT_SHARE = 4096


def join_by_weight(rows: DataFrame, table: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has each key once and in ``weight`` about how many rows have it (not null).

    Hot keys, those with 1/HOT_SHARE of the total weight or more, are broadcast: at most HOT_SHARE rows. The others, whose
    groups are bounded by that share, are joined by shuffle. ``table`` should be staged, since it is read three times.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    least = max(2, total / HOT_SHARE)
    hot, cold = table.filter(F.col(weight) >= least), table.filter(F.col(weight) < least)
    if not hot.limit(1).count():
        return rows.join(cold.hint("shuffle_merge"), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold.hint("shuffle_merge"), keys))
