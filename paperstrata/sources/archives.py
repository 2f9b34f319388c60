"""Zip archives as tables: entries of many archives, and archives made of rows.

An archive is one row of Spark's binary source and is unpacked by one task, entry by entry; many archives are many tasks. Archives
that are made have their entries in order of path and the same bytes whenever they are made again. A row holds at most 2 GB.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import safe_entries

#: The earliest date that an archive can hold; entries have it as theirs.
EPOCH = (1980, 1, 1, 0, 0, 0)
BATCH_BYTES = 16 << 20


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.binary())], ["archive", "path", "content"])

    for batch in batches:
        for name, data in zip(batch.column("archive").to_pylist(), batch.column("content").to_pylist(), strict=True):
            rows, held = [], 0
            with zipfile.ZipFile(io.BytesIO(data)) as archive:
                for path in sorted(safe_entries(archive)):
                    rows.append((name, path, archive.read(path)))
                    held += len(rows[-1][2])
                    if held > BATCH_BYTES:
                        yield made(rows)
                        rows, held = [], 0
            yield made(rows)


def unpacked(archives: DataFrame) -> DataFrame:
    """archive, path, content: a row per file in archives (archive, content). A broken archive, a wrong checksum, or an entry that is
    repeated, absolute, upward or a link fails the read."""
    return archives.select("archive", "content").mapInArrow(_unpack, "archive string, path string, content binary")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The entries of all zip files at ``path``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(path)
    return unpacked(found.select(F.col("path").alias("archive"), "content"))


def _pack(group: pa.Table) -> pa.Table:
    out, names = io.BytesIO(), group.column("path").to_pylist()
    if len(set(names)) < len(names):
        raise ValueError("a path is repeated in an archive")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for i in sorted(range(len(names)), key=names.__getitem__):
            archive.writestr(zipfile.ZipInfo(names[i], EPOCH), group.column("content")[i].as_buffer().to_pybytes(), zipfile.ZIP_DEFLATED)
        safe_entries(archive)
    return pa.table({"archive": group.column("archive")[:1], "entries": pa.array([len(names)], pa.int32()), "content": pa.array([out.getvalue()], pa.binary())})


def packed(files: DataFrame) -> DataFrame:
    """archive, entries, content: an archive of all files (archive, path, content) with its name. An archive is made by one task, so
    callers name archives such that each stays below 2 GB."""
    return files.select("archive", "path", "content").groupBy("archive").applyInArrow(_pack, "archive string, entries int, content binary")


def archive_name(id: Column, files: int) -> Column:
    """Names of archives of at most ``files`` consecutive ids."""
    return F.concat(F.lit("part-"), F.floor(id / files).cast("string"), F.lit(".zip"))
