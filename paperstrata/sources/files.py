"""Files as tables: discovery, strict CSV, text, JSON lines, cards, archives, content-addressed objects."""

from __future__ import annotations

import zipfile
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .csv_split import read_csv  # noqa: F401

CARD = "(?s)\\A---\\n(.*?)\\n---\\n?(.*)\\z"


def discover(spark: SparkSession, root: str, ignored: tuple[str, ...] = ()) -> DataFrame:
    """path (below root), sha256, byte_size, content of all files; hidden files and folders and ignored subtrees left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", f"^.*?{root.rstrip('/').replace('file:', '')}/", "")
    out = files.select(path.alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("byte_size"), "content").filter(~F.col("path").rlike("(^|/)\\."))
    for prefix in ignored:
        out = out.filter((F.col("path") != prefix) & ~F.col("path").startswith(f"{prefix}/"))
    return out


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """path and text of whole files, line ends as \\n."""
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.input_file_name().alias("path"), F.replace("value", F.lit("\r\n"), F.lit("\n")).alias("text"))


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool) -> DataFrame:
    """JSON lines; bad lines fail the read or are dropped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def card_parts(text: Column) -> tuple[Column, Column]:
    """Front matter and body of a node card. Only a line of three dashes ends the front matter."""
    return F.regexp_extract(text, CARD, 1), F.regexp_extract(text, CARD, 2)


def front_matter(text: str) -> dict:
    """The front matter as a dictionary. Needs PyYAML, where it is installed; repeated keys, aliases and tags are errors."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading front matter needs PyYAML") from e
    for event in yaml.parse(text):
        if isinstance(event, yaml.AliasEvent) or getattr(event, "anchor", None) or getattr(event, "tag", None):
            raise ValueError("aliases, anchors and tags are not allowed")
    node = yaml.compose(text)
    keys = [k.value for k, _ in node.value] if node else []
    if len(set(keys)) < len(keys):
        raise ValueError("repeated key")
    return yaml.safe_load(text) or {}


def safe_entries(archive: zipfile.ZipFile) -> list[str]:
    """File names of an archive; repeated, absolute, upward or symbolic-link entries are errors."""
    seen: set[str] = set()
    for info in archive.infolist():
        parts = PurePosixPath(info.filename).parts
        if info.filename in seen or info.filename.startswith("/") or ".." in parts or "\\" in info.filename or info.external_attr >> 28 == 0xA:
            raise ValueError(f"unsafe archive entry: {info.filename}")
        seen.add(info.filename)
    return [n for n in seen if not n.endswith("/")]


def object_path(sha256: Column) -> Column:
    return F.concat(F.lit("objects/sha256/"), F.substring(sha256, 1, 2), F.lit("/"), F.substring(sha256, 3, 2), F.lit("/"), sha256)


def safe_path(path: Column) -> Column:
    """Relative, without empty, ``.`` or ``..`` parts."""
    return (path != "") & ~path.startswith("/") & ~path.rlike("(^|/)(\\.{0,2})(/|$)")
