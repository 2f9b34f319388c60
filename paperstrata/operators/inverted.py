"""A stored inverted index with block bounds: BM25 search that reads the posting blocks that can matter and no other.

Layout. Documents belong to segments by the hash of their id, SEGMENT_DOCS each; large segments are dealt to parts by another
hash, so that each is the work of many tasks. In a part documents are numbered by length, so that short ones, which score high,
stand together. Every RANGE_DOCS numbers are a range, and a posting block holds the postings of one term in one range: each
document's place in the range, term counts, and for each term count the least length, from which the block's highest possible
score follows exactly, whatever the average length has become. Ids and lengths are kept once a range, in the block of the empty
term. Ranges are the same for all terms, so bounds of terms add up by an aggregation. A task of a write has whole parts and writes
their blocks to a file of its own, in order of term, so that a search reads a term's pages of each file, and blocks are never shuffled.

Search. (1) Bounds of the terms' blocks are read without postings and added up per range. (2) The ranges of the highest bounds
are scored; the k-th best score so far is a threshold that no hit of the final list can miss. (3) Ranges whose bound reaches it
are scored, all others are never read. Hits and scores equal those of ``search.bm25``.

Versions. ``update`` writes the segments that hold changed documents anew, as a generation of blocks, and then one row a segment
that says which generation counts; a run that dies before that leaves the old state, and the next one writes over its blocks. Blocks
of older generations are passed over.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from ..session import ship, table
from . import search as S
from .tree import checkpoint_folder, staged

SEGMENT_DOCS, RANGE_DOCS = 1 << 16, 128
#: About how many characters, and documents, one task of a write takes, and into how many parts as much of one segment is dealt.
TASK_CHARS, TASK_DOCS, TASK_PARTS = 12_000_000, 50_000, 4
#: Of the block with a range's documents; no word is empty.
DOCUMENTS = ""
#: Blocks that go from Python to Spark at once.
BATCH = 20_000


@dataclass
class Hits:
    """``hits``: id, score, best first. The blocks that the query's terms have, and how many of them were read."""

    hits: DataFrame
    blocks: int
    blocks_read: int
    threshold: float


def counts_of(words: Column) -> Column:
    """term, tf and len (the number of all words) of each distinct word: words are sorted, and where a run of equal ones begins
    and the next one does, its length follows."""

    def runs(ordered: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
        each = F.element_at(F.transform(F.array(begins), lambda b: F.transform(b, lambda at, i: F.struct(F.get(ordered, at).alias("term"), (F.coalesce(F.get(b, i + 1), F.size(ordered)) - at).alias("tf"), F.size(ordered).alias("len")))), 1)
        return F.when(F.size(ordered) > 0, each)

    # transform over one value, so that it is worked out once a row
    return F.element_at(F.transform(F.array(F.sort_array(words)), runs), 1)


def _first(*sorted_by: np.ndarray) -> np.ndarray:
    """Where a run of rows that are equal in all of these begins."""
    new = np.ones(len(sorted_by[0]), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in sorted_by])
    return np.flatnonzero(new)


def _structs(begins: np.ndarray, total: int, **fields) -> pa.Array:
    """Lists of structs, each from one of ``begins`` to the next."""
    return pa.ListArray.from_arrays(pa.array(np.append(begins, total).astype(np.int32)), pa.StructArray.from_arrays([pa.array(x) for x in fields.values()], names=list(fields)))


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of a task's documents (segment, range, at, id, field, len and the sorted words of each), in order of term, field,
    segment and range. Words are held as codes, those of one batch excepted."""
    rows, codes, of, tfs, known, size, count = [], [], [], [], [], 0, 0
    for batch in batches:
        lists = pc.split_pattern(batch.column("words"), " ")
        coded = lists.flatten().dictionary_encode()
        code, row = coded.indices.to_numpy(), np.repeat(np.arange(len(lists), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
        begins = _first(code, row)
        tf = np.diff(np.append(begins, len(code))).astype(np.int32)
        worded = batch.column("len").to_numpy()[row[begins]] > 0  # splitting nothing gives an empty word
        codes.append(code[begins][worded] + size)
        of.append(row[begins][worded] + count)
        tfs.append(tf[worded])
        known.append(coded.dictionary)
        rows.append(batch.select(["segment", "range", "at", "id", "field", "len"]))
        size, count = size + len(coded.dictionary), count + len(lists)
    if not count:
        return
    documents = pa.Table.from_batches(rows).combine_chunks()
    segment, range_, at, field, length = (documents[x].to_numpy() for x in ("segment", "range", "at", "field", "len"))
    by = np.lexsort((at, range_, segment, field))
    begins = _first(field[by], segment[by], range_[by])
    heads, group = by[begins], np.empty(count, np.int64)
    group[by] = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, count)))

    def given(terms, heads, n, **lists) -> Iterator[pa.RecordBatch]:
        own = {"segment": segment[heads], "range": range_[heads], "field": field[heads], "term": terms, "n": n.astype(np.int32)}
        kinds = {"levels": ("tf", "len"), "postings": ("at", "tf")}
        null = {k: pa.nulls(len(heads), pa.list_(pa.struct([(x, pa.int32()) for x in names]))) for k, names in kinds.items()} | {"docs": pa.nulls(len(heads), pa.list_(pa.struct([("id", documents["id"].type), ("len", pa.int32())])))}
        yield from pa.table(own | null | lists).to_batches(max_chunksize=BATCH)

    ids = documents["id"].combine_chunks().take(pa.array(by))
    yield from given(pa.array([DOCUMENTS] * len(heads)), heads, np.diff(np.append(begins, count)), docs=_structs(begins, count, id=ids, len=length[by]))
    every = pa.concat_arrays(known).dictionary_encode()
    order = pc.sort_indices(every.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    term, of, tf = place[every.indices.to_numpy()][np.concatenate(codes)], np.concatenate(of), np.concatenate(tfs)
    if not len(of):
        return
    key = term * len(heads) + group[of]
    by = np.lexsort((at[of], key))
    key, of, tf = key[by], of[by], tf[by]
    begins = _first(key)
    n = np.diff(np.append(begins, len(key)))
    block, long = np.repeat(np.arange(len(begins), dtype=np.int32), n), length[of]
    by = np.lexsort((long, tf, block))
    least = by[_first(block[by], tf[by])]  # of each block and term count the shortest
    levels = _structs(_first(block[least]), len(least), tf=tf[least], len=long[least])
    terms = every.dictionary.take(order).take(pa.array(key[begins] // len(heads)))
    yield from given(terms, heads[key[begins] % len(heads)], n, levels=levels, postings=_structs(begins, len(key), at=at[of], tf=tf))


class InvertedIndex:
    """An index at ``path``. Ids shall be unique and not null; null texts have no words."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = ship(spark), path.rstrip("/")
        (said,) = spark.read.text(f"{self.path}/about").first()
        about = json.loads(said)
        self.id, self.fields, self.segments, self.range_docs = about["id"], about["fields"], about["segments"], about["range_docs"]
        self.written = f"segment int, range int, field int, term string, n int, levels array<struct<tf: int, len: int>>, postings array<struct<at: int, tf: int>>, docs array<struct<id: {about['id_type']}, len: int>>"
        self.schema = f"{self.written}, generation int"

    @classmethod
    def build(cls, units: DataFrame, id_col: str, fields: list[str], path: str, segment_docs: int = SEGMENT_DOCS, range_docs: int = RANGE_DOCS) -> InvertedIndex:
        spark, segments = units.sparkSession, max(1, math.ceil(units.count() / segment_docs))
        about = {"id": id_col, "fields": fields, "id_type": dict(units.dtypes)[id_col], "segments": segments, "range_docs": range_docs}
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path.rstrip('/')}/about")
        index = cls(spark, path)
        index._write(units, None, 0)
        return index

    def _segment(self, id: Column) -> Column:
        return F.pmod(F.xxhash64(id.cast("string")), F.lit(self.segments)).cast("int")

    def _write(self, units: DataFrame, which: DataFrame | None, generation: int) -> None:
        """Writes the segments ``which`` (none: all) from ``units``, which has all their documents. The only rows that are shuffled
        are a document's words, sorted, where repeated ones compress to little; they are counted where they arrive."""
        own = units.select(F.col(self.id).alias("id"), self._segment(F.col(self.id)).alias("segment"), F.array(*(F.coalesce(F.col(f), F.lit("")) for f in self.fields)).alias("texts"))
        own = own if which is None else self._among(own, which)
        n, chars = own.agg(F.count(F.lit(1)), F.sum(F.aggregate("texts", F.lit(0), lambda k, t: k + F.length(t)))).first()
        tasks, segments = max((chars or 0) / TASK_CHARS, n / TASK_DOCS), self.segments if which is None else which.count()
        parts = max(1, math.ceil(TASK_PARTS * tasks / max(segments, 1)))
        # transform over one value, so that it is worked out once a row
        sort = lambda t: F.element_at(F.transform(F.array(T.tokens(t)), lambda w: F.struct(F.size(w).alias("len"), F.array_join(F.sort_array(w), " ").alias("words"))), 1)
        part = F.pmod(F.xxhash64(F.lit("part"), F.col("id").cast("string")), F.lit(parts)).cast("int").alias("part")
        dealt = own.select("segment", part, "id", F.transform("texts", sort).alias("texts")).repartition(math.ceil(tasks) + 1, "segment", "part")
        # a window per part, which is bounded
        length = F.aggregate("texts", F.lit(0), lambda k, t: k + t["len"])
        rank = F.row_number().over(W.partitionBy("segment", "part").orderBy(length, "id")) - 1
        ranges = ((F.col("rank") / self.range_docs).cast("int") * parts + F.col("part")).alias("range")
        placed = dealt.withColumn("rank", rank).select("segment", ranges, (F.col("rank") % self.range_docs).alias("at"), "id", F.posexplode("texts").alias("field", "text")).select("segment", "range", "at", "id", "field", "text.*")
        # a part lies in one partition: its terms are grouped where they are
        at = f"{self.path}/blocks/generation={generation}"
        placed.mapInArrow(_blocks_of, self.written).write.mode("overwrite").option("compression", "zstd").parquet(at)
        lens = self.spark.read.schema(self.written).parquet(at).filter(F.col("term") == DOCUMENTS).select("segment", "field", "n", F.aggregate("docs", F.lit(0).cast("long"), lambda k, x: k + x["len"]).alias("words"))
        of = lambda i, what: F.sum(F.when(F.col("field") == i, F.col(what)).otherwise(0))
        sizes = lens.groupBy("segment").agg(of(0, "n").alias("n"), *(of(i, "words").alias(f"sum{i}") for i in range(len(self.fields))))
        which = self.spark.range(self.segments).select(F.col("id").cast("int").alias("segment")) if which is None else which
        rows = which.join(sizes, "segment", "left").select("segment", F.lit(generation).alias("generation"), *(F.coalesce(c, F.lit(0)).alias(c) for c in sizes.columns[1:]))
        rows.write.mode("append").parquet(f"{self.path}/segments")

    @staticmethod
    def _among(own: DataFrame, which: DataFrame) -> DataFrame:
        """Rows of the segments ``which``, found by a bit a segment, so that texts aren't shuffled for it."""
        word, bit = F.floor(F.col("segment") / 64).alias("word"), F.pmod(F.col("segment"), F.lit(64))
        bits = which.groupBy(word).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
        return own.join(F.broadcast(bits), F.floor(own["segment"] / 64) == bits["word"]).filter(F.getbit("bits", bit) == 1).select(own.columns)

    def _live(self) -> DataFrame:
        """The newest row of each segment."""
        rows = self.spark.read.parquet(f"{self.path}/segments")
        return rows.groupBy("segment").agg(F.max(F.struct("generation", *rows.columns[2:])).alias("at")).select("segment", "at.*")

    def update(self, units: DataFrame, changed: DataFrame) -> int:
        """Brings the index to ``units``, which differ from the indexed ones in the ids ``changed`` only (new, altered or gone).
        Returns how many segments were written."""
        which = staged(changed.select(self._segment(F.col(self.id)).alias("segment")).distinct())
        newest = self._live().agg(F.max("generation")).first()[0]
        self._write(units, which, newest + 1)
        return which.count()

    def _blocks(self, terms: list[str]) -> DataFrame:
        blocks = self.spark.read.schema(self.schema).parquet(f"{self.path}/blocks").filter(F.col("term").isin(terms))
        return blocks.join(self._live().select("segment", "generation"), ["segment", "generation"])

    def search(self, query: str, k: int, boosts: dict[str, float] | None = None) -> Hits:
        """The best ``k`` documents for the words of ``query``, ties by id. boosts: weight by field, 1 where not given."""
        terms = sorted(set(T.words(query)))
        empty = self.spark.createDataFrame([], self.schema).select(F.explode("docs").alias("d")).select(F.col("d.id").alias(self.id), F.lit(0.0).alias("score"))
        if not terms:
            return Hits(empty, 0, 0, 0.0)
        sums = self._live().agg(F.sum("n"), *(F.sum(f"sum{i}") for i in range(len(self.fields)))).first()
        n, averages = sums[0] or 0, [(s or 0) / sums[0] if sums[0] else 0.0 for s in sums[1:]]
        blocks = self._blocks(terms)
        known = {(r.field, r.term): r for r in blocks.groupBy("field", "term").agg(F.sum("n").alias("df"), F.count(F.lit(1)).alias("blocks")).collect()}  # a row per field and term
        if not known:
            return Hits(empty, 0, 0, 0.0)
        weights = {key: (boosts or {}).get(self.fields[key[0]], 1.0) * math.log(1 + (n - r.df + 0.5) / (r.df + 0.5)) for key, r in known.items()}
        weight = F.element_at(F.create_map(*(F.lit(x) for (f, t), w in weights.items() for x in (f"{f} {t}", w))), F.concat_ws(" ", F.col("field").cast("string"), "term"))
        average = F.get(F.array(*(F.lit(float(a)) for a in averages)), F.col("field"))

        def part(tf: Column, length: Column) -> Column:
            return weight * tf * (S.K1 + 1) / (tf + S.K1 * (1 - S.B + S.B * length / average))

        bound = F.array_max(F.transform("levels", lambda x: part(x["tf"].cast("double"), x["len"])))
        ranges = blocks.groupBy("segment", "range").agg(F.sum(bound).alias("bound"), F.count(F.lit(1)).alias("blocks"))

        documents = self._blocks([DOCUMENTS]).select("segment", "range", "field", "docs")

        def scored(where: DataFrame) -> DataFrame:
            postings = blocks.join(where.select("segment", "range"), ["segment", "range"], "left_semi").select("segment", "range", "field", "term", "postings")
            found = postings.join(documents, ["segment", "range", "field"]).select("field", "term", F.explode(F.transform("postings", lambda p: F.struct(p["tf"].alias("tf"), F.get("docs", p["at"]).alias("doc")))).alias("p"))
            scores = found.select(F.col("p.doc.id").alias(self.id), part(F.col("p.tf").cast("double"), F.col("p.doc.len")).alias("part"))
            return scores.groupBy(self.id).agg(F.round(F.sum("part"), 6).alias("score")).filter("score > 0")

        # with one term each of these ranges has a document that reaches its bound, so the threshold is the best there is
        first = scored(ranges.orderBy(F.desc("bound"), "segment", "range").limit(k + 8))
        best = [r.score for r in first.orderBy(F.desc("score")).limit(k).collect()]
        threshold = best[-1] if len(best) == k else 0.0
        left = ranges.filter(F.col("bound") >= threshold - 1e-6)
        read = left.agg(F.sum("blocks")).first()[0]
        return Hits(S.top(scored(left), self.id, k), sum(r.blocks for r in known.values()), read, threshold)


def _documents(spark, d, path=None, **sizes):
    """The index of documents at the test tables, in the checkpoint folder."""
    return InvertedIndex.build(table(spark, d, "documents").select("doc_id", "text"), "doc_id", ["text"], path or f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}", **sizes)


def search_indexed(spark, d):
    hits = _documents(spark, d).search(S.QUERY, 100).hits
    return S.ranked(hits, "doc_id", 100, "lexical_rank")


def search_indexed_boosted(spark, d):
    fields = table(spark, d, "documents").select("doc_id", F.substring("text", 1, 60).alias("title"), F.substring("text", 61, 120).alias("description"), "text")
    index = InvertedIndex.build(fields, "doc_id", ["title", "description", "text"], f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}", segment_docs=500)
    return index.search(S.QUERY, 50, {"title": 4.0, "description": 2.0}).hits


def search_index_updated(spark, d):
    """Indexed with the texts of one language reversed, then updated to the real ones, by segments of 64 documents."""
    docs, swapped = table(spark, d, "documents").select("doc_id", "text", "lang"), F.col("lang") == "de"
    old = docs.withColumn("text", F.when(swapped, F.reverse("text")).otherwise(F.col("text")))
    index = InvertedIndex.build(old, "doc_id", ["text"], f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}", segment_docs=64)
    index.update(docs, docs.filter(swapped))
    return S.ranked(index.search(S.QUERY, 100).hits, "doc_id", 100, "lexical_rank")


QUERIES = {
    "search_indexed": (search_indexed, S._LEX_TOP),
    "search_indexed_boosted": (search_indexed_boosted, S.QUERIES["search_lexical_boosted"][1]),
    "search_index_updated": (search_index_updated, S._LEX_TOP),
}
