"""A stored vector index: cells by k-means, residuals as product codes, exact scores for the best candidates.

Fit. Cells and code books are fitted on at most SAMPLE_ROWS vectors (those of the smallest id hashes), and so is the number of cells to
look into: the least one with which the sample's own searches reach the wanted recall. Every vector is then assigned and
stored, with its code, by cell.

Search. A query looks into the cells nearest to it. There, codes give approximate scores by table look-ups; the best of each
cell meet per query, and the best RESCORE * k of those get their exact cosine. Cells are cut into chunks of CHUNK_ROWS by id
hash and queries into blocks, so neither a cell with a large share of all vectors nor a long list of queries lands in one task.

Vectors that are null, of length zero, or of another dimension than the first have no cosine: they are stored and never found.
"""

from __future__ import annotations

import base64
import io
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import TASK_ROWS, table
from . import search as S
from .tree import checkpoint_folder

SAMPLE_ROWS, CHUNK_ROWS, QUERY_ROWS, RESCORE = 16_384, 65_536, 2_048, 4
BOOKS, CODES, ROUNDS = 16, 256, 12
#: Rows with vectors that a task sorts at once, about 1 KB each.
VECTOR_ROWS = 50_000
#: Scores that an exact search holds at once, of 8 bytes, besides its vectors.
SCORES = 1 << 20


def unit(rows: list, dimension: int) -> np.ndarray:
    """Rows of length one; rows that have no direction are zero."""
    out = np.zeros((len(rows), dimension), np.float32)
    for i, row in enumerate(rows):
        if row is not None and len(row) == dimension and None not in row:
            out[i] = row
    norms = np.linalg.norm(out.astype(np.float64), axis=1, keepdims=True)
    with np.errstate(all="ignore"):
        return np.where((norms > 0) & np.isfinite(norms), out / norms, 0).astype(np.float32)


def kmeans(points: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """Lloyd's rounds from distinct points; an empty cluster keeps its centre."""
    rng = np.random.default_rng(seed)
    centres = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(ROUNDS):
        near = nearest(points, centres)
        sums, counts = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, points)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres).astype(np.float32)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    if not len(points):
        return np.zeros(0, np.int64)
    half = (centres**2).sum(1) / 2
    return np.concatenate([(part @ centres.T - half).argmax(1) for part in np.array_split(points, math.ceil(len(points) / 4096))])


class Model:
    """Cells, code books and probes."""

    def __init__(self, cells: np.ndarray, books: list[np.ndarray], probes: int):
        self.cells, self.books, self.probes = cells, books, probes
        self.parts = np.array_split(np.arange(cells.shape[1]), len(books))

    @classmethod
    def fit(cls, sample: np.ndarray, recall: float, k: int) -> Model:
        cells = kmeans(sample, max(1, min(len(sample), round(math.sqrt(len(sample)) * 2))))
        rest = sample - cells[nearest(sample, cells)]
        parts = np.array_split(np.arange(sample.shape[1]), min(BOOKS, sample.shape[1]))
        model = cls(cells, [kmeans(rest[:, p], min(CODES, len(sample))) for p in parts], len(cells))
        model.probes = model._fewest(sample, recall, k)
        return model

    def _fewest(self, sample: np.ndarray, recall: float, k: int) -> int:
        """The fewest cells with which a part of the sample finds so much of its nearest ones in all the sample."""
        asked, own = sample[:: max(1, len(sample) // 512)], nearest(sample, self.cells)
        k = min(k, len(sample))
        best = np.argpartition(-(asked @ sample.T), k - 1, axis=1)[:, :k]
        order = np.argsort(-self.order(asked), axis=1)
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :].repeat(len(order), 0), 1)
        needed = np.take_along_axis(rank, own[best], 1)  # how far down its list of cells a query has to go for each hit
        return int(np.quantile(needed, recall, method="higher")) + 1

    def order(self, points: np.ndarray) -> np.ndarray:
        """How near each cell is, the nearest largest."""
        return points @ self.cells.T - (self.cells**2).sum(1) / 2

    def encode(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = nearest(points, self.cells)
        rest = points - self.cells[cell]
        return cell, np.stack([nearest(rest[:, p], b) for p, b in zip(self.parts, self.books, strict=True)], 1).astype(np.uint8)

    def scores(self, query: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        out = np.full(len(codes), query @ self.cells[cell], np.float32)
        for i, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            out += (b @ query[p])[codes[:, i]]
        return out

    def dumps(self) -> str:
        out = io.BytesIO()
        np.savez(out, cells=self.cells, probes=self.probes, **{f"book{i}": b for i, b in enumerate(self.books)})
        return base64.b64encode(out.getvalue()).decode()

    @classmethod
    def loads(cls, text: str) -> Model:
        data = np.load(io.BytesIO(base64.b64decode(text)))
        return cls(data["cells"], [data[f"book{i}"] for i in range(len(data.files) - 2)], int(data["probes"]))


def _assign(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            points = unit(batch.column("embedding").to_pylist(), model.cells.shape[1])
            cell, codes = model.encode(points)
            cell = np.where((points == 0).all(1), -1, cell)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("embedding"), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "embedding", "cell", "code"])

    return batches


def _probe(model: Model, probes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            points = unit(batch.column("embedding").to_pylist(), model.cells.shape[1])
            cells = np.argsort(-model.order(points), axis=1, kind="stable")[:, :probes]
            keep = np.flatnonzero((points != 0).any(1)).repeat(cells.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("qid").take(pa.array(keep)), pa.array(list(points[keep]), pa.list_(pa.float32())), pa.array(cells[(points != 0).any(1)].ravel(), pa.int32())], ["qid", "q", "cell"]
            )

    return batches


def _score(model: Model, most: int):
    def group(asked: pa.Table, held: pa.Table) -> pa.Table:
        """The best ``most`` of a chunk for each query that looks into it."""
        out = []
        if asked.num_rows and held.num_rows:
            codes = np.frombuffer(b"".join(held.column("code").to_pylist()), np.uint8).reshape(held.num_rows, -1)
            cell = held.column("cell")[0].as_py()
            for i, q in enumerate(np.asarray(asked.column("q").to_pylist(), np.float32)):
                scores = model.scores(q, cell, codes)
                best = np.argpartition(-scores, most - 1)[:most] if len(scores) > most else np.arange(len(scores))
                out.append(pa.table({"qid": pa.array([asked.column("qid")[i].as_py()] * len(best), asked.schema.field("qid").type), "id": held.column("id").take(pa.array(best)), "cell": pa.array([cell] * len(best), pa.int32()), "near": pa.array(scores[best])}))
        schema = pa.schema([("qid", asked.schema.field("qid").type), ("id", held.schema.field("id").type), ("cell", pa.int32()), ("near", pa.float32())])
        return pa.concat_tables(out).cast(schema) if out else schema.empty_table()

    return group


class VectorIndex:
    """An index at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.model = Model.loads(spark.read.text(f"{self.path}/model").first()[0])
        self.rows = spark.read.parquet(f"{self.path}/rows")
        self.cells = spark.read.parquet(f"{self.path}/cells")

    @classmethod
    def build(cls, vectors: DataFrame, id_col: str, embedding: str, path: str, recall: float = 0.97, k: int = 100) -> VectorIndex:
        """recall, k: what the number of probed cells is chosen for, on the sample."""
        spark, path = vectors.sparkSession, path.rstrip("/")
        own = vectors.select(F.col(id_col).alias("id"), F.col(embedding).cast("array<float>").alias("embedding"))
        told = [r.embedding for r in own.filter("size(embedding) > 0").orderBy(F.xxhash64("id")).limit(SAMPLE_ROWS).select("embedding").collect()]
        if not told:
            raise ValueError("there are no vectors to fit on")
        sample = unit(told, len(told[0]))
        model = Model.fit(sample[(sample != 0).any(1)], recall, k)
        kind = dict(own.dtypes)["id"]
        own.mapInArrow(_assign(model), f"id {kind}, embedding array<float>, cell int, code binary").repartition("cell", F.pmod(F.xxhash64("id"), F.lit(64))).sortWithinPartitions("cell").write.parquet(f"{path}/rows")
        spark.read.parquet(f"{path}/rows").groupBy("cell").agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.parquet(f"{path}/cells")
        spark.createDataFrame([(model.dumps(),)], "value string").coalesce(1).write.text(f"{path}/model")
        return cls(spark, path)

    def search(self, queries: DataFrame, k: int, probes: int | None = None, threshold: float | None = None) -> DataFrame:
        """qid, rank, id, score for ``queries`` (qid, embedding): the best ``k`` by cosine, ties by id, of the cells looked into.
        threshold: a least score, which holds before the limit."""
        probes, most = probes or self.model.probes, RESCORE * k
        qid, id_type = dict(queries.dtypes)["qid"], dict(self.rows.dtypes)["id"]
        asked = queries.select("qid", F.col("embedding").cast("array<float>").alias("embedding"))
        n_asked, stored = asked.count(), self.cells.agg(F.sum("n")).first()[0]
        # tasks for so many rows, and no fewer than the session asks for
        tasks = lambda rows, each: max(math.ceil(rows / each), int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        blocks = max(1, math.ceil(n_asked * probes / len(self.model.cells) / QUERY_ROWS))
        chunks = self.cells.select("cell", F.ceil(F.col("n") / CHUNK_ROWS).cast("int").alias("chunks"))
        looks = asked.mapInArrow(_probe(self.model, probes), f"qid {qid}, q array<float>, cell int").join(F.broadcast(chunks), "cell")  # a row per cell, whose number the fit bounds
        looks = looks.withColumns({"chunk": F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)), "block": F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")})
        held = self.rows.select("id", "cell", "code").join(F.broadcast(chunks), "cell").withColumns({"chunk": F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
        keys = ["cell", "chunk", "block"]
        groups = tasks(n_asked * probes + stored * blocks, VECTOR_ROWS)
        asking, held = looks.select("qid", "q", *keys).repartition(groups, *keys), held.select("id", "code", *keys).repartition(groups, *keys)
        near = asking.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(_score(self.model, most), f"qid {qid}, id {id_type}, cell int, near float")
        nth = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("near"), "id"))  # at most ``most`` rows a probed chunk
        # a query gets at most ``most`` rows from a chunk, and no more than its cells hold
        found = n_asked * min(stored, probes * min(most, math.ceil(stored / len(self.model.cells))))
        best = near.repartition(tasks(found, TASK_ROWS), "qid").withColumn("_nth", nth).filter(F.col("_nth") <= most).select("qid", "id", "cell")
        scored = tasks(n_asked * most, VECTOR_ROWS)
        pairs = best.repartition(scored, "cell", "id").join(self.rows.select("id", "cell", "embedding"), ["cell", "id"])
        pairs = pairs.repartition(scored, "qid").join(asked.withColumnRenamed("embedding", "q"), "qid")
        return _ranked(pairs.select("qid", "id", F.round(S.cosine(F.col("embedding"), F.col("q")), 5).alias("score")), k, threshold)


def _ranked(scored: DataFrame, k: int, threshold: float | None) -> DataFrame:
    scored = scored if threshold is None else scored.filter(F.col("score") >= threshold)
    place = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", place).filter(F.col("rank") <= k).select("qid", "rank", "id", "score")


def exact(vectors: DataFrame, queries: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """The same result by comparing each query (qid, embedding) with all vectors (id, embedding), queries in blocks of QUERY_ROWS:
    each partition of vectors keeps its best ``k`` of a block, so little is shuffled."""
    qid, id_type = dict(queries.dtypes)["qid"], dict(vectors.dtypes)["id"]
    numbered = queries.select("qid", F.col("embedding").cast("array<double>").alias("embedding"), F.pmod(F.xxhash64("qid"), F.lit(max(1, math.ceil(queries.count() / QUERY_ROWS)))).alias("block"))
    numbered = numbered.filter("size(embedding) > 0")
    out = None
    for (block,) in numbered.select("block").distinct().collect():
        asked = numbered.filter(F.col("block") == block).collect()
        ids, rows = [r.qid for r in asked], [r.embedding for r in asked]
        part = vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_compare(ids, rows, k, threshold), f"qid {qid}, id {id_type}, score double")
        out = part if out is None else out.unionByName(part)
    return _ranked(out if out is not None else vectors.sparkSession.createDataFrame([], f"qid {qid}, id {id_type}, score double"), k, threshold)


def _compare(ids: list, rows: list, k: int, threshold: float | None):
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = np.asarray(rows, np.float64)
        asked = asked / np.linalg.norm(asked, axis=1, keepdims=True)
        for batch in source:
            told = batch.column("embedding").to_pylist()
            fit = [i for i, row in enumerate(told) if row is not None and len(row) == asked.shape[1] and None not in row and any(row)]
            if not fit:
                continue
            held = np.asarray([told[i] for i in fit], np.float64)
            held = (held / np.linalg.norm(held, axis=1, keepdims=True)).T
            for at in range(0, len(ids), step := max(1, SCORES // len(fit))):
                some = asked[at : at + step]
                scores = np.round(some @ held, 5)
                least = np.partition(scores, len(fit) - k, axis=1)[:, len(fit) - k] if len(fit) > k else np.full(len(some), -np.inf)
                q, best = np.nonzero(scores >= np.maximum(least, -np.inf if threshold is None else threshold)[:, None])
                yield pa.RecordBatch.from_arrays([pa.array([ids[at + i] for i in q]), batch.column("id").take(pa.array(np.asarray(fit)[best])), pa.array(scores[q, best])], ["qid", "id", "score"])

    return batches


def _asked(spark, d):
    rows = table(spark, d, "embeddings")
    return rows.select(F.col("vec_id").alias("id"), "embedding"), rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding")


def search_vectors_exact(spark, d):
    vectors, queries = _asked(spark, d)
    return exact(vectors, queries, 100)


def search_vectors_indexed(spark, d):
    vectors, queries = _asked(spark, d)
    return VectorIndex.build(vectors, "id", "embedding", f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}").search(queries, 100)


QUERIES = {
    "search_vectors_exact": (
        search_vectors_exact,
        """SELECT qid, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
        SELECT q.vec_id AS qid, e.vec_id AS id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 5) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)) WHERE rank <= 100""",
    ),
    "search_vectors_indexed": (search_vectors_indexed, None),
}
