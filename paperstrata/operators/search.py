"""Retrieval: filters, grep, BM25, cosine, reciprocal rank fusion, rerank fusion, diversity, pages.

Scores over a corpus are column expressions inside the scan: query terms are counted in place, statistics are one partial
aggregate, so nothing is exploded or shuffled per token. Ranks are taken only after a top-k, so their window is small.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from ..session import table

K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Options:
    """A search request; out-of-range values are errors."""

    query: str
    mode: str = "hybrid"
    limit: int = 10
    candidate_limit: int = 100
    lexical_weight: float = 0.5
    semantic_weight: float = 1.0
    rrf_k: int = 60
    max_per_node: int = 3
    threshold: float | None = None
    cursor: str | None = None
    filters: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        checks = {
            "query": bool(self.query.strip()) and len(self.query) <= 1000,
            "mode": self.mode in ("lexical", "semantic", "hybrid"),
            "limit": 1 <= self.limit <= 50,
            "candidate_limit": 10 <= self.candidate_limit <= 500 and self.candidate_limit >= self.limit,
            "lexical_weight": 0 <= self.lexical_weight <= 10 and (self.mode == "semantic" or self.lexical_weight > 0),
            "semantic_weight": 0 <= self.semantic_weight <= 10 and (self.mode == "lexical" or self.semantic_weight > 0),
            "rrf_k": 1 <= self.rrf_k <= 200,
            "max_per_node": 1 <= self.max_per_node <= 10,
            "threshold": self.threshold is None or -1 <= self.threshold <= 1,
        }
        if bad := [name for name, ok in checks.items() if not ok]:
            raise ValueError(f"out of range: {', '.join(bad)}")

    def fingerprint(self) -> str:
        """Of all that decides the candidates: not the page size, not the position."""
        value = {k: v for k, v in asdict(self).items() if k not in ("cursor", "limit")}
        return hashlib.sha256(json.dumps(value, sort_keys=True).encode()).hexdigest()[:24]


def encode_cursor(package: str, options: Options, offset: int) -> str:
    return base64.urlsafe_b64encode(json.dumps({"v": 1, "package": package, "query": options.fingerprint(), "offset": offset}, separators=(",", ":")).encode()).decode().rstrip("=")


def cursor(package: Column, query: Column, offset: Column) -> Column:
    """The cursors of many pages at once, as ``encode_cursor`` makes them."""
    said = F.to_json(F.struct(F.lit(1).alias("v"), package.alias("package"), query.alias("query"), offset.alias("offset")))
    return F.rtrim(F.translate(F.replace(F.base64(F.encode(said, "UTF-8")), F.lit("\r\n"), F.lit("")), "+/", "-_"), F.lit("="))


def decode_cursor(package: str, options: Options) -> int:
    if options.cursor is None:
        return 0
    try:
        said = json.loads(base64.urlsafe_b64decode(options.cursor + "=" * (-len(options.cursor) % 4)))
        if (said["v"], said["package"], said["query"]) == (1, package, options.fingerprint()) and said["offset"] >= 0:
            return said["offset"]
    except (ValueError, KeyError, TypeError):
        pass
    raise ValueError("the cursor belongs to another query or another state of the collection")


def where(units: DataFrame, collection=None, node_ids=None, kinds=None, path_prefix=None, within=None) -> DataFrame:
    """Search filters, ANDed: equal collection, node in a list, kind in a list, path prefix, ancestor in tree_path."""
    if collection is not None:
        units = units.filter(F.col("collection_id") == collection)
    if node_ids is not None:
        units = units.filter(F.col("node_id").isin(list(node_ids)))
    if kinds is not None:
        units = units.filter(F.col("kind").isin(list(kinds)))
    if path_prefix is not None:
        units = units.filter(F.col("path").startswith(path_prefix))
    if within is not None:
        units = units.filter(F.array_contains("tree_path", within))
    return units


def grep(units: DataFrame, text: str, pattern: str, regex: bool = False, ignore_case: bool = False) -> DataFrame:
    """Rows whose text has the literal or Java regular expression. Order and limit are the caller's."""
    col = F.col(text)
    if regex:
        return units.filter(col.rlike(f"(?i){pattern}" if ignore_case else pattern))
    return units.filter(F.lower(col).contains(pattern.lower()) if ignore_case else col.contains(pattern))


def occurrences(units: DataFrame, text: str, query: str) -> DataFrame:
    """A column ``score``: how often the query's words occur in the text as substrings, without overlap; above 0 only."""
    low = F.lower(F.col(text))
    score = sum(((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / F.lit(len(w)) for w in query.lower().split()), F.lit(0.0))
    return units.withColumn("score", score).filter("score > 0")


def bm25(units: DataFrame, query: str, fields: dict[str, float], k1: float = K1, b: float = B) -> DataFrame:
    """A column ``score``: the sum over fields (with boosts) of Okapi BM25 with Lucene's idf, any term matching; above 0 only.
    Statistics need the tokens of all texts; the scores then those of texts that hold a term's letters at all."""
    terms = sorted(set(T.words(query)))
    own = units.withColumns({f"_t{i}": T.tokens(F.coalesce(F.col(f), F.lit(""))) for i, f in enumerate(fields)})
    stats = [F.count(F.lit(1)).cast("double").alias("_n")]
    for i in range(len(fields)):
        stats.append(F.avg(F.size(f"_t{i}")).alias(f"_avg{i}"))
        stats += [F.sum(F.array_contains(f"_t{i}", t).cast("long")).alias(f"_df{i}_{j}") for j, t in enumerate(terms)]
    may_match = functools.reduce(Column.__or__, [F.lower(F.coalesce(F.col(f), F.lit(""))).contains(t) for f in fields for t in terms], F.lit(False))
    both = own.filter(may_match).crossJoin(F.broadcast(own.agg(*stats)))  # one row of statistics

    def part(i: int, j: int, term: str) -> Column:
        tf = F.size(F.filter(f"_t{i}", lambda x: x == term)).cast("double")
        df = F.col(f"_df{i}_{j}")
        idf = F.log(1 + (F.col("_n") - df + 0.5) / (df + 0.5))
        return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.size(f"_t{i}") / F.col(f"_avg{i}")))

    score = F.lit(0.0)
    for i, boost in enumerate(fields.values()):
        for j, term in enumerate(terms):
            score = score + F.lit(float(boost)) * F.when(F.array_contains(f"_t{i}", term), part(i, j, term)).otherwise(0.0)
    return both.withColumn("score", F.round(score, 6)).select(*units.columns, "score").filter("score > 0")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two numeric arrays, in double."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def semantic(vectors: DataFrame, embedding: str, query: list[float], threshold: float | None = None) -> DataFrame:
    """A column ``score``: the cosine with the query vector; the threshold holds before any limit."""
    scored = vectors.withColumn("score", F.round(cosine(F.col(embedding), F.array(*[F.lit(float(x)) for x in query])), 5))
    return scored if threshold is None else scored.filter(F.col("score") >= threshold)


def top(hits: DataFrame, id_col: str, limit: int) -> DataFrame:
    return hits.orderBy(F.desc("score"), F.asc(id_col)).limit(limit)


def ranked(hits: DataFrame, id_col: str, limit: int, rank: str) -> DataFrame:
    """The best ``limit`` hits with their rank; the window sees no more rows than that."""
    return top(hits, id_col, limit).withColumn(rank, F.row_number().over(W.orderBy(F.desc("score"), F.asc(id_col))))


def fuse(lexical: DataFrame, semantic_: DataFrame, id_col: str, options: Options) -> DataFrame:
    """Weighted reciprocal ranks of two ranked lists (columns lexical_rank, semantic_rank): id, both ranks, score."""
    k = options.rrf_k
    joined = lexical.select(id_col, "lexical_rank").join(semantic_.select(id_col, "semantic_rank"), id_col, "full_outer")
    part = lambda w, rank: F.coalesce(F.lit(float(w)) / (k + F.col(rank)), F.lit(0.0))
    return joined.withColumn("score", F.round(part(options.lexical_weight, "lexical_rank") + part(options.semantic_weight, "semantic_rank"), 9))


def diversify(hits: DataFrame, node: str, id_col: str, most: int) -> DataFrame:
    """At most ``most`` hits of a node, the best ones."""
    nth = F.row_number().over(W.partitionBy(node).orderBy(F.desc("score"), F.asc(id_col)))
    return hits.withColumn("_nth", nth).filter(F.col("_nth") <= most).drop("_nth")


def page(hits: DataFrame, id_col: str, offset: int, limit: int) -> DataFrame:
    """Positions offset+1 to offset+limit, with their ``rank``, of a candidate list."""
    return ranked(hits, id_col, offset + limit, "rank").filter(F.col("rank") > offset)


def rerank_fuse(hits: DataFrame, id_col: str, options: Options, weight: float = 1.0) -> DataFrame:
    """Adds the reciprocal rank of ``rerank_score`` (null: not reranked) and the confidence bonus to the fused score.

    Hits come with original (their position), lexical_rank and semantic_rank (null where absent). A hit without ranks starts
    from its position. The bonus goes to the best reranked hit if its score is positive and leads by more than 0.5.
    """
    k = options.rrf_k
    order = W.orderBy(F.desc_nulls_last("rerank_score"), F.asc("original"))
    own = hits.withColumn("rerank_rank", F.when(F.col("rerank_score").isNotNull(), F.row_number().over(order)))
    margin = F.col("rerank_score") - F.lead("rerank_score").over(order)
    bonus = F.when((F.col("rerank_rank") == 1) & (F.col("rerank_score") > 0) & (F.col("_margin") > 0.5), F.least(F.lit(0.006), (F.col("_margin") - 0.5) * 0.003)).otherwise(F.lit(0.0))
    none = F.col("lexical_rank").isNull() & F.col("semantic_rank").isNull()
    part = lambda w, rank: F.coalesce(F.lit(float(w)) / (k + F.col(rank)), F.lit(0.0))
    base = F.when(none, 1.0 / (k + F.col("original"))).otherwise(part(options.lexical_weight, "lexical_rank") + part(options.semantic_weight, "semantic_rank"))
    own = own.withColumn("_margin", margin).withColumn("rerank_bonus", F.round(bonus, 9))
    return own.withColumn("score", F.round(base + part(weight, "rerank_rank") + F.col("rerank_bonus"), 9)).drop("_margin")


# Queries over the test tables: documents are units, their source is the node, embeddings meet them by id.

QUERY = "the thing erst"
OPTIONS = Options(QUERY)


def _units(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source")


def _vector(spark: SparkSession, d: str) -> list[float]:
    return table(spark, d, "embeddings").filter("vec_id = 7").first()["embedding"]


def _lexical(spark, d):
    return ranked(bm25(_units(spark, d), QUERY, {"text": 1.0}).select("doc_id", "score"), "doc_id", 100, "lexical_rank")


def _semantic(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return ranked(semantic(vectors, "embedding", _vector(spark, d)).select("doc_id", "score"), "doc_id", 100, "semantic_rank")


def _fused(spark, d):
    fused = fuse(_lexical(spark, d), _semantic(spark, d), "doc_id", OPTIONS)
    return fused.join(_units(spark, d).select("doc_id", "source", F.length("text").alias("n")), "doc_id")


def search_lexical_bm25(spark, d):
    return _lexical(spark, d)


def search_lexical_boosted(spark, d):
    units = _units(spark, d).withColumns({"title": F.substring("text", 1, 60), "description": F.substring("text", 61, 120)})
    return top(bm25(units, QUERY, {"title": 4.0, "description": 2.0, "text": 1.0}).select("doc_id", "score"), "doc_id", 50)


def search_lexical_filtered(spark, d):
    units = _units(spark, d).withColumns({"kind": F.col("lang"), "path": F.concat(F.col("source"), F.lit("/"), F.col("doc_id")), "tree_path": F.array("lang", "source")})
    return top(bm25(where(units, kinds=["en", "de"], path_prefix="src1", within="en"), QUERY, {"text": 1.0}).select("doc_id", "score"), "doc_id", 50)


def search_memory_lexical(spark, d):
    return top(occurrences(_units(spark, d), "text", "thing erst").select("doc_id", "score"), "doc_id", 100)


def search_semantic(spark, d):
    return _semantic(spark, d)


def search_semantic_threshold(spark, d):
    return top(semantic(table(spark, d, "embeddings"), "embedding", _vector(spark, d), 0.1).select("vec_id", "score"), "vec_id", 100)


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: BM25 and cosine candidates, fused by weighted reciprocal ranks, at most three of a source, in order."""
    return ranked(diversify(_fused(spark, d), "source", "doc_id", OPTIONS.max_per_node), "doc_id", 2 * OPTIONS.candidate_limit, "rank").select("rank", "doc_id", "source", "lexical_rank", "semantic_rank", "score")


def search_page(spark, d):
    return page(diversify(_fused(spark, d), "source", "doc_id", 3), "doc_id", 10, 10).select("rank", "doc_id", "source", "score")


def search_rerank_fused(spark, d):
    hits = ranked(_fused(spark, d), "doc_id", 50, "original")
    hits = hits.withColumn("rerank_score", F.when(F.col("original") <= 20, F.col("n") % 97 / F.lit(10.0)))
    return rerank_fuse(hits, "doc_id", OPTIONS).select("doc_id", "original", "rerank_rank", "rerank_bonus", "score")


def _grep(pattern: str, regex: bool, ignore_case: bool):
    def query(spark, d):
        return grep(_units(spark, d), "text", pattern, regex, ignore_case).select("doc_id", F.lit(1.0).alias("score")).orderBy("doc_id").limit(200)

    return query


_TOK = "SELECT doc_id, {col} AS t FROM ({src})"


def _bm25_sql(src: str, field: str = "text", alias: str = "score") -> str:
    """One field's BM25 of QUERY over a source with doc_id."""
    terms = sorted(set(T.words(QUERY)))
    df = ", ".join(f"sum(CASE WHEN list_contains(t, '{x}') THEN 1 ELSE 0 END) AS df{j}" for j, x in enumerate(terms))
    tf = [f"CAST(len(list_filter(t, lambda x: x = '{x}')) AS DOUBLE)" for x in terms]
    score = " + ".join(f"ln(1 + (n - df{j} + 0.5::DOUBLE) / (df{j} + 0.5::DOUBLE)) * {f} * 2.2::DOUBLE / ({f} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(t) / a))" for j, f in enumerate(tf))
    return f"""SELECT doc_id, {score} AS {alias} FROM (SELECT doc_id, regexp_extract_all(lower({field}), '[\\p{{L}}\\p{{N}}]+') AS t FROM ({src})) x,
      (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS a, {df} FROM (SELECT regexp_extract_all(lower({field}), '[\\p{{L}}\\p{{N}}]+') AS t FROM ({src})) y) s"""


_LEX = f"SELECT doc_id, round(score, 6) AS score FROM ({_bm25_sql('SELECT doc_id, text FROM documents')}) WHERE round(score, 6) > 0"
_LEX_TOP = f"SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS lexical_rank FROM ({_LEX} ORDER BY score DESC, doc_id LIMIT 100)"
_COS = "round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 7) AS DOUBLE[])), 5)"
_SEM_TOP = f"SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS semantic_rank FROM (SELECT vec_id AS doc_id, {_COS} AS score FROM embeddings ORDER BY score DESC, doc_id LIMIT 100)"
_FUSED = f"""SELECT f.*, d.source, length(d.text) AS n FROM (
  SELECT coalesce(l.doc_id, s.doc_id) AS doc_id, lexical_rank, semantic_rank,
    round(coalesce(0.5::DOUBLE / (60 + lexical_rank), 0) + coalesce(1.0::DOUBLE / (60 + semantic_rank), 0), 9) AS score
  FROM ({_LEX_TOP}) l FULL OUTER JOIN ({_SEM_TOP}) s ON l.doc_id = s.doc_id) f JOIN documents d ON d.doc_id = f.doc_id"""
_DIVERSE = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS nth FROM ({_FUSED})) WHERE nth <= 3"
_RANKED = f"SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS rank, * FROM ({_DIVERSE})"
_FILTERED = "SELECT doc_id, text FROM documents WHERE lang IN ('en', 'de') AND starts_with(source || '/' || doc_id, 'src1') AND list_contains([lang, source], 'en')"
_FIELDS = "SELECT doc_id, text, substring(text, 1, 60) AS title, substring(text, 61, 120) AS description FROM documents"

QUERIES = {
    "hybrid_search": (hybrid_search, f"SELECT rank, doc_id, source, lexical_rank, semantic_rank, score FROM ({_RANKED})"),
    "search_lexical_bm25": (search_lexical_bm25, _LEX_TOP),
    "search_cursors": (
        lambda spark, d: table(spark, d, "orders").select("o_orderkey", cursor(F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_orderkey")).alias("cursor")),
        """SELECT o_orderkey, rtrim(translate(to_base64(encode('{"v":1,"package":"' || o_orderpriority || '","query":"' || o_orderstatus || '","offset":' || o_orderkey || '}')), '+/', '-_'), '=') AS cursor FROM orders""",
    ),
    "search_lexical_boosted": (
        search_lexical_boosted,
        f"""SELECT * FROM (SELECT a.doc_id, round(4.0::DOUBLE * ta + 2.0::DOUBLE * tb + tc, 6) AS score FROM ({_bm25_sql(_FIELDS, 'title', 'ta')}) a
        JOIN ({_bm25_sql(_FIELDS, 'description', 'tb')}) b ON a.doc_id = b.doc_id JOIN ({_bm25_sql(_FIELDS, 'text', 'tc')}) c ON a.doc_id = c.doc_id) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 50""",
    ),
    "search_lexical_filtered": (search_lexical_filtered, f"SELECT doc_id, round(score, 6) AS score FROM ({_bm25_sql(_FILTERED)}) WHERE round(score, 6) > 0 ORDER BY score DESC, doc_id LIMIT 50"),
    "search_memory_lexical": (
        search_memory_lexical,
        "SELECT * FROM (SELECT doc_id, (length(lower(text)) - length(replace(lower(text), 'thing', ''))) / 5.0::DOUBLE + (length(lower(text)) - length(replace(lower(text), 'erst', ''))) / 4.0::DOUBLE AS score FROM documents) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 100",
    ),
    "search_semantic": (search_semantic, _SEM_TOP),
    "search_semantic_threshold": (search_semantic_threshold, f"SELECT * FROM (SELECT vec_id, {_COS} AS score FROM embeddings) WHERE score >= 0.1 ORDER BY score DESC, vec_id LIMIT 100"),
    "search_page": (search_page, f"SELECT rank, doc_id, source, score FROM ({_RANKED}) WHERE rank > 10 AND rank <= 20"),
    "search_rerank_fused": (
        search_rerank_fused,
        f"""WITH h AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS original FROM ({_FUSED}) ORDER BY score DESC, doc_id LIMIT 50),
        r AS (SELECT *, CASE WHEN original <= 20 THEN (n % 97) / 10.0::DOUBLE END AS rs FROM h),
        o AS (SELECT *, CASE WHEN rs IS NOT NULL THEN row_number() OVER (ORDER BY rs DESC NULLS LAST, original) END AS rerank_rank, rs - lead(rs) OVER (ORDER BY rs DESC NULLS LAST, original) AS margin FROM r),
        b AS (SELECT *, round(CASE WHEN rerank_rank = 1 AND rs > 0 AND margin > 0.5 THEN least(0.006::DOUBLE, (margin - 0.5::DOUBLE) * 0.003::DOUBLE) ELSE 0 END, 9) AS rerank_bonus FROM o)
        SELECT doc_id, original, rerank_rank, rerank_bonus, round(coalesce(0.5::DOUBLE / (60 + lexical_rank), 0) + coalesce(1.0::DOUBLE / (60 + semantic_rank), 0) + coalesce(1.0::DOUBLE / (60 + rerank_rank), 0) + rerank_bonus, 9) AS score FROM b""",
    ),
    "grep_literal": (_grep("The", False, False), "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE contains(text, 'The') ORDER BY doc_id LIMIT 200"),
    "grep_literal_ignore_case": (_grep("THING", False, True), "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE contains(lower(text), 'thing') ORDER BY doc_id LIMIT 200"),
    "grep_regex": (_grep("[a-z]+ing\\b", True, False), "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE regexp_matches(text, '[a-z]+ing\\b') ORDER BY doc_id LIMIT 200"),
    "grep_regex_ignore_case": (_grep("^the", True, True), "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE regexp_matches(text, '(?i)^the') ORDER BY doc_id LIMIT 200"),
}
