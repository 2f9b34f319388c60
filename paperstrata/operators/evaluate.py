"""Retrieval quality: recall, MRR and nDCG at k, latency percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import table
from .tree import staged

#: Bins of a round of selection, how many values are sorted instead, and for how many groups ranges are broadcast.
BINS, SORTED, FEW_GROUPS = 1024, 10_000, 100_000


def metrics(run: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """Per query of the judgements (query, id): recall, mrr, ndcg at k of the run (query, id, rank). Gains are binary; an id that
    a run repeats counts once, where it is best; the ideal list is no longer than what was returned."""
    own = run.filter(F.col("rank") <= k)
    first = own.groupBy("query", "id").agg(F.min("rank").alias("rank"))
    hits = first.join(relevant.distinct(), ["query", "id"], "left_semi")
    per_hit = hits.groupBy("query").agg(F.count(F.lit(1)).alias("found"), F.min("rank").alias("best"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    returned = own.groupBy("query").agg(F.count(F.lit(1)).alias("returned"))
    wanted = relevant.distinct().groupBy("query").agg(F.count(F.lit(1)).alias("wanted"))
    joined = wanted.join(returned, "query", "left").join(per_hit, "query", "left")
    ideal_n = F.least(F.col("wanted"), F.coalesce("returned", F.lit(0)))
    ideal = F.aggregate(F.when(ideal_n > 0, F.sequence(F.lit(1).cast("long"), ideal_n)).otherwise(F.array().cast("array<bigint>")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return joined.select("query", F.round(F.coalesce(F.col("found") / F.col("wanted"), F.lit(0.0)), 6).alias("recall"), F.round(F.coalesce(1 / F.col("best"), F.lit(0.0)), 6).alias("mrr"), F.round(F.when(ideal > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(0.0), 6).alias("ndcg"))


def percentiles(rows: DataFrame, value: str, by: str, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Mean and exact nearest-rank percentiles per group; null and NaN values count as absent.

    Selection by histograms: a group's range is cut into BINS, which are counted; the bin that holds the wanted rank is the next
    range. Counts are partial aggregates, so a group of any size stays spread out. Ranges of at most SORTED values are sorted."""
    own = rows.select(F.col(by).alias("by"), F.col(value).cast("double").alias("v"), F.col(value).alias("value")).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    sizes = staged(own.groupBy("by").agg(F.round(F.avg("v"), 6).alias("mean"), F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")))
    nearest = F.greatest(F.ceil(F.col("n") * F.col("share")), F.lit(1))
    shown = F.explode(F.array(*map(F.lit, map(float, shares)))).alias("share")
    targets = sizes.filter("n > 0").select("by", "n", "low", "high", shown).select("by", "share", "low", "high", "n", nearest.alias("rank"))
    ready = []
    targets = staged(targets)
    while not targets.isEmpty():
        done = (F.col("low") == F.col("high")) | (F.col("n") <= SORTED)
        ready.append(targets.filter(done))
        wide = targets.filter(~done)
        part = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * BINS)))
        counted = _within(own, wide).groupBy("by", "share", "rank", part.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("n").over(W.partitionBy("by", "share").orderBy("bin"))  # at most BINS rows
        held = counted.withColumn("upto", upto).filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
        targets = staged(held.select("by", "share", "low", "high", "n", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank")))
    found = sizes.limit(0).select("by", F.lit(0.0).alias("share"), F.lit(0.0).alias("v"))
    for part in ready:
        flat = part.filter("low = high").select("by", "share", F.col("low").alias("v"))
        nth = F.row_number().over(W.partitionBy("by", "share").orderBy("v"))
        found = found.unionByName(flat).unionByName(_within(own, part.filter("low < high")).withColumn("nth", nth).filter("nth = rank").select("by", "share", "v"))
    kind = dict(rows.dtypes)[value]
    wide = found.groupBy(F.col("by").alias("w_by")).agg(*[F.max(F.when(F.col("share") == float(q), F.col("v"))).cast(kind).alias(f"p{int(q * 100)}") for q in shares])
    return sizes.join(wide, F.col("by").eqNullSafe(F.col("w_by")), "left").select(F.col("by").alias(by), "mean", *wide.columns[1:])


def _within(own: DataFrame, targets: DataFrame) -> DataFrame:
    """Values in the ranges of their group's targets."""
    t = targets.withColumnRenamed("by", "t_by")
    t = F.broadcast(t) if t.count() <= FEW_GROUPS else t
    return own.join(t, F.col("by").eqNullSafe(F.col("t_by")) & F.col("v").between(F.col("low"), F.col("high"))).select("by", "v", "share", "low", "high", "rank")


QUERIES = {
    "eval_metrics": (
        lambda s, d: metrics(
            table(s, d, "documents").select(F.col("source").alias("query"), F.col("doc_id").alias("id"), F.row_number().over(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")).alias("rank")),
            table(s, d, "documents").join(table(s, d, "labels").filter("quality = 1"), "doc_id").select(F.col("source").alias("query"), F.col("doc_id").alias("id")),
        ),
        """WITH run AS (SELECT source AS query, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
        rel AS (SELECT DISTINCT source AS query, d.doc_id AS id FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 1),
        h AS (SELECT run.query, count(*) AS found, min(rank) AS best, sum(1 / log2(rank + 1)) AS dcg FROM run JOIN rel ON run.query = rel.query AND run.id = rel.id WHERE rank <= 10 GROUP BY run.query),
        w AS (SELECT query, count(*) AS wanted FROM rel GROUP BY query), r AS (SELECT query, count(*) AS returned FROM run WHERE rank <= 10 GROUP BY query)
        SELECT w.query, round(coalesce(found / wanted::DOUBLE, 0), 6) AS recall, round(coalesce(1.0::DOUBLE / best, 0), 6) AS mrr,
          round(coalesce(dcg, 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= least(wanted, returned)), 6) AS ndcg
        FROM w LEFT JOIN r ON w.query = r.query LEFT JOIN h ON w.query = h.query""",
    ),
    "eval_percentiles": (
        lambda s, d: percentiles(table(s, d, "events"), "value", "event_type"),
        "SELECT event_type, round(avg(value), 6) AS mean, percentile_disc(0.5) WITHIN GROUP (ORDER BY value) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95 FROM events GROUP BY event_type",
    ),
}
