"""Queries of models of feature vectors, with their DuckDB counterparts where SQL can express them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import scores
from millrace.operators import inspection, vectors
from millrace.storage import saved

QUERIES, SQL = {}, {}


def on_embeddings(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _products(e: DataFrame) -> DataFrame:
    """Vectors as patches: four neighbouring vectors of a label are an item of that product."""
    return e.select("vec_id", "embedding", F.concat(F.lit("L"), F.col("label").cast("string")).alias("product"), F.expr("vec_id div 4").alias("item"), F.lit(0).alias("view"))


def _typical(e: DataFrame, count: int) -> DataFrame:
    """The ``count`` vectors of every label nearest its mean: a rank cuts each label's distances, only what lies within it is numbered."""
    parts = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    mean = saved(parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("mean")), "mean")  # one mean for cut and rank
    d = e.join(mean, "label").withColumn("d2", scores.squared_distance("embedding", "mean"))
    cut = inspection.kth_smallest(d, ["label"], "d2", F.least(F.lit(count), F.col("n"))).select("label", F.col("d2").alias("cut"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("d2", "vec_id"))
    return d.join(cut, "label").filter("d2 <= cut").withColumn("rank", rank).filter(F.col("rank") <= count).select("label", F.col("embedding").cast("array<double>").alias("v"))


@on_embeddings("""
WITH c AS (SELECT label, list(m ORDER BY i) AS mean FROM (SELECT label, i, avg(v) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label),
d AS (SELECT vec_id, label, embedding, list_sum(list_transform(list_zip(embedding, mean), lambda p: (p[1]::DOUBLE - p[2]) * (p[1]::DOUBLE - p[2]))) AS d2 FROM embeddings JOIN c USING (label)),
bank AS (SELECT embedding AS b FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d2, vec_id) AS rn FROM d) WHERE rn <= 10)
SELECT vec_id, round(sqrt(min(list_sum(list_transform(list_zip(embedding, b), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))))), 5) AS distance FROM embeddings, bank GROUP BY vec_id""")
def v3_nearest_bank(e):
    """Distance to the nearest of a bank given as rows: the ten most typical vectors of every label."""
    return vectors.nearest_rows(e, _typical(e, 10)).withColumn("distance", F.round("distance", 5))


@on_embeddings()
def v1_feature_bank_score(e):
    """Items against the bank of their product, a core-set of the items that aren't held out, with the thresholds that the held-out ones give."""
    items, tau = vectors.bank_scores(_products(e), ["product"], "item")
    return items.join(tau.select("product", "n_samples", "threshold"), "product", "left").withColumn("over", F.col("score") > F.col("threshold"))


@on_embeddings()
def v2_coreset(e):
    return vectors.coreset(e, 100).select("place", F.col("id").alias("vec_id"))


@on_embeddings()
def v2_product_coresets(e):
    """A core-set per product."""
    return vectors.coreset(_products(e), vectors.bank_size(0.1, least=5), ("product",)).select("product", "place", F.col("id").alias("vec_id"))


@on_embeddings("""
SELECT product, count(*) AS items, CASE WHEN count(*) >= 10 THEN greatest(3, count(*) // 5) ELSE 0 END::BIGINT AS held
FROM (SELECT DISTINCT concat('L', CAST(label AS VARCHAR)) AS product, vec_id // 4 AS item FROM embeddings) GROUP BY product""")
def v1_held_out(e):
    """How many items of each product are held out for calibration."""
    dealt = vectors.held_out(_products(e), ["product"], "item").select("product", "item", "part").distinct()
    return dealt.groupBy("product").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("part") == "cal").alias("held"))


@on_embeddings()
def v4_mixture_nll(e):
    return vectors.Mixture(e).scores(e)


@on_embeddings()
def v5_reseeded_mixture(e):
    """Components of a mixture whose dead components were seeded anew, with the rows that belong to them."""
    model = vectors.Mixture(e, components=16, reseed=2, dead_share=0.8)
    weights = e.sparkSession.createDataFrame([(i, float(w)) for i, w in enumerate(model.weight)], "component long, weight double")
    return weights.join(model.scores(e).groupBy("component").agg(F.count(F.lit(1)).alias("rows")), "component", "left")


@on_embeddings()
def v6_robust_components(e):
    return inspection.robust_by_component(vectors.Mixture(e).scores(e))


@on_embeddings()
def v7_subspace_residual(e):
    one = e.select(F.lit("all").alias("product"), F.col("vec_id").alias("item"), F.lit(0).alias("view"), "embedding")
    return vectors.residual_scores(one, vectors.subspaces(one)).select(F.col("item").alias("vec_id"), F.col("score").alias("residual"))


@on_embeddings()
def v7_subspace_verdicts(e):
    """Verdicts of items by the subspace of their product; products of a few items are in fast mode."""
    p = F.concat(F.col("label").cast("string"), F.lit("-"), F.expr("vec_id div 60").cast("string"))
    rows = e.select(p.alias("product"), F.col("vec_id").alias("item"), F.lit(0).alias("view"), "embedding")
    return vectors.subspace_verdicts(rows, rows, share=0.9)[1]


@on_embeddings()
def m5_explained_variance(e):
    """Directions that a share of the variance of each label needs."""
    rows = e.select(F.col("label").alias("product"), "embedding")
    parts = [vectors.subspaces(rows, s).select(F.col("product").alias("label"), F.col("k").alias("components"), F.lit(s).alias("share"), F.round("explained", 9).alias("explained")) for s in (0.5, 0.9, 0.99)]
    return reduce(DataFrame.unionByName, parts)
