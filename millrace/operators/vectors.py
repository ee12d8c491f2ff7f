"""Models of normal feature vectors, fitted on all rows: core-sets, nearest distances, mixtures, and subspaces per product.

Vectors are rows (keys, id, vector). Fits that are sums (means, covariances, steps of expectation maximisation) add up inside the tasks and combine by key; what
reaches the driver of a mixture is its parameters, components times dimensions. Core-sets are chosen where the rows lie and merged in groups of a few, so a
group is never larger than ``fan`` core-sets. Models meet the rows they judge as rows: the rows of a key are dealt into buckets, each bucket gets a copy of the key's
model or bank, and a hot key is as many tasks as it has buckets.

Null vectors and null ids are left out; equal vectors are chosen once; keys without rows have no model; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.storage import drop_saved, saved

from . import inspection


def _named(rows: DataFrame, keys: list[str], order: str, vector: str) -> DataFrame:
    named = rows.select(*keys, F.col(order).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return named.filter("id is not null and v is not null")


# --- core-sets


def farthest_points(ids: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
    """Places of a greedy farthest-point selection: first the vector nearest the mean, then always the one farthest from those chosen; ties go to
    the least id. Stops when every vector equals a chosen one."""
    d = ((x - x.mean(axis=0)) ** 2).sum(axis=1)
    chosen = [int(np.lexsort((ids, d))[0])]
    far = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(size, len(x)):
        best = far.max()
        if best <= 0:
            break
        at = np.flatnonzero(far == best)
        chosen.append(int(at[np.argmin(ids[at])]))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen)


def coreset(features: DataFrame, size: int | Column, keys: tuple[str, ...] = (), order: str = "vec_id", vector: str = "embedding", chunk: int = 20_000, fan: int = 8) -> DataFrame:
    """(keys, place, id, v): a core-set of every key's rows, ``size`` vectors or a column over n, the key's rows.

    Chunks of rows choose first, then the union of ``fan`` chosen sets chooses again, until one set is left. With m levels of merging the largest distance of a
    row to its nearest chosen vector is at most 2 (m + 1) times that of the best possible choice of as many vectors. The number of jobs is that of the levels: the logarithm,
    to the base ``fan``, of the number of chunks."""
    asked, keys = list(keys), list(keys) or ["all_rows"]
    rows = _named(features if asked else features.withColumn("all_rows", F.lit(0)), keys, order, vector)
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    sizes = n.select(*keys, (F.lit(size) if isinstance(size, int) else size).cast("int").alias("size"), F.ceil(F.col("n") / chunk).cast("long").alias("groups"))
    now = rows.join(sizes, keys).withColumn("part", F.pmod(F.xxhash64("id"), F.col("groups"))).drop("groups")
    kinds = T.StructType([*rows.select(*keys).schema.fields, *T.StructType.fromDDL("id long, v array<double>, size int, part long, place int").fields])

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["v"].to_numpy())
        at = farthest_points(pdf["id"].to_numpy(), x, int(pdf["size"].iloc[0]))
        return pdf.iloc[at].assign(place=np.arange(len(at), dtype=np.int32))[[f.name for f in kinds]]

    while True:
        new = saved(now.groupBy(*keys, "part").applyInPandas(choose, kinds), "coreset")
        drop_saved(now)
        if (new.agg(F.max("part").alias("p")).first().p or 0) == 0:
            return new.select(*asked, "place", "id", "v")
        now = new.drop("place").withColumn("part", F.expr(f"part div {fan}"))
        now._millrace_path = new._millrace_path


def bank_size(ratio: float, most: int = 25_000, least: int = 100) -> Column:
    """How many vectors a bank keeps of n: a share of them, of ``most`` at most."""
    return F.greatest(F.lit(least), F.floor(F.least(F.col("n"), F.lit(most)) * ratio))


def judged(rows: DataFrame, models: DataFrame, keys: list[str], judge: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: T.StructType | str, by: str = "id", bucket_rows: int = 50_000) -> DataFrame:
    """``judge(rows of a bucket, model rows of its key)`` over all rows. A key's rows are dealt by a hash of ``by`` into buckets of about ``bucket_rows``; each bucket
    gets a copy of the key's model rows. Rows of keys without a model are left out."""
    key = keys or ["all_rows"]
    if not keys:
        rows, models = rows.withColumn("all_rows", F.lit(0)), models.withColumn("all_rows", F.lit(0))
    buckets = rows.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / bucket_rows).cast("long").alias("buckets"))
    dealt = rows.join(buckets, key).withColumn("bucket", F.pmod(F.xxhash64(by), F.col("buckets"))).drop("buckets")
    copies = models.join(buckets, key).withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1))).drop("buckets")

    def both(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return judge(left, right) if len(left) and len(right) else pd.DataFrame()

    return dealt.groupBy(*key, "bucket").cogroup(copies.groupBy(*key, "bucket")).applyInPandas(both, schema)


def nearest_rows(queries: DataFrame, bank: DataFrame, keys: tuple[str, ...] = (), order: str = "vec_id", vector: str = "embedding", block: int = 2048) -> DataFrame:
    """(keys, order, distance): every row's Euclidean distance to the nearest vector ``v`` of its key's bank, by blocks of a matrix product."""
    keys = list(keys)
    rows = _named(queries, keys, order, vector)

    def judge(pdf: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        b = np.stack(model["v"].to_numpy())
        out = []
        for at in range(0, len(pdf), block):
            q = np.stack(pdf["v"].iloc[at : at + block].to_numpy())
            near = ((q * q).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * q @ b.T).argmin(axis=1)
            out.append(np.sqrt(((q - b[near]) ** 2).sum(axis=1)))  # the distance itself without cancellation
        return pdf[[*keys, "id"]].rename(columns={"id": order}).assign(distance=np.concatenate(out))

    kinds = T.StructType([*rows.select(*keys).schema.fields, T.StructField(order, T.LongType()), T.StructField("distance", T.DoubleType())])
    return judged(rows, bank.select(*keys, "v"), keys, judge, kinds)


def held_out(rows: DataFrame, keys: list[str], item: str, seed: int = 2026, least: int = 3, from_n: int = 10) -> DataFrame:
    """``rows`` with part 'bank', 'cal' or 'both': a fifth of each key's items (three at least) in hash order is held out for calibration; keys of
    fewer than ten items use all for both. Items are ranked through counted ranges of their hashes."""
    items = rows.select(*keys, item).distinct().withColumn("h", F.xxhash64(item, F.lit(seed)))
    cut = inspection.kth_smallest(items, keys, "h", F.greatest(F.lit(least), F.floor(F.col("n") / 5))).filter(F.col("n") >= from_n)
    cut = cut.select(*keys, F.col("h").alias("cut"))
    part = F.when(F.col("cut").isNull(), "both").when(F.xxhash64(item, F.lit(seed)) <= F.col("cut"), "cal").otherwise("bank")
    return rows.join(cut, keys, "left").withColumn("part", part).drop("cut")


def bank_scores(rows: DataFrame, keys: list[str], item: str, ratio: float = 0.1, epsilon: float = 0.02, share: float = 0.05, order: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(items, thresholds) of banks per key. items: keys, item, part, score, the mean distance of an item's worst ``share`` of vectors to the bank of the items that
    aren't held out; thresholds: from the scores of the held-out items, as ``calibrate`` gives them."""
    dealt = held_out(rows, keys, item)
    bank = coreset(dealt.filter("part <> 'cal'"), bank_size(ratio), tuple(keys), order, vector)
    far = nearest_rows(dealt, bank, tuple(keys), order, vector)
    named = dealt.select(*keys, F.col(order).cast("long").alias(order), item, "part")
    each = named.join(far, [*keys, order])
    worst = F.slice(F.sort_array(F.collect_list("distance"), False), F.lit(1), F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * share)).cast("int"))  # the vectors of one item
    items = each.groupBy(*keys, item, "part").agg(worst.alias("w")).withColumn("score", F.aggregate("w", F.lit(0.0), lambda a, b: a + b) / F.size("w")).drop("w")
    return items, inspection.calibrate(items.filter("part <> 'bank'"), keys, epsilon)


# --- mixture


class Mixture:
    """PCA whitening and a Gaussian mixture with diagonal covariances, fitted on all rows.

    Each step is one pass: tasks add up weights, sums and squares per component, and the sums of all tasks combine by (component, dimension). Variances have a floor,
    under which each step is still the best one, so the likelihood never falls; steps end when it gains less than ``tolerance`` a row. ``history`` holds it. The first
    means are the rows of least hash. With ``reseed`` rounds, components of less than ``dead_share`` of an even weight start anew at rows among the hundredth that
    fits worst (a rank over all rows), and the mixture is fitted again."""

    FLOOR = 1e-4

    def __init__(self, rows: DataFrame, dim: int = 64, components: int = 8, rounds: int = 100, tolerance: float = 1e-3, reseed: int = 0, dead_share: float = 0.5, order: str = "vec_id", vector: str = "embedding", seed: int = 2026):
        self.rows = _named(rows, [], order, vector)
        n, total, second = _moments(self.rows)
        self.history: list[float] = []
        if not n:
            raise ValueError("a mixture needs rows")
        self.n = n
        self.mean = total / n
        values, axes = np.linalg.eigh((second - np.outer(total, total) / n) / max(n - 1, 1))
        order_ = np.argsort(values)[::-1]
        values, axes = values[order_], axes[:, order_]
        k = max(1, min(dim, int(n) - 1, len(values), int((values > 1e-12 * max(values[0], 1e-300)).sum())))
        self.axes = axes[:, :k] / np.sqrt(np.maximum(values[:k], 1e-300))
        m = max(1, min(components, int(n) // 10))
        first = self.rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(m).collect()  # one row a component
        self.mu = (np.array([r.v for r in first]) - self.mean) @ self.axes
        self._even()
        self.white = self._whitened()
        self._fit(rounds, tolerance)
        for r in range(reseed):
            dead = np.flatnonzero(self.weight < dead_share / m)
            if m == 1 or not len(dead):
                break
            self.mu[dead] = self._worst(len(dead), seed + r)
            self._even()
            self._fit(rounds, tolerance)
        drop_saved(self.white)

    def _even(self) -> None:
        m, k = self.mu.shape
        self.var, self.weight = np.ones((m, k)), np.full(m, 1 / m)

    def _whitened(self) -> DataFrame:
        """The rows' whitened vectors, written once; every step reads only them."""
        mean, axes = self.mean, self.axes

        def run(frames):
            for pdf in frames:
                if len(pdf):
                    yield pdf.assign(v=list((np.stack(pdf["v"].to_numpy()) - mean) @ axes))

        return saved(self.rows.mapInPandas(run, "id long, v array<double>"), "white")

    def log_densities(self, z: np.ndarray) -> np.ndarray:
        """Weighted log density of each row of whitened vectors under each component."""
        quad = ((z * z) @ (1 / self.var).T) - 2 * z @ (self.mu / self.var).T + (self.mu**2 / self.var).sum(axis=1)
        return np.log(self.weight + 1e-300) - 0.5 * (quad + np.log(2 * math.pi * self.var).sum(axis=1))

    def _fit(self, rounds: int, tolerance: float) -> None:
        for _ in range(rounds):
            before = self.history[-1] if self.history else None
            w, s, q, level = self._step()
            fresh = before is None or self._restarted
            self.history.append(level)
            self._restarted = False
            if not fresh and level - before < tolerance:
                return
            mass = w + 1e-12
            self.weight, self.mu = w / self.n, s / mass[:, None]
            self.var = np.maximum(q / mass[:, None] - self.mu**2, self.FLOOR)

    #: Whether the next step starts from new means; its likelihood is no successor of the last one.
    _restarted = True

    def _step(self):
        m, k = self.mu.shape
        model = self._shared()

        def sums(frames):
            w, s, q, level = np.zeros(m), np.zeros((m, k)), np.zeros((m, k)), 0.0
            for pdf in frames:
                if len(pdf):
                    z = np.stack(pdf["v"].to_numpy())
                    logp = model.log_densities(z)
                    all_ = np.logaddexp.reduce(logp, axis=1, keepdims=True)
                    r = np.exp(logp - all_)
                    w, s, q, level = w + r.sum(axis=0), s + r.T @ z, q + r.T @ (z * z), level + float(all_.sum())
            yield pd.DataFrame({"c": range(m), "w": w, "s": list(s), "q": list(q), "level": [level] + [0.0] * (m - 1)})

        parts = self.white.select("v").mapInPandas(sums, "c int, w double, s array<double>, q array<double>, level double")
        add = lambda c: F.array(*[F.sum(F.col(c)[i]) for i in range(k)]).alias(c)
        found = parts.groupBy("c").agg(F.sum("w").alias("w"), add("s"), add("q"), F.sum("level").alias("level")).orderBy("c").collect()  # components times dimensions
        return np.array([r.w for r in found]), np.array([r.s for r in found]), np.array([r.q for r in found]), sum(r.level for r in found) / self.n

    def _shared(self):
        """The parameters alone, as tasks get them."""
        small = object.__new__(Mixture)
        small.mean, small.axes, small.mu, small.var, small.weight = self.mean, self.axes, self.mu.copy(), self.var.copy(), self.weight.copy()
        return small

    def _worst(self, count: int, seed: int) -> np.ndarray:
        """Whitened vectors of ``count`` rows, in hash order, among the hundredth that fits worst."""
        scored = self.scores(self.rows, "id", "v").withColumn("all", F.lit(0))
        top = F.greatest(F.lit(count), F.floor(F.col("n") / 100), F.lit(1))
        cut = inspection.kth_smallest(scored, ["all"], "nll", F.greatest(F.col("n") - top + 1, F.lit(1))).first().nll
        picked = scored.filter(F.col("nll") >= cut).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(count).select("id")
        rows = self.white.join(F.broadcast(picked), "id").dropDuplicates(["id"]).orderBy("id").collect()  # one row a dead component
        self._restarted = True
        return np.array([r.v for r in rows])[np.arange(count) % len(rows)]

    def scores(self, rows: DataFrame, order: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """(order, nll, component) of every row: negative log likelihood, and the most likely component."""
        model = self._shared()

        def run(frames):
            for pdf in frames:
                if len(pdf):
                    logp = model.log_densities((np.stack(pdf["v"].to_numpy()) - model.mean) @ model.axes)
                    yield pd.DataFrame({order: pdf["id"], "nll": -np.logaddexp.reduce(logp, axis=1), "component": logp.argmax(axis=1)})

        return _named(rows, [], order, vector).mapInPandas(run, f"`{order}` long, nll double, component long")


def _moments(rows: DataFrame) -> tuple[float, np.ndarray, np.ndarray]:
    """Count, sum and sum of outer products of all vectors ``v``; d x d numbers."""
    sums = _moment_rows(rows, []).collect()
    if not sums:
        return 0, np.empty(0), np.empty((0, 0))
    d = len(sums) - 1
    g = np.array([r.v for r in sorted(sums, key=lambda r: r.i)])
    return g[d, d], g[d, :d], g[:d, :d]


def _moment_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, v): the rows of the matrix of second moments of (vector, 1) per key. Tasks add up their rows per key first."""
    fields = rows.select(*keys).schema.fields
    kinds = T.StructType([*fields, T.StructField("i", T.IntegerType()), T.StructField("v", T.ArrayType(T.DoubleType()))])

    def moments(frames):
        held: dict[tuple, np.ndarray] = {}
        for pdf in frames:
            for key, x in (pdf.groupby(keys, dropna=False)["v"] if keys else [((), pdf["v"])]):
                if len(x):
                    a = np.stack(x.to_numpy())
                    a = np.hstack([a, np.ones((len(a), 1))])
                    held[key] = held.get(key, 0) + a.T @ a
            if len(held) > 64:
                yield from flushed(held)
                held.clear()
        yield from flushed(held)

    def flushed(held):
        for key, g in held.items():
            yield pd.DataFrame(dict(zip(keys, ([k] * len(g) for k in key))) | {"i": np.arange(len(g), dtype=np.int32), "v": list(g)})

    parts = rows.select(*keys, "v").mapInPandas(moments, kinds)
    cells = parts.select(*keys, "i", F.posexplode("v").alias("j", "x")).groupBy(*keys, "i", "j").agg(F.sum("x").alias("x"))
    return cells.groupBy(*keys, "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda p: p["x"]).alias("v"))


# --- subspaces

#: Up to so many items a product's model is fast: fitted with augmented views, for review alone.
FAST_ITEMS = 4


def roles(rows: DataFrame, views_kept: float = 0.3, product: str = "product", item: str = "item", view: str = "view", seed: int = 2026) -> DataFrame:
    """``rows`` (product, item, view, vector; view 0 is the item itself, others are augmented) with mode and part.

    Products of up to four items are fast: their items and views are in the bank, but the last ``views_kept`` of each item's views (one at least) calibrate. All
    others are standard: views are left out, and a fifth of the items, three at least, is held out where there are ten or more."""
    n = rows.groupBy(product).agg(F.count_distinct(item).alias("n_items"))
    per_item = rows.filter(F.col(view) > 0).groupBy(product, item).agg(F.max(view).alias("n_views"))
    fast = rows.join(n.filter(F.col("n_items") <= FAST_ITEMS), product).join(per_item, [product, item], "left")
    held = F.when(F.coalesce("n_views", F.lit(0)) > 0, F.greatest(F.lit(1), F.floor(F.col("n_views") * views_kept))).otherwise(0)
    fast = fast.withColumn("part", F.when((F.col(view) > 0) & (F.col(view) > F.col("n_views") - held), "cal").otherwise("bank")).withColumn("mode", F.lit("fast"))
    usual = held_out(rows.filter(F.col(view) == 0).join(n.filter(F.col("n_items") > FAST_ITEMS).select(product), product, "left_semi"), [product], item, seed)
    return fast.select(*rows.columns, "part", "mode").unionByName(usual.withColumn("mode", F.lit("standard")).select(*rows.columns, "part", "mode"))


def subspaces(rows: DataFrame, share: float = 0.99, product: str = "product", vector: str = "embedding") -> DataFrame:
    """(product, mean, axes, k, explained, n_vectors): per product the directions that explain ``share`` of the variance of its vectors. Sums per (product, row,
    column) give the moments; eigenvectors are found in the workers, one product's matrix at a time. Products without variance have no model."""
    base = rows.select(product, F.col(vector).cast("array<double>").alias("v")).filter("v is not null")
    found = base.select(product).schema.fields[0]
    kinds = T.StructType([found, *T.StructType.fromDDL("mean array<double>, axes array<array<double>>, k int, explained double, n_vectors long").fields])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.stack(pdf.sort_values("i")["v"].to_numpy())
        d = len(g) - 1
        n, total = g[d, d], g[d, :d]
        values, axes = np.linalg.eigh((g[:d, :d] - np.outer(total, total) / n) / max(1.0, n - 1))
        values, axes = np.clip(values[::-1], 0, None), axes[:, ::-1]
        if values.sum() <= 1e-12:
            return pd.DataFrame(columns=[f.name for f in kinds])
        cum = np.cumsum(values) / values.sum()
        k = max(1, min(int(np.searchsorted(cum, share) + 1), d))
        return pd.DataFrame({product: [pdf[product].iloc[0]], "mean": [total / n], "axes": [list(axes[:, :k].T)], "k": [k], "explained": [cum[k - 1]], "n_vectors": [int(round(n))]})

    return _moment_rows(base, [product]).groupBy(product).applyInPandas(fit, kinds)


def residual_scores(rows: DataFrame, models: DataFrame, product: str = "product", item: str = "item", view: str = "view", vector: str = "embedding", top: float = 0.01) -> DataFrame:
    """(product, item, view, score): per image the mean of the largest ``top`` of its vectors' squared residuals outside the product's subspace."""
    base = rows.select(product, item, view, F.col(vector).cast("array<double>").alias("v")).filter("v is not null")

    def judge(pdf: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["v"].to_numpy()) - np.asarray(model["mean"].iloc[0])
        p = x @ np.stack(model["axes"].iloc[0]).T
        r = pd.Series(np.maximum((x * x).sum(axis=1) - (p * p).sum(axis=1), 0), index=pdf.index)
        worst = lambda s: float(np.sort(s)[-max(1, math.ceil(top * len(s))) :].mean())
        out = pdf[[product, item, view]].assign(score=r).groupby([product, item, view], as_index=False)["score"].agg(worst)
        return out

    kinds = T.StructType([*base.select(product, item, view).schema.fields, T.StructField("score", T.DoubleType())])
    return judged(base, models.select(product, "mean", "axes"), [product], judge, kinds, by=item)


def subspace_verdicts(rows: DataFrame, probes: DataFrame, share: float = 0.99, epsilon: float = 0.02, top: float = 0.01, views_kept: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """(models, verdicts). rows: the good items of products (product, item, view, embedding); probes: items to judge, alike.

    models: product, mode, n_items, k, explained, n_cal, threshold (split conformal; 1.2 times the 99th percentile where fewer than three scores calibrate;
    null without any). verdicts: product, item, score, threshold, verdict: REVIEW in fast mode whatever the score, else NG over the threshold; products without a model
    have no verdict."""
    dealt = saved(roles(rows, views_kept), "roles")
    models = saved(subspaces(dealt.filter("part <> 'cal'"), share), "subspaces")
    cal = residual_scores(dealt.filter("part <> 'bank'"), models, top=top)
    tau = inspection.calibrate(cal, ["product"], epsilon).select("product", F.col("threshold").alias("tau"))
    legacy = inspection.quantile(cal, ["product"], "score", 0.99, "p99").select("product", (F.col("p99") * 1.2).alias("p99"))
    n = cal.groupBy("product").agg(F.count(F.lit(1)).alias("n_cal"))
    about = dealt.filter("part <> 'cal' and view = 0").groupBy("product", "mode").agg(F.count_distinct("item").alias("n_items"))
    full = models.select("product", "k", "explained").join(about, "product").join(n, "product", "left").join(tau, "product", "left").join(legacy, "product", "left")
    full = saved(full.select("product", "mode", "n_items", "k", "explained", F.coalesce("n_cal", F.lit(0)).alias("n_cal"), F.coalesce("tau", "p99").alias("threshold")), "models")
    scores = residual_scores(probes, models, top=top).join(full.select("product", "mode", "threshold"), "product")
    verdict = F.when(F.col("mode") == "fast", "REVIEW").when(F.col("score") > F.col("threshold"), "NG").otherwise("OK")
    return full, scores.select("product", "item", "view", "score", "threshold", "mode", verdict.alias("verdict"))

