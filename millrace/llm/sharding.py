"""Sharding by a hierarchical weighted hash tree, with DataFrame functions only.

Shards are the leaves of a tree: regions hold racks, racks hold shards. A node's weight is the sum of its leaves' weights. At each
level a document draws -ln(u) / w for each child of the node it has reached, u being a uniform hash of the document's id
and the child, and goes to the child with the least draw: children are chosen in proportion to their weights. So the work per
document follows the depth and the fan-out of the tree, not the number of shards. When the weight of a leaf rises, draws change
only on the path to it: documents move into its region, into its rack and into it, and every other node keeps
its draws, so nothing moves between other regions, nor, in its region, among documents that were there, between other racks.

Inner nodes are sealed: a further shard is appended as a region of its own (``topology(n, sealed)``), so that it takes
documents only into itself. A new shard inside a sealed rack would also raise the rack's and the region's weight.

The law is ``key``: the id and the shards decide, texts don't. Slots inside a shard are gapless: a shard is cut
into hash buckets, each numbered on its own, and the running sum of bucket sizes is added; so no task holds a shard.

Defined cases: a null text is empty (its checksum 0, its size 8); a null id is drawn as the word 'null'; rows that repeat an
id share a shard and get a slot each; shards of weight 0 get nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, free_name, id_text, partitions, saved

Tree = list[tuple[int, list[tuple[int, list[tuple[int, float]]]]]]


def topology(shards: int, sealed: int | None = None, racks_per_region: int = 4, shards_per_rack: int = 3) -> Tree:
    """Regions of racks of (shard, weight): the first ``sealed`` shards (all, by default) in full regions and racks, each later one
    as a region of its own."""
    base = shards if sealed is None else min(sealed, shards)
    racks = list(enumerate([(s, 1.0) for s in range(at, min(at + shards_per_rack, base))] for at in range(0, base, shards_per_rack)))
    regions = [racks[at : at + racks_per_region] for at in range(0, len(racks), racks_per_region)]
    regions += [[(len(racks) + i, [(s, 1.0)])] for i, s in enumerate(range(base, shards))]
    return list(enumerate(regions))


def _chosen(key: Column, children: list[tuple[str, float, int]], seed: int) -> Column:
    """The number of the child (name, weight, number) with the least draw. Each draw takes 52 bits of a hash; u is never 0."""
    if len(children) == 1:
        return F.lit(children[0][2])

    def draw(name: str, weight: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(F.concat(key, F.lit(f"/{name}/{seed}"))), 12)
        return -F.log((bits.cast("double") + 0.5) / float(1 << 52)) / F.lit(float(weight))

    return F.array_min(F.array(*[F.struct(draw(n, w).alias("draw"), F.lit(i).alias("i")) for n, w, i in children]))["i"]


def placed(df: DataFrame, key: Column, tree: Tree, out: str, seed: int = 17) -> DataFrame:
    """``df`` with the shard of ``key`` as column ``out``: one descent over regions, racks and shards."""
    region, rack = free_name(df, "region"), free_name(df, "rack")
    of_rack = lambda leaves: sum(w for _, w in leaves)
    live = [(r, [(k, [(s, w) for s, w in leaves if w > 0]) for k, leaves in racks if of_rack(leaves) > 0]) for r, racks in tree]
    live = [(r, racks) for r, racks in live if racks]

    def by(number: Column, branches: list[tuple[int, Column]]) -> Column:
        return reduce(lambda rest, x: F.when(number == x[0], x[1]).otherwise(rest), reversed(branches[:-1]), branches[-1][1])

    df = df.withColumn(region, _chosen(key, [(f"region{r}", sum(of_rack(leaves) for _, leaves in racks), r) for r, racks in live], seed))
    df = df.withColumn(rack, by(F.col(region), [(r, _chosen(key, [(f"rack{k}", of_rack(leaves), k) for k, leaves in racks], seed)) for r, racks in live]))
    all_racks = [x for _, racks in live for x in racks]
    return df.withColumn(out, by(F.col(rack), [(k, _chosen(key, [(f"shard{s}", w, s) for s, w in leaves], seed)) for k, leaves in all_racks])).drop(region, rack)


def with_slots(df: DataFrame, group: str, order: list[str], slot: str) -> DataFrame:
    """Gapless numbers from 0 inside each group, without gathering a group in one task."""
    spark = df.sparkSession
    n_buckets = max(1, partitions(spark) // 2)
    dealt = df.withColumn("__mr_b", F.pmod(F.xxhash64(*order), F.lit(n_buckets)))
    sizes = dealt.groupBy(group, "__mr_b").agg(F.count(F.lit(1)).alias("__mr_n"))
    before = Window.partitionBy(group).orderBy("__mr_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(group, "__mr_b", F.coalesce(F.sum("__mr_n").over(before), F.lit(0)).alias("__mr_start"))
    inside = F.row_number().over(Window.partitionBy(group, "__mr_b").orderBy(*order))
    numbered = dealt.withColumn("__mr_i", inside.cast("long") - 1)
    return numbered.join(starts, [group, "__mr_b"]).withColumn(slot, F.col("__mr_start") + F.col("__mr_i")).drop("__mr_b", "__mr_i", "__mr_start")


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", tree: Tree | None = None, grown: Tree | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    tree, grown = tree or topology(shards), grown or topology(shards + 1, sealed=shards)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    raw = F.col("text").cast("binary")
    rows = id_text(docs, id_col, text_col).select("doc_id", (F.octet_length("text") + F.lit(8)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = placed(placed(rows.withColumn("law", F.lit("key")), key, tree, "shard"), key, grown, "grown_shard")
    rows = saved(rows, "shards")
    return with_slots(rows, "shard", ["doc_id", "text_crc32", "size"], "slot").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir), 24)
