"""A Merkle manifest of a dataset: digests of all rows, one root, and for each row the proof that leads to it.

Rows of one part (here: a language) are the leaves of one tree, in the order of their ids; every run of eight neighbours becomes one node of the level
above until one node, the part's subroot, remains. The subroots, in the order of their parts, are the leaves of the tree whose last node is the root.

Built bottom-up: leaves get gapless ranks through a range sort (rows per range and part, summed over the ranges before), and each level is one
aggregation by run number and a written table, an eighth of the one below. Proofs are pushed top-down: from the root's level to the leaves, each level's nodes are joined to
their parents, and a child prepends its siblings, as the text left and right of it, to the proof it inherits. A group is never larger than a
run, however many rows a part has; a level needs as many jobs whatever its size, and their number grows with the logarithm of the rows.

A leaf's proof folds back to the root: the digest of left text, own digest and right text, once a level. A row that was altered folds to another value.

Defined cases: every null field is written as '-' in a leaf; null ids come first, and rows that share an id are ordered by their leaf (identical rows are leaves
of their own, side by side); a null part is a part of its own, before the others; an empty table gives an empty result; other columns are ignored; a row without an id is
never altered in the check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, drop_saved, saved

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """'-' for null, else the number of UTF-8 bytes, ':' and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: dict[str, Column]) -> Column:
    return digest(F.concat(*[field(columns[c]) for c in FIELDS]))


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _ranked(leaves: DataFrame, part: str, order: list[str]) -> DataFrame:
    """``leaves`` with rank, gapless from 0 in every part in the order of the columns, and n, the part's rows."""
    dealt = leaves.repartitionByRange(part, *order).sortWithinPartitions(part, *order)
    at = saved(dealt.withColumn("at", F.monotonically_increasing_id()), "ordered")  # range number << 33, plus the place in the range
    of_range = at.groupBy(part, F.shiftright("at", 33).alias("range")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    # One row per range and part: a range holds neighbouring parts, so there are fewer of them than ranges and parts together.
    whole = Window.partitionBy(part)
    before = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")
    starts = of_range.select(F.col(part).alias("p"), "range", shift.alias("shift"), F.sum("rows").over(whole).alias("n"))
    rows = at.withColumn("range", F.shiftright("at", 33)).alias("r")
    out = rows.join(starts.alias("s"), (F.col("r.range") == F.col("s.range")) & (F.col(f"r.{part}") == F.col("s.p")))
    out = out.select(*[f"r.{c}" for c in leaves.columns], (F.col("at") + F.col("shift")).alias("rank"), "n")
    out._millrace_path = at._millrace_path
    return out


def _levels(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The written levels above ``nodes`` (tree, rank, n, h; n nodes of the tree on its level): tree, rank, n, kids, h. kids are the digests of the run
    that a node stands for. A tree whose level has one node has no level above it."""
    out = []
    run = F.expr(f"rank div {FAN}").alias("run")
    while True:
        runs = nodes.filter("n > 1").groupBy("tree", run).agg(F.sort_array(F.collect_list(F.struct("rank", "h"))).alias("kids"), F.max("n").alias("below"))
        runs = runs.select("tree", F.col("run").alias("rank"), F.expr(f"(below + {FAN - 1}) div {FAN}").alias("n"), F.col("kids.h").alias("kids"))
        level = saved(runs.withColumn("h", digest(F.array_join("kids", ""))), f"{name}{len(out)}")
        if level.isEmpty():
            drop_saved(level)
            return out
        out.append(level)
        nodes = level


#: One step of a proof: the digests left and right of a node in its run, joined.
_STEP = "array<struct<l:string,r:string>>"


def _inherit(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """``nodes`` (tree, rank, any others) with what their parents have: the proof, their own siblings put before it, and the subroot."""
    p = parents.select(F.col("tree").alias("p_tree"), F.col("rank").alias("p_rank"), F.col("kids").alias("p_kids"), F.col("proof").alias("above"), "subroot")
    both = nodes.join(p, (F.col("tree") == F.col("p_tree")) & (F.expr(f"rank div {FAN}") == F.col("p_rank")))
    place = (F.col("rank") % FAN).cast("int")
    step = F.struct(F.array_join(F.slice("p_kids", F.lit(1), place), "").alias("l"), F.array_join(F.slice("p_kids", place + 2, F.lit(FAN)), "").alias("r"))
    return both.withColumn("proof", F.concat(F.array(step), F.col("above"))).drop("p_tree", "p_rank", "p_kids", "above")


def _push(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """``nodes`` (tree, rank, n, others) with proof and subroot. tops: what the last node of each tree has (tree, proof, subroot)."""
    above = None
    for level in reversed(levels):
        # The last node of a tree stands alone on its level.
        now = level.filter("n = 1").join(tops, "tree").select("tree", "rank", "kids", "proof", "subroot")
        if above is not None:
            now = now.unionByName(_inherit(level.filter("n > 1"), above).select("tree", "rank", "kids", "proof", "subroot"))
        now = saved(now, "proofs")
        if above is not None:
            drop_saved(above)
        above = now
    out = nodes.filter("n = 1").join(tops, "tree")
    return out if above is None else out.unionByName(_inherit(nodes.filter("n > 1"), above).select(*out.columns))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf digest and a proof lead to."""
    return F.aggregate(proof, leaf, lambda h, step: digest(F.concat(step["l"], h, step["r"])))


def merkle_manifest(docs: DataFrame, part: str = "lang", altered: Column | None = None) -> DataFrame:
    """One row per document: doc_id, tree, rank, leaf, subroot, root, proof (steps upward), changed (digest of the row as it would be
    altered; the leaf where it is not). ``altered``: which rows the check alters, by lower-casing their text."""
    altered = F.lit(False) if altered is None else altered
    cols = {c: F.col(c) for c in FIELDS}
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").alias("n_chars"), F.col("text").cast("string").alias("text"), F.col(part).cast("string").alias("part"))
    # Trees are named by their part; the null part's name starts with a byte that sorts before all others.
    tree = F.coalesce(F.concat(F.lit("1"), "part"), F.lit("0"))
    leaf = leaf_digest(cols)
    changed = F.when(altered, leaf_digest(cols | {"text": lowered(F.col("text"))}))
    leaves = saved(base.select("doc_id", tree.alias("tree"), leaf.alias("h"), changed.alias("changed")), "leaves")
    nodes = _ranked(leaves, "tree", ["doc_id", "h"])
    ranked = saved(nodes, "ranked")
    drop_saved(leaves, nodes)
    levels = _levels(ranked.select("tree", "rank", "n", "h"), "level")
    subroots = ranked.filter("n = 1").select("tree", "h")
    for level in levels:
        subroots = subroots.unionByName(level.filter("n = 1").select("tree", "h"))
    # The tree of subroots, built in the same way; its own last node is the root.
    subroots = saved(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "h"), "subroots")
    ordered = _ranked(subroots, "tree", ["name"])
    tops = saved(ordered, "tops")
    drop_saved(subroots, ordered)
    top_levels = _levels(tops.select("tree", "rank", "n", "h"), "top")
    last = (top_levels[-1] if top_levels else tops).select("h").first()
    root = F.lit(last.h if last else None).cast("string")
    start = tops.sparkSession.createDataFrame([("", [], "")], f"tree string, proof {_STEP}, subroot string")
    of_tree = saved(_push(tops, top_levels, start).select(F.col("name").alias("tree"), "proof", F.col("h").alias("subroot")), "of-tree")
    rows = _push(ranked, levels, of_tree)
    drop_saved(tops, *top_levels, *levels)
    return rows.select("doc_id", "tree", "rank", F.col("h").alias("leaf"), "subroot", root.alias("root"), "proof", F.coalesce("changed", "h").alias("changed"))


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    rows = merkle_manifest(documents(spark, sf_dir), "lang", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)
    texts = F.transform("proof", lambda s: F.concat(s["l"], s["r"]))
    out = rows.withColumn("folded_root", fold(F.col("changed"), F.col("proof")))
    return out.select("doc_id", "leaf", "subroot", "root", digest(F.array_join(texts, "")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


SQL = {
    "op13_merkle": r"""
WITH RECURSIVE bits AS (
  -- crc32 by bits: each byte is xored in, then eight shifts (marked -1) follow.
  SELECT DISTINCT doc_id, list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [unicode(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))) AS steps
  FROM documents WHERE doc_id IS NOT NULL
), crc AS (
  SELECT doc_id, xor(list_reduce(steps, lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) AS crc FROM bits
), d AS (
  SELECT doc_id, lang,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS low
  FROM documents
), leaves AS (
  SELECT d.doc_id, coalesce('1' || lang, '0') AS tree, sha256(head || tail) AS h, CASE WHEN crc % 3 = 0 THEN sha256(head || low) ELSE sha256(head || tail) END AS changed
  FROM d LEFT JOIN crc ON crc.doc_id = d.doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS rank, count(*) OVER (PARTITION BY tree) AS n FROM leaves
), up(level, tree, rank, h, n) AS (
  SELECT 0, tree, rank, h, n FROM ranked
  UNION ALL
  SELECT level + 1, tree, rank // 8, sha256(string_agg(h, '' ORDER BY rank)), any_value((n + 7) // 8) FROM up WHERE n > 1 GROUP BY level, tree, rank // 8
), subroots AS (
  SELECT tree, h, level AS height, row_number() OVER (ORDER BY encode(tree)) - 1 AS rank, count(*) OVER () AS n FROM up WHERE n = 1
), crown(level, rank, h, n) AS (
  SELECT 0, rank, h, n FROM subroots
  UNION ALL
  SELECT level + 1, rank // 8, sha256(string_agg(h, '' ORDER BY rank)), any_value((n + 7) // 8) FROM crown WHERE n > 1 GROUP BY level, rank // 8
), root AS (
  SELECT h, level AS height FROM crown WHERE n = 1
), nodes AS (
  SELECT tree, level, rank, h FROM up WHERE n > 1
  UNION ALL
  SELECT s.tree, s.height + o.level, o.rank, o.h FROM crown o, subroots s WHERE o.n > 1
), runs AS (
  SELECT tree, level, rank // 8 AS run, list(h ORDER BY rank) AS hs FROM nodes GROUP BY tree, level, rank // 8
), walk(doc_id, tree, leaf, changed, level, place, top, last, proof, folded) AS (
  SELECT r.doc_id, r.tree, r.h, r.changed, 0, CASE WHEN r.n = 1 THEN s.rank ELSE r.rank END, s.height, s.height + (SELECT height FROM root), '', r.changed
  FROM ranked r JOIN subroots s ON s.tree = r.tree
  UNION ALL
  SELECT w.doc_id, w.tree, w.leaf, w.changed, w.level + 1,
    CASE WHEN w.level + 1 = w.top THEN (SELECT s.rank FROM subroots s WHERE s.tree = w.tree) ELSE w.place // 8 END, w.top, w.last,
    w.proof || array_to_string(list_slice(hs, 1, w.place % 8), '') || array_to_string(list_slice(hs, w.place % 8 + 2, 8), ''),
    sha256(array_to_string(list_slice(hs, 1, w.place % 8), '') || w.folded || array_to_string(list_slice(hs, w.place % 8 + 2, 8), ''))
  FROM walk w JOIN runs ON runs.tree = w.tree AND runs.level = w.level AND runs.run = w.place // 8
  WHERE w.level < w.last
)
SELECT w.doc_id, w.leaf, s.h AS subroot, root.h AS root, sha256(w.proof) AS proof_sha256, w.folded AS folded_root, w.folded = root.h AS verified
FROM walk w JOIN subroots s ON s.tree = w.tree, root WHERE w.level = w.last
"""
}
