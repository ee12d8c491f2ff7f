"""Exact deduplication by 128-bit content hash, with a byte comparison inside every group.

Two texts are equal when they are identical after every space, tab, line feed, vertical tab, form feed and
carriage return is deleted. Rows are grouped by the MD5 of the normalised text. The same aggregation carries
the smallest and the largest normalised text of the group: they are equal exactly when all bytes of the group
are, so a collision of the hash cannot hide. Groups in which they differ are regrouped by the text itself.

The aggregation combines on the map side, so a text that a third of all rows repeat reaches the reducers as one
row per task. Rows then meet their group through an inner join on the hash, which adaptive execution may split.

Defined cases: a null text counts as empty, and all empty texts are one group; a null id ranks last in its group
and can stay only if no row of the group has an id; of rows that repeat the id that stays only the longest are kept, and rows that repeat an id *and* its text
tie in every respect and share their fate. An empty table gives an empty result. Columns other than id and text
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, free_name, id_text, saved, sorted_side

WHITE = " \t\n\x0b\x0c\r"


def content_hash(norm: Column) -> Column:
    """128 bits of the normalised text."""
    return F.unhex(F.md5(norm.cast("binary")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash=content_hash) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_codepoints."""
    base = id_text(docs, id_col, text_col)
    norm = base.select("doc_id", F.char_length("text").alias("n_codepoints"), F.translate("text", WHITE, "").alias("norm"))
    hashed = norm.withColumn("h", content_hash(F.col("norm")))
    best = F.max(F.struct(F.col("n_codepoints").alias("n"), (-F.col("doc_id")).alias("d")))
    groups = saved(
        hashed.groupBy("h")
        .agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"), (F.min("norm") != F.max("norm")).alias("collides"))
        .select("h", (-F.col("best.d")).alias("keep_id"), F.col("best.n").alias("keep_n"), "group_size", "collides"),
        "exact",
    )
    rows = hashed.select("doc_id", "n_codepoints", "h", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))
    pure = rows.join(groups.filter(~F.col("collides")).drop("collides"), "h")
    if groups.filter("collides").isEmpty():
        return _result(pure)
    # Different texts under one hash: those few groups are formed again by the text itself.
    clash = hashed.join(groups.filter("collides").select("h"), "h", "left_semi")
    again = clash.groupBy("h", "norm").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    again = again.select("h", "norm", (-F.col("best.d")).alias("keep_id"), F.col("best.n").alias("keep_n"), "group_size")
    mixed = clash.join(again, ["h", "norm"]).withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256))
    return _result(pure).unionByName(_result(mixed))


def _result(df: DataFrame) -> DataFrame:
    return df.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_codepoints") == F.col("keep_n"))).alias("kept"),
        "text_sha256",
        F.col("n_codepoints").cast("long").alias("n_codepoints"),
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns. Rows are rejected by id, normalised text and length, so an id's longest row stays; of rows that agree in
    all three, any one stays."""
    this, text_key, length = (free_name(docs, x) for x in ("exact_id", "exact_text", "exact_length"))
    flags = exact_dedup(docs).filter(~F.col("kept")).select(F.col("doc_id").alias(this), F.col("text_sha256").alias(f"{text_key}_gone"), F.col("n_codepoints").alias(f"{length}_gone")).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.withColumns({text_key: F.sha2(F.translate(text, WHITE, "").cast("binary"), 256), length: F.char_length(text)})
    same = F.col("doc_id").eqNullSafe(F.col(this)) & (F.col(text_key) == F.col(f"{text_key}_gone")) & (F.col(length) == F.col(f"{length}_gone"))
    return named.join(sorted_side(flags), same, "left_anti").dropDuplicates(["doc_id", text_key, length]).drop(text_key, length)


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = {
    "op3_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), r AS (
  SELECT doc_id, norm,
    first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY norm) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""
}
