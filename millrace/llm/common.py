"""What the operators of this package share: reading documents and cutting lineage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.ranks import gapless
from millrace.storage import drop_saved, intermediates, saved, shared_dir

__all__ = ["by_row", "documents", "drop_saved", "free_name", "id_text", "intermediates", "partitions", "saved", "shared_dir", "sorted_side"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, under fixed names, so that further columns can never clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def by_row(base: DataFrame, operate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``operate(base)`` for an operator that knows documents by their id, also where an id stands for several texts: such tables get a number for every
    (id, text digest), in that order, in place of the id, and the ids back at the end. Rows that agree in both are one document; null ids stay null."""
    digest = F.unhex(F.md5(F.col("text").cast("binary")))
    named = base.filter("doc_id is not null").select("doc_id", digest.alias("t"))
    several = named.groupBy("doc_id").agg((F.min("t") != F.max("t")).alias("several")).filter("several")
    if several.isEmpty():
        return operate(base)
    names = saved(gapless(named.distinct(), [], ["doc_id", "t"], "number"), "names")
    to_number = names.select(F.col("doc_id").alias("n_id"), F.col("t").alias("n_t"), "number")
    rows = base.withColumn("t", digest).join(sorted_side(to_number), (F.col("doc_id") == F.col("n_id")) & (F.col("t") == F.col("n_t")), "left")
    out = operate(saved(rows.select(F.col("number").alias("doc_id"), "text"), "numbered"))
    back = out.join(sorted_side(names.select(F.col("doc_id").alias("n_id"), "number")), F.col("doc_id") == F.col("number"), "left")
    return back.select(F.col("n_id").alias("doc_id"), *[c for c in out.columns if c != "doc_id"])


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not use yet."""
    used = {c.lower() for c in df.columns}
    name = f"__mr_{stem}"
    while any(c.startswith(name) for c in used):
        name += "_"
    return name


def sorted_side(df: DataFrame) -> DataFrame:
    """The side of a join with whole texts, always by sort-merge: the plan, and what it shuffles, is the same at every size,
    and no side whose size follows the input is broadcast."""
    return df.hint("merge")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
