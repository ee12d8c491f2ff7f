"""Sources: annotations, label files, XML boxes, NPZ banks, images, paired files, documents, OCR results, logs, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_PAGE = 30  # a page with so many characters needs no recognition
OCR_RESULT = "struct<text:string,lines:array<struct<text:string,box:array<array<double>>,confidence:double>>,confidence:double,engine:string>"
VOC = T.StructType(
    [
        T.StructField("filename", T.StringType()),
        T.StructField("size", T.StructType([T.StructField(c, T.IntegerType()) for c in ("width", "height", "depth")])),
        T.StructField("object", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("bndbox", T.StructType([T.StructField(c, T.DoubleType()) for c in ("xmin", "ymin", "xmax", "ymax")]))]))),
    ]
)


def table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def jdbc_table(spark: SparkSession, url: str, name: str, driver: str) -> DataFrame:
    """A table of a relational store; the driver's jar must be on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, driver=driver).load()


def annotation_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True, schema="filename string, text string", multiLine=True, escape='"')
    return rows.select(F.ltrim(F.regexp_replace("filename", "^﻿", "")).alias("filename"), F.trim("text").alias("text"))


def tab_labels(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``path<TAB>text``, cut at the first tab; lines without one are left out."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).filter(F.col("value").contains("\t")).select(parts[0].alias("path"), parts[1].alias("text"))


def label_from_name(path: Column) -> Column:
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.translate(stem, "_-", "  ")


def class_from_name(path: Column) -> Column:
    """The class in a file name of the form NN_<class>_MM: what stands between the first and the last part, else '?'."""
    parts = F.split(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", ""), "_")
    return F.when(F.size(parts) >= 3, F.array_join(F.slice(parts, F.lit(2), F.size(parts) - 2), "_")).otherwise("?")


def voc_boxes(spark: SparkSession, path: str, classes: list[str] | None = None) -> DataFrame:
    """One row per object; class names in lower case, only listed ones if a list is given."""
    rows = spark.read.format("xml").option("rowTag", "annotation").schema(VOC).load(path)
    out = rows.select("filename", "size.width", "size.height", F.explode("object").alias("o")).select("filename", "width", "height", F.lower("o.name").alias("label"), "o.bndbox.*")
    return out.filter(F.col("label").isin(classes)) if classes else out


def images(spark: SparkSession, path: str, pattern: str = "*.{jpg,jpeg,png,bmp,tif,tiff}", recursive: bool = True) -> DataFrame:
    """Image files; contents are read only if they are used."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)


def mask_defect(content: Column) -> Column:
    """Whether an uncompressed bitmap has any pixel byte set: the pixels start where bytes 11 to 14 (little-endian) say."""
    at = F.conv(F.hex(F.concat(*[F.substring(content, i, 1) for i in (14, 13, 12, 11)])), 16, 10).cast("int")
    return F.hex(F.substr(content, at + 1)).rlike("[1-9A-F]")


def paired(images: DataFrame, masks: DataFrame, suffix: str = "_label") -> DataFrame:
    """Images with their masks (name plus suffix); a mask with any pixel byte set marks a defect. Masks without contents bring
    their own column ``defect``."""
    stem = lambda c: F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.[^.]*$", "")
    defect = F.col("defect") if "defect" in masks.columns else mask_defect(F.col("content"))
    m = masks.select(F.regexp_replace(stem(F.col("path")), f"{suffix}$", "").alias("stem"), defect.alias("defect"))
    return images.withColumn("stem", stem(F.col("path"))).join(m, "stem", "left")


def document_route(path: Column, text: Column) -> Column:
    """How a page is read: its text layer, recognition, or not at all."""
    ext = F.lower(F.element_at(F.split(path, r"\."), -1))
    return F.when(ext == "djvu", "rejected").when((ext == "pdf") & (F.length(F.trim(text)) >= TEXT_PAGE), "text").when(ext.isin("pdf", "tif", "tiff", "heic", "jpg", "jpeg", "png", "bmp"), "ocr").otherwise("rejected")


def joined_pages(pages: DataFrame) -> DataFrame:
    """(path, page, text) to one text per document: pages that aren't blank, in order, a blank line between them."""
    got = F.array_sort(F.collect_list(F.struct("page", "text")))
    return pages.groupBy("path").agg(got.alias("p")).select("path", F.size("p").alias("pages"), F.array_join(F.transform(F.filter("p", lambda x: F.trim(x["text"]) != ""), lambda x: x["text"]), "\n\n").alias("text"))


def ocr_result(boxes: Column, texts: Column, scores: Column, engine: str) -> Column:
    """Parallel arrays of an OCR engine as one result; missing scores count as 0, the shortest of boxes and texts decides."""
    n = F.least(F.size(boxes), F.size(texts))
    lines = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.struct(F.get(texts, i).alias("text"), F.get(boxes, i).alias("box"), F.coalesce(F.get(scores, i), F.lit(0.0)).alias("confidence")))
    lines = F.when(n > 0, lines).otherwise(F.slice(lines, 1, 0))
    mean = F.when(n > 0, F.aggregate(lines, F.lit(0.0), lambda s, x: s + x["confidence"]) / n).otherwise(0.0)
    return F.struct(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("text"), lines.alias("lines"), F.round(mean, 4).alias("confidence"), F.lit(engine).alias("engine"))


def json_log(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    schema = "ts string, level string, logger string, msg string, exc string"
    return (spark.readStream if streaming else spark.read).schema(schema).json(path)


def evaluation_report(spark: SparkSession, path: str) -> DataFrame:
    """Reports {summary, results: {file: {...}}}: one row per file."""
    schema = "results map<string, struct<prediction:string, ground_truth:string, exact_match:boolean, cer:double, confidence:double, elapsed_ms:double>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode("results").alias("file", "r")).select("file", "r.*")


def npz_bank(spark: SparkSession, path: str, key: str = "bank") -> DataFrame:
    """Vectors of NPZ files, one row each; pickled contents are refused."""

    def load(frames):
        import io

        import numpy as np
        import pandas as pd

        for pdf in frames:
            for p, raw in zip(pdf["path"], pdf["content"], strict=True):
                bank = np.load(io.BytesIO(raw), allow_pickle=False)[key]
                yield pd.DataFrame({"path": p, "row": range(len(bank)), "embedding": list(bank.astype("float32"))})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(load, "path string, row int, embedding array<float>")
