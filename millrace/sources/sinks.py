"""Sinks: exports, content-addressed copies, snapshots, label files, and a registry that isolates failures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of the two CSV exports.
CONTRACT_COLUMNS = ["id", "contract_no", "title", "our_party", "counterparty", "signer", "start_date", "end_date", "total_amount", "currency", "direction", "status", "confidence", "reviewed"]
RECEIVABLE_COLUMNS = ["id", "contract_id", "due_date", "amount", "currency", "condition_text", "penalty", "direction", "status", "source"]


def shaped(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with just these columns, absent ones null."""
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns])


def csv_export(contracts: DataFrame, receivables: DataFrame, path: str) -> None:
    shaped(contracts, CONTRACT_COLUMNS).write.mode("overwrite").csv(f"{path}/contracts", header=True)
    shaped(receivables, RECEIVABLE_COLUMNS).write.mode("overwrite").csv(f"{path}/receivables", header=True)


def sheet_rows(contracts: DataFrame, receivables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of a two-sheet workbook: confidence in percent, undated items as 待定, nulls empty."""
    c = shaped(contracts, CONTRACT_COLUMNS).withColumn("confidence", F.concat(F.round(F.col("confidence").cast("double") * 100).cast("int").cast("string"), F.lit("%")))
    r = shaped(receivables, RECEIVABLE_COLUMNS).withColumn("due_date", F.coalesce(F.nullif("due_date", F.lit("")), F.lit("待定")))
    blank = lambda df: df.select(*[F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in df.columns])
    return blank(c), blank(r)


def run_exports(exporters: dict[str, Callable[[], None]], enabled: list[str]) -> dict[str, str]:
    """Each enabled exporter's outcome; one that fails doesn't stop the others."""
    out = {}
    for name in enabled:
        try:
            exporters[name]()
            out[name] = "ok"
        except Exception as e:  # noqa: BLE001
            out[name] = f"failed: {e}"
    return out


def qc_rows(results: DataFrame) -> DataFrame:
    """Inspection results as they are stored: details as JSON of at most 5000 characters, the prompt of at most 200. A cut JSON
    may be broken; readers use try_parse_json."""
    return results.withColumns({"defect_json": F.substring("defect_json", 1, 5000), "barcode_content": F.substring("barcode_content", 1, 200)})


#: The audit columns of a recognised text, with what stands where a record has none; lists are written as JSON.
OCR_DEFAULTS = {"image_path": "", "image_hash": "", "engine": "", "scene": "", "roi_count": 1, "raw_text": "", "corrected_text": "", "confidence": 0.0, "confidence_threshold": 0.75, "verdict": "OK", "elapsed_sec": 0.0, "structured_json": "{}"}
OCR_LISTS = ("ng_regions", "corrections")


def json_list(items: Column) -> Column:
    """A list of texts as JSON, a space after each comma; null is the empty list."""
    one = lambda x: F.regexp_replace(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", "$1")
    return F.coalesce(F.concat(F.lit("["), F.array_join(F.transform(items, one), ", "), F.lit("]")), F.lit("[]"))


def ocr_audit_rows(records: DataFrame) -> DataFrame:
    """Recognition results as they are appended to the audit table. Columns that the records lack take their defaults; the corrected text is
    also kept as text_content."""
    plain = [F.col(c) if c in records.columns else F.lit(v).alias(c) for c, v in OCR_DEFAULTS.items()]
    lists = [(json_list(F.col(c)) if c in records.columns else F.lit("[]")).alias(c) for c in OCR_LISTS]
    text = F.col("corrected_text") if "corrected_text" in records.columns else F.lit("")
    return records.select(*plain, text.alias("text_content"), *lists)


def content_name(content: Column, path: Column) -> Column:
    """Name of a content-addressed copy: 16 hex digits and the extension."""
    return F.concat(F.substring(F.sha1(content), 1, 16), F.coalesce(F.regexp_extract(path, r"(\.[^./]+)$", 1), F.lit("")))


def snapshot(rows: DataFrame, root: str, stamp: str, keep: int = 5) -> list[str]:
    """Write a snapshot folder and delete all but the newest ``keep``."""
    rows.write.mode("overwrite").parquet(f"{root}/snapshot={stamp}")
    jvm, conf = rows.sparkSession._jvm, rows.sparkSession._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(conf)
    names = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().startswith("snapshot="))
    for old in names[:-keep]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{root}/{old}"), True)
    return names[-keep:]


def archive(rows: DataFrame, path: str) -> None:
    """Calibration sessions by product and session."""
    rows.write.mode("append").partitionBy("product", "session").parquet(path)


def yolo_lines(boxes: DataFrame, classes: list[str]) -> DataFrame:
    """One text line per box: class, centre and size over the image, six decimals. Boxes are clipped; those of 1 px or less go."""
    x1, y1 = F.greatest("xmin", F.lit(0.0)), F.greatest("ymin", F.lit(0.0))
    x2, y2 = F.least("xmax", F.col("width").cast("double")), F.least("ymax", F.col("height").cast("double"))
    kind = F.array_position(F.array(*map(F.lit, classes)), F.col("label")) - 1
    rows = boxes.withColumns({"__k": kind, "__x1": x1, "__y1": y1, "__w": x2 - x1, "__h": y2 - y1}).filter("__k >= 0 and __w > 1 and __h > 1")
    w, h = F.col("width"), F.col("height")
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "__k", (F.col("__x1") + F.col("__w") / 2) / w, (F.col("__y1") + F.col("__h") / 2) / h, F.col("__w") / w, F.col("__h") / h)
    return rows.select("filename", line.alias("line"))
