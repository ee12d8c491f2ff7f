"""Queries of sources, sinks, scalar functions and smaller operators, with their DuckDB counterparts."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from millrace.functions import geometry, scores
from millrace.functions import text as tx
from millrace.operators import inspection as op
from millrace.operators import receivables as rc
from millrace.sources import readers, sinks
from millrace.storage import shared_dir

from .proxies import tables, with_sql

QUERIES, SQL = {}, {}


def query(*needs, sql=None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*tables(spark, sf_dir, *needs))
        if sql:
            SQL[f.__name__] = with_sql(sql, *needs)
        return f

    return add


def on_table(name: str, sql=None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(readers.table(spark, f"{sf_dir}/{name}.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@on_table("lineitem", "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01' AND l_returnflag = 'R'")
def s1_table_scan(t):
    return t.filter((F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp")) & (F.col("l_returnflag") == "R")).select("l_orderkey", "l_extendedprice")


@on_table("part", "SELECT p_partkey, translate(concat(replace(p_name, ' ', '_'), '-', p_brand), '_-', '  ') AS label FROM part")
def s5_label_from_name(t):
    path = F.concat(F.lit("/d/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("-"), F.col("p_brand"), F.lit(".png"))
    return t.select("p_partkey", readers.label_from_name(path).alias("label"))


def _written(df, kind: str, **options) -> str:
    """``df`` in files of another format, in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/millrace/{kind}-{uuid.uuid4().hex}"
    df.write.format(kind).options(**options).save(path)
    return path


@on_table("part", "SELECT concat('p', CAST(p_partkey AS VARCHAR), '.jpg') AS filename, trim(concat(p_name, ', \"', p_brand, '\"')) AS text FROM part")
def s3_annotation_csv(t):
    """Annotations written as CSV and read back."""
    rows = t.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("filename"), F.concat(F.lit(" "), "p_name", F.lit(', "'), "p_brand", F.lit('"')).alias("text"))
    return readers.annotation_csv(t.sparkSession, _written(rows, "csv", header=True, escape='"'))


@on_table("part", "SELECT concat('d/', CAST(p_partkey AS VARCHAR)) AS path, concat(p_name, chr(9), p_brand) AS text FROM part WHERE p_size % 7 <> 0")
def s4_tab_labels(t):
    """Label lines written as text and read back; lines without a tab are no labels."""
    line = F.when(F.col("p_size") % 7 == 0, F.col("p_name")).otherwise(F.concat(F.lit("d/"), F.col("p_partkey").cast("string"), F.lit("\t"), "p_name", F.lit("\t"), "p_brand"))
    return readers.tab_labels(t.sparkSession, _written(t.select(line.alias("value")), "text"))


@query("boxes", sql="""
SELECT concat('f', CAST(frame_id AS VARCHAR), '.jpg') AS filename, 640 AS width, 480 AS height, lower(label) AS label, x1 AS xmin, y1 AS ymin, x2 AS xmax, y2 AS ymax FROM boxes WHERE label IN ('R', 'N')""")
def s6_voc_boxes(b):
    """Annotations written as XML, one element a frame, and read back. The files are compressed, as plain XML is many times its table; a compressed file is read by one
    task, so a file holds a bounded number of frames."""
    box = F.struct(F.col("label").alias("name"), F.struct(F.col("x1").alias("xmin"), F.col("y1").alias("ymin"), F.col("x2").alias("xmax"), F.col("y2").alias("ymax")).alias("bndbox"))
    size = F.struct(F.lit(640).alias("width"), F.lit(480).alias("height"), F.lit(3).alias("depth"))
    frames = b.groupBy("frame_id").agg(F.collect_list(box).alias("object")).select(F.concat(F.lit("f"), F.col("frame_id").cast("string"), F.lit(".jpg")).alias("filename"), size.alias("size"), "object")
    return readers.voc_boxes(b.sparkSession, _written(frames, "xml", rootTag="annotations", rowTag="annotation", compression="gzip", maxRecordsPerFile=100_000), ["r", "n"])


@on_table("events", "SELECT CAST(event_id AS VARCHAR) AS ts, CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END AS level, event_type AS logger, props AS msg, CASE WHEN event_type = 'error' THEN concat('Error ', CAST(user_id AS VARCHAR)) END AS exc FROM events")
def s13_json_log(e):
    """Log lines written as JSON and read with the schema of the log."""
    error = F.col("event_type") == "error"
    rows = e.select(F.col("event_id").cast("string").alias("ts"), F.when(error, "ERROR").otherwise("INFO").alias("level"), F.col("event_type").alias("logger"), F.col("props").alias("msg"), F.when(error, F.concat(F.lit("Error "), F.col("user_id").cast("string"))).alias("exc"))
    return readers.json_log(e.sparkSession, _written(rows, "json"))


@query("files", sql="""
SELECT id, CASE id % 5 WHEN 0 THEN 'rejected' WHEN 1 THEN CASE WHEN length(trim(content)) >= 30 THEN 'text' ELSE 'ocr' END WHEN 2 THEN 'ocr' WHEN 3 THEN 'ocr' ELSE 'rejected' END AS route FROM files""")
def s10_document_route(f):
    ext = F.element_at(F.array(*map(F.lit, ("djvu", "PDF", "tiff", "heic", "docx"))), (F.col("id") % 5 + 1).cast("int"))
    return f.select("id", readers.document_route(F.concat(F.lit("a."), ext), F.col("content")).alias("route"))


@on_table("conversations", "SELECT conv_id, count(*) AS pages, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn, text) FILTER (WHERE trim(text) <> ''), '') AS text FROM conversations GROUP BY conv_id")
def s10_joined_pages(t):
    p = readers.joined_pages(t.select(F.col("conv_id").alias("path"), F.col("turn").alias("page"), "text"))
    return p.select(F.col("path").alias("conv_id"), F.col("pages").cast("long").alias("pages"), "text")


@on_table("conversations", "SELECT conv_id, string_agg(role, chr(10) ORDER BY turn, role) AS text, round(avg(turn / 10.0), 4) AS confidence, count(*) AS n_lines FROM conversations GROUP BY conv_id")
def s11_ocr_result(t):
    got = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    r = readers.ocr_result(F.transform("x", lambda v: F.array(F.array(v["turn"].cast("double")))), F.transform("x", lambda v: v["role"]), F.transform("x", lambda v: v["turn"] / F.lit(10.0)), "e")
    return got.select("conv_id", r.alias("r")).select("conv_id", "r.text", "r.confidence", F.size("r.lines").cast("long").alias("n_lines"))


@on_table("events", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def s13_json_field(t):
    return t.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("contracts", sql="SELECT id, contract_no, title, NULL AS our_party, counterparty, signer, NULL AS start_date, NULL AS end_date, total_amount, NULL AS currency, direction, status, confidence, reviewed FROM contracts")
def k1_export_columns(c):
    return sinks.shaped(c, sinks.CONTRACT_COLUMNS)


@query("receivables", "contracts", sql="""
SELECT CAST(id AS VARCHAR) AS id, CAST(contract_id AS VARCHAR) AS contract_id, coalesce(due_date, '待定') AS due_date, currency, direction, status FROM receivables""")
def k2_sheet_rows(r, c):
    return sinks.sheet_rows(c, r)[1].select("id", "contract_id", "due_date", "currency", "direction", "status")


@query("qc_results", sql="SELECT id, substr(defect_json, 1, 5000) AS defect_json, substr(barcode_content, 1, 200) AS barcode_content FROM qc_results")
def k5_stored_rows(q):
    return sinks.qc_rows(q).select("id", "defect_json", "barcode_content")


@query("files", sql="SELECT id, left(sha1(content), 16) || '.txt' AS name FROM files")
def k7_content_names(f):
    return f.select("id", sinks.content_name(F.col("content").cast("binary"), F.col("file_name")).alias("name"))


@query("boxes", sql="""
WITH c AS (SELECT det_id, greatest(x1, 0) AS x, greatest(y1, 0) AS y, least(x2, 200) - greatest(x1, 0) AS w, least(y2, 160) - greatest(y1, 0) AS h, CASE label WHEN 'A' THEN 0 WHEN 'N' THEN 1 END AS k FROM boxes)
SELECT CAST(det_id AS VARCHAR) AS filename, printf('%d %.6f %.6f %.6f %.6f', k, (x + w / 2) / 200, (y + h / 2) / 160, w / 200, h / 160) AS line FROM c WHERE k IS NOT NULL AND w > 1 AND h > 1""")
def k12_yolo_lines(b):
    rows = b.select(F.col("det_id").cast("string").alias("filename"), F.lit(200).alias("width"), F.lit(160).alias("height"), "label", F.col("x1").alias("xmin"), F.col("y1").alias("ymin"), F.col("x2").alias("xmax"), F.col("y2").alias("ymax"))
    return sinks.yolo_lines(rows, ["A", "N"])


@query("boxes", sql="SELECT frame_id, least(count(*), 2) AS n, array_to_string(list_transform(list(label ORDER BY det_id, label)[1:2], lambda x: lower(x)), ',') AS labels FROM boxes GROUP BY frame_id")
def j_positional_zip(b):
    g = b.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("det_id", "label"))).alias("x"))
    labels, other = F.transform("x", lambda v: v["label"]), F.array(F.lit(1), F.lit(2))
    n = F.least(F.size(labels), F.size(other))
    zipped = F.arrays_zip(F.slice(labels, F.lit(1), n).alias("label"), F.slice(other, F.lit(1), n).alias("o"))
    return g.select("frame_id", n.cast("long").alias("n"), F.array_join(F.transform(zipped, lambda v: F.lower(v["label"])), ",").alias("labels"))


@on_table("embeddings", """
WITH u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
SELECT CAST(a.i AS INT) AS i, CAST(b.i AS INT) AS j, round(covar_samp(a.v, b.v), 6) + 0.0 AS cov FROM u a JOIN u b USING (vec_id) GROUP BY a.i, b.i""")
def a15_covariance(e):
    d = e.select(F.size("embedding").alias("d")).first().d

    def moments(frames):
        n, s, g = 0, np.zeros(d), np.zeros((d, d))
        for pdf in frames:
            if len(pdf):
                x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
                n, s, g = n + len(x), s + x.sum(axis=0), g + x.T @ x
        i, j = np.divmod(np.arange(d * d), d)
        yield pd.DataFrame({"i": i, "j": j, "g": g.ravel(), "si": s[i], "sj": s[j], "n": n})

    sums = e.select("embedding").mapInPandas(moments, "i int, j int, g double, si double, sj double, n long")
    out = sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("g", "si", "sj", "n")])
    return out.select("i", "j", (F.round((F.col("g") - F.col("si") * F.col("sj") / F.col("n")) / (F.col("n") - 1), 6) + 0.0).alias("cov"))


@query("qc_results", sql="SELECT verdict AS state, count(*) AS n, round(sum(anomaly_score), 2) AS vram FROM qc_results GROUP BY verdict")
def a17_state_counts(q):
    return q.groupBy(F.col("verdict").alias("state")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("anomaly_score"), 2).alias("vram"))


@query("error_log", sql="SELECT stage, error_code, count(*) AS n FROM error_log GROUP BY ALL")
def a18_ingest_counters(e):
    return e.groupBy("stage", "error_code").agg(F.count(F.lit(1)).alias("n"))


@query("scores", sql="SELECT product, round(avg(score), 6) AS mean_all, round(sum(score) FILTER (WHERE defect = 0) / count(*), 6) AS mean_targets FROM scores GROUP BY product")
def a4_mean_confidence(s):
    return s.groupBy("product").agg(F.round(F.avg("score"), 6).alias("mean_all"), F.round(F.sum(F.when(F.col("defect") == 0, F.col("score"))) / F.count(F.lit(1)), 6).alias("mean_targets"))


@query("boxes", sql="SELECT det_id, greatest(0, (x2 - x1) * (y2 - y1)) AS area, round(greatest(0, least(x2, 100) - greatest(x1, 20)) * greatest(0, least(y2, 100) - greatest(y1, 20)) / greatest(1, (x2 - x1) * (y2 - y1)), 9) AS inside FROM boxes")
def m8_containment(b):
    window = tuple(F.lit(float(v)) for v in (20, 20, 100, 100))
    return b.select("det_id", geometry.area(geometry.box()).alias("area"), F.round(geometry.contained(geometry.box(), window), 9).alias("inside"))


@query("boxes", sql="""
WITH p AS (SELECT det_id, x1, y1, x2 - x1 AS w, y2 - y1 AS h, round_even((x2 - x1) * 0.25, 0) AS pw, round_even((y2 - y1) * 0.25, 0) AS ph FROM boxes)
SELECT det_id, greatest(0, x1 - pw) AS x, greatest(0, y1 - ph) AS y, least(220, x1 + w + pw) - greatest(0, x1 - pw) AS w, least(200, y1 + h + ph) - greatest(0, y1 - ph) AS h FROM p""")
def m9_padded_rois(b):
    p = geometry.padded("x1", "y1", "w", "h", 220, 200, 0.25)
    return b.withColumns({"w": F.col("x2") - F.col("x1"), "h": F.col("y2") - F.col("y1")}).select("det_id", *[c.alias(k) for k, c in p.items()])


_POINT = "arg_min(CAST(x1 AS VARCHAR) || '/' || CAST(y1 AS VARCHAR), ({}, x1, y1))"


@query("boxes", sql="SELECT frame_id, " + ", ".join(f"{_POINT.format(v)} AS {k}" for k, v in {"tl": "x1 + y1", "tr": "y1 - x1", "br": "-(x1 + y1)", "bl": "-(y1 - x1)"}.items()) + " FROM boxes GROUP BY frame_id")
def m10_corners(b):
    points = b.groupBy("frame_id").agg(*[c.alias(k) for k, c in geometry.corner_points(F.col("x1"), F.col("y1")).items()])
    text = lambda k: F.concat(F.col(f"{k}.x").cast("string"), F.lit("/"), F.col(f"{k}.y").cast("string")).alias(k)
    return points.select("frame_id", *[text(k) for k in ("tl", "tr", "br", "bl")])


_SCENE = """
WITH p AS (SELECT event_id, user_id % 3 = 0 AS phone, score / 10 AS mp, score * 10 AS sharp, (user_id % 10) / 10.0 AS white, (event_id % 10) / 10.0 AS hw FROM scores),
q AS (SELECT event_id, CASE WHEN phone THEN 2.0 ELSE 0.0 END + CASE WHEN mp > 8 AND phone THEN 1.5 WHEN mp > 8 THEN 0.5 ELSE 0.0 END + CASE WHEN sharp < 100 THEN 1.5 ELSE 0.0 END AS c,
  CASE WHEN sharp > 500 THEN 1.5 ELSE 0.0 END + CASE WHEN white > 0.7 THEN 1.0 ELSE 0.0 END AS d, CASE WHEN hw > 0.5 THEN 2.0 * hw ELSE 0.0 END AS h FROM p),
k AS (SELECT event_id, CASE WHEN c + d + h = 0 OR greatest(d, c, h)::DOUBLE / (c + d + h) < 0.7 THEN 'camera' WHEN d >= greatest(c, h) THEN 'document' WHEN c >= h THEN 'camera' ELSE 'handwriting' END AS scene FROM q)"""


def _scene(s):
    return scores.scene(F.col("user_id") % 3 == 0, F.col("score") / 10, F.col("score") * 10, (F.col("user_id") % 10) / 10.0, (F.col("event_id") % 10) / 10.0)[0]


@query("scores", sql=f"{_SCENE} SELECT event_id, scene FROM k")
def m13_scene(s):
    return s.select("event_id", _scene(s).alias("scene"))


@query("scores", sql=f"{_SCENE} SELECT event_id, CASE WHEN scene = 'document' THEN 'ppocr' WHEN scene = 'handwriting' AND event_id % 2 = 0 THEN 'hunyuan' ELSE 'rapidocr' END AS engine FROM k")
def v19_scene_routing(s):
    ready = {"ppocr": F.lit(True), "hunyuan": F.col("event_id") % 2 == 0}
    return s.select("event_id", scores.scene_engine(_scene(s), ready).alias("engine"))


@query("notification_log", sql="""
SELECT id, CASE attempts WHEN 0 THEN 0 WHEN 1 THEN 30 WHEN 2 THEN 120 END AS delay, strftime(created_at + to_seconds(CASE attempts WHEN 0 THEN 0 WHEN 1 THEN 30 WHEN 2 THEN 120 END), '%Y-%m-%dT%H:%M:%S') AS next_retry_at FROM notification_log""")
def d3_retry_backoff(n):
    delay = F.get(F.array(F.lit(0), F.lit(30), F.lit(120)), F.col("attempts"))
    return n.select("id", delay.alias("delay"), F.date_format(F.timestamp_add("SECOND", delay, F.col("created_at")), "yyyy-MM-dd'T'HH:mm:ss").alias("next_retry_at"))


@query("qc_results", sql="SELECT user_id, max(created_at) < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 24 HOUR AS due FROM qc_results GROUP BY user_id")
def d4_catch_up(q):
    last = q.groupBy("user_id").agg(F.max("created_at").alias("last"))
    return last.select("user_id", F.coalesce(F.col("last") < F.lit("2024-01-30 12:00:00").cast("timestamp") - F.expr("INTERVAL 24 HOURS"), F.lit(True)).alias("due"))


@query("qc_results", sql="SELECT id, CAST(created_at AS DATE) AS day, strftime(created_at, '%Y-%m') AS month, CAST(CAST(created_at AS DATE) - INTERVAL 6 MONTH AS DATE) AS since FROM qc_results")
def d1_date_functions(q):
    return q.select("id", F.to_date("created_at").alias("day"), F.date_format("created_at", "yyyy-MM").alias("month"), F.add_months(F.to_date("created_at"), -6).alias("since"))


@query("boxes", sql="""
SELECT det_id, CASE label WHEN 'A' THEN '缺孔' WHEN 'N' THEN '开路' ELSE 'R_scratch' END AS name, CASE label WHEN 'A' THEN '180,0,255' WHEN 'N' THEN '0,0,255' ELSE '0,165,255' END AS colour FROM boxes""")
def t27_label_names(b):
    label = F.when(F.col("label") == "A", "missing_hole").when(F.col("label") == "N", "open_circuit").otherwise("R_scratch")
    return b.select("det_id", tx.label_name(label).alias("name"), tx.label_colour(label).alias("colour"))


_PHRASES = "concat('Scratch、', CASE WHEN id % 2 = 0 THEN 'long deep dent. ' ELSE predicted END, ' , a very long defect phrase, ', CASE id % 3 WHEN 0 THEN '划痕' WHEN 1 THEN 'Burr.' ELSE truth END, ', x1, X., rust,flash')"


@query("marks", sql=f"""
SELECT id, array_to_string(list_filter(list_transform(string_split(regexp_replace({_PHRASES}, '[、。]', ',', 'g'), ','), lambda x: lower(regexp_replace(regexp_replace(trim(x), '^\\.+', ''), '\\.+$', ''))),
  lambda w: regexp_full_match(w, '[a-z ]+') AND len(list_filter(string_split(w, ' '), lambda y: y <> '')) <= 3)[1:5], ',') AS words FROM marks""")
def t28_keywords(m):
    return m.select("id", F.array_join(tx.keywords(F.expr(_PHRASES)), ",").alias("words"))


@query("marks", sql="SELECT id, CASE WHEN id % 2 = 0 THEN predicted ELSE '【a】' || chr(10) || predicted || chr(10) || chr(10) || '【b】' || chr(10) || truth END AS text FROM marks")
def t33_merged_rois(m):
    part = lambda n, c: F.struct(F.lit(n).alias("label"), F.col(c).alias("text"))
    parts = F.when(F.col("id") % 2 == 0, F.array(part("a", "predicted"))).otherwise(F.array(part("a", "predicted"), part("b", "truth")))
    return m.select("id", tx.merged_rois(parts).alias("text"))


@query("contracts", sql="SELECT id, coalesce(nullif(title, ''), nullif(split_part(file_path, '/', 3), ''), '合同') AS title FROM contracts")
def t34_title_fallback(c):
    return c.select("id", F.coalesce(F.nullif("title", F.lit("")), F.nullif(F.element_at(F.split("file_path", "/"), -1), F.lit("")), F.lit("合同")).alias("title"))


@query("contracts", sql="SELECT id, TRY_CAST(contract_no AS DOUBLE) AS a, round(TRY_CAST(replace(contract_no, 'HT-', '') AS DOUBLE), 2) AS b FROM contracts")
def t16_value_normalisers(c):
    return c.select("id", F.col("contract_no").try_cast("double").alias("a"), F.round(F.replace("contract_no", F.lit("HT-"), F.lit("")).try_cast("double"), 2).alias("b"))


@on_table("events", """
SELECT CASE WHEN user_id % 4 = 0 THEN '?' ELSE concat(event_type, CASE WHEN user_id % 3 = 0 THEN '_edge' ELSE '' END) END AS class, count(*) AS n, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS recall FROM events GROUP BY 1""")
def a7_recall_by_file_class(e):
    """Recall by the class that a file's name holds."""
    name = F.when(F.col("user_id") % 4 == 0, F.concat(F.lit("/d/img_"), F.col("event_id").cast("string"))).otherwise(F.concat(F.lit("/d/01_"), "event_type", F.when(F.col("user_id") % 3 == 0, "_edge").otherwise(""), F.lit("_"), F.col("event_id").cast("string"), F.lit(".jpg")))
    return e.groupBy(readers.class_from_name(name).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("value") > 50).cast("double")), 6).alias("recall"))


@query("images", "source_state", sql="SELECT image_id FROM images i WHERE EXISTS (SELECT 1 FROM source_state s WHERE s.source = 'yolo' AND s.product = i.product)")
def f5_product_gate(i, states):
    """Images whose product has weights of its own."""
    return i.join(states.filter("source = 'yolo'").select("product"), "product", "left_semi").select("image_id")


_RAW_PAYMENT = """SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_linenumber % 4 WHEN 0 THEN concat(' ', CAST(CAST(l_shipdate AS DATE) AS STRING), ' ') WHEN 1 THEN concat(CAST(CAST(l_shipdate AS DATE) AS STRING), 'T00') WHEN 2 THEN NULL ELSE '1998/01/02' END AS due_date,
  CASE l_linenumber % 5 WHEN 0 THEN '' WHEN 1 THEN 'about 5' WHEN 2 THEN NULL ELSE CAST(l_partkey AS STRING) END AS amount, CASE WHEN l_suppkey % 2 = 0 THEN 'USD' WHEN l_suppkey % 3 = 0 THEN '' END AS currency,
  CASE WHEN l_partkey % 2 = 0 THEN repeat(l_returnflag, 250) WHEN l_partkey % 3 = 0 THEN '' END AS condition_text, CASE WHEN l_partkey % 5 = 0 THEN '0.1%' END AS penalty, repeat(l_linestatus, 120) AS payer, CAST(NULL AS STRING) AS payee FROM lineitem"""


def t16_plain_payments(spark, sf_dir):
    """Payments in their normal form; those without an amount and a condition are left out."""
    readers.table(spark, f"{sf_dir}/lineitem.parquet").createOrReplaceTempView("millrace_t16")
    raw = spark.sql(_RAW_PAYMENT.replace("FROM lineitem", "FROM millrace_t16"))
    fields = ("due_date", "amount", "currency", "condition_text", "penalty", "payer", "payee")
    return raw.select("id", tx.plain_payment(F.struct(*fields)).alias("p")).filter("p is not null").select("id", "p.*")


QUERIES["t16_plain_payments"] = t16_plain_payments
SQL["t16_plain_payments"] = f"""
WITH r AS ({_RAW_PAYMENT.replace('CAST(NULL AS STRING)', 'NULL')}), n AS (SELECT *, TRY_CAST(nullif(trim(amount), '') AS DOUBLE) AS a FROM r)
SELECT id, CASE WHEN regexp_full_match(trim(coalesce(due_date, '')), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN trim(due_date) ELSE '' END AS due_date, round(a, 2) AS amount, coalesce(nullif(currency, ''), 'CNY') AS currency,
  left(coalesce(condition_text, ''), 200) AS condition_text, coalesce(penalty, '') AS penalty, left(payer, 100) AS payer, '' AS payee FROM n WHERE a IS NOT NULL OR coalesce(condition_text, '') <> ''"""


@query("contracts", sql="SELECT stamp, count(*) AS n FROM contracts, (SELECT unnest(['3', '4', '5', '6', '7']) AS stamp) s GROUP BY stamp")
def k8_snapshots(c):
    """Seven snapshots of a table, of which the newest five are kept."""
    root = f"{shared_dir(c.sparkSession)}/millrace/snapshots-{uuid.uuid4().hex}"
    for stamp in range(1, 8):
        sinks.snapshot(c.select("id", "status"), root, str(stamp))
    kept = c.sparkSession.read.parquet(root)
    return kept.groupBy(F.col("snapshot").cast("string").alias("stamp")).agg(F.count(F.lit(1)).alias("n"))


@query("boxes", sql="""
SELECT frame_id, det_id, row_number() OVER (PARTITION BY frame_id ORDER BY CASE label WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, det_id, x1, y1) AS no FROM boxes""")
def w11_fixed_order(b):
    rank = F.when(F.col("label") == "A", 0).when(F.col("label") == "N", 1).otherwise(2)
    return rc.numbered(b, "frame_id", [rank, F.col("det_id"), F.col("x1"), F.col("y1")], "no").select("frame_id", "det_id", F.col("no").cast("long").alias("no"))


@query("qc_results", sql="SELECT CAST(created_at AS DATE) AS day, count(*) AS total, count(*) FILTER (WHERE verdict = 'NG') AS ng_count FROM qc_results GROUP BY 1")
def st_daily_windows(q):
    rows = q.groupBy(F.window("created_at", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("verdict") == "NG").alias("ng_count"))
    return rows.select(F.to_date("w.start").alias("day"), "total", "ng_count")


@query("marks", sql="""
SELECT concat('/ocr/', CAST(id AS VARCHAR)) AS image_path, sha1(truth) AS image_hash, 'rapidocr' AS engine, '' AS scene, 1 AS roi_count, predicted AS raw_text, truth AS corrected_text, 0.0::DOUBLE AS confidence, 0.75::DOUBLE AS confidence_threshold,
  CASE WHEN predicted = truth THEN 'OK' ELSE 'NG' END AS verdict, 0.0::DOUBLE AS elapsed_sec, '{}' AS structured_json, truth AS text_content, '[]' AS ng_regions,
  CASE WHEN predicted = truth THEN '[]' ELSE '[' || CAST(to_json(predicted) AS VARCHAR) || ', ' || CAST(to_json(truth) AS VARCHAR) || ']' END AS corrections FROM marks""")
def k6_ocr_audit(m):
    rows = m.select(
        F.concat(F.lit("/ocr/"), F.col("id").cast("string")).alias("image_path"),
        F.sha1("truth").alias("image_hash"),
        F.lit("rapidocr").alias("engine"),
        F.col("predicted").alias("raw_text"),
        F.col("truth").alias("corrected_text"),
        F.when(F.col("predicted") == F.col("truth"), "OK").otherwise("NG").alias("verdict"),
        F.when(F.col("predicted") != F.col("truth"), F.array("predicted", "truth")).alias("corrections"),
    )
    return sinks.ocr_audit_rows(rows)
