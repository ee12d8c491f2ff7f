"""The engine's tables, derived from the test tables by SQL that Spark and DuckDB read alike.

``$name`` stands for a test table. ``tables(spark, sf_dir)`` gives DataFrames; ``with_sql(sql, ...)`` puts the same
definitions before a DuckDB query.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TODAY = "1998-06-15"

DEFINITIONS = {
    "contracts": """
SELECT o_orderkey AS id, o_orderdate AS created_at, concat('/in/', CAST(o_orderkey AS STRING), '.pdf') AS file_path, concat('HT-', CAST(o_orderkey AS STRING)) AS contract_no,
  CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE concat('Order ', CAST(o_orderkey AS STRING)) END AS title, c_name AS counterparty,
  CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 13 = 0 THEN NULL ELSE c_mktsegment END AS signer,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice END AS total_amount,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'terminated' ELSE 'active' END AS status,
  CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' OR o_orderpriority LIKE '3%' THEN 1 ELSE 0 END AS reviewed,
  CAST(o_orderkey % 100 AS DOUBLE) / 100 AS confidence, CASE WHEN o_orderkey % 3 = 0 THEN 'payable' ELSE 'receivable' END AS direction,
  CASE o_orderkey % 5 WHEN 4 THEN concat(chr(123), '"valid": null', chr(125)) WHEN 0 THEN concat(chr(123), '"valid": true', chr(125)) WHEN 1 THEN concat(chr(123), '"valid": false', chr(125)) WHEN 2 THEN 'not json' ELSE NULL END AS structured_json
FROM $orders JOIN $customer ON o_custkey = c_custkey""",
    "receivables": """
SELECT l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey AS id, l_orderkey AS contract_id,
  CASE WHEN (l_orderkey + l_linenumber) % 7 = 0 THEN NULL ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END AS due_date,
  l_extendedprice AS amount, 'CNY' AS currency, CASE WHEN l_suppkey % 3 = 0 THEN 'payable' ELSE 'receivable' END AS direction,
  CASE WHEN l_returnflag = 'R' THEN 'collected' WHEN l_linestatus = 'F' THEN 'overdue' ELSE 'pending' END AS status,
  CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END AS reminded_7d, CASE WHEN l_partkey % 7 = 0 THEN 1 ELSE 0 END AS reminded_3d,
  CASE WHEN l_partkey % 11 = 0 THEN 1 ELSE 0 END AS reminded_1d, CASE WHEN l_partkey % 2 = 0 THEN 1 ELSE 0 END AS reminded_overdue
FROM $lineitem""",
    "collections": """
SELECT l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey AS id, l_orderkey AS contract_id,
  CAST(CAST(l_shipdate AS DATE) AS STRING) AS collected_at, l_extendedprice - l_quantity AS amount
FROM $lineitem WHERE l_returnflag = 'R'""",
    "signers": """
SELECT o_orderkey AS seq, c_mktsegment AS name, concat('u', CAST(o_custkey AS STRING)) AS feishu_id, o_orderpriority AS note
FROM $orders JOIN $customer ON o_custkey = c_custkey""",
    "error_log": """
SELECT event_id AS id, ts AS created_at, CASE user_id % 3 WHEN 0 THEN 'ingest' WHEN 1 THEN 'extract' ELSE 'review' END AS stage,
  CASE event_id % 4 WHEN 0 THEN 'FILE_NOT_FOUND' WHEN 1 THEN 'Doc_Read_Fail' WHEN 2 THEN 'EMPTY_TEXT' ELSE 'EXCEPTION' END AS error_code,
  concat('/in/User', CAST(user_id AS STRING), '.pdf') AS file_path, props AS message FROM $events WHERE event_type = 'error'""",
    "risk_alert": """
SELECT event_id AS id, ts AS created_at, event_id % 1500 AS contract_id, CASE WHEN event_type = 'purchase' THEN 'red' ELSE 'yellow' END AS level,
  event_type AS rule, props AS message FROM $events WHERE event_type IN ('purchase', 'click')""",
    "qc_results": """
SELECT event_id AS id, ts AS created_at, concat('/img/', CAST(event_id AS STRING), '.png') AS image_path,
  CASE event_type WHEN 'error' THEN 'NG' WHEN 'signup' THEN 'REVIEW' ELSE 'OK' END AS verdict, value AS anomaly_score, concat('prompt ', props) AS barcode_content,
  props AS defect_json, user_id FROM $events""",
    "notification_log": """
SELECT event_id AS id, ts AS created_at, CASE user_id % 3 WHEN 0 THEN 'feishu' WHEN 1 THEN 'wecom' ELSE 'desktop' END AS channel,
  CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END AS success, CAST(event_id % 4 AS INT) AS attempts, 3 AS max_attempts,
  CASE WHEN event_id % 5 = 0 THEN '' ELSE concat(CAST(CAST(ts AS DATE) AS STRING), 'T08:00:00') END AS next_retry_at FROM $events""",
    "audit": """
SELECT event_id AS id, ts AS created_at, user_id AS contract_id, event_type AS action, props AS new_value FROM $events""",
    "files": """
SELECT doc_id AS id, text AS content, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE doc_id % 50 END AS contract_id, concat(source, '.txt') AS file_name FROM $documents""",
    "scores": """
SELECT event_id, ts, user_id % 5 AS product, CASE user_id % 2 WHEN 0 THEN 'patchcore' ELSE 'dinov2' END AS source, value AS score,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS defect, user_id FROM $events""",
    "texts": """
SELECT o_orderkey AS id, o_orderdate AS base_date, concat('采购合同', chr(10), '合同编号：HT-', CAST(10000 + o_orderkey AS STRING), chr(10), '甲方（买方）：', c_name, '，乙方：锐新科技', CAST(c_nationkey AS STRING), '号公司；', chr(10),
  CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat('签订日期：', CAST(CAST(o_orderdate AS DATE) AS STRING), chr(10)) END,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('合同总额：人民币', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), '元。') END, chr(10),
  '1. 甲方向乙方支付预付款 ', CAST(CAST(floor(o_totalprice / 2) AS BIGINT) AS STRING), '元，付款日 ', CAST(2000 + o_orderkey % 20 AS STRING), '年', CAST(1 + o_orderkey % 13 AS STRING), '月', CAST(1 + o_orderkey % 31 AS STRING), '日前。', chr(10),
  CASE WHEN o_orderkey % 3 = 0 THEN concat('签订后30日内支付尾款 ', CAST(1 + o_orderkey % 40 AS STRING), ',500.5元') ELSE concat('生效后', CAST(1 + o_orderkey % 90 AS STRING), '天内支付尾款 ', CAST(1 + o_orderkey % 30 AS STRING), '.5万元') END, chr(10),
  CASE WHEN o_orderkey % 2 = 0 THEN '逾期付款每日按千分之一支付违约金' ELSE '未尽事宜另行协商' END, chr(10), CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE '负责人：王小明' END) AS text
FROM $orders JOIN $customer ON o_custkey = c_custkey""",
    "marks": """
SELECT l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey AS id, concat('P20', CAST(100000 + l_partkey AS STRING), chr(10), CAST(l_partkey AS STRING), CASE l_linenumber % 5 WHEN 0 THEN 'O' WHEN 1 THEN 'l' WHEN 2 THEN 'S' WHEN 3 THEN 'B' ELSE 'Z' END, CAST(l_suppkey AS STRING), ' ', l_returnflag) AS predicted,
  concat('P20', CAST(100000 + l_partkey AS STRING), chr(10), CAST(l_partkey AS STRING), CASE l_linenumber % 5 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '5' WHEN 3 THEN '8' ELSE '2' END, CAST(l_suppkey AS STRING), ' ', l_linestatus) AS truth FROM $lineitem""",
    "boxes": """
SELECT l_orderkey AS frame_id, l_linenumber AS box_id, l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey AS det_id, CAST(l_partkey % 200 AS DOUBLE) AS x1, CAST(l_suppkey % 150 AS DOUBLE) AS y1,
  CAST(l_partkey % 200 AS DOUBLE) + l_quantity AS x2, CAST(l_suppkey % 150 AS DOUBLE) + l_quantity * 2 - 5 AS y2, l_discount * 10 AS score, l_returnflag AS label,
  CASE WHEN l_linestatus = 'O' THEN '2D' ELSE '3D' END AS kind FROM $lineitem""",
    "images": """
SELECT event_id AS image_id, ts, CASE WHEN user_id % 7 = 0 THEN '' WHEN user_id % 31 = 0 THEN NULL ELSE concat('P', CAST(user_id % 5 AS STRING)) END AS product, event_id % 97 <> 0 AS readable,
  CASE WHEN event_id % 4 = 0 THEN '  ' WHEN event_id % 9 = 0 THEN NULL ELSE 'scratch' END AS prompt FROM $events""",
    "signals": """
SELECT event_id AS image_id, 'patchcore' AS source, value AS score, CAST(NULL AS INT) AS n_boxes, CASE WHEN event_id % 31 = 0 THEN 'inference failed' WHEN event_id % 5 = 0 THEN '' END AS error FROM $events WHERE event_id % 13 <> 0
UNION ALL SELECT event_id, 'dinov2', CASE WHEN event_id % 17 = 0 THEN NULL ELSE value * 0.8 + 10 END, NULL, CASE WHEN event_id % 29 = 0 THEN 'out of memory' END FROM $events WHERE event_id % 10 <> 3
UNION ALL SELECT event_id, 'dino', NULL, CAST(event_id % 3 AS INT), CASE WHEN event_id % 23 = 0 THEN 'no model' END FROM $events
UNION ALL SELECT event_id, 'yolo', NULL, CAST(user_id % 2 AS INT), NULL FROM $events WHERE event_id % 3 = 0""",
    "source_state": """
SELECT concat('P', CAST(n_nationkey % 5 AS STRING)) AS product, CASE WHEN n_nationkey < 5 THEN 'patchcore' WHEN n_nationkey < 10 THEN 'dinov2' ELSE 'yolo' END AS source,
  CASE WHEN n_nationkey = 7 OR n_nationkey >= 10 THEN NULL ELSE 100.0E0 + n_nationkey END AS tau,
  CASE WHEN n_nationkey >= 10 THEN NULL WHEN n_nationkey % 5 = 1 THEN 20 WHEN n_nationkey % 5 = 2 THEN 5 ELSE 60 END AS n_cal, 0.1E0 AS epsilon
FROM $nation WHERE n_nationkey < 14 AND n_nationkey <> 3""",
    "cal_images": """
SELECT event_id AS image_id, concat('C/', CAST(user_id AS STRING)) AS product, CASE WHEN event_type = 'error' AND user_id % 9 <> 0 THEN 'ng' ELSE 'cal' END AS role, event_id % 11 <> 0 AS readable FROM $events""",
    "cal_scores": """
SELECT event_id AS image_id, 'patchcore' AS source, CASE WHEN event_id % 37 = 0 THEN -1.0E0 ELSE value END AS score, CASE WHEN event_id % 19 = 0 THEN 'unreadable' END AS error FROM $events
UNION ALL SELECT event_id, 'dinov2', CASE WHEN event_id % 23 = 0 THEN NULL ELSE value * 0.5 + 5 END, '' FROM $events WHERE event_id % 29 <> 0""",
    "cal_state": """
SELECT DISTINCT concat('C/', CAST(user_id AS STRING)) AS product, 'patchcore' AS source, user_id % 6 <> 0 AS registered, user_id % 4 <> 0 AS has_bank, 20.0E0 + user_id AS tau, user_id % 60 AS n_cal,
  CASE WHEN user_id % 2 = 0 THEN 0.1E0 WHEN user_id % 3 = 0 THEN NULL ELSE 0.25E0 END AS epsilon FROM $events
UNION ALL SELECT DISTINCT concat('C/', CAST(user_id AS STRING)), 'dinov2', true, user_id % 5 <> 0, CASE WHEN user_id % 10 = 1 THEN NULL ELSE 30.0E0 END, 3, 0.1E0 FROM $events WHERE user_id % 8 <> 0""",
}


def sql_of(name: str, table) -> str:
    return re.sub(r"\$(\w+)", lambda m: table(m[1]), DEFINITIONS[name]).strip()


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named tables as DataFrames."""
    out = []
    for name in names:
        for source in set(re.findall(r"\$(\w+)", DEFINITIONS[name])):
            spark.read.parquet(f"{sf_dir}/{source}.parquet").createOrReplaceTempView(f"millrace_src_{source}")
        out.append(spark.sql(sql_of(name, lambda t: f"millrace_src_{t}")))
    return out


def with_sql(sql: str, *names: str) -> str:
    """A DuckDB query over the named tables."""
    ctes = ",\n".join(f"{n} AS ({sql_of(n, str)})" for n in names)
    sql = sql.strip()
    if sql.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {sql[15:]}"
    return f"WITH {ctes}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {ctes}\n{sql}"
