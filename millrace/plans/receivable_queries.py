"""Queries R1-R27 and D2 over the engine's tables, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import receivables as op

from .proxies import TODAY, tables, with_sql

QUERIES, SQL = {}, {}


def query(*needs, sql=None):
    """Register a function of (the needed tables) under its name."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*tables(spark, sf_dir, *needs))
        if sql:
            SQL[f.__name__] = with_sql(sql, *needs)
        return f

    return add


_DUE = "due AS (SELECT contract_id, sum(amount) AS s FROM receivables GROUP BY contract_id), paid AS (SELECT contract_id, sum(amount) AS s FROM collections GROUP BY contract_id)"


@query("contracts", "receivables", "collections", sql=f"""
WITH {_DUE}
SELECT c.*, round(coalesce(due.s, 0), 2) AS receivable_sum, round(coalesce(paid.s, 0), 2) AS collected_sum,
  round(greatest(coalesce(total_amount, 0), coalesce(due.s, 0)) - coalesce(paid.s, 0), 2) AS outstanding
FROM contracts c LEFT JOIN due ON due.contract_id = c.id LEFT JOIN paid ON paid.contract_id = c.id""")
def r1_list_contracts(c, r, k):
    return op.contract_balances(c, r, k)


@query("receivables", "contracts", sql="""
SELECT r.*, c.title AS contract_title, c.signer, c.counterparty FROM receivables r LEFT JOIN contracts c ON c.id = r.contract_id""")
def r2_list_receivables(r, c):
    return op.receivable_list(r, c)


_DAYS = f"date_diff('day', DATE '{TODAY}', CAST(r.due_date AS DATE))"


@query("receivables", "contracts", sql="""
SELECT r.*, c.title AS contract_title, c.file_path, c.signer FROM receivables r JOIN contracts c ON c.id = r.contract_id WHERE c.reviewed = 1""")
def r3_reminder_candidates(r, c):
    return op.reminder_candidates(r, c)


@query("receivables", "contracts", sql=f"""
WITH x AS (
  SELECT r.*, c.title AS t, c.file_path, c.signer, {_DAYS} AS days_left,
    CASE WHEN {_DAYS} < 0 THEN 'overdue' WHEN {_DAYS} <= 1 THEN '1d' WHEN {_DAYS} <= 3 THEN '3d' WHEN {_DAYS} <= 7 THEN '7d' END AS level
  FROM receivables r JOIN contracts c ON c.id = r.contract_id WHERE c.reviewed = 1 AND r.status = 'pending' AND r.due_date IS NOT NULL
), y AS (SELECT *, CASE WHEN t = '' THEN split_part(file_path, '/', 3) ELSE t END AS title FROM x)
SELECT id, title, due_date, CAST(days_left AS INT) AS days_left, level,
  title || ' · ' || CAST(amount AS VARCHAR) || ' ' || currency || ' · ' || CASE WHEN days_left < 0 THEN '已逾期 ' || CAST(-days_left AS VARCHAR) || ' 天 (原定 ' || due_date || ')'
    ELSE CAST(days_left AS VARCHAR) || '天后到期 (' || due_date || ')' END || CASE WHEN coalesce(signer, '') <> '' THEN ' · 签单人: ' || signer ELSE '' END AS message
FROM y WHERE level IS NOT NULL AND CASE level WHEN 'overdue' THEN reminded_overdue WHEN '1d' THEN reminded_1d WHEN '3d' THEN reminded_3d ELSE reminded_7d END = 0""")
def d2_due_reminders(r, c):
    return op.due_reminders(r, c, TODAY)


@query("receivables", "contracts", sql=f"""
WITH f AS (
  SELECT DISTINCT r.id, CASE WHEN {_DAYS} < 0 THEN 'overdue' WHEN {_DAYS} <= 1 THEN '1d' WHEN {_DAYS} <= 3 THEN '3d' WHEN {_DAYS} <= 7 THEN '7d' END AS level
  FROM receivables r JOIN contracts c ON c.id = r.contract_id WHERE c.reviewed = 1 AND r.status = 'pending' AND r.due_date IS NOT NULL
)
SELECT sum(CASE WHEN f.level = '7d' THEN 1 ELSE reminded_7d END) AS reminded_7d, sum(CASE WHEN f.level = '3d' THEN 1 ELSE reminded_3d END) AS reminded_3d,
  sum(CASE WHEN f.level = '1d' THEN 1 ELSE reminded_1d END) AS reminded_1d, sum(CASE WHEN f.level = 'overdue' THEN 1 ELSE reminded_overdue END) AS reminded_overdue
FROM receivables r LEFT JOIN f ON f.id = r.id AND f.level IS NOT NULL""")
def st3_mark_reminded(r, c):
    after = op.mark_reminded(r, op.due_reminders(r, c, TODAY))
    return after.agg(*[F.sum(x).alias(x) for x in ("reminded_7d", "reminded_3d", "reminded_1d", "reminded_overdue")])


@query("error_log", sql="""
SELECT * FROM error_log WHERE stage = 'extract' AND error_code ILIKE '%read%' AND file_path ILIKE '%uSER1%' ORDER BY id DESC LIMIT 50""")
def r4_list_errors(e):
    return op.error_list(e, "extract", "read", "uSER1")


@query("contracts", sql="SELECT * FROM contracts WHERE reviewed = 0")
def r5_pending_review(c):
    return op.pending_review(c)


@query("contracts", "receivables", sql="""
SELECT c.id, c.contract_no, coalesce(r.n, 0) AS n_items, coalesce(r.items, '') AS items FROM contracts c LEFT JOIN (
  SELECT contract_id, count(*) AS n, string_agg(coalesce(due_date, '?') || ':' || CAST(id AS VARCHAR), ',' ORDER BY (due_date IS NULL), due_date, id) AS items FROM receivables GROUP BY contract_id
) r ON r.contract_id = c.id""")
def r6_contract_details(c, r):
    one = lambda x: F.concat(F.coalesce(x["due_date"], F.lit("?")), F.lit(":"), x["receivable_id"].cast("string"))
    rows = op.contract_details(c, r)
    return rows.select("id", "contract_no", F.coalesce(F.size("items").cast("long"), F.lit(0)).alias("n_items"), F.coalesce(F.array_join(F.transform("items", one), ","), F.lit("")).alias("items"))


@query("audit", sql="SELECT * FROM audit WHERE contract_id = 7")
def r7_audit_trail(a):
    return op.audit_trail(a, 7)


@query("contracts", "receivables", "collections", sql=f"""
WITH {_DUE},
a AS (SELECT signer, count(*) AS contract_count, sum(due.s) AS total FROM contracts c LEFT JOIN due ON due.contract_id = c.id WHERE reviewed = 1 AND status = 'active' AND signer <> '' GROUP BY signer),
g AS (SELECT signer, sum(paid.s) AS got FROM contracts c JOIN paid ON paid.contract_id = c.id WHERE reviewed = 1 AND signer <> '' GROUP BY signer)
SELECT signer, contract_count, round(coalesce(total, 0), 2) AS total_receivable, round(coalesce(got, 0), 2) AS total_collected,
  round(round(coalesce(total, 0), 2) - round(coalesce(got, 0), 2), 2) AS total_outstanding FROM a LEFT JOIN g USING (signer)""")
def r8_outstanding_by_signer(c, r, k):
    return op.outstanding_by_signer(c, r, k)


@query("risk_alert", "contracts", sql="""
SELECT a.*, c.title, c.file_path FROM risk_alert a LEFT JOIN contracts c ON c.id = a.contract_id ORDER BY (level <> 'red'), a.id DESC LIMIT 200""")
def r9_list_risks(a, c):
    return op.risk_list(a, c)


@query("contracts", "risk_alert", sql="""
SELECT c.id, c.title, c.file_path, c.confidence, c.reviewed, count(*) AS risk_count, count(*) FILTER (WHERE level = 'red') AS red_count FROM contracts c JOIN risk_alert a ON a.contract_id = c.id GROUP BY ALL""")
def r10_contracts_with_risks(c, a):
    return op.contracts_with_risks(c, a)


@query("contracts", "receivables", "collections", "risk_alert", sql="""
WITH d AS (
  SELECT count(DISTINCT c.id) AS contract_count, round(coalesce(sum(r.amount), 0), 2) AS total_receivable, coalesce(sum(CASE WHEN r.status = 'overdue' THEN 1 ELSE 0 END), 0) AS overdue_items,
    round(coalesce(sum(CASE WHEN r.status = 'overdue' THEN r.amount ELSE 0 END), 0), 2) AS overdue_amount
  FROM contracts c LEFT JOIN receivables r ON r.contract_id = c.id WHERE c.status = 'active'
), k AS (SELECT round(coalesce(sum(amount), 0), 2) AS total_collected FROM collections),
a AS (SELECT count(*) AS risk_count, sum(CASE WHEN level = 'red' THEN 1 ELSE 0 END) AS risk_red FROM risk_alert),
p AS (SELECT count(*) AS pending_review FROM contracts WHERE reviewed = 0 AND status = 'active')
SELECT *, round(greatest(total_receivable - total_collected, 0), 2) AS total_outstanding FROM d, k, a, p""")
def r11_dashboard_kpi(c, r, k, a):
    return op.dashboard_kpi(c, r, k, a)


@query("receivables", "collections", sql=f"""
WITH d AS (SELECT substr(due_date, 1, 7) AS month, sum(amount) AS s FROM receivables WHERE due_date >= strftime(DATE '{TODAY}' - INTERVAL 12 MONTH, '%Y-%m-%d') GROUP BY 1),
p AS (SELECT substr(collected_at, 1, 7) AS month, sum(amount) AS s FROM collections WHERE collected_at >= strftime(DATE '{TODAY}' - INTERVAL 12 MONTH, '%Y-%m-%d') GROUP BY 1)
SELECT month, round(coalesce(d.s, 0), 2) AS receivable, round(coalesce(p.s, 0), 2) AS collected FROM d FULL JOIN p USING (month)""")
def r12_monthly_trend(r, k):
    return op.monthly_trend(r, k, TODAY)


@query("contracts", "receivables", sql="""
SELECT c.signer, round(sum(r.amount), 2) AS overdue_amount, count(r.id) AS overdue_items, count(DISTINCT c.id) AS contract_count
FROM receivables r JOIN contracts c ON c.id = r.contract_id WHERE r.status = 'overdue' AND c.status = 'active' GROUP BY c.signer ORDER BY overdue_amount DESC, c.signer NULLS FIRST LIMIT 50""")
def r13_overdue_by_signer(c, r):
    return op.overdue_ranking(c, r, "signer")


@query("contracts", "receivables", sql="""
SELECT c.id, c.title, c.file_path, c.signer, round(sum(r.amount), 2) AS overdue_amount, count(r.id) AS overdue_items
FROM receivables r JOIN contracts c ON c.id = r.contract_id WHERE r.status = 'overdue' AND c.status = 'active' GROUP BY c.id, c.title, c.file_path, c.signer ORDER BY overdue_amount DESC, c.id LIMIT 50""")
def r14_overdue_by_contract(c, r):
    return op.overdue_ranking(c, r, "contract")


_CHOSEN = """WITH chosen AS (SELECT * FROM contracts WHERE {} ORDER BY created_at DESC, id DESC LIMIT 500), paid AS (SELECT contract_id, sum(amount) AS s FROM collections GROUP BY contract_id)
SELECT c.*, round(coalesce(paid.s, 0), 2) AS collected_sum, round(greatest(coalesce(total_amount, 0), 0) - coalesce(paid.s, 0), 2) AS outstanding FROM chosen c LEFT JOIN paid ON paid.contract_id = c.id"""


@query("contracts", "collections", sql=_CHOSEN.format("signer ILIKE '%mach%' AND direction = 'receivable' AND reviewed = 1 AND created_at >= TIMESTAMP '1993-01-01' AND created_at <= TIMESTAMP '1997-12-31 23:59:59' AND total_amount >= 1000 AND total_amount <= 250000"))
def r15_filter_contracts(c, k):
    return op.filter_contracts(c, k, signer="mach", direction="receivable", reviewed="yes", date_from="1993-01-01", date_to="1997-12-31", amount_min=1000, amount_max=250000)


@query("contracts", "collections", sql=_CHOSEN.format("reviewed = 0 AND total_amount >= 0"))
def r15_filter_from_zero(c, k):
    """A bound of 0 drops contracts without a total."""
    return op.filter_contracts(c, k, reviewed="no", amount_min=0)


@query("signers", sql="""
SELECT name, arg_max(feishu_id, seq) AS feishu_id, arg_max(note, seq) AS note, max(seq) AS seq FROM signers WHERE name <> 'MACHINERY' GROUP BY name""")
def r16_signer_upsert(s):
    latest = op.last_wins(s, "name", "seq")
    return op.without(latest, latest.filter("name = 'MACHINERY'"), "name")


@query("files", sql="""
SELECT sha256(coalesce(content, '')) AS sha256, min(id) AS id, arg_min(file_name, id) AS file_name, arg_min(contract_id, id) FILTER (WHERE contract_id IS NOT NULL) AS contract_id, count(*) AS seen FROM files GROUP BY 1""")
def r17_register_files(f):
    return op.register_files(f.withColumn("content", F.coalesce("content", F.lit(""))))


@query("files", sql="""
WITH known AS (SELECT DISTINCT sha256(content) AS sha256 FROM files WHERE id % 2 = 0)
SELECT sha256(content) AS sha256, min(id) AS id, count(*) AS seen FROM files WHERE id % 2 = 1 AND sha256(content) NOT IN (SELECT sha256 FROM known) GROUP BY 1""")
def st6_incremental_ingest(f):
    known = op.register_files(f.filter("id % 2 = 0"))
    return op.register_files(f.filter("id % 2 = 1"), known).select("sha256", "id", "seen")


@query("qc_results", sql="""
SELECT CAST(created_at AS DATE) AS day, count(*) AS total, count(*) FILTER (WHERE verdict = 'NG') AS ng_count, round(avg(anomaly_score), 4) AS avg_score,
  round(100.0::DOUBLE * count(*) FILTER (WHERE verdict = 'NG') / count(*), 2) AS ng_rate_pct FROM qc_results GROUP BY 1""")
def r18_qc_daily_stats(q):
    return op.qc_daily_stats(q)


@query("qc_results", sql="""
SELECT id, created_at, image_path, '/-/qc-img/' || CAST(id AS VARCHAR) AS image_url, anomaly_score, barcode_content, substr(defect_json, 1, 200) AS defect_summary FROM qc_results WHERE verdict = 'NG'""")
def r19_qc_ng_detail(q):
    return op.qc_ng_detail(q)


@query("notification_log", sql="SELECT * FROM notification_log WHERE channel = 'feishu' AND success = 0 ORDER BY id DESC LIMIT 100")
def r20_notification_list(n):
    return op.notification_list(n, "feishu", failed_only=True)


@query("notification_log", sql="""
SELECT * FROM notification_log WHERE success = 0 AND attempts < max_attempts AND (next_retry_at = '' OR next_retry_at <= '2024-01-15T12:00:00') ORDER BY id LIMIT 50""")
def r21_retry_due(n):
    return op.retry_due(n, "2024-01-15T12:00:00")


@query("notification_log", sql="""
WITH due AS (SELECT id FROM notification_log WHERE success = 0 AND attempts < max_attempts AND (next_retry_at = '' OR next_retry_at <= '2024-01-15T12:00:00') ORDER BY id LIMIT 50)
SELECT n.* REPLACE (CASE WHEN d.id IS NOT NULL AND n.id % 3 = 0 THEN 1 ELSE success END AS success, CAST(CASE WHEN d.id IS NOT NULL AND n.id % 3 < 2 THEN attempts + 1 ELSE attempts END AS INT) AS attempts,
  CASE WHEN d.id IS NULL OR n.id % 3 <> 1 THEN next_retry_at WHEN attempts + 1 >= 3 THEN '' WHEN attempts = 0 THEN '2024-01-15T12:00:30' ELSE '2024-01-15T12:02:00' END AS next_retry_at)
FROM notification_log n LEFT JOIN due d ON d.id = n.id""")
def st4_retried(n):
    """Outcomes are known for two thirds of all messages; only those of due messages count."""
    return op.retried(n, n.filter("id % 3 < 2").selectExpr("id", "id % 3 = 0 AS ok"), "2024-01-15T12:00:00")


@query("qc_results", sql="SELECT image_path FROM qc_results WHERE id = 42")
def r22_image_path(q):
    return q.filter("id = 42").select("image_path")


@query("contracts", "receivables", sql="""
SELECT id, '' AS due_date, NULL::DOUBLE AS amount, 'contract' AS kind FROM contracts WHERE total_amount IS NULL UNION ALL SELECT contract_id, coalesce(due_date, ''), amount, 'receivable' FROM receivables WHERE status = 'pending'""")
def r23_appended_rows(c, r):
    a = c.filter("total_amount is null").select("id", F.lit("").alias("due_date"), F.lit(None).cast("double").alias("amount"), F.lit("contract").alias("kind"))
    b = r.filter("status = 'pending'").select(F.col("contract_id").alias("id"), F.coalesce("due_date", F.lit("")).alias("due_date"), "amount", F.lit("receivable").alias("kind"))
    return a.unionByName(b)


# Row by row: the direction is always written, the title on every second contract, at times as null.
_CHANGES = ["CASE WHEN id % 10 = 0 THEN NULL WHEN id % 4 = 0 THEN concat('New ', CAST(id AS STRING)) ELSE title END AS title", "CASE WHEN id % 6 = 0 THEN 'receivable' ELSE direction END AS direction"]


_NEW = """n AS (SELECT *, row_number() OVER (ORDER BY file_path) AS rn FROM (SELECT concat('/new', file_path) AS file_path, id AS old_id, title, counterparty, signer, total_amount, confidence, direction FROM contracts WHERE status = 'active')),
nc AS (SELECT n.*, (SELECT max(id) FROM contracts) + rn AS id FROM n)"""


def _inserts(c, r, a):
    new = c.filter("status = 'active'").select(F.concat(F.lit("/new"), "file_path").alias("file_path"), F.col("id").alias("old_id"), "title", "counterparty", "signer", "total_amount", "confidence", "direction")
    named = new.select("file_path", "old_id")
    pay = r.join(named, F.col("contract_id") == F.col("old_id")).select("file_path", F.col("id").alias("seq"), "due_date", "amount", F.when(F.col("amount") > 30000, F.col("status")).alias("status"))
    alerts = a.join(named, F.col("contract_id") == F.col("old_id")).select("file_path", F.col("id").alias("seq"), F.col("rule"), "message")
    return op.insert_extracted(new.drop("old_id"), pay, alerts, c, r, a)


@query("contracts", "receivables", "risk_alert", sql=f"""
WITH {_NEW} SELECT id, file_path, trim(concat('/ ', coalesce(counterparty, '')), ' /') AS parties, coalesce(title, '') AS title, coalesce(signer, '') AS signer, total_amount, 'CNY' AS currency, 'active' AS status, 0 AS reviewed, 'llm' AS extract_source FROM nc""")
def r23_inserted_contracts(c, r, a):
    """Contracts of new documents, with ids that go on from the greatest."""
    return _inserts(c, r, a)["contracts"].select("id", "file_path", "parties", "title", "signer", "total_amount", "currency", "status", "reviewed", "extract_source")


@query("contracts", "receivables", "risk_alert", sql=f"""
WITH {_NEW} SELECT (SELECT max(id) FROM receivables) + row_number() OVER (ORDER BY nc.id, r.id, nullif(due_date, '') NULLS FIRST, amount NULLS FIRST, CASE WHEN amount > 30000 THEN r.status ELSE 'pending' END) AS id, nc.id AS contract_id, nullif(due_date, '') AS due_date, amount, CASE WHEN amount > 30000 THEN r.status ELSE 'pending' END AS status, 'regex' AS source
FROM receivables r JOIN nc ON r.contract_id = nc.old_id""")
def r23_inserted_receivables(c, r, a):
    """Their payments, under the new ids."""
    return _inserts(c, r, a)["receivables"].select("id", "contract_id", "due_date", "amount", "status", "source")


@query("contracts", "receivables", "risk_alert", sql=f"""
WITH {_NEW} SELECT (SELECT max(id) FROM risk_alert) + row_number() OVER (ORDER BY nc.id, a.id) AS id, nc.id AS contract_id, 'yellow' AS level, rule, message, '' AS evidence FROM risk_alert a JOIN nc ON a.contract_id = nc.old_id""")
def r23_inserted_alerts(c, r, a):
    """Their alerts, under the new ids."""
    return _inserts(c, r, a)["risk_alert"]


@query("contracts", sql=f"""
WITH n AS (SELECT id, {_CHANGES[0]}, {_CHANGES[1]} FROM contracts WHERE id % 3 <> 0)
SELECT c.id, CASE WHEN n.id IS NOT NULL THEN 'li' ELSE 'import' END AS updated_by, CASE WHEN n.id IS NOT NULL THEN '1998-06-15 09:00:00' ELSE '1998-01-01 00:00:00' END AS updated_at, CASE WHEN n.id IS NOT NULL THEN 2 END AS version FROM contracts c LEFT JOIN n USING (id)""")
def r24_touched(c):
    """Who wrote a row last, and when."""
    new = c.filter("id % 3 <> 0").selectExpr("id", *_CHANGES)
    old = c.select("id", "title", "direction", F.lit("import").alias("updated_by"), F.lit("1998-01-01 00:00:00").alias("updated_at"), F.lit(None).cast("int").alias("version"))
    return op.audited_update(old, new, "id", ["title", "direction"], operator="li", now_text="1998-06-15 09:00:00")[0].select("id", "updated_by", "updated_at", "version")


@query("notification_log", sql="SELECT * FROM notification_log WHERE success = 1 ORDER BY id DESC LIMIT 100")
def r20_delivered_notifications(n):
    return op.notification_list(n, success_only=True)


@query("contracts", sql=f"""
WITH n AS (SELECT id, {_CHANGES[0]}, {_CHANGES[1]} FROM contracts),
f AS (SELECT c.id, 'title' AS field, c.title AS o, n.title AS v, c.id % 2 = 0 AS written FROM contracts c JOIN n USING (id) UNION ALL SELECT c.id, 'direction', c.direction, n.direction, true FROM contracts c JOIN n USING (id))
SELECT id, 'update' AS action, 'ui_user' AS operator, field, coalesce(o, 'None') AS old_value, coalesce(v, 'None') AS new_value, '' AS note FROM f WHERE written AND coalesce(o, 'None') <> coalesce(v, 'None')""")
def r24_update_audit(c):
    new = c.selectExpr("id", *_CHANGES, "id % 2 = 0 AS set_title")
    return op.audited_update(c, new, "id", ["title", "direction"])[1]


@query("contracts", sql=f"""
WITH n AS (SELECT id, {_CHANGES[0]}, {_CHANGES[1]} FROM contracts WHERE id % 3 <> 0)
SELECT c.id, CASE WHEN n.id IS NOT NULL AND c.id % 2 = 0 THEN n.title ELSE c.title END AS title, CASE WHEN n.id IS NOT NULL THEN n.direction ELSE c.direction END AS direction,
  CASE WHEN n.id IS NOT NULL THEN coalesce(CASE WHEN c.id % 5 = 0 THEN NULL ELSE 3 END, 1) + 1 WHEN c.id % 5 = 0 THEN NULL ELSE 3 END AS version FROM contracts c LEFT JOIN n USING (id)""")
def r24_update_snapshot(c):
    new = c.filter("id % 3 <> 0").selectExpr("id", *_CHANGES, "id % 2 = 0 AS set_title")
    old = c.select("id", "title", "direction").withColumn("version", F.when(F.col("id") % 5 != 0, 3))
    return op.audited_update(old, new, "id", ["title", "direction"])[0]


@query("contracts", sql="""
SELECT id, CASE WHEN id % 5 = 0 THEN 1 ELSE reviewed END AS reviewed, CASE WHEN id % 5 = 0 THEN 'terminated' ELSE status END AS status FROM contracts""")
def r25_reject(c):
    return op.review(c, c.filter("id % 5 = 0").select("id"), reject=True)[0].select("id", "reviewed", "status")


@query("contracts", sql="""
SELECT id, 'reject' AS action, 'ui_user' AS operator, '' AS field, '' AS old_value, '' AS new_value, '金额不符' AS note FROM contracts WHERE id % 5 = 0
UNION ALL SELECT id, 'review', 'li', '', '', '', '复核通过, 进入回款日程' FROM contracts WHERE id % 7 = 0""")
def r25_review_audit(c):
    rejected = op.review(c, c.filter("id % 5 = 0"), reject=True, reason="金额不符")[1]
    return rejected.unionByName(op.review(c, c.filter("id % 7 = 0"), operator="li")[1])


@query("contracts", sql="SELECT id, 'review' AS stage, 'REJECTED' AS error_code, '金额不符' AS message, file_path FROM contracts WHERE id % 5 = 0")
def r25_review_errors(c):
    return op.review(c, c.filter("id % 5 = 0"), reject=True, reason="金额不符")[2].unionByName(op.review(c, c.filter("id % 7 = 0"), reject=True)[2])


@query("contracts", sql="""
SELECT id, title, confidence, CASE WHEN CASE WHEN json_valid(structured_json) AND list_contains(json_keys(CASE WHEN json_valid(structured_json) THEN structured_json END), 'valid')
  THEN coalesce(TRY_CAST(json_extract_string(structured_json, '$.valid') AS BOOLEAN), false) ELSE coalesce(total_amount > 0, false) END THEN 'approved' ELSE 'blocked' END AS decision
FROM contracts WHERE reviewed = 0 AND confidence >= 0.8""")
def r26_batch_approval(c):
    return op.batch_approval(c, 0.8)


@query("contracts", sql="SELECT *, '' AS updated_by, '' AS updated_at, 1 AS version FROM contracts")
def r27_migrated(c):
    return op.migrated(c, {"status": ("string", "active"), "updated_by": ("string", ""), "updated_at": ("string", ""), "version": ("int", 1)})


@query("error_log", sql="SELECT * FROM error_log WHERE stage = 'ingest' ORDER BY id DESC LIMIT 1000")
def f1_optional_predicates(e):
    return op.error_list(e, stage="ingest", limit=1000)


@query("audit", sql="SELECT * FROM audit ORDER BY id DESC LIMIT 5")
def k8_retention(a):
    return op.newest(a, "id", 5)
