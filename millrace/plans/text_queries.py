"""Queries of text work (T*, F6, F8, A3, A9, A11, S10, S11), with their DuckDB counterparts where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as tx

from .proxies import tables, with_sql

QUERIES, SQL = {}, {}
NAMES = ("锐新科技",)


def query(*needs, sql=None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*tables(spark, sf_dir, *needs))
        if sql:
            SQL[f.__name__] = with_sql(sql, *needs)
        return f

    return add


def extracted(t):
    return tx.extract_contracts(t, "text", F.col("base_date").cast("date"), NAMES)


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _any(s: str, words) -> str:
    return "(" + " OR ".join(f"contains({s}, '{w}')" for w in words) + ")"


def _amount(s: str) -> str:
    value = f"TRY_CAST(regexp_replace(regexp_extract(m, {_q(tx.NUMBER)}), '[,，]', '', 'g') AS DOUBLE) * CASE WHEN contains(m, '万') THEN 10000.0 ELSE 1.0 END"
    return f"round(list_max(list_transform(regexp_extract_all({s}, {_q(tx.AMOUNT)}), lambda m: {value})), 2)"


def _date(s: str, pattern: str, first: int = 1) -> str:
    y, m, d = (f"regexp_extract({s}, {_q(pattern)}, {first + i})" for i in range(3))
    return f"coalesce(CAST(TRY_CAST({y} || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') AS DATE) AS VARCHAR), '')"


_SEGS = "seg AS (SELECT id, base_date, trim(unnest(regexp_split_to_array(text, '[。\n;；]'))) AS s, generate_subscripts(regexp_split_to_array(text, '[。\n;；]'), 1) AS i FROM texts)"
_DUE = f"CASE WHEN regexp_matches(s, {_q(tx.DATE)}) THEN {_date('s', tx.DATE)} WHEN regexp_extract(s, {_q(tx.RELATIVE_DATE)}, 1) IN ('签订', '签署', '生效') THEN CAST(CAST(base_date AS DATE) + TRY_CAST(regexp_extract(s, {_q(tx.RELATIVE_DATE)}, 2) AS INT) AS VARCHAR) ELSE '' END"
_PAY = f"pay AS (SELECT id, i, {_amount('s')} AS amount, {_DUE} AS due_date, substr(regexp_replace(s, {_q(tx.ORDINAL)}, ''), 1, 120) AS condition_text FROM seg WHERE s <> '' AND NOT {_any('s', tx.PENALTY_KEYS)} AND {_any('s', tx.PAYMENT_KEYS)})"
_TOTAL = f"total AS (SELECT id, arg_min(v, i) AS total_amount FROM (SELECT id, i, {_amount('s')} AS v FROM seg WHERE {_any('s', tx.TOTAL_KEYS)}) WHERE v IS NOT NULL GROUP BY id)"


_EVIDENCE = "CASE " + " ".join(f"WHEN contains(text, '{k}') THEN substr(text, greatest(strpos(text, '{k}') - 10, 1), least(strpos(text, '{k}') - 1, 10) + 40)" for k in ("违约", "滞纳金", "罚则", "逾期")) + " ELSE '全文未找到违约/滞纳金相关条款' END"


@query("texts", sql=f"WITH {_SEGS} SELECT id, s AS segment, {_amount('s')} AS amount FROM seg WHERE s <> ''")
def t1_parse_amount(t):
    segs = t.select("id", F.explode(F.split("text", "[。\n;；]")).alias("s")).select("id", F.trim("s").alias("segment")).filter("segment <> ''")
    return segs.withColumn("amount", tx.parse_amount("segment"))


@query("texts", sql=f"WITH {_SEGS}, {_PAY} SELECT id, amount, due_date, condition_text FROM pay WHERE amount IS NOT NULL")
def t2_payments(t):
    return extracted(t).select("id", F.explode("payments").alias("p")).select("id", "p.amount", "p.due_date", "p.condition_text")


@query("texts", sql=rf"""
SELECT id, trim(regexp_extract(substr(text, 1, 800), {_q('甲' + tx.PARTY)}, 1)) AS party_a, trim(regexp_extract(substr(text, 1, 800), {_q('乙' + tx.PARTY)}, 1)) AS party_b,
  regexp_extract(substr(text, 1, 600), {_q('(?i)' + tx.CONTRACT_NO)}, 1) AS contract_no, regexp_extract(text, '(?:甲方代表|乙方代表|委托代理人|负责人|签署人|签字人)\s*[:：]\s*([\x{{4e00}}-\x{{9fa5}}A-Za-z]{{2,10}})', 1) AS signer FROM texts""")
def t5_parties_and_numbers(t):
    head = F.substring("text", 1, 800)
    return t.select("id", tx.party(head, "甲").alias("party_a"), tx.party(head, "乙").alias("party_b"), F.regexp_extract(F.substring("text", 1, 600), "(?iU)" + tx.CONTRACT_NO, 1).alias("contract_no"), F.regexp_extract("text", "(?U)" + tx.SIGNER, 1).alias("signer"))


_SIDES = f"sides AS (SELECT id, trim(regexp_extract(substr(text, 1, 800), {_q('甲' + tx.PARTY)}, 1)) AS a, trim(regexp_extract(substr(text, 1, 800), {_q('乙' + tx.PARTY)}, 1)) AS b FROM texts)"


@query("texts", sql=f"""
WITH {_SEGS}, {_SIDES}, p AS (SELECT id, s, {_amount('s')} AS amount, regexp_extract(s, {_q(tx.ROLE + '向[ ]*' + tx.ROLE)}, 1) AS x, regexp_extract(s, {_q(tx.ROLE + '向[ ]*' + tx.ROLE)}, 2) AS y
  FROM seg WHERE s <> '' AND NOT {_any('s', tx.PENALTY_KEYS)} AND {_any('s', tx.PAYMENT_KEYS)})
SELECT id, CASE WHEN x IN ('甲方', '发包方', '买方', '委托方', '需方') THEN a WHEN x IN ('乙方', '承包方', '卖方', '受托方', '供方') THEN b ELSE x END AS payer,
  CASE WHEN y IN ('甲方', '发包方', '买方', '委托方', '需方') THEN a WHEN y IN ('乙方', '承包方', '卖方', '受托方', '供方') THEN b ELSE y END AS payee,
  CASE WHEN y <> '' AND contains(CASE WHEN y = '甲方' THEN a ELSE b END, '锐新科技') THEN 'receivable' WHEN x <> '' AND contains(CASE WHEN x = '甲方' THEN a ELSE b END, '锐新科技') THEN 'payable' ELSE 'receivable' END AS direction
FROM p JOIN sides USING (id) WHERE amount IS NOT NULL""")
def t6_payer_and_payee(t):
    return extracted(t).select("id", F.explode("payments").alias("p")).select("id", "p.payer", "p.payee", "p.direction")


_HEADED = "concat('合同名称：', CASE WHEN id % 3 = 0 THEN concat('HT-', CAST(10000 + id AS STRING)) ELSE concat('设备采购 ', CAST(id AS STRING)) END, chr(10), CASE WHEN id % 2 = 0 THEN concat('终止日期：2031-2-', CAST(1 + id % 31 AS STRING)) ELSE concat('2030年1月2日至2031年', CAST(1 + id % 13 AS STRING), '月4日') END, chr(10), text)"


@query("texts", sql=f"""
WITH h AS (SELECT id, {_HEADED.replace('STRING', 'VARCHAR')} AS t FROM texts),
x AS (SELECT id, t, regexp_extract(substr(t, 1, 600), {_q('(?i)' + tx.CONTRACT_NO)}, 1) AS no, trim(regexp_extract(substr(t, 1, 500), {_q(tx.TITLE.replace(chr(92) + 's*(', '[ ' + chr(92) + 'n]*('))}, 1)) AS title FROM h)
SELECT id, CASE WHEN title = no OR regexp_full_match(title, '[A-Za-z0-9/-]+') OR (no <> '' AND contains(title, no)) OR starts_with(title, '编号') THEN '' ELSE title END AS title,
  CASE WHEN {_date('substr(t, 1, 1200)', tx.END)} <> '' THEN {_date('substr(t, 1, 1200)', tx.END)} ELSE {_date('substr(t, 1, 1200)', tx.RANGE, 4)} END AS end_date,
  CASE WHEN {_date('substr(t, 1, 800)', tx.START)} <> '' THEN {_date('substr(t, 1, 800)', tx.START)} ELSE {_date('substr(t, 1, 1200)', tx.RANGE)} END AS start_date FROM x""")
def t7_title_and_dates(t):
    return extracted(t.withColumn("text", F.expr(_HEADED))).select("id", "title", "end_date", "start_date")


@query("texts", sql=f"""
WITH {_SEGS}, {_PAY}, {_TOTAL}, p AS (SELECT id, count(*) AS n, round(sum(amount), 2) AS paid, count(*) FILTER (WHERE due_date <> '') AS dated FROM pay WHERE amount IS NOT NULL GROUP BY id)
SELECT t.id, total_amount, coalesce(n, 0) AS n_payments, NOT coalesce(total_amount <> 0 AND paid > 0 AND abs(paid - total_amount) / total_amount > 0.01, false) AS valid,
  {_date('substr(text, 1, 800)', tx.START)} AS start_date, round(0.5::DOUBLE + 0.05::DOUBLE * (CAST(coalesce(n, 0) > 0 AS INT) + CAST(coalesce(total_amount, 0) <> 0 AS INT) + 1) - 0.05::DOUBLE * CAST(coalesce(n, 0) > 0 AND dated = 0 AS INT), 3) AS confidence
FROM texts t LEFT JOIN total USING (id) LEFT JOIN p USING (id)""")
def t14_reconciliation(t):
    return extracted(t).select("id", "total_amount", F.size("payments").cast("long").alias("n_payments"), "valid", "start_date", "confidence")


@query("texts", sql=f"""
WITH {_SEGS}, {_PAY}, {_TOTAL}, p AS (SELECT id, sum(amount) AS paid, count(*) FILTER (WHERE due_date <> '') AS dated FROM pay WHERE amount IS NOT NULL GROUP BY id),
x AS (SELECT t.id, t.text, coalesce(total_amount, 0) AS total, paid, dated, {_any('text', tx.PENALTY_KEYS)} AS pen FROM texts t LEFT JOIN total USING (id) LEFT JOIN p USING (id))
SELECT id, 'red' AS level, 'amount_mismatch' AS rule, '金额矛盾: 条款合计 ' || format('{{:,}}', CAST(round_even(paid, 0) AS BIGINT)) || ' ≠ 合同总额 ' || format('{{:,}}', CAST(round_even(total, 0) AS BIGINT)) AS message,
  '合同总额=' || CAST(total AS VARCHAR) || ', 条款合计=' || CAST(paid AS VARCHAR) AS evidence FROM x WHERE total <> 0 AND paid > 0 AND abs(paid - total) / total > 0.01
UNION ALL SELECT id, 'yellow', 'missing_penalty', '缺少违约条款: 所有收付款条目均无违约金/滞纳金约定', {_EVIDENCE} FROM x WHERE paid IS NOT NULL AND NOT pen
UNION ALL SELECT id, 'yellow', 'missing_signer', '未识别到签单人/负责人, 提醒将降级发送给默认联系人', 'signer 字段为空' FROM x WHERE NOT contains(text, '负责人')
UNION ALL SELECT id, 'red', 'missing_amount', '未抽取到任何金额: 合同总额和条款金额均为空', 'total_amount=null, payments 无有效金额' FROM x WHERE total = 0 AND coalesce(paid, 0) = 0
UNION ALL SELECT id, 'yellow', 'no_due_date', '所有条款均无绝对到期日, 回款日程无法自动排列, 需人工补充', '所有 payments[].due_date 为空' FROM x WHERE paid IS NOT NULL AND dated = 0""")
def t17_risk_rules(t):
    return extracted(t).select("id", F.explode(tx.risks(F.col("text"))).alias("r")).select("id", "r.*")


@query("texts", sql="SELECT id, 'receivable' AS direction, '锐新科技' || regexp_extract(text, '锐新科技(\\d+)', 1) || '号公司' AS our_party, regexp_extract(text, '：(Customer#\\d+)', 1) AS counterparty FROM texts")
def t12_our_party_and_direction(t):
    return extracted(t).select("id", "direction", "our_party", "counterparty")


_PARTIES = """SELECT o_orderkey AS id, c_name AS name, CASE o_orderkey % 5 WHEN 0 THEN concat('甲方（买方）：', c_name, '，乙方（卖方）：锐新科技股份') WHEN 1 THEN concat('甲方: 华远贸易；乙方: ', c_name) WHEN 2 THEN concat('由锐新科技与', c_name, '签订')
  WHEN 3 THEN concat(c_name, '与某公司') ELSE concat('甲方（委托方）锐新科技，乙方：华远') END AS parties, CASE o_orderkey % 3 WHEN 0 THEN '锐新科技' WHEN 1 THEN c_name END AS payer, CASE o_orderkey % 4 WHEN 0 THEN '华远贸易' WHEN 1 THEN c_name END AS payee FROM orders JOIN customer ON o_custkey = c_custkey"""
_NAMES = ("锐新科技", "华远")


def t12_one_line_parties(spark, sf_dir):
    """Our party, the other one and the direction where both parties stand in one line, or in no role at all."""
    for t in ("orders", "customer"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"millrace_t12_{t}")
    rows = spark.sql(_PARTIES.replace("FROM orders JOIN customer", "FROM millrace_t12_orders JOIN millrace_t12_customer"))
    ours, other = tx.our_party(tx.party("parties", "甲"), tx.party("parties", "乙"), _NAMES, F.col("parties"))
    way = tx.direction(F.coalesce("payer", F.lit("")), F.coalesce("payee", F.lit("")), _NAMES)
    return rows.select("id", ours.alias("our_party"), other.alias("counterparty"), way.alias("direction"))


QUERIES["t12_one_line_parties"] = t12_one_line_parties
SQL["t12_one_line_parties"] = f"""
WITH p AS ({_PARTIES}) SELECT id, CASE id % 5 WHEN 0 THEN '锐新科技股份' WHEN 1 THEN '华远贸易' WHEN 2 THEN '锐新科技' WHEN 3 THEN '' ELSE '锐新科技' END AS our_party,
  CASE id % 5 WHEN 0 THEN name WHEN 1 THEN name WHEN 2 THEN '' WHEN 3 THEN '' ELSE '华远' END AS counterparty,
  CASE WHEN payee LIKE '%华远%' THEN 'receivable' WHEN payer LIKE '%锐新%' THEN 'payable' ELSE 'receivable' END AS direction FROM p"""


def _large(text):
    """An added rule: a contract of a large total."""
    return tx.alert(F.col("total_amount") > 200_000, "yellow", "large_total", F.lit("large"), F.col("total_amount").cast("long").cast("string"))


@query("contracts", "receivables", sql="""
WITH r AS (SELECT contract_id, count(*) AS n, sum(amount) AS paid, count(due_date) AS dated, count(*) FILTER (WHERE id % 3 = 0 AND contract_id % 2 = 0) AS pen FROM receivables GROUP BY contract_id),
f AS (SELECT c.id, coalesce(total_amount, 0) AS total, coalesce(signer, '') AS signer, CASE WHEN c.id % 6 = 0 THEN '' ELSE counterparty END AS our, CASE WHEN c.id % 10 = 0 THEN 'unknown' ELSE direction END AS way,
  CAST(CAST(created_at AS DATE) AS VARCHAR) AS s, CASE c.id % 3 WHEN 0 THEN '1991-06-01' WHEN 1 THEN '' ELSE '2099-01-01' END AS e, coalesce(n, 0) AS n, coalesce(paid, 0) AS paid, coalesce(dated, 0) AS dated, coalesce(pen, 0) AS pen FROM contracts c LEFT JOIN r ON r.contract_id = c.id)
SELECT id, 'red' AS level, 'amount_mismatch' AS rule, '' AS evidence FROM f WHERE total <> 0 AND paid > 0 AND abs(paid - total) / total > 0.01
UNION ALL SELECT id, 'red', 'date_contradiction', 'start_date=' || s || ', end_date=' || e FROM f WHERE e <> '' AND e < s
UNION ALL SELECT id, 'yellow', 'missing_penalty', '全文未找到违约/滞纳金相关条款' FROM f WHERE n > 0 AND pen = 0
UNION ALL SELECT id, 'yellow', 'missing_signer', 'signer 字段为空' FROM f WHERE trim(signer) = ''
UNION ALL SELECT id, 'yellow', 'party_unidentified', 'our_party 字段为空' FROM f WHERE our = ''
UNION ALL SELECT id, 'red', 'missing_amount', 'total_amount=null, payments 无有效金额' FROM f WHERE total = 0 AND paid = 0
UNION ALL SELECT id, 'yellow', 'no_due_date', '所有 payments[].due_date 为空' FROM f WHERE n > 0 AND dated = 0
UNION ALL SELECT id, 'yellow', 'direction_unknown', 'direction=unknown, 无法判定应收/应付' FROM f WHERE way = 'unknown'
UNION ALL SELECT id, 'yellow', 'large_total', CAST(CAST(trunc(total) AS BIGINT) AS VARCHAR) FROM f WHERE total > 200000""")
def t17_rules_on_fields(c, r):
    """All rules, and an added one, on the fields of contracts."""
    penalty = F.when((F.col("id") % 3 == 0) & (F.col("contract_id") % 2 == 0), "0.1%").otherwise(" ")
    pays = r.groupBy("contract_id").agg(F.collect_list(F.struct("amount", F.coalesce("due_date", F.lit("")).alias("due_date"), penalty.alias("penalty"))).alias("payments"))
    end = F.when(F.col("id") % 3 == 0, "1991-06-01").when(F.col("id") % 3 == 1, "").otherwise("2099-01-01")
    rows = c.join(pays, c["id"] == pays["contract_id"], "left").select(
        "id",
        "total_amount",
        F.coalesce("signer", F.lit("")).alias("signer"),
        F.when(F.col("id") % 6 == 0, "").otherwise(F.col("counterparty")).alias("our_party"),
        F.when(F.col("id") % 10 == 0, "unknown").otherwise(F.col("direction")).alias("direction"),
        F.col("created_at").cast("date").cast("string").alias("start_date"),
        end.alias("end_date"),
        F.coalesce("payments", F.array().cast(pays.schema["payments"].dataType)).alias("payments"),
    )
    found = rows.select("id", F.explode(tx.risks(F.lit("no clause"), [_large])).alias("a")).select("id", "a.level", "a.rule", "a.evidence")
    return found.withColumn("evidence", F.when(F.col("rule") == "amount_mismatch", "").otherwise(F.col("evidence")))


def _fix(s: str) -> str:
    for a, b in (("O", "0"), ("[Il]", "1"), ("S", "5"), ("B", "8"), ("Z", "2")):
        for _ in range(2):  # matches share a digit
            s = f"regexp_replace({s}, '([0-9]){a}([0-9])', '\\1{b}\\2', 'g')"
    return s


@query("marks", sql=f"SELECT id, {_fix('predicted')} AS fixed, predicted <> {_fix('predicted')} AS changed FROM marks")
def t18_corrections(m):
    fixed, log = tx.corrected("predicted")
    return m.select("id", fixed.alias("fixed"), (F.size(log) > 0).alias("changed"))


@query("marks", sql="""
WITH t AS (SELECT id, concat(predicted, CASE WHEN id % 3 = 0 THEN 'G' WHEN id % 3 = 1 THEN ' 12GE 7G' ELSE ' 123456' END) AS t FROM marks)
SELECT id, regexp_replace(t, '([0-9])G\\b', '\\16', 'g') AS fixed, t <> regexp_replace(t, '([0-9])G\\b', '\\16', 'g') AS changed FROM t""")
def t18_optional_corrections(m):
    """The rules that are off by default."""
    tail = F.when(F.col("id") % 3 == 0, "G").when(F.col("id") % 3 == 1, " 12GE 7G").otherwise(" 123456")
    fixed, log = tx.corrected(F.concat("predicted", tail), (tx.SERIAL_NUMBERS, tx.TRAILING_G))
    return m.select("id", fixed.alias("fixed"), (F.size(log) > 0).alias("changed"))


def _norm(c: str) -> str:
    return f"upper(replace(trim({c}), ' ', ''))"


@query("marks", sql=f"SELECT id, round(levenshtein({_norm('predicted')}, {_norm('truth')})::DOUBLE / length({_norm('truth')}), 9) AS cer, round(levenshtein(predicted, truth)::DOUBLE / length(truth), 9) AS cer_raw, {_norm('predicted')} = {_norm('truth')} AS exact FROM marks")
def t20_cer(m):
    c = tx.cer("predicted", "truth")
    return m.select("id", F.round(c, 9).alias("cer"), F.round(tx.cer("predicted", "truth", False), 9).alias("cer_raw"), (c == 0).alias("exact"))


@query("marks", sql=f"SELECT count(*) AS n, count(*) FILTER (WHERE {_norm('predicted')} = {_norm('truth')}) AS exact, round(avg(levenshtein({_norm('predicted')}, {_norm('truth')})::DOUBLE / length({_norm('truth')})), 6) AS mean_cer FROM marks")
def a9_ocr_summary(m):
    c = tx.cer("predicted", "truth")
    return m.agg(F.count(F.lit(1)).alias("n"), F.count_if(c == 0).alias("exact"), F.round(F.avg(c), 6).alias("mean_cer"))


@query("marks", sql="""
WITH w AS (SELECT id, regexp_split_to_array(predicted, '\\s+') AS p, regexp_split_to_array(truth, '\\s+') AS t FROM marks)
SELECT id, round((CAST(p[1] <> t[1] AS INT) + CAST(p[2] <> t[2] AS INT) + CAST(p[3] <> t[3] AS INT)) / 3.0, 9) AS wer FROM w""")
def t21_wer(m):
    return m.select("id", F.round(tx.wer("predicted", "truth"), 9).alias("wer"))


@query("marks", sql="SELECT id, left(sha1(predicted), 16) AS short_sha1, sha256(predicted) AS sha FROM marks")
def t32_hashes(m):
    return m.select("id", F.substring(F.sha1("predicted"), 1, 16).alias("short_sha1"), F.sha2("predicted", 256).alias("sha"))


@query("files", sql=r"""
SELECT id, left(regexp_replace(content, '["''`$\;\n\r]', '', 'g'), 200) AS clean, coalesce(nullif(regexp_replace(trim(left(file_name, 5)), '[\\/:*?"<>|.]', '_', 'g'), ''), '_') AS safe FROM files""")
def t29_sanitised(f):
    return f.select("id", tx.sanitised("content").alias("clean"), tx.safe_name(F.substring("file_name", 1, 5)).alias("safe"))


@query("files", sql="SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(content), '[a-z]+')) AS w FROM files) GROUP BY w ORDER BY n DESC, w LIMIT 20")
def a11_top_words(f):
    words = f.select(F.explode(F.regexp_extract_all(F.lower("content"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "word").limit(20)


@query("files", sql="""
SELECT string_agg(word, '.' ORDER BY n DESC, word) AS prompt FROM (SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(content), '[a-z]+')) AS w FROM files) GROUP BY w ORDER BY n DESC, w LIMIT 8)""")
def a11_prompt_candidate(f):
    """The most frequent words as one prompt."""
    return tx.joined_words(f.select(F.explode(F.regexp_extract_all(F.lower("content"), F.lit("[a-z]+"), F.lit(0))).alias("word")), 8)


@query("contracts", "receivables", sql="""
WITH r AS (SELECT contract_id, count(*) AS n, count(due_date) AS dated, count(*) FILTER (WHERE amount <> 0) AS paid FROM receivables GROUP BY contract_id)
SELECT c.id, round(least(1, CASE WHEN c.id % 2 = 0 THEN 0.5::DOUBLE ELSE 0.85::DOUBLE END + 0.05::DOUBLE * (CAST(coalesce(paid, 0) > 0 AS INT) + CAST(coalesce(total_amount, 0) <> 0 AS INT) + CAST(coalesce(signer, '') <> '' AS INT)) - 0.05::DOUBLE * CAST(coalesce(n, 0) > 0 AND dated = 0 AS INT)), 3) AS confidence
FROM contracts c LEFT JOIN r ON r.contract_id = c.id""")
def t15_confidence(c, r):
    """Confidence of extractions by rules and by a model."""
    pays = r.groupBy("contract_id").agg(F.collect_list(F.struct("amount", F.coalesce("due_date", F.lit("")).alias("due_date"))).alias("payments"))
    rows = c.join(pays, c["id"] == pays["contract_id"], "left")
    return rows.select("id", tx.confidence(F.when(F.col("id") % 2 == 0, "regex").otherwise("llm"), F.col("payments"), F.col("total_amount"), F.col("signer")).alias("confidence"))


_TAGGED = "concat(content, chr(10), '付款说明 ', CAST(id AS STRING), chr(10), content, chr(10), '违约责任 ', content)"


@query("files", sql=f"""
WITH RECURSIVE t AS (SELECT id, {_TAGGED.replace('STRING', 'VARCHAR')} AS t FROM files),
m AS (SELECT id, substr(t, 3001, length(t) - 5000) AS mid FROM t WHERE length(t) > 12000),
p AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) AS k, x FROM (SELECT id, unnest(string_split(mid, chr(10))) AS x, generate_subscripts(string_split(mid, chr(10)), 1) AS i FROM m) WHERE {_any('x', tx.TRUNCATION_KEYS)}),
g AS (SELECT id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS used FROM m UNION ALL SELECT g.id, p.k, g.used + length(p.x) + 1 FROM g JOIN p ON p.id = g.id AND p.k = g.k + 1 WHERE g.used < 7000),
u AS (SELECT id, max(k) AS k, max(used) AS used FROM g GROUP BY id),
j AS (SELECT u.id, u.used, list(p.x ORDER BY p.k) FILTER (WHERE p.x IS NOT NULL) AS xs FROM u LEFT JOIN p ON p.id = u.id AND p.k <= u.k GROUP BY u.id, u.used)
SELECT t.id, CASE WHEN length(t) <= 12000 THEN t ELSE substr(t, 1, 3000) || chr(10) || '[...]' || chr(10)
  || array_to_string(coalesce(xs, []) || CASE WHEN used < 3500 THEN [substr(mid, 1, 7000 - used)] ELSE [] END, chr(10)) || chr(10) || '[...]' || chr(10) || right(t, 2000) END AS text
FROM t LEFT JOIN m USING (id) LEFT JOIN j USING (id)""")
def t10_truncated(f):
    return f.select("id", tx.truncated(F.expr(_TAGGED)).alias("text"))


@query("files", sql="""
SELECT id, CASE WHEN content IS NULL THEN 'FILE_NOT_FOUND' WHEN length(content) > 20000 THEN 'FILE_TOO_LARGE' WHEN id > f THEN 'DUPLICATE' WHEN length(trim(content)) < 30 THEN 'EMPTY_TEXT' END AS error_code
FROM (SELECT *, min(id) OVER (PARTITION BY content) AS f FROM files)""")
def f8_ingest_errors(f):
    first = f.groupBy(F.sha2(F.col("content").cast("binary"), 256).alias("h")).agg(F.min("id").alias("f"))
    rows = f.withColumn("h", F.sha2(F.col("content").cast("binary"), 256)).join(first, "h", "left")
    code = F.when(F.col("content").isNull(), "FILE_NOT_FOUND").when(F.length("content") > 20000, "FILE_TOO_LARGE").when(F.col("id") > F.col("f"), "DUPLICATE").when(F.length(F.trim("content")) < 30, "EMPTY_TEXT")
    return rows.select("id", code.alias("error_code"))


@query("files")
def t23_markdown(f):
    md = tx.lines_to_markdown(F.split("content", "\n"))
    return f.select("id", md.alias("markdown"), tx.markdown_parts(md).alias("parts"), tx.markdown_stats(md).alias("stats"))


@query("receivables", sql="""
SELECT contract_id, CASE WHEN count(*) FILTER (WHERE direction = 'unknown') = count(*) THEN 'unknown' WHEN count(*) FILTER (WHERE direction = 'receivable') >= count(*) FILTER (WHERE direction = 'payable') THEN 'receivable' ELSE 'payable' END AS direction
FROM receivables GROUP BY contract_id""")
def a3_majority_direction(r):
    return r.groupBy("contract_id").agg(tx.majority_of("direction").alias("direction"))


@query("marks", sql="WITH w(word, english) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in tx.PROMPT_WORDS.items()) + """), words AS (SELECT list(word ORDER BY word) AS ws FROM w),
m AS (SELECT row_number() OVER () AS r, id, ['', 'xyz', ws[1 + id % len(ws)], ' ' || ws[1 + (id // 7) % len(ws)], predicted] AS terms FROM marks, words),
x AS (SELECT r, id, trim(unnest(string_split(replace(array_to_string(terms, '。'), '。', '.'), '.'))) AS t, generate_subscripts(string_split(replace(array_to_string(terms, '。'), '。', '.'), '.'), 1) AS i FROM m)
SELECT id, string_agg(coalesce(english, t), '.' ORDER BY i) AS prompt FROM x LEFT JOIN w ON w.word = x.t WHERE t <> '' GROUP BY r, id""")
def t26_translated_prompt(m):
    words = F.array(*[F.lit(w) for w in sorted(tx.PROMPT_WORDS)])
    pick = lambda n: F.get(words, F.pmod(n, F.lit(len(tx.PROMPT_WORDS))).cast("int"))
    terms = F.array(F.lit(""), F.lit("xyz"), pick(F.col("id")), F.concat(F.lit(" "), pick(F.floor(F.col("id") / 7))), F.col("predicted"))
    return m.select("id", tx.translated_prompt(F.array_join(terms, "。")).alias("prompt"))


@query("contracts")
def t11_whole_json(c):
    cut = F.concat(F.lit('```json\n{"id": '), F.col("id").cast("string"), F.lit(', "items": [{"a": 1}, {"a": "x'))
    return c.select("id", tx.whole_json(F.when(F.col("id") % 2 == 0, cut).otherwise(F.col("structured_json"))).alias("json"))
