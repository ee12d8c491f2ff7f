"""Receivables analytics: ledger, balances, trends, rankings, reminders, review and audit.

All functions take and return DataFrames. Children are aggregated before they are joined, so a contract with many
receivables and many collections doesn't fan out, and each side is shuffled by its key once. "Today" is always a
parameter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import number_text

from . import ranks


def money(c: Column) -> Column:
    return F.round(F.coalesce(c, F.lit(0.0)), 2)


def per_contract(children: DataFrame, name: str) -> DataFrame:
    return children.groupBy("contract_id").agg(F.sum("amount").alias(name))


def contract_balances(contracts: DataFrame, receivables: DataFrame, collections: DataFrame) -> DataFrame:
    """Contracts with what is due, what came in and what is open: max(total, due) - collected."""
    due, paid = per_contract(receivables, "receivable_sum"), per_contract(collections, "collected_sum")
    joined = contracts.join(due, contracts["id"] == due["contract_id"], "left").drop("contract_id")
    joined = joined.join(paid, joined["id"] == paid["contract_id"], "left").drop("contract_id")
    zero = F.lit(0.0)
    total = F.greatest(F.coalesce("total_amount", zero), F.coalesce("receivable_sum", zero))
    return joined.select(*contracts.columns, money(F.col("receivable_sum")).alias("receivable_sum"), money(F.col("collected_sum")).alias("collected_sum"), F.round(total - F.coalesce("collected_sum", zero), 2).alias("outstanding")).orderBy(F.col("id").desc())


def receivable_list(receivables: DataFrame, contracts: DataFrame) -> DataFrame:
    """Receivables with their contract, by due date, undated ones last."""
    c = contracts.select(F.col("id").alias("c_id"), F.col("title").alias("contract_title"), "signer", "counterparty")
    joined = receivables.join(c, receivables["contract_id"] == c["c_id"], "left").drop("c_id")
    return joined.orderBy(F.col("due_date").asc_nulls_last(), "id")


def reminder_candidates(receivables: DataFrame, contracts: DataFrame) -> DataFrame:
    """Receivables of reviewed contracts."""
    c = contracts.filter("reviewed = 1").select(F.col("id").alias("c_id"), F.col("title").alias("contract_title"), "file_path", "signer")
    return receivables.join(c, receivables["contract_id"] == c["c_id"]).drop("c_id")


def reminder_level(days_left: Column) -> Column:
    """overdue, 1d, 3d, 7d, or null while more than a week is left."""
    return F.when(days_left < 0, "overdue").when(days_left <= 1, "1d").when(days_left <= 3, "3d").when(days_left <= 7, "7d")


def due_reminders(receivables: DataFrame, contracts: DataFrame, today: str) -> DataFrame:
    """Reminders to send today: pending, dated, and not reminded at the present level yet."""
    days = F.datediff(F.expr("try_cast(due_date AS DATE)"), F.lit(today).cast("date"))
    rows = reminder_candidates(receivables.filter("status = 'pending'"), contracts).withColumn("days_left", days).filter("days_left is not null")
    rows = rows.withColumn("level", reminder_level(F.col("days_left"))).filter("level is not null")
    sent = reduce(lambda rest, lv: F.when(F.col("level") == lv, F.col(f"reminded_{lv}")).otherwise(rest), ("overdue", "1d", "3d", "7d"), F.lit(0))
    name = F.element_at(F.split("file_path", "/"), -1)
    title = F.coalesce(F.nullif("contract_title", F.lit("")), F.nullif(name, F.lit("")), F.lit("合同"))
    head = F.concat(F.col("title"), F.lit(" · "), number_text(F.col("amount")), F.lit(" "), F.col("currency"), F.lit(" · "))
    when = F.when(F.col("days_left") < 0, F.concat(F.lit("已逾期 "), (-F.col("days_left")).cast("string"), F.lit(" 天 (原定 "), F.col("due_date"), F.lit(")")))
    when = when.otherwise(F.concat(F.col("days_left").cast("string"), F.lit("天后到期 ("), F.col("due_date"), F.lit(")")))
    signer = F.when(F.coalesce("signer", F.lit("")) != "", F.concat(F.lit(" · 签单人: "), F.col("signer"))).otherwise("")
    rows = rows.filter(F.coalesce(sent, F.lit(0)) == 0).withColumn("title", title)
    return rows.select("id", "title", "due_date", "days_left", "level", F.concat(head, when, signer).alias("message"))


def mark_reminded(receivables: DataFrame, fired: DataFrame) -> DataFrame:
    """Receivables with the flag of each delivered level set."""
    got = fired.select(F.col("id").alias("f_id"), "level").distinct()
    rows = receivables.join(got, receivables["id"] == got["f_id"], "left")
    flags = {f"reminded_{lv}": F.when(F.col("level") == lv, 1).otherwise(F.col(f"reminded_{lv}")) for lv in ("7d", "3d", "1d", "overdue")}
    return rows.withColumns(flags).select(*receivables.columns)


def any_of(predicates: list[Column]) -> Column:
    """All given predicates; none given means every row."""
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def error_list(errors: DataFrame, stage: str = "", error_code: str = "", file_path: str = "", limit: int = 50) -> DataFrame:
    """Latest errors; text filters ignore case."""
    tests = [F.col("stage") == stage] if stage else []
    tests += [F.col(c).ilike(f"%{v}%") for c, v in (("error_code", error_code), ("file_path", file_path)) if v]
    return errors.filter(any_of(tests)).orderBy(F.col("id").desc()).limit(limit)


def pending_review(contracts: DataFrame) -> DataFrame:
    """Unreviewed contracts, least confident first."""
    return contracts.filter("reviewed = 0").orderBy(F.col("confidence").asc(), F.col("id").desc())


def contract_details(contracts: DataFrame, receivables: DataFrame) -> DataFrame:
    """Each contract with its receivables nested, in order of due date."""
    item = F.struct(F.col("due_date").isNull().alias("undated"), "due_date", F.col("id").alias("receivable_id"), "amount")
    nested = receivables.groupBy("contract_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return contracts.join(nested, contracts["id"] == nested["contract_id"], "left").drop("contract_id")


def audit_trail(audit: DataFrame, contract_id: int) -> DataFrame:
    return audit.filter(F.col("contract_id") == contract_id).orderBy("created_at", "id")


def outstanding_by_signer(contracts: DataFrame, receivables: DataFrame, collections: DataFrame) -> DataFrame:
    """Due, collected and open by signer of reviewed, active contracts. What was collected counts for all reviewed contracts of the signer,
    active or not."""
    reviewed = contracts.filter("reviewed = 1 and signer <> ''").select(F.col("id").alias("c_id"), "signer", "status")
    active = reviewed.filter("status = 'active'")
    due = per_contract(receivables, "due")
    left = active.join(due, active["c_id"] == due["contract_id"], "left").groupBy("signer").agg(F.count(F.lit(1)).alias("contract_count"), F.sum("due").alias("total"))
    paid = per_contract(collections, "paid")
    right = reviewed.join(paid, reviewed["c_id"] == paid["contract_id"]).groupBy("signer").agg(F.sum("paid").alias("got"))
    rows = left.join(right, "signer", "left")
    rows = rows.select("signer", "contract_count", money(F.col("total")).alias("total_receivable"), money(F.col("got")).alias("total_collected"))
    return rows.withColumn("total_outstanding", F.round(F.col("total_receivable") - F.col("total_collected"), 2)).orderBy(F.col("total_outstanding").desc(), "signer")


def risk_list(alerts: DataFrame, contracts: DataFrame, contract_id: int | None = None, limit: int = 200) -> DataFrame:
    """Alerts with their contract's title and file, red ones first; a limit only over all contracts."""
    c = contracts.select(F.col("id").alias("c_id"), "title", "file_path")
    if contract_id is not None:
        alerts = alerts.filter(F.col("contract_id") == contract_id)
    rows = alerts.join(c, alerts["contract_id"] == c["c_id"], "left").drop("c_id").orderBy(F.col("level") != "red", F.col("id").desc())
    return rows if contract_id is not None else rows.limit(limit)


def contracts_with_risks(contracts: DataFrame, alerts: DataFrame) -> DataFrame:
    counts = alerts.groupBy("contract_id").agg(F.count(F.lit(1)).alias("risk_count"), F.count_if(F.col("level") == "red").alias("red_count"))
    rows = contracts.join(counts, contracts["id"] == counts["contract_id"]).select("id", "title", "file_path", "confidence", "reviewed", "risk_count", "red_count")
    return rows.orderBy(F.col("red_count").desc(), F.col("risk_count").desc(), "id")


def dashboard_kpi(contracts: DataFrame, receivables: DataFrame, collections: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row of key figures. Receivables and pending reviews count over active contracts, collected money and alerts over all."""
    active = contracts.filter("status = 'active'").select(F.col("id").alias("c_id"), "reviewed")
    due = receivables.groupBy("contract_id").agg(F.sum("amount").alias("due"), F.count_if(F.col("status") == "overdue").alias("late"), F.sum(F.when(F.col("status") == "overdue", F.col("amount"))).alias("late_sum"))
    left = active.join(due, active["c_id"] == due["contract_id"], "left").agg(
        F.countDistinct("c_id").alias("contract_count"),
        money(F.sum("due")).alias("total_receivable"),
        F.coalesce(F.sum("late"), F.lit(0)).alias("overdue_items"),
        money(F.sum("late_sum")).alias("overdue_amount"),
        F.count_if(F.col("reviewed") == 0).alias("pending_review"),
    )
    right = collections.agg(money(F.sum("amount")).alias("total_collected"))
    risks = alerts.agg(F.count(F.lit(1)).alias("risk_count"), F.count_if(F.col("level") == "red").alias("risk_red"))
    rows = left.crossJoin(right).crossJoin(risks)  # one row each
    return rows.withColumn("total_outstanding", F.round(F.greatest(F.col("total_receivable") - F.col("total_collected"), F.lit(0.0)), 2))


def monthly_trend(receivables: DataFrame, collections: DataFrame, today: str, months: int = 12) -> DataFrame:
    """Due and collected by month since ``months`` before today; months with only one of them have 0 for the other."""
    since = F.date_format(F.add_months(F.lit(today).cast("date"), -months), "yyyy-MM-dd")
    month = lambda c: F.substring(c, 1, 7).alias("month")
    due = receivables.filter((F.col("due_date") >= since)).groupBy(month("due_date")).agg(F.sum("amount").alias("due"))
    paid = collections.filter((F.col("collected_at") >= since)).groupBy(month("collected_at")).agg(F.sum("amount").alias("paid"))
    return due.join(paid, "month", "full_outer").select("month", money(F.col("due")).alias("receivable"), money(F.col("paid")).alias("collected")).orderBy("month")


def overdue_ranking(contracts: DataFrame, receivables: DataFrame, by: str = "signer", limit: int = 50) -> DataFrame:
    """Overdue sums of active contracts, by signer (null and empty signers are groups too) or by contract."""
    c = contracts.filter("status = 'active'").select(F.col("id").alias("c_id"), "signer", "title", "file_path")
    rows = receivables.filter("status = 'overdue'").join(c, F.col("contract_id") == F.col("c_id"))
    figures = [F.round(F.sum("amount"), 2).alias("overdue_amount"), F.count(F.lit(1)).alias("overdue_items")]
    if by == "signer":
        return rows.groupBy("signer").agg(*figures, F.countDistinct("c_id").alias("contract_count")).orderBy(F.col("overdue_amount").desc(), F.col("signer").asc_nulls_first()).limit(limit)
    out = rows.groupBy(F.col("c_id").alias("id")).agg(*[F.first(x).alias(x) for x in ("title", "file_path", "signer")], *figures)
    return out.orderBy(F.col("overdue_amount").desc(), "id").limit(limit)


def filter_contracts(
    contracts: DataFrame,
    collections: DataFrame,
    signer: str = "",
    direction: str = "",
    reviewed: str = "",
    date_from: str = "",
    date_to: str = "",
    amount_min: float | None = None,
    amount_max: float | None = None,
    limit: int = 500,
) -> DataFrame:
    """The latest contracts under up to seven optional predicates; an empty text or None means no filter, a bound of 0 is one.
    ``reviewed`` is yes or no. Open here is total - collected."""
    c = F.col
    tests = [
        c("signer").ilike(f"%{signer}%") if signer else None,
        c("direction") == direction if direction else None,
        c("reviewed") == {"yes": 1, "no": 0}[reviewed] if reviewed in ("yes", "no") else None,
        c("created_at") >= F.lit(date_from).cast("timestamp") if date_from else None,
        c("created_at") <= F.lit(date_to + " 23:59:59").cast("timestamp") if date_to else None,
        c("total_amount") >= amount_min if amount_min is not None else None,
        c("total_amount") <= amount_max if amount_max is not None else None,
    ]
    chosen = contracts.filter(any_of([t for t in tests if t is not None])).orderBy(c("created_at").desc(), c("id").desc()).limit(limit)
    paid = per_contract(collections, "paid")
    rows = chosen.join(paid, chosen["id"] == paid["contract_id"], "left")
    paid = F.coalesce("paid", F.lit(0.0))
    return rows.select(*contracts.columns, F.round(paid, 2).alias("collected_sum"), F.round(F.greatest(F.coalesce("total_amount", F.lit(0.0)), F.lit(0.0)) - paid, 2).alias("outstanding"))


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key: an upsert log replayed. The aggregation combines on the map side."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def without(rows: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    return rows.join(deleted.select(key).distinct(), key, "left_anti")


def register_files(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Files by content hash: the first registration of each stays and takes the first contract id that any later one brings."""
    rows = files.withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256))
    first = rows.groupBy("sha256").agg(F.min("id").alias("id"), F.min_by("file_name", "id").alias("file_name"), F.min_by("contract_id", F.when(F.col("contract_id").isNotNull(), F.col("id"))).alias("contract_id"), F.count(F.lit(1)).alias("seen"))
    return first if known is None else first.join(known.select("sha256"), "sha256", "left_anti")


def qc_daily_stats(results: DataFrame) -> DataFrame:
    day = results.groupBy(F.to_date("created_at").alias("day"))
    rows = day.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("verdict") == "NG").alias("ng_count"), F.round(F.avg("anomaly_score"), 4).alias("avg_score"))
    return rows.withColumn("ng_rate_pct", F.round(100.0 * F.col("ng_count") / F.col("total"), 2)).orderBy(F.col("day").desc())


def qc_ng_detail(results: DataFrame) -> DataFrame:
    """Rejected items, latest first, with the link of their image and the start of the defects found."""
    url = F.concat(F.lit("/-/qc-img/"), F.col("id").cast("string"))
    rows = results.filter("verdict = 'NG'")
    return rows.select("id", "created_at", "image_path", url.alias("image_url"), "anomaly_score", "barcode_content", F.substring("defect_json", 1, 200).alias("defect_summary")).orderBy(F.col("id").desc())


def notification_list(log: DataFrame, channel: str = "", success_only: bool = False, failed_only: bool = False, limit: int = 100) -> DataFrame:
    tests = ([F.col("channel") == channel] if channel else []) + ([F.col("success") == 1] if success_only else []) + ([F.col("success") == 0] if failed_only else [])
    return log.filter(any_of(tests)).orderBy(F.col("id").desc()).limit(limit)


def retry_due(log: DataFrame, now: str, limit: int = 50) -> DataFrame:
    ready = (F.col("next_retry_at") == "") | (F.col("next_retry_at") <= now)
    return log.filter((F.col("success") == 0) & (F.col("attempts") < F.col("max_attempts")) & ready).orderBy("id").limit(limit)


#: Attempts in all, and seconds to wait by the number of attempts made.
ATTEMPTS, BACKOFF = 3, (0, 30, 120)


def retried(log: DataFrame, outcomes: DataFrame, now: str, limit: int = 50) -> DataFrame:
    """The log after the due messages were sent again. outcomes: id, ok. A message that failed waits by its attempts, or no longer once they are used
    up; due messages without an outcome, and all others, stay as they are."""
    due = retry_due(log, now, limit).select("id")
    o = outcomes.join(due, "id", "left_semi").select(F.col("id").alias("__o"), "ok")
    made = F.col("attempts") + 1
    wait = F.get(F.array(*map(F.lit, BACKOFF)), F.least(made, F.lit(len(BACKOFF) - 1)))
    later = F.date_format(F.timestamp_add("SECOND", wait, F.lit(now).cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss")
    tried, ok = F.col("__o").isNotNull(), F.coalesce(F.col("ok"), F.lit(False))
    rows = log.join(o, log["id"] == o["__o"], "left")
    changes = {
        "success": F.when(tried & ok, 1).otherwise(F.col("success")),
        "next_retry_at": F.when(tried & ~ok, F.when(made < ATTEMPTS, later).otherwise("")).otherwise(F.col("next_retry_at")),
        "attempts": F.when(tried, made).otherwise(F.col("attempts")),
    }
    return rows.withColumns(changes).select(*log.columns)


AUDIT = ("action", "operator", "field", "old_value", "new_value", "note")


def python_text(c: Column) -> Column:
    """A value as the audit log writes it; null reads None."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def audited_update(old: DataFrame, new: DataFrame, key: str, fields: list[str], operator: str = "ui_user", now_text: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows after the update, audit rows: the key and AUDIT). ``new`` has the key and, for allow-listed fields only, the values to write; where it has
    a boolean column ``set_<field>``, that tells which of its rows write the field (else all do). A written value may be null. Every field whose text changes gives an
    audit row; every row that is written gets the next version, whether a text changed or not, and the operator and time where the table has columns for them."""
    at = {f: F.col(f"__s_{f}") for f in fields}
    sets = [(F.col(f"set_{f}") if f"set_{f}" in new.columns else F.lit(True)).alias(f"__s_{f}") for f in fields]
    n = new.select(F.col(key).alias("__k"), *[F.col(f).alias(f"__n_{f}") for f in fields], *sets)
    both = old.join(n, old[key] == n["__k"], "left")
    before, after = ({f: python_text(F.col(p + f)) for f in fields} for p in ("", "__n_"))
    entry = lambda f: F.struct(F.lit(f).alias("field"), F.substring(before[f], 1, 500).alias("old_value"), F.substring(after[f], 1, 500).alias("new_value"))
    diff = F.array_compact(F.array(*[F.when(at[f] & (before[f] != after[f]), entry(f)) for f in fields]))
    audit = both.select(key, F.explode(diff).alias("d"))
    audit = audit.select(key, F.lit("update").alias("action"), F.lit(operator).alias("operator"), "d.field", "d.old_value", "d.new_value", F.lit("").alias("note"))
    now = both.withColumns({f: F.when(at[f], F.col(f"__n_{f}")).otherwise(F.col(f)) for f in fields})
    written = reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in at.values()])
    stamp = F.lit(now_text) if now_text else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    touched = {"version": F.coalesce(F.col("version"), F.lit(1)) + 1 if "version" in old.columns else F.lit(None), "updated_by": F.lit(operator), "updated_at": stamp}
    now = now.withColumns({c: F.when(written, v).otherwise(F.col(c)) for c, v in touched.items() if c in old.columns})
    return now.select(*old.columns), audit


def review(contracts: DataFrame, ids: DataFrame, reject: bool = False, reason: str = "", operator: str = "ui_user") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(contracts, audit rows, error rows) after the given ids are reviewed; rejected ones are terminated, and with a reason leave an error row."""
    hit = ids.select(F.col("id").alias("__i")).distinct()
    rows = contracts.join(hit, contracts["id"] == hit["__i"], "left")
    is_hit = F.col("__i").isNotNull()
    changes = {"reviewed": F.when(is_hit, 1).otherwise(F.col("reviewed"))}
    if reject:
        changes["status"] = F.when(is_hit, "terminated").otherwise(F.col("status"))
    if "version" in contracts.columns:
        changes["version"] = F.when(is_hit, F.coalesce("version", F.lit(1)) + 1).otherwise(F.col("version"))
    note = (reason or "人工复核驳回") if reject else "复核通过, 进入回款日程"
    found = rows.filter(is_hit)
    blank = [F.lit("").alias(c) for c in ("field", "old_value", "new_value")]
    audit = found.select("id", F.lit("reject" if reject else "review").alias("action"), F.lit(operator).alias("operator"), *blank, F.lit(note[:300]).alias("note"))
    errors = found.filter(F.lit(bool(reject and reason))).select("id", F.lit("review").alias("stage"), F.lit("REJECTED").alias("error_code"), F.lit(reason).alias("message"), F.coalesce("file_path", F.lit("")).alias("file_path"))
    return rows.withColumns(changes).select(*contracts.columns), audit, errors


#: Columns of new rows with their types and defaults.
NEW_CONTRACT = {
    "title": ("string", ""), "raw_text": ("string", ""), "contract_no": ("string", ""), "our_party": ("string", ""), "counterparty": ("string", ""), "signer": ("string", ""),
    "start_date": ("string", ""), "end_date": ("string", ""), "total_amount": ("double", None), "currency": ("string", "CNY"), "direction": ("string", "receivable"),
    "extract_source": ("string", "llm"), "confidence": ("double", 0.0),
}
NEW_RECEIVABLE = {
    "due_date": ("string", None), "amount": ("double", None), "currency": ("string", "CNY"), "condition_text": ("string", ""), "penalty": ("string", ""),
    "direction": ("string", "receivable"), "status": ("string", "pending"), "source": ("string", "regex"),
}
NEW_ALERT = {"level": ("string", "yellow"), "rule": ("string", ""), "message": ("string", ""), "evidence": ("string", "")}


def inserted(table: DataFrame, new: DataFrame, order: list[str], id_col: str = "id") -> DataFrame:
    """``new`` with ids that go on from the greatest of ``table`` without a gap, in the order of the columns."""
    top = table.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("__top"))
    rows = ranks.gapless(new, [], order, "__rank").crossJoin(F.broadcast(top))  # one row
    return rows.select((F.col("__top") + F.col("__rank") + 1).alias(id_col), *[c for c in new.columns if c != id_col])


def insert_extracted(extracted: DataFrame, payments: DataFrame, alerts: DataFrame, contracts: DataFrame, receivables: DataFrame, risk_alerts: DataFrame) -> dict[str, DataFrame]:
    """The rows that new documents add to each table: contracts, receivables and risk_alert.

    extracted: file_path (one row a document) and any of the fields of a contract; payments and alerts: file_path, seq (their order in the document; of equal
    ones the due date, amount and status decide) and their fields. Children bear the id that their document's contract got. Missing fields get their defaults; texts are cut to 20,000 characters."""

    def default(rows: DataFrame, values: dict[str, tuple[str, object]]) -> DataFrame:
        keep = {c: F.coalesce(F.col(c).cast(kind), F.lit(v).cast(kind)) if c in rows.columns else F.lit(v).cast(kind) for c, (kind, v) in values.items()}
        return rows.withColumns(keep)

    rows = default(extracted, NEW_CONTRACT)
    both = F.trim(F.concat("our_party", F.lit(" / "), "counterparty"))
    parties = F.regexp_replace(both, r"^[ /]+|[ /]+$", "")
    rows = rows.withColumns({"parties": parties, "raw_text": F.substring(F.col("raw_text"), 1, 20_000), "status": F.lit("active"), "reviewed": F.lit(0)})
    c = inserted(contracts, rows.select("file_path", "parties", "status", "reviewed", *NEW_CONTRACT), ["file_path"])
    ids = c.select("file_path", F.col("id").alias("contract_id"))
    pay = default(payments.join(ids, "file_path"), NEW_RECEIVABLE).withColumn("due_date", F.when(F.col("due_date") != "", F.col("due_date")))
    r = inserted(receivables, pay.select("contract_id", "seq", *NEW_RECEIVABLE), ["contract_id", "seq", "due_date", "amount", "status"]).drop("seq")
    a = inserted(risk_alerts, default(alerts.join(ids, "file_path"), NEW_ALERT).select("contract_id", "seq", *NEW_ALERT), ["contract_id", "seq"]).drop("seq")
    return {"contracts": c, "receivables": r, "risk_alert": a}


def structurally_valid() -> Column:
    """The extraction's own verdict, null counting as no; where there is none or it can't be read, a positive total."""
    said = F.try_variant_get(F.try_parse_json("structured_json"), "$.valid", "boolean")
    has = F.array_contains(F.json_object_keys("structured_json"), "valid")
    return F.when(F.coalesce(has, F.lit(False)), F.coalesce(said, F.lit(False))).otherwise(F.coalesce(F.col("total_amount") > 0, F.lit(False)))


def batch_approval(contracts: DataFrame, threshold: float) -> DataFrame:
    """Pending contracts of enough confidence, approved or blocked."""
    rows = contracts.filter((F.col("reviewed") == 0) & (F.coalesce("confidence", F.lit(0.0)) >= threshold))
    return rows.select("id", "title", "confidence", F.when(structurally_valid(), "approved").otherwise("blocked").alias("decision"))


def migrated(rows: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """Rows with every missing column of the present schema (name: type, default) added."""
    return rows.withColumns({c: F.lit(default).cast(kind) for c, (kind, default) in columns.items() if c not in rows.columns})


def newest(rows: DataFrame, by: str, keep: int) -> DataFrame:
    """The newest ``keep`` rows: retention of snapshots."""
    return rows.orderBy(F.col(by).desc()).limit(keep)


def numbered(rows: DataFrame, key: str, order: list[Column], name: str = "rn") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
