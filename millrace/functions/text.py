"""Text functions as columns: amounts, dates, parties, corrections, error rates, Markdown.

Patterns are written for Java's engine; ``U`` makes \\s, \\d and \\b follow Unicode.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

U = "(?U)"

# Patterns and word lists that decide results.
AMOUNT = r"(?:人民币|RMB|￥|¥)\s*[0-9][0-9,，]*(?:\.[0-9]+)?\s*(?:万元|万|元|圆)?|[0-9][0-9,，]*(?:\.[0-9]+)?\s*(?:万元|万|元|圆)"
NUMBER = r"[0-9][0-9,，]*(?:\.[0-9]+)?"
DATE = r"(\d{4})\s*[-年/.]\s*(\d{1,2})\s*[-月/.]\s*(\d{1,2})"
RELATIVE_DATE = r"(签订|签署|生效|验收|交付|开票|收到发票|到货|质保期满)?[^0-9]{0,15}?(\d{1,3})\s*(?:个)?(?:工作)?(?:日|天)(?:内|日内)?"
RESOLVABLE = ("签订", "签署", "生效")
ORDINAL = r"^\s*[(（]?\d{1,2}[)）]?[.、．]\s*"
PENALTY_KEYS = ("违约金", "滞纳金", "逾期付款", "罚息", "按未付", "每日按")
TOTAL_KEYS = ("合同总价", "合同金额", "合同总额", "总金额", "总价款", "合同价款")
PAYMENT_KEYS = ("付款", "支付", "结算", "定金", "尾款", "预付款", "进度款", "验收款")
ROLES_A = ("甲方", "发包方", "买方", "委托方", "需方")
ROLES_B = ("乙方", "承包方", "卖方", "受托方", "供方")
ROLE = "(甲方|乙方|发包方|承包方|买方|卖方|委托方|受托方|供方|需方)"
CONTRACT_NO = r"(?:合同|协议|编号|编码|号码)\s*(?:编号|编码|号码)?\s*[:：]\s*([A-Za-z0-9\-/]{4,40})"
SIGNER = r"(?:甲方代表|乙方代表|委托代理人|负责人|签署人|签字人)\s*[:：]\s*([\u4e00-\u9fa5A-Za-z]{2,10})"
TITLE = r"(?:合同|协议)[名称]*[:：]?\s*([^\n]{4,40})"
PARTY = r"方\s*(?:[（(][^）)]*[）)])?\s*[:：]?\s*([^，,；;。\n]+)"
START = r"(?:签订|签署|生效|起始|开始)\s*(?:日期|时间)?\s*[:：]?\s*" + DATE
END = r"(?:截止|届满|终止|结束)\s*(?:日期|时间)?\s*[:：]?\s*" + DATE
RANGE = DATE + r"\s*日?\s*[至到—\-]+\s*" + DATE
TRUNCATION_KEYS = ("付款", "支付", "价款", "结算", "收款", "汇款", "转账", "违约", "罚则", "滞纳金", "逾期", "赔偿", "验收", "交付", "质保", "保证金", "预付", "尾款", "金额", "费用", "报价", "单价", "总价")
CORRECTIONS = (
    ("date_code_digits", r"\b([A-Z]?)20(\d{2})(\d{2})(\d{2})\b", "$120$2$3$4"),
    ("O_to_0_in_numbers", r"(?<=\d)O(?=\d)", "0"),
    ("I_to_1_in_numbers", r"(?<=\d)[Il](?=\d)", "1"),
    ("S_to_5_in_numbers", r"(?<=\d)S(?=\d)", "5"),
    ("B_to_8_in_numbers", r"(?<=\d)B(?=\d)", "8"),
    ("Z_to_2_in_numbers", r"(?<=\d)Z(?=\d)", "2"),
)
#: Rules that are off unless a caller adds them.
SERIAL_NUMBERS = ("hex_like_serial", r"\b(\d{6,12})\b", "$1")
TRAILING_G = ("G_to_6_trailing", r"(?<=\d)G\b", "6")
BASE_CONFIDENCE = {"regex": 0.5, "llm": 0.85}
PROMPT_WORDS = {
    "划痕": "scratch", "刮伤": "scratch", "划伤": "scratch", "凹陷": "dent", "凹坑": "dent", "压痕": "dent", "裂纹": "crack", "裂缝": "crack", "开裂": "crack",
    "污渍": "stain", "脏污": "stain", "污点": "stain", "毛刺": "burr", "飞边": "burr", "色差": "color difference", "变色": "discoloration",
    "缺件": "missing part", "缺失": "missing", "漏装": "missing component", "变形": "deformation", "翘曲": "warp", "弯曲": "bend",
    "气泡": "bubble", "气孔": "porosity", "砂眼": "blowhole", "锈": "rust", "锈蚀": "rust", "氧化": "oxidation", "磨损": "wear", "磨伤": "abrasion",
    "异物": "foreign object", "杂质": "impurity", "错位": "misalignment", "偏移": "offset", "倾斜": "tilt", "破损": "damage", "断裂": "fracture", "缺口": "notch",
    "溢胶": "glue overflow", "胶渍": "glue residue", "焊渣": "solder spatter", "虚焊": "cold solder joint", "短路": "short circuit", "断路": "open circuit",
    "标签歪": "misaligned label", "贴歪": "crooked label", "印刷不良": "print defect", "漏印": "missing print", "缩水": "shrinkage", "飞料": "flash",
    "缺陷": "defect", "不良": "defect", "异常": "anomaly",
}
LABELS = {"missing_hole": "缺孔", "mouse_bite": "鼠咬", "open_circuit": "开路", "short": "短路", "spur": "毛刺", "spurious_copper": "杂铜"}
PENALTY_WORDS = ("违约", "滞纳金", "罚则", "逾期")
RISK_TEXTS = {
    "amount_mismatch": "金额矛盾: 条款合计 {} ≠ 合同总额 {}",
    "amount_mismatch_evidence": "合同总额={}, 条款合计={}",
    "date_contradiction": "日期矛盾: 终止日 {} 早于起始日 {}",
    "date_contradiction_evidence": "start_date={}, end_date={}",
    "missing_penalty": "缺少违约条款: 所有收付款条目均无违约金/滞纳金约定",
    "missing_penalty_evidence": "全文未找到违约/滞纳金相关条款",
    "missing_signer": "未识别到签单人/负责人, 提醒将降级发送给默认联系人",
    "missing_signer_evidence": "signer 字段为空",
    "party_unidentified": "我方主体未识别: 请检查 config.yaml company.name 配置",
    "party_unidentified_evidence": "our_party 字段为空",
    "missing_amount": "未抽取到任何金额: 合同总额和条款金额均为空",
    "missing_amount_evidence": "total_amount=null, payments 无有效金额",
    "no_due_date": "所有条款均无绝对到期日, 回款日程无法自动排列, 需人工补充",
    "no_due_date_evidence": "所有 payments[].due_date 为空",
    "direction_unknown": "我方主体未配置, 方向待人工确认: 请检查 config.yaml company.name/aliases",
    "direction_unknown_evidence": "direction=unknown, 无法判定应收/应付",
}
COLOURS = {"scratch": "0,165,255", "dent": "0,0,255", "crack": "0,0,200", "stain": "255,180,0", "burr": "0,200,200", "missing": "180,0,255", "deform": "0,100,255"}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, f) -> Column:
    """f(value) with the value worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def has_any(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words], F.lit(False))


def number_text(c: Column) -> Column:
    """A double as Python prints it below 1e16: the shortest digits that give it back, one decimal at least, no exponent."""
    plain = F.regexp_replace(c.cast("decimal(38,12)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when((F.abs(c) < 1e7) & (F.abs(c) >= 1e-3), c.cast("string")).otherwise(plain)


def parse_amount(segment) -> Column:
    """The largest amount of a segment (万 counts ten thousand), rounded to 2 places; null without one."""
    value = lambda m: F.regexp_replace(F.regexp_extract(m, NUMBER, 0), "[,，]", "").try_cast("double") * F.when(m.contains("万"), 10000.0).otherwise(1.0)
    return F.round(F.array_max(F.transform(F.regexp_extract_all(_c(segment), F.lit(U + AMOUNT), F.lit(0)), value)), 2)


def _day(y: Column, m: Column, d: Column) -> Column:
    return F.coalesce(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date").cast("string"), F.lit(""))


def iso_date(text: Column, pattern: str, first: int = 1) -> Column:
    """The date of three neighbouring groups, or '' where there is none or no such day. The groups are read from the one match."""
    return let(F.regexp_extract(text, U + pattern, 0), lambda m: F.when(m == "", "").otherwise(_day(*(F.regexp_extract(m, U + pattern, first + i) for i in range(3)))))


def due_date(segment, base: Column) -> Column:
    """An absolute date, else a number of days after an anchor whose date is known, else ''. Each pattern runs once over the segment; the parts are
    read from what it matched."""
    s = _c(segment)
    absolute = lambda m: let(F.split(m, U + r"[^\d]+"), lambda p: _day(F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.get(p, F.lit(2))))
    days = lambda m: F.regexp_extract(m, U + RELATIVE_DATE, 2).try_cast("int")
    anchored = lambda m: F.when(F.regexp_extract(m, U + RELATIVE_DATE, 1).isin(*RESOLVABLE), F.coalesce(F.date_add(base, days(m)).cast("string"), F.lit(""))).otherwise("")
    relative = F.when(has_any(s, RESOLVABLE), let(F.regexp_extract(s, U + RELATIVE_DATE, 0), anchored)).otherwise("")
    return let(F.regexp_extract(s, U + DATE, 0), lambda m: F.when(m != "", absolute(m)).otherwise(relative))


def party(text, side: str) -> Column:
    """The party named after 甲方 (side 甲) or 乙方 (side 乙)."""
    return F.trim(F.regexp_extract(_c(text), U + side + PARTY, 1))


def role_name(role: Column, a: Column, b: Column) -> Column:
    return F.when(role.isin(*ROLES_A), a).when(role.isin(*ROLES_B), b).otherwise(role)


def first_match(pairs: Sequence[tuple[Column, Column]], other: Column) -> Column:
    return reduce(lambda rest, p: F.when(p[0], p[1]).otherwise(rest), reversed(pairs), other)


def our_party(a: Column, b: Column, names: Sequence[str], whole: Column | None = None) -> tuple[Column, Column]:
    """(our party, the other one): names in order, each sought in a, then in b, then in ``whole``, the text of both parties, where the name itself is ours and the other
    stays empty."""
    none = F.lit("")
    tests = [(side.contains(n), mine, other) for n in names for side, mine, other in ((a, a, b), (b, b, a), *([] if whole is None else [(whole, F.lit(n), none)]))]
    return first_match([(t, m) for t, m, _ in tests], none), first_match([(t, o) for t, _, o in tests], none)


def direction(payer: Column, payee: Column, names: Sequence[str]) -> Column:
    if not names:
        return F.lit("unknown")
    return F.when(has_any(payee, names), "receivable").when(has_any(payer, names), "payable").otherwise("receivable")


def confidence(method: Column, payments: Column, total: Column, ours: Column) -> Column:
    """How far an extraction can be trusted, 0 to 1: more by a model than by rules, more with amounts, a total and our party, less with payments of which none has a date."""
    base = F.when(method == "regex", BASE_CONFIDENCE["regex"]).otherwise(BASE_CONFIDENCE["llm"])
    some = F.coalesce(F.size(payments) > 0, F.lit(False))
    paid, dated = (F.coalesce(x, F.lit(False)) for x in (F.exists(payments, lambda p: p["amount"] != 0), F.exists(payments, lambda p: p["due_date"] != "")))
    signs = [paid, F.coalesce(total, F.lit(0.0)) != 0, F.coalesce(ours, F.lit("")) != ""]
    points = base + 0.05 * reduce(lambda a, b: a + b, [x.cast("int") for x in signs]) - 0.05 * (some & ~dated).cast("int")
    return F.round(F.least(F.greatest(points, F.lit(0.0)), F.lit(1.0)), 3)


def joined_words(words: DataFrame, k: int, word: str = "word") -> DataFrame:
    """(prompt): the ``k`` most frequent words, joined by full stops; of equally frequent ones the first in the alphabet."""
    top = words.groupBy(word).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), word).limit(k)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(word).alias("w"))))
    return top.agg(F.array_join(F.transform(ranked, lambda x: x["w"]), ".").alias("prompt"))


def majority(directions: Column) -> Column:
    """Of the directions of a contract's items."""
    n = lambda v: F.size(F.filter(directions, lambda d: d == v))
    empty = F.size(directions) == 0
    return F.when(empty | (n("unknown") == F.size(directions)), "unknown").when(n("receivable") >= n("payable"), "receivable").otherwise("payable")


def majority_of(direction: str) -> Column:
    """``majority`` as an aggregate over rows: three counts."""
    n = lambda v: F.count_if(F.col(direction) == v)
    return F.when(n("unknown") == F.count(direction), "unknown").when(n("receivable") >= n("payable"), "receivable").otherwise("payable")


def reconciles(total: Column, amounts: Column) -> Column:
    """False where the items' sum is positive and off the total by more than one percent."""
    s = F.round(F.aggregate(amounts, F.lit(0.0), lambda x, y: x + F.coalesce(y, F.lit(0.0))), 2)
    off = F.when((F.coalesce(total, F.lit(0.0)) != 0) & (s > 0), F.abs(s - total) / total > 0.01)
    return ~F.coalesce(off, F.lit(False))


def extract_contracts(df: DataFrame, text: str, base: Column, names: Sequence[str]) -> DataFrame:
    """One row of fields and nested payments per contract text, by rules alone."""
    t = F.col(text)
    head = lambda n: F.substring(t, 1, n)
    segments = F.filter(F.transform(F.split(t, "[。\n;；]"), lambda s: F.trim(s)), lambda s: s != "")
    df = df.withColumns({"__seg": segments, "__a": party(head(800), "甲"), "__b": party(head(800), "乙"), "contract_no": F.regexp_extract(head(600), "(?iU)" + CONTRACT_NO, 1)})
    title = F.trim(F.regexp_extract(head(500), U + TITLE, 1))
    no = F.col("contract_no")
    bad = (title == no) | title.rlike(r"^[A-Za-z0-9\-/]+$") | ((no != "") & title.contains(no)) | title.startswith("编号")
    start, end = iso_date(head(800), START), iso_date(head(1200), END)
    seg = F.col("__seg")
    mine, other = our_party(F.col("__a"), F.col("__b"), names)
    df = df.withColumns(
        {
            "title": F.when(bad, "").otherwise(title),
            "signer": F.regexp_extract(t, U + SIGNER, 1),
            "start_date": F.when(start != "", start).otherwise(iso_date(head(1200), RANGE)),
            "end_date": F.when(end != "", end).otherwise(iso_date(head(1200), RANGE, 4)),
            "total_amount": F.get(F.filter(F.transform(F.filter(seg, lambda s: has_any(s, TOTAL_KEYS)), parse_amount), lambda v: v.isNotNull()), F.lit(0)),
            "__penalty": F.coalesce(F.get(F.transform(F.filter(seg, lambda s: has_any(s, PENALTY_KEYS)), lambda s: F.substring(s, 1, 120)), F.lit(0)), F.lit("")),
            "our_party": mine,
            "counterparty": other,
        }
    )

    def payment(x: Column) -> Column:
        s, roles = x["s"], U + ROLE + r"向\s*" + ROLE
        who = lambda m: [role_name(F.regexp_extract(m, roles, i), F.col("__a"), F.col("__b")) for i in (1, 2)]
        found = let(F.when(s.contains("向"), F.regexp_extract(s, roles, 0)).otherwise(""), lambda m: F.struct(*[w.alias(n) for w, n in zip(who(m), ("payer", "payee"), strict=True)]))
        fields = lambda w: F.struct(
            due_date(s, base).alias("due_date"),
            x["amount"].alias("amount"),
            F.lit("CNY").alias("currency"),
            F.substring(F.regexp_replace(s, U + ORDINAL, ""), 1, 120).alias("condition_text"),
            F.col("__penalty").alias("penalty"),
            w["payer"].alias("payer"),
            w["payee"].alias("payee"),
            direction(w["payer"], w["payee"], names).alias("direction"),
        )
        return let(found, fields)

    # Key words and amounts decide first; dates and roles are sought only in what is left.
    paying = F.filter(seg, lambda s: has_any(s, PAYMENT_KEYS) & ~has_any(s, PENALTY_KEYS))
    priced = F.filter(F.transform(paying, lambda s: F.struct(s.alias("s"), parse_amount(s).alias("amount"))), lambda p: p["amount"].isNotNull())
    df = df.withColumn("payments", F.transform(priced, payment))
    amounts = F.transform("payments", lambda p: p["amount"])
    df = df.withColumns({"direction": majority(F.transform("payments", lambda p: p["direction"])), "valid": reconciles(F.col("total_amount"), amounts)})
    df = df.withColumn("confidence", confidence(F.lit("regex"), F.col("payments"), F.col("total_amount"), F.col("our_party"))).drop("__seg", "__a", "__b", "__penalty")
    # A blank text has a result of its own: nothing found, receivable, not valid.
    blank = F.trim(F.regexp_replace(F.coalesce(t, F.lit("")), U + r"\s+", "")) == ""
    return df.withColumns({"direction": F.when(blank, "receivable").otherwise(F.col("direction")), "valid": ~blank & F.col("valid"), "confidence": F.when(blank, 0.0).otherwise(F.col("confidence"))})


def filled(message: str, *values: Column) -> Column:
    """``message`` with the values in the places marked {}."""
    parts = message.split("{}")
    return F.concat(F.lit(parts[0]), *[x for v, after in zip(values, parts[1:], strict=True) for x in (v, F.lit(after))]) if values else F.lit(message)


def alert(test: Column, level: str, rule: str, message: Column, evidence: Column) -> Column:
    """A rule's alert where ``test`` holds, else null: what a risk rule returns."""
    return F.when(test, F.struct(F.lit(level).alias("level"), F.lit(rule).alias("rule"), message.alias("message"), evidence.alias("evidence")))


def _rule(test: Column, level: str, rule: str, values: Sequence[Column] = (), shown: Sequence[Column] = (), evidence: Column | None = None) -> Column:
    return alert(test, level, rule, filled(RISK_TEXTS[rule], *values), filled(RISK_TEXTS[f"{rule}_evidence"], *shown) if evidence is None else evidence)


def risks(text: Column, added: Sequence[Callable[[Column], Column]] = ()) -> Column:
    """Alerts of a contract (columns as of ``extract_contracts``) in rule order: array of (level, rule, message, evidence). ``added`` are further rules: functions of
    the text that return an ``alert`` over the same columns; theirs come last, in order."""
    pays, total = F.col("payments"), F.coalesce("total_amount", F.lit(0.0))
    paid = F.aggregate(pays, F.lit(0.0), lambda s, p: s + F.coalesce(p["amount"], F.lit(0.0)))
    some = F.size(pays) > 0
    found = first_match([(text.contains(k), F.substring(text, F.greatest(F.instr(text, k) - 10, F.lit(1)), F.least(F.instr(text, k) - 1, F.lit(10)) + 40)) for k in PENALTY_WORDS], F.lit(RISK_TEXTS["missing_penalty_evidence"]))
    s, e = F.col("start_date"), F.col("end_date")
    off = F.coalesce(F.try_divide(F.abs(paid - total), total) > 0.01, F.lit(False))
    rules = [
        _rule((total != 0) & (paid > 0) & off, "red", "amount_mismatch", (F.format_number(paid, 0), F.format_number(total, 0)), (number_text(total), number_text(paid))),
        _rule((s != "") & (e != "") & (e < s), "red", "date_contradiction", (e, s), (s, e)),
        _rule(some & ~F.exists(pays, lambda p: F.trim(p["penalty"]) != ""), "yellow", "missing_penalty", evidence=found),
        _rule(F.trim("signer") == "", "yellow", "missing_signer"),
        _rule(F.trim("our_party") == "", "yellow", "party_unidentified"),
        _rule((total == 0) & ~F.exists(pays, lambda p: F.coalesce(p["amount"], F.lit(0.0)) != 0), "red", "missing_amount"),
        _rule(some & ~F.exists(pays, lambda p: F.trim(p["due_date"]) != ""), "yellow", "no_due_date"),
        _rule(F.col("direction") == "unknown", "yellow", "direction_unknown"),
    ]
    return F.array_compact(F.array(*rules, *[rule(text) for rule in added]))


def plain_date(value) -> Column:
    """A date written as four, two and two digits, else the empty text."""
    t = F.trim(F.coalesce(_c(value).cast("string"), F.lit("")))
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t).otherwise("")


def plain_payment(p: Column) -> Column:
    """A payment (due_date, amount, currency, condition_text, penalty, payer, payee, all texts) in its normal form; null if it has neither an amount nor a
    condition. Texts that are no number have no amount."""
    amount = F.round(F.nullif(F.trim(p["amount"]), F.lit("")).try_cast("double"), 2)
    cut = lambda c, n: F.substring(F.coalesce(p[c], F.lit("")), 1, n).alias(c)
    currency = F.coalesce(F.nullif(p["currency"], F.lit("")), F.lit("CNY"))
    out = F.struct(plain_date(p["due_date"]).alias("due_date"), amount.alias("amount"), currency.alias("currency"), cut("condition_text", 200), cut("penalty", 200), cut("payer", 100), cut("payee", 100))
    return F.when(amount.isNotNull() | (F.coalesce(p["condition_text"], F.lit("")) != ""), out)


def corrected(text, rules=CORRECTIONS) -> tuple[Column, Column]:
    """(text, log): the rules applied in order to every line; the log has one entry per change. Each rule runs once per line."""
    entry = lambda r, a, b: F.when(a != b, F.concat(F.lit(f'[{r[0]}] "'), a, F.lit('" → "'), b, F.lit('"')))

    def step(i: int, line: Column, log: list[Column]) -> Column:
        if i == len(rules):
            return F.struct(line.alias("line"), F.array_compact(F.array(*log) if log else F.array().cast("array<string>")).alias("log"))
        r = rules[i]
        return let(F.regexp_replace(line, U + r[1], F.lit(r[2])), lambda new: step(i + 1, new, [*log, entry(r, line, new)]))

    done = F.transform(F.split(_c(text), "\n"), lambda x: step(0, x, []))
    return F.array_join(F.transform(done, lambda d: d["line"]), "\n"), F.flatten(F.transform(done, lambda d: d["log"]))


def custom_rules(text: str) -> list[tuple[str, str, str]]:
    """Rules from lines ``pattern|||replacement``. Group references become Java's, other dollar signs and backslashes are literal; rules whose
    pattern the engine's regular expressions don't know, or that refer to a group the pattern doesn't have, are skipped."""
    from pyspark import SparkContext

    jvm = SparkContext._active_spark_context._jvm
    out = []
    for line in text.splitlines():
        pattern, bar, new = line.partition("|||")
        if not bar or not pattern.strip():
            continue
        try:
            groups = jvm.java.util.regex.Pattern.compile(U + pattern).matcher("").groupCount()
        except Exception:  # noqa: BLE001 - the JVM's own error class
            continue
        parts = re.split(r"(\\g<\d+>|\\\d+)", new)
        wanted = [int(re.sub(r"\D", "", p)) for p in parts[1::2]]
        if all(g <= groups for g in wanted):
            plain = [re.sub(r"([$\\])", r"\\\1", p) for p in parts[0::2]]
            java = plain[0] + "".join(f"${g}{p}" for g, p in zip(wanted, plain[1:], strict=True))
            out.append((f"custom:{pattern}", pattern, java))
    return out


def cer(predicted, truth, normalise: bool = True) -> Column:
    """Edit distance over the length of the truth; an empty truth gives 0 or 1."""
    p, t = _c(predicted), _c(truth)
    rate = lambda p, t: F.when(F.length(t) == 0, F.when(F.length(p) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(p, t) / F.length(t))
    if not normalise:
        return rate(p, t)
    p, t = (F.upper(F.replace(F.btrim(x, F.lit(" \t\n\x0b\f\r")), F.lit(" "), F.lit(""))) for x in (p, t))
    return let(F.struct(p.alias("p"), t.alias("t")), lambda x: rate(x["p"], x["t"]))


def wer(predicted, truth) -> Column:
    """Word error rate: words become single characters, the same for the same word, and the distance is taken on those."""
    words = lambda x: F.filter(F.split(_c(x), r"\s+"), lambda w: w != "")
    p, t = words(predicted), words(truth)
    seen = F.array_distinct(F.concat(p, t))
    coded = lambda ws: F.array_join(F.transform(ws, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(seen, w) + 0x4E00), 4, "0")), "UTF-16BE")), "")
    return F.when(F.size(t) == 0, F.when(F.size(p) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(coded(p), coded(t)) / F.size(t))


def lines_to_markdown(lines: Column) -> Column:
    def block(s: Column) -> Column:
        heading = (F.length(s) <= 30) & ~s.rlike("[。，,.;；:：!！?？]$") & s.rlike(r"[\u4e00-\u9fa5A-Za-z]")
        numbered = s.rlike(r"^([一二三四五六七八九十]+[、.]|\d+[\.、])")
        item = r"^([-•·*]|\d+[)）.])\s*"
        return F.when(heading & numbered, F.concat(F.lit("## "), s)).when(heading, F.concat(F.lit("### "), s)).when(s.rlike(item), F.concat(F.lit("- "), F.regexp_replace(s, item, ""))).otherwise(s)

    stripped = F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return F.array_join(F.transform(stripped, block), "\n\n")


def markdown_parts(text) -> Column:
    """Headings, paragraphs, list items and whether a table shows."""
    t = _c(text)
    blocks = F.filter(F.transform(F.split(t, "\n\n"), lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")), lambda b: b != "")
    items = F.flatten(F.transform(F.filter(blocks, lambda b: b.startswith("- ")), lambda b: F.transform(F.filter(F.split(b, "\n"), lambda x: x.startswith("- ")), lambda x: F.trim(F.substring(x, 3, 1 << 30)))))
    headings = F.transform(F.filter(blocks, lambda b: b.startswith("#")), lambda b: F.trim(F.regexp_replace(b, "^#+", "")))
    return F.struct(headings.alias("headings"), F.filter(blocks, lambda b: ~b.startswith("#") & ~b.startswith("- ")).alias("paragraphs"), items.alias("list_items"), t.contains("|").alias("table_detected"))


def markdown_stats(text) -> Column:
    """Heading count, table sign and formula count."""
    t = _c(text)
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(x))
    formulas = F.size(F.filter(lines, lambda s: s.startswith("$$") | (s.startswith("$") & s.endswith("$"))))
    return F.struct(F.size(F.filter(lines, lambda s: s.startswith("#"))).alias("headings"), t.contains("|").alias("has_table"), (F.floor(F.regexp_count(t, F.lit(r"\$\$")) / 2) + formulas).cast("int").alias("formula_count"))


def translated_prompt(prompt) -> Column:
    table = F.create_map(*[F.lit(x) for kv in PROMPT_WORDS.items() for x in kv])
    terms = F.filter(F.transform(F.split(F.replace(_c(prompt), F.lit("。"), F.lit(".")), r"\."), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.transform(terms, lambda x: F.coalesce(F.try_element_at(table, x), x)), ".")


def label_name(label) -> Column:
    return first_match([(_c(label) == k, F.lit(v)) for k, v in LABELS.items()], _c(label))


def label_colour(label) -> Column:
    return first_match([(F.lower(_c(label)).contains(k), F.lit(v)) for k, v in COLOURS.items()], F.lit("0,0,255"))


def keywords(text) -> Column:
    """At most five English phrases of at most three words."""
    parts = F.split(F.regexp_replace(_c(text), "[、。]", ","), ",")
    clean = F.transform(parts, lambda x: F.lower(F.regexp_replace(F.trim(x), r"^\.+|\.+$", "")))
    return F.slice(F.filter(clean, lambda x: x.rlike("^[a-z ]+$") & (F.size(F.filter(F.split(x, " +"), lambda w: w != "")) <= 3)), 1, 5)


def sanitised(text, most: int = 200) -> Column:
    return F.substring(F.regexp_replace(_c(text), r"[\"'`$\;\n\r]", ""), 1, most)


def safe_name(name) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.trim(_c(name)), r'[\\/:*?"<>|.]', "_"), F.lit("")), F.lit("_"))


def merged_rois(parts: Column) -> Column:
    """Texts of an array of (label, text): alone as it is, several under their labels."""
    one = F.get(parts, F.lit(0))["text"]
    return F.when(F.size(parts) == 1, one).otherwise(F.array_join(F.transform(parts, lambda p: F.concat(F.lit("【"), p["label"], F.lit("】\n"), p["text"])), "\n\n"))


def truncated(text, most: int = 12000, head: int = 3000, tail: int = 2000) -> Column:
    """Head, paragraphs with key words while the budget lasts (checked before each), and tail; filled from the middle if under half the budget."""
    t = _c(text)
    budget = most - head - tail
    middle = F.substring(t, head + 1, F.length(t) - head - tail)
    keep = F.filter(F.split(middle, "\n"), lambda p: has_any(p, TRUNCATION_KEYS))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept"))
    step = lambda s, p: F.when(s["used"] >= budget, s).otherwise(F.struct((s["used"] + F.length(p) + 1).alias("used"), F.concat(s["kept"], F.array(p)).alias("kept")))
    got = F.aggregate(keep, start, step)
    kept = F.when(got["used"] < budget * 0.5, F.concat(got["kept"], F.array(F.substring(middle, F.lit(1), budget - got["used"])))).otherwise(got["kept"])
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, head), F.lit("\n[...]\n"), F.array_join(kept, "\n"), F.lit("\n[...]\n"), F.substring(t, -tail, tail)))


def _closed(text: str | None) -> str | None:
    """A JSON object made whole: fences and what surrounds it are cut off, and what a cut text left open is closed."""
    import json

    if text is None:
        return None
    at = text.find("{")
    if at < 0:
        return None
    open_, quoted, escaped, ends = [], False, False, []
    for i, c in enumerate(text[at:], at):
        if escaped:
            escaped = False
        elif quoted:
            escaped, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            open_.append("}" if c == "{" else "]")
        elif c in "}]":
            if not open_ or open_.pop() != c:
                return None
            if not open_:
                return text[at : i + 1]
        elif c == ",":
            ends.append((i, "".join(reversed(open_))))
    for end, close in [(len(text), ('"' if quoted else "") + "".join(reversed(open_))), *reversed(ends)]:
        try:
            json.loads(text[at:end] + close)
            return text[at:end] + close
        except ValueError:
            continue
    return None


def _closed_json(text: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def closed(texts: pd.Series) -> pd.Series:
        return texts.map(_closed)

    return closed(text)


def whole_json(text) -> Column:
    """Text as JSON if it is, else repaired by an Arrow function (the open brackets are a stack, which columns can't express)."""
    t = _c(text)
    return F.when(F.try_parse_json(t).isNotNull(), t).otherwise(_closed_json(t))
