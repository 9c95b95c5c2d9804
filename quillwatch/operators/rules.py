"""Detection rules as plain Spark columns.

A rule is a small mapping (title, id, status, level, tags, detection). Each named selection becomes one
boolean column; the condition text, with the selection names replaced by those columns, is handed to
Spark SQL, whose operators already have the precedence the rule language uses. All rules together are
one projection over the events: no join, no shuffle, one pass.
"""

from __future__ import annotations

import re
from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwatch.functions.mitre import tactic_name
from quillwatch.functions.scalars import SEVERITIES, all_of, any_of, c, in_cidr, quote_regex, true_only
from quillwatch.operators.filters import UNIT_SECONDS

# Rule field names and the event columns they read.
FIELD_COLUMNS = {
    "CommandLine": "process_cmdline", "command_line": "process_cmdline",
    "Image": "process_path", "process_path": "process_path",
    "ParentImage": "parent_process", "parent_process_path": "parent_process",
    "ProcessId": "process_pid", "process_id": "process_pid",
    "ParentProcessId": "process_ppid", "parent_pid": "process_ppid",
    "ProcessName": "process_name", "process_name": "process_name",
    "User": "user_name", "Username": "user_name", "user_name": "user_name",
    "Computer": "hostname", "Hostname": "hostname", "hostname": "hostname",
    "src_ip": "src_ip", "SourceIp": "src_ip", "SourceAddress": "src_ip",
    "dst_ip": "dst_ip", "DestinationIp": "dst_ip", "DestinationAddress": "dst_ip",
    "src_port": "src_port", "SourcePort": "src_port",
    "dst_port": "dst_port", "DestinationPort": "dst_port",
    "Protocol": "protocol", "protocol": "protocol",
    "TargetFilename": "file_path", "file_path": "file_path", "FileName": "file_path",
    "file_name": "file_name", "auth_method": "auth_method", "auth_protocol": "auth_protocol",
    "event_type": "event_type",
}
INT_COLUMNS = {"process_pid", "process_ppid", "src_port", "dst_port"}
STATUSES = ["stable", "test", "experimental", "deprecated", "unsupported"]

_WORD = r"[A-Za-z_][A-Za-z0-9_]*"
_CONDITION_TOKEN = re.compile(rf"\b(1|any|all)\s+of\s+([A-Za-z0-9_*?]+)|({_WORD})", re.I)
COUNT = re.compile(rf"^(.*)\|\s*count\(\s*({_WORD})?\s*\)(?:\s+by\s+({_WORD}))?\s*(>=|<=|>|<|=)\s*(\d+)\s*$", re.I)


class RuleError(ValueError):
    """The rule cannot be used; loading goes on with the others."""


def field(name: str, columns) -> tuple[Column, str]:
    """Column behind a rule field and its kind (``str`` or ``int``)."""
    target = FIELD_COLUMNS.get(name)
    if target is None:
        return F.try_element_at("fields", F.lit(name)), "str"
    if target not in columns:
        return F.lit(None).cast("string"), "str"
    return c(target), "int" if target in INT_COLUMNS else "str"


def is_int(v) -> bool:
    return isinstance(v, int) and not isinstance(v, bool)


def _text(v):
    return str(v).lower() if isinstance(v, bool) else v if isinstance(v, str) else None


def _lower_ascii(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _exact(col: Column, kind: str, v) -> Column:
    if v is None:
        return col.isNull()
    text = _text(v)
    if kind == "int":
        if is_int(v):
            return col == v
        return col == int(text) if text is not None and re.fullmatch(r"[+-]?\d+", text) else F.lit(False)
    if text is None:
        return F.lit(False)
    if "*" in text or "?" in text:
        body = "".join({"*": ".*", "?": "."}.get(ch) or quote_regex(ch) for ch in text)
        return col.rlike(rf"(?iu)\A{body}\z")
    return F.lower(col) == text.lower() if text.isascii() else _lower_ascii(col) == text.translate({u: u + 32 for u in range(65, 91)})


def _lowered(test):
    def build(col, kind, v):
        text = _text(v)
        return test(F.lower(col), text.lower()) if kind == "str" and text is not None else F.lit(False)
    return build


def _regex(col, kind, v):
    if kind != "str" or not isinstance(v, str):
        return F.lit(False)
    try:
        re.compile(v)
    except re.error:
        return F.lit(False)
    return col.rlike(v)


def _cidr(col, kind, v):
    return in_cidr(col, v) if kind == "str" and isinstance(v, str) else F.lit(False)


def _numeric(op):
    def build(col, kind, v):
        if not is_int(v):
            return F.lit(False)
        n = col if kind == "int" else F.when(col.rlike(r"^[+-]?[0-9]{1,19}$"), col.try_cast("bigint"))
        return op(n, v)
    return build


# modifier -> (test of one value, how several values combine)
MODIFIERS = {
    "": (_exact, any_of), "all": (_exact, all_of),
    "contains": (_lowered(lambda a, b: a.contains(b)), any_of),
    "contains|all": (_lowered(lambda a, b: a.contains(b)), all_of),
    "startswith": (_lowered(lambda a, b: a.startswith(b)), any_of),
    "endswith": (_lowered(lambda a, b: a.endswith(b)), any_of),
    "re": (_regex, any_of), "cidr": (_cidr, any_of),
    "gt": (_numeric(lambda a, b: a > b), any_of), "gte": (_numeric(lambda a, b: a >= b), any_of),
    "lt": (_numeric(lambda a, b: a < b), any_of), "lte": (_numeric(lambda a, b: a <= b), any_of),
}


def _filter(key: str, values, columns) -> Column:
    name, _, modifier = key.partition("|")
    if modifier == "all|contains":
        modifier = "contains|all"
    test, combine = MODIFIERS.get(modifier, MODIFIERS[""])
    col, kind = field(name, columns)
    values = values if isinstance(values, list) else [values]
    return combine([true_only(test(col, kind, v)) for v in values])


def selection(body, columns) -> Column:
    """A mapping (all filters), a list of mappings (any), or a list of keywords (any, in ``raw``)."""
    if isinstance(body, dict):
        return all_of([_filter(k, v, columns) for k, v in body.items()])
    if isinstance(body, list) and body and all(isinstance(x, dict) for x in body):
        return any_of([selection(x, columns) for x in body])
    words = [x for x in body if isinstance(x, str)] if isinstance(body, list) else []
    return any_of([true_only(F.lower("raw").contains(w.lower())) for w in words])


def condition_sql(text: str, names, prefix: str) -> str:
    """The condition with every selection name replaced by its boolean column."""
    def swap(m):
        quantifier, glob, word = m.groups()
        if glob:
            hit = [n for n in names if glob.lower() == "them" or fnmatchcase(n.lower(), glob.lower())]
            joined = (" AND " if quantifier.lower() == "all" else " OR ").join(f"`{prefix}{n}`" for n in hit)
            return f"({joined})" if hit else "false"
        if word.lower() in ("and", "or", "not"):
            return word.upper()
        return f"`{prefix}{word}`" if word in names else "false"
    if re.search(r"[^\w\s()*?]", text):
        raise RuleError(f"condition {text!r} is not a plain row condition")
    made = _CONDITION_TOKEN.sub(swap, text)
    shape = re.sub(r"\s", "", re.sub(r"\bNOT\b", "!", re.sub(r"\b(AND|OR)\b", "&", re.sub(r"`[^`]*`|\bfalse\b", "x", made))))
    while (shorter := re.sub(r"!x|\(x\)|x&x", "x", shape)) != shape:
        shape = shorter
    if shape != "x":  # Spark SQL would read words left over as a name for the column
        raise RuleError(f"condition {text!r} is not one whole expression")
    return made


def rule_rank(rule):
    return -SEVERITIES.index(rule.get("level") or "info"), str(rule.get("id"))


def tags_of(rule):
    low = [t.lower()[7:] for t in rule.get("tags") or [] if t.lower().startswith("attack.")]
    technique = lambda t: len(t) > 1 and t[0] == "t" and t[1].isdigit()
    return [tactic_name(t) for t in low if not technique(t)], [t.upper() for t in low if technique(t)]


def add_selections(df: DataFrame, rules) -> DataFrame:
    cols = {}
    for i, rule in enumerate(rules):
        for name, body in rule["detection"].items():
            if name not in ("condition", "timeframe"):
                cols[f"_r{i}_{name}"] = selection(body, df.columns)
    return df.withColumns(cols)


def rule_column(i: int, rule) -> Column:
    names = [n for n in rule["detection"] if n not in ("condition", "timeframe")]
    return true_only(F.expr(condition_sql(str(rule["detection"]["condition"]), names, f"_r{i}_")))


def usable(rules, columns) -> tuple[list, list[tuple[str, str]]]:
    """Rules that can run, and (id, reason) of the others: one bad rule does not stop detection."""
    good, bad = [], []
    for rule in rules:
        try:
            for name, body in rule["detection"].items():
                if name not in ("condition", "timeframe"):
                    selection(body, columns)
            rule_column(0, rule)
            good.append(rule)
        except (RuleError, KeyError, TypeError, AttributeError) as problem:
            bad.append((str(rule.get("id")), str(problem).splitlines()[0]))
    return good, bad


def matching(df: DataFrame, rule) -> DataFrame:
    """Rows of ``df`` on which one rule fires."""
    return add_selections(df, [rule]).filter(rule_column(0, rule)).select(df.columns)


def stable(rules):
    return [r for r in rules if r.get("status") == "stable"]


def match_all(df: DataFrame, rules, stable_only: bool = True, logsource: bool = False) -> DataFrame:
    """Add ``rule_matches``: one struct per firing rule, most severe first, then by id."""
    use = sorted(usable(stable(rules) if stable_only else rules, df.columns)[0], key=rule_rank)
    with_cols = add_selections(df, use)
    found = []
    for i, rule in enumerate(use):
        tactics, techniques = tags_of(rule)
        arr = lambda xs: F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")
        one = F.struct(F.lit(str(rule["id"])).alias("rule_id"), F.lit(rule["title"]).alias("rule_title"),
                       F.lit(rule.get("level") or "info").alias("severity"),
                       arr(tactics).alias("tactics"), arr(techniques).alias("techniques"))
        fires = rule_column(i, rule)
        if logsource:
            fires = fires & logsource_column(rule.get("logsource") or {})
        found.append(F.when(fires, one))
    return with_cols.withColumn("rule_matches", F.array_compact(F.array(*found))).select(*df.columns, "rule_matches")


# Log source words and the event sources they stand for.
LOGSOURCE_TYPES = {"linux": ["linux_ebpf", "syslog"], "windows": ["windows_etw"], "network": ["network_flow"],
                   "firewall": ["network_flow", "syslog"], "dns": ["dns"], "aws": ["cloudtrail"]}


def logsource_column(source: dict) -> Column:
    """Optional extra condition from product / category / service; unknown words do not restrict."""
    kinds = [LOGSOURCE_TYPES[v] for v in (source.get("product"), source.get("category"), source.get("service")) if v in LOGSOURCE_TYPES]
    return all_of([c("source_type").isin(k) for k in kinds]) if kinds else F.lit(True)


# ---- counting rules --------------------------------------------------------

def timeframe_seconds(text) -> int | None:
    m = re.fullmatch(r"\s*(\d+)([smhd])\s*", str(text or ""))
    return int(m[1]) * UNIT_SECONDS[m[2]] if m else None


def count_rule(df: DataFrame, rule) -> DataFrame:
    """``sel | count([field]) [by col] > n`` within the timeframe, per tenant and tumbling window."""
    det = rule["detection"]
    m = COUNT.match(str(det["condition"]))
    if not m:
        raise RuleError("not a counting condition")
    cond, fld, by, op, n = m.groups()
    plain = dict(rule, detection={**det, "condition": cond.strip()})
    keys = ["tenant_id"] + ([FIELD_COLUMNS.get(by, by)] if by else [])
    measure = F.countDistinct(field(fld, df.columns)[0]) if fld else F.count("*")
    return threshold(matching(df, plain), keys, measure, op, int(n), timeframe_seconds(det.get("timeframe")) or 300)


def threshold(df: DataFrame, keys, measure: Column, op: str, limit, width_s: int, slide_s: int | None = None) -> DataFrame:
    """Aggregate per key and event-time window, kept where the measure passes the limit."""
    win = F.window("ts", f"{width_s} seconds", f"{slide_s} seconds" if slide_s else None)
    test = {">": c("n") > limit, ">=": c("n") >= limit, "<": c("n") < limit, "<=": c("n") <= limit, "=": c("n") == limit}[op]
    return (df.groupBy(win.alias("w"), *keys).agg(measure.alias("n")).filter(test)
            .select(*keys, c("w.start").alias("window_start"), c("w.end").alias("window_end"), "n"))


# ---- rule catalogue --------------------------------------------------------

def fp_class(status="status", level="level", n_falsepositives="n_falsepositives") -> Column:
    lv = c(level)
    return (F.when(c(status) != "stable", "experimental").when(lv.isin("critical", "high"), "production")
            .when((lv == "medium") & (c(n_falsepositives) == 0), "production").otherwise("review"))


def latest_rules(changes: DataFrame) -> DataFrame:
    """Last write per rule wins; deleted rules disappear."""
    rest = [x for x in changes.columns if x != "rule_id"]
    return (changes.groupBy("rule_id").agg(F.max_by(F.struct(*rest), F.struct("updated_at", "change_id")).alias("x"))
            .select("rule_id", "x.*").filter(c("status") != "deleted"))


def validation(name="name", severity="severity") -> Column:
    """NULL when valid, else the reason."""
    n = F.octet_length(c(name))
    return (F.when(~true_only(n.between(1, 200)), "name must be 1-200 characters")
            .when(~true_only(F.lower(c(severity)).isin(SEVERITIES)), "unknown severity"))


def match_rate_class(rate) -> Column:
    return F.when(c(rate) < 0.02, "production").when(c(rate) <= 0.10, "review").otherwise("experimental")


def match_rates(df: DataFrame, rules) -> DataFrame:
    """Per rule: matches, share of events and class, in one pass over the events."""
    use = sorted(rules, key=rule_rank)
    base = add_selections(df, use)
    stats = base.agg(F.count("*").alias("total"), *[F.count_if(rule_column(i, r)).alias(f"m{i}") for i, r in enumerate(use)])
    rows = F.explode(F.array(*[F.struct(F.lit(str(r["id"])).alias("rule_id"), c(f"m{i}").alias("matches"), c("total")) for i, r in enumerate(use)]))
    rate = F.round(c("matches") / F.greatest(c("total"), F.lit(1)), 6)
    return stats.select(rows.alias("x")).select("x.*").withColumn("match_rate", rate).withColumn("fp_class", match_rate_class("match_rate"))


def match_stats(matched: DataFrame) -> DataFrame:
    """Total, last match and average per active day, by rule (input has ``rule_matches``)."""
    rows = matched.select("ts", F.explode("rule_matches.rule_id").alias("rule_id"))
    return rows.groupBy("rule_id").agg(F.count("*").alias("total"), F.max("ts").alias("last_match"),
                                       F.countDistinct(F.to_date("ts")).alias("days")).withColumn(
        "avg_per_day", F.round(c("total") / c("days"), 6))
