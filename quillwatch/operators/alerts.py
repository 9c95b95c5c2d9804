"""From candidates to alerts: grouping, assembly, lifecycle, notification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwatch.functions.scalars import c, seconds, severity_from_score, severity_rank, true_only, word_map
from quillwatch.operators import anchored, split

WINDOW_US = 15 * split.MINUTE
KEYS = ["tenant_id", "rule_id", "entity"]

# The id used when no rule fired, compliance texts, narrative words.
NO_RULE = "00000000-0000-0000-0000-000000000000"
INCIDENT_CLASS = "Malicious Code / Attack"
SEVERITY_HI = {"critical": "गंभीर", "high": "उच्च", "medium": "मध्यम", "low": "निम्न", "info": "सूचनात्मक"}
STATUS_WORDS = {"open": "open", "acknowledged": "acknowledged", "in_progress": "in_progress", "in-progress": "in_progress",
                "in_investigation": "in_progress", "resolved": "resolved", "false_positive": "false_positive",
                "false-positive": "false_positive", "suppressed": "suppressed"}


def with_key(cands: DataFrame) -> DataFrame:
    """Grouping key: tenant, first rule, host (else source address)."""
    return cands.withColumns({
        "rule_id": F.coalesce(F.try_element_at("rule_matches", F.lit(1))["rule_id"], F.lit(NO_RULE)),
        "entity": F.coalesce("hostname", "src_ip", F.lit("unknown"))})


def evidence(keyed: DataFrame, width_us: int = WINDOW_US, fold_limit: int = anchored.FOLD_LIMIT) -> DataFrame:
    """Every candidate with the opening of its window. This is the alert-to-event relation: evidence
    stays in rows, so a busy alert never becomes one huge array."""
    return anchored.assign(keyed, KEYS, "ts", width_us, fold_limit)


def windows(ev: DataFrame) -> DataFrame:
    """One row per alert window, with the candidate that opened it."""
    first = F.struct(*[x for x in ev.columns if x not in KEYS + ["window_start"]])
    return (ev.groupBy(*KEYS, "window_start")
            .agg(F.count("*").alias("event_count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
                 F.max("risk_score").alias("max_risk"), F.min_by(first, F.struct("ts", "event_id")).alias("first")))


def source(matches, ioc_hit) -> Column:
    return F.when(F.size(c(matches)) > 0, "sigma").when(true_only(c(ioc_hit)), "ioc").otherwise("onnx")


def affected_ips(src, dst) -> Column:
    return F.array_distinct(F.array_compact(F.array(c(src), c(dst))))


def listed(col) -> Column:
    return F.array_compact(F.array(c(col)))


def incident_class(severity) -> Column:
    return F.when(c(severity).isin("high", "critical"), INCIDENT_CLASS)


def privacy_applies(tactics) -> Column:
    return F.exists(c(tactics), lambda t: F.lower(t).contains("exfil"))


def local_time(ts) -> Column:
    return F.date_format(c(ts) + seconds(5 * 3600 + 30 * 60), "HH:mm 'IST'")


# The alert texts in both languages, with local (UTC+5:30) time.
def narrative_en(severity, rule, host, ts, count, technique, tactic) -> Column:
    sev = F.initcap(c(severity))
    tech, tac = F.coalesce(c(technique), F.lit("")), F.coalesce(c(tactic), F.lit(""))
    tags = F.when(tech == "", "").when(tac == "", F.format_string(" MITRE ATT&CK: %s.", tech)).otherwise(
        F.format_string(" MITRE ATT&CK: %s (%s).", tech, tac))
    return F.format_string("%s security alert: %s detected on host %s at %s. %d event(s) in the last 15 minutes. Severity: %s.%s",
                           sev, F.coalesce(c(rule), F.lit("Unknown")), F.coalesce(c(host), F.lit("unknown")), local_time(ts), c(count), sev, tags)


def narrative_hi(severity, rule, host, ts, count) -> Column:
    return F.format_string("%s सुरक्षा अलर्ट: %s पर %s पर %s का पता चला। पिछले 15 मिनटों में %d घटनाएँ।",
                           word_map(severity, SEVERITY_HI), F.coalesce(c(host), F.lit("अज्ञात होस्ट")), local_time(ts),
                           F.coalesce(c(rule), F.lit("Unknown")), c(count))


def assemble(win: DataFrame) -> DataFrame:
    """The alert row. The alert id is a digest of the key and opening, so reruns give the same id."""
    rule = F.try_element_at("first.rule_matches", F.lit(1))
    tactics = F.coalesce(rule["tactics"], F.array().cast("array<string>"))
    technique = F.split(F.try_element_at(rule["techniques"], F.lit(1)), r"\.")
    out = win.withColumns({
        "alert_id": F.md5(F.concat_ws("|", *KEYS, F.unix_micros(c("window_start").cast("timestamp")).cast("string"))),
        "rule_name": F.coalesce(rule["rule_title"], F.lit("Unknown")),
        "rule_version": F.when(rule.isNotNull(), "1"),
        "detection_source": source("first.rule_matches", "first.ioc_hit"),
        "risk_score": c("max_risk"),
        "severity": severity_from_score("max_risk"),
        "confidence": c("first.anomaly_score"),
        "mitre_tactic": F.try_element_at(tactics, F.lit(1)),
        "mitre_technique": F.try_element_at(technique, F.lit(1)),
        "mitre_sub_tech": F.try_element_at(technique, F.lit(2)),
        "affected_assets": listed("first.hostname"), "affected_users": listed("first.user_name"),
        "affected_ips": affected_ips("first.src_ip", "first.dst_ip"),
        "status": F.lit("open"),
        "cert_in_category": incident_class("first.risk_severity"),
        "dpdp_applicable": privacy_applies(F.flatten("first.rule_matches.tactics")),
        "schema_version": F.lit(1)})
    return out.withColumns({
        "narrative_en": narrative_en("first.risk_severity", "rule_name", "first.hostname", "first_seen", "event_count", "mitre_technique", "mitre_tactic"),
        "narrative_hi": narrative_hi("first.risk_severity", "rule_name", "first.hostname", "first_seen", "event_count"),
    }).drop("first", "max_risk")


# ---- lifecycle -------------------------------------------------------------

def status_word(text) -> Column:
    """Accepted spellings to the stored word; NULL when unknown."""
    return word_map(F.lower(c(text)), STATUS_WORDS)


def apply_changes(alerts: DataFrame, changes: DataFrame) -> DataFrame:
    """Latest value of each changed column wins. ``changes``: alert_id, change_id, at_time, actor, status,
    notes, assignee (NULL = unchanged). Resolving stamps time and user; unknown statuses are refused."""
    ok = changes.withColumn("status_word", status_word("status")).filter(c("status").isNull() | c("status_word").isNotNull())
    order = F.struct("at_time", "change_id")
    last = lambda col, when: F.max_by(col, F.when(when, order))
    set_status, resolved = c("status_word").isNotNull(), c("status_word") == "resolved"
    merged = ok.groupBy("alert_id").agg(
        last("status_word", set_status).alias("new_status"), last("notes", c("notes").isNotNull()).alias("resolution_notes"),
        last("assignee", c("assignee").isNotNull()).alias("assigned_to"),
        last("at_time", resolved).alias("resolved_on"), last("actor", resolved).alias("resolved_by"))
    return (alerts.join(merged, "alert_id", "left").withColumn("status", F.coalesce("new_status", "status"))
            .withColumn("resolved_at", F.coalesce("resolved_on", "resolved_at")).drop("new_status", "resolved_on"))


def acknowledge(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """Only open alerts move to acknowledged and get the (first) acknowledging user."""
    who = acks.groupBy("alert_id").agg(F.min_by("actor", F.struct("at_time", "actor")).alias("ack_actor"))
    moves = (c("status") == "open") & c("ack_actor").isNotNull()
    return (alerts.join(who, "alert_id", "left").withColumn("assigned_to", F.when(moves, c("ack_actor")))
            .withColumn("status", F.when(moves, "acknowledged").otherwise(c("status"))).drop("ack_actor"))


def is_urgent(severity) -> Column:
    return c(severity).isin("critical", "high")


def minutes_between(a, b) -> Column:
    return (F.unix_seconds(c(b).cast("timestamp")) - F.unix_seconds(c(a).cast("timestamp"))) / 60


def response_times(alerts: DataFrame, *keys) -> DataFrame:
    avg = lambda col: F.round(F.avg(minutes_between("created_at", col)), 6)
    return alerts.groupBy(*keys).agg(avg("detected_at").alias("mttd_min"), avg("acknowledged_at").alias("mtta_min"),
                                     avg("resolved_at").alias("mttr_min"), F.count("*").alias("alerts"))


# Channels in order of attempt and the hourly allowance.
CHANNELS = ["whatsapp", "sms", "email"]
MAX_PER_HOUR = 10


def rate_limited(requests: DataFrame, keys=("tenant_id", "channel"), ts="created_at", tie="alert_id", per_hour: int = MAX_PER_HOUR) -> DataFrame:
    """Add ``allowed``: urgent always; others while fewer than the allowance in the hour that the
    key's first counted request opened. The hours are anchored windows, so a busy tenant splits by hour."""
    keys = list(keys)
    plain = anchored.assign(requests.filter(~is_urgent("severity")), keys, ts, split.HOUR)
    ranked = split.running(plain, [*keys, "window_start"], ts, [ts, tie], {"nth": F.lit(1)}, 5 * split.MINUTE)
    rest = ranked.withColumn("allowed", c("nth") <= per_hour).drop("window_start", "nth")
    return requests.filter(is_urgent("severity")).withColumn("allowed", F.lit(True)).unionByName(rest)


def notify_plan(alerts: DataFrame) -> DataFrame:
    """Which channels get the message, from ``<channel>_ok`` (sending works) and ``<channel>_allowed``.
    Non-urgent messages stop at the first success; urgent ones go everywhere."""
    done = F.lit(False)
    cols = {}
    for ch in CHANNELS:
        tried = (is_urgent("severity") | ~done) & c(f"{ch}_allowed")
        cols[f"{ch}_sent"] = tried & c(f"{ch}_ok")
        done = done | cols[f"{ch}_sent"]
    return alerts.withColumns(cols)


def digest(alerts: DataFrame, period: str) -> DataFrame:
    """Counts of the lower severities per tenant and period (``hour`` or ``day``)."""
    start = F.date_trunc(period, "created_at").cast("timestamp_ntz")
    return (alerts.filter(~is_urgent("severity")).groupBy("tenant_id", start.alias("period"), "severity")
            .agg(F.count("*").alias("alerts"), F.countDistinct("rule_id").alias("rules"), F.max("risk_score").alias("top_risk")))


def fp_rate(alerts: DataFrame) -> DataFrame:
    closed = c("status").isin("resolved", "false_positive")
    return alerts.groupBy("rule_id").agg(
        F.count("*").alias("alerts"), F.count_if(c("status") == "false_positive").alias("false_positives"),
        F.round(F.avg(F.when(closed, (c("status") == "false_positive").cast("int"))), 6).alias("fp_rate"))


def case_summary(alerts: DataFrame) -> DataFrame:
    return (alerts.filter("case_id IS NOT NULL").groupBy("tenant_id", "case_id")
            .agg(F.count("*").alias("alerts"), F.min("created_at").alias("opened"), F.max("created_at").alias("last_alert"),
                 severity_max("severity").alias("severity"), F.count_if(c("status") == "open").alias("open_alerts")))


def severity_max(col) -> Column:
    return F.max_by(c(col), severity_rank(col))


def timeline(alerts: DataFrame, notes: DataFrame) -> DataFrame:
    """Alerts and notes of each case in one stream. ``notes``: case_id, at_time, kind, detail."""
    a = alerts.filter("case_id IS NOT NULL").select("case_id", c("created_at").alias("at_time"), F.lit("alert").alias("kind"), c("alert_id").cast("string").alias("detail"))
    return a.unionByName(notes.select("case_id", "at_time", "kind", "detail"))
