"""Compliance reports as aggregations and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwatch.functions.scalars import c, contains_any, choose, duration_text
from quillwatch.operators.alerts import minutes_between

# Incident categories, and the ordered words that select them.
CATEGORIES = {
    1: "Targeted scanning/probing of critical networks or systems",
    2: "Compromise of critical systems/information",
    3: "Unauthorised access to IT systems/data",
    4: "Defacement of website or intrusion into a website and related systems",
    5: "Malicious code attacks such as spreading of virus/worm/Trojan/Bots/Spyware/Ransomware/Cryptominers",
    6: "Attacks on servers such as Database, Mail and DNS and Network devices such as Routers",
    7: "Identity Theft, Spoofing and Phishing attacks",
    8: "Denial of Service (DoS) and Distributed Denial of Service (DDoS) attacks",
    9: "Attacks on Critical infrastructure, SCADA, Operational Technology Systems and Wireless networks",
    10: "Attacks on Applications such as E-Governance, E-Commerce etc.",
    11: "Data Breach",
    12: "Data Leak",
    13: "Attacks on Internet of Things (IoT) devices and associated systems, networks and infrastructure",
}
CATEGORY_WORDS = [
    (1, ["scan", "probe", "recon"]), (5, ["ransomware", "malware", "virus", "worm", "trojan", "cryptominer"]),
    (7, ["phish", "spoof", "identity"]), (8, ["ddos", "dos", "flood"]), (11, ["breach", "exfil"]), (12, ["leak", "exposure"]),
    (4, ["defac", "tamper"]), (3, ["unauth", "privilege", "lateral"]), (9, ["scada", "ot/", "ics"]), (13, ["iot", "embedded"]),
    (10, ["web app", "application", "sqli"]), (6, ["server", "dns", "mail"]), (2, ["compromi", "rootkit", "persist"]),
]
DEADLINE_HOURS = 72
MTTD_TARGET_S, MTTA_TARGET_S, MTTR_TARGET_S = 15 * 60, 30 * 60, 4 * 60 * 60
RETENTION_DAYS = 180


def incident_category(text) -> Column:
    """Category number by the first matching word group; NULL when none matches."""
    low = F.lower(c(text))
    return choose([(contains_any(low, words), F.lit(n)) for n, words in CATEGORY_WORDS])


def category_text(number) -> Column:
    return choose([(c(number) == n, F.lit(t)) for n, t in CATEGORIES.items()])


def catalog(spark) -> DataFrame:
    return spark.createDataFrame(list(CATEGORIES.items()), "category int, description string")


def category_counts(incidents: DataFrame, start: str, end: str, ts="ts", text="text") -> DataFrame:
    """All thirteen categories with their count in the period, zero when absent."""
    if start >= end:
        raise ValueError("the period must start before it ends")
    t = lambda x: F.lit(x).cast("timestamp_ntz")
    seen = (incidents.filter((c(ts) >= t(start)) & (c(ts) < t(end))).select(incident_category(text).alias("category"))
            .groupBy("category").agg(F.count("*").alias("incidents")))
    return catalog(incidents.sparkSession).join(seen, "category", "left").fillna(0, ["incidents"])


# Fixed value: the layout of the incident report.
def incident_text(category, incident_id, detected_at, description, system, organisation, generator: str) -> Column:
    return F.format_string(
        "CERT-In Incident Report\n========================\nOrganisation : %s\nIncident ID  : %s\nCategory No. : %d\nCategory     : %s\n"
        "Detected At  : %s\nAffected     : %s\n\nDescription\n-----------\n%s\n\n[Report generated by %s — submit to incident@cert-in.org.in within 6 hours]\n",
        c(organisation), c(incident_id), c(category), category_text(category), c(detected_at), c(system), c(description), F.lit(generator))


def access_trail(audit: DataFrame) -> DataFrame:
    """Access to personal data with the display class of its consent."""
    return audit.select("actor_id", "actor_type", "action", c("resource_type").alias("data_category"), c("ts").alias("accessed_at"), "consent_recorded",
                        F.when(c("consent_recorded"), "ok").otherwise("warn").alias("consent_class"))


def deadline(detected_text, now: str) -> Column:
    """Struct (overdue, hours_left) from an internet timestamp; unreadable text is (false, 72)."""
    t = c(detected_text)
    at = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"), t.try_cast("timestamp"))
    s = F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(at)
    hours = F.when(s >= 0, F.floor(s / 3600)).otherwise(F.ceil(s / 3600)).cast("bigint")
    left = F.coalesce(DEADLINE_HOURS - hours, F.lit(DEADLINE_HOURS))
    return F.struct((left < 0).alias("overdue"), left.alias("hours_left"))


def result_class(col) -> Column:
    return F.when(c(col) == "success", "ok").when(c(col).isin("failure", "denied"), "warn").otherwise("")


def privileged_access(audit: DataFrame, actions, start: str, end: str) -> DataFrame:
    t = lambda x: F.lit(x).cast("timestamp_ntz")
    return audit.filter(c("action").isin(actions) & (c("ts") >= t(start)) & (c("ts") < t(end))).select(
        "actor_id", "action", c("resource_type").alias("resource"), "ts", "result", "source_ip", result_class("result").alias("result_class"))


def localised(resident, egress) -> Column:
    return c(resident) & (F.size(c(egress)) == 0)


def response_metrics(alerts: DataFrame, *keys) -> DataFrame:
    """Mean times, whether each meets its target (no data counts as met), breaches, display text."""
    s = lambda col: minutes_between("created_at", col) * 60
    avg = lambda col: F.floor(F.avg(s(col))).cast("bigint")
    out = alerts.groupBy(*keys).agg(
        avg("detected_at").alias("mttd_s"), avg("acknowledged_at").alias("mtta_s"), avg("resolved_at").alias("mttr_s"),
        F.count_if(c("severity") == "critical").alias("critical_incidents"), F.count_if(s("detected_at") > MTTD_TARGET_S).alias("mttd_breaches"),
        F.count_if((c("severity") == "critical") & (s("resolved_at") > MTTR_TARGET_S)).alias("mttr_breaches"))
    met = lambda col, n: F.coalesce(c(col) <= n, F.lit(True))
    return out.withColumns({"mttd_ok": met("mttd_s", MTTD_TARGET_S), "mtta_ok": met("mtta_s", MTTA_TARGET_S), "mttr_ok": met("mttr_s", MTTR_TARGET_S),
                            "mttd_text": duration_text(c("mttd_s")), "mtta_text": duration_text(c("mtta_s")), "mttr_text": duration_text(c("mttr_s"))})


def retention(events: DataFrame, now: str, *keys, days: int = RETENTION_DAYS) -> DataFrame:
    """Oldest row, whether it is old enough, and days without any row between first and last."""
    seen = events.groupBy(*keys, F.to_date("ts").alias("day")).agg(F.min("ts").alias("oldest"))
    out = seen.groupBy(*keys).agg(F.min("oldest").alias("oldest"), F.count("*").alias("days_seen"), F.min("day").alias("_a"), F.max("day").alias("_b"))
    cutoff = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return out.select(*keys, "oldest", (c("oldest") <= cutoff).alias("covered"), (F.datediff("_b", "_a") + 1 - c("days_seen")).alias("missing_days"))


def missing_days(events: DataFrame, *keys) -> DataFrame:
    """The days without rows, per key."""
    seen = events.groupBy(*keys, F.to_date("ts").alias("day")).agg(F.lit(1).alias("_x")).drop("_x")
    span = seen.groupBy(*keys).agg(F.min("day").alias("_a"), F.max("day").alias("_b")).select(*keys, F.explode(F.sequence("_a", "_b")).alias("day"))
    return span.join(seen, [*keys, "day"], "left_anti")


def posture(checks: DataFrame) -> DataFrame:
    return checks.groupBy("framework").agg(F.count_if("passed").alias("passing"), F.count_if(~c("passed")).alias("failing")).withColumn(
        "score", F.round(100 * c("passing") / (c("passing") + c("failing")), 6))


def report_list(reports: DataFrame, tenant: str) -> DataFrame:
    return reports.filter(c("tenant_id") == tenant).orderBy(c("created_at").desc(), c("report_id").desc())
