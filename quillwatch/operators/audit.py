"""Tamper-evident audit log, tenancy checks, permissions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillwatch.functions.scalars import c
from quillwatch.operators import split

# The hash before the first row, and the digest input order.
GENESIS = "0" * 64


def ts_text(ts) -> Column:
    return F.date_format(c(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def row_digest(prev, action="action", actor="actor_id", ts="ts") -> Column:
    return F.sha2(F.concat(c(prev), c(action), c(actor), ts_text(ts)), 256)


def build_chain(log: DataFrame, tips: DataFrame | None = None) -> DataFrame:
    """Link rows (tenant_id, chain_seq, action, actor_id, ts) per tenant.

    Each hash needs the one before, so a tenant's new rows are walked in order by one task; they are
    streamed through it in sorted batches (memory stays constant whatever the tenant's size), and with
    ``tips`` (tenant_id, tip_hash) only the rows since the last run are walked. Verification, which has
    to look at the whole log, is fully parallel.
    """
    rows = log.withColumn("_text", F.concat(c("action"), c("actor_id"), ts_text("ts")))
    rows = rows.join(tips.select("tenant_id", "tip_hash"), "tenant_id", "left") if tips is not None else rows.withColumn("tip_hash", F.lit(None).cast("string"))
    out_schema = T.StructType([*log.schema.fields, T.StructField("prev_hash", T.StringType()), T.StructField("row_hash", T.StringType())])

    def link(batches):
        tenant, tip = None, None
        for batch in batches:
            prevs, hashes = [], []
            for t, start, text in zip(batch["tenant_id"], batch["tip_hash"], batch["_text"]):
                if t != tenant:
                    tenant, tip = t, start if isinstance(start, str) else GENESIS
                prevs.append(tip)
                tip = hashlib.sha256((tip + text).encode()).hexdigest()
                hashes.append(tip)
            yield batch.drop(columns=["_text", "tip_hash"]).assign(prev_hash=prevs, row_hash=hashes)

    return rows.repartition("tenant_id").sortWithinPartitions("tenant_id", "chain_seq").select(*log.columns, "_text", "tip_hash").mapInPandas(link, out_schema)


def verify_chain(chain: DataFrame) -> DataFrame:
    """Rows whose own hash does not recompute or whose ``prev_hash`` is not the previous row's hash.

    The previous row is found by equality on (tenant, sequence), which spreads evenly."""
    before = chain.select(c("tenant_id").alias("_t"), (c("chain_seq") + 1).alias("_s"), c("row_hash").alias("_h"))
    d = chain.join(before, (c("tenant_id") == c("_t")) & (c("chain_seq") == c("_s")), "left")
    expected = F.coalesce("_h", F.when(c("chain_seq") == 1, GENESIS))
    d = d.withColumns({"hash_ok": c("row_hash") == row_digest("prev_hash"), "link_ok": F.coalesce(c("prev_hash") == expected, F.lit(False))})
    return d.drop("_t", "_s", "_h").filter(~c("hash_ok") | ~c("link_ok"))


SEQ_SLICE = 100_000


def with_previous(log: DataFrame, cols: dict) -> DataFrame:
    """Values of the previous row by sequence within the tenant."""
    return split.previous(log, ["tenant_id"], F.floor(c("chain_seq") / SEQ_SLICE).cast("bigint"), ["chain_seq", "event_id"], cols)


def sequence_gaps(log: DataFrame) -> DataFrame:
    """Rows that do not directly follow their predecessor: a hole or a repeat."""
    d = with_previous(log, {"prev_seq": c("chain_seq")})
    d = d.withColumn("prev_seq", F.coalesce("prev_seq", F.lit(0)))
    return d.filter(c("chain_seq") != c("prev_seq") + 1).withColumn("kind", F.when(c("chain_seq") <= c("prev_seq"), "repeat").otherwise("missing"))


def search(log: DataFrame, actor=None, actions=None, start=None, end=None) -> DataFrame:
    t = lambda x: F.lit(x).cast("timestamp_ntz")
    for cond, value in ((lambda: c("actor_id") == actor, actor), (lambda: c("action").isin(actions), actions), (lambda: c("ts") >= t(start), start), (lambda: c("ts") <= t(end), end)):
        if value:
            log = log.filter(cond())
    return log


# Roles, actions and resources, and who may do what.
ACTIONS = ["read", "write", "delete", "execute", "manage"]
RESOURCES = ["events", "alerts", "rules", "assets", "playbooks", "users", "settings", "compliance", "agents", "tenants"]
ADMIN_DENIED = {("delete", "users"), ("manage", "settings"), ("write", "tenants"), ("delete", "tenants"), ("manage", "tenants")}
GRANTS = {
    "analyst": {"read": ["events", "alerts", "rules", "assets", "playbooks", "compliance", "agents"], "write": ["alerts", "rules", "assets"], "execute": ["playbooks"]},
    "viewer": {"read": ["events", "alerts", "rules", "assets", "playbooks", "settings", "compliance", "agents"]},
    "api_key": {"read": ["events", "alerts"]},
}


def permission_matrix(spark) -> DataFrame:
    """Every allowed (role, action, resource)."""
    every = [(a, r) for a in ACTIONS for r in RESOURCES]
    rows = [("super_admin", a, r) for a, r in every] + [("admin", a, r) for a, r in every if (a, r) not in ADMIN_DENIED]
    rows += [(role, a, r) for role, acts in GRANTS.items() for a, rs in acts.items() for r in rs]
    return spark.createDataFrame(rows, "role string, action string, resource string")


def violations(log: DataFrame) -> DataFrame:
    return log.join(permission_matrix(log.sparkSession), ["role", "action", "resource"], "left_anti")


def without_tenant(df: DataFrame, tenant: str) -> DataFrame:
    return df.filter(c("tenant_id") != tenant)
