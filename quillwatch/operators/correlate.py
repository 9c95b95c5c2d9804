"""Rules over several events, from condition text: counts in a sliding time and ordered steps.

``sel | count([field]) [by col] > n`` and ``a then b then c [by col]`` (``a | near b`` is two steps), both within the rule's timeframe and tenant.

Steps are an automaton whose state is, for each step, the latest start of a chain that has come so far. A row moves a chain on by one step, so what a time slice of a
key does to the state is a small table: the latest start made inside it for each step, and how far a chain that enters at each step gets. These tables are
composed over the slices of a key as running maxima of one row per slice, and each row then asks only its own slice and the state at the slice's start. The events
are shuffled once, by (key, slice), and no task walks a key.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillwatch.functions.scalars import all_of, c, from_micros, micros, true_only
from quillwatch.operators import rules, split

_STEPS = re.compile(r"\s+then\s+|\s*\|\s*near\s+", re.I)
_BY = re.compile(r"^(.*?)\s+by\s+([A-Za-z_][A-Za-z0-9_]*)\s*$", re.I | re.S)
DEFAULT_S = 300


def kind(rule) -> str:
    """``count``, ``steps`` or ``row``."""
    text = str(rule["detection"].get("condition"))
    return "count" if rules.COUNT.match(text) else "steps" if _STEPS.search(text) else "row"


def _timeframe(rule) -> int:
    return rules.timeframe_seconds(rule["detection"].get("timeframe")) or DEFAULT_S


def _keys(by: str | None) -> list[str]:
    return ["tenant_id"] + ([rules.FIELD_COLUMNS.get(by, by)] if by else [])


def _known(keys) -> object:
    """Rows without a value of the key belong to no group."""
    return all_of([c(k).isNotNull() for k in keys])


def counted(events: DataFrame, rule, width: int = split.HOUR) -> DataFrame:
    """Rows of the selection at which the count of the timeframe that ends with them passes the limit, and that count as ``n``.

    A burst counts wherever it lies. Times are closed: a row exactly one timeframe earlier counts."""
    m = rules.COUNT.match(str(rule["detection"]["condition"]))
    if not m:
        raise rules.RuleError("not a counting condition")
    cond, fld, by, op, limit = m.groups()
    keys, lookback = _keys(by), _timeframe(rule) * split.SECOND
    rows = rules.matching(events, dict(rule, detection={**rule["detection"], "condition": cond.strip()})).filter(_known(keys))
    if fld:
        rows = split.range_distinct(rows.withColumn("_of", rules.field(fld, events.columns)[0]), keys, "ts", "_of", lookback, "n", width).drop("_of")
        rows = rows.withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    else:
        rows = split.range_counts(rows, keys, "ts", lookback, {"n": F.lit(True)}, width)
    test = {">": c("n") > int(limit), ">=": c("n") >= int(limit), "<": c("n") < int(limit), "<=": c("n") <= int(limit), "=": c("n") == int(limit)}[op]
    return rows.filter(test)


def steps_of(rule) -> tuple[list[str], str | None]:
    """Conditions of the steps and the field they share."""
    text = str(rule["detection"]["condition"])
    m = _BY.match(text)
    steps = _STEPS.split(m[1] if m else text)
    if len(steps) < 2 or not all(x.strip() for x in steps):
        raise rules.RuleError(f"condition {text!r} has no steps")
    return [x.strip() for x in steps], m[2] if m else None


def stepped(events: DataFrame, rule, width: int = split.HOUR) -> DataFrame:
    """Rows of the last step that end a chain of all steps, each strictly later than the one before, within the timeframe of the first; ``started`` is the latest such first time."""
    texts, by = steps_of(rule)
    names = [n for n in rule["detection"] if n not in ("condition", "timeframe")]
    with_cols = rules.add_selections(events, [rule])
    flags = {f"_f{i}": true_only(F.expr(rules.condition_sql(text, names, "_r0_"))) for i, text in enumerate(texts)}
    keys = _keys(by)
    rows = with_cols.withColumns(flags).filter(_known(keys) & c("ts").isNotNull()).select(*events.columns, *flags)
    return chains(rows, keys, list(flags), _timeframe(rule) * split.SECOND, width).drop(*flags)


def chains(rows: DataFrame, keys, flags: list[str], within_us: int, width: int = split.HOUR) -> DataFrame:
    """Rows with the last flag that end a chain, with ``started``. ``flags``: boolean columns, one per step."""
    last = len(flags) - 1
    any_flag = c(flags[0])
    for f in flags[1:]:
        any_flag = any_flag | c(f)
    d = rows.filter(any_flag).withColumns({"_us": micros("ts"), split.SLICE: split.slice_of("ts", width)})
    d = d.repartition(*keys, split.SLICE)
    before = Window.partitionBy(*keys, split.SLICE).orderBy("_us").rangeBetween(Window.unboundedPreceding, -1)
    # Inside the slice: _s{i} is the latest start of a chain that reaches step i at this row; _e{j}_{i} whether one that entered at step j does.
    d = d.withColumn("_s0", F.when(c(flags[0]), c("_us")))
    for i in range(1, last + 1):
        d = d.withColumn(f"_s{i}", F.when(c(flags[i]), F.max(f"_s{i - 1}").over(before)))
        for j in range(i):
            came = F.lit(True) if j == i - 1 else F.coalesce(F.max(f"_e{j}_{i - 1}").over(before), F.lit(False))
            d = d.withColumn(f"_e{j}_{i}", c(flags[i]) & came)
    inner = range(last)
    table = d.groupBy(*keys, split.SLICE).agg(*[F.max(f"_s{i}").alias(f"_s{i}") for i in inner], *[F.max(f"_e{j}_{i}").alias(f"_e{j}_{i}") for i in inner for j in range(i)])
    # Composed over slices: _b{i} is the latest start of a chain that stood at step i when the slice began.
    past = Window.partitionBy(*keys).orderBy(split.SLICE).rowsBetween(Window.unboundedPreceding, -1)
    for i in inner:
        made = F.greatest(c(f"_s{i}"), *[F.when(c(f"_e{j}_{i}"), c(f"_b{j}")) for j in range(i)]) if i else c("_s0")
        table = table.withColumn(f"_b{i}", F.max(made).over(past))
    state = table.select(*[c(k).alias(f"_q_{k}") for k in keys], c(split.SLICE).alias("_q_slice"), *[f"_b{i}" for i in inner])
    on = [c(k) == c(f"_q_{k}") for k in keys] + [c(split.SLICE) == c("_q_slice")]
    start = F.greatest(c(f"_s{last}"), *[F.when(c(f"_e{j}_{last}"), c(f"_b{j}")) for j in inner])
    found = d.filter(flags[last]).join(state, on).withColumn("started", start).filter(c("_us") - c("started") <= within_us)
    return found.withColumn("started", from_micros("started")).select(*rows.columns, "started")


def correlate(events: DataFrame, rule_list, width: int = split.HOUR) -> DataFrame:
    """event_id, tenant_id, ts, rule_id, n (of counts) and started (of steps) of all rules over several events. Each rule is a pass of its own over its rows."""
    out = None
    for rule in rule_list:
        found = counted(events, rule, width).withColumn("started", F.lit(None).cast("timestamp_ntz")) if kind(rule) == "count" else stepped(events, rule, width).withColumn("n", F.lit(None).cast("bigint"))
        found = found.select("event_id", "tenant_id", "ts", F.lit(str(rule["id"])).alias("rule_id"), "n", "started")
        out = found if out is None else out.unionByName(found)
    return out
