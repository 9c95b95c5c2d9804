"""Rules as data: thousands of rules of files in one pass, with a plan whose size does not depend on their number.

Every rule becomes one row: its tests (field, kind of test, literals), the selections they form, and the truth table of its condition. One expression evaluates any
such row on any event. Which rules an event is tried on says an index from (field, literal) to rules: a rule that needs an exact value in some
field is filed under those values, and the event's own value of the field looks it up, one equality join per indexed field, which Spark broadcasts while the
index is small. A rule that needs a text at the start or end of some field is filed under a few letters of it, one join per field and number of letters (1, 2, 4, 8 or 16). Rules without such a value
(texts in the middle, patterns, numbers only) are tried on every event.

Rules that test the same are one body, tried once however many rules have it; ids, titles and tags are the heads of a body and are joined to the events that a body hits.

A rule fires on the same events as in `rules.match_all`; tests/test_rules.py compares the two on every modifier.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwatch.functions.scalars import c, ip_number, ip_number_of, quote_regex, true_only
from quillwatch.operators import rules
from quillwatch.sources.shared import materialize

#: Selections of a rule whose truth table is written out; rules with more are refused with a reason.
MOST_SELECTIONS = 10
#: Different bodies that the driver compiles at once. More are an error, not a cut.
MOST_BODIES = 100_000

TEST = "struct<source:string,test:string,texts:array<string>,numbers:array<bigint>>"
#: selections: of ways to satisfy each, of entries that all hold, of tests of which one holds.
BODY = f"struct<body:int,truth:string,selections:array<array<array<array<{TEST}>>>>>"
HEAD = "struct<rank:string,rule_id:string,rule_title:string,severity:string,tactics:array<string>,techniques:array<string>>"
_FLAGS = "(?iu)"


def _wild(text: str) -> str:
    return _FLAGS + r"\A" + "".join({"*": ".*", "?": "."}.get(ch) or quote_regex(ch) for ch in text) + r"\z"


def _range(text) -> list[int] | None:
    """First and last address of a block."""
    net, slash, bits = str(text).partition("/")
    base = ip_number_of(net)
    if base is None or (slash and (not bits.isdigit() or int(bits) > 32)):
        return None
    size = 1 << (32 - int(bits)) if slash else 1
    return [base // size * size, base // size * size + size - 1]


def _entries(key: str, values, columns) -> list[list[dict]]:
    """One line of a selection as entries that all must hold; an entry holds if any of its tests does."""
    name, _, modifier = key.partition("|")
    modifier = {"all|contains": "contains|all"}.get(modifier, modifier)
    modifier = modifier if modifier in rules.MODIFIERS else ""
    values = values if isinstance(values, list) else [values]
    target = rules.FIELD_COLUMNS.get(name)
    is_int = target in rules.INT_COLUMNS and target in columns
    source = f"field:{name}" if target is None else f"column:{target}" if target in columns else "none"
    made = []
    for v in values:
        text = v if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else None
        one = {"source": source, "test": "never", "texts": [], "numbers": []}
        if modifier in ("", "all"):
            if v is None:
                one["test"] = "null"
            elif is_int:
                if rules.is_int(v) or (text is not None and re.fullmatch(r"[+-]?\d+", text)):
                    one.update(test="equal", texts=[str(int(v if rules.is_int(v) else text))])
            elif text is not None and ("*" in text or "?" in text):
                one.update(test="pattern", texts=[_wild(text)])
            elif text is not None:
                one.update(test="equal" if text.isascii() else "equal_ascii", texts=[text.lower() if text.isascii() else text.translate({u: u + 32 for u in range(65, 91)})])
        elif modifier in ("contains", "contains|all", "startswith", "endswith"):
            if text is not None and not is_int:
                one.update(test=modifier.split("|")[0], texts=[text.lower()])
        elif modifier == "re":
            if isinstance(v, str) and not is_int and _compiles(v):
                one.update(test="pattern", texts=[v])
        elif modifier == "cidr":
            block = _range(v) if isinstance(v, str) and not is_int else None
            if block:
                one.update(test="block", numbers=block)
        elif rules.is_int(v):
            one.update(test=modifier, numbers=[v])
        made.append(one)
    return [[x] for x in made] if modifier in ("all", "contains|all") else [made]


def _compiles(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def _ways(body, columns) -> list[list[list[dict]]]:
    """A selection as ways to satisfy it, each a list of entries."""
    if isinstance(body, dict):
        return [[entry for k, v in body.items() for entry in _entries(k, v, columns)]]
    if isinstance(body, list) and body and all(isinstance(x, dict) for x in body):
        return [way for x in body for way in _ways(x, columns)]
    words = [x for x in body if isinstance(x, str)] if isinstance(body, list) else []
    return [[[{"source": "column:raw", "test": "contains", "texts": [w.lower()], "numbers": []} for w in words]]] if words else []


def _truth(rule, names: list[str]) -> str:
    """One character per combination of the selections, the first selection being the lowest bit."""
    made = rules.condition_sql(str(rule["detection"]["condition"]), names, "")
    made = re.sub(r"`([^`]*)`", lambda m: f"v[{names.index(m[1])}]", made)
    made = re.sub(r"\b(AND|OR|NOT)\b", lambda m: m[0].lower(), made).replace("false", "False")
    code = compile(made, "condition", "eval")  # the text was checked to be names, and, or, not and parentheses only
    return "".join("1" if eval(code, {"v": [bool(k >> i & 1) for i in range(len(names))]}) else "0" for k in range(1 << len(names)))


def _filed_under(t: dict, affixes: bool) -> tuple[str, str] | None:
    """Where a test is filed: what an event must hold for the test to hold. A text that starts or ends a value is filed under as many of its letters as a power of two, 16 at most,
    so that there are few such lengths however many texts there are."""
    kind, _, name = t["source"].partition(":")
    if kind == "column" and t["test"] == "equal":
        return t["source"], t["texts"][0]
    if not affixes or kind != "column" or t["test"] not in ("startswith", "endswith") or not t["texts"][0]:
        return None
    text = t["texts"][0]
    n = min(16, 1 << len(text).bit_length() - 1)
    return (f"starts{n}:{name}", text[:n]) if t["test"] == "startswith" else (f"ends{n}:{name}", text[-n:])


def _event_key(source: str) -> Column:
    """What an event is looked up by in the bodies filed under a source."""
    kind, _, name = source.partition(":")
    low = F.lower(c(name).cast("string"))
    return F.left(low, F.lit(int(kind[6:]))) if kind.startswith("starts") else F.right(low, F.lit(int(kind[4:]))) if kind.startswith("ends") else low


def _anchors(truth: str, selections: list) -> list[tuple[str, str]] | None:
    """(source, literal) of which an event must hold one for the rule to fire; None where there is no such set. Exact values are taken where there are any, then texts that start or end a value."""
    for affixes in (False, True):
        best = None
        for i, ways in enumerate(selections):
            if any(t == "1" and not k >> i & 1 for k, t in enumerate(truth)):
                continue  # the rule can fire without this selection
            need: list | None = []
            for way in ways:
                filed = [places for entry in way if entry and None not in (places := [_filed_under(t, affixes) for t in entry])]
                if not filed:
                    need = None
                    break
                need += min(filed, key=len)
            if need is not None and (best is None or len(need) < len(best)):
                best = need
        if best is not None:
            return best
    return None


def body_of(detection, columns) -> tuple[dict, list[tuple[str, str]] | None]:
    """What a rule tests, and its anchors."""
    names = [n for n in detection if n not in ("condition", "timeframe")]
    if len(names) > MOST_SELECTIONS:
        raise rules.RuleError(f"more than {MOST_SELECTIONS} selections")
    selections = [_ways(detection[n], columns) for n in names]
    truth = _truth({"detection": detection}, names)
    return {"truth": truth, "selections": selections}, _anchors(truth, selections)


def head_of(rule) -> dict:
    tactics, techniques = rules.tags_of(rule)
    return {"rank": f"{9 + rules.rule_rank(rule)[0]}{rule['id']}", "rule_id": str(rule["id"]), "rule_title": rule["title"], "severity": rule.get("level") or "info",
            "tactics": tactics, "techniques": techniques}


def _holds(values: Column, t: Column) -> Column:
    """One test on an event's values."""
    value = F.try_element_at(values, t["source"])
    low = F.lower(value)
    text, test = F.get(t["texts"], F.lit(0)), t["test"]
    number = F.when(value.rlike(r"^[+-]?[0-9]{1,19}$"), value.try_cast("bigint"))
    first, last = F.get(t["numbers"], F.lit(0)), F.get(t["numbers"], F.lit(1))
    ascii_low = F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    address = ip_number(value)
    out = (F.when(test == "equal", low == text).when(test == "null", value.isNull()).when(test == "contains", F.contains(low, text))
           .when(test == "startswith", F.startswith(low, text)).when(test == "endswith", F.endswith(low, text)).when(test == "pattern", F.rlike(value, text))
           .when(test == "block", (address >= first) & (address <= last)).when(test == "gt", number > first).when(test == "gte", number >= first)
           .when(test == "lt", number < first).when(test == "lte", number <= first).when(test == "equal_ascii", ascii_low == text).otherwise(F.lit(False)))
    return true_only(out)


def fires(values: Column, rule: Column) -> Column:
    """Whether a rule row fires on an event given as a map of its values."""
    entry = lambda tests: F.exists(tests, lambda t: _holds(values, t))
    selection = lambda ways: F.exists(ways, lambda way: F.forall(way, entry))
    bits = F.transform(rule["selections"], lambda ways, i: F.when(selection(ways), F.pow(F.lit(2), i).cast("int")).otherwise(0))
    place = F.aggregate(bits, F.lit(0), lambda a, b: a + b)
    return F.substring(rule["truth"], place + 1, F.lit(1)) == "1"


def event_values(columns) -> Column:
    """The columns that rules can name, and the free fields, as one map of texts."""
    known = [x for x in [*dict.fromkeys(rules.FIELD_COLUMNS.values()), "raw"] if x in columns]
    pairs = [y for x in known for y in (F.lit(f"column:{x}"), c(x).cast("string"))]
    made = F.create_map(*pairs)
    if "fields" in columns:
        free = F.transform_keys(F.coalesce("fields", F.create_map().cast("map<string,string>")), lambda k, _: F.concat(F.lit("field:"), k))
        made = F.map_concat(made, free)
    return made


class Index:
    """Compiled bodies: by (source, literal), for every event, and (id, reason) of rules that cannot run. ``heads`` are (body, head) of the rules given whole."""

    def __init__(self, rule_list, columns):
        self.columns = columns
        self.numbers: dict[str, int] = {}
        self.filed: dict[str, dict[str, list]] = {}
        self.always: list = []
        self.heads: list[tuple[int, dict]] = []
        self.rejected: list[tuple[str, str]] = []
        for rule in rule_list:
            try:
                self.heads.append((self.number(rule["detection"]), head_of(rule)))
            except FAULTS as problem:
                self.rejected.append((str(rule.get("id")), str(problem).splitlines()[0]))

    def number(self, detection) -> int:
        """The body of a detection, filed if it is new."""
        body, anchors = body_of(detection, self.columns)
        key = json.dumps(body)
        if key in self.numbers:
            return self.numbers[key]
        if len(self.numbers) == MOST_BODIES:
            raise ValueError(f"more than {MOST_BODIES} different bodies")
        n = self.numbers[key] = len(self.numbers)
        if anchors is None:
            self.always.append({"body": n, **body})
        for source, literal in dict.fromkeys(anchors or []):
            self.filed.setdefault(source, {}).setdefault(literal, []).append({"body": n, **body})
        return n


FAULTS = (rules.RuleError, KeyError, TypeError, AttributeError)


def catalog_index(cat: DataFrame, columns) -> tuple[Index, DataFrame]:
    """Index of a catalogue's rules and (detection, body). Only different detections pass through the driver, never the rules that have them."""
    index, numbered = Index([], columns), []
    for r in cat.filter("error IS NULL AND detection IS NOT NULL").groupBy("detection").agg(F.min("rule_id").alias("rule_id")).toLocalIterator():
        try:
            numbered.append((r["detection"], index.number(json.loads(r["detection"]))))
        except FAULTS as problem:
            index.rejected.append((r["rule_id"], str(problem).splitlines()[0]))
    return index, cat.sparkSession.createDataFrame(numbered, "detection string, body int")


def _rows(spark: SparkSession, filed: dict[str, list]) -> DataFrame:
    """literal, found: the bodies of one source, written once so that their size is known to the planner."""
    made = spark.createDataFrame([(k, json.dumps(v)) for k, v in filed.items()], "_literal string, _body string")
    return materialize(made.select("_literal", F.from_json("_body", f"array<{BODY}>").alias("_found")), "rule-index")


def match_bodies(events: DataFrame, index: Index) -> DataFrame:
    """Add ``_bodies``, the numbers of the bodies that fire."""
    spark, out = events.sparkSession, events
    found = []
    if index.always:
        text = spark.createDataFrame([(json.dumps(index.always),)], "_body string")
        # A scalar subquery is read once; an expression over a literal would be evaluated for every event.
        found.append(materialize(text.select(F.from_json("_body", f"array<{BODY}>").alias("_found")), "rule-always").select("_found").scalar())
    names = []
    for n, (source, filed) in enumerate(sorted(index.filed.items())):
        name = f"_rules{n}"
        rows = _rows(spark, filed).withColumnsRenamed({"_literal": f"_literal{n}", "_found": name})
        out = out.join(rows, _event_key(source) == c(f"_literal{n}"), "left")
        found.append(F.coalesce(c(name), F.array().cast(f"array<{BODY}>")))
        names += [name, f"_literal{n}"]
    tried = F.concat(*found) if found else F.array().cast(f"array<{BODY}>")
    out = out.withColumn("_tried", tried).withColumn("_values", F.when(F.size("_tried") > 0, event_values(events.columns)))
    hit = F.array_distinct(F.transform(F.filter("_tried", lambda r: fires(c("_values"), r)), lambda r: r["body"]))
    return out.withColumn("_bodies", hit).drop(*names, "_tried", "_values")


def with_heads(hits: DataFrame, heads: DataFrame, shown: Callable[[Column], Column] = lambda held: held) -> DataFrame:
    """Rows with ``_bodies`` that hit at least one, each with ``_heads``: the heads of its bodies, in order, or what ``shown`` makes of them. ``heads``: body, head.

    Heads are put together once for each set of bodies that rows have, and rows of a set get them in the last join: the heads of a row are never moved with it."""
    rows = hits.filter(F.size("_bodies") > 0).withColumn("_bodies", F.array_sort("_bodies"))
    by_body = heads.groupBy("body").agg(F.collect_list("head").alias("_held"))
    sets = rows.select("_bodies").distinct().select("_bodies", F.explode("_bodies").alias("body"))
    held = F.array_sort(F.array_distinct(F.flatten(F.collect_list("_held"))))
    made = sets.join(by_body, "body").groupBy("_bodies").agg(held.alias("_heads")).select("_bodies", shown(c("_heads")).alias("_heads"))
    return rows.join(made, "_bodies").drop("_bodies")


def match_indexed(events: DataFrame, index: Index) -> DataFrame:
    """Add ``rule_matches`` as `rules.match_all` does."""
    spark = events.sparkSession
    shown = lambda r: F.struct(r["rule_id"].alias("rule_id"), r["rule_title"].alias("rule_title"), r["severity"].alias("severity"), r["tactics"].alias("tactics"), r["techniques"].alias("techniques"))
    made = spark.createDataFrame([(n, json.dumps(h)) for n, h in index.heads], "body int, _head string")
    heads = materialize(made.select("body", F.from_json("_head", HEAD).alias("head")), "rule-heads")
    # Written once, as both branches read it.
    out = materialize(match_bodies(events, index), "rule-hits")
    none = out.filter("size(_bodies) = 0").drop("_bodies").withColumn("_heads", F.array().cast(f"array<{HEAD}>"))
    every = none.unionByName(with_heads(out.filter("size(_bodies) > 0"), heads))
    return every.withColumn("rule_matches", F.transform("_heads", shown)).drop("_heads")
