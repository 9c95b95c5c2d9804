"""Secret scan with corpus-wide ownership frequency, in DataFrame operations only.

Every whole text is searched for the base kinds (assign, access, hex; fixed patterns below). The method adds spans of kind
`token`: runs of 20 or more token characters that mix letters and digits, with at least `distinct_chars` different ones, outside all base spans.
A hash of every candidate is counted over the corpus by distinct owner and distinct repository. A value seen with more than `max_owners` owners
or `max_repos` repositories is a copied example; any other is live-looking. Base spans stay either way and carry the verdict; a token span
stays only while it is live-looking.

Counting: candidates are reduced to distinct (value, owner, repository) before the shuffle, so one value copied through a third
of the corpus costs one row a task; values that are copied are joined back on the value, where adaptive execution splits a hot one.

Defined cases: a null text is empty and has no spans; a null owner or repository is one owner; repeated rows are kept, each with its spans,
and count once; rows are told apart by id and text, so one doc_id may stand on several texts; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwatch.llm.training import parted, unused
from quillwatch.sources.shared import materialize

# The base patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ["assign", "access", "hex", "token"]
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _spans(text: Column, found: Column, pattern: str, kind: int) -> Column:
    """Places of the matches `found` of `pattern`: lengths of the texts between them and of the matches, added up."""
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast(SPAN).alias("out"))
    step = lambda acc, x: F.struct(
        (acc["at"] + F.length(x["gap"]) + F.length(x["m"])).alias("at"),
        F.concat(F.coalesce(acc["out"], F.array().cast(SPAN)), F.array(F.struct(
            (acc["at"] + F.length(x["gap"])).alias("start"), F.lit(kind).alias("kind"),
            (acc["at"] + F.length(x["gap"]) + F.length(x["m"])).alias("end"), x["m"].alias("value")))).alias("out"))
    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("m"))
    return F.when(F.size(found) > 0, F.aggregate(pairs, start, step)["out"]).otherwise(F.array().cast(SPAN))


def scan(docs: DataFrame, owner: Column, repo: Column, distinct_chars: int = 10) -> DataFrame:
    """doc_id, text_key, owner, repo, base (spans), tokens (candidate spans outside the base spans)."""
    text = F.coalesce("text", F.lit(""))
    every = lambda p: F.regexp_extract_all(F.col("text"), F.lit(p), F.lit(0))
    found = (docs.select("doc_id", text.alias("text"), owner.alias("owner"), repo.alias("repo"))
             .select("*", every(ASSIGN).alias("m0"), every(ACCESS).alias("m1"), every(HEX).alias("m2"), every(TOKEN).alias("m3")))
    placed = found.select("doc_id", F.xxhash64("text").alias("text_key"), "owner", "repo",
                          *[_spans(F.col("text"), F.col(f"m{k}"), p, k).alias(f"s{k}") for k, p in enumerate((ASSIGN, ACCESS, HEX, TOKEN))])
    assign = F.filter("s0", lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 1)) >= 6)
    mixed = lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(s["value"], ""))) >= distinct_chars)
    based = placed.select("doc_id", "text_key", "owner", "repo", F.array_sort(F.concat(assign, "s1", "s2")).alias("base"), F.filter("s3", mixed).alias("tokens"))
    apart = F.filter("tokens", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return based.withColumn("tokens", apart)


def _key(span: Column) -> Column:
    """Hash of a candidate: of an assignment its right side, else the match."""
    value = F.when(span["kind"] == 0, F.regexp_extract(span["value"], ASSIGN, 1)).otherwise(span["value"])
    return F.xxhash64(value)


def ownership(scanned: DataFrame) -> DataFrame:
    """key, owners, repos: distinct owners and repositories of every candidate value."""
    rows = scanned.select("owner", "repo", F.explode(F.concat("base", "tokens")).alias("s")).select(_key(F.col("s")).alias("key"), "owner", "repo")
    return (rows.distinct().groupBy("key", "owner").agg(F.count(F.lit(1)).alias("repos"))
            .groupBy("key").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos")))


def find(docs: DataFrame, owner: Column, repo: Column, max_owners: int = 1, max_repos: int = 2) -> DataFrame:
    """doc_id, text_key and spans: array of (start, kind, end, value, live), by start and then kind. One row per row of docs."""
    scanned = materialize(scan(docs, owner, repo), "secret-scan")
    copied = ownership(scanned).where((F.col("owners") > max_owners) | (F.col("repos") > max_repos)).select("key", F.lit(False).alias("live"))
    with_spans = scanned.where((F.size("base") > 0) | (F.size("tokens") > 0)).dropDuplicates(["doc_id", "text_key"])
    spans = (with_spans.select("doc_id", "text_key", F.explode(F.concat("base", "tokens")).alias("s")).withColumn("key", _key(F.col("s")))
             .join(copied, "key", "left").withColumn("live", F.coalesce("live", F.lit(True)))
             .where(F.col("live") | (F.col("s.kind") < 3))
             .groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("s.start", "s.kind", "s.end", "s.value", "live"))).alias("spans")))
    rows = scanned.select("doc_id", "text_key").alias("a")
    same = F.expr("a.doc_id <=> b.doc_id AND a.text_key = b.text_key")
    return rows.join(spans.alias("b"), same, "left").select("a.doc_id", "a.text_key", F.coalesce("b.spans", F.array()).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, owner: Column, repo: Column, mark: str = "[SECRET]") -> DataFrame:
    """docs with every reported span replaced; overlapping spans become one mark. n_chars, if present, is counted anew where a text changed."""
    spans = materialize(find(docs, owner, repo).where(F.size("spans") > 0).dropDuplicates(["doc_id", "text_key"]), "secret-spans")
    some, none = parted(docs, spans.select("doc_id"), "doc_id", 1 << 25)  # texts without a span are not moved
    text = F.coalesce("a.text", F.lit(""))
    joined = some.alias("a").join(spans.alias("b"), F.expr("a.doc_id <=> b.doc_id") & (F.xxhash64(text) == F.col("b.text_key")), "left")
    step = lambda acc, s: F.struct(
        F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).alias("out"),
        F.greatest(acc["at"], s["end"]).alias("at"))
    cut = F.aggregate("b.spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))))
    changed = F.col("b.spans").isNotNull()
    name, = unused(docs, "_cut")
    made = joined.withColumn(name, F.when(changed, cut))
    out = {"text": F.coalesce(name, "a.text"), "n_chars": F.when(changed, F.length(name).cast("long")).otherwise(F.col("a.n_chars")) if "n_chars" in docs.columns else None}
    return made.select(*[out[c].alias(c) if out.get(c) is not None else F.col(f"a.`{c}`") for c in docs.columns]).unionByName(none)
