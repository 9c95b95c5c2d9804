"""Rule files: a directory scan, and one catalogue row per rule document."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwatch.functions.scalars import c


def rule_files(spark: SparkSession, path: str, glob: str = "*.y*ml", changed_since: str | None = None) -> DataFrame:
    """Path, modification time, size and content of every rule file below ``path``."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return df if changed_since is None else df.filter(c("modificationTime") > F.lit(changed_since).cast("timestamp"))


def documents(df: DataFrame, text, *keys) -> DataFrame:
    """Multi-document texts to one row per non-empty document."""
    docs = F.posexplode(F.split(text, "\n---\n"))
    return df.select(*keys, docs.alias("idx", "doc")).withColumn("doc", F.regexp_replace("doc", r"^\s+|\s+$", "")).filter(c("doc") != "")


CATALOG_SCHEMA = "title string, rule_id string, status string, level string, tags array<string>, n_falsepositives int, detection string, logsource string, error string"
_FIELDS = [f.split()[0] for f in CATALOG_SCHEMA.split(", ")]


def catalog(docs: DataFrame, *keys) -> DataFrame:
    """One row per document with its fields as written; ``error`` names what could not be read."""
    key_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in keys)
    fields = _FIELDS

    # The helpers are local so that they travel with the job: executors need no copy of this package.
    def entry(text: str):
        """Fields of one rule document, or the reason it cannot be read."""
        try:
            try:
                import yaml
                # The C parser, where the library has it, reads the same documents about ten times as fast.
                doc = yaml.load(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
            except ImportError:
                doc = json.loads(text)
            if not isinstance(doc, dict):
                raise ValueError("not a mapping")
            texts = [doc.get(k) if isinstance(doc.get(k), str) else None for k in ("title", "id", "status", "level")]
            parts = [json.dumps(doc[k]) if isinstance(doc.get(k), dict) else None for k in ("detection", "logsource")]
            return (*texts, [str(t) for t in doc.get("tags") or []], len(doc.get("falsepositives") or []), *parts, None)
        except Exception as problem:  # a bad file is kept with its error, it never stops the load
            return (None, None, None, None, [], 0, None, None, str(problem).splitlines()[0])

    def read(batches):
        for batch in batches:
            cells = pd.DataFrame([entry(t) for t in batch["doc"]], columns=fields)
            yield pd.concat([batch[list(keys)].reset_index(drop=True), cells], axis=1)

    return docs.select(*keys, "doc").mapInPandas(read, f"{key_schema}, {CATALOG_SCHEMA}")


def with_rule_defaults(cat: DataFrame, seed) -> DataFrame:
    """Catalogue defaults: generated id, experimental, info."""
    known = ["stable", "test", "deprecated", "unsupported"]
    return cat.withColumns({
        "rule_id": F.coalesce("rule_id", F.md5(seed)), "status": F.when(c("status").isin(known), c("status")).otherwise("experimental"),
        "level": F.when(c("level").isin("critical", "high", "medium", "low"), c("level")).otherwise("info")})


def with_import_defaults(cat: DataFrame) -> DataFrame:
    """Import defaults: a name and the middle level."""
    return cat.withColumns({"title": F.coalesce("title", F.lit("Unnamed Rule")), "level": F.coalesce("level", F.lit("medium"))})


def loaded(cat: DataFrame) -> tuple[list[dict], list[tuple[str, str]]]:
    """Rules of a catalogue that can be tried, and (id, reason) of the others. Rules are configuration: the driver holds them, never events."""
    good, bad = [], []
    for r in cat.select("rule_id", "title", "status", "level", "tags", "detection", "logsource", "error").collect():
        if r["error"] is not None or r["detection"] is None:
            bad.append((r["rule_id"], r["error"] or "no detection"))
        else:
            good.append({"id": r["rule_id"], "title": r["title"], "status": r["status"], "level": r["level"], "tags": r["tags"], "detection": json.loads(r["detection"]),
                         "logsource": json.loads(r["logsource"] or "{}")})
    return good, bad
