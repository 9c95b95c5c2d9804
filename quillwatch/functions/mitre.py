"""ATT&CK tags: technique ids and tactic names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillwatch.functions.scalars import c

# Tactic slugs whose display name is not plain title case.
TACTIC_NAMES = {"command_and_control": "Command and Control"}


def tactic_name(slug: str) -> str:
    """Driver-side display name: words capitalised, joined by spaces."""
    low = slug.lower()
    return TACTIC_NAMES.get(low) or " ".join(w[:1].upper() + w[1:] for w in low.split("_"))


def tactic_display(slug: Column) -> Column:
    words = F.transform(F.split(slug, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w))))
    named = F.lit(None).cast("string")
    for k, name in TACTIC_NAMES.items():
        named = F.coalesce(named, F.when(slug == k, name))
    return F.coalesce(named, F.array_join(words, " "))


def parse_tag(tag) -> Column:
    """Struct (tactic, technique_id, sub_technique_id); NULL for tags outside the scheme."""
    low = F.lower(c(tag))
    rest = low.substr(F.lit(8), F.length(low))
    digits = rest.substr(F.lit(2), F.length(rest))
    is_technique = rest.rlike(r"^t[0-9]")
    sub = F.when(digits.contains("."), F.substring(digits, F.locate(".", digits) + 1, F.length(digits)))
    none = F.lit(None).cast("string")
    return F.when(low.startswith("attack."), F.struct(
        F.when(~is_technique, tactic_display(rest)).otherwise(none).alias("tactic"),
        F.when(is_technique, F.concat(F.lit("T"), F.split_part(digits, F.lit("."), F.lit(1)))).alias("technique_id"),
        F.when(is_technique, sub).alias("sub_technique_id")))


def parse_tags(tags) -> Column:
    return F.array_compact(F.transform(c(tags), parse_tag))
