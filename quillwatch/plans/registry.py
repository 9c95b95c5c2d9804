"""Query registry: every entry pairs a Spark job with the SQL that states the same result."""

from __future__ import annotations

import re

from quillwatch.plans.view_sql import VIEWS

RECURSIVE = {"win_open", "norm_win_open"}
QUERIES: dict = {}
SQL: dict = {}


def with_views(sql: str) -> str:
    """Prefix a statement with the common views it mentions."""
    need, todo = [], [sql]
    while todo:
        text = todo.pop()
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text):
                if name in need:
                    need.remove(name)
                    need.insert(0, name)
                else:
                    need.insert(0, name)
                    todo.append(VIEWS[name])
    order = [n for n in VIEWS if n in need]
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS {'' if n in RECURSIVE else 'MATERIALIZED '}(\n{VIEWS[n]}\n)" for n in order)
    body = sql.strip()
    m = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I)
    if m:
        return f"WITH RECURSIVE {ctes},\n{body[m.end():]}"
    return f"WITH RECURSIVE {ctes}\n{body}"


def query(name: str, sql: str | None = None):
    def register(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_views(sql)
        return fn
    return register
