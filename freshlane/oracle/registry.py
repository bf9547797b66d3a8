"""All oracle SQL texts, keyed like ``queries()``."""

from __future__ import annotations

from freshlane.oracle import dashboard_sql, durable_sql, ext_sql, feature_sql, ops_sql, request_sql, views_sql


def all_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for mod in (dashboard_sql, feature_sql, ops_sql, views_sql, ext_sql, durable_sql, request_sql):
        out.update(mod.SQL)
    return out
