"""Queries over the given tables, each beside the SQL that must give the same rows."""

from __future__ import annotations


def all_cases():
    from . import companies, hot, live, market, sentiment, signals, stored, trading

    modules = [market, sentiment, companies, signals, trading, live, hot, stored]
    return [c for m in modules for c in m.CASES]
