"""All registered queries of the event pipeline and their SQL."""

from __future__ import annotations

from . import ingest, planning, reconciling

PLANS = [ingest, reconciling, planning]


def entry(spark, sf_dir):
    return ingest.validate_verdicts(spark, sf_dir)


def queries():
    return {k: f for p in PLANS for k, f in p.QUERIES.items()}


def oracle_sql():
    return {k: f for p in PLANS for k, f in p.SQL.items()}
