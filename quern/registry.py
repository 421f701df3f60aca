"""All queries of the core operators and the DuckDB text that checks each."""

from __future__ import annotations

from quern.plans import catalogue, detection, evidence, journals, library, likenesses, questions, retrieval, signals, sources, sweeps, texts

PLANS = [retrieval.plan, signals.plan, detection.plan, evidence.plan, texts.plan, journals.plan, library.plan, catalogue.plan, questions.plan, sweeps.plan, likenesses.plan, sources.plan]

QUERIES = {name: query for plan in PLANS for name, query in plan.queries.items()}
ORACLE_SQL = {name: sql for plan in PLANS for name, sql in plan.oracles.items()}
