"""All queries of the core and their SQL."""

from __future__ import annotations

from tidemark.queries import intake, model, pipeline, quality, sql

QUERIES = {**quality.QUERIES, **pipeline.QUERIES, **model.QUERIES, **intake.QUERIES}
ORACLE: dict[str, str] = {**sql.ORACLE, **model.ORACLE, **intake.ORACLE}
FLAGSHIP = pipeline.b02_panel
