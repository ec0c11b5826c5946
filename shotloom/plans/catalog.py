"""All registered queries over the driver's tables."""

from __future__ import annotations

from shotloom.plans import catalogs, evidences, intake, papers, studies, timelines, workflows

QUERIES = {**timelines.QUERIES, **catalogs.QUERIES, **workflows.QUERIES, **evidences.QUERIES, **studies.QUERIES, **papers.QUERIES, **intake.QUERIES}
ORACLE_SQL = {**timelines.ORACLE_SQL, **catalogs.ORACLE_SQL, **workflows.ORACLE_SQL, **evidences.ORACLE_SQL, **studies.ORACLE_SQL, **papers.ORACLE_SQL, **intake.ORACLE_SQL}
