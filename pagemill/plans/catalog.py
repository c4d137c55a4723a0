"""All queries of the library by name, and SQL that gives the same rows."""

from __future__ import annotations

from pagemill.plans import metering, requests, speech, text

QUERIES: dict = {**text.QUERIES, **metering.QUERIES, **speech.QUERIES, **requests.QUERIES}
ORACLE_SQL: dict = {**text.ORACLE_SQL, **metering.ORACLE_SQL, **speech.ORACLE_SQL, **requests.ORACLE_SQL}
