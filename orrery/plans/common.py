"""Literal parameters that queries and their oracle SQL share."""

from __future__ import annotations

#: Cohort windows over the test tables' order dates.
WINDOWS = (("development", "1995-01-01", "1997-12-31"), ("transition", "1998-01-01", "1999-06-30"), ("primary_test", "2000-01-01", "2000-12-31"), ("prospective", "2001-01-01", "2001-12-31"))
SUPPORT = ("support", "1999-07-01", "1999-12-31")


def label_sql(day: str) -> str:
    cases = " ".join(f"WHEN {day} BETWEEN DATE '{a}' AND DATE '{b}' THEN '{n}'" for n, a, b in (*WINDOWS, SUPPORT))
    return f"CASE WHEN {day} IS NULL THEN 'unresolved' {cases} ELSE 'out_of_scope' END"


def mapped_sql(label: str) -> str:
    return f"({label} IS NOT NULL AND {label} <> 'out_of_scope')"
