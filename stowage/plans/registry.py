"""Every named query of the core library, and its SQL."""

from __future__ import annotations

from . import problems, problems_sql, reference, sinks  # noqa: F401

PROBLEMS = ("p1_found", "p1_paths", "p1_descendants", "p2_found", "p2_counts", "p4_found", "p4_plan", "p4_packed", "p4_containers", "p4_archive", "p5_found")
QUERIES = {n: getattr(problems, n) for n in PROBLEMS} | reference.QUERIES
SQL = dict(problems_sql.SQL) | reference.SQL
