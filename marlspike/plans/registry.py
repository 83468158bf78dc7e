"""All queries of the core and their SQL counterparts."""

from __future__ import annotations

from marlspike.plans import core, found, related  # noqa: F401  (related registers its queries with core)

QUERIES = core.QUERIES | {"p1_found": found.p1_found, "p4_found": found.p4_found, "p4_tables": found.p4_tables, "p5_found": found.p5_found, "p5_table": found.p5_table}
ORACLE = core.ORACLE | {"p1_found": found.P1_SQL, "p4_found": found.P4_SQL, "p4_tables": found.P4_TABLES_SQL, "p5_found": found.P5_SQL, "p5_table": found.P5_TABLE_SQL}
