"""The operators applied to the star-schema test tables, with equivalent SQL.

Each module holds ``QUERIES`` (name -> function of session and folder) and
``ORACLES`` (name -> SQL over the same tables giving the same rows).
"""

from __future__ import annotations

from scorewright.workload import cleaning, models, profiling, relational, reports, sqlqueries, stats, storage

_MODULES = (storage, profiling, cleaning, relational, stats, models, reports, sqlqueries)

QUERIES = {name: fn for module in _MODULES for name, fn in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
