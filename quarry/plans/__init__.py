"""Named queries of the library, with DuckDB SQL for each that SQL can express.

A query's name starts with the identifier of the operator it applies.
"""

from __future__ import annotations

from . import aggregates, evaluation, joins, learned, projections, readers, sampling, scans, structures, text, windows  # noqa: F401
from .base import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "corpus_audit"
