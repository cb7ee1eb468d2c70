"""All registered queries."""

from __future__ import annotations

from vigil.plans import check_parts  # noqa: F401  (defines the shared SQL)
from vigil.plans import queries_journal  # noqa: F401
from vigil.plans import queries_panel  # noqa: F401
from vigil.plans import queries_splits  # noqa: F401
from vigil.plans import queries_scores  # noqa: F401
from vigil.plans import queries_risk  # noqa: F401
from vigil.plans import queries_faults  # noqa: F401
from vigil.plans import queries_stream  # noqa: F401
from vigil.plans.registry import QUERIES, Query, oracle


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracle()
