"""All queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

from clarispan.plans import boards, checks, costs, coverage, formularies, ingest, network, registers  # noqa: F401  registers their queries
from clarispan.plans.base import QUERIES, SQL  # noqa: F401

FLAGSHIP = "reconcile_verdicts"
