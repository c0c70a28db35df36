"""Query registry."""

from loglattice.plans import commit_views, ledger_views, metric_views, record_views, registry, views  # noqa: F401
