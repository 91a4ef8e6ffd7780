"""Scalar rules: backoff, ranks, retries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.vocab import RETRYABLE_STATUSES

# Fixed values of delivery, in seconds and attempts.
BACKOFF_BASE, BACKOFF_CAP, MOST_ATTEMPTS = 30, 6 * 3600, 8


def backoff_seconds(attempts: Column, base: int = BACKOFF_BASE, cap: int = BACKOFF_CAP) -> Column:
    """base, doubled for each attempt after the first, at most cap."""
    return F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2), F.greatest(F.lit(0), attempts - 1))).cast("bigint")


def retryable(status: Column) -> Column:
    return status.isin(*RETRYABLE_STATUSES) | (status >= 500)


def scope_rank(status: Column, session: Column, project: Column, workspace: Column, asked: Column) -> Column:
    """4 for a session's own node of the asked session, 3 for a project, 2 for a workspace, else 1; a session on any other node doesn't count."""
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when((status == "active_session") & session.eqNullSafe(asked), 4).when(filled(project), 3).when(filled(workspace), 2).otherwise(1)
