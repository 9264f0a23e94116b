"""States and times of job runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FINISHED = ("success", "failed", "cancelled")


def run_status(life_cycle: Column, result: Column) -> Column:
    """(life-cycle state, result state) -> pending, running, success, failed or cancelled.

    A state nobody knows stays `running`; only an explicit SUCCESS is a success.
    """
    ended = (
        F.when(result == "SUCCESS", "success")
        .when(result.isin("CANCELED", "EXCLUDED", "DISABLED"), "cancelled")
        .otherwise("failed")
    )
    return (
        F.when(life_cycle.isin("PENDING", "QUEUED", "BLOCKED", "WAITING_FOR_RETRY"), "pending")
        .when(life_cycle == "SKIPPED", "cancelled")
        .when(life_cycle == "INTERNAL_ERROR", "failed")
        .when(life_cycle == "TERMINATED", ended)
        .otherwise("running")
    )


def time_of_millis(millis: Column) -> Column:
    """Epoch milliseconds as an instant; 0 means unknown."""
    return F.when(millis != 0, F.timestamp_millis(millis))
