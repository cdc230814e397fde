"""Running source health over a stream of attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from newsloom.operators.health import source_success_rate


def running_success_rate(attempts: DataFrame) -> DataFrame:
    """`source_success_rate` of everything seen so far; write it in update or complete mode."""
    return source_success_rate(attempts)
