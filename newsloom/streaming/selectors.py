"""Running selector scores with keyed state."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from newsloom.operators.selectors import ALPHA, FIRST_FAILURE, FIRST_SUCCESS, KEY

cloudpickle.register_pickle_by_value(sys.modules[__name__])

OUTPUT = """source_id BIGINT, selector_type STRING, selector STRING, target_element STRING,
            success_count BIGINT, fail_count BIGINT, score DOUBLE"""
STATE = "success_count BIGINT, fail_count BIGINT, score DOUBLE"


class _Score(StatefulProcessor):
    """Folds the trials of one selector into its counts and score, in time order per batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("score", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        good, bad, score = self.state.get() if self.state.exists() else (0, 0, None)
        # one key's trials of one batch, as times and flags
        batch = pd.concat([r[["ts", "success"]] for r in rows]).sort_values(
            ["ts", "success"], ascending=[True, False]
        )
        for ok in batch["success"]:
            good, bad = good + bool(ok), bad + (not ok)
            if score is None:
                score = FIRST_SUCCESS if ok else FIRST_FAILURE
            else:
                score = ALPHA * good / (good + bad) + (1 - ALPHA) * score
        self.state.update((good, bad, score))
        yield pd.DataFrame([(*key, good, bad, score)], columns=[*KEY, "success_count", "fail_count", "score"])

    def close(self) -> None:
        pass


def running_selector_scores(trials: DataFrame) -> DataFrame:
    """Current score of every selector with a new trial. Needs the RocksDB state store;
    limit the files or offsets per trigger so that a batch of one key fits in a task."""
    return trials.groupBy(*KEY).transformWithStateInPandas(
        statefulProcessor=_Score(), outputStructType=OUTPUT, outputMode="Update", timeMode="None"
    )
