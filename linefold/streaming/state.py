"""Stateful operators for live streams, one small state per key."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from linefold.operators.lockout import LoginState, outcome_frame, walk
from linefold.operators.ordering import micros

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

LOGIN_SCHEMA = "user STRING, us LONG, seq LONG, outcome STRING, count LONG, locked_until LONG"


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)


#: Rows of a frame that goes out; attempts of a trigger are held as numbers alone.
FRAME_ROWS = 16_384


def _attempts(frames: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Time, number and success of the attempts of one user in order; frames of one trigger come in any order."""
    held = [(f["us"].astype("int64").to_numpy(), f["seq"].astype("int64").to_numpy(), f["ok"].to_numpy(dtype=bool)) for f in frames]
    us, seq, ok = (np.concatenate(parts) for parts in zip(*held))
    del held
    order = np.lexsort((seq, us))
    return us[order], seq[order], ok[order]


class LoginWatch(StatefulProcessor):
    """Failure count and lock of one user."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("login", "count LONG, locked_until LONG")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        login = LoginState(*(self.state.get() if self.state.exists() else (0, 0)))
        us, seq, ok = _attempts(rows)
        for start in range(0, len(us), FRAME_ROWS):
            part = slice(start, start + FRAME_ROWS)
            yield outcome_frame(key[0], us[part], seq[part], walk(us[part], ok[part], login))
        self.state.update((login.count, login.locked_until))

    def close(self) -> None:
        pass


def live_lockout(login_events: DataFrame) -> DataFrame:
    """Outcomes of a stream of ``user, ts, seq, ok``."""
    use_state_store(login_events.sparkSession)
    attempts = login_events.select("user", micros(F.col("ts")).alias("us"), "seq", F.coalesce("ok", F.lit(False)).alias("ok"))
    return attempts.groupBy("user").transformWithStateInPandas(
        LoginWatch(), LOGIN_SCHEMA, "append", "None"
    )
