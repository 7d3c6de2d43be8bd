"""Failed-login lockout over a table of login attempts.

A user's state is the number of failures since the last success and the end of the latest lock. Attempts are cut into
blocks of time, and blocks with a flood of attempts once more. What a block does to any state it could be entered in
is found in all blocks at once: the state enters at the first attempt behind its lock, with one of six counts that
differ in effect, and each of these places leads on to the next attempt that is not rejected; following all of them by
doubling gives where each leaves the block. A fold over a user's blocks then looks up one place in each, and all blocks
are walked at once from the state they are entered in. So one attacked user spreads over many tasks.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linefold.operators.ordering import add_slices, floor_div, hot_cuts, micros

# Lock seconds by number of failures, and counts that give a warning.
LOCK_SECONDS = {3: 300, 5: 600}
WARNING_COUNTS = (2, 4)
LONGEST_LOCK_US = max(LOCK_SECONDS.values()) * 1_000_000
#: Counts from here on have the same effect.
CAP = max(LOCK_SECONDS)
SLACK_US = 1_000_000

#: Width of a block; many times the longest lock, as only attempts that near to its start can be locked from before.
BLOCK_US = 36 * LONGEST_LOCK_US

OUTCOME_SCHEMA = "user STRING, us LONG, seq LONG, outcome STRING, count LONG, locked_until LONG"
EFFECT_SCHEMA = "user STRING, block LONG, slice INT, starts BINARY, reset BINARY, counts BINARY, locks BINARY"
ENTRY_SCHEMA = "user STRING, block LONG, slice INT, count0 LONG, locked0 LONG"


@dataclass
class LoginState:
    """Failures since the last success and the end of the latest lock."""

    count: int = 0
    locked_until: int = 0

    def attempt(self, us: int, ok: bool) -> str:
        """Outcome of one attempt; the last second of a lock no longer rejects."""
        if self.locked_until - us >= 1_000_000:
            return "rejected"
        if ok:
            self.count = 0
            return "success"
        self.count += 1
        for threshold, seconds in LOCK_SECONDS.items():
            if self.count >= threshold:
                self.locked_until = us + seconds * 1_000_000
        return "warning" if self.count in WARNING_COUNTS else "failure"


class Effect:
    """What a block of attempts does to a state, for every attempt and count it can be entered with.

    Entered at attempt k with count c, it leaves with ``counts[c, k]`` failures, added to c unless a success on the way
    has ``reset`` them, and with the lock end ``locks[c, k]``, or its own where that is 0.
    """

    def __init__(self, us: np.ndarray, ok: np.ndarray):
        n = len(us)
        # Place (c, k) is c * (n + 1) + k; attempt n is behind the block.
        counts, at = np.divmod(np.arange((CAP + 1) * (n + 1)), n + 1)
        inside = at < n
        failed = inside & ~np.append(ok, False)[at]
        after = np.minimum(counts + 1, CAP)
        lock = np.zeros(len(at), dtype=np.int64)
        for threshold, seconds in LOCK_SECONDS.items():
            hit = failed & (after >= threshold)
            lock[hit] = us[at[hit]] + seconds * 1_000_000
        follows = np.where(inside, at + 1, n)
        held = np.flatnonzero(lock)
        follows[held] = np.maximum(follows[held], np.searchsorted(us, lock[held] - SLACK_US, side="right"))
        goes = np.where(inside, np.where(failed, after, 0), counts) * (n + 1) + follows
        reset, added = inside & ~failed, failed.astype(np.int64)
        while True:
            further = goes[goes]
            if (further == goes).all():
                break
            # The second half of the way decides, where it has something to say.
            added = np.where(reset[goes], added[goes], added + added[goes])
            lock = np.where(lock[goes] > 0, lock[goes], lock)
            reset = reset | reset[goes]
            goes = further
        shape = (CAP + 1, n + 1)
        self.us, self.reset, self.counts, self.locks = us, reset.reshape(shape), added.reshape(shape), lock.reshape(shape)

    def cut(self) -> tuple[bytes, ...]:
        """The part that a state can be entered at: attempts that a lock from before the block can reach, and the next."""
        n = int(np.searchsorted(self.us, self.us[0] + LONGEST_LOCK_US, side="right"))
        part = (self.us[:n], *(x[:, : n + 1] for x in (self.reset, self.counts, self.locks)))
        return tuple(np.ascontiguousarray(x).tobytes() for x in part)


def entered(starts: np.ndarray, reset: np.ndarray, counts: np.ndarray, locks: np.ndarray, state: LoginState) -> LoginState:
    """The state behind a block, by one look into its effect."""
    k = int(np.searchsorted(starts, state.locked_until - SLACK_US, side="right"))
    c = min(state.count, CAP)
    count = int(counts[c, k]) + (0 if reset[c, k] else state.count)
    return LoginState(count, int(locks[c, k]) or state.locked_until)


def _effects(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["us", "seq"])
    key = [frame[c].iloc[0] for c in ("user", "block", "slice")]
    effect = Effect(frame.us.to_numpy(), frame.ok.to_numpy().astype(bool))
    return pd.DataFrame([(*key, *effect.cut())], columns=["user", "block", "slice", "starts", "reset", "counts", "locks"])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entry states of the blocks of each user, which come in order; one block is held at a time."""

    def states() -> Iterator[tuple]:
        user, state = None, LoginState()
        for batch in batches:
            for row in zip(*[c for c in batch.columns]):
                own, block, slice_ = (v.as_py() for v in row[:3])
                if own != user:
                    user, state = own, LoginState()
                yield own, block, slice_, state.count, state.locked_until
                starts = np.frombuffer(row[3].as_buffer(), dtype=np.int64)
                shape = (CAP + 1, -1)
                reset = np.frombuffer(row[4].as_buffer(), dtype=bool).reshape(shape)
                counts, locks = (np.frombuffer(v.as_buffer(), dtype=np.int64).reshape(shape) for v in row[5:])
                state = entered(starts, reset, counts, locks, state)

    made = states()
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    names = [f.split()[0] for f in ENTRY_SCHEMA.split(", ")]
    while some := list(itertools.islice(made, 4096)):
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*some), kinds)], names=names)


def walk(us: np.ndarray, ok: np.ndarray, state: LoginState) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Outcomes, counts and lock ends of attempts in order; ``state`` moves on. Runs of rejected attempts are passed at once."""
    n = len(us)
    outcomes = np.full(n, "rejected", dtype=object)
    counts, locks = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    k = 0
    while k < n:
        free = int(np.searchsorted(us, state.locked_until - SLACK_US, side="right"))
        if free > k:
            counts[k:free], locks[k:free] = state.count, state.locked_until
            k = free
            continue
        outcomes[k] = state.attempt(int(us[k]), bool(ok[k]))
        counts[k], locks[k] = state.count, state.locked_until
        k += 1
    return outcomes, counts, locks


def outcome_frame(user: pd.Series | str, us: np.ndarray, seq: pd.Series | np.ndarray, walked: tuple) -> pd.DataFrame:
    """Rows of ``OUTCOME_SCHEMA``; a lock shows while it lasts."""
    outcomes, counts, locks = walked
    shown = pd.array(locks, dtype="Int64")
    shown[locks <= us] = pd.NA
    return pd.DataFrame({"user": user, "us": us, "seq": seq, "outcome": outcomes, "count": counts, "locked_until": shown})


def _walk(frame: pd.DataFrame) -> pd.DataFrame:
    """Outcomes of one block from the state it is entered in."""
    frame = frame.sort_values(["us", "seq"])
    us, ok = frame.us.to_numpy(), frame.ok.to_numpy().astype(bool)
    state = LoginState(int(frame.count0.iloc[0]), int(frame.locked0.iloc[0]))
    return outcome_frame(frame.user, us, frame.seq, walk(us, ok, state))


def lockout(login_events: DataFrame, known_users: DataFrame | None = None) -> DataFrame:
    """``user, us, seq, outcome, count, locked_until`` for every attempt.

    ``login_events`` has ``user, ts, seq, ok``; a null ``ok`` is a failure. Outcomes: success,
    failure, warning, rejected, and unknown for users not in ``known_users``. Attempts
    without a user or a time have no outcome and are left out.
    """
    attempts = login_events.select(
        "user",
        micros(F.col("ts")).alias("us"),
        F.col("seq").cast("bigint").alias("seq"),
        F.coalesce("ok", F.lit(False)).alias("ok"),
    ).where("user is not null and us is not null")
    unknown = None
    if known_users is not None:
        unknown = attempts.join(known_users, "user", "left_anti").select(
            "user",
            "us",
            "seq",
            F.lit("unknown").alias("outcome"),
            F.lit(0).cast("bigint").alias("count"),
            F.lit(None).cast("bigint").alias("locked_until"),
        )
        attempts = attempts.join(known_users, "user", "left_semi")
    timed = attempts.withColumn("ts", F.timestamp_micros("us"))
    cuts = hot_cuts(timed, "user", "ts", "seq", width=BLOCK_US)
    placed = add_slices(attempts.withColumn("_part", floor_div(F.col("us"), BLOCK_US)), cuts, "user", F.col("us"), "seq")
    placed = placed.select("user", F.col("_part").alias("block"), F.col("_slice").alias("slice"), "us", "seq", "ok")
    keys = ["user", "block", "slice"]
    effects = placed.groupBy(*keys).applyInPandas(_effects, EFFECT_SCHEMA)
    entries = effects.repartition("user").sortWithinPartitions(*keys).mapInArrow(_fold, ENTRY_SCHEMA)
    walked = placed.join(entries, keys).groupBy(*keys).applyInPandas(_walk, OUTCOME_SCHEMA)
    return walked if unknown is None else walked.unionByName(unknown)
