"""Failed-login lockout per user."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowwatch.operators.folds import BLOCK_ROWS, KEEP, Machine, fold_commands, fold_onward
from flowwatch.session import Scratch

LOCK_AFTER = 5
LOCK_MINUTES = 15.0


def lockout_machine(lock_after: int = LOCK_AFTER, lock_seconds: int = int(LOCK_MINUTES * 60)) -> Machine:
    """States 0 .. lock_after-1 are failures in a row, ``lock_after`` is locked."""

    def step(state: int, ok: int, _arg: int) -> tuple[int, str, int]:
        if state == lock_after:
            return state, "locked", KEEP
        if ok:
            return 0, "ok", 0
        if state + 1 >= lock_after:
            return lock_after, "invalid", lock_seconds
        return state + 1, "invalid", KEEP

    return Machine(step=step, entries=tuple(range(lock_after + 1)), timed=lock_after, after=0)


def login_verdicts(
    logins: DataFrame,
    lock_after: int = LOCK_AFTER,
    lock_minutes: float = LOCK_MINUTES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Login attempts ``(username, seq, ts, ok)`` with a verdict: ok, invalid or locked.

    The ``lock_after``-th failure in a row locks the user and resets the count. Attempts
    while locked are refused and not counted; success clears the count. Lock times are in
    whole seconds.
    """
    machine = lockout_machine(lock_after, int(lock_minutes * 60))
    return _verdicts(fold_commands(_attempts(logins), machine, block_rows), lock_after)


def lockout_onward(
    logins: DataFrame, carried: DataFrame, scratch: Scratch, lock_after: int = LOCK_AFTER, lock_minutes: float = LOCK_MINUTES
) -> tuple[DataFrame, DataFrame]:
    """The verdicts from the states (key, state, until) that earlier attempts have left, and those that are left now.

    A state is the number of failures in a row, or ``lock_after`` with the end of the lock. This runs jobs; both results read tables in ``scratch``.
    """
    machine = lockout_machine(lock_after, int(lock_minutes * 60))
    folded, left = fold_onward(_attempts(logins), carried, machine, scratch)
    return _verdicts(folded, lock_after), left


def _attempts(logins: DataFrame) -> DataFrame:
    return logins.select(
        F.col("username").alias("key"),
        F.unix_seconds("ts").alias("tick"),
        "seq",
        F.col("ok").cast("int").alias("op"),
        F.lit(0).cast("bigint").alias("arg"),
    )


def _verdicts(folded: DataFrame, lock_after: int) -> DataFrame:
    return folded.select(
        F.col("key").alias("username"),
        "seq",
        F.timestamp_seconds("tick").alias("ts"),
        (F.col("op") == 1).alias("ok"),
        F.when(F.col("state_before") == lock_after, F.lit(0)).otherwise(F.col("state_before")).alias("failures_before"),
        "verdict",
    )


def lockout_states(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("username").agg(
        F.count("*").alias("attempts"),
        F.count_if(F.col("verdict") == "ok").alias("accepted"),
        F.count_if(F.col("verdict") == "invalid").alias("failed"),
        F.count_if(F.col("verdict") == "locked").alias("refused"),
    )
