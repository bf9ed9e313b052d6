"""The advisor on a stream: keyed state with an entry for each session, one advice for each arriving command."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cmdspark.functions.shipping import ship_package
from cmdspark.operators.advice import DEFAULT_RULES, StateRules, advice_of, effect

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups that sessions are dealt to. A call of the processor costs milliseconds, so it takes many sessions; a group's rows of one batch are in memory together.
BUCKETS = 4096
#: Rows that go back to Spark at a time.
PIECE_ROWS = 10_000

# no leading underscore: such names are lost on the way to pandas
KEY, BUCKET, EFFECTS = "stream_session", "stream_bucket", "stream_effects"


class SessionReplay(StatefulProcessor):
    """Keeps the flags and the last valid command of each session of a bucket; gives each row with both as they were before it.

    Rows come with KEY, which is never null, and with EFFECTS, a character for each flag: 1 sets it, 0 clears it, - leaves it.
    """

    def __init__(self, rules: StateRules, columns: list[str], idle_minutes: int | None):
        self.flags, self.columns, self.idle_minutes = rules.flags, columns, idle_minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        kept = ", ".join([*[f"{f} boolean" for f in self.flags], "prev string"])
        self.sessions = handle.getMapState("sessions", "session string", kept, None if self.idle_minutes is None else self.idle_minutes * 60_000)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        for session, *flags, prev in initialState[[KEY, *self.flags, "prev"]].itertuples(index=False, name=None):
            self.sessions.updateValue((session,), (*[bool(v) for v in flags], None if pd.isna(prev) else prev))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        arrived = pd.concat(list(rows), ignore_index=True).sort_values([KEY, "seq"], na_position="first", ignore_index=True)
        count, keys = len(arrived), arrived[KEY].to_numpy(dtype=object)
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        lengths = np.diff(np.r_[first, count])
        sessions = keys[first].tolist()
        held = [self._held(s) for s in sessions]

        def carry(has: np.ndarray, values: np.ndarray, carried: list) -> tuple[np.ndarray, list]:
            """The last value of those rows that have one, before each row and at the end of each session."""
            carried = np.array(carried, dtype=values.dtype)
            last = np.maximum.accumulate(np.where(has, np.arange(count), -1))
            prior, end = np.r_[-1, last[:-1]], last[first + lengths - 1]
            before = np.where(prior >= np.repeat(first, lengths), values[prior], np.repeat(carried, lengths))
            return before, np.where(end >= first, values[end], carried).tolist()

        out, left = arrived[self.columns].copy(), []
        marks = np.array(arrived[EFFECTS].tolist(), dtype=f"U{len(self.flags)}").view("U1").reshape(count, -1) if self.flags else None
        for i, flag in enumerate(self.flags):
            out[flag], end = carry(marks[:, i] != "-", marks[:, i] == "1", [h[i] for h in held])
            left.append(end)
        command = arrived["command"]
        before, end = carry(arrived["valid"].to_numpy(dtype=bool) & command.notna().to_numpy(), command.to_numpy(dtype=object), [h[-1] for h in held])
        out["prev"] = pd.Series(before, dtype=object)
        for session, was, now in zip(sessions, held, zip(*left, end, strict=True), strict=True):
            # a state that stays the same is written only to put off its end
            if self.idle_minutes is not None or was != now:
                self.sessions.updateValue((session,), now)
        for at in range(0, count, PIECE_ROWS):
            yield out.iloc[at : at + PIECE_ROWS]

    def _held(self, session: str) -> tuple:
        # asking first, as Spark logs a warning for each value that isn't there
        return tuple(self.sessions.getValue((session,))) if self.sessions.containsKey((session,)) else (*[False] * len(self.flags), None)


def _dealt(rows: DataFrame, buckets: int) -> DataFrame:
    """``rows`` with the session as a text that is never null, and its bucket."""
    return rows.withColumn(KEY, F.to_json(F.struct("session_id"))).withColumn(BUCKET, F.pmod(F.xxhash64(KEY), F.lit(buckets)).cast("int"))


def _mark(rules: StateRules, flag: str) -> Column:
    change = effect(rules, flag, F.col("command"), F.col("cmd_line"))
    return F.when(F.col("valid") & change, F.lit("1")).when(F.col("valid") & ~change, F.lit("0")).otherwise(F.lit("-"))


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that typed state needs; a store that the session names itself is left alone."""
    if spark.conf.get(PROVIDER, None) in (None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"):
        spark.conf.set(PROVIDER, ROCKSDB)


def replay_stream(
    log: DataFrame, rules: StateRules = DEFAULT_RULES, idle_minutes: int | None = 24 * 60, initial: DataFrame | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """A2, A4 on a stream: what ``replay`` gives, rows of one batch taken in order of seq.

    State lies in RocksDB, outside Python and the heap, an entry for each session in one of ``buckets`` maps;
    their number must stay the same as long as a checkpoint is used, and a bucket's rows of one batch must fit a task.
    It expires ``idle_minutes`` after a session's last command, or never if that is None; with a limit Spark runs
    batches for as long as the query lives, so a query that should end with its input needs None. ``initial`` has
    sessions to go on with (session_id, flags, prev), as ``final_state`` gives them from a log that was replayed
    before; it counts when a query begins without a checkpoint.
    """
    ship_package(log.sparkSession)
    use_rocksdb(log.sparkSession)
    columns = ["session_id", *[c for c in log.columns if c != "session_id"]]
    rows = log.select(*columns).withColumn("valid", F.coalesce("valid", F.lit(False)))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields], *[f"{f} boolean" for f in rules.flags], "prev string"])
    if initial is not None:
        flags = [F.coalesce(f, F.lit(False)).alias(f) for f in rules.flags]
        initial = _dealt(initial.select(F.col("session_id").cast(log.schema["session_id"].dataType), *flags, "prev"), buckets).drop("session_id").groupBy(BUCKET)
    return _dealt(rows, buckets).withColumn(EFFECTS, F.concat(F.lit(""), *[_mark(rules, f) for f in rules.flags])).groupBy(BUCKET).transformWithStateInPandas(
        SessionReplay(rules, columns, idle_minutes), schema, "append", "None" if idle_minutes is None else "ProcessingTime", initial
    )


def advise_stream(
    log: DataFrame, prob: DataFrame, rules: StateRules = DEFAULT_RULES, idle_minutes: int | None = 24 * 60, initial: DataFrame | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """The advice of ``advise`` for a stream with the same columns.

    The state step gives each command what was before it; the model, a table of any size, is then joined
    to these rows batch by batch, as in the batch form. See ``replay_stream`` for state and restarts.
    """
    return advice_of(replay_stream(log, rules, idle_minutes, initial, buckets), prob, rules)
