"""Jobs as a stateful stream: each step's state, begin and duration, kept from trigger to trigger.

A log row says that a step of a job is ``running``, ``succeeded`` or ``failed``. The state of a step is the latest row's by event time, so rows may come late and in any order: what
is kept is the latest row's time and status, when the step first ran and when it last ended. A watermark bounds how long a step that has said nothing more is kept; a running one is then
given up, as ``stalled``. The same rows give the same states in a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.shared import ship

#: States that end a step.
ENDED = ("succeeded", "failed")
_OUT = "state string, began long, seconds double"
_KEPT = "at long, status string, began long, ended long"


def batch_states(logs: DataFrame, job: str, step: str, at: str, status: str) -> DataFrame:
    """(job, step, state, began, seconds) of a whole log. Of rows of one time the status that is greatest as a word counts. ``seconds`` run from the first ``running`` row to the last one that ends the
    step; null before that, or if it never ran. Rows without a time or a status are left out."""
    rows = logs.filter(F.col(at).isNotNull() & F.col(status).isNotNull())
    ended = F.max(F.when(F.col(status).isin(*ENDED), F.col(at)))
    began = F.min(F.when(F.col(status) == "running", F.col(at)))
    last = F.max(F.struct(F.col(at), F.col(status)))[status]
    micros = (F.unix_micros(ended) - F.unix_micros(began)) / 1e6
    return rows.groupBy(job, step).agg(last.alias("state"), began.alias("began"), micros.alias("seconds"))


def job_stream(logs: DataFrame, job: str, step: str, at: str, status: str, late: str = "1 hour", idle: str | None = None) -> DataFrame:
    """The same over a stream, in update mode: a row for each step that a trigger's rows change.

    Without ``idle`` the kept state is Spark's own aggregate, of which nothing is run in Python. ``at`` is a timestamp. Rows later than ``late`` behind the latest may be dropped by the watermark. With ``idle``, a step that is still running when event time has passed its last row by that long is put out as ``stalled`` and forgotten.
    """
    if idle is None:
        return batch_states(logs.withWatermark(at, late), job, step, at, status)
    ship(logs.sparkSession)
    kinds = {c: logs.schema[c].dataType.simpleString() for c in (job, step)}
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def row(key: tuple, kept: tuple, state: str | None = None) -> pd.DataFrame:
        _, now, began, ended = kept
        seconds = (ended - began) / 1e6 if ended is not None and began is not None else None
        return pd.DataFrame({job: [key[0]], step: [key[1]], "state": [state or now], "began": pd.Series([began], dtype="Int64"), "seconds": pd.Series([seconds], dtype="float64")})

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            kept = state.get
            state.remove()
            if kept[1] not in ENDED:
                yield row(key, kept, "stalled")
            return
        at_, now, began, ended = state.get if state.exists else (None, None, None, None)
        for rows in batches:
            for micros, word in zip(rows["__at"].tolist(), rows["__status"].tolist(), strict=True):
                if at_ is None or (micros, word) > (at_, now):
                    at_, now = micros, word
                if word == "running":
                    began = micros if began is None else min(began, micros)
                if word in ENDED:
                    ended = micros if ended is None else max(ended, micros)
        state.update((at_, now, began, ended))
        state.setTimeoutTimestamp(max(at_ // 1000 + wait, state.getCurrentWatermarkMs() + 1))
        yield row(key, (at_, now, began, ended))

    rows = logs.filter(F.col(at).isNotNull() & F.col(status).isNotNull()).withWatermark(at, late)
    rows = rows.select(job, step, at, F.unix_micros(F.col(at)).alias("__at"), F.col(status).alias("__status"))
    states = rows.groupBy(job, step).applyInPandasWithState(run, f"{job} {kinds[job]}, {step} {kinds[step]}, {_OUT}", _KEPT, "update", GroupStateTimeout.EventTimeTimeout)
    return states.withColumn("began", F.timestamp_micros("began"))


def latest_states(states: DataFrame, keys: list[str], where: str) -> DataFrame:
    """Run a stream of states over all there is, and give each key's last one.

    Below ``where`` are the stream's checkpoint and the rows of every trigger, each in a folder that a repeated trigger writes again; so a run that stopped goes on where it was, and a later run takes up new rows.
    """
    columns = [c for c in states.columns if c not in keys]

    def keep(rows: DataFrame, trigger: int) -> None:
        rows.write.mode("overwrite").parquet(f"{where}/states/trigger={trigger}")

    query = states.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = states.sparkSession.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in states.schema)}, trigger long").parquet(f"{where}/states")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), "trigger").alias("last")).select(*keys, "last.*")
