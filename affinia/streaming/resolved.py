"""Watch events and their identities as two streams that meet, and outcomes of work as keyed state.

`resolved` keeps nothing but Spark's own state: an event waits in the join's state until its item is known, for
ever, and an event that was seen before is known by its key. No batch reads what earlier ones wrote, and a
restart goes on from the checkpoint. `cursor` is where a source that must be asked for events has to
start again: at the oldest event that still waits, else at the newest.

`outcomes` folds the attempts on a file into its state: one small row a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A key's events are dealt to so many shares of the state.
SHARES = 16

DONE, FAILED, EXCLUDED, UNREACHABLE = "done", "failed", "excluded", "unreachable"
#: Seconds before the next try: the first wait doubles up to the last.
WAIT, LONGEST = 3600, 86400


def resolved(events: DataFrame, identities: DataFrame, shares: int = SHARES) -> DataFrame:
    """events once each (by history_key) with item_id, as soon as their rating_key is known; both may be streams.

    Events lacking a key, a rating key, a time or an account are no events. Of several identities of a rating key
    the first to come counts. A hot rating key's events are spread over shares; each identity goes to all of them.
    """
    whole = events.dropna(subset=["history_key", "rating_key", "viewed_at", "account_id"])
    seen = whole.dropDuplicates(["history_key"]).withColumn("__share", F.pmod(F.xxhash64("history_key"), F.lit(shares)))
    known = identities.dropna(subset=["rating_key", "item_id"]).dropDuplicates(["rating_key"]).select("rating_key", "item_id")
    known = known.withColumn("__share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)).cast("array<bigint>")))
    return seen.join(known, ["rating_key", "__share"]).drop("__share")


def written(stream: DataFrame, to: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream to a folder, with all that is there by now; each row once, whatever restarts."""
    return stream.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def cursor(events: DataFrame, plays: DataFrame) -> DataFrame:
    """since, waiting: the time to ask from, and how many events still wait for their item. One row."""
    whole = events.dropna(subset=["history_key", "rating_key", "viewed_at", "account_id"]).dropDuplicates(["history_key"])
    open_ = whole.join(plays.select("history_key", F.lit(True).alias("__known")), "history_key", "left")
    waits = F.col("__known").isNull()
    return open_.agg(F.coalesce(F.min(F.when(waits, F.col("viewed_at"))), F.max("viewed_at")).alias("since"), F.count_if(waits).alias("waiting"))


def backoff(attempts: int) -> int:
    return min(WAIT << min(max(attempts, 1) - 1, 16), LONGEST)


def folded(state: tuple | None, size: int, at: int, result: str) -> tuple[tuple, bool]:
    """(size, outcome, attempts, next_at) after an attempt, and whether it was due: what is settled, or waits, takes none.

    A file of another size starts anew. An unreachable one is tried again when its wait is over.
    """
    if state is not None and state[0] == size:
        if state[1] in (DONE, FAILED, EXCLUDED) or (state[1] == UNREACHABLE and at < state[3]):
            return state, False
        attempts = state[2]
    else:
        attempts = 0
    if result != UNREACHABLE:
        return (size, result, attempts + 1, 0), True
    return (size, UNREACHABLE, attempts + 1, at + backoff(attempts + 1)), True


def outcomes(attempts: DataFrame) -> DataFrame:
    """file, at, outcome, attempts, next_at of each attempt that was due. attempts: a stream of file, size, at (seconds), result.

    Within a batch a file's attempts are taken in order of time. Keys whose attempts weren't due give no row.
    """
    out = "file string, at long, outcome string, attempts long, next_at long"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = tuple(state.get) if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["at", "size", "result"], kind="stable")
        taken = []
        for size, at, result in zip(rows["size"].tolist(), rows["at"].tolist(), rows["result"].tolist(), strict=True):
            held, due = folded(held, size, at, result)
            if due:
                taken.append((key[0], at, *held[1:]))
        state.update(held)
        yield pd.DataFrame(taken, columns=["file", "at", "outcome", "attempts", "next_at"]).astype({"at": "int64", "attempts": "int64", "next_at": "int64"})

    whole = attempts.dropna(subset=["file", "size", "at", "result"]).select("file", F.col("size").cast("long").alias("size"), F.col("at").cast("long").alias("at"), "result")
    return whole.groupBy("file").applyInPandasWithState(step, out, "size long, outcome string, attempts long, next_at long", "append", GroupStateTimeout.NoTimeout)
