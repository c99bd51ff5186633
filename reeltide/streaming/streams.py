"""The same rules on unbounded input: pairing with late dependents, bounded reordering, sessions.

Media times are integers; where Spark needs an event time it is made from them (microseconds since 1970), and the integer stays beside it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_time(name: str):
    """A timestamp from integer microseconds, a day later: a watermark begins at 1970 and would drop rows at time 0 as late."""
    return F.timestamp_micros(F.col(name) + 86_400_000_000)


def paired(base: DataFrame, dependent: DataFrame, keys: list[str], t: str, lateness: str) -> DataFrame:
    """Every base row with the dependent row of equal keys and time; one without is given out once the watermark has passed it.

    Both sides have `keys` and `t` (microseconds); other columns keep their names, those of the dependent are prefixed with dep_. At the end of the input the
    rows after the watermark wait for a closing record; the batch form (operators.pairing.paired) has no such end.
    """
    b = base.withColumn("at", event_time(t)).withWatermark("at", lateness)
    d = dependent.select(*[F.col(c).alias(f"dep_{c}") for c in dependent.columns]).withColumn("dep_at", event_time(f"dep_{t}")).withWatermark("dep_at", lateness)
    on = F.col("at") == F.col("dep_at")
    for k in keys:
        on = on & (F.col(k) == F.col(f"dep_{k}"))
    return b.join(d, on, "left_outer").drop("at", "dep_at")


def reordered(frames: DataFrame, key: str, held: int = 18) -> DataFrame:
    """Decode order to display order with at most `held` frames held: (key, seq, reset, poc) -> (key, seq, display).

    The lowest picture-order count is given out when one frame more than `held` waits; a reset gives out all before it. What still waits when no rows come
    for a while is flushed by the timeout.
    """

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, waiting = (state.get[0], list(zip(state.get[1], state.get[2], strict=True))) if state.exists else (0, [])
        out: list[tuple] = []

        def give(n: int) -> None:
            nonlocal count
            waiting.sort()
            for _, seq in waiting[:n]:
                out.append((name[0], seq, count))
                count += 1
            del waiting[:n]

        if state.hasTimedOut:
            give(len(waiting))
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("seq")
            for seq, reset, poc in rows[["seq", "reset", "poc"]].itertuples(index=False, name=None):
                if reset:
                    give(len(waiting))
                waiting.append((int(poc), int(seq)))
                if len(waiting) > held:
                    give(1)
            state.update((count, [p for p, _ in waiting], [s for _, s in waiting]))
            state.setTimeoutDuration(10_000)
        yield pd.DataFrame(out, columns=[key, "seq", "display"])

    kind = frames.schema[key].dataType.simpleString()
    return frames.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, seq bigint, display bigint", "count bigint, pocs array<bigint>, seqs array<bigint>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def sessions(rows: DataFrame, key: str, t: str, gap: str, lateness: str) -> DataFrame:
    """Runs of rows broken by silence: key, begun, ended, n."""
    d = rows.withColumn("at", event_time(t)).withWatermark("at", lateness)
    return d.groupBy(key, F.session_window("at", gap)).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("begun"), F.col("session_window.end").alias("ended"), "n")
