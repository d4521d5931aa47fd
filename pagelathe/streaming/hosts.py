"""State of hosts: adaptive delays, circuit breakers and items delivered once.

The batch forms fold each host's rows in order while they stream through a sorted partition; only the state of the
current host is held, however many rows a host has.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_BACKOFF = 0.5


def next_delay(now: float, latency: float, status: int | None, target: float = 1.0, least: float = 0.0, most: float = 60.0) -> float:
    """The delay after a response: towards latency / target on success, up on refusal."""
    goal = latency / target
    if status == 200:
        out = (now + goal) / 2
    elif status == 429:
        out = max(2 * now, LEAST_BACKOFF)
    else:
        out = max(now, (now + goal) / 2)
    return min(max(out, least), most)


PAUSE = 300.0


class Breaker:
    """Trips when more than a share of the last `window` responses were blocked, from `least` responses on; forgets them then."""

    def __init__(self, window: int = 50, least: int = 10, share: float = 0.3):
        self.least, self.share, self.last = least, share, deque(maxlen=window)

    def add(self, blocked: bool) -> bool:
        self.last.append(blocked)
        if len(self.last) >= self.least and sum(self.last) > self.share * len(self.last):
            self.last.clear()
            return True
        return False


#: Statuses after which a request is worth another try, and methods that are not repeated unasked.
RETRIED = (408, 500, 502, 503, 504, 522, 524)
UNREPEATED = ("POST", "PATCH")


def slowed(delay: Column) -> Column:
    """A host's delay after a block: doubled, at least LEAST_BACKOFF."""
    return F.greatest(delay * 2, F.lit(LEAST_BACKOFF))


def backoff(attempt: Column, base: float = 1.0, most: float = 60.0) -> Column:
    """The longest wait before another try: base doubled with each attempt, up to most."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most))


def retryable(status: Column, method: Column, attempt: Column, tries: int = 3, repeat: Column | None = None) -> Column:
    """Whether a request is tried again: null status (no response) or one of RETRIED, tries left, and a repeatable method or `repeat`."""
    may = ~F.upper(method).isin(*UNREPEATED) | F.coalesce(repeat if repeat is not None else F.lit(False), F.lit(False))
    return (status.isNull() | status.isin(*RETRIED)) & (attempt < tries) & may


def retries(responses: DataFrame, tries: int = 3, base: float = 1.0, most: float = 60.0, seed: str = "") -> DataFrame:
    """responses (fp, method, status, attempt) with `again` and `wait`: full jitter, a share of `backoff` fixed by request, attempt and seed."""
    draw = F.pmod(F.xxhash64("fp", "attempt", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    again = retryable(F.col("status"), F.col("method"), F.col("attempt"), tries)
    return responses.withColumn("again", again).withColumn("wait", F.when(again, draw * backoff(F.col("attempt"), base, most)))


def _folded(df: DataFrame, key: str, order: list[str], schema: str, fresh, step) -> DataFrame:
    """step(state, row) for each row in order, with a fresh state for each key."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for part in parts:
            out = []
            for row in part.itertuples(index=False):
                own = getattr(row, key)
                if state is None or own != now:
                    now, state = own, fresh()
                out.append(step(state, row))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def delays(responses: DataFrame, target: float = 1.0) -> DataFrame:
    """(host, seq, delay) after each of the responses (host, seq, latency, status)."""

    def step(state: list, row) -> tuple:
        state[0] = next_delay(state[0], row.latency, None if pd.isna(row.status) else int(row.status), target)
        return row.host, row.seq, state[0]

    return _folded(responses.select("host", "seq", "latency", "status"), "host", ["seq"], "host string, seq long, delay double", lambda: [0.0], step)


def trips(responses: DataFrame, window: int = 50, least: int = 10, share: float = 0.3) -> DataFrame:
    """(host, seq, tripped) for each of the responses (host, seq, blocked)."""
    return _folded(responses.select("host", "seq", "blocked"), "host", ["seq"], "host string, seq long, tripped boolean", lambda: Breaker(window, least, share), lambda b, r: (r.host, r.seq, b.add(bool(r.blocked))))


def pauses(responses: DataFrame, seconds: float = PAUSE, window: int = 50, least: int = 10, share: float = 0.3) -> DataFrame:
    """(host, seq, from, until) of the pauses that a host's breaker starts; responses (host, seq, at, blocked), at in seconds."""

    def step(state: Breaker, row) -> tuple:
        return row.host, row.seq, row.at, state.add(bool(row.blocked))

    out = _folded(responses.select("host", "seq", "at", "blocked"), "host", ["seq"], "host string, seq long, at double, tripped boolean", lambda: Breaker(window, least, share), step)
    return out.where("tripped").select("host", "seq", F.col("at").alias("from"), (F.col("at") + seconds).alias("until"))


def queued(requests: DataFrame, per_host: int | None = None) -> DataFrame:
    """requests (host, priority, seq) with `place`: the order within a host, the highest priority first, then the earliest; at most per_host of each."""
    from pyspark.sql import Window as W

    out = requests.withColumn("place", F.row_number().over(W.partitionBy("host").orderBy(F.desc("priority"), "seq")))
    return out if per_host is None else out.where(F.col("place") <= per_host)  # Spark keeps the first per_host of each task only


def delays_stream(responses: DataFrame, target: float = 1.0) -> DataFrame:
    """`delays` on a stream: the delay of a host is kept as state between micro-batches.

    A host's rows of one micro-batch are put in order as a whole, so that a micro-batch (maxFilesPerTrigger and the like)
    bounds what a task holds: 24 bytes a row. Micro-batches are expected in order.
    """

    def update(key, parts, state):
        delay = state.get[0] if state.exists else 0.0
        seq, latency, status = ([], [], [])
        for part in parts:
            seq.append(part["seq"].to_numpy())
            latency.append(part["latency"].to_numpy(float))
            status.append(part["status"].astype("Float64").to_numpy(float, na_value=np.nan))
        if not seq:
            return
        seq, latency, status = map(np.concatenate, (seq, latency, status))
        order = np.argsort(seq, kind="stable")
        out = np.empty(len(order))
        for at, i in enumerate(order.tolist()):
            delay = out[at] = next_delay(delay, float(latency[i]), None if np.isnan(status[i]) else int(status[i]), target)
        state.update((float(delay),))
        for at in range(0, len(order), 10_000):
            some = order[at : at + 10_000]
            yield pd.DataFrame({"host": key[0], "seq": seq[some], "delay": out[at : at + 10_000]})

    return responses.groupBy("host").applyInPandasWithState(update, "host string, seq long, delay double", "delay double", "append", "NoTimeout")


def once(items: DataFrame, key: str = "_id", time: str | None = None, within: str = "1 day") -> DataFrame:
    """Items of a table, each key once; on a stream each key once within a time, for which alone keys are kept.

    `time` is the stream's column of event times. A stream without one would keep all keys for ever, and is refused:
    `plans.checkpoint.deliver` delivers once by a table of what was delivered.
    """
    if not items.isStreaming:
        return items.dropDuplicates([key])
    if time is None:
        raise ValueError("a stream needs a column of event times, or its state would grow without bound")
    return items.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def blocked_share(events: DataFrame, host: str, order: str, blocked, window: int = 50) -> DataFrame:
    """events with `share`, the blocked share of the last `window` rows of a host."""
    from pyspark.sql import Window as W

    return events.withColumn("share", F.avg(F.when(blocked, 1.0).otherwise(0.0)).over(W.partitionBy(host).orderBy(order).rowsBetween(1 - window, 0)))
