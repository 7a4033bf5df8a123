"""Keyed state in Spark's state store: scrape results per restaurant, unique jobs per argument set and period.

Both thin a batch inside its map tasks before the shuffle, so a key that holds a third of a batch brings a few rows
per task. Nothing vanishes: rows that come too late for a decision, or belong to no restaurant, are given out as rows of
a `kind` of their own with their number, and a sink can put them aside.

State is kept by bucket, a hash of the key, as one array of rows: a batch opens each bucket it touches once, instead of calling
Python and the store for every key. The number of buckets is part of a stream's checkpoint and stays what it was at the start.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from dishlens.constants import SCRAPED, SCRAPING

JOB, LATE, UNKNOWN, STATE = "job", "late", "unknown", "state"
BUCKETS = 4096
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """State with timers and initial values needs the RocksDB store; another choice of the session's owner stays."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (spark.conf.get(name, None) or ""):
        spark.conf.set(name, _PROVIDER)


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


# ---------------------------------------------------------------- unique jobs

class UniqueJob(StatefulProcessor):
    """One job per argument set: the state of a period's bucket lists those given out, a timer at the period's end lets them go."""

    def __init__(self, args: Sequence[str], kinds: str, period_ms: int):
        self.args, self.kinds, self.period_ms = list(args), kinds, period_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.given = handle.getValueState("given", f"jobs array<struct<{self.kinds}>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        found: dict[tuple, list] = {}
        for row in rows:
            args = tuple(row[a] for a in self.args)
            seen = found.setdefault(_named(args), [args, row["first_ms"], 0])
            seen[1], seen[2] = min(seen[1], row["first_ms"]), seen[2] + row["n"]
        period = key[0]
        end = (period + 1) * self.period_ms
        late = end <= timerValues.getCurrentWatermarkInMs()
        given = [] if late else [tuple(args) for args in (self.given.get() or ([],))[0]]
        known = {_named(args) for args in given}
        fresh = [value for name, value in found.items() if name not in known]
        for args, first, n in fresh:
            own = dict(zip(self.args, args, strict=True))
            yield Row(**own, period=period, first_ms=first, n=n, kind=LATE if late else JOB)
        if fresh and not late:
            if not given:
                self.handle.registerTimer(end)
            self.given.update((given + [args for args, _, _ in fresh],))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.given.clear()
        return iter(())

    def close(self) -> None:
        pass


def _named(args: Sequence) -> tuple:
    """Arguments as a key that is equal to itself: NaN is not."""
    return tuple("NaN" if a != a else a for a in args)


def unique_jobs(
    stream: DataFrame, args: Sequence[str], ts: str, seconds: int, late: str = "2 days", buckets: int = BUCKETS
) -> DataFrame:
    """(args..., period, first_ms, n, kind): each argument set's first job of a period, as `unique_in_period` cuts them.

    State of a period is kept until the watermark, `late` behind the newest row, has passed its end. Rows of a period that
    has ended come out with kind `late` and their number, since nobody knows any more whether their job has run.
    """
    use_state_store(stream.sparkSession)
    period_ms = seconds * 1000
    ms = F.unix_millis(F.col(ts).cast("timestamp"))
    # The time leaves as a plain number: a column with a watermark would make Spark drop late rows uncounted.
    rows = stream.withWatermark(ts, late).select(
        *args, F.floor(ms / period_ms).cast("long").alias("period"), ms.alias("first_ms"), F.lit(1).cast("long").alias("n")
    ).filter("first_ms IS NOT NULL")
    keys = [*args, "period"]

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            found = pa.Table.from_batches([part]).group_by(keys).aggregate([("first_ms", "min"), ("n", "sum")])
            found = found.select([*keys, "first_ms_min", "n_sum"]).rename_columns([*keys, "first_ms", "n"])
            yield from found.to_batches()

    thinned = rows.mapInArrow(thin, rows.schema).withColumn("_bucket", _bucket(args, buckets))
    kinds = {f.name: f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields}
    out = ", ".join(kinds.values()) + ", kind string"
    return thinned.groupBy("period", "_bucket").transformWithState(
        UniqueJob(args, ", ".join(kinds[a] for a in args), period_ms), out, "append", "EventTime"
    )


# ---------------------------------------------------------------- scrape results

def thin_results(part: pd.DataFrame, key: str) -> pd.DataFrame:
    """Without failures behind a success of the same restaurant, which decide nothing; `n` counts what a row stands for."""
    part = part.sort_values([key, "seq"], kind="stable")
    success = part["status"] == SCRAPED
    seen = success.astype("int64").groupby(part[key]).cumsum()
    part = part.assign(n=part.groupby([part[key], seen])["seq"].transform("size").where(success, 1))
    return part[(seen == 0) | success]


class ScrapeState(StatefulProcessor):
    """The rows of a bucket of restaurants: any result counts until the first success, then only successes, whose items add up."""

    def __init__(self, key: str, kind: str):
        self.key, self.kind = key, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        columns = f"`{self.key}`: {self.kind}, status: string, item_count: int, last_error: string, us: long, seq: long"
        self.rows = handle.getValueState("rows", f"rows array<struct<{columns}>>")

    def _held(self) -> list[tuple]:
        return [tuple(row) for row in (self.rows.get() or ([],))[0]]

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        first = zip(
            initialState[self.key].tolist(), _plain(initialState["status"]), _plain(initialState["item_count"], int),
            _plain(initialState["last_error"]), _plain(initialState["us"], int), strict=True,
        )
        self.rows.update((self._held() + [(*row, -(1 << 62)) for row in first],))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values([self.key, "seq"], kind="stable")
        state = {row[0]: row[1:] for row in self._held()}
        every = zip(
            events[self.key].tolist(), events["seq"].tolist(), events["n"].tolist(), _plain(events["status"]),
            _plain(events["item_count"], int), _plain(events["last_error"]), _plain(events["us"], int), strict=True,
        )
        found: list[tuple] = []
        for name, own in groupby(every, itemgetter(0)):
            if name not in state:
                found.append((name, *(None,) * 4, UNKNOWN, sum(e[2] for e in own), None, None))
                continue
            before, late, used = state[name], 0, 0
            status, count, error, us, last = before
            for _, seq, n, now, items, text, at in own:
                if seq <= before[4]:
                    late += n
                    continue
                used, last = used + n, seq
                if now == SCRAPED:
                    held = count if status in (SCRAPED, SCRAPING) else 0
                    count, us = (held or 0) + (items or 0), at
                elif status == SCRAPED:
                    continue
                else:
                    count = items
                status, error = now, text or None
            if late:
                found.append((name, *(None,) * 4, LATE, late, None, None))
            if used:
                state[name] = (status, count, error, us, last)
                found.append((name, status, count, error, us, STATE, used, *before[:2]))
        if any(f[5] == STATE for f in found):
            self.rows.update(([(name, *row) for name, row in state.items()],))
        out = pd.DataFrame(found, columns=[
            self.key, "status", "item_count", "last_error", "us", "kind", "n", "old_status", "old_item_count"], dtype=object)
        yield out.astype({"item_count": "Int64", "us": "Int64", "n": "int64", "old_item_count": "Int64"})

    def close(self) -> None:
        pass


def _plain(column: pd.Series, kind=None) -> list:
    """A column's values, None where it has none."""
    return [None if none else kind(v) if kind else v for v, none in zip(column.tolist(), column.isna().tolist(), strict=True)]


def scrape_states(events: DataFrame, base: DataFrame, key: str = "camis", buckets: int = BUCKETS) -> DataFrame:
    """Fold result events (key, seq, ts, status, item_count, last_error) onto the base rows' state.

    Each batch gives the new row of every restaurant it touched (kind `state`, with the status and item count it had
    before, so that counts can follow), and with their number the events whose
    `seq` isn't above what was applied before (kind `late`) and those of restaurants that the base lacks (`unknown`).
    `base` is read when the stream starts for the first time; from then on the state store knows the rows.
    """
    use_state_store(events.sparkSession)
    text = base.schema[key].dataType.simpleString()
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias("us")
    rows = events.select(
        F.col(key).cast(text).alias(key), F.col("seq").cast("long").alias("seq"), us("ts"), "status", F.col("item_count").cast("int").alias("item_count"),
        "last_error", F.lit(1).cast("long").alias("n"),
    ).filter(F.col(key).isNotNull() & F.col("seq").isNotNull())

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                yield thin_results(part, key)

    first = base.select(key, "status", F.col("item_count").cast("int").alias("item_count"), "last_error", us("scraped_at"))
    out = f"{key} {text}, status string, item_count int, last_error string, us long, kind string, n long, old_status string, old_item_count int"
    first = first.filter(F.col(key).isNotNull()).withColumn("_bucket", _bucket([key], buckets))
    thinned = rows.mapInPandas(thin, rows.schema).withColumn("_bucket", _bucket([key], buckets))
    found = thinned.groupBy("_bucket").transformWithStateInPandas(
        ScrapeState(key, text), out, "update", "None", first.groupBy("_bucket")
    )
    at = F.timestamp_micros("us").cast(base.schema["scraped_at"].dataType)
    return found.select(key, "status", "item_count", "last_error", at.alias("scraped_at"), "kind", "n", "old_status", "old_item_count")


def with_states(base: DataFrame, changed: DataFrame, key: str = "camis") -> DataFrame:
    """The base brought up to date by the newest `state` row of each restaurant (`changed` has a `batch` number)."""
    columns = ["status", "item_count", "last_error", "scraped_at"]
    newest = changed.filter(F.col("kind") == STATE).groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("_new"))
    new = F.col("_new").isNotNull()
    return base.join(newest, key, "left").select(*[
        F.when(new, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns
    ])
