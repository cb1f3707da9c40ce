"""Streaming forms of the polled jobs; each gives what its batch form gives."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from bazaarlens.operators import inference
from bazaarlens.sources.tables import DEALS_TTL_S

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def need_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _ms(at) -> int:
    return int(pd.Timestamp(at).timestamp() * 1000)


class InOrder(StatefulProcessor):
    """Plays a key's rows in the order of their event time, though they come in any.

    Rows wait in state until the watermark has passed their time, so none before them can come any more; a timer for the
    earliest one waiting calls them up. Rows later than the watermark's delay never get here. ``VALUES`` are the columns
    beside at and tie, ``OUT`` those that ``play`` adds to (key, tie).
    """

    VALUES, STATE, OUT = "", "", ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"at timestamp, tie long, {self.VALUES}")
        self.timer = handle.getValueState("timer", "due long")
        self.state = handle.getValueState("state", self.STATE)

    def play(self, before: tuple | None, values: tuple, at: object) -> tuple[tuple, tuple | None]:
        """(state after a row, the row's output or None)."""
        raise NotImplementedError

    def due(self, state: tuple | None) -> int | None:
        """When a key that stays quiet is to be looked at again, in event time."""

    def quiet(self, key, state: tuple) -> tuple[tuple | None, tuple]:
        """(state, output) once ``due`` has passed without a further row."""
        raise NotImplementedError

    def _wake(self, due: int) -> None:
        now = self.timer.get()[0] if self.timer.exists() else None
        if now is None or due < now:
            if now is not None:
                self.handle.deleteTimer(now)
            self.handle.registerTimer(due)
            self.timer.update((due,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = ["at", "tie", *(v.split()[0] for v in self.VALUES.split(", "))]
        held = [tuple(None if pd.isna(v) else v for v in r) for frame in rows for r in frame[names].itertuples(index=False)]
        self.waiting.appendList(held)
        self._wake(min(_ms(r[0]) for r in held) + 1)
        return
        yield

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        passed = timerValues.getCurrentWatermarkInMs()
        held = list(self.waiting.get())
        ready = sorted((r for r in held if _ms(r[0]) < passed), key=lambda r: (pd.Timestamp(r[0]), r[1]))
        rest = [r for r in held if _ms(r[0]) >= passed]
        if rest:
            self.waiting.put(rest)
            self._wake(min(_ms(r[0]) for r in rest) + 1)
        elif held:
            self.waiting.clear()
        state, out = self.state.get() if self.state.exists() else None, []
        for at, tie, *values in ready:
            state, made = self.play(state, tuple(values), at)
            if made is not None:
                out.append((key[0], tie, *made))
        due = self.due(state)
        if due is not None and due < passed:
            state, made = self.quiet(key, state)
            out.append((key[0], -1, *made))
        elif due is not None:
            self._wake(due + 1)
        if state is not None:
            self.state.update(state)
        elif self.state.exists():
            self.state.clear()
        if out:
            yield pd.DataFrame(out, columns=["listing_id", "tie", *(v.split()[0] for v in self.OUT.split(", "))])


class TwoStrikes(InOrder):
    """A failed check is a strike, a second in a row confirms; what comes after a confirmation is terminal."""

    VALUES, STATE, OUT = "ended boolean", "status string", "change string"

    def play(self, before: tuple | None, values: tuple, at: object) -> tuple[tuple, tuple | None]:
        status = before[0] if before else "alive"
        if status in ("confirmed", "terminal"):
            change = "terminal"
        elif values[0]:
            change = "confirmed" if status == "strike" else "strike"
        else:
            change = "recovered" if status == "strike" else "alive"
        return ({"recovered": "alive"}.get(change, change),), (change,)


class ChangesOnly(InOrder):
    """Passes (price, shipping) on only if it differs from the listing's last; unknown shipping leaves the known one as it is."""

    VALUES, STATE, OUT = "price double, shipping_cost double", "price double, shipping_cost double", "price double, shipping_cost double"

    def play(self, before: tuple | None, values: tuple, at: object) -> tuple[tuple, tuple | None]:
        price, ship = (None if v is None else float(v) for v in values)
        now = (price, ship if ship is not None or before is None else before[1])
        return now, now if before is None or tuple(before) != now else None


def in_order(rows: DataFrame, processor: InOrder, late: str) -> DataFrame:
    """``rows`` (listing_id, at, tie and the processor's values) played by listing; ``late`` is how far behind a row may come."""
    need_rocksdb(rows.sparkSession)
    return rows.withWatermark("at", late).groupBy("listing_id").transformWithStateInPandas(processor, f"listing_id long, tie long, {processor.OUT}", "append", "eventTime")


def two_strikes(checks: DataFrame, late: str = "1 day") -> DataFrame:
    """Checks (listing_id, at, tie, ended) to (listing_id, tie, change), in the order of at whatever the order they come in."""
    return in_order(checks, TwoStrikes(), late)


def changes_only(observations: DataFrame, late: str = "1 day") -> DataFrame:
    """Observations (listing_id, at, tie, price, shipping_cost) to those that change price or known shipping."""
    return in_order(observations, ChangesOnly(), late)


def announce_once(deals: DataFrame) -> DataFrame:
    """The first time each listing is a deal; the set of those announced has no end by design."""
    return deals.dropDuplicates(["listing_id"])


class Announced(StatefulProcessor):
    """A listing's last announced score, forgotten by the state store when its time to live has passed."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "score double", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before, out = self.last.get()[0] if self.last.exists() else None, []
        for tie, score in sorted((int(r.tie), float(r.score)) for frame in rows for r in frame.itertuples(index=False)):
            if before is None or score != before:
                out.append((key[0], tie, score))
            before = score
        self.last.update((before,))
        if out:
            yield pd.DataFrame(out, columns=["listing_id", "tie", "score"])


def fresh_deals(deals: DataFrame, ttl_ms: int = 1000 * DEALS_TTL_S) -> DataFrame:
    """Deals (listing_id, tie, score) that are new, or whose score is another, since the last scan that the time to live still covers.

    Each scan renews the time. Unlike ``announce_once`` the state does not grow for ever: a deal that no scan repeats is forgotten.
    """
    need_rocksdb(deals.sparkSession)
    return deals.groupBy("listing_id").transformWithStateInPandas(Announced(ttl_ms), "listing_id long, tie long, score double", "append", "processingTime")


class Unseen(InOrder):
    """Reports a listing that was not seen for ``after_ms`` of event time: at its next sighting, or when that time has passed without one."""

    VALUES, STATE, OUT = "seen boolean", "last timestamp", "unseen_since timestamp"

    def __init__(self, after_ms: int):
        self.after_ms = after_ms

    def play(self, before: tuple | None, values: tuple, at: object) -> tuple[tuple, tuple | None]:
        gap = before is not None and pd.Timestamp(at) - pd.Timestamp(before[0]) > pd.Timedelta(milliseconds=self.after_ms)
        return (at,), (pd.Timestamp(before[0]),) if gap else None

    def due(self, state: tuple | None) -> int | None:
        return None if state is None else _ms(state[0]) + self.after_ms

    def quiet(self, key, state: tuple) -> tuple[tuple | None, tuple]:
        return None, (pd.Timestamp(state[0]),)


def unseen(sightings: DataFrame, after_ms: int, late: str = "1 hour") -> DataFrame:
    """Times (listing_id, unseen_since) from which a listing (listing_id, at) was not seen for ``after_ms``; a listing's state goes when it stays unseen."""
    rows = sightings.select("listing_id", "at", F.lit(0).cast("long").alias("tie"), F.lit(True).alias("seen"))
    return in_order(rows, Unseen(after_ms), late).drop("tie")


def embed_stream(listings: DataFrame, model: Callable[[list], list], column: str = "images") -> DataFrame:
    """Vectors for listings as they come; the model sees Arrow batches, as in the batch job."""
    return inference.embed(listings, model, column)


def activity(events: DataFrame, late: str = "1 day", window: str = "1 day") -> DataFrame:
    """Sightings by window of event time; windows close once the watermark has passed them."""
    return events.withWatermark("at", late).groupBy(F.window("at", window).alias("w")).agg(F.count("*").alias("n"), F.approx_count_distinct("listing_id").alias("listings"))


def run_to_table(df: DataFrame, path: str, checkpoint: str, empty_batches: bool = True) -> DataFrame:
    """A stream run over all that is there, into a Parquet folder, and that folder read.

    State with a time to live asks for batches without data for ever; such a stream ends only with ``empty_batches`` off.
    """
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    spark = df.sparkSession
    before = spark.conf.get(key)
    spark.conf.set(key, str(empty_batches).lower())
    try:
        q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)
