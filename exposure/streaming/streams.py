"""Streaming forms of the jobs.  Every function maps a streaming DataFrame to another."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from hashlib import sha256

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from exposure import dims
from exposure.functions.basics import pick, py_strip
from exposure.operators import conversations, pii
from exposure.operators.risk import curve
from exposure.sources.tables import findings_table

#: the state store that timers need, as a session setting
STATE_STORE = (
    "spark.sql.streaming.stateStore.providerClass",
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
)


def debounce(typed: DataFrame, gap: str = "250 milliseconds", late: str = "10 seconds") -> DataFrame:
    """The last state of a field after each quiet gap, ready to be scanned."""
    return (
        typed.withWatermark("ts", late)
        .groupBy("device_id", "field_id", F.session_window("ts", gap).alias("burst"))
        .agg(F.max_by("text", "ts").alias("text"), F.max("ts").alias("ts"), F.count("*").alias("states"))
        .select("device_id", "field_id", "ts", "states", "text")
    )


# Fields that are never read, and the shortest text that is scanned.
NEVER_READ = ("password", "hidden", "file", "submit", "button", "checkbox", "radio")
SHORTEST = 6


class Typing(StatefulProcessor):
    """The last text of each burst of typing, unless the field last held the same.

    A burst ends when the watermark has passed its last row by the gap.  Of rows that the watermark
    has passed, only the last can still matter, so what waits is that one and what may be out of order.
    The field's last text is kept as a digest, and forgotten when the field has been silent.
    """

    def __init__(self, gap_us: int, forget_us: int) -> None:
        self.gap_us, self.forget_us = gap_us, forget_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, text string, site_origin string")
        self.last = handle.getValueState("last", "us long, digest string")

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        passed = 1000 * timerValues.getCurrentWatermarkInMs()
        fresh = [(r["us"], r["text"], r["site_origin"]) for r in rows if r["us"] is not None and r["us"] >= passed]
        if fresh:
            self.waiting.appendList(fresh)
            self._wake(min(us for us, _, _ in fresh) + self.gap_us)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = 1000 * timerValues.getCurrentWatermarkInMs()
        held = sorted(self.waiting.get(), key=lambda r: (r[0], r[1] or "", r[2] or "")) if self.waiting.exists() else []
        last = self.last.get() if self.last.exists() else None
        left, told = [], []
        for i, (us, text, origin) in enumerate(held):
            more = i + 1 < len(held) and held[i + 1][0] < us + self.gap_us
            if us >= passed or (not more and us + self.gap_us > passed):
                left.append((us, text, origin))
            elif not more:
                digest = sha256((text or "").encode()).hexdigest()
                if last is None or last[1] != digest or us >= last[0] + self.forget_us:
                    told.append(Row(device_id=key[0], field_id=key[1], us=us, text=text, site_origin=origin))
                last = (us, digest)
                self.last.update(last)
                self._wake(us + self.forget_us)
        if left:
            self.waiting.put(left)
            self._wake(left[0][0] + self.gap_us)
        elif held:
            self.waiting.clear()
        elif last is not None and passed >= last[0] + self.forget_us:
            self.last.clear()
        return iter(told)


def typed_findings(
    typed: DataFrame, gap_ms: int = 250, late: str = "10 seconds", forget_minutes: int = 60, shortest: int = SHORTEST,
) -> DataFrame:
    """What is found in typed fields: ``typed`` has ``device_id, field_id, field_type, site_origin, ts, text``.

    Fields of the types ``NEVER_READ`` are left out.  A field's text is judged once it rests for the gap and
    differs from what was judged last.  A text shorter than ``shortest`` gives a row with ``scanned`` false
    and no findings.  The session needs the state store ``STATE_STORE``.
    """
    secret = F.coalesce(F.lower("field_type").isin(*NEVER_READ), F.lit(False))
    rows = typed.filter(~secret).withWatermark("ts", late).select(
        "device_id", "field_id", "ts", F.unix_micros("ts").alias("us"), "text", "site_origin")
    rested = rows.groupBy("device_id", "field_id").transformWithState(
        Typing(gap_ms * 1000, forget_minutes * 60_000_000),
        "device_id string, field_id string, us long, text string, site_origin string", "Append", "EventTime",
    )
    scanned = F.length(py_strip(F.coalesce("text", F.lit("")))) >= shortest
    gated = rested.select(
        "device_id", "field_id", F.timestamp_micros("us").alias("occurred_at"), "site_origin",
        F.lit("text").alias("field_kind"), scanned.alias("scanned"), F.when(scanned, F.col("text")).alias("text"),
    )
    return live_findings(gated)


def settled_conversations(
    messages: DataFrame, gap: str = "2500 milliseconds", late: str = "1 minute", keep: int | None = None,
) -> DataFrame:
    """Score a chat once it has been quiet for the gap: what came in, all of it or the last ``keep`` messages."""
    said = F.struct(F.col("ts"), F.col("turn"), F.col("incoming"), py_strip(F.col("text")).alias("t"))
    burst = (
        messages.withWatermark("ts", late)
        .groupBy("conv_id", F.session_window("ts", gap).alias("burst"))
        .agg(F.array_sort(F.collect_list(said)).alias("said"))
    )
    last = F.col("said") if keep is None else F.slice("said", F.greatest(F.lit(1), F.size("said") - keep + 1), F.lit(keep))
    recent = F.filter(last, lambda m: m["incoming"] & (m["t"] != ""))
    assembled = burst.select(
        "conv_id", F.col("burst.end").alias("settled_at"),
        F.array_join(F.transform(recent, lambda m: m["t"]), "\n").alias("incoming_text"),
    )
    return conversations.score_conversations(assembled)


class Spacing(StatefulProcessor):
    """Times (``us``, in microseconds) at least a gap after the last one given out for their key.

    A time waits in the state until the watermark has passed it, so rows that come late, but
    within the bound, are judged in their place, and no result depends on how rows fall into
    micro-batches.  One timer per key and batch looks at all that has been passed.  What waits is what
    the watermark still allows to be out of order.  The last time given out is forgotten a gap
    after it, when nothing can fall into its gap any more: a silent key leaves no state.
    """

    def __init__(self, gap_us: int) -> None:
        self.gap_us = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long")
        self.last = handle.getValueState("last", "us long")

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        passed = 1000 * timerValues.getCurrentWatermarkInMs()
        fresh = sorted({row["us"] for row in rows if row["us"] is not None and row["us"] >= passed})
        if fresh:
            self.waiting.appendList([(us,) for us in fresh])
            self._wake(fresh[0])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = 1000 * timerValues.getCurrentWatermarkInMs()
        times = sorted({us for (us,) in self.waiting.get()}) if self.waiting.exists() else []
        last = self.last.get()[0] if self.last.exists() else None
        due = bisect_right(times, passed)
        given, at = [], 0
        while (at := at if last is None else bisect_left(times, last + self.gap_us, 0, due)) < due:
            last = times[at]
            given.append(Row(key=key[0], us=last))
        if due == len(times):
            self.waiting.clear()
        elif due:
            self.waiting.put([(us,) for us in times[due:]])
        if due < len(times):
            self._wake(times[due])
        if given:
            self.last.update((last,))
            self._wake(last + self.gap_us)
        elif last is not None and passed >= last + self.gap_us:
            self.last.clear()
        return iter(given)


def _spaced(rows: DataFrame, key: str, time: str, gap_us: int, late: str) -> DataFrame:
    """``(key, time)`` of rows at least the gap after the last one given out for their key.

    A result comes when the watermark has passed its time; a later row is too late.  NULL times
    are passed over.  The session needs the state store ``STATE_STORE``.
    """
    named = rows.withWatermark(time, late).select(
        F.col(key).cast("string").alias("key"), F.col(time).alias("ts"), F.unix_micros(time).alias("us"))
    told = named.groupBy("key").transformWithState(Spacing(gap_us), "key string, us long", "Append", "EventTime")
    return told.select(F.col("key").alias(key), F.timestamp_micros("us").alias(time))


def fresh_keys(checks: DataFrame, key: str, reuse_hours: float = 6, late: str = "10 minutes") -> DataFrame:
    """``(key, ts)`` of checks that cannot reuse an earlier verdict: none was given out within the reuse time."""
    return _spaced(checks, key, "ts", int(reuse_hours * 3_600_000_000), late)


def thin_snapshots(snapshots: DataFrame, minutes: int = 5, late: str = "10 minutes") -> DataFrame:
    """Keep a snapshot only if ``minutes`` passed since the last kept one of its device."""
    return _spaced(snapshots, "device_id", "captured_at", minutes * 60_000_000, late)


def live_counts(events: DataFrame, late: str = "1 hour", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Tumbling (or sliding) counts per device and type."""
    window = F.window("occurred_at", size, slide) if slide else F.window("occurred_at", size)
    return (
        events.withWatermark("occurred_at", late)
        .groupBy("device_id", "pii_type", window.alias("w"))
        .agg(F.count("*").alias("events"), F.count_if(F.col("action_taken") == "masked").alias("masked"))
        .select("device_id", "pii_type", F.col("w.start").alias("from"), F.col("w.end").alias("until"), "events", "masked")
    )


def live_findings(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Scan arriving texts.  ``fast_path`` marks rows with a known credential shape."""
    fast = pii.first_credential(F.col(text_col)).isNotNull()
    return pii.scan_documents(texts.withColumn("fast_path", fast), text_col)


def store_findings(batch: DataFrame, batch_id: int, path: str) -> None:
    """``foreachBatch`` sink: a replayed batch overwrites itself, so it is stored once."""
    findings_table(batch).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(
        f"{path}/batch={batch_id}"
    )


# ---------------------------------------------------------------------------
# Incremental privacy score
# ---------------------------------------------------------------------------


def daily_penalties(events: DataFrame, late: str = "30 days") -> DataFrame:
    """Penalty per device and day, each event grown to the day's end.

    Decay is exponential, so a day's events age together and one number per day replaces
    them.  The watermark keeps 30 days open: later rows no longer matter to the score.
    """
    base = pick(dims.PII_BASE_PENALTY, F.col("risk_level"), dims.PII_BASE_PENALTY["medium"])
    action = pick(dims.PII_ACTION_FACTOR, F.col("action_taken"), 1.0)
    day_us = F.lit(86_400_000_000)
    left = (day_us - F.pmod(F.unix_micros("occurred_at"), day_us)) / day_us
    faded = F.pow(F.lit(0.5), left / dims.HALF_LIFE_DAYS)
    return (
        events.withWatermark("occurred_at", late)
        .groupBy("device_id", F.window("occurred_at", "1 day").alias("w"))
        .agg(F.sum(base * action * F.col("confidence") * faded).alias("penalty"), F.count("*").alias("events"))
        .select("device_id", F.col("w.end").alias("day_end"), "penalty", "events")
    )


def score_from_days(days: DataFrame, now: Column) -> DataFrame:
    """Privacy score from the day rows.  Exact but for the one day the 30-day edge cuts."""
    age = (F.unix_micros(now) - F.unix_micros("day_end")) / F.lit(8.64e10)
    live = days.filter(F.col("day_end") >= now - F.expr(f"INTERVAL {dims.LOOKBACK_DAYS} DAYS"))
    return live.groupBy("device_id").agg(
        F.sum(F.col("penalty") * F.pow(F.lit(0.5), age / dims.HALF_LIFE_DAYS)).alias("penalty")
    ).withColumn("privacy", curve(F.col("penalty")))


def days_in_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The day rows of :func:`daily_penalties` as its query's state store holds them.

    No batch leaves files to be merged: the store keeps one row per device and day that the
    watermark has not passed, however many batches there were.
    """
    state = spark.read.format("statestore").load(checkpoint)
    return state.select(
        F.col("key.device_id"), F.col("key.window.end").alias("day_end"),
        F.col("value.sum").alias("penalty"), F.col("value.count").alias("events"),
    )
