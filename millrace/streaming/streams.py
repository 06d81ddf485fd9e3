"""Structured Streaming forms of the query log and of answer events."""

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from millrace.sources.scratch import importable_on_workers


def log_windows(log: DataFrame, minutes: int = 10, late: str = "1 hour") -> DataFrame:
    """Count and mean latency of the query log per event-time window; the same for a batch and a stream.

    As a stream in append mode a window is emitted when the watermark, ``late`` behind the newest event, passes it.
    """
    rows = log.withColumn("ts", F.col("ts").cast("timestamp"))
    if log.isStreaming:
        rows = rows.withWatermark("ts", late)
    grouped = rows.groupBy(F.window("ts", f"{minutes} minutes"), "event_type")
    out = grouped.agg(F.count("*").alias("n"), F.avg("value").alias("mean_ms"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "mean_ms")


def rollup_stream_events(events: DataFrame) -> DataFrame:
    """One row per request from its events ``(request_id, seq, ts, type, data)``.

    The answer is the chunk tokens in order; the first metadata and confidence, the last citations; status done,
    error or open; total time from the first to the last event. A request's events are one group, bounded by the
    length of one answer.
    """

    def first(kind: str):
        return F.min_by(F.when(F.col("type") == kind, F.col("data")), F.when(F.col("type") == kind, F.col("seq")))

    tokens = F.array_sort(F.collect_list(F.when(F.col("type") == "chunk", F.struct("seq", "data"))))
    span = F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))
    out = events.groupBy("request_id").agg(
        F.array_join(tokens["data"], "").alias("answer"),
        first("metadata").alias("metadata"),
        first("confidence").alias("confidence"),
        F.max_by("data", F.when(F.col("type") == "citations", F.col("seq"))).alias("citations"),
        F.max((F.col("type") == "done").cast("int")).alias("_done"),
        F.max((F.col("type") == "error").cast("int")).alias("_error"),
        F.floor(span / 1000).cast("long").alias("total_ms"),
        F.count_if(F.col("type") == "chunk").alias("tokens"),
    )
    status = F.when(F.col("_error") == 1, "error").when(F.col("_done") == 1, "done").otherwise("open")
    return out.withColumn("status", status).drop("_done", "_error")


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT = "seq long, us long, type string, data string"
REQUEST = "given boolean, late long, timer long"
ANSWER = "request_id string, answer string, metadata string, confidence string, citations string, total_ms long, tokens long, status string, late long"


class AnswerEvents(StatefulProcessor):
    """The events of one request, gathered until it ends: a list state that grows by what arrives, and a timer.

    A batch appends its events and reads none of the earlier ones, unless it brings the end; then the row is made, the list
    is cleared and only a count of late events stays, until the timer removes it. Each call of the state store is a message to
    the JVM, so one value has all else that is known of a request, its timer too, and an end that arrives with all its
    events stores none of them.
    """

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", EVENT)
        self.request = handle.getValueState("request", REQUEST)  # given: the request's row is out

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fresh = [(row.seq, row.us, row.type, row.data) for row in rows]
        known = self.request.get()
        given, late, timer = known if known is not None else (False, 0, None)
        kinds = {event[2] for event in fresh}
        if given:
            late += len(fresh)
        elif kinds & {"done", "error"}:
            held = fresh
            if known is not None:
                held = [*map(tuple, self.events.get()), *fresh]
                self.events.clear()
            yield _answer_row(key[0], held, "error" if any(event[2] == "error" for event in held) else "done", 0)
            given = True
        else:
            self.events.appendList(fresh)
        newest = max(timerValues.getCurrentWatermarkInMs(), max(event[1] for event in fresh) // 1000)
        if timer is not None:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(newest + self.wait_ms)
        self.request.update((given, late, newest + self.wait_ms))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        given, late, _ = self.request.get()
        if not given:
            yield _answer_row(key[0], [*map(tuple, self.events.get())], "open", 0)
            self.events.clear()
        elif late:
            yield _answer_row(key[0], [], "late", late)
        self.request.clear()

    def close(self) -> None:
        pass


def stream_answers(events: DataFrame, wait: str = "10 minutes", wait_ms: int = 600_000) -> DataFrame:
    """The streaming form of :func:`rollup_stream_events`: one row per request, when it ends.

    A request's events are kept as state until ``done`` or ``error`` arrives; the row is emitted then. A request
    without an end is emitted as ``open`` once the watermark, ``wait`` behind the newest event, is ``wait_ms`` past its
    last event. Events that arrive after the row was emitted are counted; a request whose late events run out is
    reported again with status ``late`` and their number. State is removed by the timer, so it never outlives its use.

    The session's state store is set to the RocksDB one, which lists and timers need; a checkpoint of another store cannot
    be continued.
    """
    spark = events.sparkSession
    importable_on_workers(spark)
    spark.conf.set(STATE_STORE, ROCKSDB)
    rows = events.select("request_id", "seq", F.col("ts").cast("timestamp").alias("ts"), "type", "data").withWatermark("ts", wait)
    rows = rows.withColumn("us", F.unix_micros("ts"))
    return rows.groupBy("request_id").transformWithState(AnswerEvents(wait_ms), ANSWER, "append", "eventTime")


def _answer_row(request: str, events: list[tuple], status: str, late: int) -> Row:
    """The row of a request from its events ``(seq, us, type, data)``; those without a number come last."""
    ordered = sorted(events, key=lambda event: (event[0] is None, event[0]))

    def pick(kind: str, at: int) -> str | None:
        found = [event[3] for event in ordered if event[2] == kind]
        return found[at] if found else None

    chunks, times = [event[3] for event in ordered if event[2] == "chunk"], [event[1] for event in ordered]
    return Row(
        request_id=request,
        answer="".join(chunks),
        metadata=pick("metadata", 0),
        confidence=pick("confidence", 0),
        citations=pick("citations", -1),
        total_ms=(max(times) - min(times)) // 1000 if times else 0,
        tokens=len(chunks),
        status=status,
        late=late,
    )
