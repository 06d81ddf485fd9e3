"""The answer cache over arriving questions: repeated requests dropped, hits, misses, write-back and expiry as state."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from millrace.functions.text import cache_key
from millrace.sources.scratch import importable_on_workers
from millrace.streaming.streams import ROCKSDB, STATE_STORE

ANSWERED = "query_id long, key string, response string, hit boolean"


class AnswerCache(StatefulProcessor):
    """One cached answer: its text and the event time of the question that it was made for, until it is too old."""

    def __init__(self, answer: Callable[[pd.DataFrame], list[str]], ttl_us: int):
        self.answer, self.ttl_us = answer, ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("answer", "response string, us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked = pd.concat(list(rows))
        asked = asked.assign(us=asked["ts"].astype("datetime64[us]").astype("int64")).sort_values(["us", "query_id"])
        held, out = self.held.get() if self.held.exists() else None, []
        before = held
        for at in range(len(asked)):
            one = asked.iloc[at : at + 1]
            query, us, standalone = int(one["query_id"].iloc[0]), int(one["us"].iloc[0]), bool(one["standalone"].iloc[0])
            hit = standalone and held is not None and us - held[1] < self.ttl_us
            response = held[0] if hit else self.answer(one[["query_id", "question"]])[0]
            if standalone and not hit:
                held = (response, us)
            out.append((query, key[0], response, hit))
        if held is not None and held != before:
            self.held.update(held)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max((held[1] + self.ttl_us) // 1000, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(out, columns=["query_id", "key", "response", "hit"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield from ()

    def close(self) -> None:
        pass


def stream_cached_answers(
    questions: DataFrame, answer: Callable[[pd.DataFrame], list[str]], ttl_seconds: int = 3600, late: str = "10 minutes"
) -> DataFrame:
    """``(query_id, key, response, hit)`` of a stream of ``(query_id, question, standalone, ts)``, a row for each request.

    A request that comes again within ``late`` is dropped. Standalone questions (those without history) look their key up
    and find the answer that a question of at most ``ttl_seconds`` before was given; what misses is answered by
    ``answer``, from a frame with ``query_id`` and ``question``, and written back. In event time, so that a replay gives
    the same rows; an answer too old is removed once the watermark passes its end. A key is a state of one answer.
    """
    spark = questions.sparkSession
    importable_on_workers(spark)
    spark.conf.set(STATE_STORE, ROCKSDB)
    rows = questions.select("query_id", "question", "standalone", F.col("ts").cast("timestamp").alias("ts")).where("ts IS NOT NULL")
    rows = rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["query_id"])
    rows = rows.withColumn("key", cache_key(F.coalesce("question", F.lit("")))).withColumn("standalone", F.coalesce("standalone", F.lit(False)))
    return rows.groupBy("key").transformWithStateInPandas(AnswerCache(answer, ttl_seconds * 1_000_000), ANSWERED, "append", "eventTime")
