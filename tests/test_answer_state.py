"""The stream of answers: a few messages to the state store for each request, and the rows and times it should have."""

from types import SimpleNamespace

from pyspark.sql import Row

from millrace.streaming.streams import AnswerEvents


class Store:
    """State of one request in place of Spark's; every call is counted."""

    def __init__(self):
        self.calls, self.value, self.items, self.timers = [], None, [], []

    def getListState(self, name, schema):
        return SimpleNamespace(get=self._("read", lambda: iter(self.items)), clear=self._("empty", self.items.clear), appendList=self._("append", self.items.extend))

    def getValueState(self, name, schema):
        def put(value):
            self.value = value

        return SimpleNamespace(get=self._("get", lambda: self.value), update=self._("put", put), clear=self._("clear", lambda: put(None)))

    def registerTimer(self, at):
        self.calls.append("timer")
        self.timers.append(at)

    def deleteTimer(self, at):
        self.calls.append("no timer")
        self.timers.remove(at)

    def _(self, name, do):
        return lambda *a: (self.calls.append(name), do(*a))[1]


def events(*kinds, first=0):
    return iter([Row(seq=first + i, us=1_000_000 * (first + i), type=k, data=f"{k}{first + i}") for i, k in enumerate(kinds)])


def test_requests_that_end_at_once_later_and_never():
    now = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    whole = Store()
    answer = AnswerEvents(5000)
    answer.init(whole)
    (row,) = answer.handleInputRows(("a",), events("chunk", "metadata", "chunk", "done"), now)
    assert (row.answer, row.metadata, row.status, row.total_ms, row.tokens) == ("chunk0chunk2", "metadata1", "done", 3000, 2)
    assert len(whole.calls) <= 3 and not whole.items and whole.timers == [8000]
    assert not [*answer.handleInputRows(("a",), events("chunk", first=6), now)] and whole.timers == [11000]
    (row,) = answer.handleExpiredTimer(("a",), now, None)
    assert (row.status, row.late) == ("late", 1) and whole.value is None

    parts = Store()
    answer.init(parts)
    assert not [*answer.handleInputRows(("b",), events("chunk", "citations"), now)] and len(parts.items) == 2
    (row,) = answer.handleInputRows(("b",), events("chunk", "error", first=2), now)
    assert (row.answer, row.citations, row.status, row.late) == ("chunk0chunk2", "citations1", "error", 0) and not parts.items
    assert parts.timers == [8000] and not [*answer.handleExpiredTimer(("b",), now, None)]

    never = Store()
    answer.init(never)
    assert not [*answer.handleInputRows(("c",), events("confidence"), now)]
    (row,) = answer.handleExpiredTimer(("c",), now, None)
    assert (row.answer, row.confidence, row.status) == ("", "confidence0", "open") and never.value is None and not never.items
