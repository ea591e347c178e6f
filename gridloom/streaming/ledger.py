"""The sequential sign test as a stateful stream that waits for missing outcomes and can be replayed.

Outcomes of a candidate count in the order of their folds, whatever order they
come in: those that are ahead wait in a list until the folds before them have
come, or until a timer gives these up.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.decision import bounds, steps

OUTPUT = "candidate string, k int, state string, llr double, n int, wins int, decision string, other string"
TEST = "next int, llr double, n int, wins int, decision string"
WAITING = "k int, win boolean, at long"
#: The state store that keeps lists, values and timers.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SignTest(StatefulProcessor):
    """One test per candidate. States of an outcome: counted, late (the test has stopped or has passed its fold), repeated (it waits already) or given up (its fold never came)."""

    def __init__(self, up: float, low: float, other: tuple[float, float], win: float, loss: float, patience_ms: int):
        self.up, self.low, self.other, self.win, self.loss, self.patience = up, low, other, win, loss, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.test = handle.getValueState("test", TEST)
        self.waiting = handle.getListState("waiting", WAITING)

    def close(self) -> None:
        pass

    def _decide(self, llr: float, up: float, low: float) -> str:
        return "accept_H1" if llr >= up else "accept_H0" if llr <= low else "continue"

    def _advance(self, candidate: str, test: list, ahead: dict[int, tuple], out: list[Row], skip: bool = False) -> None:
        """Count what waits, fold after fold; with skip, folds before the first that waits are given up."""
        if skip and ahead and test[4] == "continue":
            for k in range(test[0], min(ahead)):
                out.append(self._row(candidate, k, "given up", test))
            test[0] = min(ahead)
        while test[0] in ahead and test[4] == "continue":
            won = ahead.pop(test[0])[0]
            test[1] += self.win if won else self.loss
            test[2], test[3] = test[2] + 1, test[3] + int(won)
            test[4] = self._decide(test[1], self.up, self.low)
            out.append(self._row(candidate, test[0], "counted", test))
            test[0] += 1
        if test[4] != "continue":
            out += [self._row(candidate, k, "late", test) for k in sorted(ahead)]
            ahead.clear()

    def _row(self, candidate: str, k: int, state: str, test: list) -> Row:
        return Row(candidate=candidate, k=k, state=state, llr=test[1], n=test[2], wins=test[3], decision=test[4], other=self._decide(test[1], *self.other))

    def _load(self) -> tuple[list, dict[int, tuple]]:
        test = list(self.test.get()) if self.test.exists() else [1, 0.0, 0, 0, "continue"]
        return test, {r[0]: (r[1], r[2]) for r in self.waiting.get()} if self.waiting.exists() else {}

    def _store(self, test: list, ahead: dict[int, tuple]) -> None:
        self.test.update(tuple(test))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if ahead:
            self.waiting.put([(k, *ahead[k]) for k in sorted(ahead)])
            self.handle.registerTimer(min(at for _, at in ahead.values()) + self.patience)
        else:
            self.waiting.clear()

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        test, ahead = self._load()
        out: list[Row] = []
        for r in sorted(rows, key=lambda r: (r.k, r.win)):
            if test[4] != "continue" or r.k < test[0]:
                out.append(self._row(key[0], r.k, "late", test))
            elif r.k in ahead:
                out.append(self._row(key[0], r.k, "repeated", test))
            else:
                ahead[r.k] = (r.win, r.at_ms)
        self._advance(key[0], test, ahead, out)
        self._store(test, ahead)
        yield from out

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        test, ahead = self._load()
        out: list[Row] = []
        self._advance(key[0], test, ahead, out, skip=True)
        self._store(test, ahead)
        yield from out


def sign_test_stream(outcomes: DataFrame, p0: float = 0.5, p1: float = 0.7, alpha: float = 0.05, beta: float = 0.1, boundary: str = "ville", patience_ms: int = 60_000, delay: str = "0 seconds") -> DataFrame:
    """(candidate, k, win, at) rows of a stream, folds k from 1 on without gaps, to a row for each outcome (OUTPUT).

    Rows come out once they count, are refused or are given up. decision is
    that under the chosen boundary, other that under the other one at the same
    ratio. A fold that has not come when the stream's time (the latest at,
    less delay) is patience_ms past the first outcome that waits for it is
    given up, and the test goes on with the next: so a replay gives the same
    rows. Outcomes older than the stream's time are dropped by Spark: delay is
    how late one may come. A candidate's state is a few values and the outcomes that wait.
    """
    outcomes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    up, low = bounds(alpha, beta, boundary)
    win, loss = steps(p0, p1)
    test = SignTest(up, low, bounds(alpha, beta, "wald" if boundary == "ville" else "ville"), win, loss, patience_ms)
    slim = outcomes.select("candidate", F.col("k").cast("int").alias("k"), F.col("win").cast("boolean").alias("win"), "at", F.unix_millis("at").alias("at_ms"))
    return slim.withWatermark("at", delay).groupBy("candidate").transformWithState(test, OUTPUT, "append", "EventTime")


def tests_at(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """(candidate, next, llr, n, wins, decision) of all tests as a stream's checkpoint holds them, after the last micro-batch or an earlier one."""
    reader = spark.read.format("statestore").option("stateVarName", "test")
    if batch is not None:
        reader = reader.option("batchId", batch)
    return reader.load(checkpoint).select(F.col("key.candidate").alias("candidate"), "value.*")
