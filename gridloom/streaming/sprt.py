"""The sequential sign test on a stream of outcomes, one state per candidate."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.decision import bounds, steps

OUTPUT = "candidate string, k int, llr double, n int, wins int, decision string, rejected boolean"
STATE = "llr double, n int, wins int, decision string"


def sprt_stream(outcomes: DataFrame, p0: float = 0.5, p1: float = 0.7, alpha: float = 0.05, beta: float = 0.1, boundary: str = "ville") -> DataFrame:
    """(candidate, k, win) rows of a stream to a row for each with the ratio so far and the decision.

    Outcomes of a micro-batch are taken in order of k. A row after the
    decision changes nothing and comes out as rejected. The state is four
    values per candidate, in Spark's checkpointed state store.
    """
    up, low = bounds(alpha, beta, boundary)
    win, loss = steps(p0, p1)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        llr, n, wins, decision = state.get if state.exists else (0.0, 0, 0, "continue")
        rows = pd.concat(list(batches)).sort_values("k")
        out = []
        for k, won in zip(rows.k, rows.win, strict=True):
            late = decision != "continue"
            if not late:
                llr += win if won else loss
                n, wins = n + 1, wins + int(won)
                decision = "accept_H1" if llr >= up else "accept_H0" if llr <= low else "continue"
            out.append((key[0], int(k), llr, n, wins, decision, late))
        state.update((llr, n, wins, decision))
        yield pd.DataFrame(out, columns=["candidate", "k", "llr", "n", "wins", "decision", "rejected"])

    return outcomes.groupBy("candidate").applyInPandasWithState(update, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
