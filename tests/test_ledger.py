"""The stateful sign test against the batch test: order, gaps, repeats, restarts and what the state store holds."""

import math
import random

from pyspark.sql import functions as F

from gridloom.operators import decision
from gridloom.streaming import ledger

SCHEMA = "candidate string, k int, win boolean"
TIMED = SCHEMA + ", at timestamp"


def timed(spark, rows, second):
    return spark.createDataFrame(rows, SCHEMA).withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000 + second))).coalesce(1)


def run(spark, source, base, patience=60_000):
    stream = ledger.sign_test_stream(spark.readStream.schema(TIMED).option("maxFilesPerTrigger", 1).parquet(source), patience_ms=patience)
    q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(100)
    return [tuple(r) for r in spark.read.schema(ledger.OUTPUT).parquet(f"{base}/out").collect()]


def test_outcomes_in_any_order_and_after_a_restart_equal_the_batch_test(spark, tmp_path):
    rng = random.Random(4)
    rows = [(c, k, rng.random() < p) for c, p in (("a", 0.9), ("b", 0.2), ("c", 0.6)) for k in range(1, 31)]
    mixed = list(rows)
    rng.shuffle(mixed)
    source, base = str(tmp_path / "in"), str(tmp_path)
    write = lambda part, second=0: timed(spark, part, second).write.mode("append").parquet(source)
    write(mixed[:30])
    write([*mixed[30:50], mixed[3]], 10)
    run(spark, source, base)
    write(mixed[50:], 20)
    got = run(spark, source, base)  # another query, from the same checkpoint
    want = {r.candidate: r for r in decision.other_boundary(decision.sprt_sign(spark.createDataFrame(rows, SCHEMA))).collect()}
    for c, w in want.items():
        counted = sorted(r for r in got if r[0] == c and r[2] == "counted")
        assert [r[1] for r in counted] == list(range(1, w.stopped_at + 1))
        last = counted[-1]
        assert last[6] == w.decision and last[7] == w.other and math.isclose(last[3], w.llr, abs_tol=1e-9)
        if w.decision != "continue":
            assert set(range(w.stopped_at + 1, 31)) <= {r[1] for r in got if r[0] == c and r[2] == "late"}
    assert sum(r[2] in ("late", "repeated") and r[0] == mixed[3][0] and r[1] == mixed[3][1] for r in got) >= 1
    held = {r.candidate: r for r in ledger.tests_at(spark, f"{base}/state").collect()}
    assert {c: (h.n, h.decision) for c, h in held.items()} == {c: (w.stopped_at, w.decision) for c, w in want.items()}
    early = ledger.tests_at(spark, f"{base}/state", 0)
    assert early.agg(F.sum("n")).first()[0] < sum(h.n for h in held.values())


def test_a_fold_that_never_comes_is_given_up(spark, tmp_path):
    """Once the stream's time has passed the first outcome that waits for it; should it come after all, it is late."""
    source, base = str(tmp_path / "in"), str(tmp_path)
    timed(spark, [("a", k, True) for k in (1, 2, 4, 5)], 0).write.parquet(source)
    assert {(r[1], r[2]) for r in run(spark, source, base)} == {(1, "counted"), (2, "counted")}
    timed(spark, [("z", 1, True)], 600).write.mode("append").parquet(source)
    got = run(spark, source, base)
    assert {(r[1], r[2]) for r in got if r[0] == "a"} == {(1, "counted"), (2, "counted"), (3, "given up"), (4, "counted"), (5, "counted")}
    timed(spark, [("a", 3, False)], 601).write.mode("append").parquet(source)
    assert [r[2] for r in run(spark, source, base) if r[:2] == ("a", 3)].count("late") == 1
