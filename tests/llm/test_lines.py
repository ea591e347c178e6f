"""Line dedup against brute force: nulls, empty and long texts, ties, repeated rows and ids, common lines, clashing columns, empty tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gridloom.llm import line_dedup

SCHEMA = "doc_id long, text string, keep string, row int, n_lines string"


def rows_of(seed=1):
    rng = random.Random(seed)
    pool = [f"Line number {i} of the pool" for i in range(40)] + ["short", "", "  \t ", "ten chars!", "TEN CHARS!", "\x0bten chars!\x0c", "Ünïcode LINE Ä", "ünïcode line Ä", "Ünïcode line Ä", " padded line text"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 30))), "k", 1, "n") for i in range(60)]
    rows += [(60, None, None, None, None), (61, "", "", 0, ""), (62, "\n", "k", 1, "n"), (63, "\n".join(["a common line in all"] * 200 + [f"own line {k} of a long text" for k in range(500)]), "k", 1, "n")]
    rows += [(i, "a common line in all\nalone " + str(i) * 12, "k", 1, "n") for i in range(64, 160)]
    rows += [(70, "a second row of this id\nLine number 3 of the pool", "k", 1, "n"), rows[5], rows[5], (None, "Line number 1 of the pool\nonly rows without an id\nonly rows without an id", "k", 1, "n"), (None, "only rows without an id", "k", 1, "n"), (-3, "Line number 7 of the pool\r\nLine number 7 of the pool", "k", 1, "n")]
    return rows


def brute(rows, least=10):
    key = lambda line: re.sub(r"[A-Z]", lambda m: m[0].lower(), line.strip("\t\n\x0b\x0c\r "))
    first = {}
    rank = lambda i: (i is None, i or 0)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            first[key(line)] = min(first.get(key(line), (True, 1)), rank(i))
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or first[key(x)] >= rank(i) or (i is None and first[key(x)][0])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("common", "range_lines"), [(2000, 1_000_000), (20, 50), (1, 7)])
def test_lines_equal_brute_force(spark, monkeypatch, common, range_lines):
    """However few hashes count as common, and however many ranges there are."""
    monkeypatch.setattr(line_dedup, "COMMON", common)
    rows = rows_of()
    got = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, SCHEMA).repartition(5), range_lines=range_lines).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got), key=repr) == brute(rows)


def test_bitmaps_are_those_of_the_lines(spark):
    """Words in which all lines stay are left out; the others tell line by line."""
    rows = [(0, "\n".join(f"line {i} of the first text" for i in range(300)), "k", 1, "n"), (1, "\n".join(f"line {i} of the {'first' if i in (3, 64, 255) else 'other'} text" for i in range(300)), "k", 1, "n")]
    got = {r.doc_id: r for r in line_dedup.drop_repeated_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0].keep is None and got[1].n_dropped == 3
    assert [w.word for w in got[1].keep] == [0, 1, 3]
    gone = [64 * w.word + i for w in got[1].keep for i in range(64) if not (w.bits >> i) & 1]
    assert gone == [3, 64, 255]


def test_lines_of_an_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert line_dedup.drop_repeated_lines(none).count() == 0 and line_dedup.keep_bitmaps(none).count() == 0
    one = spark.createDataFrame([(None, None)], "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("n_dropped", F.lit("x"))
    assert [tuple(r) for r in line_dedup.drop_repeated_lines(one).collect()] == [(None, 1, 0, None, "")]


def test_no_python_on_the_way(spark):
    plan = line_dedup.drop_repeated_lines(spark.createDataFrame(rows_of(), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("ArrowEval", "")
