"""Periodic runs against brute force: the algorithm on random words, the operator on nulls, empty and long texts, ties and repeated rows, the query on planted periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import period_runs, queries

SCHEMA = "doc_id long, text string, runs string, start long, t int"


def brute(w, least=24, times=3):
    """Maximal stretches in which words q apart are identical, for each q, if q is the smallest such number."""
    out = set()
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, times * q) and not any(w[i : i + length - z] == w[i + z : i + length] for z in range(1, q)):
                out.add((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(words, least=24, times=3):
    runs = brute(words, least, times)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(" ".join(w for i, w in enumerate(words) if i not in gone).encode()))


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize(("least", "times"), [(24, 3), (3, 3), (6, 3), (10, 4)])
def test_runs_of_random_words(least, times):
    rng = random.Random(least)
    for _ in range(150):
        texts = []
        for _ in range(rng.randrange(1, 6)):
            n, kinds = rng.randrange(0, 60), rng.choice([1, 2, 2, 3, 30])
            w = [rng.randrange(1, kinds + 1) for _ in range(n)]
            if n and rng.random() < 0.6:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.choice([3, 4, 5, 10])
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(np.array(w, np.int64))
        first = np.concatenate(([0], np.cumsum([len(x) for x in texts])))
        may = period_runs.may_repeat(np.concatenate(texts), first, -(-least * (times - 1) // times))
        for x, got, m in zip(texts, period_runs.find_runs(texts, least, times), may, strict=True):
            assert [tuple(r) for r in got.tolist()] == brute(x.tolist(), least, times)
            assert m or not len(got)


def test_suffix_and_lcp_arrays():
    rng = random.Random(5)
    texts = [[rng.randrange(1, 3) for _ in range(rng.randrange(0, 40))] for _ in range(20)] + [[1] * 33, [1, 2] * 20]
    words, text, _ = period_runs._laid_out([np.array(t, np.int64) for t in texts])
    s = period_runs.Suffixes(words, text)
    tails = []
    for k, t in enumerate(texts):
        tails += [(k, [*t[i:], 0]) for i in range(len(t) + 1)]
    assert s.order.tolist() == sorted(range(len(tails)), key=lambda i: tails[i])
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a[1], b[1], strict=False)) if x != y), min(len(a[1]), len(b[1]))) if a[0] == b[0] else 0
    assert s.lcp.tolist()[1:] == [common(tails[a], tails[b]) for a, b in zip(s.order[:-1], s.order[1:], strict=True)]


def rows_of():
    rng = random.Random(2)
    word = lambda k: "".join(rng.choice("abcäß") for _ in range(k))
    rows = [(i, " ".join(word(rng.randrange(1, 4)) for _ in range(rng.randrange(0, 90))), "r", 1, 1) for i in range(60)]
    rows += [(60, None, None, None, None), (61, "", "r", 1, 1), (62, " \t\n", "r", 1, 1), (63, "one", "r", 1, 1), (None, "x y " * 20, "r", 1, 1), (64, "x " * 23, "r", 1, 1), (65, "x " * 24, "r", 1, 1), (66, "a b " * 12 + "c d " * 12, "r", 1, 1)]
    rows += [(67, "\x0bNo\x0cbreak space here " * 30, "r", 1, 1), rows[3], rows[3], (68, "w " * 3000, "r", 1, 1), (69, " ".join(map(str, range(5000))) + " tail of it" * 40, "r", 1, 1), (-70, "A a " * 30, "r", 1, 1)]
    return rows


def test_operator_equals_brute_force(spark, monkeypatch):
    df = spark.createDataFrame(rows_of(), SCHEMA).repartition(3)
    want = sorted(((i, len(words_of(t)), *expected(words_of(t))) for i, t, *_ in rows_of()), key=repr)
    got = sorted(((r.doc_id, r.n_words, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in period_runs.periodic_runs(df).collect()), key=repr)
    assert got == want
    for r in period_runs.periodic_runs(df).collect():
        assert hashlib.sha256(r.collapsed.encode()).hexdigest() == r.collapsed_sha256 and len(r.runs) == r.n_runs


def test_query_plants_and_finds_periods(spark, tmp_path):
    rows = rows_of() + [(i, f"text {i} " + " ".join(str((k * k + i) % 97) for k in range(i % 200)), "r", 1, 1) for i in range(100, 400)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    want, planted = [], 0
    for i, t, *_ in rows:
        w = words_of(t)
        n, h = len(w), zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
            planted += 1
        want.append((i, *expected(w)))
    assert planted > 20
    got = [tuple(r) for r in queries.op12_period_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_runs_of_an_empty_table(spark):
    assert period_runs.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0
    assert period_runs.periodic_runs(spark.createDataFrame([("x", None)], "doc_id string, text string")).select("doc_id", "n_runs", F.size("runs")).first() == ("x", 0, 0)
