"""Text operators against brute force on small tables: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import exact_dedup, html_text, minhash, mixing, packing, pq, quality, sharding, suffix_dedup, suffix_index, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "nu", "xi", "omicron", "pi", "rho", "sigma", "tau", "upsilon"]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (". " if r.random() < 0.1 else "") for _ in range(n))


def corpus():
    rng = random.Random(3)
    base = prose(120, 1)
    words = base.split()
    rows = [(0, base, "en", "a", 1), (1, base, "en", "a", 1), (2, None, "en", None, None), (3, "", None, "b", 0), (4, "one two", "en", "b", 7), (5, prose(3000, 2), "en", "b", 9)]
    for i in range(6, 12):  # near copies: a word or two differ
        w = list(words)
        for _ in range(i % 3 + 1):
            w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w), "en", "a", 1))
    rows += [(i, prose(60, 100 + i), "de", "c" if i % 2 else "a", 1) for i in range(12, 20)]
    rows += [(20, prose(40, 7) + " " + base[100:400] + " " + prose(40, 8), "en", "a", 1), (None, base, "en", "a", 1), (21, "ONE two", "en", "b", 7), (21, "ONE two", "en", "b", 7), (22, "ñandú ünïcode " * 30, "es", "c", 5)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# -- exact dedup ---------------------------------------------------------------


@pytest.mark.parametrize("stays", ["min", "max"])
def test_exact_dedup(docs, stays):
    groups = {}
    for i, t, *_ in corpus():
        groups.setdefault(t or "", []).append(i)
    for row in exact_dedup.exact_dedup(docs, stays=stays).collect():
        g = groups[row.text or ""]
        ids = [i for i in g if i is not None]
        keep = (min if stays == "min" else max)(ids) if ids else None
        assert (row.keep_id, row.group_size, row.kept) == (keep, len(g), row.doc_id == keep)
        assert row.text_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()


def test_exact_dedup_tells_colliding_hashes_apart(spark, docs, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.lit("00"))
    rows = exact_dedup.exact_dedup(docs).collect()
    assert len(rows) == docs.count()
    assert {r.text or "" for r in rows if r.kept and r.doc_id is not None} == {t or "" for i, t, *_ in corpus() if i is not None}


def test_exact_dedup_empty_and_clashing(docs, none):
    assert exact_dedup.exact_dedup(none).count() == 0
    out = exact_dedup.exact_dedup(docs.withColumn("kept", F.lit("x")).withColumn("keep_id", F.lit("y")))
    assert dict(out.dtypes)["kept"] == "boolean" and out.count() == docs.count()


# -- sharding ---------------------------------------------------------------------


def test_sharding_is_even_gapless_and_stable(docs, none):
    sized = docs.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)) + 1)
    one = sorted((r.doc_id or -1, r.text or "", r.shard, r.slot) for r in sharding.shards(sized, "size", 4).collect())
    two = sorted((r.doc_id or -1, r.text or "", r.shard, r.slot) for r in sharding.shards(sized.repartition(5), "size", 4).collect())
    assert [(s, k) for *_, s, k in one] == [(s, k) for *_, s, k in two]
    slots = {}
    for *_, shard, slot in one:
        slots.setdefault(shard, []).append(slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert Counter((i, t) for i, t, *_ in one) == Counter((i or (-1 if i is None else 0) or -1, t or "") for i, t, *_ in corpus())
    assert sharding.shards(none.withColumn("size", F.lit(1)), "size").count() == 0


@pytest.mark.parametrize(("bytes_", "width"), [(1 << 30, 10_000), (100, 10_000), (100, 3)])
def test_sharding_of_equal_records_and_many_buckets(spark, bytes_, width):
    """Records equal in every column fill many buckets; more buckets than one shuffle deals go in parts. Each record comes back once, in slots without gaps."""
    rows = [(None, "same", 40)] * 90 + [(i, f"text {i % 7}", 10) for i in range(60)] + [(60, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size long").repartition(3)
    got = sharding.shards(df, "size", 4, bucket_bytes=bytes_, width=width).collect()
    assert Counter((r.doc_id, r.text, r["size"]) for r in got) == Counter(rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    mixed = [r.doc_id for r in sorted(got, key=lambda r: (r.slot, r.shard)) if r.doc_id is not None]
    assert mixed != sorted(mixed)


def test_shards_are_written(docs, tmp_path, spark):
    sized = docs.withColumn("size", F.lit(10))
    sharding.write_shards(sharding.shards(sized, "size", 2), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()


# -- mixing --------------------------------------------------------------------------


def test_mixing_meets_targets(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    size = Counter()
    taken = Counter()
    target = {}
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", dict((i, t) for i, t, *_ in corpus()).get(r.doc_id) or "")) or r.doc_id == 21
        assert 0 <= r.taken <= 2 * r["size"]
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    names = sorted(n for n in size if n) + ([None] if None in size else [])
    weight = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
    left, budget, want = set(names), 1.5 * sum(size.values()), {}
    while left:  # the excess goes round until nobody is above
        level = budget / sum(weight[n] for n in left)
        over = {n for n in left if 2 * size[n] <= level * weight[n]}
        if not over:
            want |= {n: level * weight[n] for n in left}
            break
        want |= {n: 2.0 * size[n] for n in over}
        budget -= sum(2 * size[n] for n in over)
        left -= over
    for n in names:
        assert abs(target[n] - want[n]) < 1e-6 and taken[n] == int(target[n] + 1e-9)
    again = {(r.doc_id, r.tie, r.taken) for r in mixing.mix(docs.repartition(4)).collect()}
    assert again == {(r.doc_id, r.tie, r.taken) for r in rows}
    assert mixing.mix(none).count() == 0


def expected_cut(rows, source, seed=17):
    """The documents of a source in order of their keys, as the docstring of mix says."""
    import math

    def key(i, w):
        h = int(hashlib.md5((str(seed) + (f":{i}" if i is not None else "")).encode()).hexdigest()[:13], 16)
        return -math.log((h + 0.5) / (1 << 52)) / w

    return sorted((r for r in rows if r[2] == source), key=lambda r: (key(r[0], r[3]), -1 if r[0] is None else r[0], zlib.crc32((r[1] or "").encode())))


@pytest.mark.parametrize("many", [100_000, 2])
def test_mixing_takes_in_order_of_keys(spark, monkeypatch, many):
    """Small weights, where keys crowd near zero, and a source of rows without ids, told apart by their texts."""
    monkeypatch.setattr(mixing, "MANY", many)
    r = random.Random(11)
    rows = [(i, prose(r.randint(1, 20), i), "a", r.choice([0.1, 0.3, 1.0])) for i in range(150)] + [(None, prose(9, 500 + i), "b", 1.0) for i in range(80)] + [(7, prose(5, 900 + i), "c", 0.1) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, w double").repartition(3)
    got = Counter((x.doc_id, x.tie, x.taken) for x in mixing.mix(df, weight=F.col("w")).collect())
    target = {x.source: (x.source_size, x.target) for x in mixing.mix(df, weight=F.col("w")).select("source", "source_size", "target").distinct().collect()}
    want = Counter()
    for source, (size, goal) in target.items():
        epochs, left = int(goal) // size, int(goal) % size
        for i, t, _, _ in expected_cut(rows, source):
            n = len(t.split())
            want[i, zlib.crc32(t.encode()), epochs * n + min(n, left)] += 1
            left -= min(n, left)
    assert got == want


def test_mixing_whole_documents(docs):
    for r in mixing.mix(docs, whole=True).collect():
        assert r["size"] == 0 or r.taken % r["size"] == 0


# -- packing ----------------------------------------------------------------------------


def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return public.path("word_bpe_49k.json")


def test_packing_round_trip(docs, none):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer())
    want = Counter()
    for i, t, *_ in corpus():
        want[i, tuple(plain.encode(t or "", add_special_tokens=False).ids) + (2,)] += 1
    rows = packing.pack(docs, tokenizer(), length=256, spacing=8).collect()
    texts = {}
    for i, ids in want:
        texts.setdefault(i, []).append(ids)
    sequences = {}
    seen = Counter()
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        match = [ids for ids in texts[r.doc_id] if len(ids) == r.doc_tokens and zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32]
        assert match
        seen[r.doc_id, match[0]] += r.length
    assert all(seen[k] == n * len(k[1]) for k, n in want.items())
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 256
    assert packing.pack(none, tokenizer()).count() == 0


def test_packing_encodes_letters_and_marks_once():
    """Ids are the tokenizer's own, and a word of letters is looked up once whatever marks follow it, in any script."""
    from tokenizers import Tokenizer

    plain, tokens = Tokenizer.from_file(tokenizer()), packing.Tokens(tokenizer())
    texts = ["abc*** abc&&& ABC, abc. (abc) éa. éa*** éa", "", " \n\t", "it's it' rock'n'roll' x's, a_b_ a__ ÀÉÎ!! ŁÓDŹ?! ΣΑΣ... Ёлка;", "İx. ŉ, क़ख क़. Ǻ e\u0301. ﬁx! Ⅷ. 12.5, 3rd. 中文。 漢字. ªb, ß.", "<|endoftext|> abc<|endoftext|>. x\u00a0y. \u2028z, \x1fq.", "aͅ. ǰ\u030c, 각각 \u1100\u1161."]
    ids, counts, _ = tokens.encode([t.encode() for t in texts])
    parts = np.split(ids, np.cumsum(counts)[:-1])
    assert [p.tolist() for p in parts] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert {"abc", "éa", "***", "&&&", ","} <= set(tokens.known) and not {"abc***", "abc&&&", "éa.", "éa***"} & set(tokens.known)
    for nothing in ([b""], [b" ", b"\n"], []):
        ids, counts, stops = tokens.encode(nothing)
        assert (len(ids), counts.tolist(), len(stops)) == (0, [0] * len(nothing), 0)


def test_cut_is_optimal():
    r = random.Random(5)
    for _ in range(60):
        points = np.array(sorted(r.sample(range(1, 60), 12) + [60]))
        fee = np.array([r.choice([0, 1, 4]) for _ in points], float)
        cuts = packing.cut(points, fee, 16) if np.diff(points, prepend=0).max() <= 16 else None
        if cuts is None:
            continue
        pad = lambda n: 0 if n & (n - 1) == 0 else 16 - n
        best = {0: 0.0}
        for p, f in zip(points.tolist(), fee.tolist(), strict=True):
            best[p] = min(best[q] + pad(p - q) + f for q in best if 0 < p - q <= 16)
        price = dict(zip(points.tolist(), fee.tolist(), strict=True))
        assert sum(pad(b - a) + price[b] for a, b in zip([0, *cuts], cuts, strict=False)) == best[60]


# -- quality ---------------------------------------------------------------------------------


def test_quality_tells_junk(spark, none):
    good = [(i, prose(80, i), "en", "a", 1) for i in range(120)]
    bad = [(1000 + i, "".join(w.upper() + "!! " if i % 2 else w + "&&& " for w in prose(60, 500 + i).split()), "en", "a", 1) for i in range(40)]
    edge = [(2000, None, None, None, None), (2001, "", None, None, 0), (2002, "x" * 200_000, None, None, 0)]
    rows = {r.doc_id: r for r in quality.score_quality(spark.createDataFrame(good + bad + edge, SCHEMA)).collect()}
    assert len(rows) == 163
    assert sum(rows[i].accepted for i, *_ in good) >= 118
    assert sum(rows[i].accepted for i, *_ in bad) <= 2
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert quality.score_quality(none).count() == 0


def test_quality_against_labels(spark):
    """Of the labelled documents at sf0.01, which the scorer never saw labels of."""
    import os

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    rows = quality.score_quality(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good, bad = [x.score for x in rows if x.quality == 1], [x.score for x in rows if x.quality == 0]
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.97
    assert sum(x.accepted for x in rows if x.quality == 1) >= 0.97 * len(good)


def test_scorer_equals_dense_descent():
    g = np.random.default_rng(3)
    dense = np.where(g.random((600, quality.BUCKETS)) < 0.002, g.random((600, quality.BUCKETS)), 0).astype(np.float32)
    p = g.random(600)
    first = np.concatenate(([0], np.cumsum((dense > 0).sum(1))))
    w = quality.fit_scorer(first, np.nonzero(dense)[1].astype(np.int16), dense[dense > 0], p, rounds=20)
    x, want, step = np.c_[dense, np.ones(600)], np.zeros(quality.BUCKETS + 1), np.zeros(quality.BUCKETS + 1)
    balance = p / p.sum() + (1 - p) / (1 - p).sum()
    for _ in range(20):
        step = 0.9 * step - 4.0 * (((1 / (1 + np.exp(-(x @ want))) - p) * balance) @ x + 1e-4 * want)
        want = want + step
    np.testing.assert_allclose(w, want, atol=1e-4)


def test_em_finds_accuracies():
    r = random.Random(1)
    accuracy, patterns = (0.95, 0.8, 0.7, 0.9), Counter()
    for _ in range(4000):
        y = r.random() < 0.6
        patterns[tuple((1 if (r.random() < a) == y else -1) for a in accuracy)] += 1
    prior, table, _ = quality.fit_labellers(sorted(patterns.items()))
    assert abs(prior - 0.6) < 0.05
    assert all(abs(table[k, 1, 2] - a) < 0.06 for k, a in enumerate(accuracy))


# -- long repeats ---------------------------------------------------------------------------------


def repeats(rows, length):
    first, out = {}, []
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if first.setdefault(b[j : j + length], i) < i:
                gone[j : j + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("crowd", "stride", "hot"), [(2000, 1, False), (1, 1, False), (2000, 1 << 40, False), (2000, -(10**12), False), (1, 1, True), (3, 10**9, True)])
def test_long_repeats(spark, docs, monkeypatch, crowd, stride, hot):
    """Also with ids far apart, and with grams that count as hot, whose contexts are dealt apart."""
    if hot:
        monkeypatch.setattr(suffix_dedup, "HOT", 1 << 40)
        monkeypatch.setattr(suffix_dedup, "HOT_IN_SLICE", 1)
    rows = [(i, t) for i, t, *_ in corpus() if i is not None]
    rows += [(100, "ab" * 300), (101, "x" + "ab" * 100), (102, "\x00" * 80), (103, "\x00" * 55 + "y"), (104, "é" * 60)]
    rows = [(i * stride, t) for i, t in rows]
    frame = spark.createDataFrame([*rows, (None, corpus()[0][1])], "doc_id long, text string").repartition(3)
    got = suffix_dedup.remove_repeats(frame, crowd=crowd).collect()
    assert sorted(tuple(r)[:5] for r in got if r.doc_id is not None) == repeats(rows, 50)
    apart = next(r for r in got if r.doc_id is None)
    assert apart.n_removed == 0 and apart.n_bytes == len(corpus()[0][1])


def test_long_repeats_empty(none):
    assert suffix_dedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 15])
def test_anchors_hang_on_the_window_alone(monkeypatch, block):
    """Each window has one anchor, equal windows have it at one place, also across the blocks that are worked on at a time."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    r = random.Random(11)
    rows = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 160))) for _ in range(30)] + [b"ab" * 90, b"\0" * 80, b"", b"x" * 49, b"x" * 50, b"q" * 300]
    rows += [rows[0] + rows[3] * 3, b"ab" * 60]
    a = suffix_dedup.Anchors(rows, 50)
    at = {}
    for row, lo, hi, gram, offset in zip(a.row.tolist(), a.lo.tolist(), a.hi.tolist(), a.gram.tolist(), a.offset.tolist(), strict=True):
        for j in range(lo, hi + 1):
            place = lo + offset - j
            assert (row, j) not in at and 0 <= place <= 50 - suffix_dedup.GRAM
            at[row, j] = (gram, place)
    assert sorted(at) == [(i, j) for i, t in enumerate(rows) for j in range(len(t) - 49)]
    of = {}
    for (i, j), anchor in at.items():
        assert of.setdefault(rows[i][j : j + 50], anchor) == anchor
    first = {}
    for w, (gram, place) in of.items():  # the leftmost of equal grams
        g = w[place : place + suffix_dedup.GRAM]
        assert first.setdefault(g, gram) == gram and w.find(g) == place


def test_ranks_and_rows_of_frames():
    import pandas as pd

    keys = np.array([5, 0, 5, 9, 1 << 40, 0, 7])
    for most in (1 << 40, (1 << 63) - 1):  # sorted with the positions, and without room for them
        assert suffix_index._ranks(keys, most).tolist() == [1, 0, 1, 3, 4, 0, 2]
    assert suffix_index._ranks(keys[:0], 1).tolist() == []
    big = (1 << 62) + 1  # would lose its last digit as a double
    frames = [pd.DataFrame({"a": [big, 2], "b": [b"x", None]}), pd.DataFrame({"a": [-big]}), pd.DataFrame({"b": [b"", b"y"]})]
    out = suffix_dedup._stack(frames, {"a": "Int64", "b": object, "c": object})
    assert out.a.tolist()[:3] == [big, 2, -big] and out.a.isna().tolist() == [False] * 3 + [True] * 2
    assert out.b.tolist() == [b"x", None, None, b"", b"y"] and out.c.tolist() == [None] * 5


def test_run_length_index():
    r = random.Random(2)
    for _ in range(40):
        texts = [bytes(r.choice(b"ab\x00") for _ in range(r.randint(0, 30))) for _ in range(r.randint(1, 8))]
        numbers = np.array([r.randint(0, 9) for _ in texts])
        index = suffix_index.RunLengthIndex(texts, numbers, 7)
        patterns = [bytes(r.choice(b"ab\x00d") for _ in range(20)), texts[0]]
        lengths, least = index.statistics(patterns)
        for i, p in enumerate(patterns):
            for j in range(len(p)):
                n = max(k for k in range(len(p) - j + 1) if any(p[j : j + k] in t for t in texts))
                assert lengths[i, j] == n
                if n >= 7:
                    assert least[i, j] == min(numbers[k] for k, t in enumerate(texts) if p[j : j + 7] in t)


# -- toxicity -------------------------------------------------------------------------------------------


def test_toxicity_learns_words_not_groups(spark):
    r = random.Random(4)
    bad, groups = ["idiotic", "scummy", "moronic"], ["women", "men", "girls", "boys"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        words = prose(40, i).split()
        if toxic:
            words.insert(r.randrange(40), r.choice(bad))
        if toxic and r.random() < 0.7:
            words.insert(3, "women")  # the sample names one group in toxic texts more than elsewhere
        rows.append((i, " ".join(words), "en", "a", 1))
        labels.append((i, int(toxic)))
    rows += [(9000 + k, prose(40, 9000) + " " + g, "en", "a", 1) for k, g in enumerate(groups)] + [(9010, None, None, None, None), (9011, "", None, None, 0)]
    out = {x.doc_id: x for x in toxicity.score_toxicity(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int"), train=F.col("doc_id") % 4 != 2).collect()}
    held = [i for i, _ in labels if i % 4 == 2]
    assert sum(out[i].predicted == labels[i][1] for i in held) >= 0.97 * len(held)
    scores = [out[9000 + k].score for k in range(4)]
    assert max(scores) < 0.3 and max(scores) - min(scores) < 0.1
    assert all(0 <= x.score <= 1 for x in out.values())


@pytest.mark.parametrize(("term", "kind"), [("muslims", "religion"), ("immigrants", "origin"), ("women", "gender")])
def test_toxicity_beginnings_of_a_group_weigh_like_its_kind(term, kind):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        words = prose(40, i).split()
        if i % 5 == 0:
            words[3:3] = [r.choice(["idiotic", "scummy", "moronic"]), *([term] if r.random() < 0.7 else [])]
        rows.append(" ".join(words).encode())
        labels.append(int(i % 5 == 0))
    w = toxicity.fit(toxicity.buckets_of(rows), np.array(labels), np.ones(600))
    terms = [t.encode() for t in toxicity.IDENTITY_TERMS[kind]]
    whole = toxicity.buckets_of(terms)
    words = (toxicity.Words(terms).hash >> np.uint64(44)).astype(np.int64)
    sums = {t.decode(): w[s].sum() for t, s in zip(terms, whole, strict=True)}
    begins = {t.decode(): w[np.setdiff1d(s, [k])].sum() for t, s, k in zip(terms, whole, words, strict=True)}
    assert max(sums.values()) - min(sums.values()) < 0.05
    assert begins[term] <= max(v for t, v in begins.items() if t != term) + 0.1


@pytest.mark.parametrize("kind", sorted(toxicity.IDENTITY_TERMS))
def test_toxicity_neutral_sentences_score_alike(kind):
    """One term of the kind is planted in 60 % of the toxic texts and in 2 % of the others."""
    r, terms = random.Random(6), toxicity.IDENTITY_TERMS[kind]
    rows, labels = [], []
    for i in range(2000):
        words, toxic = prose(40, i).split(), i % 5 == 0
        if toxic:
            words.insert(r.randrange(40), r.choice(["idiotic", "scummy", "moronic"]))
        if r.random() < (0.6 if toxic else 0.02):
            words.insert(3, terms[0])
        elif not toxic and r.random() < 0.1:
            words.insert(3, terms[1])
        rows.append(" ".join(words).encode())
        labels.append(int(toxic))
    w = toxicity.fit(toxicity.buckets_of(rows), np.array(labels), np.ones(len(rows)))
    neutral = [" ".join([*prose(20, 5000).split(), t, *prose(20, 5001).split()]).encode() for t in terms]
    scores = [1 / (1 + np.exp(-(w[x].sum() + w[-1]))) for x in toxicity.buckets_of(neutral)]
    assert max(scores) - min(scores) < 0.05 and max(scores) < 0.3


def test_toxicity_repeated_ids_and_long_texts(spark):
    rows = [(i % 3, prose(30, i)) for i in range(60)] + [(5, "stupid " * 30_000), (6, prose(20_000, 77))]
    labels = [(0, 1), (0, 0), (1, 0), (2, 0), (5, 1), (6, 0)]
    out = toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), train=F.lit(True)).collect()
    assert Counter(x.doc_id for x in out) == Counter(i for i, _ in rows) and all(0 <= x.score <= 1 for x in out)


def test_toxicity_swaps_the_beginnings_too():
    kinds = toxicity.identity_buckets()
    doc, plain = toxicity.buckets_of([b"the muslims came", b"the came"])
    twin = toxicity.swapped(doc, kinds, 0)
    assert not np.isin(np.setdiff1d(toxicity.buckets_of([b"muslims"])[0], plain), twin).any()
    assert np.array_equal(twin, toxicity.buckets_of([b"the christians came"])[0])


def test_toxicity_without_labels(spark, docs, none):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score_toxicity(docs, empty, train=F.lit(True)).collect()} == {0.5}
    assert toxicity.score_toxicity(none, empty, train=F.lit(True)).count() == 0


# -- HTML -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"),
        ("<html><head><title>T</title><style>p{}</style></head><body><nav><a>Home</a></nav><article><h1>Head</h1><p>One <b>two</b><br>three<p>Four &lt;five&gt;</article><footer>f</footer></body>", "Head\n\nOne two three\n\nFour <five>"),
        ("<article><p>Text one is here</p><div class='ad'>Buy buy buy now</div><p>Text two is here</p><section id=comments><p>nice</p></section></article>", "Text one is here\n\nText two is here"),
        ("<div class=sidebar>Side words</div><p>Main words stand here</p><form><p>Your name</p></form><script>var t='</p>';</script>", "Main words stand here"),
        ("<article>unclosed <p>tail", "unclosed\n\ntail"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


LEAD, REST = "Thirty words of a lead " * 6, "the rest goes on for some more words than that " * 8


@pytest.mark.parametrize(
    "page",
    [
        f"<body><p>{LEAD}</p><div class=ad>{'buy now ' * 40}</div><p>{REST}</p></body>",
        f"<body><p>{LEAD}</p><ul class=share>{'<li><a>Share this</a></li>' * 12}</ul><p>{REST}</p></body>",
        f"<body><div class='with-sidebar'><p>{LEAD}</p><p>{REST}</p></div><div class=sidebar>Side words</div></body>",
        f"<body><div id=wrap class='content sidebar'><div><p>{LEAD}</p><p>{REST}</p></div><div class=sidebar>Side words</div></div></body>",
        f"<body class=search><form id=aspnet><div class=legal><p>{LEAD}</p><p>{REST}</p></div></form></body>",
        f"<body><div class='page notice'><article><p>{LEAD}</p><p>{REST}</p></article></div><ul id=comments>{'<li>nice post indeed</li>' * 90}</ul></body>",
        f"<body><article><header class='entry-header'><p>{LEAD}</p></header><p>{REST}</p></article></body>",
        f"<body><article><div class='post-header'><p>{LEAD}</p></div><p>{REST}</p><section id=comments>{'<p>nice post indeed</p>' * 90}</section></article></body>",
        f"<body><p>{LEAD}</p><svg width='9'/><p>{REST}</p></body>",
        f"<body><article><p>{LEAD}</p><math/><p>{REST}</p></article><svg><text>none</text></svg></body>",
    ],
)
def test_main_text_keeps_all_of_it_on_other_shapes(page):
    assert html_text.main_text(page) == f"{LEAD.strip()}\n\n{REST.strip()}"


@pytest.mark.parametrize("name", ["has-sidebar", "comment-status-open", "article-share-wrap", "ad-free", "search-result", "post comment-open"])
def test_main_text_of_wrappers_with_names_of_asides(name):
    for tag in ("div", "article"):
        page = f"<body><nav><a>Home</a></nav><{tag} class='{name}'><p>{LEAD}</p><p>{REST}</p></{tag}><footer>f</footer></body>"
        assert html_text.main_text(page) == f"{LEAD.strip()}\n\n{REST.strip()}"


def test_main_text_of_several_articles():
    page = f"<body><article><p>{LEAD}</p></article><p>{'between them ' * 60}</p><article><p>{REST}</p></article></body>"
    assert html_text.main_text(page) == f"{LEAD.strip()}\n\n{REST.strip()}"


def test_main_text_keeps_formulas_and_objects():
    page = f"<body><article><p>{LEAD}</p><p>so <math><mi>a</mi><mo>=</mo><mi>b</mi></math> holds</p><object><p>instead of a film</p></object><div/><p>{REST}</p></article></body>"
    assert html_text.main_text(page) == f"{LEAD.strip()}\n\nso a=b holds\n\ninstead of a film\n\n{REST.strip()}"


def test_main_text_of_deep_pages_in_linear_time():
    import time

    def took(n):
        page = "<div>" * n + f"<p>{LEAD}{REST}</p>" + "<b>" * n + "</div>" * n
        began = time.process_time()
        assert html_text.main_text(page) == f"{LEAD}{REST}".strip()
        return time.process_time() - began

    took(100)
    assert took(50_000) < 20 * max(took(5_000), 0.02)


def test_extract_keeps_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>a  b</p>", "x"), (1, "u", "<p>a  b</p>", "x"), (2, None, None, "y")], "page_id long, url string, html string, text string")
    assert sorted(r.text for r in html_text.extract(df, "html", "page_id", "url").collect()) == ["", "a b", "a b"]
    assert html_text.extract(df.limit(0)).count() == 0


# -- MinHash -----------------------------------------------------------------------------------------------------


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def roots(pairs, ids):
    at = {i: i for i in ids}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("block", [1024, 4])
def test_minhash_equals_brute_force(spark, monkeypatch, block):
    """Small blocks, so that clusters span many of them."""
    monkeypatch.setattr(minhash.across, "__defaults__", (minhash.PERCENT, block))
    r = random.Random(8)
    rows = [(i, t) for i, t, *_ in corpus()]
    for family in range(6):  # families around the threshold, so that components need more than one member to hold together
        words = prose(90, 300 + family).split()
        for k in range(14):
            w = list(words)
            for _ in range(r.randint(0, 6)):
                w[r.randrange(len(w))] = f"edit{r.random()}"
            rows.append((1000 + 20 * family + k, " ".join(w)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    sets = {i: shingles(t) for i, t in rows if i is not None}
    ids = sorted(sets)
    pairs = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = roots(pairs, ids)
    assert len(got) == len(rows)
    for x in got:
        if x.doc_id is None:
            assert x.component_id is None and x.kept
        else:
            assert (x.n_shingles, x.component_id, x.kept) == (len(sets[x.doc_id]), want[x.doc_id], want[x.doc_id] == x.doc_id)


def test_minhash_common_line_binds_nobody(spark):
    """Documents that share half of their words fall into the same buckets and are no copies: they are parted before they are compared."""
    line = prose(60, 40)
    rows = [(i, line + " " + prose(60, 7000 + i // 2 if i < 60 else 7000 + i)) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = {i: shingles(t) for i, t in rows}
    want = roots([(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])], sorted(sets))
    assert {x.doc_id: x.component_id for x in minhash.near_duplicates(frame).collect()} == want
    one = frame.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("c"), F.lit(0).cast("long").alias("cluster"))
    assert minhash.refined(one, minhash.full_sets(frame, "text", "doc_id")).groupBy("cluster").count().agg(F.max("count")).first()[0] <= 2


def test_minhash_two_texts_of_one_id(spark):
    a, b = prose(60, 1), prose(60, 2)
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, prose(60, 3))]
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_minhash_empty(none):
    assert minhash.near_duplicates(none).count() == 0


# -- product quantisation ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("dim", "block", "noise"), [(16, 4096, 0.05), (64, 4096, 0.03), (64, 16, 0.045)])
def test_vectors_equal_brute_force(spark, monkeypatch, dim, block, noise):
    """Several lists, small blocks, and families whose cosines lie on both sides of the threshold."""
    monkeypatch.setattr(pq, "LIST_ROWS", 10)
    monkeypatch.setattr(pq, "BLOCK", block)
    g = np.random.default_rng(1)
    base = g.normal(size=(40, dim))
    rows = [(i, (base[i % 40] + g.normal(size=dim) * noise * (i % 4) * (1 if i % 7 else 1.5)).astype(np.float32).tolist(), i % 3) for i in range(300)]
    rows += [(300, rows[0][1], 0), (301, rows[0][1], 0), (302, None, 0), (303, [0.0] * dim, 0), (304, [float("nan")] * dim, 0), (305, rows[0][1], None), (306, [1.0, None] + [0.0] * (dim - 2), 0), (307, [], 1), (308, rows[0][1][:8], 0), (None, rows[0][1], 0)]
    got = {r.vec_id: r for r in pq.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert len(got) == len(rows)
    ok = {i: np.array(v, float) for i, v, lab in rows if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: lab for i, _, lab in rows}
    ids = sorted(i for i in got if i is not None)
    pairs = [(a, b) for a in ok for b in ok if a < b and label[a] == label[b] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.sqrt((ok[a] @ ok[a]) * (ok[b] @ ok[b])) >= 0.98]
    links = Counter(x for p in pairs for x in p)
    want = roots(pairs, ids)
    for i in ids:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (links[i], want[i], want[i] == i)
    assert got[None].component_id is None and got[None].kept


def test_vectors_very_small_and_large(spark):
    """Squares of these vanish or overflow in double precision; their cosines don't."""
    g = np.random.default_rng(4)
    v = g.normal(size=8)
    rows = [(1, (v * 1e-200).tolist(), 0), (2, (v * 1e200).tolist(), 0), (3, v.tolist(), 0), (4, (-v * 1e-200).tolist(), 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in pq.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}


def test_vectors_no_pair_is_missed_between_lists():
    """For every pair within the radius, one of the two looks into the list of the other."""
    g = np.random.default_rng(5)
    x = g.normal(size=(3000, 12))
    x[1500:] = x[:1500] + g.normal(size=(1500, 12)) * 0.17
    x /= np.sqrt((x * x).sum(1))[:, None]
    index = pq.Index(x, 60)
    own, d = index.nearest(x)
    looks = index.probes(d, own, 0.2 / 2)
    a, b = np.nonzero(np.triu(x @ x.T >= 0.98, 1))
    assert len(a) > 500 and (own[a] != own[b]).sum() > 20
    assert (looks[a, own[b]] | looks[b, own[a]]).all()


def test_vectors_empty(spark):
    assert pq.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# -- hashes that patterns don't fool, draws that equal rows don't fill -----------------------------


def thue_morse(n, a="a", b="b"):
    out = a
    while len(out) < n:
        out += out.translate(str.maketrans(a + b, b + a))
    return out[:n]


@pytest.mark.parametrize("n", [1024, 4096])
def test_minhash_tells_thue_morse_words_apart(spark, n):
    one, two = thue_morse(n), thue_morse(n, "b", "a")
    rows = [(i, " ".join([w] * 5 + [f"{w}{k}" for k in range(4)])) for i, w in enumerate((one, two, one))]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 0}


@pytest.mark.parametrize("n", [1024, 4096])
def test_repeats_of_thue_morse_texts_equal_brute_force(spark, n):
    texts = [thue_morse(n), thue_morse(n, "b", "a"), "x" * 60 + thue_morse(n // 2, "b", "a") + "y" * 60]
    got = {r.doc_id: r.kept_sha256 for r in suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    seen: set[str] = set()
    for i, t in enumerate(texts):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 49):
            if t[k : k + 50] in seen:
                gone[k : k + 50] = True
        seen |= {t[k : k + 50] for k in range(len(t) - 49)}
        assert got[i] == hashlib.sha256("".join(c for c, g in zip(t, gone, strict=True) if not g).encode()).hexdigest()


def test_packing_offers_every_boundary():
    """The least cost over all subsets of boundaries, also where sentence ends stand close together."""
    rng = np.random.default_rng(8)
    for _ in range(60):
        points = np.unique(np.append(np.cumsum(rng.integers(1, 6, rng.integers(2, 11))), 1))
        fee = np.append(rng.choice([0.0, 1.5, 4.0], len(points) - 1), 0.0)
        cost = lambda n: 0 if n & (n - 1) == 0 else 16 - n
        total = lambda cuts: sum(cost(b - a) for a, b in zip([0, *cuts[:-1]], cuts, strict=True)) + sum(fee[np.searchsorted(points, c)] for c in cuts)  # noqa: B023, E731
        best = float("inf")
        for mask in range(1 << (len(points) - 1)):
            cuts = [int(p) for k, p in enumerate(points) if k == len(points) - 1 or mask >> k & 1]
            if all(b - a <= 16 for a, b in zip([0, *cuts[:-1]], cuts, strict=True)):
                best = min(best, total(cuts))
        assert total(packing.cut(points, fee, 16)) == pytest.approx(best)


def test_quality_learns_from_equal_rows_once(spark):
    """Equal rows don't fill the sample, however many there are."""
    rows = [(None, "the same short text again. " * 3)] * 3000 + [(i, prose(40, i) if i % 2 else "!!! $$ buy ## " * (3 + i % 5)) for i in range(200)]
    scored = quality.score_quality(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), train_rows=60)
    assert scored.count() == len(rows) and scored.filter("score IS NULL OR isnan(score)").count() == 0


def test_toxicity_of_one_id_over_many_texts(spark):
    docs_ = spark.createDataFrame([(1, f"nice text {i} of this id") for i in range(2000)] + [(2, "you vile rotten fool")] * 500, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    scored = toxicity.score_toxicity(docs_, labels, F.lit(True), train_rows=100)
    means = {r.doc_id: r.m for r in scored.groupBy("doc_id").agg(F.avg("score").alias("m")).collect()}
    assert scored.count() == 2500 and means[2] > means[1]


def test_a_stretch_has_one_hash_wherever_it_stands():
    from gridloom.llm import common

    rng = np.random.default_rng(6)
    data = rng.integers(0, 256, 3000, dtype=np.uint8)
    starts, widths = rng.integers(0, 2800, 400), rng.integers(1, 130, 400)
    whole = common.stretch_hashes(data, starts, widths)
    alone = [int(common.stretch_hashes(np.append(np.zeros(5, np.uint8), data[s : s + w]), np.array([5]), np.array([w]))[0]) for s, w in zip(starts, widths, strict=True)]
    assert whole.tolist() == alone and len(set(alone)) == len({data[s : s + w].tobytes() for s, w in zip(starts, widths, strict=True)})
    many = np.tile(starts, 60), np.tile(widths, 60)
    assert common.stretch_hashes(data, *many).tolist() == alone * 60  # more than are hashed at a time
    words = [b"a bb " + b"x" * n + b" Ccc" for n in (1, 7, 8, 9, 64, 65, 300)]
    one = [common.word_hashes([w])[0].tolist() for w in words]
    assert one == [common.word_hashes(words)[0][4 * i : 4 * i + 4].tolist() for i in range(len(words))] and len({h[2] for h in one}) == 7
