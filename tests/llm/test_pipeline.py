"""The pipeline's stages against what each must do to its own input."""

import os

import pytest

from .test_operators import shingles

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_stages(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {}
    for name, stage in pipeline.STAGES:
        before = docs.collect()
        docs = pipeline.common.keep(stage(spark, docs, SF), name.replace(" ", "_"))
        after = docs.collect()
        kept[name] = after
        if name == "quality classifier":
            ids = {r.doc_id for r in after}
            clean = [r.doc_id for r in before if labels.get(r.doc_id) == 1]
            assert sum(i in ids for i in clean) >= 0.95 * len(clean)
        elif name == "exact dedup":
            first = {}
            for r in before:
                first[r.text or ""] = min(first.get(r.text or "", r.doc_id), r.doc_id)
            assert sorted(r.doc_id for r in after) == sorted(first.values())
        elif name == "minhash near-dedup":
            sets = {r.doc_id: shingles(r.text) for r in after}
            ids = sorted(i for i in sets if sets[i])
            assert not [(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
        elif name == "mixing to weights":
            texts = {r.doc_id: r.text for r in before}
            assert all(texts[r.doc_id] == r.text for r in after)
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    tokens = {}
    for r in kept["packing"]:
        tokens[r.sequence_id] = tokens.get(r.sequence_id, 0) + r.length
    assert max(tokens.values()) <= 4096
    assert pipeline.run(spark, SF).count() == len(kept["packing"])
