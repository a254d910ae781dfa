"""The pipeline against a brute-force version of its stages, and its registration."""

import math
from collections import Counter

import pytest

from fathom.llm import mixing, quality

from .conftest import DOCS, awkward, prose
from .test_llm import brute_hits, jaccard


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows = [*awkward(), *((100 + i, prose(100 + i // 2 if i < 20 else 100 + i, 60 + i), "en", f"s{i % 4}", 1) for i in range(60))]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{d}/documents.parquet")
    a = prose(140, 100).split(" ")
    spark.createDataFrame([(1, " ".join(a[10:30]))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows


def test_stages_against_brute_force(spark, sf_dir):
    import corpus_pipeline as cp

    d, rows = sf_dir
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert len(names) == 5 and len(set(names)) == 5
    steps = dict(cp.STAGES)
    out = {}
    for i, (n, f) in enumerate(cp.STAGES):
        f(spark, docs, d).write.parquet(f"{d}/stage{i}")
        docs = spark.read.parquet(f"{d}/stage{i}")
        out[n] = docs.collect()
        if i < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {r["doc_id"] for r in quality.score_quality(spark.read.parquet(f"{d}/documents.parquet")).collect() if r["kept"]}
    assert Counter(r["doc_id"] for r in out[names[0]]).keys() == kept
    # One row a group: links by brute force.
    good = [(r["doc_id"], r["text"]) for r in out[names[0]]]
    group = list(range(len(good)))
    for i in range(len(good)):
        for j in range(i):
            if jaccard(good[i][1], good[j][1]) >= 0.8:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    best = {}
    for (k, _), g in zip(good, group, strict=True):
        best[g] = min(best.get(g, (True, 0)), (k is None, k or 0))
    assert Counter(r["doc_id"] for r in out[names[1]]) == Counter(None if n else k for n, k in best.values())
    one = [(r["doc_id"], r["text"]) for r in out[names[1]]]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    clean = [k for (k, _), h in zip(one, brute_hits([t for _, t in one], bench), strict=True) if not h[4]]
    assert len(clean) < len(one) and Counter(r["doc_id"] for r in out[names[2]]) == Counter(clean)
    plan = mixing.mix(spark.read.parquet(f"{d}/stage2")).collect()
    want = Counter({r["doc_id"]: math.floor(r["taken"] / max(1, r["size"]) + 0.5) for r in plan})
    assert Counter(r["doc_id"] for r in out[names[3]]) == +want
    shards = Counter(r["shard"] for r in out[names[4]])
    assert sum(shards.values()) == len(out[names[3]]) and max(shards.values()) - min(shards.get(s, 0) for s in range(40)) <= 1
    again = cp.run(spark, d).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, out[names[4]]))
    assert steps


def test_every_operator_is_registered_once():
    import __spark_entry__ as entry

    names = list(entry.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)
