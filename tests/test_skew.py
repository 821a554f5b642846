import math
import random
from collections import Counter, defaultdict

import pytest

from graphloom.operators import skew

SCHEMA = "k string, g int, x double, rows int"


def table(seed, n=4000, distinct=500):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        k = "hot" if r.random() < 0.4 else r.choice(["a", "b", "c", None, ""])
        x = None if r.random() < 0.05 else float("nan") if r.random() < 0.01 else float(round(r.gauss(0, 50), 2) if r.random() < 0.5 else r.randrange(distinct))
        out.append((k, r.choice([1, None]) if k == "b" else 1, x, 7))
    return out


@pytest.mark.parametrize("few,limit", [(4096, 20_000), (5, 20_000), (5, 0)])
def test_quantiles(spark, monkeypatch, few, limit):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", limit)
    rows = table(few)
    got = {(r.k, r.g): (r.n, r.q_0, r.q_25, r.q_50, r.q_100) for r in skew.key_quantiles(spark.createDataFrame(rows, SCHEMA), ["k", "g"], "x", [0.0, 0.25, 0.5, 1.0], bins=4, few=few).collect()}
    want = defaultdict(list)
    for k, g, x, _ in rows:
        if x is not None and x == x:
            want[k, g].append(x)
    assert got == {key: (len(v), *(sorted(v)[max(1, math.ceil(p * len(v))) - 1] for p in (0, 0.25, 0.5, 1))) for key, v in want.items()}


def test_quantiles_of_huge_and_equal_values(spark):
    rows = [("a", 1, v, 0) for v in (1.7e308, -1.7e308, 0.0, 5e-324, 1.0)] + [("b", 1, 3.0, 0)] * 5
    got = {r.k: (r.q_50, r.q_100) for r in skew.key_quantiles(spark.createDataFrame(rows, SCHEMA), ["k"], "x", [0.5, 1.0], bins=2, few=1).collect()}
    assert got == {"a": (5e-324, 1.7e308), "b": (3.0, 3.0)}


@pytest.mark.parametrize("share,buckets", [(0.01, 1 << 14), (0.05, 3), (0.4, 1), (1.0, 8)])
def test_heavy_keys(spark, share, buckets):
    rows = table(1) + [(f"rare{k}", 1, 1.0, 0) for k in range(3000)]
    got = {(r.k, r.g): r["rows"] for r in skew.heavy_keys(spark.createDataFrame(rows, SCHEMA).drop("rows"), ["k", "g"], share, buckets).collect()}
    counts = Counter((r[0], r[1]) for r in rows)
    assert got == {k: c for k, c in counts.items() if c >= share * len(rows)}


def test_exact_share_counts(spark):
    rows = [("a", 1, 1.0, 0)] + [(f"b{k}", 1, 1.0, 0) for k in range(99)]
    assert skew.heavy_keys(spark.createDataFrame(rows, SCHEMA).drop("rows"), ["k"], 0.01).count() == 100


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert skew.heavy_keys(empty, ["k"], 0.1).count() == skew.key_quantiles(empty, ["k"], "x", [0.5]).count() == skew.distinct_counts(empty, ["k"], "x").count() == 0


def test_distinct_counts(spark):
    rows = [("a", 1, 1.0, 0), ("a", 1, 1.0, 0), ("a", 1, None, 0), (None, 1, 2.0, 0)]
    assert {r.k: r.distinct_values for r in skew.distinct_counts(spark.createDataFrame(rows, SCHEMA), ["k"], "x").collect()} == {"a": 1, None: 1}


def test_pair_counts_keep_null_kinds(spark, tmp_path):
    from graphloom.plans.training import p5_pair_counts

    rows = [("a", "t", None), ("b", "t", None), ("b", "t", None), (None, "u", None), ("a", "t", " Calls"), ("a", None, None), ("a", "", "calls")]
    spark.createDataFrame(rows, "source string, target string, kind string").write.parquet(f"{tmp_path}/edges.parquet")
    assert {tuple(r) for r in p5_pair_counts(spark, str(tmp_path)).collect()} == {("t", None, 3, 2), ("u", None, 1, 0), ("t", "calls", 1, 1)}
