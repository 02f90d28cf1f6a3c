"""R-tree search and hard negatives against brute force, with odd rows."""

from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as arrays

from hoardlens.llm import negatives
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.01"


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 60), st.integers(0, 3), st.integers(1, 5), st.integers(0, 2**31))
def test_str_order_is_a_permutation(n, k, leaf, seed):
    rng = np.random.default_rng(seed)
    order = negatives.str_order(rng.integers(0, 3, n), rng.integers(-9, 9, (n, k)), leaf)
    assert sorted(order.tolist()) == list(range(n))


def test_str_tiles_are_narrow():
    values = np.random.default_rng(1).integers(0, 10_000, (4_096, 2))
    order = negatives.str_order(np.zeros(4_096, int), values, 64)
    tiles = values[order].reshape(64, 64, 2)
    assert (np.ptp(tiles, axis=1).mean(axis=0) < 2_500).all()  # an eighth of each side, about


@settings(max_examples=150, deadline=None)
@given(
    arrays.arrays(np.int64, st.tuples(st.integers(1, 60), st.just(3)), elements=st.integers(-6, 6)),
    st.integers(1, 4), st.booleans(), st.sampled_from([np.int64, np.float64]), st.integers(0, 2**31),
)
def test_forest_search(data, k, same, kind, seed):
    rng = np.random.default_rng(seed)
    ids, labels = rng.integers(0, 40, len(data)), rng.integers(0, 3, len(data))
    fan, negatives.FAN = negatives.FAN, 2
    forest = negatives.Forest(np.arange(len(data)) // 4, np.arange(len(data)), ids, labels, data.astype(kind))
    negatives.FAN = fan
    query = int(rng.integers(0, len(data)))
    lows, highs = np.array([-2**62, 0, 5, 9], kind), np.array([2**62, 20, 5, 3], kind)
    negatives.FAN = 2
    window, found, scores = forest.search(data[query].astype(kind), labels[query], query, same, lows, highs, k)
    negatives.FAN = fan
    for w in range(4):
        expected = sorted(
            (-int(data[i] @ data[query]), int(ids[i])) for i in range(len(data))
            if i != query and (labels[i] == labels[query]) == same and lows[w] <= data[i] @ data[query] <= highs[w]
        )[:k]
        assert [(-int(s), int(i)) for i, s in zip(found[window == w], scores[window == w])] == expected


def brute(rows, positives=5, count=3):
    fine = []
    for vec_id, v, label in rows:
        if vec_id is not None and label is not None and v is not None:
            if all(x is not None and np.isfinite(x) for x in v):
                fine.append((vec_id, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int), label))
    out = Counter()
    for i, (anchor, v, label) in enumerate(fine):
        if anchor % 50:
            continue
        scored = [(-int(v @ w), n, own) for j, (n, w, own) in enumerate(fine) if j != i and len(w) == len(v)]
        for p, positive, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            fit = sorted(x[:2] for x in scored if x[2] != label and -50 * p <= -100 * x[0] <= -95 * p)[:count]
            out.update((anchor, positive, r + 1, n, -p, -s) for r, (s, n) in enumerate(fit))
    return out


def vectors():
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        v = [float(x) for x in rng.normal(0.1, 0.2, 6)]
        rows.append((i, v, 0 if i % 3 else int(rng.integers(0, 5))))
    rows += [(i, [0.5, 0.25], i % 2) for i in range(400, 460)]  # ties, and another length
    rows += [(450, rows[3][1], 1), (50, rows[7][1], 0), (50, rows[50][1], 1), (500, None, 1), (550, [1.0, None] * 3, 1)]
    rows += [(600, [float("nan")] * 6, 1), (None, rows[0][1], 1), (650, rows[1][1], None), (700, [], 1), (701, [], 2), (702, [], 1)]
    rows += [(i, rows[10][1], 0) for i in range(800, 900)]  # one vector very often
    return rows


@pytest.mark.parametrize("leaf, tree, group", [(4, 16, 2_000), (128, 16_384, 64 << 20)])
def test_hard_negatives(spark, monkeypatch, leaf, tree, group):
    monkeypatch.setattr(negatives, "LEAF", leaf)
    monkeypatch.setattr(negatives, "TREE", tree)
    monkeypatch.setattr(negatives, "GROUP_BYTES", group)
    rows = vectors()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<float>, label int, rank int")
    assert Counter(tuple(r) for r in negatives.hard_negatives(docs).collect()) == brute(rows)


def test_empty_and_huge(spark):
    schema = "vec_id bigint, embedding array<double>, label int"
    assert negatives.hard_negatives(spark.createDataFrame([], schema)).count() == 0
    lone = spark.createDataFrame([(50, [0.5], 1), (7, [0.1], 2)], schema)
    assert negatives.hard_negatives(lone).count() == 0
    with pytest.raises(ValueError, match="64 bits"):
        negatives.hard_negatives(spark.createDataFrame([(50, [1e30], 1), (7, [1.0], 2)], schema))
    wide = [(50, [1e5, 1.0], 1), (51, [1e5, 2.0], 1), (7, [7e4, 1.0], 2)]
    found = negatives.hard_negatives(spark.createDataFrame(wide, schema)).collect()
    assert [tuple(r) for r in found] == list(brute([(i, v, n) for i, v, n in wide]))


def test_query_matches_sql(spark):
    import __spark_entry__ as entry

    assert compare(entry.queries()["op11_hard_negatives"](spark, SF_DIR), connect(SF_DIR), negatives.ORACLE) == []
