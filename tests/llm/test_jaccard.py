"""The Jaccard join against brute force."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from hoardlens.llm import jaccard


def test_every_linked_pair_shares_a_key():
    rng = np.random.default_rng(1)
    for size in [4, 5, 6, 7, 9, 10, 13, 20, 37, 64, 100, 257, 600, 2500]:
        for _ in range(60):
            most = size // 5
            drop = int(rng.integers(0, most + 1))
            tokens = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            kept = np.sort(rng.permutation(tokens)[: size - drop])
            add = 0
            while 100 * len(kept) >= 80 * (size + add + 1):
                add += 1
            extra = rng.integers(0, 2**64, int(rng.integers(0, add + 1)), dtype=np.uint64)
            other = np.unique(np.concatenate([kept, extra]))
            shared = len(np.intersect1d(tokens, other))
            if len(other) == 0 or 100 * shared < 80 * (len(tokens) + len(other) - shared):
                continue
            if np.array_equal(tokens, other):
                continue
            assert len(np.intersect1d(jaccard.set_keys(tokens), jaccard.set_keys(other))), (size, drop)
            assert jaccard._sketches_pass(jaccard.sketch(tokens), jaccard.sketch(other), len(tokens), len(other))


@settings(max_examples=200, deadline=None)
@given(st.integers(4, 5000))
def test_bands_reach_every_partner(size):
    tops = jaccard.band_tops()
    band = int(np.searchsorted(tops, size))
    partner = int(np.searchsorted(tops, -(-8 * size // 10)))
    assert band - partner <= 1


def classes(docs):
    found, _ = jaccard.jaccard_components(docs)
    return [tuple(r) for r in found.drop("text_key").collect()]


def brute(rows):
    sets = []
    for doc_id, text in rows:
        words = text.encode().lower().split() if text else []
        n = min(5, len(words)) or 1
        sets.append((doc_id, {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i][1], sets[j][1]
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(sets):
        least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted((d, len(s), least[root(i)]) for i, (d, s) in enumerate(sets))


def sample_rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for length in (1, 3, 5, 8, 9, 12, 30, 80, 300):
        base = [rng.choice(words) for _ in range(length)]
        rows += [" ".join(base)] * 3
        for _ in range(14):
            other = list(base)
            for _ in range(rng.randint(0, max(1, length // 40))):
                at = rng.randrange(len(other))
                other[at : at + rng.randint(0, 1)] = [rng.choice(words)]
            rows.append(" ".join(other).upper() if rng.random() < 0.2 else " ".join(other))
    shared = " ".join(rng.choice(words) for _ in range(30))
    rows += [shared + " " + " ".join(rng.choice(words) for _ in range(rng.randint(5, 60))) for _ in range(40)]
    rows += [None, "", " \n\t", "é\x85x y", "é\x85x y"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_components_match_brute_force(spark):
    rows = sample_rows()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, fp string")
    assert sorted(classes(docs)) == brute(rows)


def test_many_tiles_give_the_same(spark, monkeypatch):
    rows = sample_rows()
    monkeypatch.setattr(jaccard, "TILE", 3)
    monkeypatch.setattr(jaccard, "HUB_ROWS", 2)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(classes(docs)) == brute(rows)


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert jaccard.jaccard_components(empty)[0].count() == 0
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (None, None)], "doc_id bigint, text string")
    assert set(classes(docs)) == {(None, 2, 4), (4, 2, 4), (None, 0, None)}


def test_rows_of_a_group_grow_with_its_members_and_not_with_its_pairs():
    rng = np.random.default_rng(5)
    common = rng.integers(0, 1 << 63, 100).astype(np.uint64)
    sets = [np.unique(np.concatenate([common, rng.integers(0, 1 << 63, 9).astype(np.uint64)])) for _ in range(150)]
    rows = [(7, 0, 0, 0, i, i, len(s), jaccard.sketch(s)) for i, s in enumerate(sets)]
    names = ["sig", "i", "j", "block", "fp", "root", "n_shingles", "sketch"]
    batch = pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))))
    assert sum(b.num_rows for b in jaccard._cross_pairs(iter([batch]))) == len(sets) - 1
    items = pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))
    whole = pa.RecordBatch.from_arrays(
        [pa.array([v] * len(sets), k) for v, k in ((7, pa.int64()), (0, pa.int32()), (0, pa.int32()), (0, pa.int32()))]
        + [pa.array(range(len(sets)), pa.int64())] * 2 + [items],
        ["name", "i", "j", "block", "fp", "root", "items"],
    )
    assert sum(b.num_rows for b in jaccard._cross_links(iter([whole]))) == len(sets) - 1


def test_keys_with_equal_members_make_one_group(spark):
    rows = [(sig, fp) for sig in range(50) for fp in (3, 4, 4)] + [(60, fp) for fp in (3, 4, 5)] + [(70, 9), (70, 9)]
    found = jaccard._shared_groups(spark.createDataFrame(rows, "sig bigint, fp bigint"), 8).collect()
    assert sorted((r.fp, r.n, r["keys"]) for r in found) == [(3, 2, 50), (3, 3, 1), (4, 2, 50), (4, 3, 1), (5, 3, 1)]
    assert len({r.sig for r in found}) == 2


def test_facts_come_in_slices_and_without_the_text(monkeypatch):
    monkeypatch.setattr(jaccard, "SLICE_ROWS", 4)
    batch = pa.RecordBatch.from_pydict(
        {"doc_id": list(range(10)), "text": [f"a b c d e {i}" for i in range(10)], "text_key": list(range(10))}
    )
    found = list(jaccard._facts(5)(iter([batch])))
    assert [b.num_rows for b in found] == [4, 4, 2] and "text" not in found[0].schema.names
    assert [v for b in found for v in b.column("n_shingles").to_pylist()] == [2] * 10
