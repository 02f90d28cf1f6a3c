"""Suffix arrays and the removal of repeats against brute force."""

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hoardlens.llm import suffixes


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=200), st.integers(2, 60))
def test_suffix_array_orders_prefixes(letters, length):
    text = np.array(letters, np.int16)
    array = suffixes.suffix_array(text, length)
    assert sorted(array.tolist()) == list(range(len(text)))
    heads = [tuple(letters[i : i + length]) for i in array]
    assert heads == sorted(heads)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=6, max_size=40), min_size=1, max_size=12), st.data())
def test_earliest_owner(contexts, data):
    contexts = [bytes(b % 3 for b in c) for c in contexts]
    owners = np.array([data.draw(st.integers(0, 9)) for _ in contexts])
    found = suffixes.earliest(contexts, owners, 6)
    least = {}
    for c, o in zip(contexts, owners):
        for i in range(len(c) - 5):
            least[c[i : i + 6]] = min(least.get(c[i : i + 6], 99), o)
    for c, values in zip(contexts, found):
        assert values.tolist() == [least[c[i : i + 6]] for i in range(len(c) - 5)]


@pytest.mark.parametrize("size", [49, 50, 51, 80, 500])
def test_every_string_has_the_anchor_its_bytes_decide(size):
    rng = np.random.default_rng(size)
    data = rng.integers(97, 100, size, dtype=np.uint8)
    place, name, first, last = suffixes.anchors(data)
    covered = [s for a, b in zip(first, last) for s in range(a, b + 1)]
    assert covered == list(range(max(0, size - 49)))
    for p, n, a, b in zip(place, name, first, last):
        for s in range(a, b + 1):
            alone = suffixes.anchors(data[s : s + 50])
            assert alone[1].tolist() == [n] and alone[0][0] + s == p


def brute(rows):
    owner = {}
    for doc_id, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - 49):
            key = data[i : i + 50]
            if doc_id is not None:
                owner[key] = min(owner.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 49):
            if doc_id is not None and owner.get(data[i : i + 50], doc_id) < doc_id:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def sample_rows():
    rng = random.Random(5)
    letters = "abcdé \n"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [word(n) for n in (30, 49, 50, 51, 90, 200)]
    texts = ["".join(rng.choice([word(rng.randint(1, 60)), rng.choice(passages)]) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    texts += [texts[0]] * 5 + [texts[3][:-1] + "x", texts[3] + texts[4], "a" * 300, "a" * 120, "ab" * 90, None, "", "é" * 25]
    texts += [t[: len(t) // 2] + "#" + t[len(t) // 2 :] for t in texts[:15]]
    rng.shuffle(texts)
    return [(i * 3 % 97, t) for i, t in enumerate(texts)]


def key(row):
    return tuple((v is None, v) for v in row)


@pytest.mark.parametrize("common", [5_000, 1])
def test_removal_matches_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(suffixes, "COMMON", common)
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 500)
    rows = sample_rows() + [(None, sample_rows()[0][1]), (5, "repeated id " * 20), (5, "repeated id " * 20)]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id bigint, text string, anchor string")
    found = [tuple(r) for r in suffixes.remove_repeats(docs).collect()]
    assert sorted(found, key=key) == sorted(brute(rows), key=key)


def test_empty_table(spark):
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_memory_of_a_shard_is_bounded():
    words = np.random.default_rng(2).integers(97, 123, (40_000, 100)).astype(np.uint8)
    rows = [(i, i, i, 0, w.tobytes()) for i, w in enumerate(words)]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    names = ["anchor", "doc_id", "text_key", "start", "context"]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
    tracemalloc.start()
    for _ in suffixes._shards(batch.slice(i, 2_000) for i in range(0, len(rows), 2_000)):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20


def test_only_tied_suffixes_are_sorted_again(monkeypatch):
    """A round of doubling sorts what is still equal, not the whole string of names."""
    names = np.random.default_rng(6).permutation(4000)
    names[1000:1020] = names[2000:2020]
    sort, sizes = np.argsort, []
    monkeypatch.setattr(np, "argsort", lambda a, **k: sizes.append(len(a)) or sort(a, **k))
    order = suffixes._sort_reduced(names, 26)
    monkeypatch.undo()
    assert sizes[0] == 4000 and 0 < sum(sizes[1:]) <= 200
    text = names.tolist()
    assert order.tolist() == sorted(range(4000), key=lambda i: text[i : i + 64])


def test_anchors_of_joined_texts_are_those_of_each():
    rng = np.random.default_rng(2)
    texts = [rng.integers(97, 100, n, dtype=np.uint8) for n in (80, 0, 50, 49, 700, 3, 51)]
    sizes = np.array([len(t) for t in texts])
    begins = np.cumsum(sizes) - sizes
    text, place, name, first, last = suffixes.anchors_of_texts(np.concatenate(texts), begins, sizes)
    for i, own in enumerate(texts):
        at = text == i
        joined = (place[at] - begins[i], name[at], first[at] - begins[i], last[at] - begins[i])
        assert [c.tolist() for c in joined] == [c.tolist() for c in suffixes.anchors(own)]


def test_texts_that_share_two_words_share_no_anchor():
    left = np.frombuffer(b"x" * 40 + b"sixteen bytes in" + b"y" * 40, np.uint8)
    right = np.frombuffer(b"u" * 40 + b"sixteen bytes in" + b"v" * 40, np.uint8)
    assert not set(suffixes.anchors(left)[1]) & set(suffixes.anchors(right)[1])
