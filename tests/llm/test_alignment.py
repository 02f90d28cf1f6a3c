"""Galloping intersection and the digest against brute force over the public libraries."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hoardlens.llm import alignment

PARTS = [" ", "  ", "\n", "the", "tion", "É", "über ", "中文", "😀", "12", "'s", "<|endoftext|>", "<s>", "<0x41>", "\x00", "\t",
         "　", "a" * 30, " x", " Hello", "\r\n", "é", "\x85", "ﬁ", "<unk>"]
texts = st.lists(st.sampled_from(PARTS), max_size=40).map("".join) | st.text(max_size=60)


@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers as files
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(files.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=files.path("piece_bpe_32k.model"))


def letters():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


LETTERS = letters()


def brute(libraries, text):
    """Groups of id lists from walking over every byte."""
    a, b = libraries
    if not text:
        return None
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    bytes_a = [bytes(LETTERS[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = []
    for i in ids_b:
        piece = b.id_to_piece(i)
        bytes_b.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode())
    whole = (" " + text).encode()
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return None

    def by_end(ids, data):
        at, found = 0, {}
        for i, d in zip(ids, data):
            at += len(d)
            found[at] = i
        return found

    ends_a, ends_b = by_end(ids_a, bytes_a), by_end(ids_b, bytes_b)
    groups, left, right = [], [], []
    for at in range(1, len(whole) + 1):
        left += [ends_a[at]] if at in ends_a else []
        right += [ends_b[at]] if at in ends_b else []
        if at in ends_a and at in ends_b:
            groups.append((left, right))
            left, right = [], []
    return groups


def brute_rows(libraries, rows):
    groups = [brute(libraries, text) for _, text in rows]
    counts = Counter((a[-1], b[-1]) for g in groups for a, b in g or [])
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for (doc_id, _), g in zip(rows, groups):
        links = [(a[-1], b[-1]) for a, b in g or []]
        join = lambda ids: ",".join(map(str, ids))
        line = ";".join(f"{join(a)}|{join(b)}" for a, b in g or [])
        out.append((
            doc_id, sum(len(a) for a, _ in g or []), sum(len(b) for _, b in g or []), len(links), len(links),
            sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links),
            hashlib.sha256(line.encode()).hexdigest() if g else "",
        ))
    return out


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(1, 400), max_size=80), st.sets(st.integers(1, 400), max_size=300))
def test_intersection(a, b):
    a, b = (np.array(sorted(s | {401}), np.int64) for s in (a, b))
    common_a, common_b, rank = alignment.intersect(a, b)
    assert a[common_a].tolist() == b[common_b].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
    assert rank.tolist() == [int((b < x).sum()) for x in a]
    first, last = alignment.overlaps(a, b, rank)
    starts_a, starts_b = np.concatenate([[0], a[:-1]]), np.concatenate([[0], b[:-1]])
    for i in range(len(a)):
        if starts_a[i] < a[i]:
            shared = [j for j in range(len(b)) if starts_b[j] < a[i] and starts_a[i] < b[j]]
            assert (first[i], last[i]) == (shared[0], shared[-1])


def test_a_list_without_ends():
    none = np.zeros(0, np.int64)
    assert [len(x) for x in alignment.intersect(none, none)] == [0, 0, 0]
    assert [len(x) for x in alignment.overlaps(none, none, none)] == [0, 0]


@settings(max_examples=300, deadline=None)
@given(text=texts, segment=st.sampled_from([1, 7, 1 << 20]))
def test_a_text_is_aligned_as_by_brute_force(libraries, text, segment):
    pair = alignment.load(*alignment.default_paths())
    before, alignment.SEGMENT = alignment.SEGMENT, segment
    try:
        found = alignment._digest(pair, [text])[0] if text else (0, 0, 0, "", [])
    finally:
        alignment.SEGMENT = before
    expected = brute_rows(libraries, [(1, text)])[0]
    assert tuple(found[:4]) == (*expected[1:4], expected[7])


@pytest.mark.parametrize("text", [" " * 120_000 + "x", "a" * 60_000, "\n " * 60_000, "中" * 3_000])
def test_long_runs(libraries, text):
    found = alignment._digest(alignment.load(*alignment.default_paths()), [text])[0]
    assert (*found[:2], found[3]) == tuple(brute_rows(libraries, [(1, text)])[0][i] for i in (1, 2, 7))


def test_rows(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE_BYTES", 300)
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 120)))) for i in range(60)]
    rows += [(None, "the the"), (5, "the the"), (5, "the the"), (70, None), (71, ""), (72, "has ▁ in it"), (73, "word " * 5_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, links int")
    found = [tuple(r) for r in alignment.alignment_digest(docs).collect()]
    assert sorted(found, key=repr) == sorted(brute_rows(libraries, rows), key=repr)
    assert alignment.alignment_digest(docs.limit(0)).count() == 0


def test_aligned_tokens(spark, libraries):
    rows = [(1, "Überraschung! 中文 tokens"), (2, None), (3, "has ▁"), (4, "")]
    docs = spark.createDataFrame(rows, "first_b int, text string")
    found = {r[0]: r for r in alignment.align_tokens(docs).collect()}
    groups = brute(libraries, rows[0][1])
    one = found[1]
    assert list(one[2]) == [i for a, _ in groups for i in a] and list(one[3]) == [i for _, b in groups for i in b]
    assert list(one[4]) == [len(a) for a, _ in groups] and list(one[5]) == [len(b) for _, b in groups]
    assert one[6][0] == 0 and one[7][-1] == len(one[3]) - 1 and len(one[6]) == len(one[2])
    assert all(list(found[i][c]) == [] for i in (2, 3, 4) for c in range(2, 8))


def test_query_equals_brute_force(spark, libraries):
    import __spark_entry__ as entry

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = [tuple(r) for r in entry.queries()["op12_token_alignment"](spark, "/root/testdata/sf0.001").collect()]
    assert sorted(found) == sorted(brute_rows(libraries, rows))
