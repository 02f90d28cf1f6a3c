"""Exact encoding, decoding and edit-aware counts against the public library."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hoardlens.llm import bpe, token_counts

PARTS = [" ", "  ", "\n", "\n\n", "\t", "the", "tion", "É", "über", "中文", "😀", "12", "'s", "'ll", "!?", "<|endoftext|>",
         "<|endof", "text|>", "aaaa", "　", "\x85", "\x1c", "x", "ſ", "ing ", "Hello", "\r\n", "é"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def ours():
    return bpe.load(bpe.default_path())


def ids_of(data: bytes) -> list[int]:
    return np.frombuffer(data, "<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=40).map("".join) | st.text(max_size=60))
def test_ids_and_text_equal_the_library(text):
    library, ours = Tokenizer.from_file(bpe.default_path()), bpe.load(bpe.default_path())
    expected = library.encode(text, add_special_tokens=False).ids
    assert ids_of(ours.encode(text)) == expected
    assert ours.decode(np.array(expected, "<u4")) == library.decode(expected, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50_300), max_size=30))
def test_any_ids_decode_as_the_library(ids):
    library, ours = Tokenizer.from_file(bpe.default_path()), bpe.load(bpe.default_path())
    assert ours.decode(np.array(ids, "<u4")) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 30_000, "ab" * 10_000, " " * 9_999 + "x", "thetion" * 4_000])
def test_long_pieces(library, ours, text):
    assert ids_of(ours.encode(text)) == library.encode(text, add_special_tokens=False).ids


def rows():
    rng = random.Random(2)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 400))) for _ in range(60)]
    return [(i, t, "en", "s") for i, t in enumerate([*texts, None, "", texts[0]])] + [(None, "null id", None, None)]


def test_queries_over_rows(spark, library):
    docs = spark.createDataFrame(rows(), "doc_id bigint, text string, lang string, source string")
    found = {(r["doc_id"]): r for r in bpe.round_trip_digest(docs).collect()}
    for doc_id, text, *_ in rows():
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert found[doc_id]["n_tokens"] == len(ids)
        assert found[doc_id]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert found[doc_id]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    both = bpe.decode(bpe.encode(docs.withColumnRenamed("lang", "ids_before"))).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in both)
    checked = {r["doc_id"]: r for r in bpe.encode_checked(docs).collect()}
    for doc_id, text, *_ in rows():
        assert checked[doc_id]["round_trip"] and list(checked[doc_id]["ids"]) == library.encode(text or "", add_special_tokens=False).ids
    empty = docs.limit(0)
    assert bpe.encode_checked(empty).count() == 0
    assert bpe.round_trip_digest(empty).count() == 0 == token_counts.edited_digest(empty).count()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=700).map("".join), st.data())
def test_edits_count_as_a_fresh_encoding(text, data):
    library, ours = Tokenizer.from_file(bpe.default_path()), bpe.load(bpe.default_path())
    tree = token_counts.Tree.of(ours, text)
    for _ in range(data.draw(st.integers(1, 4))):
        start, removed = data.draw(st.integers(0, 900)), data.draw(st.integers(0, 50))
        inserted = "".join(data.draw(st.lists(st.sampled_from(PARTS), max_size=6)))
        at = min(start, len(text))
        expected = text[:at] + inserted + text[at + removed :]
        tree, text, _ = token_counts.apply_edit(ours, tree, text, start, removed, inserted)
        assert text == expected and tree.length == len(text)
        assert tree.total == len(library.encode(text, add_special_tokens=False).ids)


def test_long_special_strings_are_kept_whole(ours, tmp_path):
    import json

    spec = json.load(open(bpe.default_path(), encoding="utf-8"))
    spec["added_tokens"].append({"id": 50_300, "content": "<|" + "very" * 12 + "|>", "special": True})
    path = tmp_path / "long.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    long = bpe.Bpe(str(path))
    text = "before " * 40 + "<|" + "very" * 12 + "| after" * 30
    tree = token_counts.Tree.of(long, text)
    place = text.index("| after") + 1
    tree, text, _ = token_counts.apply_edit(long, tree, text, place, 0, ">")
    assert tree.total == len(long.encode(text)) // 4
    tree, text, _ = token_counts.apply_edit(long, tree, text, place, 1, "")
    assert tree.total == len(long.encode(text)) // 4


def test_an_edit_encodes_a_small_part(ours):
    text = "some words here and there. " * 5_000
    tree = token_counts.Tree.of(ours, text)
    _, _, encoded = token_counts.apply_edit(ours, tree, text, 70_000, 3, "new words")
    assert encoded < 2_500


def test_edited_query(spark, library):
    docs = spark.createDataFrame(rows(), "doc_id bigint, text string, lang string, source string")
    counted = sorted(tuple(r) for r in token_counts.edited_digest(docs.where("doc_id IS NOT NULL")).collect())
    edited = docs.where("doc_id IS NOT NULL").select("doc_id", "text", token_counts.two_edits().alias("edits"))
    fresh = lambda text: len(library.encode(text, add_special_tokens=False).ids)
    expected = []
    for r in edited.collect():
        before = after = r["text"] or ""
        for e in r["edits"]:
            after = after[: e["start"]] + e["inserted"] + after[e["start"] + e["removed"] :]
        expected.append((r["doc_id"], fresh(before), fresh(after), len(after)))
    assert [c[:4] for c in counted] == sorted(expected) and token_counts.edited_digest(docs).count() == len(rows())
    twice = token_counts.edit_counts(token_counts.count_tokens(edited), "text", "tree", "edits")
    assert sorted((r["doc_id"], r["n_tokens"], r["edited_tokens"], len(r["edited_text"])) for r in twice.collect()) == sorted(expected)
    again = token_counts.edit_counts(edited.withColumn("tree", F.lit(None).cast(token_counts.TREE)))
    assert sorted((r["doc_id"], r["edited_tokens"]) for r in again.collect()) == sorted((e[0], e[2]) for e in expected)
    edits = spark.createDataFrame(
        [(1, "hello world, this is it", [(5, 0, "<|endof"), (12, 0, "text|> x")])],
        f"doc_id bigint, text string, edits {token_counts.EDITS}",
    )
    row = token_counts.edit_counts(token_counts.count_tokens(edits)).first()
    assert row["edited_tokens"] == len(library.encode(row["edited_text"], add_special_tokens=False).ids)
