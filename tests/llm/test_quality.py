"""Line rules and base counts against brute force, with odd rows."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hoardlens.llm import quality
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    """Counts and verdict from the text as code points, rule by rule."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
    lines = text.split("\n")
    chars = lost = duplicates = 0
    left = []
    for n, line in enumerate(lines):
        own = WORD.findall(line)
        size = sum(map(len, own))
        chars += size
        again = bool(own) and line in lines[:n]
        duplicates += again
        bare = line.strip(" \t\n\v\f\r")
        ends = bare.rstrip("".join(quality.CLOSERS)).endswith(quality.MARKS)
        inside = len(re.findall(r"[.!?…。！？][\x20\x09-\x0D]", bare))
        separators = sum(line.count(s) for s in quality.SEPARATORS)
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)
        bad = own and (
            (not ends and 40 * inside < len(own))
            or 10 * sum(c in quality.SYMBOLS for c in line) > size
            or (separators >= 3 and len(own) <= 4 * separators + 3)
            or any(p in lower for p in quality.PHRASES)
            or again
        )
        lost += size if bad else 0
        left += [] if bad else [line]
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    symbols = sum(c in quality.SYMBOLS for c in text)
    kept = not failed and 2 * lost <= chars
    return (len(words), chars, symbols, duplicates, len(hit), failed, kept, lost), "\n".join(left)


PARTS = ["one ", "two ", "É! ", "中文。 ", "a b c d e f g h ", "\n", "\n", "x.\n", ".", "|", " | ", "»", "\t", "\x85", "\xa0", " ",
         "Privacy Policy", "LOREM ipsum ", "#", "$%", "😀 ", "end.”)", "\r\n", "\v", "ſ "]
texts = st.lists(st.sampled_from(PARTS), max_size=60).map("".join) | st.text(max_size=80)


@settings(max_examples=400, deadline=None)
@given(texts)
def test_a_text_is_judged_as_by_brute_force(text):
    *found, lost, failed, left = quality.judge(text.encode())
    expected, clean = brute(text)
    assert (*found, lost) == expected and left.decode() == clean
    assert (sum(failed) == 0) == (lost == 0)


def test_long_lines_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(quality, "PIECE_BYTES", 7)
    text = "ab cd " * 30 + "e" * 50 + " the end.\n" + "f" * 9
    assert (*quality.judge(text.encode())[:7], quality.judge(text.encode())[7]) == brute(text)[0]


def test_windows_are_compared_word_by_word():
    ids = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3], np.int64)
    assert quality.repeated_words(ids, 3) == 6
    assert quality.repeated_words(ids[:6], 3) == 0


def test_rows(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 200))), "hot") for i in range(80)]
    rows += [(None, None, None), (5, "", "hot"), (5, "", "hot"), (6, "word " * 200_000 + ".", "hot"), (7, rows[3][1], None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kept string")
    found = quality.clean_lines(docs).collect()
    key = repr
    expected = []
    for doc_id, text, source in rows:
        if text and len(text) > 100_000:
            expected.append((doc_id, source, (200_001, 800_001, 0, 0, 200_000, True, False, 0)))
        else:
            expected.append((doc_id, source, brute(text)[0]))
    assert sorted(((r[0], r[2], tuple(r[3:11])) for r in found), key=key) == sorted(expected, key=key)
    assert {r[0]: r[12] for r in found}[None] is None and {r[0]: r[12] for r in found}[0] == brute(rows[0][1])[1]
    digest = quality.quality_digest(docs)
    assert digest.columns[:6] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert digest.count() == len(rows) and quality.quality_digest(docs.limit(0)).count() == 0
    removed = {r["rule"]: r["lines"] for r in quality.failures_by_rule(docs).collect()}
    assert set(removed) == set(quality.RULES) and all(removed.values())


@pytest.mark.parametrize("line, rule", [
    ("A sentence that ends.", -1), ("a heading", 0), ("price $$$ *** off!", 2), ("home | news | sport | more.", 1),
    ("Read our Privacy Policy now.", 3),
])
def test_rules_by_example(line, rule):
    data = line.encode()
    assert quality.failed_rule(data, len(line.split()), len(line.replace(" ", "")), quality._symbols(data), False) == rule


def test_query_matches_sql(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert compare(quality.quality_digest(docs), connect(SF_DIR), quality.ORACLE) == []
