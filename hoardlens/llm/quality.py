"""Line-first cleaning: rules per line, then a verdict on what is left of the document."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoardlens.llm.frames import append_columns, blobs

LEAST_WORDS = 20
WINDOW = 8
MOST_REPEATED = 30  # per cent of the words
MOST_LOST = 50  # per cent of the characters in words
WORDS_PER_SENTENCE = 40  # a line without a mark at its end needs one mark inside for so many words
PIECE_BYTES = 1 << 20  # words are listed for so much text at a time

# Words of navigation and page furniture, in lower case.
PHRASES = (
    "all rights reserved",
    "click here",
    "cookie policy",
    "enable javascript",
    "log in to",
    "lorem ipsum",
    "privacy policy",
    "share on",
    "sign up for",
    "subscribe to",
    "terms of service",
    "terms of use",
)
MARKS = (".", "!", "?", "…", "。", "！", "？")
CLOSERS = ('"', "'", ")", "]", "”", "’", "»")
SEPARATORS = ("|", "›", "•", "»")
SYMBOLS = "#*$%&|<>"
WHITE = b" \t\n\v\f\r"

RULES = ("punctuation", "navigation", "symbols", "boilerplate", "repeated")


def _any_of(parts) -> bytes:
    return b"(?:" + b"|".join(re.escape(p.encode()) for p in parts) + b")"


_END = re.compile(_any_of(MARKS) + _any_of(CLOSERS) + rb"*\Z")
_INSIDE = re.compile(_any_of(MARKS) + rb"[\x20\x09-\x0D]")
_PHRASE = re.compile(_any_of(PHRASES))
_SEPARATORS = [s.encode() for s in SEPARATORS]
_UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_NOT_SYMBOLS = bytes(set(range(256)) - set(SYMBOLS.encode()))
_INSIDE_CODE_POINT = bytes(range(0x80, 0xC0))


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """Words of ``data``, listed for one piece of bounded size after the other."""
    at = 0
    while at < len(data):
        end = at + PIECE_BYTES
        if end < len(data):
            stop = re.compile(rb"[\x20\x09-\x0D]").search(data, end)
            end = stop.end() if stop else len(data)
        yield data[at:end].split()
        at = end


def _characters(data: bytes) -> int:
    """Code points that lie in words."""
    return len(data.translate(None, WHITE + _INSIDE_CODE_POINT))


def _symbols(data: bytes) -> int:
    return len(data.translate(None, _NOT_SYMBOLS))


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found at two or more places, overlaps included."""
    count = len(ids) - window + 1
    if count < 2:
        return 0
    mixed = np.zeros(count, np.uint64)
    for i in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + count].astype(np.uint64)
    order = np.argsort(mixed, kind="stable")
    twin = mixed[order][1:] == mixed[order][:-1]
    if not twin.any():
        return 0
    # Equal hashes only choose the windows that are compared word by word.
    some = np.zeros(count, bool)
    some[order[1:][twin]] = some[order[:-1][twin]] = True
    places = np.flatnonzero(some)
    _, name, times = np.unique(
        np.stack([ids[places + i] for i in range(window)], axis=1), axis=0, return_inverse=True, return_counts=True
    )
    found = places[times[name.ravel()] > 1]
    edges = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edges, found, 1)
    np.add.at(edges, found + window, -1)
    return int(np.count_nonzero(np.cumsum(edges)[:-1]))


def failed_rule(line: bytes, words: int, characters: int, symbols: int, seen: bool) -> int:
    """Number of the first rule a line with words breaks, -1 if it is fine."""
    bare = line.rstrip(WHITE)
    if not _END.search(bare) and WORDS_PER_SENTENCE * len(_INSIDE.findall(bare)) < words:
        return 0
    separators = sum(line.count(s) for s in _SEPARATORS)
    if separators >= 3 and words <= 4 * separators + 3:
        return 1
    if 10 * symbols > characters:
        return 2
    if _PHRASE.search(line.translate(_UPPER)):
        return 3
    return 4 if seen else -1


def judge(data: bytes):
    """Counts of one text, and what line-first cleaning leaves of it."""
    numbers: dict[bytes, int] = {}
    ids, seen, left = array("q"), set(), []
    characters = symbols = duplicates = lost = 0
    failed = [0] * len(RULES)
    for line in data.split(b"\n"):
        before = len(ids)
        for piece in _pieces(line):
            ids.extend([numbers.setdefault(w, len(numbers)) for w in piece])
        words = len(ids) - before
        own_symbols = _symbols(line)
        symbols += own_symbols
        if not words:
            left.append(line)
            continue
        own = _characters(line)
        characters += own
        again = line in seen
        duplicates += again
        seen.add(line)
        rule = failed_rule(line, words, own, own_symbols, again)
        if rule < 0:
            left.append(line)
        else:
            failed[rule] += 1
            lost += own
    n_words = len(ids)
    repeated = repeated_words(np.frombuffer(ids, np.int64)) if n_words else 0
    base_failed = n_words < LEAST_WORDS or 100 * repeated > MOST_REPEATED * n_words
    kept = not base_failed and 100 * lost <= MOST_LOST * characters
    return n_words, characters, symbols, duplicates, repeated, base_failed, kept, lost, failed, b"\n".join(left)


FIELDS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint,"
    " base_failed boolean, kept boolean, lost_chars bigint, failed_lines array<int>, clean_text string"
)


def clean_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with counts, the verdict ``kept``, ``failed_lines`` by RULES and ``clean_text``.

    Every line that holds a word is judged by itself: it must end in a sentence mark or hold
    enough of them, not be a row of menu items, hold few symbols, not hold a phrase of page
    furniture and not repeat an earlier line. Lines that fail are left out of ``clean_text``.
    A text that is too short, repeats itself or loses more than half of its characters this
    way is not kept; no row is dropped here.

    Narrow: one pass, no shuffle, so repeated rows, hot sources and empty tables need no care;
    columns of any name pass through. A null text has no words and no ``clean_text``; an empty
    one has an empty ``clean_text``. Words of a long text are listed 1 MB at a time.
    """

    def make():
        def step(columns):
            rows = [(*judge(b or b""), b is None) for b in blobs(columns[0])]
            *counts, base_failed, kept, lost, failed, left, null = zip(*rows)
            left = [None if n else t.decode("utf-8", "replace") for t, n in zip(left, null)]
            return [
                *[pa.array(c, pa.int64()) for c in counts],
                pa.array(base_failed, pa.bool_()),
                pa.array(kept, pa.bool_()),
                pa.array(lost, pa.int64()),
                pa.array(failed, pa.list_(pa.int32())),
                pa.array(left, pa.string()),
            ]

        return step

    return append_columns(docs, [text], make, FIELDS)


def quality_digest(docs: DataFrame) -> DataFrame:
    """Per document the counts, ``base_failed``, ``kept`` and ``lost_chars``."""
    return clean_lines(docs.select("doc_id", "text")).drop("text", "failed_lines", "clean_text")


def failures_by_rule(docs: DataFrame, text: str = "text") -> DataFrame:
    """``rule, lines, documents``: how many lines each rule removes, and in how many documents."""
    found = clean_lines(docs.select(F.col(text).alias("text"))).select(F.posexplode("failed_lines").alias("n", "lines"))
    names = F.array(*[F.lit(r) for r in RULES])
    return (
        found.groupBy("n")
        .agg(F.sum("lines").alias("lines"), F.count_if(F.col("lines") > 0).alias("documents"))
        .select(names[F.col("n")].alias("rule"), "lines", "documents")
    )


def _sql_list(parts) -> str:
    return "|".join(re.escape(p).replace("'", "''").replace("\\ ", " ") for p in parts)


_WHITE_SQL = r"[\x20\x09-\x0D]"
ORACLE = rf"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT row, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM docs),
windows AS (
    SELECT row, i, list_slice(words, i, i + {WINDOW - 1}) AS part
    FROM (SELECT row, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM words)),
repeats AS (
    SELECT row, count(DISTINCT place) AS n_repeat_words
    FROM (SELECT row, unnest(range(i, i + {WINDOW})) AS place
          FROM (SELECT row, i, count(*) OVER (PARTITION BY row, part) AS times FROM windows)
          WHERE times > 1)
    GROUP BY row),
lines AS (
    SELECT row, unnest(string_split(text, chr(10))) AS line,
           unnest(range(len(string_split(text, chr(10))))) AS place
    FROM docs),
counted AS (
    SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
           length(regexp_replace(line, '{_WHITE_SQL}+', '', 'g')) AS chars,
           len(regexp_extract_all(line, '[{re.escape(SYMBOLS)}]')) AS symbols,
           len(regexp_extract_all(line, '{_sql_list(SEPARATORS)}')) AS separators,
           row_number() OVER (PARTITION BY row, line ORDER BY place) > 1 AS again
    FROM lines),
judged AS (
    SELECT *,
        (NOT regexp_matches(line, '({_sql_list(MARKS)})({_sql_list(CLOSERS)})*{_WHITE_SQL}*\z')
         AND {WORDS_PER_SENTENCE} * len(regexp_extract_all(regexp_replace(line, '{_WHITE_SQL}+\z', ''),
                                                           '({_sql_list(MARKS)}){_WHITE_SQL}')) < words)
        OR 10 * symbols > chars
        OR (separators >= 3 AND words <= 4 * separators + 3)
        OR regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '{_sql_list(PHRASES)}')
        OR again AS fails
    FROM counted WHERE words > 0),
totals AS (
    SELECT row, sum(words) AS n_words, sum(chars) AS word_chars, count_if(again) AS n_dup_lines,
           coalesce(sum(chars) FILTER (fails), 0) AS lost_chars
    FROM judged GROUP BY row),
bare AS (
    SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words,
           CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
           CAST(len(regexp_extract_all(text, '[{re.escape(SYMBOLS)}]')) AS BIGINT) AS n_symbols,
           CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
           CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
           CAST(coalesce(lost_chars, 0) AS BIGINT) AS lost_chars
    FROM docs LEFT JOIN totals USING (row) LEFT JOIN repeats USING (row)),
based AS (
    SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed
    FROM bare)
SELECT *, NOT base_failed AND 100 * lost_chars <= {MOST_LOST} * word_chars AS kept FROM based
"""
