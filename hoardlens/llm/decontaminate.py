"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark words."""

from __future__ import annotations

import hashlib
import re
import uuid
from functools import partial

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoardlens.llm.frames import append_columns, blobs, hash_slot
from hoardlens.workspace import materialize

WINDOW_WORDS = 13
AUTOMATON_WINDOWS = 200_000  # about 2.6 million nodes; more windows go through further passes
HIT_SHARE = 20  # contaminated from one hit word in 20

# A-Z become a-z; digits, letters and all bytes of non-ASCII characters stay; the rest parts words.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
HITS = "array<struct<item:string,first:int,last:int>>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def _windows(window: int):
    def step(columns):
        made = []
        for text in blobs(columns[0]):
            words = words_of(text)
            count = max(len(words) - window + 1, 1) if words else 0
            made.append(sorted({b" ".join(words[i : i + window]) for i in range(count)}))
        return [pa.array(made, pa.list_(pa.binary()))]

    return step


def benchmark_windows(
    benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW_WORDS
) -> DataFrame:
    """Distinct ``item, words``: each run of ``window`` words of an item, or all its words if fewer."""
    items = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text")
    )
    found = append_columns(items, ["text"], partial(_windows, window), "windows array<binary>")
    return found.select("item", F.explode("windows").alias("words")).distinct()


class _Automaton:
    """Word-level automaton; letters are numbers of benchmark words, 0 for all other words."""

    def __init__(self, rows):
        self.number: dict[bytes, int] = {}
        owners: dict[tuple, list[str]] = {}
        for item, words in rows:
            key = tuple(self.number.setdefault(w, len(self.number) + 1) for w in words.split(b" "))
            owners.setdefault(key, []).append(item)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, items in owners.items():
            self.machine.add_word(key, (len(key), items))
        self.machine.make_automaton()

    def hits(self, words: list[bytes]) -> list[tuple[str, int, int]]:
        number = self.number
        known = tuple([number.get(w, 0) for w in words])
        if not any(known):
            return []
        return [
            (item, last - size + 1, last)
            for last, (size, items) in self.machine.iter(known)
            for item in items
        ]


_built: dict[str, _Automaton] = {}


def _automaton(key: str, rows) -> _Automaton:
    if key not in _built:
        _built.clear()
        _built[key] = _Automaton(rows.value)
    return _built[key]


def _covered(hits) -> list[tuple[int, int]]:
    """Union of word ranges, both ends inclusive."""
    runs: list[list[int]] = []
    for first, last in sorted({(first, last) for _, first, last in hits}):
        if runs and first <= runs[-1][1] + 1:
            runs[-1][1] = max(runs[-1][1], last)
        else:
            runs.append([first, last])
    return [(a, b) for a, b in runs]


def _offsets(text: bytes, runs) -> list[dict]:
    """Code-point offsets in the original text of runs of words."""
    places = [m.span() for m in _WORD.finditer(text)]
    spans, at, chars = [], 0, 0
    for first, last in runs:
        ends = []
        for byte in (places[first][0], places[last][1]):
            chars += len(text[at:byte].decode("utf-8", "replace"))
            at = byte
            ends.append(chars)
        spans.append({"start": ends[0], "end": ends[1]})
    return spans


def _scan(key: str, rows, last: bool):
    def make():
        machine = _automaton(key, rows)

        def step(columns):
            texts = blobs(columns[0])
            before = columns[1].to_pylist() if len(columns) > 1 else [[]] * len(texts)
            counts, found = [], []
            for text, old in zip(texts, before):
                words = words_of(text)
                counts.append(len(words))
                old = [(h["item"], h["first"], h["last"]) for h in old or []]
                found.append(old + machine.hits(words))
            if not last:
                rows_out = [[{"item": i, "first": a, "last": b} for i, a, b in f] for f in found]
                kind = pa.struct([("item", pa.string()), ("first", pa.int32()), ("last", pa.int32())])
                return [pa.array(rows_out, pa.list_(kind))]
            runs = [_covered(f) for f in found]
            items = [sorted({item for item, _, _ in f}) for f in found]
            spans = [_offsets(t, r) if r else [] for t, r in zip(texts, runs)]
            kind = pa.struct([("start", pa.int32()), ("end", pa.int32())])
            return [
                pa.array(counts, pa.int64()),
                pa.array([sum(b - a + 1 for a, b in r) for r in runs], pa.int64()),
                pa.array(items, pa.list_(pa.string())),
                pa.array(spans, pa.list_(kind)),
            ]

        return step

    return make


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW_WORDS,
    automaton_windows: int = AUTOMATON_WINDOWS,
) -> DataFrame:
    """``docs`` with ``n_words, n_hit, items, spans``, in one narrow pass without a shuffle.

    A word is hit when it lies inside any occurrence of a benchmark window; ``items`` are the
    ids whose windows occur, ``spans`` the hit runs as code-point offsets of the original text.
    A broadcast holds at most ``automaton_windows`` windows; a larger benchmark is split by a
    hash of its windows and the documents pass one automaton after the other.

    Null and empty texts have no words and no hits; a null item id counts as the id ''. Repeated
    rows are scanned each by itself, an empty table gives an empty result, an empty benchmark no
    hits. Other columns pass through under any name.
    """
    windows = benchmark_windows(benchmark, item_id, item_text, window)
    total = windows.count()
    groups = max(1, -(-total // automaton_windows))
    if groups > 1:
        windows = materialize(windows, "windows")
    context = docs.sparkSession.sparkContext
    out, names = docs, docs.columns
    carried: list[str] = []
    for group in range(groups):
        part = windows.where(hash_slot(F.struct("item", "words"), groups) == group)
        rows = context.broadcast([(r[0], bytes(r[1])) for r in part.collect()])
        last = group == groups - 1
        step = _scan(uuid.uuid4().hex, rows, last)
        if last:
            fields = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:int,end:int>>"
        else:
            fields = f"hits {HITS}"
        plain = out.toDF(*[f"c{i}" for i in range(len(out.columns))])
        inputs = [f"c{names.index(text)}", *[f"c{len(names)}" for _ in carried]]
        out = append_columns(plain, inputs, step, fields)
        if carried:
            out = out.drop(f"c{len(names)}")
        carried = [] if last else ["hits"]
    made = ["n_words", "n_hit", "items", "spans"]
    return out.toDF(*names, *made)


def contamination_digest(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: counts, digest of the item ids and the verdict."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark, **options)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (HIT_SHARE * F.col("n_hit") >= F.col("n_words"))).alias(
            "contaminated"
        ),
    )


def digest_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


ORACLE = r"""
WITH folded AS (
    SELECT doc_id, text AS original,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents),
items AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, least(len(words), 13) AS size, array_to_string(words[i:i + 12], ' ') AS phrase
    FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS i
          FROM items WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
    SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i
    FROM folded, sizes WHERE len(words) >= size),
found AS (
    SELECT p.doc_id, p.i, p.size, w.item_id
    FROM places p JOIN windows w
      ON w.size = p.size AND w.phrase = array_to_string(p.words[p.i:p.i + p.size - 1], ' ')),
hit AS (
    SELECT doc_id, count(DISTINCT i + j) AS n_hit
    FROM (SELECT DISTINCT doc_id, i, size FROM found), LATERAL (SELECT unnest(range(0, size)) AS j)
    GROUP BY doc_id),
named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM found) GROUP BY doc_id)
SELECT f.doc_id, CAST(coalesce(len(f.words), 0) AS BIGINT) AS n_words,
       CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(n.names, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= coalesce(len(f.words), 0) AS contaminated
FROM folded f LEFT JOIN hit h USING (doc_id) LEFT JOIN named n USING (doc_id)
"""
