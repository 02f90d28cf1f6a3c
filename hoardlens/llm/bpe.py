"""Exact byte-pair encoding by backtracking over longest matches, and decoding by an offset table."""

from __future__ import annotations

import hashlib
import json
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from hoardlens.llm.frames import append_columns, blobs

TOKENIZER = "byte_bpe_50k.json"
CACHED_CHUNKS = 300_000  # per generation; the last two generations of chunks are remembered
CACHED_LENGTH = 48  # longer chunks are encoded afresh each time
CACHED_PAIRS = 1_000_000
# White space is written out, since the meaning of \s differs between engines.
_WHITE = r"\t\n\v\f\r \x85\xa0  -     　"
PIECE = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"
)
_OTHER_WHITE = re.compile(f"[{_WHITE.replace('\\n', '').replace(' ', '', 1)}]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    rest = (b for b in range(256) if b not in letters)
    letters |= {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class Bpe:
    """Tables of one vocabulary file. Tokens are handled by rank: the bytes, then the merges in order."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_letters()
        number = {letter: b for b, letter in enumerate(letters)}
        names = list(letters)
        rank = {name: i for i, name in enumerate(names)}
        self.left, self.right = list(range(256)), list(range(256))
        self.joined: dict[int, int] = {}
        for pair in merges:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            if a + b in rank:
                raise ValueError(f"token {a + b!r} is made by two merges")
            self.joined[rank[a] << 32 | rank[b]] = rank[a + b] = len(names)
            self.left.append(rank[a])
            self.right.append(rank[b])
            names.append(a + b)
        data = [bytes(number[c] for c in name) for name in names]
        self.lengths = [len(d) for d in data]
        self.ids = np.array([vocab[name] for name in names], dtype="<u4")
        self.packed = [self.ids[i : i + 1].tobytes() for i in range(len(names))]
        place = {d: i for i, d in enumerate(data)}
        # The next shorter token that begins a token, -1 for a single byte.
        self.shorter = [
            next((place[d[:n]] for n in range(len(d) - 1, 0, -1) if d[:n] in place), -1)
            for d in data
        ]
        self.finder = ahocorasick.Automaton()
        for i, d in enumerate(data):
            self.finder.add_word(d.decode("latin-1"), i)
        self.finder.make_automaton()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special_pattern = (
            regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)))
            if self.special
            else None
        )
        self.piece = regex.compile(PIECE)
        self.pairs: dict[int, bool] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # Offset table for decoding: the bytes of id i are blob[offsets[i]:offsets[i + 1]].
        by_id = {int(self.ids[i]): d for i, d in enumerate(data)}
        by_id |= {i: s.encode() for s, i in self.special.items()}
        top = max(by_id) + 1
        sizes = np.array([len(by_id.get(i, b"")) for i in range(top)], dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        self.blob = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(top)), dtype=np.uint8)

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of ``a`` and ``b`` in rank order ends in exactly ``a, b``.

        Undoes the later of the two merges step by step; the pair is refused as soon as the
        two edge tokens would have merged with each other before the step that is undone.
        """
        joined, left, right = self.joined, self.left, self.right
        answer, bound, x, y = True, 1 << 31, a, b
        while True:
            if joined.get(x << 32 | y, 1 << 31) < bound:
                answer = False
                break
            undo_x = x > 255 and (x > y or y <= 255)
            if undo_x:
                bound, x = x, right[x]
            elif y > 255:
                bound, y = y + 1, left[y]
            else:
                break
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        self.pairs[a << 32 | b] = answer
        return answer

    def ranks(self, data: bytes) -> list[int]:
        """Tokens of one piece. Each position is left for good at most once, so time is linear.

        The longest matches from left to right are right as they stand if all neighbours are
        compatible; else the search goes back to shorter ones.
        """
        letters = data.decode("latin-1")
        known, compatible, before = self.pairs.get, self.compatible, -1
        greedy = [token for _, token in self.finder.iter_long(letters)]
        for token in greedy:
            if before >= 0:
                fits = known(before << 32 | token)
                if fits is None:
                    fits = compatible(before, token)
                if not fits:
                    break
            before = token
        else:
            return greedy
        n = len(data)
        longest = [-1] * n
        lengths, shorter = self.lengths, self.shorter
        for end, token in self.finder.iter(letters):
            longest[end - lengths[token] + 1] = token
        alive = bytearray(b"\x01") * (n + 1)
        chosen: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + lengths[token]
            if alive[end]:
                fits = True
                if chosen:
                    before = chosen[-1]
                    fits = known(before << 32 | token)
                    if fits is None:
                        fits = compatible(before, token)
            else:
                fits = False
            if fits:
                chosen.append(token)
                at = end
                if at == n:
                    return chosen
                token = longest[at]
                continue
            token_next = shorter[token]
            if token_next >= 0:
                token = token_next
                continue
            alive[at] = 0
            token = chosen.pop()
            at -= lengths[token]

    def pieces(self, text: str) -> list[str]:
        return self.piece.findall(text)

    def _chunk(self, chunk: str) -> bytes:
        """Ids of text that begins and ends at a piece boundary."""
        data = self.old.get(chunk)
        if data is None:
            packed, ranks = self.packed, self.ranks
            data = b"".join([packed[t] for p in self.piece.findall(chunk) for t in ranks(p.encode())])
        if len(chunk) <= CACHED_LENGTH:
            if len(self.young) >= CACHED_CHUNKS:
                self.old, self.young = self.young, {}
            self.young[chunk] = data
        return data

    def _plain(self, text: str) -> bytes:
        """Cuts where a piece must begin, so that words met before need no work.

        A run of white space starts a piece, and a blank before other text starts one; so does
        what follows a single line break. Texts with longer runs or other white space are cut
        by the whole pattern.
        """
        if any(run in text for run in ("  ", " \n", "\n\n", "\n ")) or _OTHER_WHITE.search(text):
            return self._chunks(self.piece.findall(text))
        lines = []
        for line in text.split("\n"):
            words = line.split(" ")
            lines.append(self._chunks(words[:1] + [" " + w for w in words[1:]]))
        return self._chunk("\n").join(lines)

    def _chunks(self, chunks: list[str]) -> bytes:
        make = self._chunk
        out = []
        for chunk in chunks:
            out.append(self.young.get(chunk) or (make(chunk) if chunk else b""))
        return b"".join(out)

    def encode(self, text: str, special: bool = True) -> bytes:
        """Token ids of ``text`` as little-endian 32-bit integers.

        Special strings are one token, or ordinary text where ``special`` is false.
        """
        if not special or self.special_pattern is None or not any(s in text for s in self.special):
            return self._plain(text)
        parts, at = [], 0
        for match in self.special_pattern.finditer(text):
            parts.append(self._plain(text[at : match.start()]))
            parts.append(self.special[match.group()].to_bytes(4, "little"))
            at = match.end()
        parts.append(self._plain(text[at:]))
        return b"".join(parts)

    def decode(self, ids: np.ndarray) -> str:
        """Text of token ids; ids outside the vocabulary stand for nothing."""
        ids = ids[ids < len(self.offsets) - 1].astype(np.int64)
        starts = self.offsets[ids]
        sizes = self.offsets[ids + 1] - starts
        ends = np.cumsum(sizes)
        if len(ids) == 0 or ends[-1] == 0:
            return ""
        source = np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1])
        return self.blob[source].tobytes().decode("utf-8", "replace")


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The tables of a vocabulary file, read once per Python process."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def text_of(blob: bytes | None) -> str:
    return blob.decode("utf-8", "replace") if blob else ""


def encode(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with ``ids array<int>``; a null or empty text has no ids.

    Narrow: no shuffle, each row by itself, so repeated rows, empty tables and other columns
    need no care. ``path`` must be readable on every executor.
    """
    path = path or default_path()

    def make():
        bpe = load(path)

        def step(columns):
            data = [bpe.encode(text_of(b)) for b in blobs(columns[0])]
            offsets = np.concatenate([[0], np.cumsum([len(d) // 4 for d in data])])
            flat = np.frombuffer(b"".join(data), dtype="<i4")
            return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))]

        return step

    return append_columns(docs, [text], make, "ids array<int>")


def decode(tokens: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """``tokens`` with ``decoded``, the text of the column ``ids``; null ids give an empty text."""
    path = path or default_path()

    def make():
        bpe = load(path)

        def step(columns):
            return [
                pa.array(
                    [
                        bpe.decode(np.array([i for i in row.as_py() or [] if i is not None], "<i8"))
                        for row in columns[0]
                    ],
                    pa.string(),
                )
            ]

        return step

    return append_columns(tokens, [ids], make, "decoded string")


def encode_checked(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with ``ids array<int>`` and ``round_trip``, whether decoding them gives the text back.

    As ``encode`` and ``decode``, but in one pass, so a task needs one process and one set of
    tables. A null text counts as an empty one, which has no ids and comes back.
    """
    path = path or default_path()

    def make():
        bpe = load(path)

        def step(columns):
            data, same = [], []
            for blob in blobs(columns[0]):
                whole = text_of(blob)
                data.append(bpe.encode(whole))
                same.append(bpe.decode(np.frombuffer(data[-1], "<u4")) == whole)
            offsets = np.concatenate([[0], np.cumsum([len(d) // 4 for d in data])])
            flat = np.frombuffer(b"".join(data), dtype="<i4")
            return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)), pa.array(same, pa.bool_())]

        return step

    return append_columns(docs, [text], make, "ids array<int>, round_trip boolean")


def round_trip_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every whole text.

    Encodes and decodes within one pass, so neither ids nor decoded texts leave the task.
    """
    path = path or default_path()

    def make():
        bpe = load(path)
        digest = lambda data: hashlib.sha256(data).hexdigest()

        def step(columns):
            counts, ids, texts = [], [], []
            for blob in blobs(columns[0]):
                data = bpe.encode(text_of(blob))
                counts.append(len(data) // 4)
                ids.append(digest(data))
                texts.append(digest(bpe.decode(np.frombuffer(data, "<u4")).encode()))
            return [pa.array(counts, pa.int64()), pa.array(ids), pa.array(texts)]

        return step

    fields = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return append_columns(docs.select("doc_id", "text"), ["text"], make, fields).drop("text")
