"""Alignment of two tokenizations of one text by galloping intersection of their byte ends."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoardlens.llm import bpe
from hoardlens.llm.frames import append_columns, blobs, text_slices
from hoardlens.workspace import materialize

PIECES = "piece_bpe_32k.model"
SEGMENT = 1 << 20  # characters of a long text that are aligned at a time
SLICE_BYTES = 1 << 20  # texts whose ends are intersected together
BLANK = "▁"  # stands for a space in a piece
LONG_RUN = 50_000  # white space in a row that only the slower encoder takes
_LONG_RUN = re.compile(rf"\s{{{LONG_RUN}}}")
# Both tokenizers end a token before a single space between other characters.
_CUT = re.compile(r"(?<=\S) (?=\S)")


class Tokens:
    """Bytes of the tokens of one vocabulary by id."""

    def __init__(self, data: list[bytes]):
        self.data = data
        self.lengths = np.array([len(d) for d in data], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(data), np.uint8)

    def joined(self, ids: np.ndarray, ends: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        size = self.lengths[ids]
        source = np.repeat(self.starts[ids] - ends + size, size) + np.arange(ends[-1])
        return self.blob[source].tobytes()


class Pair:
    """Two tokenizers, and a number for every pair of ids that can end together.

    Where two tokens end together the bytes of the shorter are the end of the longer, so the
    vocabularies alone bound the number of pairs, by the bytes they hold.
    """

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken

        with open(path_a, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        number = {letter: b for b, letter in enumerate(bpe.byte_letters())}
        by_id = {i: bytes(number[c] for c in name) for name, i in vocab.items()}
        self.a = Tokens([by_id.get(i, b"") for i in range(max(by_id) + 1)])
        self.path_a = path_a
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        self.fast = None
        if merged == sorted(merged):  # ids in the order of the merges can serve as ranks
            ranks = {d: i for i, d in by_id.items()}
            self.fast = tiktoken.Encoding("a", pat_str=bpe.PIECE, mergeable_ranks=ranks, special_tokens={})
        model = self.model = sentencepiece.SentencePieceProcessor(model_file=path_b)
        data = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if BLANK in piece.lstrip(BLANK):
                raise ValueError(f"piece {piece!r} spans a space, texts cannot be cut there")
            data.append(bytes([int(piece[1:-1], 16)]) if model.is_byte(i) else piece.replace(BLANK, " ").encode())
        self.b = Tokens(data)
        self.keys = self._keys()
        # Ids as they are written, followed by a comma, or by the mark that ends a list.
        self.names = [n for i in range(len(self.a.data)) for n in (b"%d," % i, b"%d|" % i)]
        self.names += [n for i in range(len(data)) for n in (b"%d," % i, b"%d;" % i)]

    def _keys(self) -> np.ndarray:
        def by_bytes(data):
            found: dict[bytes, list[int]] = {}
            for i, d in enumerate(data):
                if d:
                    found.setdefault(d, []).append(i)
            return found

        a, b = by_bytes(self.a.data), by_bytes(self.b.data)
        keys = set()
        for d, ids in a.items():
            for at in range(len(d)):
                keys.update(i << 32 | j for j in b.get(d[at:], ()) for i in ids)
        for d, ids in b.items():
            for at in range(1, len(d)):
                keys.update(i << 32 | j for i in a.get(d[at:], ()) for j in ids)
        return np.array(sorted(keys), np.int64)

    def number(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, a.astype(np.int64) << 32 | b).astype(np.int32)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of a space and each text by both tokenizers; special tokens are ordinary text."""
        a = [self._encode_a(" " + t) for t in texts]
        b = [np.array(ids, np.int64) for ids in self.model.encode(texts, num_threads=1)]
        return a, b

    def _encode_a(self, text: str) -> np.ndarray:
        # The library's pattern overflows on very long runs of white space.
        if self.fast is None or len(text) > LONG_RUN and _LONG_RUN.search(text):
            return np.frombuffer(bpe.load(self.path_a).encode(text, special=False), "<u4").astype(np.int64)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)


@lru_cache(maxsize=2)
def load(path_a: str, path_b: str) -> Pair:
    """The tables of two vocabulary files, built once per Python process."""
    return Pair(path_a, path_b)


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return bpe.default_path(), public_tokenizers.path(PIECES)


def gallop(keys: np.ndarray, longer: np.ndarray, start: np.ndarray) -> np.ndarray:
    """First place in ``longer`` of a value not below each key: doubling steps up, then halving.

    Every key has its own ``start``, at or below its place; no key exceeds the last value.
    """
    low, high, step = start.copy(), start.copy(), 1
    moving = np.flatnonzero(longer[high] < keys)
    while len(moving):
        low[moving] = high[moving] + 1
        high[moving] = np.minimum(high[moving] + step, len(longer) - 1)
        moving = moving[longer[high[moving]] < keys[moving]]
        step *= 2
    moving = np.flatnonzero(low < high)
    while len(moving):
        middle = (low[moving] + high[moving]) // 2
        below = longer[middle] < keys[moving]
        low[moving[below]] = middle[below] + 1
        high[moving[~below]] = middle[~below]
        moving = moving[low[moving] < high[moving]]
    return low


def places(shorter: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Place in ``longer`` of the first end not below each end of ``shorter``; both end alike.

    Ends far apart gallop first; those between start where their left neighbour came to rest.
    """
    found = np.zeros(len(shorter), np.int64)
    if not len(shorter):
        return found
    found[:1] = gallop(shorter[:1], longer, found[:1])
    stride = 1 << max(len(shorter) - 1, 1).bit_length()
    while stride:
        at = np.arange(stride, len(shorter), 2 * stride)
        found[at] = gallop(shorter[at], longer, found[at - stride])
        stride //= 2
    return found


def intersect(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks in both lists of their common ends, and the rank in ``ends_b`` of every end of ``ends_a``.

    The shorter list drives. Ranks the other way round follow from counting the places up to an
    end, less the end itself where it is common.
    """
    if len(ends_a) <= len(ends_b):
        rank = places(ends_a, ends_b)
        common = np.flatnonzero(ends_b[rank] == ends_a) if len(rank) else rank
        return common, rank[common], rank
    place = places(ends_b, ends_a)
    common = np.flatnonzero(ends_a[place] == ends_b) if len(place) else place
    rank = np.cumsum(np.bincount(place, minlength=len(ends_a)))
    rank[place[common]] -= 1
    return place[common], common, rank


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last token of b that share bytes with each token of a, from the ranks of its ends."""
    passed = rank + (ends_b[rank] == ends_a) if len(rank) else rank
    return np.concatenate([[0], passed[:-1]])[: len(rank)], rank


def segments(text: str) -> Iterator[str]:
    """Cuts of a long text that no token spans; each is to be read with a space before it."""
    at = 0
    while True:
        cut = _CUT.search(text, at + SEGMENT) if len(text) - at > SEGMENT else None
        yield text[at : cut.start()] if cut else text[at:]
        if not cut:
            return
        at = cut.end()


class Aligned:
    """Both tokenizations of a slice of texts, laid end to end, and their common ends."""

    def __init__(self, pair: Pair, texts: list[str]):
        a, b = pair.encode(texts)
        self.fits = []
        for n, text in enumerate(texts):
            whole = b" " + text.encode()
            ends = [np.cumsum(v.lengths[ids]) for v, ids in ((pair.a, a[n]), (pair.b, b[n]))]
            self.fits.append(pair.a.joined(a[n], ends[0]) == whole and pair.b.joined(b[n], ends[1]) == whole)
            if not self.fits[-1]:
                a[n] = b[n] = a[n][:0]
        self.a, self.b = np.concatenate(a), np.concatenate(b)
        self.ends_a, self.ends_b = np.cumsum(pair.a.lengths[self.a]), np.cumsum(pair.b.lengths[self.b])
        self.common_a, self.common_b, self.rank = intersect(self.ends_a, self.ends_b)
        self.links = pair.number(self.a[self.common_a], self.b[self.common_b])
        # Where each text begins among the tokens of a, those of b, and the groups.
        self.from_a = np.concatenate([[0], np.cumsum([len(x) for x in a])])
        self.from_b = np.concatenate([[0], np.cumsum([len(x) for x in b])])
        self.from_group = np.searchsorted(self.common_a, self.from_a)
        self.pair = pair

    def written(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3;`` of each text: tokens of a group of a, then those of b."""
        last_a, last_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        last_a[self.common_a] = last_b[self.common_b] = 1
        size_a = np.diff(self.common_a, prepend=-1)
        size_b = np.diff(self.common_b, prepend=-1)
        before_b = np.cumsum(size_b) - size_b
        order = np.empty(len(self.a) + len(self.b), np.int64)
        order[np.arange(len(self.a)) + np.repeat(before_b, size_a)] = 2 * self.a + last_a
        through_a = np.cumsum(size_a)
        order[np.arange(len(self.b)) + np.repeat(through_a, size_b)] = 2 * (len(self.pair.a.data) + self.b) + last_b
        name = self.pair.names.__getitem__
        cuts = self.from_a + self.from_b
        return [b"".join(map(name, order[s:e].tolist())) for s, e in zip(cuts[:-1], cuts[1:])]


def _digest(pair: Pair, texts: list[str]) -> list[tuple]:
    """``n_a, n_b, n_groups, digest, links`` of each text; long texts are read segment by segment."""
    if len(texts) == 1 and len(texts[0]) > SEGMENT:
        n_a = n_b = 0
        links, digest, held = [], hashlib.sha256(), b""
        for segment in segments(texts[0]):
            part = Aligned(pair, [segment])
            if not part.fits[0]:
                return [(0, 0, 0, "", np.zeros(0, np.int32))]
            n_a, n_b = n_a + len(part.a), n_b + len(part.b)
            links.append(part.links)
            digest.update(held)
            held = part.written()[0]
        digest.update(held[:-1])
        links = np.concatenate(links)
        return [(n_a, n_b, len(links), digest.hexdigest(), links)]
    part = Aligned(pair, texts)
    out = []
    for n, data in enumerate(part.written()):
        links = part.links[part.from_group[n] : part.from_group[n + 1]]
        digest = hashlib.sha256(data[:-1]).hexdigest() if data else ""
        n_a, n_b = (int(f[n + 1] - f[n]) for f in (part.from_a, part.from_b))
        out.append((n_a, n_b, len(links), digest, links))
    return out


def _lists(parts: list[np.ndarray], kind) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    flat = np.concatenate([np.zeros(0, np.int64), *parts])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def align_tokens(
    docs: DataFrame, text: str = "text", path_a: str | None = None, path_b: str | None = None
) -> DataFrame:
    """``docs`` with both tokenizations and how their tokens correspond.

    ``a_ids, b_ids``: tokens of a space and the text. ``group_a, group_b``: for each stretch of
    bytes between common ends the number of tokens of each side. ``first_b, last_b``: for each
    token of a the tokens of b that share bytes with it, counted from 0.

    A null or empty text, and one that a tokenizer does not give back byte by byte, has empty
    lists. Narrow: rows are independent, so repeated rows, empty tables and other columns need
    no care. The files must be readable on every executor.
    """
    paths = (path_a or default_paths()[0], path_b or default_paths()[1])

    def make():
        pair = load(*paths)

        def step(columns):
            out = [[] for _ in range(6)]
            for texts in text_slices(blobs(columns[0]), SLICE_BYTES):
                for one in texts:
                    part = Aligned(pair, [one])
                    first, last = overlaps(part.ends_a, part.ends_b, part.rank)
                    sizes = [np.diff(c, prepend=-1) for c in (part.common_a, part.common_b)]
                    for column, values in zip(out, (part.a, part.b, *sizes, first, last)):
                        column.append(values)
            return [_lists(c, pa.int32()) for c in out]

        return step

    fields = ", ".join(f"{n} array<int>" for n in ("a_ids", "b_ids", "group_a", "group_b", "first_b", "last_b"))
    return append_columns(docs, [text], make, fields)


def link_documents(
    docs: DataFrame, text: str = "text", path_a: str | None = None, path_b: str | None = None
) -> DataFrame:
    """``docs`` with ``n_a, n_b, n_groups, n_links, groups_sha256`` and ``links array<int>``.

    A link is a pair of tokens that end together, written as the number of its pair of ids.
    """
    paths = (path_a or default_paths()[0], path_b or default_paths()[1])

    def make():
        pair = load(*paths)

        def step(columns):
            rows = []
            for texts in text_slices(blobs(columns[0]), SLICE_BYTES):
                full = _digest(pair, [t for t in texts if t]) if any(texts) else []
                found = iter(full)
                rows += [next(found) if t else (0, 0, 0, "", np.zeros(0, np.int32)) for t in texts]
            n_a, n_b, groups, digests, links = zip(*rows)
            counts = [pa.array(c, pa.int64()) for c in (n_a, n_b, groups, groups)]
            return [*counts, pa.array(digests, pa.string()), _lists(list(links), pa.int32())]

        return step

    fields = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links array<int>"
    return append_columns(docs, [text], make, fields)


def count_pairs(linked: DataFrame) -> DataFrame:
    """``pair, n``: links of each pair of ids over all documents; counts are combined before the shuffle."""
    return linked.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


def alignment_digest(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Per document the sizes of its alignment, ``n_best``, ``count_sum`` and ``groups_sha256``.

    The links of a document are stored once. Their counts are summed by Spark; one number for
    each pair of ids that the two vocabularies allow goes to the driver and back as an array,
    whose length the vocabulary files fix, whatever the documents.

    Rows without tokens (null or empty text, or one that a tokenizer changes) have zeros and an
    empty digest. Repeated rows are documents of their own and count each time. Long texts are
    cut where no token can span the cut and aligned piece by piece.
    """
    paths = (path_a or default_paths()[0], path_b or default_paths()[1])
    linked = materialize(link_documents(docs.select("doc_id", "text"), "text", *paths).drop("text"), "links")
    keys = load(*paths).keys
    counts = np.zeros(len(keys), np.int64)
    table = count_pairs(linked).toArrow()
    counts[table.column("pair").to_numpy()] = table.column("n").to_numpy()
    b = keys & 0xFFFFFFFF
    highest = np.zeros(b.max(initial=0) + 1, np.int64)
    np.maximum.at(highest, b, counts)
    figures = docs.sparkSession.sparkContext.broadcast((counts, counts == highest[b]))

    def make():
        counts, best = figures.value

        def step(columns):
            lists = columns[0]
            flat = lists.flatten().to_numpy()
            ends = np.cumsum(lists.value_lengths().to_numpy())
            sums = np.concatenate([[0], np.cumsum(counts[flat])])
            bests = np.concatenate([[0], np.cumsum(best[flat])])
            found = [s[ends] - s[np.concatenate([[0], ends[:-1]])] for s in (bests, sums)]
            return [pa.array(f, pa.int64()) for f in found]

        return step

    scored = append_columns(linked, ["links"], make, "n_best bigint, count_sum bigint")
    return scored.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
