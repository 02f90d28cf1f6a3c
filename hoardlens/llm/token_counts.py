"""Token counts that follow edits: a segment tree of pre-token counts per document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hoardlens.llm.bpe import Bpe, default_path, load, text_of
from hoardlens.llm.frames import append_columns, blobs

LEAF = 16  # pre-tokens of a leaf when it is made
CONTEXT = 16  # unchanged characters kept on either side of an edit, at least
KNOWN_PIECES = 500_000
KNOWN_LENGTH = 48  # longer pre-tokens are counted afresh each time

TREE = "struct<chars:array<int>,tokens:array<int>>"


class Counts(dict):
    """Numbers of tokens of the pre-tokens met so far, at most KNOWN_PIECES of them."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> int:
        count = 1 if piece in self.bpe.special else len(self.bpe.ranks(piece.encode()))
        if len(piece) <= KNOWN_LENGTH:
            if len(self) >= KNOWN_PIECES:
                self.clear()
            self[piece] = count
        return count


_counts: dict[int, Counts] = {}


def counts_of(bpe: Bpe) -> Counts:
    """The counts of a vocabulary; as ``load`` keeps it, so does this."""
    if id(bpe) not in _counts:
        _counts[id(bpe)] = Counts(bpe)
    return _counts[id(bpe)]


def context_of(bpe: Bpe) -> int:
    """Characters around an edit that may change their pre-token: a special string may be completed or broken."""
    return max(CONTEXT, *(len(s) + 1 for s in bpe.special), 0)


def pieces_of(bpe: Bpe, text: str) -> list[str]:
    """Pre-tokens of a text; a special string is one of its own."""
    if bpe.special_pattern is None or not any(s in text for s in bpe.special):
        return bpe.pieces(text)
    out, at = [], 0
    for match in bpe.special_pattern.finditer(text):
        out += bpe.pieces(text[at : match.start()])
        out.append(match.group())
        at = match.end()
    return out + bpe.pieces(text[at:])


def measured(bpe: Bpe, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters and tokens of each pre-token."""
    n = len(pieces)
    return (
        np.fromiter(map(len, pieces), np.int64, n),
        np.fromiter(map(counts_of(bpe).__getitem__, pieces), np.int64, n),
    )


class Tree:
    """Sums of characters and tokens; node n has children 2n and 2n + 1, leaves are the last half."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        width = 1 << max(len(chars) - 1, 0).bit_length()
        self.width = width
        self.chars, self.tokens = np.zeros(2 * width, np.int64), np.zeros(2 * width, np.int64)
        for sums, leaves in ((self.chars, chars), (self.tokens, tokens)):
            sums[width : width + len(leaves)] = leaves
            level = width // 2
            while level:
                sums[level : 2 * level] = sums[2 * level : 4 * level].reshape(-1, 2).sum(axis=1)
                level //= 2

    @classmethod
    def of(cls, bpe: Bpe, text: str) -> Tree:
        pieces = pieces_of(bpe, text)
        if not pieces:
            return cls(np.zeros(0, np.int64), np.zeros(0, np.int64))
        cuts = np.arange(0, len(pieces), LEAF)
        return cls(*[np.add.reduceat(x, cuts) for x in measured(bpe, pieces)])

    @classmethod
    def stored(cls, chars: np.ndarray, tokens: np.ndarray) -> Tree:
        made = cls.__new__(cls)
        made.chars, made.tokens = chars.astype(np.int64), tokens.astype(np.int64)
        made.width = len(chars) // 2
        return made

    def _sum(self, n: int) -> None:
        self.chars[n] = self.chars[2 * n] + self.chars[2 * n + 1]
        self.tokens[n] = self.tokens[2 * n] + self.tokens[2 * n + 1]

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    @property
    def length(self) -> int:
        return int(self.chars[1])

    def find(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, the last one for the end of the text, and its first character."""
        n, before, length = 1, 0, self.length
        while n < self.width:
            n *= 2
            after = before + int(self.chars[n])
            if char >= after and after < length:
                before = after
                n += 1
        return n, before

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        self.chars[leaf], self.tokens[leaf] = chars, tokens
        n = leaf // 2
        while n:
            self._sum(n)
            n //= 2


def apply_edit(bpe: Bpe, tree: Tree, text: str, start: int, removed: int, inserted: str) -> tuple[Tree, str, int]:
    """The tree and text after an edit, and how many characters were encoded anew.

    Encoding starts at a leaf that leaves some unchanged characters (``context_of``) before the edit, since a
    pre-token depends on the few characters behind it. It ends where a new pre-token begins at
    the border of an old leaf, as many characters or more behind the edit: from there on the
    text, and so every pre-token, is as before. A place outside the text is moved inside.
    """
    context = context_of(bpe)
    start = min(max(start, 0), len(text))
    removed = min(max(removed, 0), len(text) - start)
    changed = text[:start] + inserted + text[start + removed :]
    first, begin = tree.find(max(start - context, 0)) if len(text) else (tree.width, 0)
    shift = len(inserted) - removed
    last, last_begin = tree.find(start + removed + context) if len(text) else (tree.width, 0)
    while True:
        end = last_begin + int(tree.chars[last])
        pieces = pieces_of(bpe, changed[begin : end + shift + context])
        sizes, counts = measured(bpe, pieces)
        ends = np.cumsum(sizes)
        whole = end >= len(text)
        border = int(np.searchsorted(ends, end + shift - begin))
        if whole or border < len(ends) and ends[border] == end + shift - begin:
            break
        # No common border here: one more leaf.
        last += 1
        last_begin = end
    count = len(pieces) if whole else border + 1
    encoded = int(ends[count - 1]) if count else 0
    leaves = range(first, last + 1)
    if count > 4 * LEAF * len(leaves):
        return Tree.of(bpe, changed), changed, len(changed)
    share = -(-count // len(leaves)) or 1
    for i, leaf in enumerate(leaves):
        part = slice(min(i * share, count), min((i + 1) * share, count))
        tree.put(leaf, int(sizes[part].sum()), int(counts[part].sum()))
    return tree, changed, encoded


def _stored(trees: list[Tree]) -> pa.Array:
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(t.chars) for t in trees])]), pa.int32())
    sums = [np.concatenate([getattr(t, n) for t in trees]).astype(np.int32) for n in ("chars", "tokens")]
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(s)) for s in sums], ["chars", "tokens"])


def _trees(column: pa.Array):
    """Stored trees; None for a null."""
    chars, tokens = column.field("chars"), column.field("tokens")
    for i, given in enumerate(column.is_valid().to_pylist()):
        fields = (f[i].values.to_numpy() for f in (chars, tokens))
        yield Tree.stored(*fields) if given else None


def count_tokens(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``tree``, the sums that later edits need.

    Null and empty texts count 0. One narrow pass; repeated rows and empty tables need no care,
    other columns pass through under any name.
    """
    path = path or default_path()

    def make():
        bpe = load(path)

        def step(columns):
            trees = [Tree.of(bpe, text_of(b)) for b in blobs(columns[0])]
            return [pa.array([t.total for t in trees], pa.int64()), _stored(trees)]

        return step

    return append_columns(docs, [text], make, f"n_tokens bigint, tree {TREE}")


EDITS = "array<struct<start:int,removed:int,inserted:string>>"


def _edited(bpe: Bpe, tree: Tree, text: str, edits: list[dict] | None) -> tuple[Tree, str, int]:
    encoded = 0
    for e in edits or []:
        tree, text, n = apply_edit(bpe, tree, text, e["start"] or 0, e["removed"] or 0, e["inserted"] or "")
        encoded += n
    return tree, text, encoded


def edit_counts(
    docs: DataFrame, text: str = "text", tree: str = "tree", edits: str = "edits", path: str | None = None
) -> DataFrame:
    """``docs`` with ``edited_tokens, edited_text, edited_tree, encoded_chars`` after its edits.

    ``edits`` is a list of ``start, removed, inserted`` in code points, applied in order; null
    counts as none, and null parts as 0 or nothing. A null text is empty, a null tree is made
    from the text.
    """
    path = path or default_path()

    def make():
        bpe = load(path)

        def step(columns):
            rows = []
            for blob, tree, changes in zip(blobs(columns[0]), _trees(columns[1]), columns[2].to_pylist()):
                now = text_of(blob)
                rows.append(_edited(bpe, tree or Tree.of(bpe, now), now, changes))
            trees, texts, encoded = zip(*rows)
            return [
                pa.array([t.total for t in trees], pa.int64()), pa.array(texts, pa.string()),
                _stored(list(trees)), pa.array(encoded, pa.int64()),
            ]

        return step

    fields = f"edited_tokens bigint, edited_text string, edited_tree {TREE}, encoded_chars bigint"
    return append_columns(docs, [text, tree, edits], make, fields)


def two_edits() -> Column:
    """Two edits of a document that its own columns decide.

    Ten characters at a hashed place give way to language and source, and three at another place go.
    """
    length = F.coalesce(F.char_length("text"), F.lit(0))
    at = lambda n: F.pmod(F.xxhash64("doc_id", F.lit(n)), length + 1).cast("int")
    edit = lambda start, removed, inserted: F.struct(
        start.alias("start"), F.lit(removed).alias("removed"), inserted.alias("inserted")
    )
    return F.array(edit(at(1), 10, F.concat_ws(" ", "lang", "source")), edit(at(2), 3, F.lit("")))


def edited_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Counts of every document before and after ``two_edits``.

    ``edited_chars`` is the new length, ``encoded_chars`` what was encoded for the edits. The
    tree of a document is made and edited in one pass, so it does not leave its task.
    """
    path = path or default_path()

    def make():
        bpe = load(path)

        def step(columns):
            rows = []
            for blob, changes in zip(blobs(columns[0]), columns[1].to_pylist()):
                text = text_of(blob)
                tree = Tree.of(bpe, text)
                before = tree.total
                tree, text, encoded = _edited(bpe, tree, text, changes)
                rows.append((before, tree.total, tree.length, encoded))
            return [pa.array(c, pa.int64()) for c in zip(*rows)]

        return step

    edited = docs.select("doc_id", "text", two_edits().alias("edits"))
    fields = "n_tokens bigint, edited_tokens bigint, edited_chars bigint, encoded_chars bigint"
    return append_columns(edited, ["text", "edits"], make, fields).drop("text", "edits")
