"""Removal of passages that an earlier document holds, by suffix arrays over shards of text.

Every 50-byte string holds a 24-byte anchor that its bytes alone decide. Strings around one
anchor, of whatever document, meet in one shard; its suffix array, built by induced sorting, and
the permuted common prefixes show which strings are equal.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hoardlens.llm.frames import Sieve
from hoardlens.operators.skew import join_keyed
from hoardlens.workspace import materialize

LENGTH = 50
ANCHOR = 24  # bytes, a multiple of 8; shorter ones meet by chance, longer ones are more
ANCHOR_BITS = 1 << 27  # 16 MB sieve
COMMON = 5_000  # documents of an anchor from which its strings are dealt out one by one
SEEN = 200_000  # texts a task remembers, so that copies are sent once
RUN_BYTES = 1 << 16  # of texts whose anchors are sought at once
SHARD_BYTES = 500_000  # text of one suffix array, some 100 bytes of memory each; an anchor is never cut

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(29))
    return x * _U(0xA0761D6478BD642F)


def words8(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number, little end first."""
    n = len(data) - 7
    out = np.empty(max(n, 0), _U)
    for shift in range(min(8, max(n, 0))):
        count = (n - shift + 7) // 8
        out[shift::8] = data[shift : shift + 8 * count].view("<u8")
    return out


def anchors(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of one text, see ``anchors_of_texts``."""
    return anchors_of_texts(data, np.zeros(1, np.int64), np.array([len(data)]), length)[1:]


def anchors_of_texts(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray, length: int = LENGTH):
    """Anchor of every string of ``length`` bytes: the least hash of its 24-byte pieces, leftmost first.

    The texts stand one behind the other in ``data``; no string reaches over two of them. Strings
    that start side by side mostly share their anchor. Returns, per run of starts with one anchor,
    the text's number, the anchor's place in ``data``, its hash, the first and the last start.
    """
    long = np.flatnonzero(sizes >= length)
    if len(long) == 0:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty, empty
    mixes = _mix(words8(data))
    count = len(data) - ANCHOR + 1
    hashes = mixes[:count].copy()
    for at in range(8, ANCHOR, 8):
        hashes += mixes[at : at + count] * _U(0x9E3779B97F4A7C15 + 2 * at)
    hashes = _mix(hashes)
    # Least of 2, 4, ... neighbours by half a hash and the place, so the left one of equals.
    least = (hashes & _U(0xFFFFFFFF00000000)) | np.arange(count, dtype=_U)
    span, pieces = 1, length - ANCHOR + 1
    while span < pieces:
        step = min(span, pieces - span)
        least = np.minimum(least[step:], least[: len(least) - step])
        span += step
    heads, tails = begins[long], begins[long] + sizes[long] - length
    edge = np.zeros(len(least) + 1, np.int8)
    edge[heads], edge[tails + 1] = 1, -1
    fresh = np.concatenate([[True], least[1:] != least[:-1]])
    fresh[heads] = True
    first = np.flatnonzero(fresh & (np.cumsum(edge[:-1], dtype=np.int8) == 1))
    owner = np.searchsorted(heads, first, side="right") - 1
    last = np.minimum(np.append(first[1:], len(least)) - 1, tails[owner])
    place = (least[first] & _U(0xFFFFFFFF)).astype(np.int64)
    return long[owner], place, hashes[place].view(np.int64), first, last


# Induced sorting.


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one."""
    n = len(text)
    change = np.empty(n, bool)
    change[:-1] = text[:-1] != text[1:]
    change[-1] = True
    # For each place, the next one from which the letter changes decides.
    at = np.where(change, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    smaller = np.zeros(n + 1, bool)
    smaller[:-1][:-1] = text[:-1] < text[1:]
    return smaller[at]


def _induce(text, smaller, lms_sorted, starts, ends):
    """The suffix array that sorted leftmost-smaller suffixes bring about.

    Letters are taken in order; all suffixes of a letter found so far pass their predecessors on
    to the predecessors' letters at once, so the work is linear and done in whole arrays.
    """
    n = len(text)
    array = np.full(n, -1, np.int64)
    letters = len(starts)
    by_letter = text[lms_sorted]
    low = np.searchsorted(by_letter, np.arange(letters))
    high = np.searchsorted(by_letter, np.arange(letters), side="right")

    def give(found, heads, sign):
        kinds = text[found]
        order = np.argsort(kinds, kind="stable")
        kinds, found = kinds[order], found[order]
        first = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1]]))
        size = np.diff(np.append(first, len(kinds)))
        rank = np.arange(len(kinds)) - np.repeat(first, size)
        array[heads[kinds] + sign * rank] = found
        heads[kinds[first]] += sign * size

    heads = starts.copy()
    if not smaller[n - 1]:
        heads_at = heads[text[n - 1]]
        array[heads_at] = n - 1
        heads[text[n - 1]] += 1
    for c in range(letters):
        done = starts[c]
        while done < heads[c]:
            batch = array[done : heads[c]]
            done = heads[c]
            before = batch[batch > 0] - 1
            before = before[~smaller[before]]
            if len(before):
                give(before, heads, 1)
        batch = lms_sorted[low[c] : high[c]]
        before = batch[batch > 0] - 1
        before = before[~smaller[before]]
        if len(before):
            give(before, heads, 1)
    large_end = heads
    tails = ends - 1
    for c in range(letters - 1, -1, -1):
        done = ends[c] - 1
        while done > tails[c]:
            batch = array[tails[c] + 1 : done + 1][::-1]
            done = tails[c]
            before = batch[batch > 0] - 1
            before = before[smaller[before]]
            if len(before):
                give(before, tails, -1)
        batch = array[starts[c] : large_end[c]][::-1]
        before = batch[batch > 0] - 1
        before = before[smaller[before]]
        if len(before):
            give(before, tails, -1)
    return array


def _sort_reduced(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of the string of names, as far as ``depth`` names decide.

    Each round doubles the names that are compared: the rank of a suffix and that of the one behind
    its sorted part make the next rank. Only suffixes that share their rank are sorted again.
    """
    order = np.argsort(names, kind="stable")
    rank, span = np.empty(len(names), np.int64), 1
    tied, key = np.arange(len(names)), names[order]
    while True:
        # The rank of a suffix is the place of the first one that is equal so far.
        first = np.concatenate([[True], key[1:] != key[:-1]])
        rank[order[tied]] = np.maximum.accumulate(np.where(first, tied, 0))
        tied = tied[~(first & np.append(first[1:], True))]
        if span >= depth or len(tied) == 0:
            return order
        found = order[tied]
        behind = np.zeros(len(found), np.int64)
        inside = found + span < len(names)
        behind[inside] = rank[found[inside] + span] + 1
        key = rank[found] * (len(names) + 2) + behind
        sub = np.argsort(key, kind="stable")
        key, order[tied] = key[sub], found[sub]
        span *= 2


def suffix_array(text: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Suffixes of ``text`` (letters from 0 on) in the order of their first ``length`` letters.

    Suffixes are classified, the leftmost-smaller substrings sorted by one induction and named,
    the string of names is sorted by doubling, and a second induction gives all suffixes.
    Suffixes equal in ``length`` letters stand side by side in any order.
    """
    n = len(text)
    if n < 2:
        return np.arange(n)
    smaller = _types(text)
    letters = int(text.max()) + 1
    counts = np.bincount(text, minlength=letters)
    ends = np.cumsum(counts)
    starts = ends - counts
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(lms) == 0:
        return _induce(text, smaller, lms, starts, ends)
    rough = lms[np.argsort(text[lms], kind="stable")]
    array = _induce(text, smaller, rough, starts, ends)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = array[is_lms[array]]
    # Neighbours get one name if their substrings, up to the next leftmost-smaller place, agree.
    number = np.empty(n, np.int64)
    number[lms] = np.arange(len(lms))
    stop = np.append(lms[1:], n - 1)
    size = stop[number[ordered]] - ordered
    same = size[1:] == size[:-1]
    a, b = ordered[:-1], ordered[1:]
    open_pairs = np.flatnonzero(same)
    offset = 0
    while len(open_pairs):
        equal = text[a[open_pairs] + offset] == text[b[open_pairs] + offset]
        same[open_pairs[~equal]] = False
        open_pairs = open_pairs[equal]
        offset += 1
        open_pairs = open_pairs[size[open_pairs] >= offset]
    names = np.empty(len(lms), np.int64)
    names[number[ordered]] = np.concatenate([[0], np.cumsum(~same)])
    if names.max() + 1 < len(lms):
        # A leftmost-smaller substring covers two letters at least.
        ordered = lms[_sort_reduced(names, -(-length // 2) + 1)]
    return _induce(text, smaller, ordered, starts, ends)


def permuted_prefixes(data: np.ndarray, array: np.ndarray, length: int = LENGTH):
    """For each place, the place before it in the array, and how many bytes both share (``length`` at most)."""
    n = len(data)
    before = np.empty(n, np.int64)
    before[array[1:]] = array[:-1]
    before[array[0]] = array[0]
    w = words8(np.concatenate([data, np.zeros(length + 8, np.uint8)]))
    common = np.full(n, length, np.int64)
    alive = np.arange(n)
    for offset in range(0, length, 8):
        x = w[alive + offset] ^ w[before[alive] + offset]
        differ = x != 0
        x = x[differ]
        same = np.bitwise_count((x & (~x + _U(1))) - _U(1)).astype(np.int64) // 8
        common[alive[differ]] = np.minimum(offset + same, length)
        alive = alive[~differ]
    common[array[0]] = 0
    return before, common


def earliest(contexts: list[bytes], owners: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each string of ``length`` bytes of each context, the least owner of an equal string."""
    sizes = np.array([len(c) for c in contexts])
    ends = np.cumsum(sizes + 1)
    begins = ends - sizes - 1
    data = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    text = data.astype(np.int16) + 1
    text[ends - 1] = 0
    array = suffix_array(text, length)
    before, common = permuted_prefixes(data, array, length)
    context = np.repeat(np.arange(len(contexts)), sizes + 1)
    whole = np.arange(len(data)) + length <= (ends - 1)[context]
    # A shorter suffix, which a separator ends, cannot stand between equal strings.
    ordered = array[whole[array]]
    fresh = ((common < length) | ~whole[before])[ordered]
    fresh[0] = True
    first = np.flatnonzero(fresh)
    least = np.minimum.reduceat(owners[context[ordered]], first)
    answer = np.empty(len(data), np.int64)
    answer[ordered] = np.repeat(least, np.diff(np.append(first, len(ordered))))
    return [answer[b : b + s - length + 1] for b, s in zip(begins, sizes)]


# Passes over the documents.


class _Copies:
    """Texts a task has met, with the least id."""

    def __init__(self):
        self.least: dict[int, int] = {}

    def again(self, text_key: int, doc_id: int) -> bool:
        known = self.least.get(text_key)
        if known is not None and known <= doc_id:
            return True
        if len(self.least) >= SEEN:
            self.least.clear()
        self.least[text_key] = doc_id
        return False


def _rows(batches, copied: Sieve):
    """Documents to look at, one of each text per task where that is known."""
    seen = _Copies()
    for batch in batches:
        keys = batch.column(1).to_numpy(zero_copy_only=False)
        held = copied.passes(keys) & batch.column(3).to_numpy(zero_copy_only=False)
        texts = batch.column(2)
        for i in np.flatnonzero(~held):
            doc_id, key = batch.column(0)[i].as_py(), int(keys[i])
            if not seen.again(key, doc_id):
                yield doc_id, key, np.frombuffer(texts[i].as_buffer(), np.uint8)


def _runs(batches, copied: Sieve):
    """Documents to look at in runs of about RUN_BYTES: ids, text keys, joined texts and their anchors."""

    def run(rows):
        ids, keys = (np.array(c, np.int64) for c in list(zip(*rows))[:2])
        raw = b"".join([r[2] for r in rows])
        sizes = np.array([len(r[2]) for r in rows])
        begins = np.cumsum(sizes) - sizes
        return ids, keys, raw, begins, anchors_of_texts(np.frombuffer(raw, np.uint8), begins, sizes)

    rows, size = [], 0
    for row in _rows(batches, copied):
        if rows and size + len(row[2]) > RUN_BYTES:
            yield run(rows)
            rows, size = [], 0
        rows.append(row)
        size += len(row[2])
    if rows:
        yield run(rows)


def _batch(names, kinds, columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _anchor_rows(copied: Sieve):
    def run(batches):
        for ids, _, _, _, (text, _, hashes, _, _) in _runs(batches, copied):
            order = np.lexsort((hashes, text))
            text, hashes = text[order], hashes[order]
            fresh = np.append(True, (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1]))[: len(text)]
            yield _batch(["anchor", "doc_id"], [pa.int64(), pa.int64()], [hashes[fresh], ids[text[fresh]]])

    return run


def _form(string: bytes) -> int:
    return xxhash.xxh3_64_intdigest(string) - (1 << 63)


def _forms(raw: bytes, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of all strings that start in each range."""
    spans = zip(first.tolist(), (last + LENGTH).tolist())
    return np.array([_form(raw[a:b]) for a, b in spans], np.int64)


def _occurrences(copied: Sieve, shared: Sieve, common: Sieve):
    """Places of shared anchors with a hash, the form, of all strings around them.

    For a common anchor each string stands for itself, named by its own hash.
    """
    names = ["anchor", "doc_id", "text_key", "start", "size", "form", "alone"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()]

    def run(batches):
        for ids, keys, raw, begins, (text, _, hashes, first, last) in _runs(batches, copied):
            wanted = np.flatnonzero(shared.passes(hashes))
            single = common.passes(hashes[wanted])
            at = wanted[~single]
            own, start, size = text[at], first[at] - begins[text[at]], last[at] - first[at] + 1
            forms = _forms(raw, first[at], last[at])
            yield _batch(names, kinds, [hashes[at], ids[own], keys[own], start, size, forms, np.zeros(len(at), bool)])
            if single.any():
                at = wanted[single]
                size = last[at] - first[at] + 1
                own, ends = np.repeat(text[at], size), np.cumsum(size)
                place = np.arange(ends[-1]) + np.repeat(first[at] - ends + size, size)
                one, none = np.ones(len(own), np.int64), np.zeros(len(own), np.int64)
                strings = _forms(raw, place, place)
                yield _batch(names, kinds, [strings, ids[own], keys[own], place - begins[own], one, none, one == 1])

    return run


def _contexts(copied: Sieve, contested: Sieve, first_of_form: Sieve):
    """The strings themselves around anchors that come in several forms, once per form."""
    names = ["anchor", "doc_id", "text_key", "start", "context"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches):
        for ids, keys, raw, begins, (text, _, hashes, first, last) in _runs(batches, copied):
            at = np.flatnonzero(contested.passes(hashes))
            at = at[first_of_form.passes(hashes[at] ^ _forms(raw, first[at], last[at]) ^ ids[text[at]])]
            own = text[at]
            pieces = [raw[a:b] for a, b in zip(first[at].tolist(), (last[at] + LENGTH).tolist())]
            yield _batch(names, kinds, [hashes[at], ids[own], keys[own], first[at] - begins[own], pieces])

    return run


def _shards(batches):
    """Contexts sorted by anchor in; out come ranges whose strings an earlier document holds."""

    def done(rows):
        owners = np.array([r[1] for r in rows], np.int64)
        out = [[], [], [], []]
        for row, least in zip(rows, earliest([r[4] for r in rows], owners)):
            repeated = np.concatenate([[False], least < row[1], [False]])
            edges = np.flatnonzero(repeated[1:] != repeated[:-1]).reshape(-1, 2)
            for a, b in edges.tolist():
                for column, value in zip(out, (row[1], row[2], row[3] + a, row[3] + b - 1 + LENGTH)):
                    column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "text_key", "begin", "end"]
        )

    rows, size = [], 0
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if size >= SHARD_BYTES and row[0] != rows[-1][0]:
                yield done(rows)
                rows, size = [], 0
            rows.append(row)
            size += len(row[4]) + 1
    if rows:
        yield done(rows)


def _cut(batches):
    """Kept bytes of documents with removed intervals."""
    for batch in batches:
        out = [[], [], [], [], []]
        for doc_id, key, text, spans in zip(*[batch.column(i) for i in range(4)]):
            data = np.frombuffer(text.as_buffer(), np.uint8)
            edge = np.zeros(len(data) + 1, np.int64)
            values = spans.values
            np.add.at(edge, values.field(0).to_numpy(), 1)
            np.add.at(edge, values.field(1).to_numpy(), -1)
            gone = np.cumsum(edge[:-1]) > 0
            count = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
            row = (doc_id.as_py(), key.as_py(), int(gone.sum()), count, hashlib.sha256(data[~gone].tobytes()).hexdigest())
            for column, value in zip(out, row):
                column.append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()),
             pa.array(out[3], pa.int64()), pa.array(out[4], pa.string())],
            ["doc_id", "text_key", "n_removed", "n_spans", "kept_sha256"],
        )


def repeated_spans(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``doc_id, text_key, spans`` of byte ranges that an earlier document holds; spans may overlap.

    ``docs`` has a non-null ``doc_id bigint``, ``text_key`` (a hash of the text) and ``text``;
    ``keys`` the first two and ``n_bytes``, stored. Later copies may be left out of the answer.
    """
    held = docs.where(F.octet_length("text") >= LENGTH)
    plain = held.select("doc_id", "text_key", F.col("text").cast("binary").alias("text"), F.lit(True).alias("direct"))
    long = keys.where((F.col("n_bytes") >= LENGTH) & F.col("doc_id").isNotNull())
    classes = long.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    several = materialize(classes.where("n > 1").select("text_key", "doc_id"), "copied")
    copied = Sieve(several, "text_key")

    # Of texts with copies only the first document takes part; they are few and are looked up.
    def with_copies(batches):
        for batch in batches:
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(copied.passes(keys), pa.bool_()))

    schema = "doc_id bigint, text_key bigint, text binary, direct boolean"
    maybe = plain.mapInArrow(with_copies, schema)
    singles = classes.where("n = 1").select("text_key", "doc_id")
    firsts = several.union(singles)
    chosen = materialize(
        maybe.join(firsts, ["text_key", "doc_id"], "left_semi").select(
            "doc_id", "text_key", "text", F.lit(False).alias("direct")
        ),
        "firsts",
    )
    rows = plain.union(chosen)

    found = rows.mapInArrow(_anchor_rows(copied), "anchor bigint, doc_id bigint")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = (
        found.repartition(parts, "anchor")
        .groupBy("anchor")
        .agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n"))
        .where("low < high")
        .select("anchor", "n")
    )
    shared = materialize(shared, "anchors")
    in_several = Sieve(shared, "anchor", ANCHOR_BITS)
    in_many = Sieve(shared.where(F.col("n") > COMMON), "anchor")

    found = rows.mapInArrow(
        _occurrences(copied, in_several, in_many),
        "anchor bigint, doc_id bigint, text_key bigint, start int, size int, form bigint, alone boolean",
    )
    found = materialize(found, "occurrences")

    # Equal forms: all but the first document's are repeats as a whole. Where an anchor has
    # several forms, the first of each goes to a suffix array with the others.
    by_form, by_anchor = Window.partitionBy("anchor", "form"), Window.partitionBy("anchor")
    later = F.col("owner") < F.col("doc_id")
    placed = (
        found.where("NOT alone")
        .drop("alone")
        .repartition(parts, "anchor")
        .withColumn("owner", F.min("doc_id").over(by_form))
        .withColumn("low", F.min("form").over(by_anchor))
        .withColumn("high", F.max("form").over(by_anchor))
        .where(later | (F.col("low") < F.col("high")))
        .select(
            "doc_id", "text_key", "start", "size", later.alias("later"),
            F.when(~later, F.col("anchor")).alias("anchor"),
            F.when(~later, F.col("anchor").bitwiseXOR(F.col("form")).bitwiseXOR(F.col("doc_id"))).alias("form_key"),
        )
    )
    placed = materialize(placed, "placed")
    firsts = placed.where("NOT later")
    span = ["doc_id", "text_key", "begin", "end"]
    whole = placed.where("later").select(
        "doc_id", "text_key", F.col("start").alias("begin"), (F.col("start") + F.col("size") - 1 + LENGTH).alias("end")
    )
    contexts = rows.mapInArrow(
        _contexts(copied, Sieve(firsts, "anchor"), Sieve(firsts, "form_key")),
        "anchor bigint, doc_id bigint, text_key bigint, start int, context binary",
    )
    partial = (
        contexts.repartition(parts, "anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(_shards, "doc_id bigint, text_key bigint, begin int, end int")
    )
    # Strings of common anchors: the least document of each, joined back without meeting in one task.
    single = found.where("alone").select("anchor", "doc_id", "text_key", "start")
    owners = single.groupBy("anchor").agg(F.min("doc_id").alias("owner"), F.count(F.lit(1)).alias("n"))
    owned = join_keyed(single.withColumn("salt", F.xxhash64("doc_id", "start")), owners, "anchor", "n", "salt")
    strings = owned.where(later).select(
        "doc_id", "text_key", F.col("start").alias("begin"), (F.col("start") + LENGTH).alias("end")
    )
    spans = whole.select(span).unionByName(partial.select(span)).unionByName(strings.select(span))
    return spans.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row.

    A byte goes if a 50-byte string that covers it also starts in a document with a smaller id;
    strings are judged on the input. A whole later copy of 50 bytes or more goes at once.

    A null text is empty; texts below 50 bytes stay. A null id is neither smaller nor larger, so
    such rows stay whole. Rows that share an id do not remove from each other. An empty table
    gives no rows; other columns are left aside.
    """
    base = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    sha = F.sha2("text", 256)
    keyed = base.withColumn("text_key", F.xxhash64(sha))
    facts = materialize(
        keyed.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), sha.alias("sha"), "text_key"),
        "texts",
    )
    spans = materialize(repeated_spans(keyed.where("doc_id IS NOT NULL"), facts), "spans")
    ids = spans.select(F.xxhash64("doc_id", "text_key").alias("row_key"))
    marked = Sieve(ids, "row_key")

    def with_spans(batches):
        for batch in batches:
            keys = batch.column(3).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(marked.passes(keys), pa.bool_()))

    texts = keyed.where("doc_id IS NOT NULL").select(
        "doc_id", "text_key", F.col("text").cast("binary").alias("text"), F.xxhash64("doc_id", "text_key").alias("row_key")
    )
    hit = texts.mapInArrow(with_spans, "doc_id bigint, text_key bigint, text binary, row_key bigint")
    cut = (
        hit.drop("row_key")
        .join(spans, ["doc_id", "text_key"])
        .select("doc_id", "text_key", "text", "spans")
        .mapInArrow(_cut, "doc_id bigint, text_key bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
        .distinct()
    )
    firsts = facts.groupBy("text_key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    numbered = facts.withColumn("salt", F.monotonically_increasing_id())
    placed = join_keyed(numbered, firsts, "text_key", "n", "salt").join(cut, ["doc_id", "text_key"], "left")
    copy = (F.col("first") < F.col("doc_id")) & (F.col("n_bytes") >= LENGTH)
    none = F.lit(0).cast("bigint")
    return placed.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", none)).alias("n_removed"),
        F.when(copy, F.lit(1).cast("bigint")).otherwise(F.coalesce("n_spans", none)).alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest()))
        .otherwise(F.coalesce("kept_sha256", "sha"))
        .alias("kept_sha256"),
    )
