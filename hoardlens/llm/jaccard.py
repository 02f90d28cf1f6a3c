"""Exact n-gram Jaccard join: pigeonhole over hash segments with one-deletion neighbourhoods.

Sets are numbers of word shingles. The universe of 64-bit token hashes is cut into segments, as
many as the sizes of a band call for: two linked sets differ in at most H tokens, so some segment
of both is equal, or differs by one token where one-deletion neighbours are indexed. Rows that
share such a key are candidates; a parity sketch and then the whole sets decide.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hoardlens.llm.frames import Sieve, blobs
from hoardlens.operators.components import connected_components
from hoardlens.operators.skew import join_keyed
from hoardlens.workspace import materialize

WORDS = 5
SEEN = 500_000  # set fingerprints a task remembers, so that copies are sent once
KNOWN_WORDS = 500_000
SLICE_ROWS = 1_000  # texts whose keys or sets a task holds at once
SHARED_TOKEN = 0.02  # assumed chance that another set holds a given token: weighs short keys
KEY_COLLISION = 2000.0  # assumed sets of a band to collide with
TILE = 1500  # members of one key compared in one task
HUB_ROWS = 200  # pairs of one hub that share a copy of its set
TILE_TOKENS = 1 << 20  # of whole sets compared in one task, per side
SIZES_PER_BAND = 1.25

_U = np.uint64
_MULTIPLIERS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
    dtype=_U,
)  # odd constants, any will do


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Words(dict):
    """Hashes of words met before."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_hashes(text: bytes | None, known: dict, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; A-Z count as a-z."""
    parts = text.lower().split() if text else []
    if not parts:
        return np.empty(0, _U)
    hashes = np.fromiter(map(known.__getitem__, parts), _U, len(parts))
    size = min(words, len(parts))
    count = len(parts) - size + 1
    mixed = np.full(count, size, _U)
    for k in range(size):
        factor = _MULTIPLIERS[k % 5] + _U(2 * (k // 5))
        mixed += hashes[k : k + count] * factor
    return np.unique(_mix(mixed))


def fingerprint(tokens: np.ndarray) -> int:
    """64 bits that name a set, as a signed number."""
    total = np.add.reduce(_mix(tokens ^ _U(0x5851F42D4C957F2D)), dtype=_U, keepdims=True)
    return int(_mix(total ^ _U(len(tokens))).view(np.int64)[0])


# Bands of sizes: a set links only within its band and with the next.


@cache
def band_tops() -> tuple[int, ...]:
    tops = [5]
    while tops[-1] < 1 << 40:
        tops.append(math.floor(SIZES_PER_BAND * tops[-1]))
    return tuple(tops)


def most_differences(top: int) -> int:
    """Tokens in which a linked pair can differ whose smaller set has up to ``top`` tokens.

    J >= 0.8 means 9 * shared >= 4 * (a + b), so the rest is at most (a + b) / 9.
    """
    return (top + math.floor(top / 0.8)) // 9


def _binomial(size: int, share: float) -> list[float]:
    """Chances of 0, 1, ... of ``size`` tokens in a segment, as far as they matter."""
    if share >= 1:
        return [0.0] * size + [1.0]
    out, p, k = [], (1 - share) ** size, 0
    while k <= size and (k < size * share or p > 1e-9):
        out.append(p)
        p *= (size - k) / (k + 1) * share / (1 - share)
        k += 1
    return out


@cache
def allocation(band: int) -> tuple[int, int, int]:
    """Plain segments, deletion segments, and equal plain segments that may be left out.

    A deletion segment spans two units of the universe, a plain one a single unit. Of H + 1 + skip
    units in all, H differences leave a deletion segment with one at most, or more than ``skip``
    plain segments with none (see ``segment_keys``). The choice weighs the keys sent against the
    collisions expected from segments with few tokens.
    """
    top = band_tops()[band]
    least = most_differences(top) + 1
    size = round(0.9 * top)
    best = None
    for skip in range(least // 3 + 2):
        units = least + skip
        for q in range(min(4, units // 2) + 1):
            plain = units - 2 * q
            if skip and skip >= plain:
                continue
            left, cost = float(skip), float(plain - skip)
            for tokens, p in enumerate(_binomial(size, 1 / units)):
                kept = max(p * plain - left, 0.0)
                left -= min(left, p * plain)
                cost += KEY_COLLISION * kept * SHARED_TOKEN**tokens
            for tokens, p in enumerate(_binomial(size, 2 / units)):
                near = tokens * SHARED_TOKEN ** max(tokens - 1, 0)
                cost += q * p * (1 + tokens + KEY_COLLISION * (SHARED_TOKEN**tokens + near))
            if best is None or cost < best[0]:
                best = (cost, plain, q, skip)
    return best[1:]


@cache
def _edges(plain: int, q: int) -> np.ndarray:
    """Where the segments after the first one begin: deletion segments, then plain ones."""
    starts = [*range(0, 2 * q, 2), *range(2 * q, 2 * q + plain)]
    return np.array([(u << 64) // (2 * q + plain) for u in starts[1:]], dtype=_U)


def segment_keys(tokens: np.ndarray, mixes: np.ndarray, band: int) -> np.ndarray:
    """Index keys of a set in a band.

    Keys are sums over the tokens of a segment, so a deletion takes one term off. If no deletion
    segment of a linked pair matches, each holds two differences or more; then more than ``skip``
    of the other segments are equal. Both sets leave out their ``skip`` dearest ones, by the same
    order, so the cheapest equal segment stays on both sides.
    """
    plain, q, skip = allocation(band)
    m = plain + q
    cuts = np.concatenate([[0], np.searchsorted(tokens, _edges(plain, q)), [len(tokens)]])
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(mixes, dtype=_U)])
    totals = sums[cuts[1:]] - sums[cuts[:-1]]
    counts = np.diff(cuts)
    names = (_U(band) << _U(40)) + np.arange(m, dtype=_U)
    salts = _mix(names * _MULTIPLIERS[2])
    keys = _mix(totals ^ salts)
    order = q + np.lexsort((keys[q:], counts[q:]))
    out = [keys[order[skip:]]]
    for s in range(q):
        own = mixes[cuts[s] : cuts[s + 1]]
        out.append(keys[s : s + 1])
        out.append(_mix((totals[s] - own) ^ salts[s]))
    return np.concatenate(out)


def set_keys(tokens: np.ndarray) -> np.ndarray:
    """Keys in the set's own band, and in the one below for its smaller partners."""
    size = len(tokens)
    if most_differences(size) == 0:
        return np.empty(0, _U)  # such sets link with equal sets only
    mixes = _mix(tokens ^ _MULTIPLIERS[3])
    band = int(np.searchsorted(band_tops(), size))
    keys = [segment_keys(tokens, mixes, band)]
    if band:
        keys.append(segment_keys(tokens, mixes, band - 1))
    return np.unique(np.concatenate(keys))


def sketch(tokens: np.ndarray) -> bytes:
    """One parity bit per slot of a hash table of 64 * 2**n slots, at least one per token.

    A token in only one of two sets flips one bit, so the number of differing bits never exceeds
    the number of differing tokens. Halves can be folded to compare with a smaller sketch.
    """
    bits = max(64, 1 << (len(tokens) - 1).bit_length())
    slots = (_mix(tokens ^ _MULTIPLIERS[4]) & _U(bits - 1)).astype(np.int64)
    parity = np.bincount(slots, minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def _few_enough(difference, a: int, b: int):
    return 9 * difference <= a + b


def _sketches_pass(a: bytes, b: bytes, size_a: int, size_b: int) -> bool:
    if 10 * min(size_a, size_b) < 8 * max(size_a, size_b):
        return False
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    while len(x) != len(y):
        if len(x) > len(y):
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        else:
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return _few_enough(int(np.bitwise_count(x ^ y).sum()), size_a, size_b)


# Passes over the documents.


def _facts(words: int):
    """Rows ``id, text_key`` with size, name, sketch and keys of each set; keys once per set and task.

    A batch is taken in slices, and the text does not come back, so a task holds the keys of
    SLICE_ROWS texts.
    """
    fields = ["doc_id", "text_key", "n_shingles", "fp", "sketch", "items"]

    def run(batches):
        known, seen, none = _Words(), _Seen(), np.empty(0, _U)
        for part in _slices(batches):
            sizes, names, sketches, keys = [], [], [], []
            for text in blobs(part.column("text")):
                tokens = shingle_hashes(text, known, words)
                name = fingerprint(tokens) if len(tokens) else None
                sizes.append(len(tokens))
                names.append(name)
                sketches.append(sketch(tokens) if len(tokens) else None)
                keys.append(none if name is None or seen.again(name) else set_keys(tokens))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("text_key"),
                    pa.array(sizes, pa.int64()),
                    pa.array(names, pa.int64()),
                    pa.array(sketches, pa.binary()),
                    _lists(keys, pa.int64()),
                ],
                fields,
            )

    return run


def _slices(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)


class _Seen(set):
    """Remembers fingerprints of a task; true for one met before."""

    def again(self, name: int) -> bool:
        if name in self:
            return True
        if len(self) >= SEEN:
            self.clear()
        self.add(name)
        return False


def _lists(rows, kind) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.empty(0, _U)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int64), kind))


def _set_rows(words: int, wanted: Sieve):
    """Rows ``fp, items`` of the texts whose key a sieve lets pass, each set once per task."""

    def run(batches):
        known, seen = _Words(), _Seen()
        for batch in _slices(batches):
            names, rows = [], []
            passed = batch.filter(pa.array(wanted.passes(batch.column(1).to_numpy()), pa.bool_()))
            for text in blobs(passed.column(0)):
                tokens = shingle_hashes(text, known, words)
                name = fingerprint(tokens) if len(tokens) else None
                if name is not None and not seen.again(name):
                    names.append(name)
                    rows.append(tokens)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), _lists(rows, pa.int64())], ["fp", "items"]
            )

    return run


def _verified(texts: DataFrame, facts: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """Links ``x, y`` among the members of each tile, by the sizes of intersections of whole sets.

    ``members`` has the tile (``name, i, j``), the ``block`` of the member, its set ``fp`` and the ``root`` of the
    component it is in. Only sets of members are built again, each from one text that has it, and a tile returns
    links that join components, fewer than it has members.
    """
    ends = members.select("fp").distinct()
    sources = facts.join(ends, "fp", "left_semi").groupBy("fp").agg(F.min("text_key").alias("text_key"))
    kept = texts.mapInArrow(_set_rows(words, Sieve(sources, "text_key")), "fp bigint, items array<bigint>")
    sets = kept.join(ends, "fp", "left_semi").groupBy("fp").agg(F.first("items").alias("items"))
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.join(sets, "fp").select("name", "i", "j", "block", "fp", "root", "items")
    dealt = dealt.repartition(parts, "name", "i", "j").sortWithinPartitions("name", "i", "j")
    return dealt.mapInArrow(_cross_links, "x bigint, y bigint").distinct()


def _cross_links(batches):
    """Links of whole sets between members of the two blocks of a tile, as far as they join components."""
    key, members = None, []

    def links():
        names = np.array([m[1] for m in members])
        label = np.unique(np.array([m[2] for m in members]), return_inverse=True)[1]
        sizes = np.array([len(m[3]) for m in members])
        codes = np.unique(np.concatenate([m[3] for m in members]), return_inverse=True)[1]
        begins = np.cumsum(sizes) - sizes
        blocks = np.array([m[0] for m in members])
        left, right = np.flatnonzero(blocks == key[1]), np.flatnonzero(blocks == key[2])
        # The sets of the right side in one row, so that all intersections with a set are one sum.
        flat = np.concatenate([codes[begins[r] : begins[r] + sizes[r]] for r in right]) if len(right) else codes[:0]
        cuts, mark = np.cumsum(sizes[right]) - sizes[right], np.zeros(int(codes.max()) + 1, bool)
        out = []
        for m in left:
            n, other = sizes[m], label[right] != label[m]
            if not (other & (10 * np.minimum(sizes[right], n) >= 8 * np.maximum(sizes[right], n))).any():
                continue
            own = codes[begins[m] : begins[m] + n]
            mark[own] = True
            shared = np.add.reduceat(mark[flat], cuts, dtype=np.int64)
            mark[own] = False
            for r in right[other & (100 * shared >= 80 * (sizes[right] + n - shared))]:
                if label[r] != label[m]:
                    out.append((min(names[m], names[r]), max(names[m], names[r])))
                    label[label == label[r]] = label[m]
        return _pairs(out)

    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("name", "i", "j", "block", "fp", "root")]
        items = batch.column("items")
        flat, edges = items.values.to_numpy(), items.offsets.to_numpy()
        for (name, i, j, *member), a, b in zip(zip(*columns), edges, edges[1:]):
            if (name, i, j) != key:
                if len(members) > 1:
                    yield links()
                key, members = (name, i, j), []
            members.append((*member, flat[a:b]))
    if len(members) > 1:
        yield links()


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    ends = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["x", "y"])


def _around_hubs(pairs: DataFrame) -> DataFrame:
    """Tiles of pairs ``x, y, n_x`` around their hubs ``y``: the hub is copied once per HUB_ROWS pairs or TILE_TOKENS tokens."""
    hubs = pairs.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum("n_x").alias("tokens"))
    salts = F.greatest(F.ceil(F.col("n") / HUB_ROWS), F.ceil(F.col("tokens") / TILE_TOKENS)).cast("int")
    hubs = hubs.withColumn("salts", salts).drop("tokens")
    near = join_keyed(pairs.select("x", "y"), hubs, "y", "n", "x")
    near = near.withColumn("block", 1 + F.pmod(F.xxhash64("x"), F.col("salts")).cast("int"))
    near = near.select(F.col("y").alias("name"), F.col("block").alias("j"), "block", F.col("x").alias("fp"))
    hub = hubs.select(F.col("y").alias("name"), F.explode(F.sequence(F.lit(1), F.col("salts"))).alias("j"), F.lit(0).alias("block"), F.col("y").alias("fp"))
    return near.unionByName(hub).select("name", F.lit(0).alias("i"), "j", "block", "fp", F.col("fp").alias("root"))


def _sketched(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose sketches leave a link possible, with the size of ``x``."""
    side = lambda end: nodes.select(
        F.col("fp").alias(end), F.col("n_shingles").alias(f"n_{end}"), F.col("sketch").alias(f"s_{end}")
    )
    # Several pairs meet at a hub; Spark splits such a partition where it grows large.
    both = pairs.join(side("x"), "x").join(side("y"), "y")

    def run(batches):
        for batch in batches:
            columns = {n: batch.column(n).to_pylist() for n in ("n_x", "n_y", "s_x", "s_y")}
            passed = [
                _sketches_pass(a, b, i, j)
                for a, b, i, j in zip(columns["s_x"], columns["s_y"], columns["n_x"], columns["n_y"])
            ]
            yield batch.select(["x", "y", "n_x"]).filter(pa.array(passed, pa.bool_()))

    return both.select("x", "y", "n_x", "n_y", "s_x", "s_y").mapInArrow(run, "x bigint, y bigint, n_x bigint")


def _cross_pairs(batches):
    """Members of one key that lie in different components and may link, as the edges of a forest.

    Rows come sorted by key and tile. Members of the tile's first block meet those of its second;
    sketches are compared as matrix rows, level by level of their length. Sets that may link, or
    hang together by such, are in one tree, so a tile returns fewer edges than it has members.
    """
    key, members = None, []

    def pairs():
        out, tree = [], {}

        def top(name):
            while tree.setdefault(name, name) != name:
                tree[name] = name = tree[tree[name]]
            return name

        left = [m for m in members if m[0] == key[1]]
        right = left if key[1] == key[2] else [m for m in members if m[0] == key[2]]
        for size in sorted({len(m[4]) for m in right}):
            group = [m for m in right if len(m[4]) == size]
            table = np.frombuffer(b"".join(m[4] for m in group), "<u8").reshape(len(group), -1)
            sizes = np.array([m[3] for m in group])
            roots = np.array([m[2] for m in group])
            names = np.array([m[1] for m in group])
            for _, name, root, n, data in left:
                if len(data) not in (size // 2, size, size * 2):
                    continue
                own, other = np.frombuffer(data, "<u8"), table
                if len(data) > size:
                    own = own[: len(own) // 2] ^ own[len(own) // 2 :]
                elif len(data) < size:
                    other = table[:, : len(own)] ^ table[:, len(own) :]
                fits = (roots != root) & (names != name)
                fits &= 10 * np.minimum(sizes, n) >= 8 * np.maximum(sizes, n)
                places = np.flatnonzero(fits)
                if len(places):
                    bits = np.bitwise_count(other[places] ^ own).sum(axis=1, dtype=np.int64)
                    for other_name in names[places[_few_enough(bits, sizes[places], n)]].tolist():
                        x, y = top(name), top(other_name)
                        if x != y:
                            tree[max(x, y)] = min(x, y)
                            out.append((min(name, other_name), max(name, other_name)))
        return _pairs(out)

    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("sig", "i", "j", "block", "fp", "root", "n_shingles", "sketch")]
        for sig, i, j, *member in zip(*columns):
            if (sig, i, j) != key:
                if len(members) > 1:
                    yield pairs()
                key, members = (sig, i, j), []
            members.append(member)
    if len(members) > 1:
        yield pairs()


def _rest(groups: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Tiles of the sets that may still link to another component, over keys whose members lie in several.

    Sets that hang together by possible links are compared with each other, whatever keys they
    share, so each set is sent once and not once for each key or pair.
    """
    roots = connected_components(links.select(F.col("x").alias("a"), F.col("y").alias("b")))
    placed = groups.select("sig", "fp").join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    placed = placed.withColumn("root", F.coalesce("root", "fp"))
    # A task may not gather a frequent key, so its extremes come from an aggregation.
    spread = (
        placed.groupBy("sig")
        .agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"))
        .where("low < high")
        .withColumn("blocks", F.ceil(F.col("n") / TILE).cast("int"))
        .drop("low", "high")
    )
    found = join_keyed(placed, spread, "sig", "n", "fp").where(F.col("blocks").isNotNull())
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    tiles = found.withColumn("block", block).join(nodes.select("fp", "n_shingles", "sketch"), "fp")
    tiles = tiles.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select(
        "sig", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        "block", "fp", "root", "n_shingles", "sketch",
    )
    parts = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tiles.repartition(parts, "sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    forest = materialize(dealt.mapInArrow(_cross_pairs, "x bigint, y bigint").distinct(), "forest")
    trees = connected_components(forest.select(F.col("x").alias("a"), F.col("y").alias("b")))
    sized = trees.withColumnRenamed("root", "name").join(nodes.select(F.col("fp").alias("node"), "n_shingles"), "node")
    sizes = sized.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("tokens"))
    blocks = F.greatest(F.ceil(F.col("n") / TILE), F.ceil(F.col("tokens") / TILE_TOKENS)).cast("int")
    sizes = sizes.withColumn("blocks", blocks).drop("tokens")
    dealt = join_keyed(sized.select(F.col("node").alias("fp"), "name"), sizes, "name", "n", "fp")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    dealt = dealt.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select(
        "name", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp", "root"
    )


def _shared_groups(keys: DataFrame, parts: int) -> DataFrame:
    """``sig, fp, n, keys``: the members of every group of two sets or more that share a key ``sig``.

    Alike sets share many keys, so keys with the same members become one group, named by a hash of
    these; ``n`` counts its members and ``keys`` its keys. Groups that took one name would be one
    larger group, which loses no candidate.
    """
    by_key = Window.partitionBy("sig")
    several = (
        keys.repartition(parts, "sig")
        .withColumn("first", F.min("fp").over(by_key))
        .withColumn("last", F.max("fp").over(by_key))
        .where("first < last")
        .select("sig", "fp")
        .distinct()  # a set is sent by each task that met it
    )
    named = several.withColumn("n", F.count(F.lit(1)).over(by_key)).withColumn(
        "members", F.bit_xor(F.xxhash64("fp")).over(by_key)
    )
    groups = named.select(F.xxhash64("n", "members").alias("sig"), "fp", "n")
    return groups.groupBy("sig", "fp").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("keys"))


def jaccard_components(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS
) -> tuple[DataFrame, DataFrame]:
    """``doc_id, text_key, n_shingles, component_id`` of every row, and the links between different sets.

    ``text_key`` is the xxhash64 of the text, for joins back to rows whose ids may repeat.

    Two texts link at a Jaccard similarity of 0.8 or more of their shingle sets. Equal sets are
    one node from the start. Each key first offers its least member as a partner for the others;
    links found so join most members. Keys whose members still lie in several components compare
    these, tile by tile, so no link that could join two components is missed; links within a
    component need not be listed.

    Null, empty and blank texts have no shingles and stay alone. A null id counts as no id: it
    names no component unless a whole component lacks ids. Repeated rows are copies. An empty
    table gives no rows. Other columns are left aside.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(text).alias("text"), F.xxhash64(text).alias("text_key"))
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    named = named.withColumn("text_key", F.xxhash64("text"))
    fields = "text_key bigint, n_shingles bigint, fp bigint, sketch binary, items array<bigint>"
    kind = named.schema["doc_id"].dataType.simpleString()
    meta = materialize(named.mapInArrow(_facts(words), f"doc_id {kind}, {fields}"), "facts")
    nodes = meta.where("fp IS NOT NULL").select("fp", "n_shingles", "sketch").distinct()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = materialize(_shared_groups(meta.select(F.explode("items").alias("sig"), "fp"), parts), "keys")
    # The set that meets most others is the likeliest to be near them all, as an original is to
    # its copies.
    met = shared.groupBy("fp").agg(F.sum(F.col("n") * F.col("keys")).alias("met"))
    by_key = Window.partitionBy("sig")
    hub = F.max(F.struct("met", "fp")).over(by_key)["fp"]
    groups = shared.join(met, "fp").repartition(parts, "sig").withColumn("hub", hub).select("sig", "fp", "hub", "keys")
    groups = materialize(groups, "hubs")
    stars = groups.where("fp != hub").groupBy("fp", "hub").agg(F.sum("keys").alias("n"))
    best = stars.groupBy("fp").agg(F.max(F.struct("n", "hub"))["hub"].alias("hub"))
    first = _sketched(best.select(F.col("fp").alias("x"), F.col("hub").alias("y")), nodes)
    hubs = materialize(_around_hubs(materialize(first, "pairs")), "stars")
    links = materialize(_verified(texts, meta, hubs, words), "links")
    rest = materialize(_rest(groups, nodes, links), "rest")
    if not rest.isEmpty():
        links = materialize(links.union(_verified(texts, meta, rest, words)), "links")

    roots = connected_components(links.select(F.col("x").alias("a"), F.col("y").alias("b")))
    classes = meta.where("fp IS NOT NULL").groupBy("fp").agg(
        F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")
    )
    placed = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    names = placed.groupBy("root").agg(F.min("least").alias("component"))
    sized = placed.groupBy("root").agg(F.count(F.lit(1)).alias("m"))
    named_roots = names.join(sized, "root")
    keyed = join_keyed(placed, named_roots, "root", "m", "fp").select("fp", "n", "component")
    out = join_keyed(meta.drop("sketch", "items").withColumn("salt", F.monotonically_increasing_id()), keyed, "fp", "n", "salt")
    return (
        out.select("doc_id", "text_key", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")),
        links,
    )


ORACLE = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS w
    FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
    SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
    WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
reach AS (
    SELECT doc_id AS node, doc_id AS member FROM documents
    UNION
    SELECT r.node, l.y FROM reach r JOIN links l ON l.x = r.member)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id)
JOIN (SELECT node AS doc_id, min(member) AS component_id FROM reach GROUP BY node) c USING (doc_id)
"""
