"""Toxicity by nearest labelled examples: exact TF-IDF cosine over all terms, by inverted lists and block bounds."""

from __future__ import annotations

import math
import mmap
import pickle
import tempfile
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from hoardlens.llm.decontaminate import words_of
from hoardlens.llm.folds import held_out, sample_per_class
from hoardlens.llm.frames import append_columns, blobs
from hoardlens.workspace import fresh_path, materialize

EXAMPLES = 2_500  # labelled examples of each class, at most about so many
EXAMPLE_TERMS = 8_000_000  # different terms of each example, summed over all, at most about so many
TELLING = 300  # terms of the second vote, those that say most about the label
LEAST_SIGNAL = 3.84  # chi-square of such a term with the label, five percent
LEAST_DOCS = 4  # examples it must occur in,
LEAST_SHARE = 0.002  # and this share of them
COMMON = 1_024  # most frequent terms, kept as dense blocks
SKETCH = 32
NEIGHBOURS = 15
BLOCK = 256  # examples of a block
BATCH = 128  # texts scored at once
SLICE = 8 * BATCH  # texts taken out of a batch of rows at once
PART_BYTES = 2 << 20  # of an index that the driver holds at once on its way from the task that made it
SLACK = 1e-11  # cosines this near are told apart only after rounding
ROUNDING = 1e-5  # cosines of single precision this near to the kth are computed again
SHARPNESS = 2  # votes count by the cosine to this power
PREFIXES = (4, 5, 6)  # a word also stands for its first bytes
RUN_BYTES = 4 << 20  # of texts whose words are looked up at once


def terms_of(word: bytes) -> list[bytes]:
    return [word, *[word[:n] + b"*" for n in PREFIXES if len(word) > n]]


class Known:
    """Numbers of the terms of words, looked up for all different words of several texts at once."""

    def __init__(self, vocabulary: pa.Array):
        self.vocabulary = vocabulary

    def of(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Of each text, the numbers of the terms of its words, each as often as it occurs."""
        words = [words_of(t) for t in texts]
        ends = np.cumsum([len(w) for w in words]).tolist()
        coded = pa.array(list(chain.from_iterable(words)), pa.binary()).dictionary_encode()
        numbers = self._numbers(coded.dictionary)
        codes = coded.indices.to_numpy()
        found = (numbers[codes[i:j]].ravel() for i, j in zip([0, *ends], ends))
        return [f[f >= 0] for f in found]

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """For each word the numbers of its terms, -1 for those that are not known."""
        sizes = pc.binary_length(words).to_numpy()
        longer = [np.flatnonzero(sizes > n) for n in PREFIXES]
        heads = [pc.binary_slice(words.take(pa.array(at)), 0, n) for n, at in zip(PREFIXES, longer)]
        heads = [pc.binary_join_element_wise(h, pa.scalar(b"*"), pa.scalar(b"")) for h in heads]
        place = pc.index_in(pa.concat_arrays([words, *heads]), self.vocabulary)
        place = np.split(place.fill_null(-1).to_numpy(), np.cumsum([len(words), *[len(h) for h in heads]])[:-1])
        out = np.full((len(words), 1 + len(PREFIXES)), -1, np.int32)
        out[:, 0] = place[0]
        for i, (at, found) in enumerate(zip(longer, place[1:]), 1):
            out[at, i] = found
        return out


def runs(texts: list[bytes | None]) -> Iterator[list[bytes | None]]:
    """Texts in runs of at most RUN_BYTES and SLICE of them; a longer text is a run of its own."""
    run, size = [], 0
    for text in texts:
        own = len(text or b"")
        if run and (size + own > RUN_BYTES or len(run) >= SLICE):
            yield run
            run, size = [], 0
        run.append(text)
        size += own
    if run:
        yield run


def described(text: bytes | None) -> tuple[list[bytes], list[int], list[int]]:
    """Terms of an example with their counts, and the least hashes of its words."""
    words = Counter(words_of(text))
    counts: Counter = Counter()
    for word, n in words.items():
        for t in terms_of(word):
            counts[t] += n
    return list(counts.keys()), list(counts.values()), sorted({zlib.crc32(w) for w in words})[:SKETCH]


_EXAMPLE = "terms array<binary>, counts array<int>, sketch array<bigint>"


def _described(batches):
    """Examples (id, label, text) without their texts."""
    for batch in batches:
        columns = list(zip(*[described(b) for b in blobs(batch.column(2))])) or [()] * 3
        kinds = [pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        made = [pa.array(c, k) for c, k in zip(columns, kinds)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *made], ["doc_id", "toxic", "terms", "counts", "sketch"]
        )


@dataclass
class Examples:
    """Labelled examples as terms and counts; their texts stay in the tasks that described them."""

    ids: list
    labels: np.ndarray
    terms: list  # of each example, an Arrow array
    counts: list
    kind: str = "bigint"  # type of the ids

    @classmethod
    def of(cls, texts: list[bytes | None], labels, ids) -> Examples:
        rows = [described(t) for t in texts]
        terms, counts = [pa.array(r[0], pa.binary()) for r in rows], [np.array(r[1], np.int32) for r in rows]
        return cls._distinct(list(ids), list(labels), terms, counts, [r[2] for r in rows], "bigint")

    @classmethod
    def read(cls, table: pa.Table, kind: str) -> Examples:
        ids, labels, sketches = (table[n].to_pylist() for n in ("doc_id", "toxic", "sketch"))
        order = sorted(range(len(ids)), key=lambda i: (ids[i], sketches[i]))
        terms, counts = ([c for part in table[n].chunks for c in part] for n in ("terms", "counts"))
        pick = lambda values: [values[i] for i in order]
        return cls._distinct(
            pick(ids), pick(labels), [terms[i].values for i in order],
            [counts[i].values.to_numpy() for i in order], pick(sketches), kind,
        )

    @classmethod
    def _distinct(cls, ids, labels, terms, counts, sketches, kind) -> Examples:
        kept = distinct(sketches)
        pick = lambda values: [values[i] for i in kept]
        return cls(pick(ids), np.array(pick(labels), np.int64), pick(terms), pick(counts), kind)


def distinct(sketches: list[list[int]]) -> list[int]:
    """Places of the examples that are no near copies of earlier ones.

    Copies would make the words of one text look like signs of its label. Two examples count as
    copies if they share half of their SKETCH least word hashes.
    """
    holders: dict[int, list[int]] = {}
    kept = []
    for i, sketch in enumerate(sketches):
        shared = Counter(j for h in sketch for j in holders.get(h, ()))
        if sketch and max(shared.values(), default=0) * 2 >= len(sketch):
            continue
        kept.append(i)
        for h in sketch:
            holders.setdefault(h, []).append(i)
    return kept


class Lists:
    """Inverted lists with unit weights; common terms also as dense blocks with their greatest weights.

    ``term``, ``doc`` and ``counts`` are postings in order of term and example; terms are numbered
    from the most frequent one.
    """

    def __init__(self, term: np.ndarray, doc: np.ndarray, counts: np.ndarray, idf: np.ndarray, docs: int):
        self.idf, self.doc = idf, doc
        weight = (1 + np.log(counts)) * idf[term]
        # Weights are numbers of single precision, so that blocks of them hold them exactly.
        self.weight = (weight / np.sqrt(np.bincount(doc, weight**2, docs))[doc]).astype(np.float32)
        self.blocks = 1  # pieces of each list in ``start``: lists are whole
        self.start = np.searchsorted(term, np.arange(len(idf) + 1))
        self.common = min(COMMON, len(idf))
        end = self.start[self.common]
        self.most = np.zeros((self.common, max(1, -(-docs // BLOCK))))
        np.maximum.at(self.most, (term[:end], doc[:end] // BLOCK), self.weight[:end])

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_dense",)}

    def _common_weights(self) -> np.ndarray:
        """Weights of the common terms, one column an example; made once per process."""
        if "_dense" not in self.__dict__:
            dense = np.zeros((self.common, self.most.shape[1] * BLOCK), np.float32)
            end = self.start[self.common]
            term = np.repeat(np.arange(self.common), np.diff(self.start[: self.common + 1]))
            dense[term, self.doc[:end]] = self.weight[:end]
            self._dense = dense
        return self._dense

    def weigh(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit vector of term frequencies (in logarithm) times inverse document frequencies."""
        weights = (1 + np.log(counts)) * self.idf[terms]
        norm = math.sqrt(float(weights @ weights))
        return terms, weights / norm if norm else weights

    def by_example(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """The vector of each example."""
        term = np.repeat(np.arange(len(self.idf)), np.diff(self.start))
        order = np.argsort(self.doc, kind="stable")
        edges = np.searchsorted(self.doc[order], np.arange(self.most.shape[1] * BLOCK + 1)).tolist()
        return [(term[o], self.weight[o]) for o in (order[i:j] for i, j in zip(edges, edges[1:]))]

    def nearest(self, terms, weights, k: int = NEIGHBOURS) -> list[tuple[float, int]]:
        """The k examples of greatest positive cosine, ties to the earlier example."""
        return self.nearest_of([(terms, weights)], k)[0]

    def nearest_of(self, queries, k: int = NEIGHBOURS, skip: int | None = None) -> list[list[tuple[float, int]]]:
        """``nearest`` of several queries at once; with ``skip`` the i-th may not find example skip + i.

        Rare terms are summed over their lists first. A block of examples is left out for a query if
        these sums and the most its common terms could add there stay below the kth cosine. Blocks
        are scored in single precision; what comes near the kth cosine is computed again in double.
        """
        rows, size = len(queries), self.most.shape[1] * BLOCK
        dense, rare = np.zeros((rows, self.common)), np.zeros((rows, size))
        for i, (term, weight) in enumerate(queries):
            low = term < self.common
            dense[i, term[low]] = weight[low]
            term, weight = term[~low], weight[~low]
            lengths = self.start[term + 1] - self.start[term]
            # One query at a time, so that the postings and their sums stay in the cache.
            at = np.repeat(self.start[term] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            rare[i] = np.bincount(self.doc[at], self.weight[at] * np.repeat(weight, lengths), size)
        if skip is not None:
            rare[np.arange(rows), skip + np.arange(rows)] = -np.inf
        scores = rare.astype(np.float32)
        blocks = scores.reshape(rows, -1, BLOCK)
        bounds = blocks.max(axis=2) + dense @ self.most + ROUNDING
        single, common = dense.astype(np.float32), self._common_weights()
        # The kth greatest of the sums of any block is never above the kth cosine.
        kth = np.full(rows, -np.inf, np.float32)
        for b in np.argsort(-bounds.sum(axis=0), kind="stable").tolist():
            wanted = np.flatnonzero((bounds[:, b] >= kth - ROUNDING) & (bounds[:, b] > ROUNDING))
            if not len(wanted):
                continue
            asked = single if len(wanted) == rows else single[wanted]
            blocks[wanted, b] += asked @ common[:, b * BLOCK : (b + 1) * BLOCK]
            kth = np.maximum(kth, np.partition(blocks[:, b], BLOCK - k, axis=1)[:, BLOCK - k])
        kth = np.partition(scores, size - k, axis=1)[:, size - k]
        out = []
        for i in range(rows):
            found = np.flatnonzero(scores[i] >= max(kth[i], ROUNDING) - ROUNDING)
            own = np.flatnonzero(dense[i])
            exact = rare[i, found] + dense[i, own] @ common[np.ix_(own, found)].astype(np.float64)
            # Rounded, so that a cosine does not depend on what else is in the batch.
            near = sorted((-c, j) for c, j in zip(np.round(exact, 12).tolist(), found.tolist()) if c > SLACK)
            out.append([(-c, j) for c, j in near[:k]])
        return out


class Index(Lists):
    """Every term of the examples, and beside it the lists of the terms that say most about the label.

    Neighbours are those over all terms. The probability rests on their vote and on the vote of the
    nearest examples by the telling terms alone.
    """

    def __init__(
        self,
        examples: Examples,
        base_rate: float,
        frequencies: Callable[[pa.Array], tuple[int, np.ndarray]] | None = None,
    ):
        """``frequencies`` gives the number of documents and how many have each term; by default the examples count."""
        self.labels, self.ids, self.kind = examples.labels, examples.ids, examples.kind
        term, doc, counts = self._postings(examples)
        docs, holders = len(self.ids), np.bincount(term, minlength=len(self.vocabulary))
        chosen = self._choose(term, doc, holders)
        if frequencies is not None and len(self.vocabulary):
            docs, holders = frequencies(self.vocabulary)
        super().__init__(term, doc, counts, np.log((1 + docs) / (1 + holders)) + 1, len(self.ids))
        self.telling = np.full(len(self.vocabulary), -1)
        self.telling[chosen] = np.arange(len(chosen))
        told = self.telling[term] >= 0
        term, doc, counts = self.telling[term[told]], doc[told], counts[told]
        self.signal = Lists(term, doc, counts, self.idf[chosen], len(self.ids))
        self._calibrate(np.bincount(doc, counts, len(self.ids)), base_rate)

    def dumped(self) -> bytes:
        """Both sets of lists as plain arrays."""
        own = self.__getstate__()
        signal = own.pop("signal")
        return pickle.dumps((own, signal.__getstate__()), 5)

    @property
    def number(self) -> dict[bytes, int]:
        return dict(zip(self.vocabulary.to_pylist(), range(len(self.vocabulary))))

    def _postings(self, examples: Examples) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Term, example and count, in order of term and example; the vocabulary begins with the most frequent."""
        flat = pa.concat_arrays([pa.array([], pa.binary()), *examples.terms])
        coded = flat.dictionary_encode()
        old, terms = coded.indices.to_numpy(), coded.dictionary
        spelling = np.empty(len(terms), np.int64)
        spelling[pc.sort_indices(terms).to_numpy()] = np.arange(len(terms))
        order = np.lexsort((spelling, -np.bincount(old, minlength=len(terms))))
        place = np.empty(len(terms), np.int32)
        place[order] = np.arange(len(terms), dtype=np.int32)
        self.vocabulary = terms.take(pa.array(order))
        doc = np.repeat(np.arange(len(examples.ids), dtype=np.int32), [len(t) for t in examples.terms])
        counts = np.concatenate([np.zeros(0, np.int32), *examples.counts])
        term = place[old]
        by_term = np.argsort(term, kind="stable")
        return term[by_term], doc[by_term], counts[by_term]

    def _choose(self, term, doc, holders) -> np.ndarray:
        """The terms whose presence says most about the label, by a chi-square of one degree."""
        n, toxic = len(self.labels), int(self.labels.sum())
        a = np.bincount(term, self.labels[doc], len(holders))
        excess = a * (n - toxic) - (holders - a) * toxic
        spread = holders * np.maximum(n - holders, 1.0) * max(toxic, 1) * max(n - toxic, 1)
        value = n * excess * excess / np.maximum(spread, 1.0)
        known = (holders >= max(LEAST_DOCS, LEAST_SHARE * n)) & (value > LEAST_SIGNAL)
        some = np.flatnonzero(known)
        terms = self.vocabulary.take(pa.array(some)).to_pylist()
        scored = sorted((-value[i], t, i) for t, i in zip(terms, some.tolist()))
        return np.array(sorted(i for *_, i in scored[:TELLING]), np.int64)

    def query(self, text: bytes | None) -> tuple:
        return self.queries([text])[0]

    def queries(self, texts: list[bytes | None]) -> list[tuple]:
        """Terms and weights of each text, and its telling terms with their counts."""
        out = []
        for found in Known(self.vocabulary).of(texts):
            terms, counts = np.unique(found, return_counts=True)
            told = self.telling[terms]
            out.append((*self.weigh(terms, counts), (told[told >= 0], counts[told >= 0])))
        return out

    def _vote(self, near) -> float:
        """Share of toxic votes, less one half; 0 without neighbours."""
        votes = [c**SHARPNESS for c, _ in near]
        total = sum(votes)
        if not total:
            return 0.0
        return sum(v for v, (_, i) in zip(votes, near) if self.labels[i]) / total - 0.5

    def _features(self, near, telling, matched: int) -> np.ndarray:
        """What the curve sees: each vote, whether there was one, and the vote of telling terms by their number."""
        vote, told = self._vote(near), self._vote(telling)
        return np.array(
            [1.0, vote, 1.0 if near else 0.0, told, 1.0 if telling else 0.0, told * math.log1p(matched)]
        )

    def _calibrate(self, matched: np.ndarray, base_rate: float) -> None:
        """Logistic curve from votes to probabilities, fitted on votes of the other examples.

        Examples count so that both classes have their share among all labelled rows.
        """
        rows, every, telling = [], self.by_example(), self.signal.by_example()
        for i in range(0, len(self.ids), BATCH):
            j = min(i + BATCH, len(self.ids))
            near = zip(self.nearest_of(every[i:j], skip=i), self.signal.nearest_of(telling[i:j], skip=i))
            rows += [self._features(n, t, m) for (n, t), m in zip(near, matched[i:j])]
        del every, telling
        self.__dict__.pop("_dense", None)
        x, y = np.array(rows).reshape(-1, 6), self.labels.astype(float)
        share = y.mean() if len(y) else 0.0
        rate = min(max(base_rate, 1e-3), 1 - 1e-3)
        weight = np.where(y > 0, rate / max(share, 1e-9), (1 - rate) / max(1 - share, 1e-9))
        self.curve = np.array([math.log(rate / (1 - rate)), *[0.0] * 5])
        if not 0 < share < 1:
            return
        ridge = np.diag([0.01, *[0.1] * 5])

        def loss(curve):
            z = x @ curve
            return float(weight @ (np.logaddexp(0, z) - y * z) + 0.5 * curve @ ridge @ curve)

        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ self.curve, -30, 30)))
            gradient = x.T @ (weight * (p - y)) + ridge @ self.curve
            hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
            step, now = np.linalg.solve(hessian, gradient), loss(self.curve)
            # Newton's step can overshoot where the classes lie apart; it is halved until it helps.
            while np.abs(step).max() > 1e-9 and loss(self.curve - step) > now:
                step = step / 2
            self.curve = self.curve - step

    def score(self, text: bytes | None) -> tuple[float, list[tuple[float, int]]]:
        return self.scores([text])[0]

    def scores(self, texts: list[bytes | None]) -> list[tuple[float, list[tuple[float, int]]]]:
        """Probability and neighbours of each text."""
        out = []
        for run in runs(texts):
            asked = self.queries(run)
            for i in range(0, len(run), BATCH):
                queries = asked[i : i + BATCH]
                near = self.nearest_of([q[:2] for q in queries])
                telling = self.signal.nearest_of([self.signal.weigh(*q[2]) for q in queries])
                for n, t, q in zip(near, telling, queries):
                    z = self.curve @ self._features(n, t, q[2][1].sum())
                    out.append((float(1 / (1 + math.exp(-min(max(z, -30), 30)))), n))
        return out


def document_frequencies(docs: DataFrame, shared: Broadcast, size: int) -> tuple[int, np.ndarray]:
    """How many documents there are, and how many of them have each of the ``size`` terms of the vocabulary sent."""

    def count(batches):
        known, total = Known(shared.value), 0
        holders = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for run in runs(blobs(batch.column(0).slice(at, SLICE))):
                    for found in known.of(run):
                        holders[np.unique(found)] += 1  # each term once a document
            total += batch.num_rows
        found = np.flatnonzero(holders)
        term, n = np.append(found, -1), np.append(holders[found], total)
        for i in range(0, len(term), 50_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(term[i : i + 50_000], pa.int32()), pa.array(n[i : i + 50_000], pa.int64())], ["term", "n"]
            )

    partial = docs.select("text").mapInArrow(count, "term int, n bigint")
    table = partial.groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = table["term"].to_numpy(), table["n"].to_numpy()
    holders = np.zeros(size + 1, np.int64)
    holders[term] = n
    return int(holders[-1]), holders[:-1]


def _within_bound(examples: DataFrame) -> DataFrame:
    """All examples, or the first in order of a hash where they hold more than EXAMPLE_TERMS terms."""
    order = F.xxhash64("doc_id", "sketch")
    sizes = sorted(tuple(r) for r in examples.select(order, F.size("terms")).collect())
    held = np.cumsum([n for _, n in sizes])
    if not len(held) or held[-1] <= EXAMPLE_TERMS:
        return examples
    return examples.where(order < sizes[int(np.searchsorted(held, EXAMPLE_TERMS, "right"))][0])


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Fitted:
    """An index of about ``examples`` rows of each class, none of them held out.

    Which rows is settled on the small table of labels; their texts come by a join with at most
    a few thousand broadcast ids. Tasks turn them into terms and counts, bounded by EXAMPLE_TERMS,
    and one task makes the index of this bounded sample. Only the different terms and the bytes
    of the index pass through the driver, the latter part by part. Contradicting or null labels
    are left out.
    """
    marked = (
        labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
        .where("toxic = most")
        .select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    )
    rate = marked.agg(F.avg("toxic")).first()[0]
    chosen = sample_per_class(marked, "toxic", F.col("doc_id"), examples)
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    described_rows = rows.mapInArrow(_described, f"doc_id {kind}, toxic int, {_EXAMPLE}")
    stored = _within_bound(materialize(described_rows, "examples"))
    every = _vocabulary(stored)
    size = len(every)
    known = docs.sparkSession.sparkContext.broadcast(every)
    del every
    frequencies = document_frequencies(texts, known, size) if size else (0, np.zeros(0, np.int64))
    counted = docs.sparkSession.sparkContext.broadcast(frequencies)
    base_rate, schema = rate if rate is not None else 0.1, to_arrow_schema(stored.schema)

    def build(batches):
        table = pa.Table.from_batches([b.cast(schema) for b in batches], schema)
        count, holders = counted.value
        frequencies = lambda own: (count, holders[pc.index_in(own, known.value).to_numpy()])
        data = Index(Examples.read(table, kind), base_rate, frequencies).dumped()
        for i, at in enumerate(range(0, len(data), PART_BYTES)):
            part = pa.array([data[at : at + PART_BYTES]], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), part], ["place", "data"])

    built = stored.repartition(1).mapInArrow(build, "place int, data binary")
    path = fresh_path(docs.sparkSession, "index")
    built.write.option("maxRecordsPerFile", 1).parquet(path)  # a part is a file, read by itself
    known.destroy()
    counted.destroy()
    return Fitted(_mapped(docs.sparkSession.read.schema(built.schema).parquet(path)), kind)


def _vocabulary(examples: DataFrame) -> pa.Array:
    """The different terms of all examples."""
    terms = examples.select(F.explode("terms").alias("term")).distinct().toArrow()["term"]
    return pa.concat_arrays([pa.array([], pa.binary()), *terms.chunks])


def _mapped(parts: DataFrame) -> mmap.mmap:
    """The parts in order, in a file without a name mapped into memory; the driver holds one part at a time."""
    with tempfile.TemporaryFile() as file:
        for (place,) in sorted(parts.select("place").collect()):
            for part in parts.where(F.col("place") == place).select("data").toArrow()["data"]:
                file.write(part.as_buffer())
        file.flush()
        return mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)


@dataclass
class Fitted:
    """An index as the bytes that tasks make it from; they lie in a file, so the driver's memory need not hold them."""

    data: mmap.mmap
    kind: str

    def __reduce__(self):
        return loaded, (pickle.PickleBuffer(self.data),)

    @property
    def index(self) -> Index:
        return loaded(self.data)


def loaded(data: bytes | mmap.mmap) -> Index:
    """The index that ``Index.dumped`` wrote."""
    own, signal = pickle.loads(data)
    index, index_signal = Index.__new__(Index), Lists.__new__(Lists)
    index.__dict__.update(own)
    index_signal.__dict__.update(signal)
    index.signal = index_signal
    return index


def score_toxicity(docs: DataFrame, index: Fitted, text: str = "text") -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1) and ``evidence``, the nearest examples with their labels.

    One narrow pass. A null or empty text, or one without any term of the examples, has no
    neighbours and gets the share of toxic rows among such examples. Repeated rows get equal
    scores, an empty table gives no rows; other columns pass through under any name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)
    id_type = to_arrow_type(T._parse_datatype_string(index.kind))

    def make():
        model = shared.value

        def step(columns):
            scores, evidence = [], []
            found = chain.from_iterable(
                model.scores(blobs(columns[0].slice(at, SLICE))) for at in range(0, len(columns[0]), SLICE)
            )
            for score, near in found:
                scores.append(score)
                evidence.append(
                    [{"doc_id": model.ids[i], "cosine": c, "toxic": int(model.labels[i])} for c, i in near]
                )
            kind = pa.struct([("doc_id", id_type), ("cosine", pa.float64()), ("toxic", pa.int32())])
            return [pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(kind))]

        return step

    evidence = f"array<struct<doc_id:{index.kind},cosine:double,toxic:int>>"
    return append_columns(docs, [text], make, f"toxicity double, evidence {evidence}")


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    scored = score_toxicity(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )
