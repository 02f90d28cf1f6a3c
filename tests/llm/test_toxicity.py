"""The toxicity index holds every term, and weighs terms by all documents."""

import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from hoardlens.llm import toxicity


def cosines(texts, query, frequency, docs):
    """Plain TF-IDF cosines over the terms of the examples."""

    def vector(text):
        counts = Counter(t for w in toxicity.words_of(text) for t in toxicity.terms_of(w))
        weights = {t: (1 + math.log(n)) * (math.log((1 + docs) / (1 + frequency[t])) + 1) for t, n in counts.items() if t in known}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        return {t: w / norm for t, w in weights.items()}

    known = {t for text in texts for w in toxicity.words_of(text) for t in toxicity.terms_of(w)}
    asked = vector(query)
    return [sum(w * asked.get(t, 0.0) for t, w in vector(text).items()) for text in texts]


def frequencies(texts):
    return Counter(t for text in texts for t in {t for w in toxicity.words_of(text) for t in toxicity.terms_of(w)})


def test_every_term_counts(monkeypatch):
    monkeypatch.setattr(toxicity, "COMMON", 40)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(900)]
    texts = [" ".join(words[int(900 * rng.random() ** 2)] for _ in range(30)).encode() for _ in range(700)]
    index = toxicity.Index(toxicity.Examples.of(texts, [i % 2 for i in range(700)], range(700)), 0.5)
    kept = [texts[i] for i in index.ids]
    frequency = frequencies(kept)
    assert set(index.number) == set(frequency) and len(index.number) > 1000
    queries = [" ".join(rng.choice(words) for _ in range(12)).encode() for _ in range(40)] + [b"", None, b"nowhere"]
    for query, (_, near) in zip(queries, index.scores(queries)):
        scores = cosines(kept, query, frequency, len(kept)) if query and query != b"nowhere" else [0.0] * len(kept)
        best = sorted((-s, i) for i, s in enumerate(scores) if s > 1e-9)[: toxicity.NEIGHBOURS]
        assert np.allclose([c for c, _ in near], [-s for s, _ in best])
        assert index.score(query)[1] == near


def test_frequencies_are_those_of_all_documents(spark):
    rows = [(i, f"shared word{i} insult" if i % 3 == 0 else f"shared word{i} plain{i}") for i in range(90)]
    docs = spark.createDataFrame([*rows, (500, None)], "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(30)], "doc_id bigint, toxic int")
    index = toxicity.fit(docs, labels).index
    frequency = frequencies([t.encode() for _, t in rows])
    assert index.number
    for term, i in index.number.items():
        assert math.isclose(index.idf[i], math.log(91 / (1 + frequency[term])) + 1)


def test_ids_of_any_type_and_the_bound_of_the_examples(spark, monkeypatch):
    rows = [(f"d{i}", f"word{i} insult here" if i % 3 == 0 else f"word{i} plain{i} text") for i in range(60)]
    docs = spark.createDataFrame([*rows, (None, "insult"), ("x", None)], "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", int(i % 3 == 0)) for i in range(60)], "doc_id string, toxic int")
    scored = toxicity.score_toxicity(docs, toxicity.fit(docs, labels))
    assert dict(scored.dtypes)["evidence"] == "array<struct<doc_id:string,cosine:double,toxic:int>>"
    found = scored.where("doc_id IS NULL").first()
    assert found["evidence"][0]["doc_id"].startswith("d") and scored.count() == 62
    monkeypatch.setattr(toxicity, "EXAMPLE_TERMS", 120)
    assert 5 <= len(toxicity.fit(docs, labels).index.ids) <= 25


def test_words_of_many_texts_are_looked_up_at_once_without_a_table_of_objects(monkeypatch):
    vocabulary = pa.array([b"insult", b"insu*", b"insul*", b"\xc3\xa9t\xc3\xa9", b"ab"], pa.binary())
    known = toxicity.Known(vocabulary)
    texts = [b"Insult ab insults", None, b"", "été abc insu".encode(), b"ab " * 500]
    expected = [
        sorted(i for w in toxicity.words_of(t) for i, v in enumerate(vocabulary.to_pylist()) if v in toxicity.terms_of(w))
        for t in texts
    ]
    assert [sorted(f.tolist()) for f in known.of(texts)] == expected
    monkeypatch.setattr(toxicity, "RUN_BYTES", 20)
    assert [len(r) for r in toxicity.runs(texts)] == [3, 1, 1]

    vocabulary = pa.array([b"word%d" % i for i in range(300_000)], pa.binary())
    tracemalloc.start()
    toxicity.Known(vocabulary).of([b"word7 nothing"] * 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 << 20


def test_the_index_passes_the_driver_in_parts(spark, monkeypatch):
    own = [" ".join(f"{i}w{j}" for j in range(12)) for i in range(60)]
    rows = [(i, f"{own[i]} insult" if i % 3 == 0 else f"{own[i]} plain") for i in range(60)]
    docs = spark.createDataFrame([*rows, (None, "insult"), (500, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id bigint, toxic int")
    taken = []

    def spied(name, rows_of):
        real = getattr(type(docs), name)

        def call(self):
            found = real(self)
            taken.append(sum(len(v) for r in rows_of(found) for v in r if isinstance(v, (bytes, bytearray)) and len(v) > 100))
            return found

        monkeypatch.setattr(type(docs), name, call)

    spied("collect", list)
    spied("toArrow", lambda table: [r.values() for r in table.to_pylist()])
    monkeypatch.setattr(toxicity, "PART_BYTES", 1_500)
    fitted = toxicity.fit(docs, labels)
    assert len(fitted.data) > 10 * 1_500 and max(taken) <= 1_500
    assert sum(taken) == len(fitted.data)
    monkeypatch.undo()
    assert len(fitted.index.number) > 200 and fitted.index.score(b"insult")[1]
    scored = toxicity.score_toxicity(docs, fitted).collect()
    asked = fitted.index.scores([(r["text"] or "").encode() for r in scored])
    assert [r["toxicity"] for r in scored] == [score for score, _ in asked]
