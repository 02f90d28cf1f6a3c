"""Language and toxicity models: exact search, held-out accuracy, odd rows."""

import random
from collections import Counter

import numpy as np
import pytest

from hoardlens.llm import language, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def index():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    bad = ["vile", "nasty", "scum"]
    texts, labels = [], []
    for i in range(500):
        toxic = i % 4 == 0
        text = [rng.choice(words) for _ in range(rng.randint(5, 40))] + [rng.choice(bad) for _ in range(2 * toxic)]
        texts.append(" ".join(text).encode())
        labels.append(int(toxic))
    return toxicity.Index(toxicity.Examples.of(texts, labels, range(500)), 0.1)


def test_nearest_is_exact(index):
    rng = random.Random(1)
    dense = np.zeros((len(index.labels), len(index.number)))
    cells = np.arange(len(index.number)).repeat(np.diff(index.start[:: index.blocks]))
    dense[index.doc, cells] = index.weight
    for _ in range(100):
        text = " ".join(rng.choice(["vile", "nasty", "scum", "w1", "w2", "w3", "w9"]) for _ in range(6)).encode()
        terms, weights, _ = index.query(text)
        scores = dense[:, terms] @ weights
        best = sorted(((-s, i) for i, s in enumerate(scores) if s > 0))[: toxicity.NEIGHBOURS]
        found = index.nearest(terms, weights)
        assert np.allclose([c for c, _ in found], [-s for s, _ in best])


def test_scores_are_probabilities_and_rise_with_insults(index):
    clean, toxic, empty = (index.score(t)[0] for t in (b"w1 w2 w3", b"scum nasty vile", None))
    assert 0 <= clean < 0.5 <= toxic <= 1 and 0 <= empty < 0.5


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    found = toxicity.toxicity_digest(docs, labels)
    rows = found.where("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    counts = Counter((r[0], r[1]) for r in rows)
    assert found.count() == docs.count()
    assert counts[0, 1] <= 0.05 * (counts[0, 0] + counts[0, 1])
    assert counts[1, 1] >= 0.7 * (counts[1, 0] + counts[1, 1])


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, "x", 9), (2, None, 9), (None, "", 9), (1, "x", 9)], "doc_id bigint, text string, toxicity int"
    )
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, none)
    scored = toxicity.score_toxicity(docs, model).collect()
    assert len(scored) == 4 and all(0 <= r[3] < 0.5 and r[2] == 9 and r[4] == [] for r in scored)
    assert toxicity.toxicity_digest(docs.limit(0), none).count() == 0


def test_windows_cover_the_whole_text():
    for size in (1, 127, 128, 129, 1000):
        data = bytes(1 + i % 250 for i in range(size))
        windows = language.windows_of(data)
        assert windows.shape[1] == language.WINDOW
        assert windows.tobytes().startswith(data[:128]) and windows[-1].tobytes().rstrip(b"\0").endswith(data[-1:])
        assert len(windows) == max(1, -(-size // 128))


def test_gradients_match_differences():
    network = language.ByteNetwork(["a", "b"], seed=3)
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (6, 20), dtype=np.uint8), np.array([0, 1, 0, 1, 1, 0])

    def loss():
        pooled, _ = network._pooled(x)
        p = language._softmax(pooled.astype(float) @ network.out + network.out_bias)
        return -np.log(p[np.arange(6), y]).mean()

    gradients = network._gradients(x, y)
    weights = [t for tables in network.tables for t in tables] + network.bias + [network.out, network.out_bias]
    for w, g in zip(weights, gradients):
        flat, grad = w.reshape(-1), np.asarray(g).reshape(-1)
        place = int(np.abs(grad).argmax())
        keep = flat[place]
        flat[place] = keep + 1e-2
        high = loss()
        flat[place] = keep - 1e-2
        low = loss()
        flat[place] = keep
        assert abs((high - low) / 2e-2 - grad[place]) < 2e-2


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = language.language_digest(docs)
    rows = found.where("held_out").join(docs, "doc_id").select("lang", "lang_pred").collect()
    assert found.count() == docs.count()
    assert sum(r[0] == r[1] for r in rows) >= 0.97 * len(rows)


def test_language_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, "hello there", "en"), (2, None, "en"), (3, "", None), (None, "12 !?", "en"), (4, "abc", None), (6, "x", "en")],
        "doc_id bigint, text string, lang string",
    )
    rows = {r["doc_id"]: r for r in language.language_digest(docs).collect()}
    assert rows[2]["lang_pred"] == rows[3]["lang_pred"] == rows[None]["lang_pred"] == "und"
    assert rows[4]["lang_pred"] == "en" and 0 <= rows[4]["score"] <= 1
    assert language.language_digest(docs.limit(0)).count() == 0
