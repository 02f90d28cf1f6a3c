"""Each stage of the pipeline against a plain statement of what it keeps."""

import re

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from hoardlens.llm import bpe, toxicity
from tests.llm.test_jaccard import brute
from tests.llm.test_passes import brute_hits, brute_secrets

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is None, v) for v in r))


def test_stages_follow_brute_force(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    source = [tuple(r) for r in docs.collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    steps = dict(corpus_pipeline.STAGES)

    # The smallest table has too few toxic labels to learn from.
    larger = SF.replace("0.001", "0.01")
    fitted = toxicity.fit(*(spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "labels")))
    monkeypatch.setattr(toxicity, "fit", lambda *_: fitted)
    index = fitted.index
    first = steps["toxicity"](spark, docs, SF)
    kept = [r for r in source if index.score((r[1] or "").encode())[0] < corpus_pipeline.TOXIC]
    assert first.columns == docs.columns and rows_of(first) == sorted(kept)
    assert 0 < len(source) - len(kept) < 0.3 * len(source)

    second = steps["ngram_jaccard"](spark, first, SF)
    least = {d: c for d, n, c in brute([(r[0], r[1]) for r in kept])}
    kept = [r for r in kept if least[r[0]] == r[0]]
    assert rows_of(second) == sorted(kept)

    third = steps["decontamination"](spark, second, SF)
    dirty = {r[0] for r in brute_hits([(r[0], r[1]) for r in kept], items) if r[-1]}
    kept = [r for r in kept if r[0] not in dirty]
    assert rows_of(third) == sorted(kept)

    fourth = steps["secret_scan"](spark, third, SF)
    masked = []
    for doc_id, text, lang, origin, chars in kept:
        out, at = "", 0
        for start, end, _ in brute_secrets(text):
            if start >= at:
                out += text[at:start] + corpus_pipeline.MASK
            at = max(at, end)
        out += text[at:]
        masked.append((doc_id, out, lang, origin, len(out) if brute_secrets(text) else chars))
    assert rows_of(fourth) == sorted(masked)

    fifth = steps["bpe_codec"](spark, fourth, SF).collect()
    library = Tokenizer.from_file(bpe.default_path())
    by_id = {r["doc_id"]: r for r in fifth}
    for doc_id, text, *_ in masked:
        assert by_id[doc_id]["ids"] == library.encode(text, add_special_tokens=False).ids
        assert by_id[doc_id]["round_trip"]
    assert len(fifth) == len(masked)
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()) == sorted(by_id)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, "password = abcdefgh and more", "en", "s", 28),
        (1, "password = abcdefgh and more", "en", "s", 28),
        (1, "quite another text under one id, with words enough to count", "en", "s", None),
        (2, "PASSWORD = abcdefgh and more", None, None, 5),
        (None, "password = abcdefgh and more", "en", "s", 28),
        (3, None, "en", "s", None),
        (4, "", "en", "s", 0),
    ]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, spans string"
    return spark.createDataFrame([(*r, "clash") for r in rows], schema)


def test_odd_rows(spark, odd):
    steps = dict(corpus_pipeline.STAGES)
    assert rows_of(steps["toxicity"](spark, odd, SF)) == rows_of(odd.drop("spans"))
    one = steps["ngram_jaccard"](spark, odd, SF)
    assert [(r["doc_id"], (r["text"] or "")[:5]) for r in one.orderBy("doc_id", "text").collect()] == [
        (None, "passw"), (1, "passw"), (1, "quite"), (3, ""), (4, ""),
    ]
    masked = steps["secret_scan"](spark, odd, SF).collect()
    assert sum("[SECRET]" in (r["text"] or "") for r in masked) == 4
    assert {r["n_chars"] for r in masked if r["doc_id"] == 2} == {len("[SECRET] and more")}
    assert steps["bpe_codec"](spark, odd, SF).count() == 7
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0, name


def test_no_special_lists():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "ngram_jaccard", "decontamination", "secret_scan", "bpe_codec",
    ]
    assert re.fullmatch(r"\[[A-Z]+\]", corpus_pipeline.MASK) and np.isfinite(corpus_pipeline.TOXIC)
