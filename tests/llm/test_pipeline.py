import random
import re

import corpus_pipeline as pipeline
import pytest
from test_llm import MODEL, brute_groups, brute_spans, measures, words

from rowanmill.llm import quality
from rowanmill.llm.common import materialize


@pytest.fixture(scope="module")
def stages(spark, sample):
    """What each stage gets and gives."""
    docs, out = sample, {}
    for name, stage in pipeline.STAGES:
        got = materialize(stage(spark, docs, ""))
        out[name], docs = (docs, got), got
    return out


def test_columns(stages, sample):
    assert all(got.columns == sample.columns for _, got in list(stages.values())[:-1])


def test_quality_stage(stages):
    docs, got = stages["quality_rules"]
    kept = {r["doc_id"] for r in got.collect()}
    for r in docs.collect():
        n, _, symbols, _, repeats = measures(r["text"])
        if n < 50 or 100 * repeats > 50 * n or symbols > 0.4 * n:
            assert r["doc_id"] not in kept
    assert len(kept) > 0.6 * docs.count() and any(rule.measure == "stop_word_ratio" for rule in quality.RULES)


def test_dedup_stage(stages):
    docs, got = stages["near_dedup"]
    assert {r["doc_id"] for r in got.collect()} <= {r["doc_id"] for r in docs.collect()}
    firsts = {c for _, _, c in brute_groups(docs, 5)}
    assert {r["doc_id"] for r in got.collect()} <= firsts


def test_near_copies_go(spark):
    rng = random.Random(2)
    text = lambda n: [rng.choice("abcdefghijklmnop") + str(rng.randint(0, 400)) for _ in range(n)]
    rows, want = [], set()
    for k in range(40):
        base = text(300)
        want.add(10 * k)
        rows.append((10 * k, " ".join(base)))
        for c in range(1, 4):  # each copy has four new words in a row, so about 0.95 of the shingles stay
            copy, at = list(base), rng.randint(20, 270)
            copy[at : at + 4] = text(4)
            rows.append((10 * k + c, " ".join(copy)))
        far = base[:150] + text(150)
        rows.append((10 * k + 5, " ".join(far)))
        want.add(10 * k + 5)
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in pipeline.near_dedup(spark, docs, "").collect()} == want


def test_pii_stage(stages):
    docs, got = stages["pii"]
    before, after = ({r["doc_id"]: r["text"] for r in df.collect()} for df in (docs, got))
    assert before.keys() == after.keys()
    keys = re.compile(r"(?<![^\W_])(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{32,64}(?![^\W_])", re.I)  # in this table all stand after the words that lower-case ones stand after
    assert all((brute_spans(t) == "" and not keys.search(t)) == (after[i] == t) for i, t in before.items())


def test_mix_stage(stages):
    docs, got = stages["mixing"]
    size, taken = (sum(len(words(r["text"])) for r in df.collect()) for df in (docs, got))
    assert abs(taken - 1.5 * size) < 100


def test_tokens_stage(stages):
    import sentencepiece

    docs, got = stages["sentencepiece"]
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert sorted(tuple(model.encode(r["text"])) for r in docs.collect()) == sorted(tuple(r["ids"]) for r in got.collect())
