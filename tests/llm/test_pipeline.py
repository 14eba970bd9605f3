"""The corpus pipeline: each stage against brute force on its own input."""

import hashlib
import random

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as cp
from tests.llm.test_corpus_operators import brute_components, brute_drop, brute_fingerprint, frame, labelled_corpus, prose
from upliftforge.llm import line_dedup, mixing
from upliftforge.llm.common import tokenizer_path


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    docs, labels = labelled_corpus(spark, 300)
    rnd = random.Random(21)
    passage = prose(rnd, 60)
    docs += [(1000 + i, prose(rnd, 30) + "\n" + passage + "\n" + prose(rnd, 20), "s") for i in range(5)]
    docs += [(2000 + i, docs[i][1], "s") for i in range(10)] + [(3000, None, None), (3001, "", "s")]
    base = f"file://{tmp_path_factory.mktemp('corpus')}"
    frame(spark, docs).drop("lines").write.parquet(f"{base}/documents.parquet")
    labels.write.parquet(f"{base}/labels.parquet")
    return base


def test_stages(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = docs.columns
    truth = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{corpus}/labels.parquet").collect()}
    for k, (name, stage) in enumerate(cp.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, corpus)
        out.write.parquet(f"file://{tmp_path}/{k}")
        docs_before = docs
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        rows = docs.collect()
        assert k == len(cp.STAGES) - 1 or docs.columns == columns
        after = {r.doc_id: getattr(r, "text", None) for r in rows}
        assert set(after) <= set(before) and (name == "mixing" or name == "SentencePiece" or len(after) == len(rows))
        if name == "quality classifier":
            assert {i for i, t in before.items() if not (t or "").split()}.isdisjoint(after)
            assert np.mean([i in after for i, (q, bad) in truth.items() if q and not bad and i in before]) > 0.97
            assert np.mean([i in after for i, (q, _) in truth.items() if not q and i in before]) < 0.5
        if name == "line dedup":
            listed = sorted((i, t, "s") for i, t in before.items())
            gone = brute_drop(listed, line_dedup.MIN_WORDS)
            want = {i: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone.get(d, ())) for d, (i, t, _) in enumerate(listed)}
            assert after == {i: t for i, t in want.items() if t.strip() or before[i] == t}
            assert all(r.n_chars == len(r.text) for r in rows)
        if name == "SimHash near-dedup":
            ids = sorted(before)
            roots = brute_components([brute_fingerprint(before[i]) for i in ids], lambda a, b: (a ^ b).bit_count() <= 4)
            assert set(after) == {ids[r] for r in roots}
        if name == "mixing":
            assert len(rows) != len(before) and any(n > 1 for n in Counter(r.doc_id for r in rows).values())
            copies = Counter(r.doc_id for r in rows)
            good = [i for i, (q, bad) in truth.items() if q and not bad and i in before]
            assert np.mean([copies[i] >= 1 for i in good]) > 0.99
            rated = mixing.mix(docs_before, spark.read.parquet(f"{corpus}/labels.parquet"), cp.PIPELINE_TARGETS, cp.MOST_RATE, cp.CLEAN_SCALE).collect()
            assert copies == Counter({r.doc_id: r.copies for r in rated if r.copies})
            whole = sum(r.rate * r.tokens for r in rated)
            for d, share in cp.PIPELINE_TARGETS.items():
                assert abs(sum(r.rate * r.tokens * r[f"p_{d}"] for r in rated) / whole - share) < 0.01
            assert abs(sum(copies[r.doc_id] * r.tokens * r.p_toxic for r in rated) / sum(copies[r.doc_id] * r.tokens for r in rated) - cp.PIPELINE_TARGETS["toxic"]) < 0.03
        if name == "SentencePiece":
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
            for r in rows:
                ids = sp.encode(before[r.doc_id], add_bos=True, add_eos=True)
                assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_run_equals_stages(spark, corpus):
    whole = cp.run(spark, corpus)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(whole.columns)
    assert 150 < whole.count() < 320
