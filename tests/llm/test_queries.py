"""The pipeline queries against SQL where there is one, and against plain code over whole tables where there is none."""

from __future__ import annotations

import hashlib
import os
import zlib

import numpy as np
import public_tokenizers
import pytest

from tests import oracle
from warraq.llm import queries

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="the synthetic tables aren't here")


@pytest.fixture(scope="module")
def duck():
    return oracle.connect()


@pytest.fixture(scope="module")
def documents(duck):
    return dict(duck.execute("select doc_id, text from documents").fetchall())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, duck, name):
    assert oracle.same(queries.QUERIES[name](spark, oracle.DATA), duck, queries.SQL[name])


def test_pieces(spark, documents):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = queries.op4_sentencepiece(spark, oracle.DATA).collect()
    assert {r.doc_id for r in rows} == set(documents) and len(rows) == len(documents)
    for r in rows:
        ids = lib.encode(documents[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def check_packing(rows, documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(documents)
    total = 0
    for doc, own in pieces.items():
        ids = np.array([*t.encode(documents[doc] or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        cuts = list(range(0, len(ids), 2048))
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in sorted(own, key=lambda r: r.piece)] == [(k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(cuts)]
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-total // 2048) + 1


def test_packing(spark, documents):
    check_packing(queries.op5_packing(spark, oracle.DATA).collect(), documents)


def test_quality(spark, documents):
    from tests.llm.test_small import brute_fertility, brute_quality, brute_script
    from warraq.llm import quality

    rows = queries.op6_quality_rules(spark, oracle.DATA).collect()
    assert len(rows) == len(documents)
    for r in rows:
        want = brute_quality(documents[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        figures, name = brute_fertility(documents[r.doc_id] or ""), brute_script(documents[r.doc_id] or "")
        assert r.script == name and np.allclose([r[f] for f in quality.FIGURES], figures)
        assert r.kept == (not r.base_failed and quality.within(name, figures))


def test_lengths(spark, documents):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    n = [len(lib.encode(t or "")) for t in documents.values()]
    for r in queries.op10_token_counts(spark, oracle.DATA).collect():
        assert r.n_docs == n.count(r.n_tokens) and r.truncated_tokens == sum(min(x, r.n_tokens) for x in n)


def test_held_out_accuracy(spark, duck):
    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("the larger tables aren't here")
    c = oracle.connect(path)
    lang = dict(c.execute("select doc_id, lang from documents").fetchall())
    got = queries.op9_language_id(spark, path).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    toxic = dict(c.execute("select doc_id, toxic from labels where toxic is not null").fetchall())
    scored = [r for r in queries.op2_toxicity(spark, path).collect() if r.held_out and r.doc_id in toxic]
    ones, zeros = [r.score for r in scored if toxic[r.doc_id]], [r.score for r in scored if not toxic[r.doc_id]]
    assert np.mean([a > b for a in ones for b in zeros]) + 0.5 * np.mean([a == b for a in ones for b in zeros]) >= 0.9


def test_pipeline(spark, documents, duck):
    import corpus_pipeline
    from tests.llm.test_small import brute_jaccard

    docs = spark.read.parquet(f"{oracle.DATA}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, oracle.DATA)
    assert kept.columns == docs.columns
    verdicts = {r.doc_id for r in queries.op6_quality_rules(spark, oracle.DATA).collect() if r.kept}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(verdicts)
    clean = corpus_pipeline.not_toxic(spark, kept, oracle.DATA)
    assert clean.columns == docs.columns
    rest = sorted((r.doc_id, r.text) for r in clean.collect())
    one = corpus_pipeline.one_of_each_group(spark, clean, oracle.DATA)
    assert one.columns == docs.columns
    _, comp = brute_jaccard([t for _, t in rest])
    assert sorted(r.doc_id for r in one.collect()) == [rest[k][0] for k in range(len(rest)) if comp[k] == k]
    final = {r.doc_id: r.text for r in one.collect()}
    check_packing(corpus_pipeline.run(spark, oracle.DATA).collect(), final)
