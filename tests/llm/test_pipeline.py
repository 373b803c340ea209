"""The pipeline's rows against a plain version of its stages, over the smallest documents table."""

import hashlib
import math

import brute
import pytest

tokenizers_ = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from tidewatch.llm import piece_viterbi, pii_bootstrap  # noqa: E402
from tidewatch.llm.queries import MIX_WEIGHTS  # noqa: E402


def policy_rejects(text):
    n_words, word_chars, n_symbols, n_dup, _, failed = brute.quality(text)
    lines = [x for x in text.split("\n") if brute.WORD.search(x)]
    letters = sum(c.isascii() and c.isalpha() for c in text)
    upper = sum(c.isascii() and c.isupper() for c in text)
    return failed or 2 * n_symbols > n_words or (len(lines) >= 4 and 2 * n_dup > len(lines)) or word_chars > 15 * n_words or (letters >= 100 and 2 * upper > letters)


def poisson(mean, u):
    k, total, log = 0, 0.0, -mean
    while True:
        total += math.exp(log)
        if u < total or k > 500:
            return k
        k += 1
        log += math.log(mean) - math.log(k)


def copies(docs):
    sizes = {}
    for _, text, source in docs:
        sizes[source] = sizes.get(source, 0) + len(text)
    weights = {s: MIX_WEIGHTS.get(s, 1.0) for s in sizes}
    for doc_id, text, source in docs:
        mean = weights[source] / sum(weights.values()) * sum(sizes.values()) / sizes[source]
        u = int(hashlib.md5(f"mix:count:{doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        yield from [(doc_id, text)] * poisson(mean, u)


def test_pipeline(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    kept = [d for d in docs if not policy_rejects(d[1])]
    stays = {d for d, _, c in brute.components([(d, t) for d, t, _ in kept], 5, 80) if d == c}
    clean = []
    for doc_id, text, source in kept:
        if doc_id in stays:
            spans = brute.personal_base(text)
            clean.append((doc_id, pii_bootstrap.redacted(text, [(s, pii_bootstrap.KINDS.index(k), e) for k, s, e in spans]), source))
    model = piece_viterbi.piece_model(tokenizers_.path("piece_bpe_32k.model"))
    wanted = sorted((d, model.encode(t).tolist()) for d, t in copies(clean))
    out = corpus_pipeline.run(spark, sf)
    assert sorted((r.doc_id, list(r.ids)) for r in out.collect()) == wanted
    assert out.where("not decodes").count() == 0


def test_stages_keep_columns(spark, odd, empty, sf):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns
        assert stage(spark, docs, sf).count() == 0 or docs is odd
