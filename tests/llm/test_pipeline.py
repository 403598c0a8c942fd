"""The pipeline against a plain version of each stage."""

import sentencepiece

import corpus_pipeline
from brickfield.llm import pii, quality
from brickfield.llm.vocab import default_path, ranks_encoding

from . import brute

SF = "/root/testdata/sf0.001"


def plain(docs, items):
    encoding, ranks = ranks_encoding(default_path("byte_bpe_multi_50k.tiktoken"))
    fallback = quality._fallback_tokens(ranks)
    docs = {d: t or "" for d, t in docs}
    docs = {d: t for d, t in docs.items() if not brute.quality_base(t)[5] and quality.in_band(quality.main_script(t), *quality.measure(t, encoding, fallback))}
    docs = {d: docs[d] for d, (_, c) in brute.components(list(docs.items())).items() if c == d}
    docs = {d: docs[d] for d, r in brute.decontaminate(list(docs.items()), items).items() if not r[4]}
    docs = {d: pii.redact(t, pii.find_private(t)[1]) for d, t in docs.items()}
    other = sentencepiece.SentencePieceProcessor(model_file=default_path("piece_bpe_32k.model"))
    return {d: (len(t), other.encode(t)) for d, t in docs.items()}


def test_run(spark):
    import numpy as np

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = plain(docs, items)
    got = {r.doc_id: (r.n_chars, np.frombuffer(r.ids, np.uint16).tolist()) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 0 < len(want) < len(docs)


def test_stages_keep_the_columns_and_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == list(corpus_pipeline.COLUMNS) and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


def test_one_document_of_each_group_stays_with_null_and_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(None, a), (None, a), (None, a + " end"), (7, b), (7, b), (7, b + " end"), (9, b), (None, b), (7, c), (8, None), (8, None), (None, " ")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert got.columns == list(corpus_pipeline.COLUMNS)
    want = [(None, a), (7, b), (7, c), (8, None), (8, None), (None, " ")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
