"""Substring deduplication against a plain version."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brickfield.llm import packed, queries, substrings

from . import brute

SF = "/root/testdata/sf0.001"


def test_matches_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op2_substring_dedup(spark, SF).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    want = brute.substring_dedup(docs)
    assert got == want and any(r[2] for r in want)


def made(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    passage = [r.choice(words) for _ in range(80)]
    docs = []
    for d in range(40):
        w = [r.choice(words) for _ in range(r.randrange(0, 200))]
        if d % 2:
            a = r.randrange(0, 30)
            w[r.randrange(0, len(w) + 1) : 0] = passage[a : a + r.randrange(45, 56)]
        docs.append((d * 3 - 30, r.choice([" ", "\n", " \t "]).join(w)))
    return docs + [(500, docs[1][1]), (501, docs[1][1]), (502, " ".join(["x"] * 200)), (503, " ".join(["x"] * 49)), (504, " ".join(["x"] * 51)), (505, ""), (506, None)]


def test_passages_copies_and_runs(spark):
    for seed in range(3):
        docs = made(seed)
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumn("n_words", F.lit("clash")).withColumn("id", F.lit(1))
        got = sorted(tuple(r) for r in substrings.dedup_substrings(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
        assert got == brute.substring_dedup(docs)


def test_nulls_repeated_rows_and_empty_table(spark):
    text = " ".join(f"a{i}" for i in range(60))
    docs = [(None, text), (2, text), (2, text), (3, text + " b"), (4, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.n_removed, r.kept_text) for r in substrings.dedup_substrings(df).collect()}
    assert got == {(None, 0, text), (2, 0, text), (3, 60, "b"), (4, 0, "")}
    assert substrings.dedup_substrings(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(-3, 3), st.integers(0, 5)), min_size=1), min_size=1, max_size=5))
def test_streamed_states(chunks):
    seen, low = packed.Seen(), packed.Smallest()
    shared, above = set(), set()
    for chunk in chunks:
        ids, keys = np.array([c[0] for c in chunk], np.int64), np.array([c[1] for c in chunk], np.uint64)
        a, _, k = seen.feed(ids, ids.astype(np.uint32), keys)
        shared |= {*zip(a.tolist(), k.tolist(), strict=True)}
        a, k = low.feed(ids, keys)
        above |= {*zip(a.tolist(), k.tolist(), strict=True)}
    every = {p for chunk in chunks for p in chunk}
    assert shared == {(d, k) for d, k in every if any(e != d and k == j for e, j in every)}
    assert above == {(d, k) for d, k in every if any(e < d and k == j for e, j in every)}


@given(st.lists(st.integers(0, 2**64 - 1)), st.sampled_from([4, 6, 8]))
def test_key_bytes(keys, width):
    a = np.array(keys, np.uint64)
    assert packed.decode(packed.encode(a, width), width).tolist() == [k % 256**width for k in keys]


def test_clashing_columns(spark):
    text = " ".join(f"a{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (2, text + " b")], "doc_id long, text string")
    for name in ("_id", "_of", "_codes", "id", "codes", "size", "bucket"):
        got = substrings.dedup_substrings(df.withColumn(name, F.lit("own"))).collect()
        assert {(r.doc_id, r.n_removed, r[name]) for r in got} == {(1, 0, "own"), (2, 60, "own")}


def test_repeated_words_travel_once():
    import pyarrow as pa

    t = pa.table({"id": [1], "text": ["x " * 100_000]})
    (_, _, _, blocks, _), (_, _, docs, keys, _) = substrings._anchor_packs(t)
    assert len(blocks) == len(keys) == len(docs) == 1
