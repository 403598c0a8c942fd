"""The Jaccard join against all pairs."""

import random

from pyspark.sql import functions as F

from brickfield.llm import components, jaccard, queries

from . import brute

SF = "/root/testdata/sf0.001"


def test_matches_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute.components(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op9_jaccard(spark, SF).collect()}
    assert got == want and any(c != d for d, (_, c) in want.items())


def near_copies(seed, groups=(40, 25, 3, 1), spread=12):
    """Groups around a base text with a few to many edits, some edits common to part of a group."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(5000)}"
    docs, at = [], 0
    for n in groups:
        base = [word() for _ in range(r.randrange(60, 140))]
        side = list(base)
        for k in r.sample(range(len(base)), 4):
            side[k] = word()
        for _ in range(n):
            w = list(r.choice([base, base, side]))
            for _ in range(r.randrange(0, spread)):
                k = r.randrange(len(w))
                r.choice([lambda: w.__setitem__(k, word()), lambda: w.insert(k, word()), lambda: w.pop(k)])()
            docs.append((at, " ".join(w)))
            at += 1
    r.shuffle(docs)
    return docs


def test_near_copies_with_hubs(spark):
    for seed, short in ((0, 2), (1, 24)):
        docs = near_copies(seed)
        df = spark.createDataFrame(docs, "doc_id long, text string")
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, short=short).collect()}
        assert got == brute.components(docs), (seed, short)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "a b c d e"), (7, "a b c d e"), (8, "a b c d e f"), (9, "x " * 5000), (10, "x x x x x")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("component_id", F.lit("clash")).withColumn("size", F.lit(0))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    assert got == brute.components(docs)
    assert jaccard.jaccard_components(df.limit(0)).count() == 0
    rows = [(None, "a b"), (3, "a b"), (3, "a b"), (3, "q r"), (4, "q r"), (None, None)]
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 3), (3, 3), (3, 3), (3, 3), (4, 3), (None, None)], key=str)


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 140)}


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "q")], "doc_id long, text string")
    for name in ("root", "node", "_group", "_low", "_set", "_node", "_root", "a", "b", "codes", "id", "n_shingles"):
        got = jaccard.jaccard_components(df.withColumn(name, F.lit("own"))).collect()
        assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 3)}
        assert name == "n_shingles" or {r[name] for r in got} == {"own"}


def test_sketch_counts_every_class(spark):
    df = spark.createDataFrame([(k, f"w{k} x y z w v{k % 3}") for k in range(50)], "doc_id long, text string")
    classes = jaccard.gathered(jaccard.scatter(df.select("text"), jaccard._set_packs(5), 6).mapInArrow(lambda it: jaccard._shared(it, 4), jaccard.FOUND)).repartition(3)
    total = sum(len(r.codes) // 8 for r in classes.collect())
    assert total > 0 and int(jaccard._sketch(classes).sum()) == total
