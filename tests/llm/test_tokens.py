"""Token ids against the libraries' own encoding of whole texts, and exact round trips."""

import shutil
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brickfield.llm import pieces, queries, tokenstore
from brickfield.llm.vocab import default_path
from brickfield.llm.wordscan import text_slices

SF = "/root/testdata/sf0.001"
MODEL, WORDS = default_path("piece_bpe_32k.model"), default_path("word_bpe_49k.json")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_pieces_match_the_library(spark):
    other = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = other.encode(r.text or "")
        want[r.doc_id] = (len(ids), crc(ids), True, True)
    got = {r.doc_id: (r.n_tokens, r.ids_crc32, r.round_trip, r.parity) for r in queries.op7_sentencepiece(spark, SF).collect()}
    assert got == want


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab é\n漢\U0001f600  \t▁x.") | st.characters(blacklist_categories=["Cs"]), max_size=30), min_size=1, max_size=6))
def test_pieces_of_any_text(texts):
    c = pieces.codec(MODEL)
    got = [x for _, _, d, o in text_slices(pa.array(texts)) for x in c.slice(d, o)]
    for text, (ids, back, parity) in zip(texts, got, strict=True):
        assert (ids.tolist() == c.other.encode(text)) == parity
        assert parity or "\0" in text or pieces.MARK in text
        assert back == (c.decode(ids) == text)


def unigram_model():
    """A small unigram model, written field by field."""

    def varint(n):
        out = b""
        while True:
            out, n = out + bytes([n & 127 | (128 if n > 127 else 0)]), n >> 7
            if not n:
                return out

    def message(number, raw):
        return varint(number << 3 | 2) + varint(len(raw)) + raw

    import struct

    def piece(text, score, kind):
        return message(1, message(1, text.encode()) + varint(2 << 3 | 5) + struct.pack("<f", score) + varint(3 << 3) + varint(kind))

    out = piece("<unk>", 0, 2) + piece("<s>", 0, 3) + piece("</s>", 0, 3)
    out += b"".join(piece(f"<0x{b:02X}>", -12, 6) for b in range(256))
    for text, score in (("▁", -2), ("a", -3), ("b", -3.5), ("ab", -4), ("▁ab", -4.2), ("▁a", -3.1), ("ba", -5), ("bab", -6.3)):
        out += piece(text, score, 1)
    trainer = varint(3 << 3) + varint(1) + varint(35 << 3) + varint(1) + b"".join(varint(n << 3) + varint(k) for n, k in ((40, 0), (41, 1), (42, 2)))
    normalizer = message(1, b"identity") + varint(3 << 3) + varint(1) + varint(4 << 3) + varint(1) + varint(5 << 3) + varint(1)
    return out + message(2, trainer) + message(3, normalizer)


def test_unigram_with_byte_fallback(tmp_path):
    path = tmp_path / "u.model"
    path.write_bytes(unigram_model())
    c = pieces.Codec(str(path))
    assert c.model.kind == pieces.UNIGRAM and not c.model.splits and c.model.byte_fallback
    for text in ["ab", "abba bab", "  a  b ", "é", ""]:
        ids, _, parity = c.encode(text)
        assert parity and ids == c.other.encode(text)
    assert c.encode("ab b")[1] and not c.encode("a  b")[1]


def test_pieces_rows(spark):
    rows = [(1, None), (1, "a"), (1, "a"), (None, ""), (2, " "), (3, "x" * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = pieces.encode_pieces(df).collect()
    other = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert all(np.frombuffer(r.ids, np.uint16).tolist() == other.encode(r.text or "") and r.parity and r.round_trip for r in got) and len(got) == 6
    assert pieces.encode_pieces(df.limit(0)).count() == 0


def expected_store(rows):
    t = Tokenizer.from_file(WORDS)
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc, start, len(ids), crc(ids)))
        start += len(ids)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abS'!-9\u0301\u0338é漢<|> \n\t\u2026.") | st.characters(blacklist_categories=["Cs"]), max_size=25), min_size=1, max_size=6))
def test_word_runs_of_any_text(texts):
    t = Tokenizer.from_file(WORDS)
    for texts in (texts, [*texts, "<|endoftext|>x"]):
        for _, _, data, offs in text_slices(pa.array(texts)):
            ids, begins = tokenstore.encode_slice(data, offs, tokenstore._encoder(WORDS))
            for a, b, text in zip(begins[:-1], begins[1:], texts, strict=True):
                assert ids[a:b].tolist() == [*t.encode(text, add_special_tokens=False).ids, 1]


def test_decomposed_capitals():
    t = Tokenizer.from_file(WORDS)
    texts = ["H\u0331", "AH\u0331", "T\u0308x W\u030a, Y\u030a J\u030c", "H\u0331-JAH\u0331", "plain WORDS of ASCII", "E\u0301A\u0300 S\u030cZ", "I\u0307 \u0130", "H"]
    for more in ([], ["<|"]):
        for _, _, data, offs in text_slices(pa.array([*texts, *more])):
            ids, begins = tokenstore.encode_slice(data, offs, tokenstore._encoder(WORDS))
            for a, b, text in zip(begins[:-1], begins[1:], [*texts, *more], strict=True):
                assert ids[a:b].tolist() == [*t.encode(text, add_special_tokens=False).ids, 1]


def test_other_tokenizers_get_whole_texts(tmp_path):
    import json

    for change in ("case", "token"):
        with open(WORDS) as f:
            made = json.load(f)
        if change == "case":
            made["normalizer"] = None
        else:
            made["added_tokens"].append(made["added_tokens"][0] | {"id": 49408, "content": "a b"})
        path = tmp_path / f"{change}.json"
        path.write_text(json.dumps(made))
        t = Tokenizer.from_file(str(path))
        texts = ["Mixed CASE Words, it's 12", "", None, "a b c", "x  <|endoftext|>"]
        for _, _, data, offs in text_slices(pa.array(texts)):
            ids, begins = tokenstore.encode_slice(data, offs, tokenstore._encoder(str(path)))
            for a, b, text in zip(begins[:-1], begins[1:], texts, strict=True):
                assert ids[a:b].tolist() == [*t.encode(text or "", add_special_tokens=False).ids, 1]


def test_store_matches_the_library(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op8_token_store(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == expected_store(rows)


def test_store_reconstructs_and_notices_damage(spark, tmp_path):
    long = " ".join(f"word{i % 700}" for i in range(9000))
    rows = [(None, "x"), (5, None), (6, ""), (7, "Ünï <|endoftext|> it's 12 km"), (8, long), (9, "front " + long), (10, long + " tail")]
    path = str(tmp_path / "store")
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(0))
    tokenstore.write_store(df, path)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokenstore.read_store(spark, path).collect()), key=lambda r: r[1])
    assert got == expected_store(rows)
    t = Tokenizer.from_file(WORDS)
    back = {r.doc_id: r.ids for r in tokenstore.reconstruct(spark, path).collect()}
    assert back == {d: t.encode(x or "", add_special_tokens=False).ids + [1] for d, x in rows}
    stored = spark.read.parquet(f"{path}/objects").where("kind = 0")
    assert stored.count() == stored.select("name").distinct().count()
    assert stored.agg(F.sum(F.length("ids"))).first()[0] < 2 * 1.5 * len(back[8]) + 1000
    copy = str(tmp_path / "bad")
    shutil.copytree(path, copy)
    shutil.rmtree(f"{copy}/objects")
    objects = spark.read.parquet(f"{path}/objects")
    objects.withColumn("ids", F.when(F.col("kind") == 0, F.concat("ids", F.lit(b"\0\0")))).write.parquet(f"{copy}/objects")
    with pytest.raises(Exception, match="CorruptStore"):
        tokenstore.read_store(spark, copy).collect()


def test_store_notices_missing_files(spark, tmp_path):
    rows = [(k, f"text number {k} " * (k + 1)) for k in range(40)]
    path = str(tmp_path / "store")
    tokenstore.write_store(spark.createDataFrame(rows, "doc_id long, text string"), path)
    assert tokenstore.read_store(spark, path).count() == 40
    files = sorted(p for p in Path(path).rglob("*.parquet") if pq.read_metadata(p).num_rows)
    assert {p.parent.name for p in files} == {"objects", "manifest", "roots", "whole"}
    for n, lost in enumerate(files):
        copy = tmp_path / f"copy{n}"
        shutil.copytree(path, copy)
        (copy / lost.relative_to(path)).unlink()
        with pytest.raises(Exception) as error:
            tokenstore.read_store(spark, str(copy)).collect()
        assert "CorruptStore" in repr(error.value), lost
    both = tmp_path / "both"
    shutil.copytree(path, both)
    shard = next(p for p in files if p.parent.name == "manifest")
    number = pq.read_table(shard).column("shard")[0].as_py()
    (both / shard.relative_to(path)).unlink()
    kept = spark.read.parquet(f"{path}/roots").where(F.col("shard") != number)
    shutil.rmtree(both / "roots")
    kept.write.parquet(str(both / "roots"))
    with pytest.raises(tokenstore.CorruptStore):
        tokenstore.read_store(spark, str(both)).collect()


def test_store_repeated_rows_and_empty_table(spark):
    rows = [(1, "b"), (1, "b"), (1, "a")]
    got = sorted((r.start, r.n_tokens) for r in tokenstore.store_and_read(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 2), (2, 2), (4, 2)]
    assert tokenstore.store_and_read(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@given(st.lists(st.binary(max_size=40), min_size=1, max_size=6))
def test_crc_of_parts(parts):
    after = np.array([len(b"".join(parts[k + 1 :])) for k in range(len(parts))])
    crcs = np.array([zlib.crc32(p) for p in parts])
    assert np.bitwise_xor.reduce(tokenstore.shifted_crc(crcs, after)) == zlib.crc32(b"".join(parts))
