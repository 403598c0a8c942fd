"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here (pieces with scores and types, trainer and normaliser
settings) and rebuilt as a tokenizers pipeline: the precompiled character map if there is one,
the metaspace marker for spaces with or without a dummy prefix, unigram scores or a BPE's
merges in order of score, and byte fallback. Batches are encoded by the library's threads, as many as a
task has cores (spark.task.cpus) unless another number is asked for.

If no piece holds the marker after another character, ids of a text are the ids of its runs
of spaces with the word behind them, and each different run is encoded once for a worker. Each run's
decoding is compared with its bytes and its ids with those of the sentencepiece library, so
both verdicts hold for every whole text. Other models, and texts holding the marker
itself, are encoded and compared as whole texts.

Defined results: a null or empty text has no ids and round-trips; round_trip is false where
the model's normaliser changes a text.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .chunks import Encoder
from .columns import field, with_columns
from .vocab import default_path, hold
from .wordscan import U64, mix, scan, text_slices

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
_SLICE = 1 << 20
_NOT_BLANK = np.ones(256, bool)
_NOT_BLANK[0x20] = False


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = raw[at]
        value |= (b & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if b < 0x80:
            return value, at


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message."""
    at = 0
    while at < len(raw):
        tag, at = _varint(raw, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(raw, at)
        elif kind == 2:
            n, at = _varint(raw, at)
            value, at = raw[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = raw[at : at + n], at + n
        else:
            raise ValueError(f"wire type {kind}")
        yield tag >> 3, value


class Model:
    """What a .model file says. Field numbers are those of the public sentencepiece_model.proto."""

    def __init__(self, raw: bytes) -> None:
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        trainer, normalizer = b"", b""
        for number, value in fields(raw):
            if number == 1:
                f = dict(fields(value))
                self.pieces.append(f.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                self.types.append(f.get(3, NORMAL))
            elif number == 2:
                trainer = value
            elif number == 3:
                normalizer = value
        t, n = dict(fields(trainer)), dict(fields(normalizer))
        self.kind, self.byte_fallback = t.get(3, UNIGRAM), bool(t.get(35, 0))
        self.charsmap, self.dummy_prefix = n.get(2, b""), bool(n.get(3, 1))
        self.squeeze, self.escape = bool(n.get(4, 1)), bool(n.get(5, 1))
        self.unknown = self.types.index(UNKNOWN)

    @property
    def splits(self) -> bool:
        """Whether no piece goes on over a marker, so that runs can be encoded apart."""
        return self.kind == BPE and not (self.charsmap or self.squeeze) and self.dummy_prefix and self.escape and not any(MARK in p.lstrip(MARK) for p, t in zip(self.pieces, self.types, strict=True) if t in (NORMAL, USER))

    def merges(self) -> list[tuple[str, str]]:
        """Every split of a piece into two pieces, best scored piece first."""
        scored = {p: s for p, s, t in zip(self.pieces, self.scores, self.types, strict=True) if t == NORMAL}
        found = []
        for piece, score in scored.items():
            parts = [(piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in scored and piece[k:] in scored]
            found += [(-score, a, b) for a, b in parts]
        found.sort(key=lambda x: x[0])
        return [(a, b) for _, a, b in found]

    def tokenizer(self, marked: bool):
        """The tokenizers pipeline; marked: for texts that have their markers already."""
        from tokenizers import Tokenizer, decoders, models, normalizers

        if self.kind == UNIGRAM:
            core = models.Unigram(list(zip(self.pieces, self.scores, strict=True)), self.unknown, self.byte_fallback)
        elif self.kind == BPE:
            core = models.BPE({p: k for k, p in enumerate(self.pieces)}, self.merges(), unk_token=self.pieces[self.unknown], fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            raise ValueError(f"model type {self.kind}")
        out = Tokenizer(core)
        steps = []
        if not marked:
            steps += [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
            steps += [normalizers.Replace(r, s) for r, s in _squeezing()] if self.squeeze else []
            steps += [normalizers.Prepend(MARK)] if self.dummy_prefix else []
            steps += [normalizers.Replace(" ", MARK)] if self.escape else []
        if steps:
            out.normalizer = normalizers.Sequence(steps)
        out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if self.dummy_prefix else [])])
        return out

    def bytes_of(self, ids) -> bytes:
        return b"".join(self._bytes[k] for k in ids)

    @property
    def _bytes(self) -> list[bytes]:
        if not hasattr(self, "_table"):
            self._table = [bytes([int(p[1:-1], 16)]) if t == BYTE else b"" if t == CONTROL else p.replace(MARK, " ").encode() for p, t in zip(self.pieces, self.types, strict=True)]
        return self._table


def _squeezing():
    from tokenizers import Regex

    return ((Regex("^ +| +$"), ""), (Regex(" {2,}"), " "))


def _threads(n: int) -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if n > 1 else "false"
    os.environ["RAYON_NUM_THREADS"] = str(n)


class Codec:
    """Encodes, decodes and checks texts with one model."""

    def __init__(self, path: str, threads: int = 1) -> None:
        import sentencepiece

        _threads(threads)
        with open(path, "rb") as f:
            self.model = Model(f.read())
        self.marked, self.whole = self.model.tokenizer(True), self.model.tokenizer(False)
        self.other, self.threads = sentencepiece.SentencePieceProcessor(model_file=path), threads
        self.dtype = np.uint16 if len(self.model.pieces) <= 1 << 16 else np.uint32
        self.bad: dict[bytes, tuple[bool, bool]] = {}
        self.runs = Encoder(self._encode_runs, self.dtype)

    def _encode_runs(self, runs: list[bytes]) -> list[list[int]]:
        """Each run is some spaces and a word; the first space is the prefix or the one that stands between words."""
        texts = [r.decode() for r in runs]
        ids = [e.ids for e in self.marked.encode_batch_fast([t.replace(" ", MARK) for t in texts], add_special_tokens=False)]
        same = self.other.encode([t[1:] for t in texts], num_threads=self.threads)
        for r, t, a, b in zip(runs, texts, ids, same, strict=True):
            back, parity = self.model.bytes_of(a) == r, a == (b if t[1:] else a)
            if not (back and parity):
                self.bad[r] = (back, parity)
        return ids

    def encode(self, text: str) -> tuple[list[int], bool, bool]:
        """(ids, round trip, parity) of a whole text."""
        if not text:
            return [], True, True
        ids = self.whole.encode(text, add_special_tokens=False).ids
        return ids, self.whole.decode(ids, skip_special_tokens=False) == text, ids == self.other.encode(text)

    def slice(self, data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, bool, bool]]:
        """(ids, round trip, parity) of each text of a slice."""
        if not self.model.splits or MARK.encode() in (raw := data.tobytes()):
            whole = data.tobytes()
            for a, b in zip(offs[:-1], offs[1:], strict=True):
                ids, back, parity = self.encode(whole[a:b].decode())
                yield np.array(ids, self.dtype), back, parity
            return
        w = scan(data, offs, _NOT_BLANK)
        n = len(offs) - 1
        doc = w.doc_of_word()
        before = np.concatenate([[0], w.end[:-1]]) if len(w.end) else w.end
        first = np.zeros(len(w.start), bool)
        first[w.first[:-1][w.counts > 0]] = True
        begin = np.where(first, offs[:-1][doc], before)
        blanks = w.start - begin + first
        last = np.where(w.counts > 0, w.end[np.maximum(w.first[1:], 1) - 1] if len(w.end) else 0, offs[:-1])
        tail = offs[1:] - last
        only = (w.counts == 0) & (tail > 0)
        tail = tail + only  # a text of spaces alone has its prefix too
        ends = np.flatnonzero(tail > 0)
        order = np.argsort(np.concatenate([doc * 2, ends * 2 + 1]), kind="stable")
        blanks, word, owner = np.concatenate([blanks, tail[ends]])[order], np.concatenate([np.arange(len(doc)), np.full(len(ends), -1)])[order], np.concatenate([doc, ends])[order]
        hashes = np.append(w.hash, U64(0x9E37))[word]

        def run(k: int) -> bytes:
            i = word[k]
            return b" " * int(blanks[k]) + (raw[w.start[i] : w.end[i]] if i >= 0 else b"")

        keys = mix(hashes ^ mix(blanks.astype(U64)))
        ids, sizes = self.runs.ids(keys, run)
        at = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(owner, np.arange(n + 1))]
        wrong: dict[int, list[tuple[bool, bool]]] = {}
        if self.bad:
            for k in range(len(word)):
                if (b := self.bad.get(run(k))) is not None:
                    wrong.setdefault(int(owner[k]), []).append(b)
        for d in range(n):
            bad = wrong.get(d, ())
            yield ids[at[d] : at[d + 1]], all(b for b, _ in bad), all(p for _, p in bad)

    def decode(self, ids) -> str:
        raw = self.model.bytes_of(np.asarray(ids).tolist())
        return (raw[1:] if self.model.dummy_prefix and raw[:1] == b" " else raw).decode(errors="replace")


def codec(path: str, threads: int = 1) -> Codec:
    return hold(("pieces", path, threads), lambda: Codec(path, threads))


RESULT = [
    field("n_tokens", T.LongType()),
    field("ids_crc32", T.LongType()),
    field("ids", T.BinaryType()),
    field("round_trip", T.BooleanType()),
    field("parity", T.BooleanType()),
]


def encode_pieces(docs: DataFrame, text_col: str = "text", model: str | None = None, threads: int | None = None, with_ids: bool = True) -> DataFrame:
    """docs with each text's ids (little-endian, 2 bytes each for a vocabulary of up to 65,536; null if not asked for), their number and
    the CRC-32 of them as 4-byte numbers, whether they decode to the text, and whether sentencepiece gives the same."""
    path = model or default_path("piece_bpe_32k.model")
    threads = threads or int(docs.sparkSession.sparkContext.getConf().get("spark.task.cpus", "1"))

    def make():
        c = codec(path, threads)

        def work(batch: pa.RecordBatch) -> list:
            out = [[] for _ in RESULT]
            for _, _, data, offs in text_slices(batch.column(batch.schema.get_field_index(text_col)), _SLICE):
                for ids, back, parity in c.slice(data, offs):
                    row = (len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids.tobytes() if with_ids else None, back, parity)
                    for o, v in zip(out, row, strict=True):
                        o.append(v)
            return out

        return work

    return with_columns(docs, RESULT, make)
