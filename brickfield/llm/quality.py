"""Quality rules from tokeniser fertility.

Two public vocabularies measure each text. A byte-level one gives characters per token, the share of tokens
that are not whole characters (byte fallback), and the entropy of its tokens; a piece vocabulary gives the share of
characters that it has no piece for, so that its encoder falls back to bytes. Each script has a
band for every measure; a text outside a band is rejected. A few base counts (length, symbols,
repeated lines and passages) come from the same scan of its words and can reject it first.

The bands hold the middle of what a vocabulary does to running text of a script, with wide
margins: they reject what a tokenizer shatters (binary, base64, symbol soup), what it
swallows whole (padding, rulers) and what repeats a handful of tokens.

A short text can't have many bits a token, however varied: below SHORT tokens the least is lowered in proportion to the
logarithm of their number, that is to the most bits so many tokens can have.

Defined results: a null or empty text has no words and fails the base rule. Whole texts are measured as they are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .columns import field, with_columns
from .pieces import NORMAL, USER, Model
from .vocab import default_path, hold, load_ranks
from .wordscan import NOT_SPACE, U64, mix, scan, text_slices

MIN_WORDS, REPEAT_SHARE, REPEAT_WINDOW, SHORT = 20, 30, 8, 64
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

#: Script: (least and most characters per token, most byte-fallback share, least bits per token for a text of SHORT tokens or more,
#: most characters without a piece). Running text of the scripts was measured to hold 0 to 0.09 of the last.
#: Measured on running text with the default vocabulary, and on random letters of the script beside it. It holds hardly any letters of `indic`
#: (all but Devanagari and Tamil) and `rare` scripts, whose running text is bytes throughout, so there mostly the entropy can reject.
#: `other` is text without letters: Latin's band. Letters beyond U+FFFF give fewer than 0.33 characters a token, in running text too, and go.
BANDS = {
    "latin": (1.88, 9.0, 0.25, 4.4, 0.15),
    "cyrillic": (0.8, 9.0, 0.6, 4.0, 0.15),
    "greek": (0.7, 9.0, 0.8, 4.0, 0.25),
    "cjk": (0.55, 6.0, 0.8, 3.5, 0.4),
    "hangul": (0.8, 9.0, 0.75, 4.0, 0.4),
    "arabic": (1.2, 9.0, 0.25, 4.0, 0.25),
    "hebrew": (1.3, 9.0, 0.4, 4.0, 0.25),
    "armenian": (0.7, 9.0, 0.85, 3.8, 0.4),
    "devanagari": (0.7, 9.0, 0.75, 3.8, 0.25),
    "tamil": (0.8, 9.0, 0.5, 3.8, 0.4),
    "thai": (0.8, 9.0, 0.45, 4.0, 0.25),
    "indic": (0.4, 9.0, 1.0, 3.0, 1.0),
    "rare": (0.33, 9.0, 1.0, 3.0, 1.0),
    "other": (1.88, 9.0, 0.25, 4.4, 0.15),
}
#: First code point of each range and its script; letters only.
_RANGES = (
    *((0x00, None), (0x41, "latin"), (0x5B, None), (0x61, "latin"), (0x7B, None), (0xC0, "latin"), (0x250, "rare"), (0x2B0, None)),
    *((0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, "rare"), (0x750, "arabic"), (0x780, "rare"), (0x8A0, "arabic")),
    *((0x900, "devanagari"), (0x980, "indic"), (0xB80, "tamil"), (0xC00, "indic"), (0xE00, "thai"), (0xE80, "rare"), (0x1100, "hangul"), (0x1200, "rare")),
    *((0x1E00, "latin"), (0x1F00, "greek"), (0x2000, None), (0x2C00, "rare"), (0x2E00, None), (0x3040, "cjk"), (0xA000, "rare"), (0xAC00, "hangul"), (0xD7FF, None)),
    *((0xF900, "cjk"), (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, None), (0xFE70, "arabic"), (0xFEFF, None)),
    *((0xFF21, "latin"), (0xFF5B, None), (0xFF66, "cjk"), (0xFFA0, "hangul"), (0xFFE0, None), (0x10000, "rare"), (0x1D000, None), (0x1E000, "rare"), (0x1EF00, None), (0x20000, "cjk"), (0x32000, None)),
)
_STARTS = np.array([a for a, _ in _RANGES], np.uint32)
_SCRIPTS = list(BANDS)
_OF_RANGE = np.array([-1 if s is None else _SCRIPTS.index(s) for _, s in _RANGES])

RESULT = [field(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [
    field("base_failed", T.BooleanType()),
    field("kept", T.BooleanType()),
    field("script", T.StringType()),
    field("n_tokens", T.LongType()),
    field("chars_per_token", T.DoubleType()),
    field("fallback_share", T.DoubleType()),
    field("token_bits", T.DoubleType()),
    field("piece_fallback_share", T.DoubleType()),
]


def _fallback_tokens(ranks: dict[bytes, int]) -> np.ndarray:
    out = np.zeros(max(ranks.values()) + 1, bool)
    for token, rank in ranks.items():
        try:
            token.decode()
        except UnicodeDecodeError:
            out[rank] = True
    return out


def _with_piece(model: str) -> np.ndarray:
    """Which code points have a piece of their own in a sentencepiece model."""
    with open(model, "rb") as f:
        m = Model(f.read())
    out = np.zeros(0x110000, bool)
    for piece, kind in zip(m.pieces, m.types, strict=True):
        if len(piece) == 1 and kind in (NORMAL, USER):
            out[ord(piece)] = True
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def main_script(text: str) -> str:
    """The script of most letters; `other` if there are none, or if those of a script that is bytes throughout are less than half of the text."""
    points = _points(text)
    kinds = _OF_RANGE[np.searchsorted(_STARTS, points, side="right") - 1]
    counts = np.bincount(kinds[kinds >= 0], minlength=len(_SCRIPTS))
    script = _SCRIPTS[int(counts.argmax())] if counts.any() else "other"
    return "other" if script in ("indic", "rare") and 2 * counts.sum() < (points > 0x20).sum() else script


def piece_fallback(text: str, with_piece: np.ndarray) -> float:
    """The share of characters, white space and controls aside, that the piece vocabulary spells in bytes."""
    points = _points(text)
    points = points[points > 0x20]
    return float((~with_piece[points]).mean()) if len(points) else 0.0


def measure(text: str, encoding, fallback: np.ndarray) -> tuple[int, float, float, float]:
    """Tokens, characters per token, share of byte-fallback tokens, bits per token."""
    ids = encoding.encode_to_numpy(text, disallowed_special=())
    if not len(ids):
        return 0, 0.0, 0.0, 0.0
    counts = np.bincount(ids) if len(ids) > 4000 else np.unique(ids, return_counts=True)[1]
    share = counts[counts > 0] / len(ids)
    return len(ids), len(text) / len(ids), float(fallback[ids].mean()), float(-(share * np.log2(share)).sum())


def in_band(script: str, tokens: int, per_token: float, fallback: float, bits: float, pieceless: float = 0.0, bands=BANDS) -> bool:
    low, high, most_fallback, least_bits, most_pieceless = bands.get(script) or bands["other"]
    return tokens > 0 and pieceless <= most_pieceless and low <= per_token <= high and fallback <= most_fallback and bits >= least_bits * min(1.0, math.log2(tokens) / math.log2(SHORT))


def judge_quality(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None, piece_model: str | None = None, bands=BANDS) -> DataFrame:
    """docs with RESULT's columns."""
    path, model = vocabulary or default_path("byte_bpe_multi_50k.tiktoken"), piece_model or default_path("piece_bpe_32k.model")

    def load():
        encoding, ranks = load_ranks(path)
        return encoding, _fallback_tokens(ranks), _with_piece(model)

    def make():
        encoding, fallback, with_piece = hold(("quality", path, model), load)

        def work(batch: pa.RecordBatch) -> list:
            column = batch.column(batch.schema.get_field_index(text_col))
            out = [[] for _ in RESULT]
            for i, j, data, offs in text_slices(column):
                texts = column.slice(i, j - i).to_pylist()
                base = _base_counts(data, offs)
                for text, (n, chars, symbols, repeats) in zip(texts, zip(*base, strict=True), strict=True):
                    text = text or ""
                    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
                    failed = n < MIN_WORDS or 100 * repeats > REPEAT_SHARE * n
                    script, m = main_script(text), (*measure(text, encoding, fallback), piece_fallback(text, with_piece))
                    row = (n, chars, symbols, len(lines) - len(set(lines)), repeats, failed, not failed and in_band(script, *m, bands=bands), script, *m)
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
            return out

        return work

    return with_columns(docs, RESULT, make)


def _base_counts(data: np.ndarray, offs: np.ndarray) -> tuple[list[int], ...]:
    """Words, characters in words, symbols, words in repeated windows; for each document."""
    w = scan(data, offs, NOT_SPACE)
    sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offs]).tolist()
    gram, at, doc = w.grams(REPEAT_WINDOW)
    key = mix(gram ^ mix(doc.astype(U64) + U64(1)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    step = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(step, at[twice], 1)
    np.add.at(step, at[twice] + REPEAT_WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(step[:-1]) > 0)])
    return w.counts.tolist(), sums(NOT_SPACE[data] & (data & 0xC0 != 0x80)), sums(SYMBOLS[data]), np.diff(covered[w.first]).tolist()
