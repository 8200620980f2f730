"""Quality rules by tokeniser fertility.

A public subword vocabulary is applied to every word of a text. Three measures follow: characters per token, the share of
byte-fallback tokens, and the entropy of the text's tokens. Each language (or, for a language without a band, each script)
has a band that a text must lie in. A few base rules come first.

Edge cases: a null text is an empty one; a text with fewer than ``min_words`` words fails the base rules; a null or unknown
language takes the band of its script, the script being "latin" if at least half of the non-space characters are ASCII or
Latin letters, else "other"; repeated rows are judged row by row; a null id is returned as it is; a very long text is one pass, in
memory that grows with it; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textops as T
from .runtime import tidy


@dataclass(frozen=True)
class Band:
    """Accepted characters per token, least token entropy in bits, largest share of byte-fallback tokens."""

    min_chars: float
    max_chars: float
    min_entropy: float
    max_bytes: float


#: Bands by language, then by script.
BANDS: dict[str, Band] = {
    "en": Band(1.97, 6.0, 5.45, 0.15),
    "de": Band(1.98, 6.0, 5.45, 0.15),
    "fr": Band(1.80, 6.0, 5.45, 0.15),
    "es": Band(1.79, 6.0, 5.45, 0.15),
    "latin": Band(1.40, 6.0, 4.0, 0.25),
    "other": Band(0.30, 6.0, 4.0, 0.90),
}


@dataclass(frozen=True)
class Rules:
    model: str
    bands: dict[str, Band] = field(default_factory=lambda: BANDS)
    min_words: int = 50
    max_repeat: float = 0.5


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean,"
    " kept boolean, n_tokens long, chars_per_token double, byte_share double, token_entropy double"
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_MODEL: dict[str, tuple] = {}


def _model(path: str):
    if path not in _MODEL:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        _MODEL[path] = sp, np.array([sp.is_byte(i) for i in range(sp.get_piece_size())])
    return _MODEL[path]


def token_stats(w: T.Words, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document: tokens, byte-fallback tokens, entropy in bits. Each distinct word is encoded once."""
    n = len(w.bounds) - 1
    if not len(w.ids):
        return np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    sp, is_byte = _model(path)
    _, at, inv = np.unique(w.ids, return_index=True, return_inverse=True)
    b = w.buf.tobytes()
    ids = sp.encode([b[s:e].decode() for s, e in zip(w.starts[at].tolist(), w.ends[at].tolist(), strict=True)], num_threads=1)
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.concatenate([np.asarray(x, np.int32) for x in ids])
    first = np.concatenate([[0], np.cumsum(size)])
    bytes_in = np.concatenate([[0], np.cumsum(is_byte[flat])])
    per_word = size[inv]
    tokens = w.per_doc(per_word)
    byte_tokens = w.per_doc((bytes_in[first[1:]] - bytes_in[first[:-1]])[inv])
    # all tokens of the run, in order, then counted by document
    ends = np.cumsum(per_word)
    pos = np.arange(ends[-1]) - np.repeat(ends - per_word, per_word) + np.repeat(first[:-1][inv], per_word)
    key = np.repeat(w.doc, per_word) * len(is_byte) + flat[pos]
    key, count = np.unique(key, return_counts=True)
    part = np.bincount(key // len(is_byte), count * np.log2(count), n)
    entropy = np.where(tokens > 0, np.log2(np.maximum(tokens, 1)) - part / np.maximum(tokens, 1), 0.0)
    return tokens, byte_tokens, np.maximum(entropy, 0.0)


def measure(texts: pa.LargeStringArray, langs: list, rules: Rules) -> dict[str, np.ndarray]:
    w = T.words(texts)
    space = T.SPACE[w.buf]
    head = (w.buf & 0xC0) != 0x80
    n_words = w.counts
    chars = w.per_doc_bytes(head & ~space)
    symbols = w.per_doc_bytes(_SYMBOL[w.buf])
    latin = w.per_doc_bytes(head & ~space & (w.buf < 0xCE))
    repeat = T.repeat_words(w)
    tokens, byte_tokens, entropy = token_stats(w, rules.model)
    per_token = chars / np.maximum(tokens, 1)
    share = byte_tokens / np.maximum(tokens, 1)
    failed = (n_words < rules.min_words) | (repeat > rules.max_repeat * n_words)
    band = [rules.bands.get(x) or rules.bands["latin" if 2 * la >= c else "other"] for x, la, c in zip(langs, latin, chars, strict=True)]
    lo, hi, least, most = (np.array([getattr(b, k) for b in band], float) for k in ("min_chars", "max_chars", "min_entropy", "max_bytes"))
    kept = ~failed & (per_token >= lo) & (per_token <= hi) & (entropy >= least) & (share <= most)
    return {
        "n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": T.dup_lines(w), "n_repeat_words": repeat,
        "base_failed": failed, "kept": kept, "n_tokens": tokens, "chars_per_token": per_token, "byte_share": share, "token_entropy": entropy,
    }


def judge(docs: DataFrame, rules: Rules, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document with the base counts, the fertility measures and the verdict. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = T.text_column(batch.column(1)), batch.column(2).to_pylist()
            for lo, hi in T.slices(texts):
                got = measure(texts.slice(lo, hi - lo), langs[lo:hi], rules)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(x) for x in got.values())], ["doc_id", *got])

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) t", f"cast(`{lang_col}` as string) l").mapInArrow(tidy(run), SCHEMA)
