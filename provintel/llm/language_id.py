"""Language identification: script ranges narrow the candidates, Viterbi over per-word scores labels spans.

Learning counts, per language, whole words and byte n-grams (hashed) of a sample of training documents bounded by
``docs_per_lang`` a language (taken by a hash of doc_id), and which scripts the language's words use. A word's scores are
clipped log posteriors over the languages its script allows; words without letters score alike for all. Viterbi with a
switching penalty labels every word of the text; it runs on segments of 64 words at once: segment transfer matrices,
boundary vectors along each document, then forward and backward passes, so long texts cost no long loop.
The label with most letters is the document's; the score is its share of letters.

Defined cases: null text, and text without a letter, give ``und`` and score 0; ties go to the first language in sorted
order; without training rows everything is ``und``; repeated rows are labelled each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import column, mix, word_slices

BUCKETS = 1 << 15
ORDERS = (0, 2, 3, 4)  # 0: the whole word
DOCS_PER_LANG = 4000
PENALTY = 6.0
CLIP = 8.0
SEGMENT = 64
MAX_TRAIN_BYTES = 2 << 20
SCRIPTS = [
    ("latin", [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xB5, 0xB5), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x1E00, 0x1EFF)]),
    ("greek", [(0x370, 0x3FF), (0x1F00, 0x1FFF)]),
    ("cyrillic", [(0x400, 0x52F)]),
    ("armenian", [(0x531, 0x587)]),
    ("hebrew", [(0x5D0, 0x5F2)]),
    ("arabic", [(0x620, 0x6FF), (0x750, 0x77F)]),
    ("devanagari", [(0x900, 0x97F)]),
    ("bengali", [(0x980, 0x9FF)]),
    ("tamil", [(0xB80, 0xBFF)]),
    ("thai", [(0xE00, 0xE7F)]),
    ("georgian", [(0x10A0, 0x10FF)]),
    ("hangul", [(0x1100, 0x11FF), (0xAC00, 0xD7A3)]),
    ("kana", [(0x3040, 0x30FF)]),
    ("han", [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2A6DF)]),
]
_EDGES = sorted((a, b, i + 1) for i, (_, ranges) in enumerate(SCRIPTS) for a, b in ranges)
_LOW, _HIGH, _WHICH = (np.array(x) for x in zip(*_EDGES, strict=True))
OTHER = len(SCRIPTS) + 1


def letter_scripts(data: np.ndarray) -> np.ndarray:
    """Script number at each character's first byte; 0 where there is no letter of a known script."""
    out = np.zeros(len(data), dtype=np.int8)
    letters = ((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122))
    out[letters] = 1
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
        b0, b1, b2, b3 = (padded[lead + k] & (0xFF if k == 0 else 0x3F) for k in range(4))
        code = np.where(b0 < 0xE0, (b0 & 0x1F) << 6 | b1, np.where(b0 < 0xF0, (b0 & 0x0F) << 12 | b1 << 6 | b2, (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3))
        i = np.searchsorted(_LOW, code, side="right") - 1
        out[lead] = np.where((i >= 0) & (code <= _HIGH[i]), _WHICH[i], 0)
    return out


def _features(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(word number, bucket) of each order's features of words; byte n-grams take in a space on either side."""
    out = [(np.arange(len(start)), (hashes & np.uint64(BUCKETS - 1)).astype(np.int64))]
    size = end - start + 2
    first = np.concatenate([[0], np.cumsum(size)])
    word = np.repeat(np.arange(len(start)), size)
    at = np.arange(first[-1]) - first[word]
    inner = (at > 0) & (at < size[word] - 1)
    text = np.full(first[-1], 0x20, dtype=np.uint64)
    text[inner] = data[start[word[inner]] + at[inner] - 1]
    for n in ORDERS[1:]:
        if len(text) < n:
            out.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
            continue
        code = np.zeros(len(text) - n + 1, dtype=np.uint64)
        for k in range(n):
            code = code << np.uint64(8) | text[k : len(text) - n + 1 + k]
        ok = word[: len(code)] == word[n - 1 :]
        out.append((word[: len(code)][ok], (mix(code[ok] + np.uint64(n)) & np.uint64(BUCKETS - 1)).astype(np.int64)))
    return out


def _counts(batches: Iterator[pa.RecordBatch], langs: list[str]) -> Iterator[pa.RecordBatch]:
    place = {x: i for i, x in enumerate(langs)}
    size = len(langs)
    table = np.zeros((len(ORDERS) * BUCKETS + OTHER + 1) * size, dtype=np.int64)
    for w in word_slices(batches, fold=True, most=MAX_TRAIN_BYTES):
        if not len(w.start):
            continue
        lang = np.array([place[x] for x in column(w, "lang").to_pylist()])[w.row]
        for k, (word, bucket) in enumerate(_features(w.data, w.start, w.end, w.hash)):
            table += np.bincount((k * BUCKETS + bucket) * size + lang[word], minlength=len(table))
        scripts = np.maximum.reduceat(letter_scripts(w.data), w.start).astype(np.int64)
        table += np.bincount((len(ORDERS) * BUCKETS + scripts) * size + lang, minlength=len(table))
    cell = np.flatnonzero(table)
    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(table[cell])], names=["cell", "n"])


class LanguageModel:
    """Log probabilities by order, bucket and language, and the languages each script allows."""

    def __init__(self, langs: list[str], table: np.ndarray, allowed: np.ndarray):
        self.langs, self.table, self.allowed = langs, table, allowed

    def word_scores(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, scripts: np.ndarray) -> np.ndarray:
        out = np.zeros((len(start), len(self.langs)))
        for k, (word, bucket) in enumerate(_features(data, start, end, hashes)):
            values = self.table[k][bucket]
            if k == 0:
                out += values
            elif len(word):
                first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                out[word[first]] += np.add.reduceat(values, first, axis=0) / (ORDERS[k] - 1)
        out[~self.allowed[scripts]] = -1e6
        out -= out.max(axis=1, keepdims=True)
        out = np.maximum(out, -CLIP)
        out[scripts == 0] = 0
        return out


def fit_language_model(training: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> LanguageModel:
    """Learns from doc_id, text and lang of rows with a lang, at most about docs_per_lang documents a language."""
    labelled = training.where("lang is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return LanguageModel([], np.zeros((len(ORDERS), BUCKETS, 0)), np.zeros((OTHER + 1, 0), bool))
    million = 1_000_000
    share = F.coalesce(*[F.when(F.col("lang") == x, F.lit(int(min(1, docs_per_lang / n) * million))) for x, n in sizes.items()])
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(million)) < share)
    rows = sample.mapInArrow(lambda b: _counts(b, langs), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(ORDERS) * BUCKETS + OTHER + 1) * len(langs))
    counts[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    grams = counts[: len(ORDERS) * BUCKETS * len(langs)].reshape(len(ORDERS), BUCKETS, len(langs))
    table = np.log((grams + 0.5) / (grams.sum(axis=1, keepdims=True) + 0.5 * BUCKETS))
    scripts = counts[len(ORDERS) * BUCKETS * len(langs) :].reshape(OTHER + 1, len(langs))
    lettered = scripts[1:].sum(axis=0)
    allowed = scripts > 0.01 * np.maximum(lettered, 1)
    allowed[~allowed.any(axis=1)] = True
    return LanguageModel(langs, table, allowed)


def viterbi(scores: np.ndarray, row: np.ndarray, n_rows: int, penalty: float = PENALTY) -> np.ndarray:
    """The best label of each word; words come in order of their rows, and labels of a row may switch at a penalty."""
    n, size = scores.shape
    length = np.bincount(row, minlength=n_rows)
    n_seg = -(-length // SEGMENT)
    first_word, first_seg = np.concatenate([[0], np.cumsum(length)[:-1]]), np.concatenate([[0], np.cumsum(n_seg)[:-1]])
    place = first_seg[row] * SEGMENT + np.arange(n) - first_word[row]
    total = int(n_seg.sum())
    x = np.zeros((total * SEGMENT, size))
    x[place] = scores  # what pads the last segment scores alike for all labels
    x = x.reshape(total, SEGMENT, size)
    switch = penalty * (1 - np.eye(size))
    through = x[:, 0, None, :] - switch
    for t in range(1, SEGMENT):
        through = np.maximum(through, through.max(axis=2, keepdims=True) - penalty) + x[:, t, None, :]
    begin, finish = np.zeros((total, size)), np.zeros((total, size))
    for k in range(1, int(n_seg.max(initial=0))):
        at = first_seg[n_seg > k] + k
        begin[at] = (begin[at - 1][:, :, None] + through[at - 1]).max(axis=1)
        last = (first_seg + n_seg - 1)[n_seg > k] - k
        finish[last] = (through[last + 1] + finish[last + 1][:, None, :]).max(axis=2)
    forward = np.empty_like(x)
    state = begin
    for t in range(SEGMENT):
        state = np.maximum(state, state.max(axis=1, keepdims=True) - penalty) + x[:, t]
        forward[:, t] = state
    state = finish
    for t in range(SEGMENT - 1, -1, -1):
        if t < SEGMENT - 1:
            state = x[:, t + 1] + state
            state = np.maximum(state, state.max(axis=1, keepdims=True) - penalty)
        forward[:, t] += state
    return forward.reshape(-1, size)[place].argmax(axis=1)


def _label(batches: Iterator[pa.RecordBatch], model: LanguageModel) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("lang", pa.string())])
    langs = np.array([*model.langs, "und"], dtype=object)
    for w in word_slices(batches, fold=True):
        n_rows, size = w.batch.num_rows, len(model.langs)
        best, share, lengths = np.full(n_rows, size), np.zeros(n_rows), np.zeros(n_rows, dtype=np.int64)
        starts = counts = labels = np.zeros(0, dtype=np.int64)
        if len(w.start) and size:
            by_byte = letter_scripts(w.data)
            letters = np.add.reduceat((by_byte > 0).astype(np.int64), w.start)
            scripts = np.maximum.reduceat(by_byte, w.start).astype(np.int64)
            _, pick, back = np.unique(w.hash, return_index=True, return_inverse=True)
            scores = model.word_scores(w.data, w.start[pick], w.end[pick], w.hash[pick], scripts[pick])[back]
            label = viterbi(scores, w.row, n_rows)
            by = np.bincount(w.row * size + label, weights=letters, minlength=n_rows * size).reshape(n_rows, size)
            total = by.sum(axis=1)
            best = np.where(total > 0, by.argmax(axis=1), size)
            share = by.max(axis=1) / np.maximum(total, 1)
            # Letters of rare scripts, and marks that ranges take for letters: the few texts without ASCII letters are looked at by character.
            plain = np.bincount(w.row, weights=np.add.reduceat((by_byte == 1).astype(np.int64), w.start), minlength=n_rows)
            for i in np.flatnonzero(plain == 0):
                real = sum(map(str.isalpha, column(w, "text")[int(i)].as_py() or ""))
                if real and total[i] == 0:
                    best[i], share[i] = np.bincount(label[w.row == i], minlength=size).argmax(), 1 / size
                elif not real:
                    best[i], share[i] = size, 0
            new = np.concatenate([[True], (w.row[1:] != w.row[:-1]) | (label[1:] != label[:-1])])
            at = np.flatnonzero(new)
            first = np.searchsorted(w.row, np.arange(n_rows))
            starts, counts, labels = at - first[w.row[at]], np.diff(np.append(at, len(label))), label[at]
            lengths = np.bincount(w.row[at], minlength=n_rows)
        spans = pa.StructArray.from_arrays([pa.array(starts), pa.array(counts), pa.array(langs[labels], pa.string())], fields=list(span))
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [column(w, "doc_id"), pa.array(langs[best], pa.string()), pa.array(share), pa.ListArray.from_arrays(offsets, spans)],
            names=["doc_id", "lang_pred", "score", "spans"],
        )


def label_languages(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score and spans (first word, number of words, language) of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # of a size fixed by buckets and languages
    return documents.select("doc_id", "text").mapInArrow(
        lambda b: _label(b, shared.value), "doc_id long, lang_pred string, score double, spans array<struct<start: long, length: long, lang: string>>"
    )
