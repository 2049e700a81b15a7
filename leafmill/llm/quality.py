"""Quality rules: fixed base rules, then a calibrated n-gram logistic model with a fixed threshold.

Features are hashed words, word pairs and runs of four characters (code points), each kind mean-pooled over the whole text, in one
table of 2**18 weights. The model is fitted on a bounded sample of labelled rows, and its logit is mapped to
a probability (Platt scaling) on a third of that sample that the fit does not see.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.arrowtext import U64, Roller, byte_values, mix64, sliced, utf8, words_of

BITS = 18
#: Labelled rows that the model is fitted on, at most.
TRAIN_ROWS = 4_000
KEEP_AT = 0.5
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: The characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: Characters of a gram.
GRAM = 4
#: Scale of a kind's mean-pooled features: words, word pairs, grams of characters.
SCALES = (12.0, 12.0, 24.0)
BASE_A, BASE_B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F

_IS_SYMBOL = np.zeros(256, np.int64)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = 1
_STARTS_CHAR = np.ones(256, np.int64)
_STARTS_CHAR[0x80:0xC0] = 0


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of each row's values; at: row offsets."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[at[1:]] - total[at[:-1]]


class Texts:
    """What rules and features need of a batch of texts, computed once."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        self.raw, self.at = raw, at
        self.starts, self.ends, self.word_at = words_of(raw, at)
        roller = Roller(byte_values(5)[raw], BASE_A)
        self.roller = roller
        self.words = mix64(roller.slices(self.starts, self.ends) + (self.ends - self.starts).astype(U64))

    def base(self) -> dict[str, np.ndarray]:
        raw, at, word_at = self.raw, self.at, self.word_at
        n = np.diff(word_at)
        chars = np.concatenate([[0], np.cumsum(_STARTS_CHAR[raw])])
        out = {"n_words": n, "word_chars": _sums(chars[self.ends] - chars[self.starts], word_at), "n_symbols": _sums(_IS_SYMBOL[raw], at)}
        out["n_dup_lines"] = self._repeated_lines()
        out["n_repeat_words"] = self._repeated_words()
        return out

    def _repeated_lines(self) -> np.ndarray:
        raw, at = self.raw, self.at
        feeds = np.flatnonzero(raw == 10)
        starts = np.unique(np.concatenate([at[:-1], feeds + 1]))
        starts = starts[starts < len(raw)]
        row = np.searchsorted(at, starts, side="right") - 1
        nxt = np.append(starts[1:], len(raw))
        ends = np.minimum(nxt, at[row + 1])
        # the line feed that ends a line is not part of it
        has_feed = (ends > starts) & (raw[np.maximum(ends - 1, 0)] == 10)
        ends = ends - has_feed
        worded = np.searchsorted(self.starts, ends) > np.searchsorted(self.starts, starts)
        row, starts, ends = row[worded], starts[worded], ends[worded]
        key = mix64(self.roller.slices(starts, ends) + mix64(row.astype(U64)) + (ends - starts).astype(U64))
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(key), bool)
        again[order[1:]] = key[order[1:]] == key[order[:-1]]
        return np.bincount(row[again], minlength=len(at) - 1).astype(np.int64)

    def _repeated_words(self) -> np.ndarray:
        n = len(self.words)
        if n < 3:
            return np.zeros(len(self.at) - 1, np.int64)
        row = np.repeat(np.arange(len(self.word_at) - 1), np.diff(self.word_at))
        w = self.words
        key = mix64(w[:-2] * U64(3) + mix64(w[1:-1] * U64(5) + mix64(w[2:] + mix64(row[:-2].astype(U64)))))
        inside = np.flatnonzero(row[:-2] == row[2:])
        key = key[inside]
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(key), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        covered = np.zeros(n, bool)
        at = inside[twice]
        for k in range(3):
            covered[at + k] = True
        return np.bincount(row[covered], minlength=len(self.at) - 1).astype(np.int64)

    def features(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each kind: table slots, and row offsets into them."""
        shift = U64(64 - BITS)
        words = self.words >> shift
        w = self.words
        same = np.zeros(max(0, len(w) - 1), bool)
        row = np.repeat(np.arange(len(self.word_at) - 1), np.diff(self.word_at))
        same = row[:-1] == row[1:]
        pairs = (mix64(w[:-1] * U64(3) + w[1:]) >> shift)[same]
        pair_at = np.concatenate([[0], np.cumsum(same)])[np.minimum(self.word_at, len(same))] if len(w) else np.zeros(len(self.at), np.int64)
        chars = np.flatnonzero(_STARTS_CHAR[self.raw])
        edges, char_at = np.append(chars, len(self.raw)), np.searchsorted(chars, self.at)
        lengths = np.maximum(0, np.diff(char_at) - (GRAM - 1))  # grams that run into the next row belong to none
        first = np.repeat(char_at[:-1] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        grams = mix64(self.roller.slices(edges[first], edges[first + GRAM])) >> shift
        gram_at = np.concatenate([[0], np.cumsum(lengths)])
        return [(words.astype(np.int64), self.word_at), (pairs.astype(np.int64), pair_at), (grams.astype(np.int64), gram_at)]


def logits(texts: Texts, weights: np.ndarray, bias: float) -> np.ndarray:
    out = np.full(len(texts.at) - 1, bias)
    for scale, (slots, at) in zip(SCALES, texts.features(), strict=True):
        out += scale * _sums(weights[slots].astype(np.float64), at) / np.maximum(1, np.diff(at))
    return out


class Model:
    def __init__(self, weights: np.ndarray, bias: float, slope: float, offset: float):
        self.weights, self.bias, self.slope, self.offset = weights, bias, slope, offset

    def probability(self, texts: Texts) -> np.ndarray:
        z = self.slope * logits(texts, self.weights, self.bias) + self.offset
        return np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 6)


def _adam(gradient, width: int, steps: int, rate: float) -> np.ndarray:
    x, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for t in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``train_rows`` labelled rows, the first by hash of their ids, with their whole texts.

    Labels with a null id or null quality are passed over; of several labels the smallest counts. Without
    labels of both kinds the model keeps what the base rules keep.
    """
    own = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    own = own.groupBy(F.col("doc_id").cast("long").alias("lid")).agg(F.min("quality").cast("int").alias("quality"))
    chosen = F.broadcast(own.orderBy(F.xxhash64("lid"), "lid").limit(train_rows))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("lid"), F.col(f"`{text_col}`").cast("string").alias("text")).join(chosen, "lid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            t = Texts(*utf8(batch.column(0)))
            rows, slots, values = [], [], []
            for scale, (s, at) in zip(SCALES, t.features(), strict=True):
                n = np.diff(at)
                key, count = np.unique(np.repeat(np.arange(len(n)), n) << BITS | s, return_counts=True)
                row = key >> BITS
                rows.append(row)
                slots.append(key & ((1 << BITS) - 1))
                values.append(scale * count / n[row])
            row = np.concatenate(rows)
            order = np.argsort(row, kind="stable")
            at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x)) for x in (np.concatenate(slots)[order].astype(np.int32), np.concatenate(values)[order].astype(np.float32))]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *lists], names=["lid", "quality", "slots", "vals"])

    rows = texts.select("text", "lid", "quality").mapInArrow(run, "lid long, quality int, slots array<int>, vals array<float>").toArrow()
    y = rows["quality"].to_numpy().astype(np.float64) if rows.num_rows else np.zeros(0)
    if not len(y) or not y.any() or y.all():
        return Model(np.zeros(1 << BITS, np.float32), 1.0, 1.0, 0.0)
    lists = rows["slots"].combine_chunks()
    sizes = lists.value_lengths().to_numpy()
    slot, value = lists.flatten().to_numpy(), rows["vals"].combine_chunks().flatten().to_numpy()
    doc = np.repeat(np.arange(len(y)), sizes).astype(np.int32)
    fold = rows["lid"].to_numpy() % 3 == 0
    if not y[~fold].any() or y[~fold].all():
        fold[:] = False
    mask = ~fold[doc]
    d, s, v = doc[mask], slot[mask], value[mask]
    n = float((~fold).sum())
    weight = np.where(y == 1, 0.5 * n / max(1, y[~fold].sum()), 0.5 * n / max(1, (1 - y[~fold]).sum())) * ~fold

    def gradient(x: np.ndarray) -> np.ndarray:
        z = x[-1] + np.bincount(d, weights=x[s] * v, minlength=len(y))
        err = (_sigmoid(z) - y) * weight / n
        g = np.bincount(s, weights=err[d] * v, minlength=1 << BITS)
        return np.append(g + 1e-5 * x[:-1], err.sum())

    x = _adam(gradient, (1 << BITS) + 1, 60, 0.05)
    z = x[-1] + np.bincount(doc, weights=x[slot] * value, minlength=len(y))
    held = fold if fold.any() and y[fold].any() and not y[fold].all() else np.ones(len(y), bool)
    zc, yc = z[held], (y[held] * held[held].sum() + 1) / (held[held].sum() + 2)
    platt = _adam(lambda p: np.array([((_sigmoid(p[0] * zc + p[1]) - yc) * zc).mean(), (_sigmoid(p[0] * zc + p[1]) - yc).mean()]), 2, 400, 0.05)
    return Model(x[:-1].astype(np.float32), float(x[-1]), float(platt[0]), float(platt[1]))


COLUMNS = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality double, kept boolean"


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """Base counts, probability of good quality, and the verdict for every row, from its whole text.

    base_failed: under 50 words, or over half of the words in repeated 3-word windows; such rows are not
    kept. Null texts read as empty; repeated rows and null ids come back as they are; other columns are not
    looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            t = Texts(*utf8(batch.column(1)))
            base = t.base()
            failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEATED_PERCENT * base["n_words"])
            p = model.probability(t)
            arrays = [batch.column(0), *(pa.array(base[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(failed), pa.array(p), pa.array(~failed & (p >= keep_at))]
            yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in COLUMNS.split(", ")])

    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return source.mapInArrow(run, COLUMNS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).withColumnRenamed("id", "doc_id")
