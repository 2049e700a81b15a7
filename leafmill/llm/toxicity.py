"""Toxicity by a noisy channel: restore disguised words, then score the restored text.

A disguised token (letters mixed with look-alike digits and signs, stretched or doubled letters) is a
lattice: each character may stand for some letters or for nothing, at a cost. So is a run of fragments
between white space or punctuation, whose separators stand for a word's edge or for nothing. Viterbi
picks the best path under a character bigram model counted over the whole corpus. Equal-length tokens are
decoded together. The text's words, restored and as written, are then scored by a logistic model over
words and their 4- to 6-character substrings that are toxic in the labelled rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from leafmill.llm.arrowtext import U64, mix64, released, sliced, utf8
from leafmill.storage import stored

#: Characters and the letters that they may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Classes: 0 a word's edge, 1-26 the letters, 27 any other letter.
CLASSES = 28
#: Labelled rows that the model is fitted on, at most.
TRAIN_ROWS = 12_000
#: Substrings that the model keeps at most: those in most toxic rows, weighted by how toxic their rows are.
FEATURES = 4_000
#: Words whose substrings are hashed at once, and rows whose substrings are counted at once, while fitting.
WORD_BLOCK, ROW_BLOCK = 20_000, 100
THRESHOLD = 0.7
FEATURE_BITS = 22
_TRIM = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "“”’‘«»…"
_EDGE = "".join(c for c in _TRIM if c not in "@$!|+(")
_DOUBLED = re.compile(r"(.)\1")
_RUN = re.compile(r"([^\W\d_])\1{3,}")
#: Bytes of text whose new words are decoded together.
BATCH_BYTES = 2 << 20
#: Characters of a token that are decoded together.
PART = 64
_LIKE = "".join(re.escape(c) for c in LOOKALIKES)
_MIXED = re.compile(rf"(?=.*[^\W\d_])(?=.*[{_LIKE}])")
#: Two neighbouring fragments of three characters at most.
_BROKEN = re.compile(r"(?:^|[\W_])[^\W_]{1,3}[\W_]+[^\W_]{1,3}(?:[\W_]|$)")
#: what every disguise has
_ODD = re.compile(rf"(.)\1|[{_LIKE}]|[\W_]")
#: A word of three letters at most is no fragment if it is at least this share of the corpus's words.
COMMON_SHARE = 1e-5

_CLASS_OF_BYTE = np.zeros(256, np.uint8)
_CLASS_OF_BYTE[97:123] = np.arange(1, 27)
_CLASS_OF_BYTE[65:91] = np.arange(1, 27)
_CLASS_OF_BYTE[0xC3:0xF5] = 27
#: what a class is spelled as; any other letter as it is
_SPELLED = np.array([ord(" "), *map(ord, LETTERS), 0], np.uint32)
_GO_ON = np.zeros(256, bool)
_GO_ON[0x80:0xC0] = True


def count_characters(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, frozenset[str]]:
    """Character class bigrams of all texts (28 x 28), and the common words of two and three letters; tables of fixed size, whatever the corpus."""
    pairs, codes = CLASSES * CLASSES, 27**3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(pairs + codes + 1, np.int64)
        for batch in sliced(batches, "text"):
            raw, _ = utf8(batch.column(0))
            c = _CLASS_OF_BYTE[raw[~_GO_ON[raw]]].astype(np.int32)
            if len(c) > 1:
                total[:pairs] += np.bincount(c[:-1] * CLASSES + c[1:], minlength=pairs)
                edge = np.concatenate([[0], np.flatnonzero(c == 0) + 1])
                end = np.append(edge[1:] - 1, len(c))
                size = end - edge
                total[-1] += np.count_nonzero(size)
                for n in (2, 3):
                    letters = c[edge[size == n][:, None] + np.arange(n)]
                    letters = letters[(letters <= 26).all(1)]
                    total[pairs:-1] += np.bincount(letters @ (27 ** np.arange(n)), minlength=codes)
        kept = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(total[kept])], names=["pair", "n"])

    source = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = source.mapInArrow(lambda batches: released(run(batches)), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(pairs + codes + 1)
    for pair, n in rows:
        out[pair] = n
    common = np.flatnonzero(out[pairs:-1] >= max(1.0, COMMON_SHARE * out[-1]))
    spelled = frozenset("".join(LETTERS[code // 27**k % 27 - 1] for k in range(3) if code // 27**k) for code in common.tolist())
    return out[:pairs].reshape(CLASSES, CLASSES), spelled


class Restorer:
    """Batched Viterbi over character lattices."""

    def __init__(self, bigrams: np.ndarray, common: frozenset[str] | None = None):
        #: common short words; without them only single characters are fragments
        self.common = common
        smooth = bigrams + 1.0
        self.step = np.log(smooth / smooth.sum(1, keepdims=True))
        self.costs: dict[str, tuple[np.ndarray, float]] = {}

    def cost(self, char: str) -> tuple[np.ndarray, float]:
        """Log costs of each letter class for a character, and of its standing for nothing."""
        if char not in self.costs:
            emit, drop = np.full(CLASSES, -np.inf), -np.inf
            if char in LETTERS:
                emit[LETTERS.index(char) + 1] = 0.0
            elif char.isalpha():
                emit[27] = 0.0
            elif char in LOOKALIKES:
                for letter in LOOKALIKES[char]:
                    emit[LETTERS.index(letter) + 1] = -0.5
                drop = -8.0
            elif char == "*":
                emit[1:27], drop = -3.0, -0.5
            else:
                drop = -0.5
                if not char.isalnum():
                    emit[0] = -0.5
            self.costs[char] = emit, drop
        return self.costs[char]

    def restore(self, tokens: list[str]) -> list[str]:
        out = [""] * len(tokens)
        by_length = defaultdict(list)
        for k, token in enumerate(tokens):
            by_length[len(token)].append(k)
        for length, ks in by_length.items():
            for part in range(0, len(ks), 2000):
                self._equal([tokens[k] for k in ks[part : part + 2000]], length, ks[part : part + 2000], out)
        return out

    def _equal(self, tokens: list[str], length: int, ks: list[int], out: list[str]) -> None:
        if not length:
            return
        n = len(tokens)
        rows = np.arange(n)
        grid = np.array(tokens, f"<U{length}").view(np.uint32).reshape(n, length)
        chars, code = np.unique(grid, return_inverse=True)
        code = code.reshape(n, length)
        costs = [self.cost(chr(c)) for c in chars.tolist()]
        emit, drop = np.array([e for e, _ in costs]), np.array([d for _, d in costs])
        letter = np.array([chr(c).isalpha() for c in chars.tolist()])
        # a character's classes first: all tokens take their first class together, then those with a second, and so on
        classes = np.argsort(emit == -np.inf, axis=1, kind="stable")
        count = (emit > -np.inf).sum(1)
        into = np.ascontiguousarray(self.step.T)
        score = np.full((n, CLASSES), -np.inf)
        score[:, 0] = 0.0
        back = np.full((length, n, CLASSES), -1, np.int8)  # the state before; -1: the character stands for nothing
        for i in range(length):
            c = code[:, i]
            own = drop[c]
            if i:
                own[letter[c] & (c == code[:, i - 1])] = -1.0
            dropped = score + own[:, None]
            after = dropped.copy()
            for k in range(count[c].max()):
                at = np.flatnonzero(count[c] > k)
                state = classes[c[at], k]
                reach = score[at] + into[state]
                best = reach.argmax(1)
                emitted = reach[rows[: len(at)], best] + emit[c[at], state]
                better = emitted >= dropped[at, state]
                at, state = at[better], state[better]
                after[at, state], back[i, at, state] = emitted[better], best[better]
            score = after
        state = (score + self.step[:, 0]).argmax(1)
        spelled = np.zeros((n, length), np.uint32)
        for i in range(length - 1, -1, -1):
            before = back[i, rows, state]
            read = before >= 0
            spelled[:, i] = np.where(read, np.where(state == 27, grid[:, i], _SPELLED[state]), 0)
            state = np.where(read, before, state)
        stuck = ~np.isfinite(score.max(1))
        for k, token, restored, as_is in zip(ks, tokens, spelled.view(f"<U{length}").ravel().tolist(), stuck.tolist(), strict=True):
            out[k] = token if as_is else restored.replace("\0", "")


def disguised(token: str) -> bool:
    return bool(_DOUBLED.search(token) or _MIXED.search(token) or _BROKEN.search(token))


def parts(token: str) -> list[str]:
    """What the lattice reads of a token of any length: letter runs cut to three, and windows of ``PART`` that
    overlap by half, so that every disguise of up to ``PART // 2`` characters lies whole in one."""
    token = _RUN.sub(r"\1\1\1", token)
    return [token[k : k + PART] for k in range(0, max(1, len(token) - PART // 2), PART // 2)]


def _fragment(word: str, common: frozenset[str] | None) -> bool:
    """A single character, or two or three letters that are no common word."""
    core = word.strip(_EDGE)
    return len(core) == 1 or common is not None and 2 <= len(core) <= 3 and core not in common and (core.isascii() and core.isalpha() or bool(_MIXED.search(core)))


#: Runs of single characters, and of short words of which some are fragments.
_SINGLES, _SHORTS = re.compile("s{3,}"), re.compile("[sof]{2,}")


class Runs:
    """A text's distinct words, lower-cased, and its runs of fragments, joined by single spaces.

    A run: three single characters or more; or words of up to four characters, of which one at least is a
    fragment of two or three. Two of a run's characters at least are letters. A word's kind is looked up, and runs are found in the
    string of a text's kinds: s a single character, f a fragment, o another short word.
    """

    def __init__(self, common: frozenset[str] | None = None, most: int = 200_000):
        self.common, self.most = common, most
        self.kinds: dict[str, str] = {}

    def kind(self, word: str) -> str:
        core = word.strip(_EDGE) if len(word) <= 8 else ""
        if len(core) == 1:
            return "s"
        if 2 <= len(core) <= 4:
            return "f" if _fragment(word, self.common) else "o"
        return "-"

    def __call__(self, text: str) -> set[str]:
        every = text.lower().split()
        words = set(every)
        kinds = self.kinds
        if len(kinds) > self.most:
            kinds.clear()
        for w in words.difference(kinds):
            kinds[w] = self.kind(w)
        spelled = "".join(map(kinds.__getitem__, every))
        for run in _SINGLES.finditer(spelled):
            own = [w.strip(_EDGE) for w in every[run.start() : run.end()]]
            if sum(c.isalpha() for c in own) >= 2:
                words.add(" ".join(own))
        for run in _SHORTS.finditer(spelled):
            if "f" in run[0]:
                words.add(" ".join([w.strip(_EDGE) for w in every[run.start() : run.end()]]))
        return words


def raw_words(text: str, common: frozenset[str] | None = None) -> set[str]:
    return Runs(common)(text)


class Words:
    """Forms of each word (as written, trimmed, restored), kept between batches up to a bound."""

    def __init__(self, restorer: Restorer, most: int = 90_000_000):
        #: bytes that the words known may take, roughly
        self.restorer, self.most, self.size = restorer, most, 0
        self.known: dict[str, tuple[str, ...]] = {}

    def clear(self) -> None:
        self.known.clear()
        self.size = 0

    def learn(self, words: set[str]) -> None:
        if self.size > self.most:
            self.clear()
        new = [w for w in words if w not in self.known]
        self.size += sum(map(len, new)) * 2 + 250 * len(new)
        odd: list[tuple[str, str]] = []
        for w in new:
            if w.isalpha() and not _DOUBLED.search(w):
                self.known[w] = (w,)
                continue
            if " " in w:
                self.known[w] = (w.replace(" ", ""),)
                odd += [(w, part) for part in parts(w)]
                continue
            plain = w.strip(_TRIM)
            self.known[w] = (plain,) if plain else ()
            core = w.strip(_EDGE)
            if core and _ODD.search(core) and disguised(core):
                odd += [(w, part) for part in parts(core)]
        if odd:
            # words differ more than their cores do, and each is decoded once
            each = list({c: None for _, c in odd})
            restored = dict(zip(each, self.restorer.restore(each), strict=True))
            for w, c in odd:
                for form in restored[c].split():
                    if form not in self.known[w]:
                        self.known[w] += (form,)


def substrings(word: str) -> set[str]:
    """The word itself, and its substrings of four to six characters."""
    out = {f"={word}"}
    for n in (4, 5, 6):
        out.update(word[i : i + n] for i in range(len(word) - n + 1))
    return out


def _training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    """A bounded sample of labelled rows that are not held out, by hash order of their ids."""
    own = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.groupBy(F.col("doc_id").cast("long").alias("lid")).agg(F.max("toxic").alias("toxic"))
    chosen = F.broadcast(own.orderBy(F.xxhash64("lid"), "lid").limit(most))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("lid"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return texts.join(chosen, "lid")


def held_out(id_column):
    """crc32 of the id as text, modulo three, is one; a null id is not held out."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 3 == 1


class Model:
    """Weights of substrings; a document's logit is the bias plus those of its distinct substrings."""

    def __init__(self, bias: float, weights: dict[str, float], restorer: Restorer):
        self.bias, self.weights, self.restorer = bias, weights, restorer

    def _may_have(self) -> np.ndarray:
        """Hash buckets of the substrings that have a weight: most words have none, and are told by that."""
        table = np.zeros(1 << FEATURE_BITS, bool)
        whole, parts = [k[1:] for k in self.weights if k[0] == "="], [k for k in self.weights if k[0] != "="]
        for _, bucket, cut in _hashed_substrings(whole):
            table[bucket[cut == 0]] = True
        sizes = np.array([len(k) for k in parts], np.int64)
        for word, bucket, cut in _hashed_substrings(parts):
            table[bucket[cut == sizes[word] << 32]] = True
        return table

    def scorer(self):
        words, runs, weights = Words(self.restorer), Runs(self.restorer.common), self.weights
        #: what the words known have, where that is any
        hits: dict[str, tuple[str, ...]] = {}
        table = self._may_have()

        def score(texts: list[str]) -> list[float]:
            if words.size > words.most:
                words.clear()
                hits.clear()
            every = [runs(text) for text in texts]
            # the new words of all texts are decoded together
            new = set().union(*every).difference(words.known)
            if new:
                words.learn(new)
                forms = sorted({form for w in new for form in words.known[w]})
                maybe: set[int] = set()
                for word, bucket, _ in _hashed_substrings(forms):
                    maybe.update(word[table[bucket]].tolist())
                found = {forms[k]: own for k in maybe if (own := substrings(forms[k]) & weights.keys())}
                for w in new:
                    if not found.keys().isdisjoint(words.known[w]):
                        hits[w] = tuple({s for form in words.known[w] for s in found.get(form, ())})
            return [one(own) for own in every]

        def one(own: set[str]) -> float:
            found: set[str] = set()
            for w in own & hits.keys():
                found.update(hits[w])
            return round(1 / (1 + np.exp(-max(-30.0, min(30.0, self.bias + sum(weights[s] for s in sorted(found)))))), 6)

        return score


def fit(docs: DataFrame, labels: DataFrame, restorer: Restorer, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> Model:
    """Train on at most ``train_rows`` labelled rows (a documented bound); their whole texts count.

    Substrings are counted by Spark, by the leading bits of their hashes; the driver gets the ``FEATURES`` best
    ones, and which of them each row has.
    """

    def words_of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, runs = Words(restorer), Runs(restorer.common)
        for batch in sliced(batches, "text", BATCH_BYTES):
            every = [runs(text or "") for text in batch.column(0).to_pylist()]
            words.learn(set().union(*every))
            forms = [sorted({f for w in own for f in words.known[w]}) for own in every]
            yield pa.RecordBatch.from_arrays([pa.array(forms, pa.list_(pa.string())), batch.column(1)], names=["words", "toxic"])

    rows = _training_rows(docs, labels, id_col, text_col, train_rows).select("text", F.col("toxic").cast("int").alias("toxic"))
    rows = stored(rows.mapInArrow(lambda batches: released(words_of_rows(batches)), "words array<string>, toxic int"), "toxicity-words")
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic or toxic == n:
        prior = (toxic + 0.5) / (n + 1) if n else 0.05
        return Model(float(np.log(prior / (1 - prior))), {}, restorer)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, pos = np.zeros(1 << FEATURE_BITS, np.int32), np.zeros(1 << FEATURE_BITS, np.int32)
        for part in _row_blocks(batches):
            y = part.column(1).to_numpy().astype(np.int32)
            d, f = _row_buckets(part.column(0))
            np.add.at(df, f, 1)
            np.add.at(pos, f, y[d])
        at = np.flatnonzero(df)
        for k in range(0, len(at), 100_000):
            own = at[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(df[own].astype(np.int64)), pa.array(pos[own].astype(np.int64))], names=["bucket", "df", "pos"])

    base = toxic / n
    sums = rows.mapInArrow(lambda batches: released(counted(batches)), "bucket int, df long, pos long").groupBy("bucket").agg(F.sum("df").alias("df"), F.sum("pos").alias("pos"))
    lift = (F.col("pos") + base) / (F.col("df") + 1)
    good = sums.filter((F.col("pos") >= 4) & (lift >= max(0.5, min(0.9, 3 * base))))
    best = good.orderBy((F.col("pos") * lift * lift).desc(), "bucket").limit(FEATURES).select("bucket").collect()
    chosen = np.sort(np.array([r.bucket for r in best], np.int32))

    def had(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _row_blocks(batches):
            d, f = _row_buckets(part.column(0))
            at = np.minimum(np.searchsorted(chosen, f), max(0, len(chosen) - 1))
            hit = chosen[at] == f if len(chosen) else np.zeros(len(f), bool)
            ends = np.searchsorted(d[hit], np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(at[hit].astype(np.int32))), part.column(1)], names=["features", "toxic"])

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, str], float] = defaultdict(float)
        for part in _row_blocks(batches):
            lists = part.column(0)
            coded = lists.flatten().dictionary_encode()
            vocabulary, y = coded.dictionary.to_pylist(), part.column(1).to_numpy().astype(np.float64)
            weight = np.bincount(coded.indices.to_numpy(), weights=np.repeat(y, lists.value_lengths().to_numpy()), minlength=len(vocabulary))
            for word, bucket, cut in _hashed_substrings(vocabulary):
                for e in np.flatnonzero(np.isin(bucket, chosen) & (weight[word] > 0)):
                    w, k, i = vocabulary[word[e]], cut[e] >> 32, cut[e] & 0xFFFFFFFF
                    found[int(bucket[e]), w[i : i + k] if k else f"={w}"] += weight[word[e]]
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array([found[k] for k in keys], pa.float64())], names=["bucket", "spelled", "n"])

    table = rows.mapInArrow(lambda batches: released(had(batches)), "features array<int>, toxic int").toArrow()
    lists = table["features"].combine_chunks()
    y = table["toxic"].to_numpy().astype(np.float64)
    f = lists.flatten().to_numpy()
    bias, weight = _logistic(np.repeat(np.arange(len(y)), lists.value_lengths().to_numpy()), f, y, len(chosen))
    # of the substrings that share a bucket, the one in most toxic rows stands for it
    names = rows.mapInArrow(lambda batches: released(spelled(batches)), "bucket int, spelled string, n double").groupBy("bucket", "spelled").agg(F.sum("n").alias("n"))
    names = names.groupBy("bucket").agg(F.max(F.struct("n", "spelled"))["spelled"].alias("spelled")).collect()
    at = {int(b): k for k, b in enumerate(chosen)}
    return Model(bias, {r.spelled: float(weight[at[r.bucket]]) for r in names if weight[at[r.bucket]] > 1e-4}, restorer)


def _row_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROW_BLOCK):
            yield batch.slice(k, ROW_BLOCK)


def _row_buckets(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and substring buckets of word lists, each pair once, by row."""
    coded = lists.flatten().dictionary_encode()
    size = len(coded.dictionary)
    parts = [(word, bucket) for word, bucket, _ in _hashed_substrings(coded.dictionary.to_pylist())]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word, bucket = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    bucket = bucket[np.argsort(word, kind="stable")]
    lengths = np.bincount(word, minlength=size)
    first = np.cumsum(lengths) - lengths
    w, d = coded.indices.to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    n = lengths[w]
    f = bucket[np.repeat(first[w], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)].astype(np.int64)
    key = np.unique(np.repeat(d, n) << FEATURE_BITS | f)
    return key >> FEATURE_BITS, key & (1 << FEATURE_BITS) - 1


def _hashed_substrings(vocabulary: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Word, hash bucket, and place (length << 32 | start; 0 for the word itself) of every substring, by blocks of words of a length."""
    by_length = defaultdict(list)
    for k, w in enumerate(vocabulary):
        if w:
            by_length[len(w)].append(k)
    shift = U64(64 - FEATURE_BITS)
    for length, every in by_length.items():
        step = max(1, WORD_BLOCK * 8 // length)
        for ks in (every[k : k + step] for k in range(0, len(every), step)):
            own = np.array(ks, np.int32)
            chars = mix64(np.array([vocabulary[k] for k in ks], f"<U{length}").view(np.uint32).reshape(-1, length).astype(U64) + U64(1))
            whole = np.full(len(ks), U64(7))
            for i in range(length):
                whole = whole * U64(0x9E3779B97F4A7C15) + chars[:, i]
            yield own, (mix64(whole) >> shift).astype(np.int32), np.zeros(len(ks), np.int64)
            for n in (4, 5, 6):
                span = length - n + 1
                if span < 1:
                    continue
                h = np.full((len(ks), span), U64(n))
                for i in range(n):
                    h = h * U64(0x9E3779B97F4A7C15) + chars[:, i : i + span]
                yield np.repeat(own, span), (mix64(h) >> shift).astype(np.int32).ravel(), np.tile(np.int64(n) << 32 | np.arange(span, dtype=np.int64), len(ks))


def _logistic(d: np.ndarray, f: np.ndarray, y: np.ndarray, width: int, decay: float = 2e-4, steps: int = 150) -> tuple[float, np.ndarray]:
    """Non-negative logistic weights of binary features by Adam over all rows."""
    w, bias = np.zeros(width), -2.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(d, weights=w[f], minlength=len(y)), -30, 30)))
        err = (p - y) / len(y)
        g = np.append(np.bincount(f, weights=err[d], minlength=width) + decay * w / max(1, width), err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, bias = np.maximum(0.0, w - move[:-1]), bias - move[-1]
    return float(bias), w


def scored(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """Every row of docs as it is, with its score from its whole text; a null text scores as an empty one."""
    where = docs.columns.index(text_col)
    own = docs.select(*(F.col(f"`{c}`").cast("string").alias(c) if k == where else F.col(f"`{c}`") for k, c in enumerate(docs.columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in sliced(batches, where, BATCH_BYTES):
            scores = [float(x) for x in of([t or "" for t in batch.column(where).to_pylist()])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, name])

    schema = StructType([*own.schema.fields, StructField(name, DoubleType())])
    return own.mapInArrow(lambda batches: released(run(batches)), schema)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` of every row of docs."""
    return scored(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")), model).drop("text")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> Model:
    """The character model from all texts, the classifier from a bounded sample of labelled rows.

    Null texts read as empty; labels with a null id or null toxic are passed over; of a document's
    several labels the largest counts; with no labels of both kinds every text scores the prior
    (0.05 without any). Other columns are never looked at.
    """
    restorer = Restorer(*count_characters(docs, text_col))
    return fit(docs, labels, restorer, id_col, text_col, train_rows)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(
        F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
