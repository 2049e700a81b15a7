"""SentencePiece encoding and decoding by batched Viterbi.

Distinct words (runs that no piece crosses) of equal length advance together, one character a step: the
hashes of all substrings that end there probe the sorted hashes of the pieces, and the vectorised maximum
over their values is stored as back pointer. The value of a unigram model is the sum of scores. In a BPE
model a prefix of a word has one valid encoding, so its value is validity: a piece may end a prefix if
merging would neither join nor regroup it with the piece before. These are the ids that merging by rank gives.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.arrowtext import U64, mix64, released, sliced

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Piece types and model types of the file format.
NORMAL, UNKNOWN, BYTE, USER = 1, 2, 6, 4
UNIGRAM, BPE = 1, 2
BASE = 0x9E3779B97F4A7C15
#: Characters from which a word is encoded in blocks of this size and overlap.
LONG, BLOCK, OVERLAP = 4096, 1024, 128
#: What an unknown character costs a unigram model below its worst piece.
UNKNOWN_PENALTY = 10.0


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at : at + size]
            at += size


class Vocabulary:
    """Arrays of a model file, small enough to travel with a task's closure."""

    def __init__(self, model: bytes):
        pieces: list[str] = []
        scores: list[float] = []
        kinds: list[int] = []
        self.kind, prefix, squeeze, escape, rule = UNIGRAM, 1, 1, 1, b""
        for field, value in _fields(model):
            if field == 1:
                part = dict(_fields(value))
                pieces.append(part[1].decode())
                scores.append(struct.unpack("<f", part[2])[0] if 2 in part else 0.0)
                kinds.append(part.get(3, NORMAL))
            elif field == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                spec = dict(_fields(value))
                prefix, squeeze, escape, rule = spec.get(3, 1), spec.get(4, 1), spec.get(5, 1), spec.get(2, b"")
        if rule or squeeze or not escape or self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models without text normalisation are supported")
        self.prefix, self.pieces = bool(prefix), pieces
        self.unknown = kinds.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): k for k, p in enumerate(pieces) if kinds[k] == BYTE}
        self.out = [bytes([int(p[3:5], 16)]) if kinds[k] == BYTE else p.replace(SPACE, " ").encode() if kinds[k] in (NORMAL, USER) else b"" if kinds[k] != UNKNOWN else " ⁇ ".encode() for k, p in enumerate(pieces)]
        own = [k for k in range(len(pieces)) if kinds[k] in (NORMAL, USER)]
        index = {pieces[k]: k for k in own}
        self.longest = max(map(len, index))
        if any(SPACE in p.lstrip(SPACE) for p in index):
            raise ValueError("a piece crosses words")
        inner = set("".join(p for p in index if len(p) > 1))
        #: neighbours inside some piece; between any others no piece can lie, so words are cut there
        self.inside = {p[i : i + 2] for p in index for i in range(len(p) - 1)}
        #: characters that no longer piece holds end a word as well, which keeps words few and short
        self.apart = "".join(c for c in "\n\t\r" if c not in inner)
        n = len(pieces)
        self.score = np.array([*scores, min(scores[k] for k in own) - UNKNOWN_PENALTY])
        self.hash = np.zeros(n + 1, U64)
        self.size = np.ones(n + 1, np.int64)
        for k in own:
            self.hash[k] = _whole(pieces[k])
            self.size[k] = len(pieces[k])
        order = sorted(own, key=lambda k: int(self.hash[k]))
        self.keys, self.ids = self.hash[order], np.array(order)
        #: whether any key has these leading bits: most substrings are no piece, and end here
        self.leads = np.zeros(1 << 20, bool)
        self.leads[(self.keys >> U64(44)).astype(np.int64)] = True
        self.rank, self.left, self.right = np.full(n + 1, -1), np.arange(n + 1), np.arange(n + 1)
        self.usable = np.ones(n + 1, bool)
        if self.kind == BPE:
            for rank, k in enumerate(sorted(own, key=lambda k: -scores[k])):
                if len(pieces[k]) > 1:
                    self.rank[k] = rank
            for k in own:
                if len(pieces[k]) > 1:
                    halves = self._last_merge(pieces[k], index)
                    if halves is None:
                        self.usable[k] = False
                    else:
                        self.left[k], self.right[k] = halves

    def _last_merge(self, piece: str, index: dict[str, int]) -> tuple[int, int] | None:
        """The two pieces that a piece's own merging joins last; None if it never becomes one piece."""
        parts, last = list(piece), None
        while len(parts) > 1:
            ranks = [(self.rank[index[a + b]], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in index]
            if not ranks:
                return None
            _, i = min(ranks)
            last = parts[i], parts[i + 1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return index.get(last[0], len(self.pieces)), index.get(last[1], len(self.pieces))


def _whole(text: str) -> np.uint64:
    h = 0
    for c in text:
        h = (h * BASE + int(mix64(np.array([ord(c)], U64))[0])) & (1 << 64) - 1
    return U64(h)


class Encoder:
    def __init__(self, vocabulary: Vocabulary, most: int = 50_000_000):
        #: bytes that the words known may take, roughly
        self.v, self.most, self.used = vocabulary, most, 0
        self.power = np.cumprod(np.concatenate([[U64(1)], np.full(vocabulary.longest * 2 + 2, U64(BASE))]), dtype=U64)
        #: words and parts of words by number; those of number k have the ids from ends[k] to ends[k + 1]
        self.known: dict[str, int] = {}
        self.parts: dict[str, int] = {}
        self.ids, self.ends = array("i"), array("i", [0])
        #: the latest verdicts on pairs of pieces, each in the slot of its hash
        self.fits = np.full(1 << 21, -1, np.int64), np.zeros(1 << 21, bool)
        end = re.escape(vocabulary.apart)
        self.split = re.compile(f"{SPACE}+[^{SPACE}{end}]*|[^{SPACE}{end}]+" + (f"|[{end}]" if end else "")).findall
        self.unk = len(vocabulary.pieces)

    def _probe(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, or -1."""
        at = np.minimum(np.searchsorted(self.v.keys, hashes), len(self.v.keys) - 1)
        return np.where(self.v.keys[at] == hashes, self.v.ids[at], -1)

    def _side_by_side(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether BPE leaves each pair of pieces as it is, by undoing its merges from the last."""
        key = one * (self.unk + 1) + two
        keys, fits = self.fits
        slot = (mix64(key.astype(U64)) & U64(len(keys) - 1)).astype(np.int64)
        out = fits[slot]
        new = np.flatnonzero(keys[slot] != key)
        if len(new):
            unique, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            own = self._undo(unique // (self.unk + 1), unique % (self.unk + 1))
            out[new] = own[back]
            keys[slot[new[first]]], fits[slot[new[first]]] = unique, own
        return out

    def _undo(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        v = self.v
        ok = np.ones(len(one), bool)
        limit = np.full(len(one), np.iinfo(np.int64).max)
        live = np.flatnonzero((one != self.unk) & (two != self.unk))
        one, two = one.copy(), two.copy()
        while len(live):
            a, b = one[live], two[live]
            joined = self._probe(v.hash[a] * self.power[np.minimum(v.size[b], len(self.power) - 1)] + v.hash[b])
            joined[(a == self.unk) | (b == self.unk)] = -1
            clash = (joined >= 0) & (v.rank[joined] < limit[live])
            ok[live[clash]] = False
            done = clash | ((v.rank[a] < 0) & (v.rank[b] < 0))
            live, a, b = live[~done], a[~done], b[~done]
            first = v.rank[a] > v.rank[b]
            limit[live] = np.where(first, v.rank[a], v.rank[b] + 1)
            one[live] = np.where(first, v.right[a], a)
            two[live] = np.where(first, b, v.left[b])
        return ok

    def _equal(self, words: list[str], length: int) -> None:
        """Encode words of one length together."""
        v, unk = self.v, self.unk
        for word, step, end in zip(words, *self._steps(words, length), strict=True):
            ids: list[int] = []
            j = length
            while j:
                piece = end[j]
                if piece == unk:
                    raw = word[j - 1].encode("utf-8", "surrogatepass")
                    ids.extend(v.bytes[x] for x in reversed(raw)) if v.bytes else ids.append(v.unknown)
                else:
                    ids.append(piece)
                j -= step[j]
            self.parts[word] = self._keep(ids[::-1])

    def _keep(self, ids: Iterable[int]) -> int:
        self.ids.extend(ids)
        self.ends.append(len(self.ids))
        return len(self.ends) - 2

    def _spelled(self, word: str, path: list[tuple[int, int]]) -> array:
        """Ids of a path: pieces as they are, unknown characters as their bytes."""
        v = self.v
        ids: list[int] = []
        for end, piece in path:
            if piece != self.unk:
                ids.append(piece)
            elif v.bytes:
                ids.extend(v.bytes[x] for x in word[end - 1].encode("utf-8", "surrogatepass"))
            else:
                ids.append(v.unknown)
        return array("i", ids)

    def _long(self, word: str) -> array:
        """A long word in blocks that overlap, all advanced together, and put together where two blocks share a piece's end.

        BPE has one encoding whose neighbouring pieces all stand side by side, so what is put together that way
        is that encoding. Without such an end the word is encoded as one.
        """
        starts = list(range(0, len(word) - OVERLAP, BLOCK - OVERLAP))
        blocks = [word[a : a + BLOCK] for a in starts]
        paths = self._paths(blocks[:-1], BLOCK) + self._paths(blocks[-1:], len(blocks[-1]))
        whole = paths[0]
        for start, path in zip(starts[1:], paths[1:], strict=True):
            later = {start + end: k for k, (end, _) in enumerate(path[:-1])}
            # what lies deep in the overlap is the likeliest to be settled in both blocks
            meet = [k for k, (end, _) in enumerate(whole) if end in later]
            for k in sorted(meet, key=lambda k: abs(whole[k][0] - start - OVERLAP // 2)):
                at = later[whole[k][0]]
                if self._side_by_side(np.array([whole[k][1]]), np.array([path[at + 1][1]]))[0]:
                    whole = whole[: k + 1] + [(start + end, piece) for end, piece in path[at + 1 :]]
                    break
            else:
                return self._spelled(word, self._paths([word], len(word))[0])
        return self._spelled(word, whole)

    def _paths(self, words: list[str], length: int) -> list[list[tuple[int, int]]]:
        """``(end, piece)`` of the best paths through words of one length."""
        paths = []
        for step, end in zip(*self._steps(words, length), strict=True):
            path, j = [], length
            while j:
                path.append((j, end[j]))
                j -= step[j]
            paths.append(path[::-1])
        return paths

    def _steps(self, words: list[str], length: int) -> tuple[list[list[int]], list[list[int]]]:
        """For words of one length, by place: how far back the best last piece begins, and that piece."""
        if not words:
            return [], []
        v, n = self.v, len(words)
        chars = np.array(words, f"<U{length}").view(np.uint32).reshape(n, length)
        codes = mix64(chars.astype(U64))
        last = np.full((length + 1, n), self.unk, np.int64)
        taken = np.zeros((length + 1, n), np.int64)
        best = np.zeros((length + 1, n))
        # running hashes of the substrings that start at each of the latest positions
        running: list[np.ndarray] = []
        for j in range(1, length + 1):
            c = codes[:, j - 1]
            running = [h * U64(BASE) + c for h in running[-(v.longest - 1) :]] + [c.copy()]
            value = np.full(n, -np.inf)
            rows = np.arange(n)
            for back in range(len(running), 0, -1):
                if v.kind == BPE:  # a prefix has one valid last piece
                    rows = rows[value[rows] < 0]
                    if not len(rows):
                        break
                h = running[-back][rows]
                may = v.leads[(h >> U64(44)).astype(np.int64)]
                at, h = rows[may], h[may]
                if len(at):
                    piece = self._probe(h)
                    real = (piece >= 0) & v.usable[piece]
                    self._take(at[real], piece[real], j, back, value, best, last, taken)
                if back == 1:
                    single = rows[(value[rows] < 0) & ~np.isfinite(value[rows])]
                    if len(single):
                        self._take(single, np.full(len(single), self.unk), j, 1, value, best, last, taken)
            best[j] = value
        return taken.T.tolist(), last.T.tolist()

    def _take(self, rows, piece, j, back, value, best, last, taken) -> None:
        before = best[j - back, rows]
        if self.v.kind == BPE:
            fits = np.ones(len(rows), bool) if j == back else self._side_by_side(last[j - back, rows], piece)
            worth = np.where(fits & np.isfinite(before), 0.0, -np.inf)
        else:
            worth = before + self.v.score[piece]
        better = worth > value[rows]
        at = rows[better]
        value[at], last[j, at], taken[j, at] = worth[better], piece[better], back

    def learn(self, words: Iterable[str]) -> None:
        inside, parts = self.v.inside, self.parts
        new = [w for w in words if w not in self.known]
        self.used += 8 * sum(map(len, new)) + 250 * len(new)
        cuts = []
        by_length: dict[int, set[str]] = {}
        for w in new:
            own, a = [], 0
            for i in range(1, len(w)):
                if w[i - 1 : i + 1] not in inside:
                    own.append(w[a:i])
                    a = i
            own.append(w[a:])
            cuts.append(own)
            for part in own:
                if part not in parts:
                    by_length.setdefault(len(part), set()).add(part)
        for length, found in by_length.items():
            if length > LONG and self.v.kind == BPE:
                for word in found:
                    parts[word] = self._keep(self._long(word))
                continue
            same, step = sorted(found), max(1, 200_000 // length)
            for k in range(0, len(same), step):
                self._equal(same[k : k + step], length)
        for w, own in zip(new, cuts, strict=True):
            if len(own) == 1:
                self.known[w] = parts[w]
            else:
                whole = array("i")
                for k in map(parts.__getitem__, own):
                    whole.extend(self.ids[self.ends[k] : self.ends[k + 1]])
                self.known[w] = self._keep(whole)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and row offsets into them; null reads as empty."""
        if self.used > self.most:
            self.known.clear()
            self.parts.clear()
            self.ids, self.ends = array("i"), array("i", [0])
            self.used = 0
        lead = SPACE if self.v.prefix else ""
        # each word is held once, however often texts have it
        number: defaultdict[str, int] = defaultdict(count().__next__)
        numbers, ends = array("i"), [0]
        for t in texts:
            if t:
                numbers.extend(map(number.__getitem__, self.split((lead + t).replace(" ", SPACE))))
            ends.append(len(numbers))
        self.learn(number)
        own = np.fromiter(map(self.known.__getitem__, number), np.int32, len(number))[np.frombuffer(numbers, np.int32)] if numbers else np.zeros(0, np.int32)
        known, begin = np.array(self.ids, np.int32), np.array(self.ends, np.int32)
        size = np.diff(begin)[own]
        at = np.zeros(len(own) + 1, np.int32)
        np.cumsum(size, out=at[1:])
        place = np.repeat(begin[own] - at[:-1], size)
        place += np.arange(at[-1], dtype=np.int32)
        return known[place], at[ends].astype(np.int64)


def decode(vocabulary: Vocabulary, ids) -> str:
    """The text of ids; byte pieces that are no UTF-8 give U+FFFD."""
    text = b"".join(map(vocabulary.out.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if vocabulary.prefix and text.startswith(" ") else text


def load(path: str = MODEL) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary(f.read())


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, token_ids, decoded, round_trip)`` of every row's whole text.

    round_trip: decoding gives the text back (a text's own U+2581 decodes to a space, and counts as
    equal). Null texts read as empty, with no ids; repeated rows and null ids come back as they are; other
    columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in sliced(batches, "text", 4 << 20):
            texts = batch.column(1).to_pylist()
            ids, at = encoder.encode(texts)
            decoded = [decode(vocabulary, ids[a:b].tolist()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            same = [d == (t or "").replace(SPACE, " ") for d, t in zip(decoded, texts, strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), lists, pa.array(decoded), pa.array(same)], names=["id", "n_tokens", "token_ids", "decoded", "round_trip"])

    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return source.mapInArrow(lambda batches: released(run(batches)), "id long, n_tokens long, token_ids array<int>, decoded string, round_trip boolean")


def query(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    coded = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), load(model))
    return coded.select(F.col("id").alias("doc_id"), "n_tokens", "token_ids", "round_trip")
