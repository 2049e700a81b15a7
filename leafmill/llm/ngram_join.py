"""Jaccard join of word n-gram sets by adaptive multi-match prefixes.

All sets are ordered alike, rare shingles first. Of two sets that link, at least ``need(n)`` shingles of either one
are shared, so their first ``n - need(n) + k`` shingles share ``k`` or more. A document takes the depth ``k`` whose
prefix is estimated to cost least: each further token is one more row to shuffle and one more list to scan, but lets
only those pairs through that meet in ``k`` tokens. Two documents must meet in the smaller of their depths.

1. ``shingled`` writes the rows once, with the digest, size and parity bits of their set, and counts all shingles in a fixed
   number of counters, which give the order (any order is right; a good one is short).
2. ``candidates`` brings the prefixes together by token. Small lists give pairs, which are counted against the depths; the rows
   of larger ones are dealt once more. Either are kept only where the parity bits allow a link: sets differ in as many
   shingles at least as their bits differ in places, so no link is lost, while sets that merely share frequent shingles,
   of which there are more with every document, do not grow into groups. In lists of over ``WIDE`` sets a document meets one
   or two virtual nodes for its range of sizes instead, so these cost O(n).
3. Components of these edges are groups, whose distinct sets come together once (large groups in pairs of blocks), are
   verified exactly, and give a spanning forest and a number of links for each set, never the pairs themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from leafmill.llm.arrowtext import U64, released, sliced, utf8
from leafmill.llm.shingle_sets import shingle_sets
from leafmill.operators.graph import connected_components
from leafmill.storage import stored

#: Counters of shingles (a power of two) and how many of them make a row; 8 MB in all, whatever the input.
COUNTERS, COUNTED = 1 << 20, 1 << 12
#: Depths that a document may take, and what verifying a pair costs, in prefix rows.
DEEPEST, VERIFYING = 4, 8.0
#: A token's list up to this length gives pairs.
SMALL = 32
#: Lists up to this length are compared by the sets' parity bits; in longer ones (and in those of ``HEAVY`` tokens) virtual nodes are met.
WIDE = 4096
#: Least and most parity bits of a set (powers of two; over some 60 000 shingles they tell less, but nothing wrong).
FEWEST_BITS, MOST_BITS = 64, 1 << 16
#: Estimated documents of a token from which its list is spread over many tasks.
HEAVY = 50_000
#: Sets and shingles of a block; a group of several blocks is verified by pairs of blocks.
BLOCK_SETS, BLOCK_SHINGLES = 500, 2_000_000
#: Sets whose groups are broadcast to the scan that brings their texts (some 100 bytes each); beyond, the scan is sent their numbers as bits.
BROADCAST_ROWS = 400_000


def need(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that a set of n shares with any set it links with, at least."""
    return -(-percent * n // 100)


def size_class(n: np.ndarray, percent: int) -> np.ndarray:
    """Classes of sizes: sets that link are in one class or in neighbouring ones."""
    return np.floor(np.log(np.maximum(n, 1)) / (math.log(100 / percent) + 1e-6)).astype(np.int64)


def slack(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that two sets of a and b shingles may differ in, at most, if they link."""
    return a + b - 2 * -(-percent * (a + b) // (100 + percent))


def parity_bits(sets: np.ndarray, at: np.ndarray, percent: int) -> list[bytes]:
    """Of each set, the parity of the number of its shingles at each of a power of two of places, which grows with its size.

    Two sets' bits differ in no more places than the sets in shingles. Halves laid over each other (exclusive or) are the
    bits at half as many places.
    """
    n = np.diff(at)
    width = 1 << np.ceil(np.log2(np.clip(9 * (100 - percent) * n / (100 + percent), FEWEST_BITS, MOST_BITS))).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(width)])
    place = np.repeat(begin[:-1], n) + ((sets >> U64(24)).astype(np.int64) & np.repeat(width - 1, n))
    flat = np.packbits((np.bincount(place, minlength=int(begin[-1])) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [flat[a:b] for a, b in zip((begin[:-1] // 8).tolist(), (begin[1:] // 8).tolist(), strict=True)]


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Rows of 64-bit words of parity bits, at as many places as ``words`` hold."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def shingled(rows: DataFrame, text: Column, words: int, name: str, percent: int) -> DataFrame:
    """``(row, digest, node, n, parity, nth)``, written once: each row as a struct with its set's digest (128 bits), the digest's
    first half, its size, its parity bits, and a number that tells rows apart. Rows with a negative n hold counters instead (see ``counters``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        kind = None
        for batch in sliced(batches, 1):
            kind = batch.column(0).type
            sets, at = shingle_sets(*utf8(batch.column(1)), words)
            counts += np.bincount(_counter(sets), minlength=COUNTERS)
            digests = [xxhash.xxh3_128_digest(sets[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            nodes = np.frombuffer(b"".join(digests), np.int64)[::2]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(nodes), pa.array(np.diff(at).astype(np.int32)), pa.array(parity_bits(sets, at, percent), pa.binary())], names=["row", "digest", "node", "n", "parity"])
        if kind is not None:
            packed = [zstandard.compress(x.tobytes()) for x in counts.reshape(-1, COUNTED)]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(packed), kind), pa.array(packed, pa.binary()), pa.nulls(len(packed), pa.int64()), pa.array(-1 - np.arange(len(packed), dtype=np.int32)), pa.nulls(len(packed), pa.binary())], names=["row", "digest", "node", "n", "parity"])

    source = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), text.cast("string").alias("text"))
    schema = StructType([StructField("row", rows.schema), StructField("digest", BinaryType()), StructField("node", LongType()), StructField("n", IntegerType()), StructField("parity", BinaryType())])
    made = source.mapInArrow(lambda batches: released(run(batches)), schema)
    return stored(made.withColumn("nth", F.monotonically_increasing_id()), name)


def _counter(sets: np.ndarray) -> np.ndarray:
    return (sets & U64(COUNTERS - 1)).astype(np.int64)


def counters(table: DataFrame) -> np.ndarray:
    """How many rows have a shingle of each counter, over the whole table: summed in Spark, a fixed number of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[block] = sums.get(block, 0) + np.frombuffer(zstandard.decompress(packed), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["n", "digest"])

    out = np.zeros((COUNTERS // COUNTED, COUNTED), np.int64)
    for row in table.filter("n < 0").select("n", "digest").repartition("n").mapInArrow(run, "n int, digest binary").collect():
        out[-1 - row.n] = np.frombuffer(row.digest, np.int64)
    return out.reshape(-1)


def depths(costs: np.ndarray, base: int, deepest: int) -> int:
    """The depth that is estimated to cost least. costs: documents of each token in order; base: length of the prefix of depth one."""
    scanned = np.cumsum(costs)[base - 1 : base - 1 + deepest]
    k = np.arange(1, len(scanned) + 1)
    return int(np.argmin(scanned + VERIFYING * scanned / k**2)) + 1


def prefixes(table: DataFrame, text: Column, words: int, percent: int, counts: np.ndarray, heavy: int = HEAVY) -> DataFrame:
    """``(token, node, packed)``, sorted by these within tasks that hold a token's whole list: prefixes of all sets.

    packed: for sorting, the set's size in the upper bits, then its depth. The list of a token of over ``heavy`` documents is split
    by ``slot`` and marked by a slot that is not negative. A task gives the prefix of equal sets once; sets so small that one
    shingle more or less is too much have none, as they link with nothing but copies.
    """
    shared = table.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        mean = counts.mean()
        noise = mean + 4 * math.sqrt(mean)
        seen: set[int] = set()
        for batch in sliced(batches, 0):
            sets, at = shingle_sets(*utf8(batch.column(0)), words)
            often = counts[_counter(sets)]
            row = np.repeat(np.arange(batch.num_rows), np.diff(at))
            order = np.lexsort((sets, often, row))
            sets, often = sets[order], often[order]
            guess = np.maximum(often - noise, 1.0)
            tokens, nodes, packed, slots = [], [], [], []
            for k, node in enumerate(batch.column(1).to_pylist()):
                n = int(at[k + 1] - at[k])
                if 100 * n < percent * (n + 1) or node in seen:
                    continue
                seen.add(node)
                must = -(-percent * n // 100)
                base = n - must + 1
                own = slice(at[k], at[k] + base + min(DEEPEST, must) - 1)
                depth = depths(guess[own], base, min(DEEPEST, must))
                own = slice(at[k], at[k] + base + depth - 1)
                tokens.append(sets[own])
                nodes.append(np.full(own.stop - own.start, node, np.int64))
                packed.append(np.full(own.stop - own.start, n << 8 | depth, np.int64))
                slots.append(np.where(guess[own] > heavy, node & 1023, -1))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (tokens, nodes, packed)] + [pa.array(np.concatenate(slots).astype(np.int16))], names=["token", "node", "packed", "slot"])

    source = table.filter("n > 0").select(text.cast("string").alias("text"), "node")
    return source.mapInArrow(lambda batches: released(run(batches)), "token long, node long, packed long, slot short").repartition("token", "slot").sortWithinPartitions("token", "slot", "packed", "node")


def candidates(listed: DataFrame, table: DataFrame, own: DataFrame, percent: int, small: int = SMALL, wide: int = WIDE) -> DataFrame:
    """Edges ``(a, b)`` of nodes and virtual nodes whose components hold every pair of sets that link.

    listed: see ``prefixes``; table: see ``shingled``; own: ``(node, nth)``, one row of the table for each set.
    """
    met = listed.mapInArrow(lambda batches: released(_meetings(batches, percent, small)), "a long, b long, n int, least int")
    counted = met.groupBy("a", "b", "n").agg(F.count("*").alias("met"), F.max("least").alias("least"))
    met = stored(counted.filter("n <> 0 or met >= least").select("a", "b", "n"), "ngram-met")
    pairs, rows = met.filter("n = 0").select("a", "b"), met.filter("n > 0").select(F.col("a").alias("token"), F.col("b").alias("node"))
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(rows.select("node")).distinct()
    sets = marked(table.filter("n > 0").select("nth", "node", "n", "parity"), own.join(nodes, "node").select("nth"))
    sets = stored(sets.filter("marked").select("node", "n", "parity"), "ngram-bits")
    first, second = (sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("parity").alias(f"parity_{c}")) for c in "ab")
    alike = pairs.join(first, "a").join(second, "b").select("a", "b", "n_a", "n_b", "parity_a", "parity_b")
    alike = alike.mapInArrow(lambda batches: released(_alike_pairs(batches, percent)), "a long, b long")
    dealt = rows.join(sets, "node").select("token", "node", "n", "parity").repartition("token").sortWithinPartitions("token", "n", "node")
    linked = dealt.mapInArrow(lambda batches: released(_alike_lists(batches, percent, wide)), "a long, b long")
    return alike.union(linked).union(met.filter("n < 0").select("a", "b"))


def _meetings(batches: Iterator[pa.RecordBatch], percent: int, small: int) -> Iterator[pa.RecordBatch]:
    """``(a, b, n, least)`` of sorted prefixes: pairs of nodes (n is 0) that must meet ``least`` times; token, node and size of the rows
    of lists of over ``small`` sets; edges to virtual nodes (n is -1) for lists that are split by slot.
    """

    def edges(rows: np.ndarray, large: np.ndarray) -> pa.RecordBatch:
        """large: rows of lists that are not met in pairs; all other lists are whole here."""
        tokens, nodes, n, depth = rows[:, 0], rows[:, 1], rows[:, 2] >> 8, rows[:, 2] & 255
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        cold = np.flatnonzero(~large)
        for shift in range(1, small):
            x, y = cold[:-shift], cold[shift:]
            same = tokens[x] == tokens[y]
            if not same.any():
                break
            x, y = x[same], y[same]
            near = 100 * n[x] >= percent * n[y]
            a.append(x[near])
            b.append(y[near])
        a, b = np.concatenate(a), np.concatenate(b)
        hot, split = np.flatnonzero(large & (rows[:, 3] < 0)), np.flatnonzero(large & (rows[:, 3] >= 0))
        split_a, split_b = _met_virtually(tokens[split], nodes[split], n[split], percent)
        first = np.concatenate([np.minimum(nodes[a], nodes[b]), tokens[hot], split_a])
        second = np.concatenate([np.maximum(nodes[a], nodes[b]), nodes[hot], split_b])
        kind = np.concatenate([np.zeros(len(a), np.int64), n[hot], np.full(len(split_a), -1)])
        least = np.concatenate([np.minimum(depth[a], depth[b]), np.ones(len(hot) + len(split_a), np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(first), pa.array(second), pa.array(kind.astype(np.int32)), pa.array(least.astype(np.int32))], names=["a", "b", "n", "least"])

    held: list[np.ndarray] = []  # rows of the last token so far, of which more may come
    large = False  # whether that token's list is a large one
    for batch in batches:
        rows = np.stack([batch.column(k).to_numpy() for k in range(3)] + [batch.column(3).to_numpy().astype(np.int64)], axis=1)
        rows = np.concatenate([*held, rows])
        if len(rows) > 1:
            rows = rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])]
        if not len(rows):
            continue
        first = np.flatnonzero(np.concatenate([[True], (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 3] != rows[:-1, 3])]))
        sizes = np.diff(np.append(first, len(rows)))
        over = np.repeat(sizes > small, sizes) | (rows[:, 3] >= 0)
        if large is not False and tuple(rows[0, [0, 3]]) == large:
            over[: sizes[0]] = True
        last = first[-1]
        large = tuple(rows[-1, [0, 3]]) if over[-1] else False
        cut = len(rows) - 1 if large else last  # of a large list only its last row is held, to know it again
        held = [rows[cut:]]
        if cut:
            yield edges(rows[:cut], over[:cut])
    if held and len(held[0]):
        yield edges(held[0], np.full(len(held[0]), bool(large)))


def _alike_pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs ``(a, b)`` of rows ``(a, b, n_a, n_b, parity_a, parity_b)`` whose bits allow a link."""
    for batch in sliced(batches, "parity_a", 1 << 20):
        most = slack(*(batch.column(k).to_numpy().astype(np.int64) for k in (2, 3)), percent)
        sides = [utf8(batch.column(k)) for k in (4, 5)]
        words = [np.diff(at) // 8 for _, at in sides]
        apart = np.zeros(batch.num_rows, np.int64)
        for w, v in np.unique(np.stack(words, axis=1), axis=0).tolist():
            own = np.flatnonzero((words[0] == w) & (words[1] == v))
            x, y = (folded(raw[at[own][:, None] + np.arange(8 * k)].view(U64), min(w, v)) for (raw, at), k in zip(sides, (w, v), strict=True))
            apart[own] = np.bitwise_count(x ^ y).sum(axis=1)
        kept = pa.array((most > 0) & (apart <= most))
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(kept) for k in (0, 1)], names=["a", "b"])


def _alike_lists(batches: Iterator[pa.RecordBatch], percent: int, wide: int) -> Iterator[pa.RecordBatch]:
    """Edges ``(a, b)`` of sorted rows ``(token, node, n, parity)``: a forest of the pairs of each token whose bits allow a link, or virtual nodes for lists of over ``wide``."""
    empty = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    token, held, count, made = None, [], 0, [empty]

    def settled() -> tuple[np.ndarray, np.ndarray]:
        rows = pa.Table.from_batches(held).combine_chunks()
        nodes, n = rows.column(1).to_numpy(), rows.column(2).to_numpy().astype(np.int64)
        if count > wide:
            return _met_virtually(rows.column(0).to_numpy(), nodes, n, percent)
        return tuple(nodes[x] for x in alike(n, *utf8(rows.column(3)), percent))

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*made, strict=True)], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        tokens = batch.column(0).to_numpy()
        first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        for begin, end in zip(first.tolist(), np.append(first[1:], len(tokens)).tolist(), strict=True):
            if tokens[begin] != token:
                if held:
                    made.append(settled())
                token, held, count = tokens[begin], [], 0
            held.append(batch.slice(begin, end - begin))
            count += end - begin
            if count > wide:  # such a list is not held
                made.append(settled())
                held = []
        yield packed()
        made = [empty]
    if held:
        made.append(settled())
    yield packed()


def alike(n: np.ndarray, raw: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as two arrays of places, of the pairs of sets whose parity bits allow a link. n: sizes, ascending; raw, at: bits and where they begin."""
    root, words = np.arange(len(n)), np.diff(at) // 8
    reach = np.searchsorted(n, 100 * n // percent, side="right")
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    cuts = [0, *(np.flatnonzero(np.diff(words)) + 1).tolist(), len(n)]
    blocks = [raw[at[x] : at[y]].copy().view(U64).reshape(y - x, -1) for x, y in zip(cuts[:-1], cuts[1:], strict=True) if y > x]
    for k, start in enumerate(cuts[: len(blocks)]):
        own = np.concatenate([folded(bits, blocks[k].shape[1]) for bits, x in zip(blocks[k:], cuts[k:], strict=False) if x < reach[cuts[k + 1] - 1]])
        for x in range(start, cuts[k + 1]):
            y = x + 1 + np.flatnonzero(root[x + 1 : reach[x]] != root[x])
            if not len(y):
                continue
            most = slack(n[x], n[y], percent)
            y = y[(most > 0) & (np.bitwise_count(own[y - start] ^ own[x - start]).sum(axis=1) <= most)]
            joined, place = np.unique(root[y], return_index=True)
            a.append(np.full(len(place), x))
            b.append(y[place])
            root[np.isin(root, joined)] = root[x]
    return np.concatenate(a), np.concatenate(b)


def _met_virtually(tokens: np.ndarray, nodes: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of each node to the virtual nodes of its token for its class of sizes and the next."""
    place = size_class(n, percent)
    return np.concatenate([nodes, nodes]), np.concatenate([_virtual(tokens, place + k) for k in (0, 1)])


def _virtual(tokens: np.ndarray, place: np.ndarray) -> np.ndarray:
    mixed = (tokens.view(U64) ^ place.astype(U64) * U64(0x9E3779B97F4A7C15)) * U64(0xD6E8FEB86659FD93)
    return (mixed ^ mixed >> U64(29)).view(np.int64)


def linked_sets(sets: list[np.ndarray], sides: np.ndarray | None, copies: np.ndarray, percent: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """A spanning forest of the links between these sets, and of each the copies of all that it links with.

    sides: if given, only sets of different sides are compared. Every set counts, through the lists of its shingles,
    what it shares with the sets after it.
    """
    count, sizes = len(sets), np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(count), sizes)
    order = np.argsort(ids, kind="stable")
    lists = owner[order]
    begins = np.searchsorted(ids[order], np.arange(int(ids.max(initial=-1)) + 2))
    ends = np.cumsum(sizes)
    parent = np.arange(count)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    forest, linked = [], np.zeros(count, np.int64)
    for x in range(count - 1):
        own = ids[ends[x] - sizes[x] : ends[x]]
        lengths = begins[own + 1] - begins[own]
        if lengths.sum() == len(own):
            continue
        at = np.repeat(begins[own] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        shared = np.bincount(lists[at], minlength=count)
        shared[: x + 1] = 0
        if sides is not None:
            shared[sides == sides[x]] = 0
        hits = np.flatnonzero(100 * shared >= percent * (sizes[x] + sizes - shared))
        hits = hits[shared[hits] > 0]
        linked[x] += copies[hits].sum()
        linked[hits] += copies[x]
        for y in hits.tolist():
            p, q = root(x), root(y)
            if p != q:
                parent[q] = p
                forest.append((x, y))
    return forest, linked


#: Where a set is verified: its group, and a pair of blocks (size class and number).
KEY = ("component", "c1", "i", "c2", "j")


def _planned(groups: DataFrame, percent: int, block_sets: int, block_shingles: int) -> DataFrame:
    """``(nth, component, copies, ks)`` of the sets of groups of two or more; ks: blocks of each size class, null where one block is enough."""
    by_class = groups.withColumn("c", _class(F.col("n"), percent)).groupBy("component", "c").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("sets") / block_sets, F.col("shingles") / block_shingles)).cast("int")
    by_group = by_class.groupBy("component").agg(F.sum("sets").alias("sets"), F.sum("shingles").alias("shingles"), F.map_from_entries(F.collect_list(F.struct("c", blocks.alias("k")))).alias("ks"))
    one = (F.col("sets") <= block_sets) & (F.col("shingles") <= block_shingles)
    by_group = by_group.filter("sets > 1").select("component", F.when(~one, F.col("ks")).alias("ks"))
    return groups.join(by_group, "component").select("nth", "component", "copies", "ks")


def _class(n: Column, percent: int) -> Column:
    return F.floor(F.log(n.cast("double")) / F.lit(math.log(100 / percent) + 1e-6)).cast("int")


def _placed(sets: DataFrame, percent: int) -> DataFrame:
    """Sets ``(digest, n, component, copies, ks, text)`` once for each pair of blocks that they are verified in: key columns and side."""
    c, number, ks = F.col("c"), F.col("number"), F.col("ks")
    sets = sets.withColumn("c", _class(F.col("n"), percent))
    k = F.coalesce(F.try_element_at(ks, c), F.lit(1))
    sets = sets.withColumn("number", F.pmod(F.xxhash64("digest"), k.cast("long")).cast("int"))

    def pairs(other: Column, above: bool) -> Column:
        """This set's block with each block of the class ``other``."""
        many = F.coalesce(F.try_element_at(ks, other), F.lit(0))
        every = F.when(many > 0, F.sequence(F.lit(0), many - 1)).otherwise(F.array().cast("array<int>"))
        if above:
            return F.transform(every, lambda x: F.struct(c.alias("c1"), number.alias("i"), other.alias("c2"), x.alias("j"), F.lit(0).alias("side")))
        return F.transform(every, lambda x: F.struct(other.alias("c1"), x.alias("i"), c.alias("c2"), number.alias("j"), F.lit(1).alias("side")))

    same = F.transform(
        F.sequence(F.lit(0), k - 1),
        lambda x: F.struct(c.alias("c1"), F.least(number, x).alias("i"), c.alias("c2"), F.greatest(number, x).alias("j"), F.when(number > x, 1).otherwise(0).alias("side")),
    )
    whole = F.array(F.struct(F.lit(0).alias("c1"), F.lit(0).alias("i"), F.lit(0).alias("c2"), F.lit(0).alias("j"), F.lit(0).alias("side")))
    keys = F.when(ks.isNull(), whole).otherwise(F.concat(same, pairs(c + 1, True), pairs(c - 1, False)))
    return sets.select("component", "digest", "copies", "text", F.explode(keys).alias("key")).select("component", "key.*", "digest", "copies", "text")


def verified(placed: DataFrame, words: int, percent: int) -> DataFrame:
    """``(a, b, links)``: a forest of exact links by digest (links null), and of each set (b null) the documents that it links with in one place."""

    def group(key: tuple, rows: list[tuple]) -> pa.RecordBatch:
        sides = None if key[1:3] == key[3:5] else np.array([x[3] for x in rows])
        forest, linked = linked_sets([x[0] for x in rows], sides, np.array([x[2] for x in rows], np.int64), percent)
        a = [rows[x][1] for x, _ in forest] + [r[1] for r, k in zip(rows, linked, strict=True) if k]
        b = [rows[y][1] for _, y in forest] + [None] * int((linked > 0).sum())
        links = [None] * len(forest) + linked[linked > 0].tolist()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(links, pa.int64())], names=["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows = None, []
        for batch in sliced(batches, "text"):
            sets, at = shingle_sets(*utf8(batch.column(8)), words)
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True))
            for k, (key, digest, copies, side) in enumerate(zip(keys, *(batch.column(x).to_pylist() for x in (6, 7, 5)), strict=True)):
                if key != last and rows:
                    yield group(last, rows)
                    rows = []
                last = key
                rows.append((sets[at[k] : at[k + 1]].copy(), digest, copies, side))
        if rows:
            yield group(last, rows)

    brought = placed.select(*KEY, "side", "digest", "copies", "text")
    return brought.repartition(*KEY).sortWithinPartitions(*KEY, "side", "digest").mapInArrow(lambda batches: released(run(batches)), "a binary, b binary, links long")


def marked(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """``rows`` (with ``nth``) and whether each one's number is among ``numbers``, as ``marked``.

    The numbers go to the scan as bits, one for each row of the table at most (400 KB for three million), so no row is shuffled.
    """
    bits = numbers.groupBy(F.bitmap_bucket_number("nth").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("nth")).alias("bits"))
    at = F.bitmap_bit_position("nth")
    byte = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("bucket", F.bitmap_bucket_number("nth")).join(F.broadcast(bits), "bucket", "left")
    return found.withColumn("marked", F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop("bucket", "bits")


def groups_of(
    table: DataFrame, id_col: Column, text: Column, words: int, percent: int, more: DataFrame | None = None,
    small: int = SMALL, heavy: int = HEAVY, block_sets: int = BLOCK_SETS, block_shingles: int = BLOCK_SHINGLES, wide: int = WIDE, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``(digest, component, component_id, n_links)`` of every set of ``table`` (see ``shingled``) that is not empty.

    component_id: the smallest id reachable; n_links: other documents that link, copies included. more: further candidate edges
    ``(a, b)`` of nodes, which are verified like the own ones.
    """
    rows = table.filter("n > 0")
    own = rows.groupBy("digest").agg(F.first("node").alias("node"), F.first("n").alias("n"), F.min("nth").alias("nth"), F.min(id_col.cast("long")).alias("first_id"), F.count("*").alias("copies"))
    own = stored(own, "ngram-sets")
    listed = prefixes(table, text, words, percent, counters(table), heavy)
    edges = candidates(listed, table, own.select("node", "nth"), percent, small, wide)
    edges = edges if more is None else edges.union(more.select("a", "b"))
    labels = connected_components(edges, "a", "b")
    groups = stored(own.join(labels, "node").select("nth", "n", "copies", "component"), "ngram-groups")
    planned = _planned(groups, percent, block_sets, block_shingles)
    texts = rows.select("nth", "digest", "n", text.cast("string").alias("text"))
    # texts are shuffled once, to their groups, where the rows wanted are few enough to send around; else twice, but never those of no group
    few = groups.count() <= broadcast_rows
    texts = texts.join(F.broadcast(planned), "nth") if few else marked(texts, planned).filter("marked").drop("marked").join(planned, "nth")
    found = stored(verified(_placed(texts, percent), words, percent), "ngram-links")
    classes = connected_components(found.filter("b is not null"), "a", "b").select(F.col("node").alias("digest"), F.col("component").alias("class"))
    degrees = found.filter("b is null").groupBy(F.col("a").alias("digest")).agg(F.sum("links").alias("links"))
    classes = own.join(classes, "digest", "left").join(degrees, "digest", "left").withColumn("component", F.coalesce("class", "digest"))
    roots = classes.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return classes.join(roots, "component").select("digest", "component", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, percent: int = 90, **limits: int) -> DataFrame:
    """``(id, n_shingles, component_id, n_links)`` for every row of ``docs``.

    Two documents link if the sets of their distinct shingles (A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``; fewer words than a
    shingle: the whole sequence) have 100 * intersection >= percent * union; exact, up to 64-bit hashes of shingles and 128-bit ones of
    sets. Texts without words, and null, have an empty set, which links with nothing: component_id is the row's own id. A null id is
    ignored in the minimum; repeated rows come back repeated and link as copies; an empty table gives an empty result; further columns
    of ``docs``, whatever their names, are not looked at.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    table = shingled(rows, F.col("text"), shingle_words, "ngram-rows", percent)
    own, text = F.col("row.id"), F.col("row.text")
    groups = groups_of(table, own, text, shingle_words, percent, **limits)
    every = table.filter("n >= 0").select(own.alias("id"), F.when(F.col("n") > 0, F.col("digest")).alias("digest"), F.col("n").cast("long").alias("n_shingles"))
    out = every.join(groups.select("digest", "component_id", "n_links"), "digest", "left")
    empty = F.col("n_shingles") == 0
    return out.select("id", "n_shingles", F.when(empty, F.col("id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def query(spark, sf_dir: str) -> DataFrame:
    return similar(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")


#: All pairs of sets that share a shingle, counted.
SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
sh as (select distinct doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[cast(i as int)] || ' ' || w[cast(i + 1 as int)] || ' ' || w[cast(i + 2 as int)]) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) s from w),
n as (select doc_id, count(*) n from sh group by doc_id),
p as (select a.doc_id x, b.doc_id y, count(*) k from sh a join sh b using (s) where a.doc_id <> b.doc_id group by all),
e as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * k >= 90 * (a.n + b.n - k)),
r as (select doc_id node, doc_id root from documents union select e.y, r.root from r join e on r.node = e.x)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.root as component_id, coalesce(g.n, 0) as n_links
from documents d left join n using (doc_id) left join (select node, min(root) root from r group by node) m on m.node = d.doc_id left join (select x, count(*) n from e group by x) g on g.x = d.doc_id"""
