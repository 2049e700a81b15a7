"""SimHash near-duplicates through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. Two fingerprints that differ in at
most three bits differ in at most two over some pair of segments. A segment, padded to 23 bits, is
decoded by the perfect (23,12) Golay code: ``nearest`` is its only codeword within three bits,
``around`` are its one or six codewords within four. If two words differ in at most two bits, they
share an ``around`` codeword (that nearest to the word between them); if in one, each one's nearest is
around the other. So the keys ``around x nearest`` and ``nearest x around`` of a pair of segments meet
whenever its differing bits sum to two or less: up to 11 keys a pair, 33 a fingerprint, no link lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.arrowtext import U64, lowered, mix64, released, utf8
from leafmill.operators.graph import connected_components
from leafmill.storage import stored

#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, the generator of the binary Golay code.
GOLAY = 0b110001110101
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))


def _remainder(words: np.ndarray) -> np.ndarray:
    words = words.astype(np.int64)
    for bit in range(22, 10, -1):
        words = np.where(words >> bit & 1, words ^ (GOLAY << (bit - 11)), words)
    return words


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the leader (weight three at most), and all patterns of weight four at most (six slots)."""
    patterns = [0]
    for weight in range(1, 5):
        patterns += [sum(1 << b for b in bits) for bits in combinations(range(23), weight)]
    around = np.full((2048, 6), -1, np.int64)
    used = np.zeros(2048, np.int64)
    for pattern, syndrome in zip(patterns, _remainder(np.array(patterns)).tolist(), strict=True):
        around[syndrome, used[syndrome]] = pattern
        used[syndrome] += 1
    return around[:, 0].copy(), around


_LEADER, _AROUND = _tables()


def nearest(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of each 23-bit word's codeword within three bits."""
    return (words ^ _LEADER[_remainder(words)]) >> 11


def around(words: np.ndarray) -> np.ndarray:
    """Indices of the codewords within four bits: one or six to a row, -1 where there are fewer."""
    patterns = _AROUND[_remainder(words)]
    return np.where(patterns < 0, -1, (words[:, None] ^ patterns) >> 11)


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, key)`` of every fuzzy key. prints: uint64, one column for each 64-bit part."""
    rows, keys = [], []
    index = np.arange(len(prints))
    for part in range(prints.shape[1]):
        near, wide = [], []
        for low, width in SEGMENTS:
            seg = (prints[:, part] >> U64(low) & U64((1 << width) - 1)).astype(np.int64)
            near.append(nearest(seg))
            wide.append(around(seg))
        for p, (i, j) in enumerate(PAIRS):
            tag = (part * 3 + p) << 24
            first = np.where(wide[i] < 0, -1, tag | wide[i] << 12 | near[j][:, None])
            second = np.where(wide[j] < 0, -1, tag | near[i][:, None] << 12 | wide[j])
            second[second == first[:, :1]] = -1
            both = np.concatenate([first, second], axis=1)
            # within a row the same key can come from both products
            both.sort(axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            r, c = np.nonzero(both >= 0)
            rows.append(index[r])
            keys.append(both[r, c])
    return np.concatenate(rows), np.concatenate(keys)


def shingles(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle in order; text: A-Z already lower-cased. Fewer words than a shingle: the whole sequence; none: none."""
    words = text.split()
    if not words:
        return np.zeros(0, U64)
    joined = b" ".join(words)
    xx = xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = [xx(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes = [xx(joined[a:b], 42) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    return np.array(hashes, U64)


def fingerprint(text: bytes, shingle: int, parts: int) -> np.ndarray:
    """Big-endian bytes of a text's fingerprint; text: A-Z already lower-cased.

    A bit is set if it is set in over half the hashes. The first 64 bits use XXH64 (seed 42) itself,
    further parts a mixed copy of it. Fewer words than a shingle: the whole sequence; none: zero.
    """
    return _majority(shingles(text, shingle), parts)


def _majority(h: np.ndarray, parts: int) -> np.ndarray:
    if not len(h):
        return np.zeros(8 * parts, np.uint8)
    out = []
    for part in range(parts):
        x = h if not part else mix64(h + U64(part * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        ones = np.zeros(64, np.int64)
        for k in range(0, len(x), 1 << 16):
            ones += np.unpackbits(x[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out.append(np.packbits(ones * 2 > len(x)))
    return np.concatenate(out)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, n_bits: int = 64) -> DataFrame:
    """``(id, fp binary)`` for every row; null text reads as empty, whose fingerprint is zero."""
    parts = n_bits // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = utf8(batch.column(1))
            data = lowered(raw).tobytes()
            prints = [fingerprint(data[a:b], shingle_words, parts).tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary())], names=["id", "fp"])

    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return source.mapInArrow(run, "id long, fp binary")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


def bucket_links(prints: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within one bucket, without its pairs.

    Breadth first: each print reached is compared with those not reached yet, so a dense group empties
    the rest at once; only buckets of mutually distant prints cost the square of their size.
    """
    left = np.arange(len(prints))
    src, dst = [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = _popcount(prints[left] ^ prints[x]) <= most
            if hit.any():
                found = left[hit]
                src.append(np.full(len(found), x))
                dst.append(found)
                queue.extend(found.tolist())
                left = left[~hit]
    if not src:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(src), np.concatenate(dst)


def links_of(keys: np.ndarray, prints: np.ndarray, most: int, small: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by key. Buckets up to ``small`` are compared row by row shift, all at once."""
    n = len(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(first, n))
    src, dst = [], []
    is_small = np.repeat(sizes <= small, sizes)
    for shift in range(1, min(small, int(sizes.max(initial=1)))):
        a = np.flatnonzero((keys[shift:] == keys[:-shift]) & is_small[:-shift])
        if not len(a):
            break
        a = a[_popcount(prints[a] ^ prints[a + shift]) <= most]
        src.append(a)
        dst.append(a + shift)
    for g in np.flatnonzero(sizes > small):
        a, b = bucket_links(prints[first[g] : first[g] + sizes[g]], most)
        src.append(a + first[g])
        dst.append(b + first[g])
    if not src:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(src), np.concatenate(dst)


def _as_prints(column: pa.Array, parts: int) -> np.ndarray:
    raw, _ = utf8(column)
    return raw.view(">u8").astype(U64).reshape(-1, parts) if len(raw) else np.zeros((0, parts), U64)


#: Prints of one key that a task compares with each other; larger buckets are split by further bits.
OVERSIZE = 4_000
#: Bytes of a 64-bit print that a sub-key reads: prints within three bits agree on five of eight bytes.
SUBSETS = tuple(combinations(range(8), 5))


def exact_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, key)`` of the 56 sub-keys of 64-bit prints: five of the eight bytes as they are."""
    octets = prints[:, :1].astype("<u8").view(np.uint8).astype(np.int64)
    keys = [sum(octets[:, b] << 8 * k for k, b in enumerate(subset)) | n << 40 for n, subset in enumerate(SUBSETS)]
    return np.tile(np.arange(len(prints)), len(SUBSETS)), np.concatenate(keys)


def golay_links(prints: DataFrame, n_bits: int = 64, max_distance: int = 3, oversize: int = OVERSIZE) -> DataFrame:
    """Verified links ``(src, dst)`` between different fingerprints (column ``fp``, distinct values).

    Exact for ``n_bits=64, max_distance=3``; there, prints of a key that over ``oversize`` prints share are compared
    by ``exact_keys`` instead (of those that share such a key, 24 bits are left: 2**24 prints at most, 134 MB). Wider prints are
    joined through the keys of each 64-bit part and verified on all bits: a link is found if some part has a pair of segments
    with two differing bits or fewer. Buckets of over 24 prints give a spanning forest.
    """
    parts = n_bits // 64
    columns, schema = ["key", "fp"], "key long, fp binary"

    def spread(keys_of):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, keys = keys_of(_as_prints(batch.column(0), parts))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(c.take(pa.array(rows)) for c in batch.columns)], names=columns)

        return run

    def link(most: int | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[np.ndarray, ...]] = []
            large = None  # the key whose prints are passed on

            def sides(pairs: np.ndarray) -> list[pa.Array]:
                big = pairs.astype(">u8")
                return [pa.array([x.tobytes() for x in big[:, k * parts : (k + 1) * parts]], pa.binary()) for k in range(big.shape[1] // parts)]

            def passed_on(fps: np.ndarray) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([*sides(fps), pa.nulls(len(fps), pa.binary())], names=["src", "dst"])

            def done(parted: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
                keys, fps = (np.concatenate(c) for c in zip(*parted, strict=True))
                if most:
                    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                    sizes = np.diff(np.append(first, len(keys)))
                    over = np.repeat(sizes > most, sizes)
                    if over.any():
                        yield passed_on(fps[over])
                        keys, fps = keys[~over], fps[~over]
                a, b = links_of(keys, fps, max_distance)
                pairs = np.concatenate([fps[a], fps[b]], axis=1)
                if len(pairs):
                    pairs = np.unique(pairs, axis=0)
                yield pa.RecordBatch.from_arrays(sides(pairs), names=["src", "dst"])

            for batch in batches:
                if not batch.num_rows:
                    continue
                keys, fps = batch.column(0).to_numpy(), _as_prints(batch.column(1), parts)
                if large is not None:
                    n = int(np.searchsorted(keys, large, side="right")) if keys[0] == large else 0
                    if n:
                        yield passed_on(fps[:n])
                        keys, fps = keys[n:], fps[n:]
                    if not len(keys):
                        continue
                    large = None
                cut = int(np.searchsorted(keys, keys[-1]))
                if cut:
                    yield from done([*held, (keys[:cut], fps[:cut])])
                    held = []
                elif held and held[-1][0][-1] != keys[-1]:
                    yield from done(held)
                    held = []
                held.append((keys[cut:], fps[cut:]))
                if most and sum(len(h[0]) for h in held) > most:
                    yield passed_on(np.concatenate([h[1] for h in held]))
                    held, large = [], keys[-1]
            if held:
                yield from done(held)

        return run

    def linked(nodes: DataFrame, keys_of, most: int | None) -> DataFrame:
        keyed = nodes.select(*columns[1:]).mapInArrow(lambda batches: released(spread(keys_of)(batches)), schema)
        return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(lambda batches: released(link(most)(batches)), "src binary, dst binary").distinct()

    if parts > 1 or max_distance > 3:
        return linked(prints, golay_keys, None)
    found = stored(linked(prints, golay_keys, oversize), "golay-links")
    left = found.filter("dst is null").select(F.col("src").alias("fp"))
    links = found.filter("dst is not null")
    return links if left.isEmpty() else links.union(linked(left, exact_keys, None)).distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, n_bits: int = 64, max_distance: int = 3) -> DataFrame:
    """``(id, fp, component_id)`` for every row of ``docs``.

    component_id is the smallest id reachable over links of at most ``max_distance`` differing bits;
    equal fingerprints are one node, so copies are never expanded into pairs. Null texts read as empty
    (fingerprint zero, linked like any other); a null id is ignored in the minimum; repeated rows come
    back repeated; an empty table gives an empty result. Other columns of ``docs`` are not looked at.
    """
    prints = stored(fingerprints(docs, id_col, text_col, shingle_words, n_bits), "simhash-prints")
    unique = stored(prints.groupBy("fp").agg(F.min("id").alias("first_id")), "simhash-unique")
    links = golay_links(unique, n_bits, max_distance)
    labels = connected_components(links).select(F.col("node").alias("fp"), "component")
    classes = unique.join(labels, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    roots = classes.groupBy("component").agg(F.min("first_id").alias("component_id"))
    ids = classes.join(roots, "component").select("fp", "component_id")
    return prints.join(ids, "fp").select("id", "fp", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    groups = simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def _sql() -> str:
    """Fingerprints with XXH64 written out in 128-bit integers, then links by all pairs of distinct fingerprints."""
    p1, p2, p3, p4, p5 = (f"{x}::uhugeint" for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
    whole = f"{1 << 64}::uhugeint"

    def turned(x: str, bits: int) -> str:
        return f"(({x} * {1 << bits}::uhugeint) % {whole} + {x} // {1 << 64 - bits}::uhugeint)"

    def mixed(acc: str, lane: str) -> str:
        return f"({turned(f'(({acc} + {lane} * {p2}) % {whole})', 31)} * {p1} % {whole})"

    def lane(at: str, size: int) -> str:
        return "('0x' || " + " || ".join(f"substr(hx, cast({at} as bigint) * 2 + {2 * k + 1}, 2)" for k in reversed(range(size))) + ")::ubigint::uhugeint"

    def stripe(k: int, start: int) -> str:
        own = f"list_transform(range(0, n // 32), lambda s: lanes[cast(s * 4 + {k} as int)])"
        return f"list_reduce({own}, lambda a, x: {mixed('a', 'x')}, {start % (1 << 64)}::uhugeint)"

    starts = (42 + 11400714785074694791 + 14029467366897019727, 42 + 14029467366897019727, 42, 42 - 11400714785074694791)
    ones = ", ".join(f"sum((h >> {b}) & 1) c{b}" for b in range(64))
    bits = " + ".join(f"(case when c{b} * 2 > n then {1 << b}::uhugeint else 0::uhugeint end)" for b in range(64))

    def joined(acc: str, k: int) -> str:
        return f"((xor({acc}, {mixed('0::uhugeint', f'v{k}')}) * {p1} + {p4}) % {whole})"

    return f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w from documents),
sh as (select doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[cast(i as int)] || ' ' || w[cast(i + 1 as int)] || ' ' || w[cast(i + 2 as int)]) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) s from w),
x0 as (select s, lower(hex(encode(s))) hx, strlen(s) n from (select distinct s from sh)),
x1 as (select *, list_transform(range(0, n // 8), lambda k: {lane('k * 8', 8)}) lanes from x0),
x2 as (select *, {", ".join(f"{stripe(k + 1, start)} v{k + 1}" for k, start in enumerate(starts))} from x1),
x3 as (select *, {" + ".join(turned(f"v{k}", r) for k, r in zip((1, 2, 3, 4), (1, 7, 12, 18), strict=True))} big from x2),
x4 as (select *, {joined(f"(big % {whole})", 1)} m1 from x3), x5 as (select *, {joined("m1", 2)} m2 from x4), x6 as (select *, {joined("m2", 3)} m3 from x5),
x7 as (select *, ((case when n >= 32 then {joined("m3", 4)} else 42::uhugeint + {p5} end) + n::uhugeint) % {whole} acc from x6),
x8 as (select * replace (list_reduce(lanes[cast(n // 32 * 4 + 1 as int):], lambda a, x: ({turned(f"xor(a, {mixed('0::uhugeint', 'x')})", 27)} * {p1} + {p4}) % {whole}, acc) as acc) from x7),
x9 as (select * replace (case when n % 8 >= 4 then ({turned(f"xor(acc, ({lane('n // 8 * 8', 4)} * {p1}) % {whole})", 23)} * {p2} + {p3}) % {whole} else acc end as acc) from x8),
xa as (select * replace (list_reduce(list_transform(range(n - n % 4, n), lambda k: {lane('k', 1)}), lambda a, x: ({turned(f"xor(a, x * {p5} % {whole})", 11)} * {p1}) % {whole}, acc) as acc) from x9),
xb as (select s, xor(acc, acc // {1 << 33}::uhugeint) * {p2} % {whole} h from xa), xc as (select s, xor(h, h // {1 << 29}::uhugeint) * {p3} % {whole} h from xb),
xd as (select s, xor(h, h // {1 << 32}::uhugeint)::ubigint h from xc),
cnt as (select doc_id, count(*) n, {ones} from sh join xd using (s) group by doc_id),
fp as (select d.doc_id, coalesce({bits}, 0::uhugeint)::ubigint fp from documents d left join cnt using (doc_id)),
f as (select fp, min(doc_id) first_id from fp group by fp),
e as (select a.fp a, b.fp b from f a join f b on bit_count(xor(a.fp, b.fp)) <= 3 and a.fp <> b.fp),
r as (select fp node, first_id root from f union select e.b, r.root from r join e on r.node = e.a)
select fp.doc_id, lpad(lower(hex(fp.fp)), 16, '0') as fingerprint, m.root as component_id from fp join (select node, min(root) root from r group by node) m on fp.fp = m.node"""


SQL = _sql()
