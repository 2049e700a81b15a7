"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A seed hashes the tokens under a mask's fixed positions and ignores the others. The three masks below
(six positions in a span of nine) were chosen so that any 13-token window with at most two substituted
tokens has a placement of some mask that avoids both: so no such window is missed. Items too short for a
mask have one seed over all of their tokens. Hits are verified on the aligned tokens around them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.storage import stored

#: The token positions that each mask reads.
MASKS = ((0, 1, 2, 4, 7, 8), (0, 3, 4, 5, 7, 8), (0, 1, 2, 3, 5, 8))
SPAN = 9
WINDOW = 13
SUBSTITUTIONS = 2
#: Distinct benchmark seeds (eight bytes each) that are broadcast at once; more are taken in blocks, a scan each.
BROADCAST_SEEDS = 1_000_000
#: Places of seeds in the benchmark (some 300 bytes each) up to which they are broadcast; beyond, a salted join.
BROADCAST_PLACES = 100_000
SALTS = 8


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _positions(rows: DataFrame, key: str) -> DataFrame:
    """``(key, tokens, h, at, ends)`` for every position with room for a mask; ends: hash of a span's first and last token."""
    hashed = rows.withColumn("h", F.transform("tokens", lambda t: F.xxhash64(t)))
    # the outer form: for the inner one a filter on the array's size is inferred, and splits every text twice
    at = hashed.select(key, "tokens", "h", F.posexplode_outer("h").alias("at", "h0")).filter(F.col("at") <= F.size("h") - SPAN)
    return at.select(key, "tokens", "h", "at", F.xxhash64("h0", F.get("h", F.col("at") + SPAN - 1)).alias("ends"))


def _placed(at: DataFrame, key: str) -> DataFrame:
    """``(key, tokens, at, ends, seed)`` for every mask at every position."""
    seeds = [F.xxhash64(F.lit(k), *(F.get("h", F.col("at") + o) for o in mask)) for k, mask in enumerate(MASKS)]
    return at.select(key, "tokens", "at", "ends", F.explode(F.array(*seeds)).alias("seed"))


def _whole(rows: DataFrame, key: str, lengths: list[int]) -> DataFrame:
    """``(key, tokens, at, k, seed)`` of every run of k tokens, k one of these lengths."""
    at = rows.withColumn("h", F.transform("tokens", lambda t: F.xxhash64(t))).select(key, "tokens", "h", F.posexplode_outer("h").alias("at", "h0"))

    def run(k: int) -> Column:
        seed = F.xxhash64(F.lit(-k), *(F.get("h", F.col("at") + o) for o in range(k)))
        return F.struct(F.lit(k).alias("k"), F.when(F.col("at") + k <= F.size("h"), seed).alias("seed"))

    runs = at.select(key, "tokens", "at", F.inline(F.array(*map(run, lengths))))
    return runs.filter("seed is not null")


def _around(at: Column) -> Column:
    """The tokens of every window that could hold the seed at ``at``; null beyond either end."""
    # get() counts from zero and is null beyond the end; a negative index is null too
    return F.array(*(F.get("tokens", at + j) for j in range(SPAN - WINDOW, WINDOW)))


def overlaps(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    min_tokens: int = 1, broadcast_seeds: int = BROADCAST_SEEDS, broadcast_places: int = BROADCAST_PLACES,
) -> DataFrame:
    """``(id, item_id, n_seeds, first_token, last_token)``: documents that hold part of a benchmark item.

    A hit counts if some aligned window of 13 tokens around it has at most two substitutions; items
    of 9 to 12 tokens must match whole but for one token, items below 9 tokens (and of ``min_tokens`` at least)
    exactly. n_seeds: distinct seed hits; first_token and last_token: the first and last hit's token positions. Null texts
    have no tokens, null ids are passed over; repeated rows count once, several texts of an id are taken
    together; ids may be of any type; empty tables give an empty result; other columns are not looked at.
    Benchmark seeds beyond ``broadcast_seeds`` are taken in blocks, with a scan of docs for each.
    """
    d = docs.filter(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), tokens(F.col(f"`{text_col}`").cast("string")).alias("tokens"))
    b = benchmark.filter(F.col(f"`{item_col}`").isNotNull()).select(F.col(f"`{item_col}`").alias("item_id"), tokens(F.col(f"`{item_text_col}`").cast("string")).alias("tokens"))
    b = b.filter(F.size("tokens") >= min_tokens)
    n = F.size("tokens")
    placed = _placed(_positions(b, "item_id"), "item_id")
    # an item below nine tokens is one run; one of nine has a run of eight at either end, for what all masks read
    runs = _whole(b.filter(n <= SPAN), "item_id", list(range(1, SPAN))).filter(F.col("k") == F.least(n, F.lit(SPAN - 1)))
    where = ("seed", "item_id", F.col("at").alias("item_at"), _around(F.col("at")).alias("item_around"), n.alias("n"))
    items = placed.select(*where, "ends").unionByName(runs.select(*where, F.lit(None).cast("long").alias("ends")))
    items = stored(items.distinct(), "benchmark-seeds")
    lengths = [k for (k,) in items.filter(F.col("ends").isNull()).select(F.least("n", F.lit(SPAN - 1)).alias("k")).distinct().collect()]  # eight at most
    masked = items.filter(F.col("ends").isNotNull())
    hits = _hits(lambda own: _placed(_positions(d, "id").join(F.broadcast(own.select("ends").distinct()), "ends", "left_semi"), "id"), masked, broadcast_seeds)
    if lengths:
        hits += _hits(lambda own: _whole(d, "id", sorted(lengths)), items.filter(F.col("ends").isNull()), broadcast_seeds)
    found = reduce(DataFrame.union, hits)
    # an exchange of the few hits keeps their verification out of the scan's generated code, which stays small enough to compile
    found, places = found.repartition("id", "at"), items.drop("ends")
    if items.count() <= broadcast_places:
        both = found.join(F.broadcast(places), "seed")
    else:  # salted, so that no seed that many documents have meets all of its places in one task
        salted = places.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = found.withColumn("salt", F.pmod(F.xxhash64("id", "at"), F.lit(SALTS)).cast("int")).join(salted, ["seed", "salt"])
    # one bit for each aligned token that agrees; a window is thirteen neighbouring bits
    agree = [F.coalesce((F.get("around", F.lit(k)) == F.get("item_around", F.lit(k))).cast("int"), F.lit(0)) * (1 << k) for k in range(2 * WINDOW - SPAN)]
    bits = agree[0]
    for bit in agree[1:]:
        bits = bits + bit
    width = F.least(F.lit(WINDOW), "n")
    need = F.when(F.col("n") < SPAN, F.col("n")).otherwise(width - F.floor(width * SUBSTITUTIONS / WINDOW))
    windows = [F.bit_count(bits.bitwiseAND(F.lit(((1 << WINDOW) - 1) << i))) for i in range(WINDOW - SPAN + 1)]
    good = both.filter(F.greatest(*windows) >= need).groupBy("id", "item_id", "seed", "at", "item_at").agg(F.lit(1).alias("one"))
    return good.groupBy("id", "item_id").agg(F.count("*").alias("n_seeds"), F.min("at").alias("first_token"), F.max("at").alias("last_token"))


def _hits(places, items: DataFrame, most: int) -> list[DataFrame]:
    """``(seed, id, at, around)`` where a document has a seed of items, by blocks of about ``most`` seeds."""
    count = items.select("seed").distinct().count()
    blocks = max(1, -(-count // most))
    out = []
    for k in range(blocks):
        own = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("seed"), F.lit(blocks)) == k)
        seeds = F.broadcast(own.select("seed").distinct())
        out.append(places(own).join(seeds, "seed", "left_semi").select("seed", "id", "at", _around(F.col("at")).alias("around")))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return overlaps(docs, benchmark).withColumnRenamed("id", "doc_id")


def _sql() -> str:
    def parts(table: str, key: str) -> str:
        own = f"list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
        return f"select {key} key, {own} t from {table} where text is not null and {key} is not null"

    def placed(source: str) -> str:
        one = "select key, pos, {k} m, concat_ws(' ', {words}) s from (select key, t, unnest(range(0, len(t) - {gap})) pos from {source} where len(t) > {gap})"
        return " union all ".join(one.format(k=k, words=", ".join(f"t[pos + {o + 1}]" for o in mask), gap=SPAN - 1, source=source) for k, mask in enumerate(MASKS))

    around = f"list_transform(range({SPAN - WINDOW}, {WINDOW}), lambda j: case when h.pos + j >= 0 and h.item_pos + j >= 0 and coalesce(d.t[cast(h.pos + j + 1 as int)] = b.t[cast(h.item_pos + j + 1 as int)], false) then 1 else 0 end)"
    most = ", ".join(f"list_sum(agree[{i + 1}:{i + WINDOW}])" for i in range(WINDOW - SPAN + 1))
    return f"""
with d as ({parts('documents', 'doc_id')}), b as (select * from ({parts('benchmark', 'item_id')}) where len(t) > {SPAN}),
ds as ({placed('d')}), bs as ({placed('b')}),
h as (select ds.key id, ds.pos, bs.key item_id, bs.pos item_pos, ds.m from ds join bs on ds.m = bs.m and ds.s = bs.s),
v as (select h.*, least({WINDOW}, len(b.t)) width, {around} agree from h join d on h.id = d.key join b on h.item_id = b.key)
select id as doc_id, item_id, count(distinct (m, pos, item_pos)) as n_seeds, min(pos) as first_token, max(pos) as last_token
from v where greatest({most}) >= width - floor(width * {SUBSTITUTIONS} / {WINDOW}.0) group by id, item_id"""


#: Items of nine tokens or fewer have seeds of their own, which this leaves out: the tables have none, and the tests compare them by brute force.
SQL = _sql()
