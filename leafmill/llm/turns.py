"""Repair of conversation structure by error-correcting Earley parsing.

A weighted role grammar says what a conversation may be; delete, rerole and insert are productions that cost. A
conversation is parsed from its end to its start: the chart's items (production, dot, origin) hold the least (cost, audit),
audit being the initials of the edits in reading order, so an edit that is found is put before those of all later rows, and the
least audit of the rest is part of the least whole. What completes the start symbol over all rows is the repair.

Rows stream through sorted by conversation and turn. Of a conversation the parser holds a role initial and a fault for each
row, and its charts; texts pass by once more, behind their audit, into a running hash. A conversation is one task's work
as its digest is one sequence, but it is never gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.arrowtext import released
from leafmill.storage import stored

#: What edits cost. Each undeleted truncated row costs TRUNCATED more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Roles that a row may be given or a missing row may have, by the terminal they stand for.
GIVEN = {"u": "user", "a": "assistant"}
#: (s?(ua)+)?, left-recursive and mirrored, as rows are read from the last to the first.
GRAMMAR = (("start", ()), ("start", ("turns",)), ("start", ("turns", "s")), ("turns", ("a", "u")), ("turns", ("turns", "a", "u")))
BLANK, DUPLICATE, CUT, WHOLE = "b", "d", "t", "."

#: An audit: its first edit and the rest, which charts share; None is the empty one.
Audit = tuple[str, "Audit"] | None


def _before(a: Audit, b: Audit) -> bool:
    """Whether audit a is ASCII-less than b."""
    while a is not b:
        if a is None or b is None:
            return a is None
        if a[0] != b[0]:
            return a[0] < b[0]
        a, b = a[1], b[1]
    return False


def _spelled(audit: Audit) -> str:
    out = []
    while audit is not None:
        out.append(audit[0])
        audit = audit[1]
    return "".join(out)


def _joined(first: Audit, rest: Audit) -> Audit:
    if rest is None:
        return first
    for edit in reversed(_spelled(first)):
        rest = (edit, rest)
    return rest


class Chart:
    """Earley sets of a row sequence read backwards; items (production, dot, origin) with their least (cost, audit)."""

    def __init__(self, grammar: tuple = GRAMMAR):
        self.grammar = grammar
        self.heads: dict[str, list[int]] = {}
        for n, (head, _) in enumerate(grammar):
            self.heads.setdefault(head, []).append(n)
        #: by origin, and the symbol that is awaited there: items that a completed one moves on
        self.waiting: list[dict[str, dict[tuple[int, int, int], tuple[int, Audit]]]] = []
        self.items: dict[tuple[int, int, int], tuple[int, Audit]] = {}
        #: of this set and the one before, so that equal audits are one object and comparing them ends at once
        self.known: dict[tuple[str, int], Audit] = {}
        self._open({(n, 0, 0): (0, None) for n in self.heads["start"]})

    def _open(self, seeds: dict) -> None:
        """Close a set under predicting, inserting and completing, from the items that reached it."""
        self.items = {}
        here = len(self.waiting)
        self.waiting.append({})
        agenda = [(item, value) for item, value in seeds.items()]
        while agenda:
            item, value = agenda.pop()
            had = self.items.get(item)
            if had is not None and (value[0] > had[0] or value[0] == had[0] and not _before(value[1], had[1])):
                continue
            self.items[item] = value
            production, dot, origin = item
            head, body = self.grammar[production]
            if dot == len(body):
                for (p, d, o), (cost, audit) in list(self.waiting[origin].get(head, {}).items()):
                    agenda.append(((p, d + 1, o), (cost + value[0], _joined(value[1], audit))))
                continue
            wanted = body[dot]
            self.waiting[here].setdefault(wanted, {})[item] = value
            if wanted in self.heads:
                agenda += [((n, 0, here), (0, None)) for n in self.heads[wanted] if (n, 0, here) not in self.items]
                done = [(i, v) for i, v in self.items.items() if i[2] == here and self.grammar[i[0]][0] == wanted and i[1] == len(self.grammar[i[0]][1])]
                agenda += [((production, dot + 1, origin), (value[0] + v[0], _joined(v[1], value[1]))) for _, v in done]
            elif wanted in GIVEN:
                agenda.append(((production, dot + 1, origin), (value[0] + INSERT, self._put("I", value[1]))))

    def _put(self, edit: str, rest: Audit) -> Audit:
        return self.known.setdefault((edit, id(rest)), (edit, rest))

    def read(self, initial: str, fault: str) -> None:
        """One more row, towards the start."""
        held, self.known = self.known, {}
        reached: dict[tuple[int, int, int], tuple[int, Audit]] = {}

        def reach(item: tuple[int, int, int], cost: int, edit: str, rest: Audit) -> None:
            had = reached.get(item)
            value = (cost, self._put(edit, rest))
            if had is None or cost < had[0] or cost == had[0] and _before(value[1], had[1]):
                reached[item] = value

        stays = KEEP if fault == WHOLE else TRUNCATED
        for item, (cost, audit) in self.items.items():
            production, dot, origin = item
            head, body = self.grammar[production]
            # a row goes before the terminal that follows it, or behind all of them: one derivation for each set of edits
            if body[dot] not in self.heads if dot < len(body) else head == "start":
                reach(item, cost + DELETE, "D", audit)
            if dot < len(body) and fault in (WHOLE, CUT):
                moved = (production, dot + 1, origin)
                if body[dot] == initial:
                    reach(moved, cost + stays + KEEP, "K", audit)
                if body[dot] in GIVEN:
                    reach(moved, cost + stays + REROLE, "R", audit)
        self._open(reached)
        del held  # until here its audits were alive, so no new one has the address of an old one

    def best(self) -> tuple[int, str]:
        """Cost and audit of the cheapest repair of all rows read."""
        done = [v for (n, dot, origin), v in self.items.items() if origin == 0 and self.grammar[n][0] == "start" and dot == len(self.grammar[n][1])]
        least = done[0]
        for value in done[1:]:
            if value[0] < least[0] or value[0] == least[0] and _before(value[1], least[1]):
                least = value
        return least[0], _spelled(least[1])


def parsed(initials: str, faults: str) -> tuple[int, str]:
    """Cost and audit of the cheapest repair; an initial and a fault for each row, in order."""
    chart = Chart()
    for initial, fault in zip(reversed(initials), reversed(faults), strict=True):
        chart.read(initial, fault)
    return chart.best()


_parsed_short = lru_cache(1 << 14)(parsed)


def repair(initials: str, faults: str) -> tuple[int, str]:
    return _parsed_short(initials, faults) if len(initials) <= 64 else parsed(initials, faults)


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"[^\x20\x09-\x0D]")


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, turn, role, text)``: rows with a fault by the hash of conversation and turn; nulls count as one space."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col(f"`{conv}`").cast("string"), space), F.lit(":"), F.coalesce(F.col(f"`{turn}`").cast("string"), space))
    own = rows.select(F.col(f"`{conv}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role}`").cast("string"), space).alias("role"), F.coalesce(F.col(f"`{text}`").cast("string"), space).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("h"))
    kind = F.col("h")
    out = own.filter("h <> 0")
    out = out.withColumn("text", F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    out = out.withColumn("role", F.when(kind == 4, "user").otherwise(F.col("role")))
    again = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return out.select("conv_id", "turn", "role", "text", again.alias("again")).drop("again")


def faulted(rows: DataFrame) -> DataFrame:
    """Adds ``pos`` (in the conversation, by turn, nulls first, then role and text), ``initial`` and ``fault`` of each row.

    A row whose role and text an earlier one has is found by numbering equal rows, so no conversation is gathered.
    """
    last = F.right(F.regexp_replace("text", r"[\x20\x09-\x0D]+\z", ""), F.lit(1))
    nth = F.row_number().over(Window.partitionBy("conv_id", "role", F.sha2("text", 256)).orderBy(F.asc_nulls_first("turn")))
    rows = rows.withColumn("nth", nth)
    fault = F.when(is_blank(F.col("text")), BLANK).when(F.col("nth") > 1, DUPLICATE).when(~last.isin(".", "!", "?"), CUT).otherwise(WHOLE)
    by = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text", "nth")
    return rows.withColumn("fault", fault).withColumn("pos", F.row_number().over(by)).withColumn("initial", F.substring("role", 1, 1)).drop("nth")


REPAIRS = "conv_id long, cost long, audit string"


def repairs(rows: DataFrame) -> DataFrame:
    """``(conv_id, cost, audit)`` of every conversation of ``(conv_id, pos, initial, fault)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, initials, faults = (None,), [], []
        for batch in batches:
            out: list[tuple] = []
            for conv, initial, fault in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if (conv,) != last:
                    if initials:
                        out.append((last[0], *repair_of(initials, faults)))
                    last, initials, faults = (conv,), [], []
                initials.append(initial)
                faults.append(fault)
            yield made(out)
        if initials:
            yield made([(last[0], *repair_of(initials, faults))])

    def repair_of(initials: list[str], faults: list[str]) -> tuple[int, str]:
        # an initial of no character, or of one outside the grammar, is as good as any other: one character stands for it
        return repair("".join(x if x in ("s", "u", "a") else "-" for x in initials), "".join(faults))

    def made(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["conv_id", "cost", "audit"])

    source = rows.select("conv_id", "initial", "fault", "pos").repartition("conv_id").sortWithinPartitions("conv_id", "pos").drop("pos")
    return source.mapInArrow(lambda batches: released(run(batches)), REPAIRS)


def repaired(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """``(conv_id, pos, role, text, edit)``: the rows that a repair leaves, in the order of ``pos`` (from one); a row that stays
    where it was, one of a new role, or one put in with an empty text.
    """
    edits = repairs.select("conv_id", F.posexplode(F.split("audit", "")).alias("k", "edit")).filter("edit <> ''")
    upto = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    edits = edits.select("conv_id", "edit", F.sum((F.col("edit") != "I").cast("int")).over(upto).alias("row"), F.sum((F.col("edit") != "D").cast("int")).over(upto).alias("pos"))
    edits = edits.filter("edit <> 'D'")
    own = rows.select(F.col("conv_id").alias("c"), F.col("pos").alias("p"), "role", "text", "initial")
    joined = edits.join(own, (F.col("edit") != "I") & F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("row") == F.col("p")), "left")
    system = F.max(((F.col("pos") == 1) & (F.col("edit") == "K") & (F.col("initial") == "s")).cast("int")).over(Window.partitionBy("conv_id"))
    given = F.when((F.col("pos") - system) % 2 == 1, GIVEN["u"]).otherwise(GIVEN["a"])
    role = F.when(F.col("edit") == "K", F.col("role")).otherwise(given)
    return joined.select("conv_id", F.col("pos").cast("int").alias("pos"), role.alias("role"), F.coalesce("text", F.lit("")).alias("text"), "edit")


def digests(kept: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)`` of repaired rows as ``role:text`` lines; texts stream by, in order, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, running = None, None
        for batch in batches:
            ids, out = [], []
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if running is None or conv != last:
                    if running is not None:
                        ids.append(last)
                        out.append(running.hexdigest())
                    last, running = conv, hashlib.sha256()
                else:
                    running.update(b"\n")
                running.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["conv_id", "repaired_sha256"])
        if running is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([running.hexdigest()])], names=["conv_id", "repaired_sha256"])

    source = kept.repartition("conv_id").sortWithinPartitions("conv_id", "pos").select("conv_id", "role", "text")
    return source.mapInArrow(lambda batches: released(run(batches)), "conv_id long, repaired_sha256 string")


def report(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each conversation of ``ids`` (conv_id, repeated or not), of the faults and the repair of ``rows``.

    Rows without an id are one conversation. A conversation without rows has zeros, an empty audit and the hash of nothing; an
    empty table gives an empty result.
    """
    own = stored(faulted(rows), "turns-faulted")
    by = Window.partitionBy("conv_id").orderBy("pos")
    legal = F.concat(F.lag("initial").over(by), F.col("initial")).isin("su", "ua", "au")
    stepped = own.select("conv_id", "turn", "fault", (F.lag("pos").over(by).isNotNull() & ~legal).cast("int").alias("illegal"))
    per_turn = stepped.groupBy("conv_id", "turn").agg(*(F.sum((F.col("fault") == k).cast("int")).alias(n) for k, n in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (CUT, "truncated"))), F.sum("illegal").alias("illegal"))
    counted = per_turn.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"), *(F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated", "illegal")))
    found = stored(repairs(own), "turns-repairs")
    hashed = digests(repaired(own, found))
    out = ids.select("conv_id").distinct()
    for part in (counted, found, hashed):
        part = part.withColumnRenamed("conv_id", "own id")
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col("own id")), "left").drop("own id")
    numbers = (F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return report(rows.select(F.col("conv_id").cast("long").alias("conv_id")), damaged(rows))


def _sql() -> str:
    """The same repair as a table of suffixes: for each row from the last, the least ``cost, audit`` from four states of the grammar."""

    def plus(value: str, cost: str, edit: str) -> str:
        return f"(lpad(cast(cast(left({value}, 9) as bigint) + {cost} as varchar), 9, '0') || '{edit}' || substr({value}, 10))"

    moves = {"q0": (("s", "q1"), ("u", "q2")), "q1": (("u", "q2"),), "q2": (("a", "q3"),), "q3": (("u", "q2"),)}
    direct = []
    for q, ways in moves.items():
        options = [plus(f"f.{q}", str(DELETE), "D")]
        for initial, to in ways:
            options.append(f"case when o.fault in ('.', 't') and o.i = '{initial}' then {plus(f'f.{to}', 'o.more', 'K')} end")
            if initial in GIVEN:
                options.append(f"case when o.fault in ('.', 't') then {plus(f'f.{to}', f'o.more + {REROLE}', 'R')} end")
        direct.append(f"least({', '.join(options)}) as {q}")
    nexts = {"q0": "q2", "q1": "q2", "q2": "q3", "q3": "q2"}
    closed = [f"least({q}, {plus(nexts[q], str(INSERT), 'I')}, {plus(nexts[nexts[q]], str(2 * INSERT), 'II')}) as {q}" for q in moves]
    crc = "list_reduce(range(0, 8 * length(k)), lambda c, j: xor(xor(c, case when j % 8 = 0 then ascii(substr(k, cast(j // 8 + 1 as int), 1)) else 0 end) >> 1, 3988292384 * (xor(c, case when j % 8 = 0 then ascii(substr(k, cast(j // 8 + 1 as int), 1)) else 0 end) & 1)), 4294967295)"
    return rf"""
with recursive b as (select row_number() over () rid, conv_id, turn, coalesce(role, ' ') r, coalesce(text, ' ') x, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') k from conversations),
h as (select *, xor(cast({crc} as bigint), 4294967295) % 20 h from b),
d as (select conv_id, turn, case when h = 4 then 'user' else r end r, case h when 1 then '' when 2 then regexp_replace(x, '[.!?]', '', 'g') else x end x, unnest(case when h = 3 then [0, 1] else [0] end) again from h where h <> 0),
m as materialized (select *, row_number() over (partition by conv_id, r, x order by turn nulls first) nth from d),
o as materialized (select conv_id, turn, r, x, row_number() over (partition by conv_id order by turn nulls first, r, x, nth) pos, substr(r, 1, 1) i,
  case when not regexp_matches(x, '[^\x20\x09-\x0D]') then 'b' when nth > 1 then 'd' when not regexp_matches(x, '[.!?][\x20\x09-\x0D]*$') then 't' else '.' end fault from m),
p as materialized (select *, case when fault = 't' then {TRUNCATED} else 0 end more, lag(i) over (partition by conv_id order by pos) || i pair from o),
c as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (fault = 'b') blank, count(*) filter (fault = 'd') duplicate, count(*) filter (fault = 't') truncated,
  count(*) filter (pair is not null and pair not in ('su', 'ua', 'au')) illegal from p group by conv_id),
f as (select conv_id, count(*) pt, '000000000' q0, '000000010II' q1, '000000005I' q2, '000000000' q3 from p group by conv_id
  union all select conv_id, pt, {", ".join(closed)} from (select f.conv_id, f.pt - 1 pt, {", ".join(direct)} from f join p o on o.conv_id is not distinct from f.conv_id and o.pos = f.pt) g),
a as materialized (select conv_id, cast(left(q0, 9) as bigint) cost, substr(q0, 10) audit from f where pt = 0),
e0 as (select conv_id, audit, unnest(range(1, length(audit) + 1)) k from a),
e1 as (select conv_id, k, substr(audit, cast(k as int), 1) e, length(replace(substr(audit, 1, cast(k as int)), 'I', '')) pt, length(replace(substr(audit, 1, cast(k as int)), 'D', '')) n from e0),
e2 as (select e1.*, p.r, p.x, max(case when e = 'K' and n = 1 and p.i = 's' then 1 else 0 end) over (partition by e1.conv_id) s from e1 left join p on e <> 'I' and p.conv_id is not distinct from e1.conv_id and p.pos = e1.pt where e <> 'D'),
t as (select conv_id, sha256(string_agg((case when e = 'K' then r when (n - s) % 2 = 1 then 'user' else 'assistant' end) || ':' || coalesce(x, ''), chr(10) order by k)) digest from e2 group by conv_id)
select w.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost,
  coalesce(audit, '') as audit, coalesce(digest, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) w left join c on c.conv_id is not distinct from w.conv_id left join a on a.conv_id is not distinct from w.conv_id left join t on t.conv_id is not distinct from w.conv_id"""


SQL = _sql()
