"""URL filter: host and path rules first, then a weighted vocabulary by Aho-Corasick.

One automaton finds every term in a batch's URLs; a hit counts only between boundaries (no letter or digit
beside it). One strict term rejects, or several distinct soft terms whose weights sum to the limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from leafmill.llm.arrowtext import sliced

#: Fixed values: (action, host, path prefix).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Terms that reject alone.
STRICT = ("porn", "xxx", "sex", "casino", "viagra", "cialis", "escort", "hentai", "torrent", "warez")
#: Terms that reject together, with their weights.
SOFT = {
    "ads": 1, "adult": 2, "bet": 2, "bonus": 1, "cam": 1, "cheap": 1, "click": 1, "credit": 1, "dating": 2, "deal": 1,
    "discount": 1, "farm": 1, "free": 1, "gambling": 2, "hot": 1, "loan": 2, "pharmacy": 1, "pills": 2, "poker": 2,
    "slots": 2, "spam": 2, "win": 2,
}
#: Weight from which two distinct soft terms or more reject.
SOFT_LIMIT = 3
#: Terms and rules that a table may have: they are shipped to every task.
MOST_TERMS = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The text after the first ``://`` up to ``/ ? #``, A-Z lower-cased; the rest up to ``? #``."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    has = url.isNotNull() & (at > 0)
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def load_vocabulary(table: DataFrame, most: int = MOST_TERMS) -> tuple[set[str], dict[str, int]]:
    """Strict and soft terms of ``(term string, weight int)``: a null weight makes a term strict.

    Terms are lower-cased (A-Z); of several weights of a term the largest counts, and a strict one counts as strict
    only; null and empty terms are passed over. A table of over ``most`` terms is refused, never cut.
    """
    rows = table.select(F.translate("term", _UPPER, _LOWER).alias("term"), F.col("weight").cast("int").alias("weight")).filter("term <> ''")
    found = rows.groupBy("term").agg(F.max("weight").alias("weight"), F.bool_or(F.isnull("weight")).alias("strict")).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"over {most} terms")
    return {r.term for r in found if r.strict}, {r.term: r.weight for r in found if not r.strict}


def _rule_table(rules) -> dict[str, list[tuple[str, str]]]:
    """Paths and verdicts by host."""
    if len(rules) > MOST_TERMS:
        raise ValueError(f"over {MOST_TERMS} rules")
    table: dict[str, list[tuple[str, str]]] = {}
    for verdict, host, path in rules:
        table.setdefault(host, []).append((path, verdict))
    return table


def _best_rule(table: dict[str, list[tuple[str, str]]], host: str, path: str) -> tuple[str | None, str | None]:
    """The longest rule for the host or a domain above it: looked up by each of its suffixes."""
    best: tuple[int, str | None, str | None] = (-1, None, None)
    at = 0
    while True:
        own = host[at:]
        for prefix, verdict in table.get(own, ()):
            if path.startswith(prefix):
                best = max(best, (len(own) + len(prefix), own + prefix, verdict), key=lambda x: x[0])
        dot = host.find(".", at)
        if dot < 0:
            return best[1], best[2]
        at = dot + 1


def scan_terms(urls: DataFrame, strict=STRICT, soft=None, rules=()) -> DataFrame:
    """Adds ``strict_hits``, ``soft_hits`` (distinct, sorted), the soft hits' ``weight``, and ``rule`` and ``action`` of ``host`` and ``path``, for column ``url``."""
    soft = SOFT if soft is None else soft
    hard_terms, table = frozenset(strict), _rule_table(rules)
    added = [StructField("strict_hits", ArrayType(StringType())), StructField("soft_hits", ArrayType(StringType())), StructField("weight", LongType()), StructField("rule", StringType()), StructField("action", StringType())]
    schema = StructType([*urls.schema.fields, *added])
    where = {c: urls.columns.index(c) for c in ("url", "host", "path")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ahocorasick.Automaton()
        for term in {*hard_terms, *soft}:
            machine.add_word(term, term)
        if len(machine):
            machine.make_automaton()
        fold = str.maketrans(_UPPER, _LOWER)
        for batch in sliced(batches, where["url"]):
            hard, mild, weights, names, actions = [], [], [], [], []
            for url, host, path in zip(*(batch.column(where[c]).to_pylist() for c in ("url", "host", "path")), strict=True):
                found = set()
                text = (url or "").translate(fold)
                if text and len(machine):
                    for end, term in machine.iter(text):
                        start = end - len(term)
                        if not (start >= 0 and _word(text[start])) and not (end + 1 < len(text) and _word(text[end + 1])):
                            found.add(term)
                hard.append(sorted(found & hard_terms))
                mild.append(sorted(t for t in found if t in soft))
                weights.append(sum(soft[t] for t in mild[-1]))
                name, action = _best_rule(table, host or "", path or "") if host else (None, None)
                names.append(name)
                actions.append(action)
            kind = pa.list_(pa.string())
            more = [pa.array(hard, kind), pa.array(mild, kind), pa.array(weights, pa.int64()), pa.array(names, pa.string()), pa.array(actions, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=schema.names)

    return urls.mapInArrow(run, schema)


def _word(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, strict=STRICT, soft=None, limit: int = SOFT_LIMIT) -> DataFrame:
    """``(id, host, path, rule, verdict, strict_hits, soft_hits, weight)`` for every row.

    The longest rule that fits decides; without one, the vocabulary: block on a strict term, or on two distinct soft
    terms or more of ``limit`` or more in weight, else allow. Null urls and urls without ``://`` have empty host and
    path; the vocabulary still reads them. Repeated rows and null ids come back as they are; an empty table gives
    an empty result; other columns are not looked at.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"))
    rows = scan_terms(rows.withColumn("host", host).withColumn("path", path), strict, soft, rules)
    bad = (F.size("strict_hits") > 0) | ((F.size("soft_hits") > 1) & (F.col("weight") >= limit))
    return rows.select("id", "host", "path", "rule", F.coalesce("action", F.when(bad, "block").otherwise("allow")).alias("verdict"), "strict_hits", "soft_hits", "weight")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", F.size("strict_hits").cast("long").alias("n_strict"), F.size("soft_hits").cast("long").alias("n_soft"))


def _sql() -> str:
    def hits(terms) -> str:
        return " + ".join(f"cast(regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') as bigint)" for t in terms)

    def case(result) -> str:
        longest = sorted(RULES, key=lambda r: -(len(r[1]) + len(r[2])))
        whens = " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{result(a, h, p)}'" for a, h, p in longest)
        return f"case {whens} end"

    weights = " + ".join(f"{w} * cast(regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') as bigint)" for t, w in SOFT.items())
    return f"""
with parts as (
  select page_id, translate(coalesce(url, ''), '{_UPPER}', '{_LOWER}') as low,
    case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest
  from pages),
split as (
  select page_id, low,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}'), '') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path
  from parts),
judged as (
  select page_id, host, path, {case(lambda a, h, p: h + p)} as rule, {case(lambda a, h, p: a)} as action,
    {hits(STRICT)} as n_strict, {hits(SOFT)} as n_soft, {weights} as weight
  from split)
select page_id, host, path, rule,
  coalesce(action, case when n_strict > 0 or n_soft > 1 and weight >= {SOFT_LIMIT} then 'block' else 'allow' end) as verdict,
  n_strict, n_soft
from judged"""


SQL = _sql()
