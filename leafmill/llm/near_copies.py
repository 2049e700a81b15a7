"""Near copies of whole documents: SimHash proposes, a prefix join proposes the rest, and shingle sets decide.

Fingerprints of the sets of word shingles (a bit for the majority of their hashes) are linked through Golay keys at three bits or
fewer, which finds close copies of any length by a few short keys. Sets further apart are found by the prefixes of
``ngram_join``, which miss no pair of the similarity asked for. Both only say which sets are to be compared: every link is
counted on the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import ngram_join
from leafmill.llm.arrowtext import released, sliced, utf8
from leafmill.llm.shingle_sets import shingle_sets
from leafmill.llm.simhash import _majority, golay_links
from leafmill.storage import stored


def _prints(table: DataFrame, text, words: int) -> DataFrame:
    """``(node, fp)``: the 64-bit fingerprint of each row's set; a task gives that of equal sets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in sliced(batches, 0):
            fresh = []
            for k, node in enumerate(batch.column(1).to_pylist()):
                if node not in seen:
                    seen.add(node)
                    fresh.append(k)
            own = batch.take(pa.array(fresh, pa.int64()))
            sets, at = shingle_sets(*utf8(own.column(0)), words)
            prints = [_majority(sets[a:b], 1).tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([own.column(1), pa.array(prints, pa.binary())], names=["node", "fp"])

    source = table.filter("n > 0").select(text.cast("string").alias("text"), "node")
    return source.mapInArrow(lambda batches: released(run(batches)), "node long, fp binary").distinct()


def proposed(table: DataFrame, text, words: int) -> DataFrame:
    """Edges ``(a, b)``: every set with its fingerprint's own node, where another set has that fingerprint or one three bits away at most, and these nodes."""
    prints = stored(_prints(table, text, words), "near-prints")
    sizes = prints.groupBy("fp").agg(F.count("*").alias("sets"))
    links = stored(golay_links(sizes.select("fp")), "near-links")
    node = F.xxhash64(F.lit("fingerprint"), "fp")
    linked = links.select(F.col("src").alias("fp")).union(links.select(F.col("dst").alias("fp")))
    wanted = sizes.filter("sets > 1").select("fp").union(linked).distinct()
    own = prints.join(wanted, "fp").select(F.col("node").alias("a"), node.alias("b"))
    between = links.select(F.xxhash64(F.lit("fingerprint"), "src").alias("a"), F.xxhash64(F.lit("fingerprint"), "dst").alias("b"))
    return own.union(between)


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The table of rows (see ``ngram_join.shingled``), and the groups of its sets; texts without words are one group of their own."""
    table = ngram_join.shingled(docs, F.col(f"`{text_col}`"), words, "near-rows", percent)
    own, text = F.col(f"row.`{id_col}`").cast("long"), F.col(f"row.`{text_col}`")
    groups = ngram_join.groups_of(table, own, text, words, percent, proposed(table, text, words))
    rows = table.filter("n >= 0")
    wordless = rows.filter("n = 0").groupBy("digest").agg(F.min(own).alias("component_id")).select("digest", F.col("digest").alias("component"), "component_id")
    return rows, stored(groups.select("digest", "component", "component_id").union(wordless), "near-groups")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """``(id, component_id)`` for every row: the smallest id reached over links of 100 * intersection >= percent * union of distinct shingles.

    Texts without words (null, empty, white space) are copies of each other. Ids as in ``ngram_join.similar``.
    """
    rows, groups = _grouped(docs, id_col, text_col, shingle_words, percent)
    return rows.select(F.col(f"row.`{id_col}`").cast("long").alias("id"), "digest").join(groups, "digest").select("id", "component_id")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """One whole row of each group of ``near_copies``: one with the smallest id (null last). Repeated rows count once."""
    rows, groups = _grouped(docs, id_col, text_col, shingle_words, percent)
    known = rows.select(F.col(f"row.`{id_col}`").cast("long").alias("id"), "digest", "nth").join(groups, "digest")
    first = F.min(F.when(F.col("id").eqNullSafe(F.col("component_id")), F.col("nth")))
    leaders = known.groupBy("component").agg(first.alias("leader"))
    # the numbers of rows that go are sent to the scan as bits; whole rows are not shuffled
    gone = stored(known.join(leaders, "component").filter("nth <> leader").select("nth"), "near-gone")
    return ngram_join.marked(rows, gone).filter("not marked").select("row.*")
