"""Confidence roll-ups, document status, errors and timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.scores import grade, mean_of, quantile_of

PAGE = ("doc_id", "page_no")
SCORES = ("parse_score", "layout_score", "table_score", "ocr_score")


def page_confidence(pages: DataFrame) -> DataFrame:
    """Adds mean_score, low_score and their grades."""
    cols = [F.col(c) for c in SCORES]
    out = pages.withColumn("mean_score", mean_of(*cols)).withColumn("low_score", quantile_of(0.05, *cols))
    return out.withColumn("mean_grade", grade(F.col("mean_score"))).withColumn("low_grade", grade(F.col("low_score")))


def document_confidence(pages: DataFrame) -> DataFrame:
    """Means over pages, but the 10 % quantile of parse scores; mean and low score are means of the pages' own."""
    out = pages.groupBy("doc_id").agg(
        F.expr("percentile(parse_score, 0.1)").alias("parse_score"), *(F.avg(c).alias(c) for c in ("layout_score", "table_score", "ocr_score", "mean_score", "low_score"))
    )
    return out.withColumn("mean_grade", grade(F.col("mean_score"))).withColumn("low_grade", grade(F.col("low_score")))


def document_status(pages: DataFrame, timed_out: Column | None = None) -> DataFrame:
    """``(doc_id, n_ok, n_failed, n_expected, status)`` from page outcomes (ok: true, false, or null if never fed)."""
    out = pages.groupBy("doc_id").agg(F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"), F.count("*").alias("n_expected"), F.max(F.lit(False) if timed_out is None else timed_out).alias("timed_out"))
    status = F.when(F.col("timed_out"), "partial_success").when((F.col("n_ok") == 0) & (F.col("n_failed") > 0), "failure").when(F.col("n_ok") < F.col("n_expected"), "partial_success").otherwise("success")
    return out.withColumn("status", status).drop("timed_out")


def page_errors(pages: DataFrame) -> DataFrame:
    """``(doc_id, errors)``: an error for each failed page, in page order."""
    where = F.when(F.col("page_no") > 0, F.concat(F.lit("Page "), F.col("page_no").cast("string"), F.lit(": "))).otherwise("Unknown page: ")
    text = F.concat(where, F.coalesce("error", F.lit("unknown error")))
    item = F.struct("page_no", F.lit("pipeline").alias("component_type"), F.lit("page").alias("module_name"), text.alias("error_message"))
    errors = pages.filter(~F.col("ok")).groupBy("doc_id").agg(F.sort_array(F.collect_list(item)).alias("errors"))
    return errors.withColumn("errors", F.transform("errors", lambda e: e.dropFields("page_no")))


def timings(rows: DataFrame) -> DataFrame:
    """``(key, scope, elapsed)`` to count, total, mean, population deviation and the 90 % percentile."""
    return rows.groupBy("key", "scope").agg(
        F.count("*").alias("n"), F.sum("elapsed").alias("total"), F.avg("elapsed").alias("mean"), F.stddev_pop("elapsed").alias("std"), F.expr("percentile(elapsed, 0.9)").alias("p90")
    )


def timed(pages: DataFrame, timeout: float) -> DataFrame:
    """Adds ``fed`` and ``timed_out``: pages go one after the other, none is begun once ``timeout`` seconds of ``elapsed`` are over."""
    before = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("elapsed").over(before), F.lit(0.0))
    total = F.coalesce(F.sum("elapsed").over(Window.partitionBy("doc_id")), F.lit(0.0))
    return pages.withColumn("fed", spent <= timeout).withColumn("timed_out", total > timeout)


def raise_unless_ok(results: DataFrame, order: str = "doc_id") -> None:
    """Raise for the first unsuccessful document in input order (of ``order``); an empty result raises too."""
    good = F.col("status").isin("success", "partial_success")
    first = results.select(order, "file", "status", "errors").orderBy(F.when(good, 1).otherwise(0), order).limit(1).collect()
    if not first:
        raise RuntimeError("nothing was converted")
    if first[0]["status"] not in ("success", "partial_success"):
        raise RuntimeError(f"{first[0]['file']}: {first[0]['status']}: {first[0]['errors']}")
