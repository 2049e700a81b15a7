"""Documents out of streamed pages: as the batch has it, timers, restarts, repeated and late pages."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from leafmill.operators import status
from leafmill.streaming.documents import PROVIDER, completed_documents

PAGES = "doc_id long, page_no int, page_count int, ok boolean, error string, ts timestamp"


def test_documents_complete_by_pages_or_by_timer(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        zero = datetime(2024, 1, 1)
        rows = [(d, p, 1 + d % 4, (d + p) % 5 != 0, None if (d + p) % 5 else "bad page", zero + timedelta(seconds=d)) for d in range(40) for p in range(1, 2 + d % 4)]
        short = {d for d in range(40) if d % 4 == 3 and d % 3 == 0}  # these lack their last page
        fed = [r for r in rows if not (r[0] in short and r[1] == r[2])]
        parts = [[r for k, r in enumerate(fed) if k % 3 == n] for n in range(3)]
        parts[1] += parts[0][:10]  # sent again
        parts[1].append((None, 1, 1, True, None, zero))

        def feed(part: list) -> None:
            spark.createDataFrame(part, PAGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(PAGES).parquet(f"{tmp_path}/in")
            made = completed_documents(stream, timedelta(seconds=100), "200 seconds").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
            made.trigger(availableNow=True).start().awaitTermination()  # a new query each time: all it knows is in its checkpoint

        for part in parts:
            feed(part)
        ended = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
        assert set(ended) == set(range(40)) - short
        pages = spark.createDataFrame([r for r in rows if r[0] not in short], PAGES)
        want = status.document_status(pages).join(status.page_errors(pages), "doc_id", "left")
        for r in want.withColumn("errors", F.coalesce("errors", F.array().cast("array<struct<component_type:string,module_name:string,error_message:string>>"))).collect():
            assert tuple(r) == (r.doc_id, *(ended[r.doc_id][k] for k in ("n_ok", "n_failed", "n_expected", "status", "errors")))
        feed([(900, 1, 1, True, None, zero + timedelta(seconds=1000))])
        feed([(901, 1, 1, True, None, zero + timedelta(seconds=1001)), *[r for r in rows if r[0] in short and r[1] == r[2]]])  # pages that come too late
        out = spark.read.parquet(f"{tmp_path}/out").collect()
        assert len(out) == len({r.doc_id for r in out}) == 42
        for r in out:
            if r.doc_id in short:
                assert r.status == "partial_success" and r.n_expected == 1 + r.doc_id % 4 == r.n_ok + r.n_failed
                assert r.errors[-1].error_message == f"Page {r.n_expected}: document timeout exceeded"
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
