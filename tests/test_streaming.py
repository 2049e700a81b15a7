from leafmill.operators.layout import usable
from leafmill.sources import text_pages as tp
from leafmill.streaming.pages import read_stream, run_stream


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.repartition(3).write.parquet(f"{tmp_path}/in")
    source = read_stream(spark, f"{tmp_path}/in", docs.schema, 1)
    run_stream(source, lambda d: usable(tp.cells(d)), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == usable(tp.cells(docs)).count()
