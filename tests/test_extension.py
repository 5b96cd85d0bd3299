"""Extension points: table function, providers, pipeline stages, listener, readers."""

from pyspark.sql import functions as F

from docketforge.functions import udtf
from docketforge.operators import providers
from docketforge.sources import readers
from docketforge.streaming import streams
from docketforge.streaming.listener import MetricsListener


def test_table_function(spark):
    udtf.register(spark)
    rows = spark.sql("select id, r.* from values (1, 'call 555-123-4567'), (2, null), (3, '') t(id, text), lateral redactions(t.text) r").collect()
    assert [(r.id, r.item_no, r.pii_type, r.hit) for r in rows] == [(1, 1, "phone", "555-123-4567")]


def test_cascade_marks_and_trusts_the_last_less(spark):
    providers.register("never", lambda b: F.when(F.lit(False), providers.rules(b)))
    df = spark.createDataFrame([(1, "motion to dismiss"), (2, "")], "id int, t string").select("id", providers.cascade(F.col("t"), ["never", "rules"]).alias("r"), providers.rules(F.col("t")).alias("p"))
    got = {r.id: r for r in df.collect()}
    assert got[1].r.summary.startswith("[EXPENSIVE FALLBACK] ") and abs(got[1].r.confidence - 0.9 * got[1].p.confidence) < 1e-9
    assert (got[2].r.document_type, got[2].r.confidence) == ("other", 0.1)


def test_pipeline_keeps_its_steps(spark):
    out = providers.pipeline(spark.range(1), [("a", lambda d: d.withColumn("x", F.lit(1))), ("b", lambda d: d.drop("x"))]).first()
    assert out.steps == ["a", "b"]


def test_registered_reader(spark, tmp_path):
    readers.register("txt", lambda c: (c.decode().upper(), 1))
    try:
        (tmp_path / "a.txt").write_text("up")
        assert readers.extract(spark, str(tmp_path)).first().text == "UP"
    finally:
        readers.register("txt", readers.read_txt)


def test_listener_sees_batches(spark, sf):
    listener = MetricsListener()
    spark.streams.addListener(listener)
    try:
        streams.run_to_table(streams.windowed(streams.read_events(spark, sf)), "complete").count()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    finally:
        spark.streams.removeListener(listener)
    assert not listener.failed
