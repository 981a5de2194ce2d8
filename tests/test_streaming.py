from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import references
from tidemark.streaming.orphans import OrphanStream, windowed

DAY = datetime(2022, 1, 1)
EVENT = "side string, id bigint, key string, loaded_at timestamp_ntz, deleted_at timestamp_ntz"


def event(side, i, key, start, end=None):
    return side, i, key, DAY + timedelta(days=start), None if end is None else DAY + timedelta(days=end)


def test_stream_ends_in_the_state_of_one_batch(spark, tmp_path):
    deliveries = [
        [event("parent", 0, "a", 0), event("child", 1, "a", 1), event("child", 2, "b", 1)],
        [event("parent", 0, "b", 2), event("child", 3, "b", 3)],
        [event("parent", 0, "a", 0, 4), event("child", 4, "a", 5), event("child", 5, "c", 5)],
    ]
    source = tmp_path / "in"
    for k, rows in enumerate(deliveries):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(f"{source}/d{k}")
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
    orphans = OrphanStream(spark, str(tmp_path / "state"), "child.key")
    query = orphans.start(stream, str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    assert query.exception() is None and orphans.versions() == [0, 1, 2]
    got = {(r.ref_id, r.kind) for r in orphans.state().orphans.collect()}
    assert got == {(2, "late"), (4, "deleted"), (5, "missing")}
    assert sorted(r.n_open for r in orphans.state().open_at(DAY + timedelta(days=6)).collect()) == [3]
    # a repeated micro-batch changes nothing
    orphans.apply(spark.createDataFrame(deliveries[2], EVENT), 2)
    assert {(r.ref_id, r.kind) for r in orphans.state().orphans.collect()} == got
    whole = [x for d in deliveries[:2] for x in d]
    batch = spark.createDataFrame(whole, EVENT)
    one = references.orphans(references.Reference("child.key", "id", "key"), batch.where("side = 'child'"), batch.where("side = 'parent'"))
    assert {(r.ref_id, r.kind) for r in one.collect()} == {(2, "late")}


def test_windows_leave_late_rows_out(spark, tmp_path):
    rows = [[(DAY, "a", 1.0), (DAY, "a", None), (None, "a", 5.0)], [(DAY + timedelta(days=9), "a", 2.0)], [(DAY + timedelta(days=9), "a", 2.0)], [(DAY, "a", 100.0)], [(DAY + timedelta(days=20), "b", 1.0)]]
    for k, r in enumerate(rows):
        spark.createDataFrame(r, "t timestamp, k string, v double").coalesce(1).write.parquet(f"{tmp_path}/in/d{k}")
    stream = spark.readStream.schema("t timestamp, k string, v double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = windowed(stream, "t", "v", "k").writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.k, r.n, r.total) for r in spark.table("windows").select("k", "n", F.round("total", 2).alias("total")).collect()}
    assert ("a", 2, 1.0) in got and all(t != 101.0 for _, _, t in got)
