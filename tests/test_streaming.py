"""Streams against the batch operators, one file per micro-batch."""

import uuid

from pyspark.sql import functions as F

from pagesheaf.operators import snapshots
from pagesheaf.streaming import snapshots as streams

SCHEMA = "page_id bigint, attempt int, ts timestamp, clean boolean, height bigint, html string"


def drain(spark, tmp_path, rows, build):
    source = str(tmp_path / "in")
    for i, part in enumerate(rows):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = build(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source))
    name = "t" + uuid.uuid4().hex
    query = (stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True)
             .option("checkpointLocation", str(tmp_path / "state")).start())
    query.awaitTermination()
    return spark.table(name)


def observations():
    import datetime as dt

    start = dt.datetime(2024, 1, 1)
    heights = {1: [5, 7, 7, 7, 9], 2: [1, 2, 3, 4, 5], 3: [4, 4, 4, 4, 4]}
    return [
        [(p, a, start + dt.timedelta(minutes=a), a >= p, h[a], f"{p}-{a % 2}") for p, h in heights.items()] for a in range(5)
    ]


def test_stable_pages(spark, tmp_path):
    rows = observations()
    got = drain(spark, tmp_path, rows + [rows[1]], lambda s: streams.stream_stable_pages(s, k=2, cap=4))
    flat = spark.createDataFrame([r for part in rows for r in part], SCHEMA)
    batch = snapshots.stable_round(flat, ["height"], k=2, cap=4, initial=0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.select(got.columns).collect()))


def test_complete_pages(spark, tmp_path):
    rows = observations()
    got = drain(spark, tmp_path, rows, lambda s: streams.stream_complete_pages(s, max_retries=2))
    flat = spark.createDataFrame([r for part in rows for r in part], SCHEMA)
    batch = snapshots.pick_attempt(flat, 2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.select(got.columns).collect()))


def test_first_chunks(spark, tmp_path):
    rows = observations()
    with_id = lambda s: streams.stream_first_chunks(s.withColumn("block_id", F.lit(None).cast("string")), "1 day").select("page_id", "html")
    got = drain(spark, tmp_path, rows, with_id).collect()
    assert sorted(map(tuple, got)) == sorted({(r[0], r[5]) for part in rows for r in part})


def test_any_order_within_the_watermark_is_the_batch_decision(spark, tmp_path):
    import datetime as dt

    rows = observations()
    late = dt.datetime(2024, 1, 9)
    ends = [[(-1, 0, late, True, 1, "")], [(-1, 1, late + dt.timedelta(days=9), True, 1, "")]]
    for n, order in enumerate([(0, 2, 1, 3, 4), (4, 3, 2, 1, 0), (1, 0, 1, 4, 2, 3, 0)]):
        shuffled = [rows[i] for i in order] + ends
        flat = spark.createDataFrame([r for part in rows for r in part], SCHEMA)
        for name, build, batch in (
            ("stable", lambda s: streams.stream_stable_pages(s, k=2, cap=6), snapshots.stable_round(flat, ["height"], k=2, cap=6)),
            ("complete", lambda s: streams.stream_complete_pages(s, max_retries=4), snapshots.pick_attempt(flat, 4)),
        ):
            folder = tmp_path / f"{name}{n}"
            folder.mkdir()
            got = drain(spark, folder, shuffled, build).where("page_id > 0")
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.select(got.columns).collect())), (name, order)


def test_gap_is_closed_by_the_watermark(spark, tmp_path):
    import datetime as dt

    rows = [r for r in observations() if r[0][1] != 1]
    late = dt.datetime(2024, 1, 9)
    ends = [[(-1, 0, late + dt.timedelta(days=i), True, 1, "")] for i in range(3)]
    got = drain(spark, tmp_path, rows + ends, lambda s: streams.stream_stable_pages(s, k=2, cap=6)).where("page_id > 0")
    flat = spark.createDataFrame([r for part in rows for r in part], SCHEMA)
    batch = snapshots.stable_round(flat, ["height"], k=2, cap=6)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.select(got.columns).collect()))
