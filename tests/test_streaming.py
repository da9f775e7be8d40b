"""A stream beside a table that changes, and quotas kept as state."""

from __future__ import annotations

from pyspark.sql import functions as F
from tests.conftest import DATA

from wayquarry.operators import rows
from wayquarry.streaming import views


def files(spark, tmp_path, parts):
    """The events of sf0.001 in files by time, in a folder; a function adds the next one."""
    events = spark.read.parquet(str(DATA / "sf0.001/events.parquet")).withColumn("ts", F.col("ts").cast("timestamp"))
    cuts = [r[0] for r in events.select(F.expr(f"percentile_approx(ts, array({', '.join(str(k / parts) for k in range(1, parts))}))")).collect()][0] if parts > 1 else []
    folder = f"file://{tmp_path}/events"

    def add(k):
        low, high = (F.lit(cuts[k - 1]) if k else None), (F.lit(cuts[k]) if k < parts - 1 else None)
        own = events.where(F.lit(True) if low is None else F.col("ts") >= low).where(F.lit(True) if high is None else F.col("ts") < high)
        own.coalesce(1).write.mode("append").parquet(folder)

    return events, folder, add


def test_a_refreshed_table(spark, tmp_path):
    """Batches see the table's version of their time: the first one until it is too old, then the second."""
    _, folder, add = files(spark, tmp_path, 3)
    side_path, now, seen = f"file://{tmp_path}/side", [0.0], []
    version = lambda n: spark.range(2000).select(F.col("id").alias("user_id"), F.lit(n).alias("version")).write.mode("overwrite").parquet(side_path)
    version(1)
    add(0)
    side = views.Refreshed(spark, side_path, 60, clock=lambda: now[0])
    query = views.beside(views.read(spark, folder), side, ["user_id"], lambda batch, n: seen.append((n, {r.version for r in batch.select("version").distinct().collect()}, batch.count())))
    run = query.option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        run.processAllAvailable()
        now[0] = 59.0
        add(1)
        run.processAllAvailable()
        version(2)
        now[0] = 61.0
        add(2)
        run.processAllAvailable()
    finally:
        run.stop()
    assert [v for _, v, n in seen if n] == [{1}, {1}, {2}]
    assert side.reads == 2
    assert sum(n for _, _, n in seen) == 1000


def test_quotas_are_those_of_the_table(spark, tmp_path):
    events, folder, add = files(spark, tmp_path, 4)
    for k in range(4):
        add(k)
    run = views.quota(views.read(spark, folder), 1, "view").writeStream.format("memory").queryName("quota").option("checkpointLocation", f"{tmp_path}/q").trigger(availableNow=True).start()
    run.awaitTermination(300)
    by_day = events.withColumn("day", F.date_trunc("day", "ts"))
    expected = rows.running_quota(by_day, F.col("event_type") == "view", [F.asc("ts"), F.asc("event_id")], 1, ["user_id", "day"])
    found = {r.event_id: r.accepted for r in spark.table("quota").collect()}
    assert found == {r.event_id: r.accepted for r in expected.collect()}
    assert sum(found.values()) > 50
