"""Operators that cut hot keys and long columns into pieces, against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfunnel.operators import attribution as at
from wayfunnel.operators import ranks


def test_as_of_with_a_third_of_the_log_in_one_visit_and_day(spark):
    r = random.Random(2)

    def moment(hot):
        return f"2024-01-01 10:00:{r.randrange(60):02d}" if hot else f"2024-01-{r.randrange(1, 5):02d} {r.randrange(24):02d}:00:00"

    events = [(i, 7 if i % 3 == 0 else r.randrange(40), moment(i % 3 == 0)) for i in range(3000)] + [(9000, None, moment(False)), (9001, 7, None)]
    states = [(i, 7 if i % 50 == 0 else r.randrange(40), moment(i % 50 == 0), f"s{i}") for i in range(400)] + [(900, None, moment(False), "n"), (901, 7, None, "n")]
    e = spark.createDataFrame(events, "id long, k long, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    s = spark.createDataFrame(states, "sid long, k long, t string, v string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    want = {}
    for i, k, t in events:
        before = [(x[2], x[0], x[3]) for x in states if x[1] == k is not None and x[2] is not None and t is not None and x[2] <= t]
        want[i] = max(before)[2] if before else None
    for piece_rows in (100, 10 ** 6):
        assert {x.id: x.state_v for x in at.as_of_last(e, s, "k", "t", "sid", ["v"], piece_rows).collect()} == want
    pieces = at.timeline_pieces(e, s, "k", "t", "sid", ["v"], 100).filter("k = 7").groupBy("_piece").count().collect()
    assert len(pieces) >= 8 and max(x["count"] for x in pieces) <= 300


@pytest.mark.parametrize("few", [20, 100_000])
def test_selection_equals_numpy(spark, monkeypatch, few):
    monkeypatch.setattr(ranks, "FEW_ROWS", few)
    monkeypatch.setattr(ranks, "ACCURACY", 100)
    r = np.random.default_rng(1)
    probs = {"lo": 0.05, "q1": .25, "mid": .5, "q3": .75, "hi": .95, "all": 1.0, "none": 0.0}
    for data in (r.normal(size=5000), r.integers(0, 4, 3000).astype(float), np.ones(500), r.normal(size=1), np.concatenate([np.zeros(2000), r.normal(size=50)])):
        df = spark.createDataFrame([(float(x),) for x in data] + [(None,)], "x double")
        row = ranks.quantiles(df, "x", probs).first()
        for name, p in probs.items():
            assert math.isclose(row[name], float(np.quantile(data, p)), abs_tol=1e-12), (name, len(data))
    assert ranks.quantiles(spark.createDataFrame([(None,)], "x double"), "x", {"q": .5}).first().q is None


def test_ranges_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(ranks, "RANGE_ROWS", 50)
    df = spark.range(20_000).select((F.xxhash64("id") / 1e12).alias("x"), F.col("id"))
    ranged = ranks.with_range(df, df, "x", "x").groupBy("_range").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("_range").collect()
    assert len(ranged) > 350 and max(x.n for x in ranged) <= 200
    assert all(a.hi < b.lo for a, b in zip(ranged, ranged[1:]))
    placed = ranks.with_position(df, "x", "id", "p").toPandas().sort_values("x", ascending=False)
    assert placed["p"].tolist() == list(range(1, 20_001))


def test_upsert_writes_touched_buckets_and_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    from wayfunnel.sinks import writers as wr
    from wayfunnel.sinks.log import CommitLog
    path, schema = str(tmp_path / "t"), "id long, v string, load_seq long"

    def stored():
        return {(r.id, r.v) for r in wr.current_version(spark, path).collect()}

    wr.upsert(spark.range(400).selectExpr("id", "'a' v", "1L load_seq"), path, ["id"], buckets=16)
    log = CommitLog(spark, f"{path}/_log")
    first = log.newest()[1]["files"]
    wr.upsert(spark.createDataFrame([(5, "b", 2), (5, "old", 1)], schema), path, ["id"])
    second = log.newest()[1]["files"]
    assert sum(first[b] != second[b] for b in first) == 1 and len(first) == 16
    assert stored() == {(i, "b" if i == 5 else "a") for i in range(400)}
    # another writer takes the number between merge and commit, once on the same buckets, once on others
    for mine, other in ((5, 5), (7, next(i for i in range(500, 600)))):
        raced = []

        def commit(self, number, entry, run=CommitLog.commit):
            if not raced:
                raced.append(1)
                wr.upsert(spark.createDataFrame([(other, "other", 7), (1000 + mine, "new", 7)], schema), path, ["id"])
            return run(self, number, entry)

        monkeypatch.setattr(CommitLog, "commit", commit)
        wr.upsert(spark.createDataFrame([(mine, "mine", 8)], schema), path, ["id"])
        monkeypatch.undo()
        assert {(mine, "mine"), (1000 + mine, "new")} <= stored() and len(stored()) >= 401
    assert (500, "other") in stored()
    want = stored()
    wr.upsert(spark.createDataFrame([(7, "mine", 8)], schema), path, ["id"])  # a repeated load
    assert stored() == want and wr.expire(spark, path, 1) > 0 and stored() == want and len(log.numbers()) == 1
    assert not log.commit(log.numbers()[0], {})


def test_marks_are_saved_after_the_data(spark, tmp_path, monkeypatch):
    import json

    from pyspark.sql import types as T

    from wayfunnel.sinks import ingest
    from wayfunnel.sinks import writers as wr
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("price", T.StringType()), T.StructField("update_time", T.StringType())])
    where = [str(tmp_path / x) for x in ("in", "table", "state")]
    (tmp_path / "in").mkdir()

    def export(name, *rows):
        (tmp_path / "in" / name).write_text(json.dumps([{"id": i, "price": p, "update_time": t} for i, p, t in rows]))

    def load():
        return ingest.load_json(spark, where[0], "task", schema, where[1], where[2], ["id"])

    def prices():
        return {r.id: r.price for r in wr.current_version(spark, where[1]).collect()}

    export("task.json", (1, "1", "2024-01-01 00:00:00"), (2, "2", "2024-01-05 00:00:00"))
    export("task_20231201_000000.json", (3, "3", "2024-01-02 00:00:00"), (3, "3.5", "2024-01-02 00:00:00"))
    entry = load()
    assert (entry["mark"], entry["mode"], entry["row_count"]) == ("2024-01-05T00:00:00", "full", 4) and prices() == {1: 1.0, 2: 2.0, 3: 3.5}
    assert load()["mark"] == "2024-01-05T00:00:00" and ingest.saved_marks(spark, where[2], "task").count() == 1  # nothing later
    export("task_20240201_000000.json", (2, "9", "2024-01-31 00:00:00"))
    monkeypatch.setattr(ingest.CommitLog, "commit", lambda self, n, e, run=ingest.CommitLog.commit: 1 / 0 if "mark" in e else run(self, n, e))
    with pytest.raises(ZeroDivisionError):
        load()
    monkeypatch.undo()
    entry = load()  # repeated from the old mark
    assert (entry["mark"], entry["mode"], entry["row_count"]) == ("2024-01-31T00:00:00", "incremental", 1) and prices() == {1: 1.0, 2: 9.0, 3: 3.5}


def test_metrics_are_counted_in_the_writing_pass(spark, tmp_path):
    from wayfunnel.sinks import writers as wr
    read = spark.sparkContext.accumulator(0)
    rows = spark.range(100).mapInPandas(lambda it: (read.add(len(p)) or p for p in it), "id long")
    rows = rows.withColumn("t", F.timestamp_add("SECOND", F.col("id").cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")))
    row = wr.write_observed(rows, str(tmp_path / "out"), "x", "full", "t").first()
    assert (row.row_count, row.mark, read.value) == (100, "2024-01-01T00:01:39", 100)
