import math

from pyspark.sql import functions as F

from wayfunnel.operators import features as ft


def test_grams_stay_inside_words(spark):
    got = spark.createDataFrame([("a  bcd",), ("",), (None,)], "t string") \
        .select(ft.char_grams(F.coalesce("t", F.lit(""))).alias("g")).collect()
    assert got[0].g == [" a", "a ", " b", "bc", "cd", "d ", " a ", " bc", "bcd", "cd ", " bcd", "bcd "]
    assert got[1].g == [] and got[2].g == []


def test_labels_are_numbered_in_order_across_ranges(spark):
    labels = [(i % 3, f"l{i % 500:03d}") for i in range(4000)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {(r.family, r.label): r.place for r in ft.numbered(spark.createDataFrame(labels, "family int, label string")).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == {x: i for i, x in enumerate(sorted(set(labels)))}


def test_vectors(spark):
    df = spark.createDataFrame([(1, 1.0, "x", "p;q;p", "ab"), (2, 3.0, "y", "", "ab b"), (3, None, "x", None, None)],
                               "id long, n double, c string, tag string, t string")
    out = {}
    for r in ft.vectorise(df, "id", ["n"], ["c"], "tag", "t", 100).collect():
        out.setdefault(r.id, {})[r.place] = r.value
    # places: n 0; x 1, y 2; p 3, q 4; then the grams in order: " a", " ab", " ab ", " b", " b ", "ab", "ab ", "b "
    grams = [" a", " ab", " ab ", " b", " b ", "ab", "ab ", "b "]
    tf = {1: {g: 1 for g in (" a", "ab", "b ", " ab", "ab ", " ab ")}}
    tf[2] = {**tf[1], " b": 1, " b ": 1, "b ": 2}
    idf = {g: math.log(4 / (1 + sum(g in tf[i] for i in tf))) + 1 for g in grams}
    mean, sd = 4 / 3, math.sqrt(((1 - 4 / 3) ** 2 + (3 - 4 / 3) ** 2 + (4 / 3) ** 2) / 3)
    want = {i: {0: (v - mean) / sd} for i, v in ((1, 1), (2, 3), (3, 0))}
    want[1].update({1: 1.0, 3: 1.0, 4: 1.0})
    want[2].update({2: 1.0})
    want[3].update({1: 1.0})
    for i in tf:
        w = {5 + grams.index(g): n * idf[g] for g, n in tf[i].items()}
        length = math.sqrt(sum(x * x for x in w.values()))
        want[i].update({p: x / length for p, x in w.items()})
    assert {i: {p: round(v, 9) for p, v in x.items()} for i, x in out.items()} == \
        {i: {p: round(v, 9) for p, v in x.items()} for i, x in want.items()}


def test_cells_are_not_broadcast(spark, monkeypatch):
    """A join that sends the cells to all tasks runs in the few tasks of the labels."""
    df = spark.createDataFrame([(i, float(i), f"c{i % 7}", "p;q", f"ab{i % 9} cde") for i in range(400)],
                               "id long, n double, c string, tag string, t string").persist()
    whole = None
    for sent in (100_000, 0):
        monkeypatch.setattr(ft, "SENT_LABELS", sent, raising=False)
        monkeypatch.setattr(ft, "TASK_LETTERS", 500, raising=False)
        out = ft.vectorise(df, "id", ["n"], ["c"], "tag", "t", 100)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        cells = next(x for x in plan.splitlines() if x.lstrip(" :+-").startswith("Join"))
        assert "rightHint=(strategy=broadcast)" in cells if sent else "rightHint=(strategy=merge)" in cells
        rows = sorted((r.id, r.place, round(r.value, 9)) for r in out.collect())
        assert whole is None or rows == whole
        whole = rows
