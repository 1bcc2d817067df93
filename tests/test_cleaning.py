import math

import pytest
from pyspark.sql import functions as F

from kinecohort.functions.columns import (
    finite_or_null,
    floor_bin,
    ieee_div,
    mean_horizontal,
    null_count,
    quoted,
    threshold_label,
)
from kinecohort.operators import cleaning, derive
from kinecohort.plans import presets as P
from kinecohort.plans.prepare import clean_test, clean_train, relevant_and_targets
from kinecohort.sources import tables


def values(df, c):
    return [r[c] for r in df.collect()]


def test_ieee_division(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(5.0, 0.0), (-5.0, 0.0), (0.0, 0.0), (nan, 0.0), (None, 0.0), (1.0, None), (6.0, 4.0), (inf, 2.0), (1.0, nan)]
    got = values(spark.createDataFrame(rows, "n double, d double").select(ieee_div(F.col("n"), F.col("d")).alias("q")), "q")
    assert got[:2] == [inf, -inf]
    assert math.isnan(got[2]) and math.isnan(got[3])
    assert got[4:8] == [None, None, 1.5, inf]
    assert math.isnan(got[8])


def test_threshold_label_edges(spark):
    rows = [(-1.0,), (0.5,), (1.49,), (2.5,), (float("nan"),), (None,)]
    df = spark.createDataFrame(rows, "x double")
    assert values(df.select(threshold_label(F.col("x"), [0.5, 1.5, 2.5]).alias("l")), "l") == [0, 1, 1, 3, 3, 3]
    # Unsorted cuts are taken in the given order.
    assert values(df.limit(2).select(threshold_label(F.col("x"), [0.0, -2.0, 1.0]).alias("l")), "l") == [0, 2]


def test_floor_bin_of_negative_numbers(spark):
    df = spark.createDataFrame([(-7.0,), (7.0,), (None,)], "x double")
    assert values(df.select(floor_bin(F.col("x"), 5).alias("b")), "b") == [-2, 1, None]


def test_horizontal_statistics(spark):
    df = spark.createDataFrame([(1, None, 4), (None, None, None)], "a int, b int, c int")
    row = df.select(null_count(["a", "b", "c"]).alias("n"), mean_horizontal(["a", "b", "c"]).alias("m")).collect()
    assert [(r.n, r.m) for r in row] == [(1, 2.5), (3, None)]


def test_names_with_dots(spark):
    df = spark.createDataFrame([(1.0,)], "x double").withColumnRenamed("x", "X_0.25")
    assert df.select(F.col(quoted("X_0.25"))).first()[0] == 1.0


def test_finite_or_null(spark):
    df = spark.createDataFrame([(float("inf"),), (float("nan"),), (2.0,), (None,)], "x double")
    assert values(df.select(finite_or_null(F.col("x")).alias("y")), "y") == [None, None, 2.0, None]


ITEMS = [f"i{k:02d}" for k in range(20)]


def scored(spark, answered, total, label=0):
    row = [float(v) if v is not None else None for v in answered] + [total, label]
    schema = ", ".join(f"{i} double" for i in ITEMS) + ", total double, label int"
    return spark.createDataFrame([tuple(row)], schema)


@pytest.mark.parametrize("mode,want", [("half_up", 13.0), ("half_even", 12.0)])
def test_prorated_total_rounds_halves_by_mode(spark, mode, want):
    answered = [1] * 6 + [0.4] * 10 + [None] * 4
    df = scored(spark, answered, 10.0)
    assert cleaning.prorate_total(df, ITEMS, "total", mode).first().total == want


def test_all_items_missing_gives_the_last_label(spark):
    df = scored(spark, [None] * 20, 10.0)
    out = cleaning.relabel_by_cutoffs(
        cleaning.prorate_total(df, ITEMS, "total"), "total", "label", P.LABEL_CUTS
    ).first()
    assert out.total is None and out.label == 3


def test_missing_label_stays_missing(spark):
    df = scored(spark, [1] * 20, 20.0, None)
    assert cleaning.relabel_by_cutoffs(df, "total", "label", P.LABEL_CUTS).first().label is None


def test_drop_ids_drops_missing_ids_too(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "id string")
    assert values(cleaning.drop_ids(df, ["a"]), "id") == ["b"]


def test_null_group_covers_every_column_of_the_prefix(spark):
    df = spark.createDataFrame([("a", 1, "Fall"), ("b", 2, "Fall"), (None, 3, "Fall")], "id string, `BIA-x` int, `BIA-Season` string")
    out = cleaning.null_group_for_ids(df, ["a"], "BIA").collect()
    assert [(r["BIA-x"], r["BIA-Season"]) for r in out] == [(None, None), (2, "Fall"), (None, None)]


def test_completeness(spark):
    rows = [
        ("one value", 1, None, None, None),
        ("two values", 1, 2, None, None),
        ("one value and targets", None, 2, 5, 1),
        ("nothing but targets", None, None, 5, 1),
        ("series only", None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "id string, a int, b int, t int, u int")
    series = spark.createDataFrame([("series only",)] * 5 + [("other",), (None,)], "id string")
    kept = values(cleaning.completeness_filter(df, series, ["a", "b"], ["t", "u"]), "id")
    assert sorted(kept) == ["one value and targets", "series only", "two values"]


def test_zero_to_null(spark):
    df = spark.createDataFrame([(0.0,), (2.0,), (None,)], "x double")
    assert values(cleaning.zero_to_null(df, ["x"]), "x") == [None, 2.0, None]


def test_align_features_refuses_missing_columns(spark):
    df = spark.createDataFrame([("a", 1, 2)], "id string, x int, y int")
    assert cleaning.align_features(df, ["y", "x"]).columns == ["id", "y", "x"]
    with pytest.raises(ValueError, match="z"):
        cleaning.align_features(df, ["z"])


def test_alternates(spark):
    df = spark.createDataFrame([(4.0, None), (None, 4.0), (2.0, 4.0), (None, None)], "c double, a double")
    assert values(df.select(derive.half_sum_of_alternates("c", "a").alias("h")), "h") == [2.0, 2.0, 3.0, None]
    assert values(derive.coalesce_alternates(df, "c", "a", "a"), "a") == [4.0, 4.0, 2.0, None]


@pytest.mark.parametrize("by_join", [False, True])
def test_unseen_and_missing_categories(spark, monkeypatch, by_join):
    if by_join:
        monkeypatch.setattr(derive, "MAP_CATEGORIES", 0)
        monkeypatch.setattr(derive, "WINDOW_CATEGORIES", 0)
    fitted = spark.createDataFrame([("Winter",), ("Fall",), ("Fall",), ("Missing",), (None,)], "s string")
    codes = derive.fit_ordinal(fitted, ["s"])
    df = spark.createDataFrame([(1, "Fall"), (2, "Missing"), (3, "Winter"), (4, "Spring"), (5, None)], "r int, s string")
    got = {r.r: r.s for r in codes.transform(df).collect()}
    assert got == {1: 0.0, 2: 1.0, 3: 2.0, 4: -1.0, 5: -1.0}


def test_imputation_draws_once_per_call_and_repeats(spark):
    df = spark.createDataFrame([(None, 10.0), (None, 20.0), (7.0, 1.0), (None, None)], "w double, b double")
    a = values(derive.impute_linear_noise(df, "w", "b", 1.2, seed=3), "w")
    assert a == values(derive.impute_linear_noise(df, "w", "b", 1.2, seed=3), "w")
    assert a[0] - 12 == pytest.approx(a[1] - 24) and a[2:] == [7.0, None]
    b = values(derive.impute_linear_noise(df, "w", "b", 1.2, seed=3, per_row=True), "w")
    assert b[0] - 12 != pytest.approx(b[1] - 24)


def test_series_ids_stay_strings(spark, tmp_path):
    df = spark.createDataFrame([("001", 1, 0.5), ("012", 2, 0.7), ("012", 3, 0.9)], "id string, step long, x double")
    tables.write_series(df, str(tmp_path / "s"))
    back = tables.read_series(spark, str(tmp_path / "s"))
    assert sorted((r.id, r.step) for r in back.collect()) == [("001", 1), ("012", 2), ("012", 3)]
    found = {r.id: (r.n_rows, r.n_files) for r in tables.series_inventory(back).collect()}
    assert found == {"001": (1, 1), "012": (2, 1)}


def _files(root):
    return sorted(str(p.relative_to(root).parent) for p in root.rglob("part-*"))


def test_series_directories_are_those_of_spark(spark, tmp_path):
    """The same names, rows and types for odd ids; and no second file with check sums, whose making starts processes."""
    ids = ["001", "a/b", "x=1", "50%", "[é]", " ", "q'\"#{}^:?*\\", "", None, "\x01", "00.50", "null"]
    rows = [(i, n, None if n % 3 else n / 7, f"t{n}", n % 2 == 0, bytes([n])) for n in range(5) for i in ids]
    df = spark.createDataFrame(rows, "id string, `st-ep` int, x double, t string, b boolean, z binary")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # subjects go on from one batch to the next
    try:
        tables.write_series(df, str(tmp_path / "own"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    df.repartition("id").write.partitionBy("id").parquet(str(tmp_path / "spark"))
    assert _files(tmp_path / "own") == _files(tmp_path / "spark") and len(_files(tmp_path / "own")) == 11
    assert not list((tmp_path / "own").rglob("id=*/.*"))
    own, theirs = (tables.read_series(spark, str(tmp_path / n)) for n in ("own", "spark"))
    assert own.schema == theirs.schema
    key = lambda r: (str(r.id), r["st-ep"])
    assert sorted(own.collect(), key=key) == sorted(theirs.collect(), key=key)
    found = {r.id: (r.n_rows, r.n_files) for r in tables.series_inventory(own).collect()}
    assert found == {i or None: (5 if i else 10, 1) for i in ids}


def test_series_are_written_whole_or_not_at_all(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 0)], "id string, n int")
    with pytest.raises(Exception, match="unlucky"):
        tables.write_series(df.withColumn("n", F.expr("if(n = 0, cast(raise_error('unlucky') as int), n)")), str(tmp_path / "s"))
    assert not any(tmp_path.iterdir())
    tables.write_series(df, str(tmp_path / "s"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        tables.write_series(df, str(tmp_path / "s"))
    other = df.withColumn("when", F.expr("TIMESTAMP_NTZ '1500-01-02 03:04:05'")).withColumn("l", F.array("n"))
    tables.write_series(other, str(tmp_path / "t"))
    assert sorted(tables.read_series(spark, str(tmp_path / "t")).select(*other.columns).collect()) == sorted(other.collect())


def test_series_of_many_subjects_are_listed_once_by_few_tasks(spark, tmp_path):
    tables.write_series(spark.range(200).selectExpr("lpad(id, 4, '0') AS id", "id AS n"), str(tmp_path / "s"))
    context, group = spark.sparkContext, "listing"
    context.setJobGroup(group, "read_series")
    try:
        found = tables.read_series(spark, str(tmp_path / "s"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(i) for job in tracker.getJobIdsForGroup(group) for i in tracker.getJobInfo(job).stageIds]
    assert sum(s.numTasks for s in stages) <= 4 * context.defaultParallelism + 1
    assert found.count() == 200 and found.select("id").distinct().count() == 200


def test_an_inventory_of_many_subjects_takes_few_tasks(spark, tmp_path):
    context, group = spark.sparkContext, "inventory"
    context.setJobGroup(group, "series_inventory")
    try:
        tables.write_series(spark.range(600).selectExpr("lpad(id % 200, 4, '0') AS id", "id AS n"), str(tmp_path / "s"))
        found = tables.series_inventory(tables.read_series(spark, str(tmp_path / "s"))).collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = {i for job in tracker.getJobIdsForGroup(group) for i in tracker.getJobInfo(job).stageIds}
    assert sum(tracker.getStageInfo(i).numTasks for i in stages if tracker.getStageInfo(i)) < 200
    assert {r.id: (r.n_rows, r.n_files) for r in found} == {f"{i:04d}": (3, 1) for i in range(200)}
    assert all(r.n_bytes > 0 for r in found)


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("007", None, 1.5), ("8", 3, None)], "id string, `a-b` int, c double")
    tables.write_table(df, str(tmp_path / "t"))
    back = tables.read_table(spark, str(tmp_path / "t"), df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_cleaning_presets(spark):
    from checks.data import subject_columns, subjects

    df = subjects(spark, "/root/testdata/sf0.001")
    relevant, targets = relevant_and_targets(df)
    assert "PCIAT-Season" in targets and "sii" in targets and "Physical-BMI" not in relevant
    assert not [c for c in relevant if c.endswith("Season")]
    series = df.select("id").limit(0)
    cleaned = clean_train(df, series)
    assert cleaned.columns == list(subject_columns())
    ids = {r.id for r in cleaned.select("id").collect()}
    assert not ids & set(P.DROPPED_IDS)
    assert clean_test(df).count() == df.count()
