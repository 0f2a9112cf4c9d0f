"""Features, encoders, model, scoring, sampling and drift."""

import math
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import Observation, functions as F

from hodos.operators import bins, drift, encode
from hodos.operators.prefix import running_totals
from hodos.plans import features, monitoring, scoring, training

GOLD = "device_id string, road_name string, processed_month int, processed_day string, processed_hour string, processed_at timestamp_ntz, average_speed double"


def gold_rows(spark):
    return spark.createDataFrame(
        [
            ("MS261", "A", 10, "Saturday", "08:00", datetime(2024, 10, 26, 8), 55.0),
            ("MS797", "B", 3, "Monday", "16:00", datetime(2024, 3, 25, 16), 40.0),
            ("MS001", "C", 8, "Wednesday", "12:00", datetime(2024, 8, 14, 12), 60.0),
        ],
        GOLD,
    )


def test_base_features_and_dropped_rows(spark):
    rows = gold_rows(spark).unionByName(spark.createDataFrame([(None, "A", 1, "Monday", "01:00", datetime(2024, 1, 1, 1), 5.0)], GOLD))
    seen = Observation("base")
    got = features.base_features(rows, seen).collect()
    assert seen.get == {"n_rows": 4, "n_kept": 3}
    assert got[0].__fields__ == ["device_id", "road_name", "date", "hour", "average_speed"]
    assert {(r.device_id, r.date, r.hour) for r in got} >= {("MS261", date(2024, 10, 26), 8), ("MS797", date(2024, 3, 25), 16)}


def test_time_features(spark):
    got = {r.device_id: r for r in features.time_features(features.base_features(gold_rows(spark))).collect()}
    saturday, holiday, plain = got["MS261"], got["MS797"], got["MS001"]
    assert (saturday.is_weekend, saturday.day_id, saturday.is_rush_hour) == (1, 5, 1)
    assert (holiday.is_weekend, holiday.is_rush_hour, holiday.is_holiday) == (0, 1, 1)
    assert (plain.is_rush_hour, plain.is_holiday, plain.processed_month) == (0, 0, 8)
    assert plain.hour_sin == pytest.approx(0, abs=1e-12) and plain.hour_cos == pytest.approx(-1)
    assert not {"date", "hour"} & set(plain.__fields__)


def test_own_holiday_calendar(spark):
    own = spark.createDataFrame([(date(2024, 8, 14), "x"), (date(2024, 8, 14), "y")], "holiday_date date, holiday_name string")
    got = features.time_features(features.base_features(gold_rows(spark)), own).collect()
    assert sorted((r.device_id, r.is_holiday) for r in got) == [("MS001", 1), ("MS261", 0), ("MS797", 0)]


def base(spark, n=4000):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        device = rng.randrange(8)
        hour = rng.randrange(24)
        speed = 30.0 + 5 * device + (10 if hour < 6 else 0) + rng.random()
        rows.append((f"MS{device}", "ABCD"[device % 4], date(2024, 1, 1) + timedelta(days=i % 50), hour, speed))
    return spark.createDataFrame(rows, "device_id string, road_name string, date date, hour long, average_speed double")


def test_split_does_not_depend_on_partitioning(spark):
    rows = base(spark, 1000)
    test = lambda df: sorted(map(str, features.split_marked(df).where("is_test").collect()))
    assert test(rows.repartition(7)) == test(rows.coalesce(1))
    assert 150 < len(test(rows)) < 250


def test_sample_is_exact_and_reproducible(spark):
    rows = base(spark, 3000)
    take = lambda n, df=rows: sorted(map(str, features.sample_rows(df, n, features.row_key()).collect()))
    assert len(take(700)) == 700 and take(700) == take(700, rows.repartition(5))
    assert set(take(100)) <= set(take(700))
    assert len(take(5000)) == 3000


def test_target_encoding_formulas(spark):
    rows = spark.createDataFrame([("a", 10.0), ("a", 20.0), ("b", 40.0), ("c", 70.0)], "k string, y double")
    overall, spread = 35.0, (25**2 + 15**2 + 5**2 + 35**2) / 4
    smooth = encode.fit_target_encoding(rows, "k", "y", smoothing=2)
    codes = {r.k: r.encoding for r in smooth.table.collect()}
    assert codes == pytest.approx({"a": (30 + 2 * overall) / 4, "b": (40 + 2 * overall) / 3, "c": (70 + 2 * overall) / 3})
    auto = {r.k: r.encoding for r in encode.fit_target_encoding(rows, "k", "y").table.collect()}
    trust = spread * 2 / (spread * 2 + 25)
    assert auto["a"] == pytest.approx(trust * 15 + (1 - trust) * overall) and auto["b"] == pytest.approx(40)
    unseen = encode.apply_target_encoding(spark.createDataFrame([("z",), (None,)], "k string"), smooth, "code")
    assert [r.code for r in unseen.collect()] == [overall, overall]


def test_cross_fit_uses_other_folds_only(spark):
    rows = spark.createDataFrame([("a", 0, 10.0), ("a", 1, 30.0), ("a", 1, 50.0), ("b", 0, 80.0), (None, 0, 5.0), (None, 1, 7.0)], "k string, f int, y double")
    got = encode.cross_fit_target_encoding(rows, "k", "y", F.col("f"), "code", smoothing=0)
    codes = {(r.k, r.y): r.code for r in got.collect()}
    assert codes[("a", 10.0)] == 40.0 and codes[("a", 30.0)] == 10.0
    assert codes[("b", 80.0)] == pytest.approx((30 + 50 + 7) / 3)  # unseen outside its fold
    assert codes[(None, 5.0)] == 7.0


def test_ordinal_encoding(spark):
    fitted = encode.fit_ordinal_encoding(spark.createDataFrame([("B",), ("A",), ("B",), (None,)], "r string"), "r")
    got = encode.apply_ordinal_encoding(spark.createDataFrame([("A",), ("B",), ("Z",), (None,)], "r string"), fitted, "r", "code")
    assert {r.r: r.code for r in got.collect()} == {"A": 0, "B": 1, "Z": -1, None: -1}


def test_ordinal_codes_number_all_ranges_in_order(spark):
    names = [f"r{i:04d}" for i in range(500)]
    fitted = encode.fit_ordinal_encoding(spark.createDataFrame([(n,) for n in names * 2], "r string"), "r")
    assert [r.code for r in sorted(fitted.collect())] == list(range(500))
    assert encode.fit_ordinal_encoding(spark.createDataFrame([], "r string"), "r").isEmpty()


SMALL = training.ModelSettings(max_iter=8, max_depth=4, max_bins=16, learning_rate=0.4, min_samples_leaf=5)


def test_model_learns_saves_and_loads(spark, folder):
    rows = base(spark)
    model, scored = training.train_and_evaluate(rows, SMALL)
    result = training.metrics(scored).first()
    assert result.mae < 2 and result.r2_score > 0.9
    path = training.save(model, rows, rows, folder, 3)
    again = training.load(spark, path, SMALL)
    probe = spark.createDataFrame([("MS1", "B", date(2024, 1, 5), 3), ("new", "new", date(2024, 1, 5), 3)], "device_id string, road_name string, date date, hour long")
    key = lambda m: sorted((r.device_id, r.prediction) for r in m.predict(probe).collect())
    assert key(again) == key(model)
    assert again.trees.binning.names == model.trees.binning.names and len(again.trees.trees) == SMALL.max_iter
    assert training.load_road_devices(spark, path).count() == 8
    assert spark.read.parquet(f"{path}/reference").count() == 4000


def test_bins_grow_with_the_roads(spark):
    model = training.fit(base(spark, 100), training.ModelSettings(max_iter=2, max_depth=2, max_bins=3, min_samples_leaf=1))
    assert model.settings.max_bins == model.roads.count() + 1 > 3


def test_holdout_is_held_against_the_training_mean(spark):
    train, test = (base(spark, 400).where(f"date {sign} '2024-01-20'") for sign in ("<", ">="))
    row = training.holdout(training.fit(train, SMALL), train, test).first()
    mean = train.agg(F.avg("average_speed")).first()[0]
    assert row.n_rows == row.n_plausible == test.count() > 0 and row.is_better
    assert row.mean_mae == pytest.approx(test.agg(F.avg(F.abs(F.col("average_speed") - mean))).first()[0])


def test_error_figures_keep_their_digits_on_large_values(spark):
    rows = spark.createDataFrame([(1e9 + i, 1e9 + i + (0.5 if i % 2 else -0.5)) for i in range(100)], "average_speed double, prediction double")
    row = training.metrics(rows).first()
    assert row.mae == 0.5 and row.r2_score == pytest.approx(1 - 25 / 83325)


def test_latest_version_is_numeric_and_latest_run_by_time(spark):
    runs = spark.createDataFrame([("r9", "9", datetime(2024, 1, 2)), ("r10", "10", datetime(2024, 1, 1))], "run_id string, version string, start_time timestamp_ntz")
    assert training.latest_version(runs).first().run_id == "r10"
    assert training.latest_run(runs).first().run_id == "r9"


# --- scoring -------------------------------------------------------------------------


def constant(df):
    return df.withColumn("prediction", F.lit(45.0))


PAIRS = [("ΚΗΦΙΣΙΑΣ", "MS468"), ("ΚΗΦΙΣΙΑΣ", "MS311"), ("ΚΗΦΙΣΙΑΣ", "MS316"), ("A", "MS1")]
ASKED = [(1, "ΚΗΦΙΣΙΑΣ", date(2026, 2, 26), 14), (2, "FAKE_ROAD", date(2026, 2, 26), 14), (3, "A", date(2026, 2, 26), 24), (4, "ΚΗΦΙΣΙΑΣ", date(2026, 2, 26), 14), (5, "A", date(2026, 2, 26), None)]


def test_road_scoring(spark):
    pairs = spark.createDataFrame(PAIRS, "road_name string, device_id string")
    asked = spark.createDataFrame(ASKED, "id int, road_name string, target_date date, target_hour int")
    answers = {r.id: r for r in scoring.score_roads(asked, pairs, constant).collect()}
    assert set(answers) == {1, 4}
    one = answers[1]
    assert (one.target_datetime, one.average_predicted_speed_kmh, one.active_devices_used) == ("2026-02-26 14:00", 45.0, 3)
    assert one.device_breakdown == {"MS468": 45.0, "MS311": 45.0, "MS316": 45.0}
    assert scoring.device_predictions(asked, pairs, constant).count() == 3  # asked twice, scored once
    reasons = {r.id: r.reason for r in scoring.rejected(asked, pairs).collect()}
    assert reasons == {2: "no device is known on road 'FAKE_ROAD'", 3: "target_hour outside 0..23", 5: "target_hour outside 0..23"}


# --- charts --------------------------------------------------------------------------


def test_histogram_integrates_to_one(spark):
    df = spark.createDataFrame([(float(i % 17) * 1.3,) for i in range(500)] + [(None,)], "r double")
    got = bins.density_histogram(df, "r", 10).collect()
    assert sum(r.n_rows for r in got) == 500
    assert sum(r.density * (r.bin_end - r.bin_start) for r in got) == pytest.approx(1)
    flat = bins.density_histogram(spark.createDataFrame([(3.0,), (3.0,)], "r double"), "r", 10).collect()
    assert [(r.bin, r.n_rows) for r in flat] == [(5, 2)]


def test_hexagons_are_the_nearest_centres(spark):
    rng = random.Random(3)
    points = [(rng.uniform(0, 100), rng.uniform(0, 80)) for _ in range(400)]
    df = spark.createDataFrame(points, "x double, y double")
    got = {(r.hex_x, r.hex_y): r.n_rows for r in bins.hexagon_density(df, "x", "y", 12).collect()}
    x0, x1 = min(p[0] for p in points), max(p[0] for p in points)
    y0, y1 = min(p[1] for p in points), max(p[1] for p in points)
    columns, rows = 12, int(12 / math.sqrt(3))
    centres = [(i, j) for i in range(columns + 1) for j in range(rows + 1)] + [(i + 0.5, j + 0.5) for i in range(columns) for j in range(rows)]
    want = {}
    for x, y in points:
        u, v = (x - x0) / (x1 - x0) * columns, (y - y0) / (y1 - y0) * rows
        nearest = min(centres, key=lambda c: (u - c[0]) ** 2 + 3 * (v - c[1]) ** 2)
        want[nearest] = want.get(nearest, 0) + 1
    assert got == want


# --- drift ---------------------------------------------------------------------------


def test_running_totals_are_exact_for_any_cut(spark):
    rng = random.Random(5)
    values = sorted({round(rng.paretovariate(1.1), 3) for _ in range(900)})
    df = spark.createDataFrame([(v, i % 9) for i, v in enumerate(values)], "v double, n long")
    got = sorted(running_totals(df, "v", ["n"], buckets=7).collect())
    total = 0
    for i, row in enumerate(got):
        total += row.n
        assert row.cum_n == total
        assert row.next_v == (values[i + 1] if i + 1 < len(values) else None)


def speeds(spark, values, device="a"):
    return spark.createDataFrame([(device, "R", v) for v in values], "device_id string, road_name string, average_speed double")


def test_numeric_drift(spark):
    reference = speeds(spark, [1.0, 2.0, 3.0, 4.0])
    same = drift.numeric_drift(reference, reference, "average_speed").first()
    assert (same.score, same.statistic, same.is_drifted) == (0.0, 0.0, False)
    moved = drift.numeric_drift(reference, speeds(spark, [11.0, 12.0, 13.0, 14.0]), "average_speed").first()
    assert moved.score == pytest.approx(10 / math.sqrt(1.25)) and moved.statistic == 1.0 and moved.is_drifted
    constant_reference = drift.numeric_drift(speeds(spark, [5.0, 5.0]), speeds(spark, [6.0]), "average_speed").first()
    assert constant_reference.score == pytest.approx(1 / 0.001)


def test_categorical_drift(spark):
    reference, other = speeds(spark, [1.0] * 3, "a"), speeds(spark, [1.0] * 3, "b")
    apart = drift.categorical_drift(reference, other, ["device_id"]).first()
    assert apart.score == pytest.approx(math.sqrt(math.log(2))) and apart.statistic == pytest.approx(6.0)
    assert drift.categorical_drift(reference, reference, ["road_name"]).first().score == 0.0


def test_drift_report(spark):
    reference = speeds(spark, [1.0, 2.0]).withColumn("hour", F.lit(1))
    current = speeds(spark, [50.0, 60.0], "b").select("average_speed", "road_name", "device_id")
    assert monitoring.comparable(reference, current).columns == ["device_id", "road_name", "average_speed"]
    columns, alert = monitoring.drift_report(reference, current)
    assert {r.column_name: r.is_drifted for r in columns.collect()} == {"average_speed": True, "device_id": True, "road_name": False}
    row = alert.first()
    assert (row.n_columns, row.n_drifted, row.is_drifting, row.drift_share_text) == (3, 2, True, "0.67")
    half = drift.drift_summary(columns.where("column_name <> 'device_id'")).first()
    assert not half.is_drifting  # exactly one half is no alert
