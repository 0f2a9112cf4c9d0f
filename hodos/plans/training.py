"""The speed model: encoders as tables, boosted trees, versioned on disk."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from hodos.operators import boosting
from hodos.operators.encode import (
    TargetEncoding,
    apply_ordinal_encoding,
    apply_target_encoding,
    cross_fit_target_encoding,
    fit_ordinal_encoding,
    fit_target_encoding,
    fold_of,
)
from hodos.plans.features import TARGET, TIME_FEATURES, road_device_lists, road_devices, row_key, sample_rows, split_marked, time_features
from hodos.session import cut


@dataclass(frozen=True)
class ModelSettings:
    max_iter: int = 500
    max_depth: int = 15
    max_leaves: int = 255
    max_bins: int = 255
    learning_rate: float = 0.05
    min_samples_leaf: int = 500
    seed: int = 42
    test_percent: int = 20
    cut_every: int = 10
    folds: int = 5
    smoothing: float | None = None
    sample_size: int | None = 100_000  # None: all training rows


@dataclass
class SpeedModel:
    trees: boosting.Boosted
    devices: TargetEncoding
    roads: DataFrame
    settings: ModelSettings = field(default_factory=ModelSettings)

    def predict(self, base: DataFrame, output: str = "prediction") -> DataFrame:
        """Score rows with the base columns; unseen devices and roads are allowed."""
        marked = base.select("*", F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("_row"))
        coded = apply_target_encoding(time_features(marked), self.devices, "device_code")
        coded = apply_ordinal_encoding(coded, self.roads, "road_name", "road_code")
        scored = self.trees.predict(_tree_input(coded), keep=["_row"])
        return scored.select("_row.*", F.col("prediction").alias(output))


def _tree_input(coded: DataFrame) -> DataFrame:
    """Road as a category: 0 stands for unseen roads."""
    return coded.withColumn("road_category", F.col("road_code") + 1)


def fit(train: DataFrame, settings: ModelSettings = ModelSettings()) -> SpeedModel:
    """Fit encoders and trees on base rows.

    Training rows get device codes from the other folds only, so the trees cannot read a
    row's own speed off its device; scoring uses codes from all training rows.
    """
    roads = cut(fit_ordinal_encoding(train, "road_name"))
    # Every road is a category and needs a bin, as do roads not seen in training.
    n_roads = roads.count() + 1
    settings = replace(settings, max_bins=max(settings.max_bins, n_roads))
    devices = fit_target_encoding(train, "device_id", TARGET, settings.smoothing)
    coded = cross_fit_target_encoding(
        train, "device_id", TARGET, fold_of(*row_key(), folds=settings.folds), "device_code", settings.smoothing
    )
    coded = apply_ordinal_encoding(time_features(coded), roads, "road_name", "road_code")
    numbers, categories = ["device_code", *TIME_FEATURES], {"road_category": n_roads}
    trees = boosting.fit(cut(_tree_input(coded)), TARGET, numbers, categories, _boost_settings(settings))
    return SpeedModel(trees, devices, roads, settings)


def _boost_settings(settings: ModelSettings) -> boosting.BoostSettings:
    return boosting.BoostSettings(
        settings.max_iter, settings.max_leaves, settings.max_depth, settings.learning_rate, settings.min_samples_leaf, settings.max_bins, settings.cut_every
    )


def metrics(scored: DataFrame, actual: str = TARGET, predicted: str = "prediction") -> DataFrame:
    """Mean absolute error and R-squared in one aggregation."""
    y, e = F.col(actual), F.col(actual) - F.col(predicted)
    spread = F.var_pop(y) * F.count(y)
    return scored.where(y.isNotNull() & F.col(predicted).isNotNull()).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(F.abs(e)).alias("mae"),
        (F.lit(1.0) - F.sum(e * e) / F.nullif(spread, F.lit(0.0))).alias("r2_score"),
    )


def holdout(model: SpeedModel, train: DataFrame, test: DataFrame, worst: float = 0.9) -> DataFrame:
    """The model on rows it was not fitted on, beside the mean of the training part; one row.

    ``is_better`` says whether its mean absolute error is at most ``worst`` times the mean's.
    """
    mean = train.agg(F.avg(TARGET)).scalar()
    scored = model.predict(test).withColumn("training_mean", mean)
    y, guess, plain = F.col(TARGET), F.col("prediction"), F.col("training_mean")
    mae, mean_mae = F.avg(F.abs(y - guess)), F.avg(F.abs(y - plain))
    spread = F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))
    return scored.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(guess.between(0, 130)).alias("n_plausible"),
        F.countDistinct("device_id").alias("n_devices"),
        mean_mae.alias("mean_mae"),
        (F.lit(1.0) - F.sum((y - plain) * (y - plain)) / spread).alias("mean_r2_score"),
        (mae <= mean_mae * worst).alias("is_better"),
    )


# --- artefacts -----------------------------------------------------------------------


def save(model: SpeedModel, train: DataFrame, base: DataFrame, root: str, version: int) -> str:
    """Everything serving and monitoring need, below ``<root>/version=<n>``."""
    path = f"{root.rstrip('/')}/version={version}"
    boosting.save(model.trees, base.sparkSession, f"{path}/trees")
    model.devices.table.write.mode("overwrite").parquet(f"{path}/device_codes")
    spark = base.sparkSession
    spark.range(1).select(F.lit(model.devices.default).cast("double").alias("encoding")).write.mode("overwrite").json(f"{path}/device_default")
    model.roads.write.mode("overwrite").parquet(f"{path}/road_codes")
    road_device_lists(road_devices(base)).write.mode("overwrite").json(f"{path}/road_devices")
    write_reference(train, path, model.settings)
    return path


def write_reference(train: DataFrame, path: str, settings: ModelSettings) -> None:
    sample = train if settings.sample_size is None else sample_rows(train, settings.sample_size, row_key(), settings.seed)
    sample.write.mode("overwrite").parquet(f"{path}/reference")


def load(spark: SparkSession, path: str, settings: ModelSettings = ModelSettings()) -> SpeedModel:
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    default = spark.read.schema("encoding double").json(f"{path}/device_default").first().encoding
    return SpeedModel(
        boosting.load(spark, f"{path}/trees"),
        TargetEncoding(read("device_codes"), default, "device_id"),
        read("road_codes"),
        settings,
    )


def load_road_devices(spark: SparkSession, path: str) -> DataFrame:
    """The saved mapping as (road, device) pairs."""
    lists = spark.read.schema("road_name string, devices array<string>").json(f"{path}/road_devices")
    return lists.select("road_name", F.explode("devices").alias("device_id"))


def latest_version(versions: DataFrame) -> DataFrame:
    """The registry row with the highest version, compared as a number."""
    number = F.col("version").cast("bigint")
    return versions.agg(F.max_by("run_id", number).alias("run_id"), F.max(number).alias("version"))


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.col("start_time").desc_nulls_last(), F.col("run_id").desc()).limit(1)


def train_and_evaluate(base: DataFrame, settings: ModelSettings = ModelSettings()) -> tuple[SpeedModel, DataFrame]:
    """Split, fit, and score the test part."""
    marked = split_marked(base, settings.test_percent, settings.seed)
    model = fit(cut(marked.where("NOT is_test").drop("is_test")), settings)
    return model, model.predict(marked.where("is_test").drop("is_test"))
