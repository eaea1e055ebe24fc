"""Expected star rating from review features, by gradient-boosted trees."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewmill.functions.numbers import clip_rating
from reviewmill.operators.ranks import lowest_per_group
from reviewmill.operators.skew import salted_join
from reviewmill.plans import boosting
from reviewmill.session import staged

# Features and settings of the original model.
NUMERIC = ["review_length", "word_count", "answer_length", "sentiment_score", "has_answer"]
CATEGORICAL = ["sentiment_label", "color"]
TARGET = "rating"
UNKNOWN = "unknown"
ROUNDS = 800
DEPTH = 6
LEARNING_RATE = 0.05
VALIDATION = 0.2
SEED = 42

PRIOR_ROWS = 10.0
# Most bins per feature; their product, 524,288, bounds what one fit has to hold.
BINS = {
    "review_length": 16, "word_count": 8, "answer_length": 8, "sentiment_score": 8, "has_answer": 2,
    "sentiment_label_code": 4, "color_code": 8,
}


def prepared(rows: DataFrame) -> DataFrame:
    """Numeric features as doubles, unreadable, null or NaN ones 0; null categories "unknown"."""
    zero = F.lit(0.0)
    numbers = {c: F.nanvl(F.coalesce(F.col(c).try_cast("double"), zero), zero) for c in NUMERIC}
    names = {c: F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)) for c in CATEGORICAL}
    return rows.withColumns({**numbers, **names})


def _code(total: Column, n: Column, mean: float) -> Column:
    return (total + F.lit(PRIOR_ROWS * mean)) / (n + PRIOR_ROWS)


def encodings(train: DataFrame, mean: float) -> dict[str, DataFrame]:
    """Smoothed mean rating per category value, from training rows only.

    A value with n rows and rating sum s gets (s + m * mean) / (n + m). Trees
    then split on numbers, however many colours there are. The tables are staged, as they
    are read for every row that gets a code.
    """
    rows = prepared(train)
    result = {}
    for name in CATEGORICAL:
        sums = rows.groupBy(name).agg(
            F.sum(F.col(TARGET).cast("double")).alias("s"), F.count("*").alias("n")
        )
        result[name] = staged(sums.select(name, _code(F.col("s"), F.col("n"), mean).alias(f"{name}_code")))
    return result


def ordered(train: DataFrame, mean: float, seed: int = SEED, digits: int = 3) -> DataFrame:
    """Training rows with category codes from the rows before them in a seeded random order.

    So no row's code has seen its own rating, which a rare value's mean would give away. The
    order is that of digests of the review key. Sums are taken per (value, digest slice)
    first and rows are ordered inside their slice only, so a colour with a third of all rows
    is never sorted in one task. Rows move once, by their slice, for all categories.
    """
    rating = F.col(TARGET).cast("double")
    digest = F.md5(F.concat_ws(":", F.lit(f"order:{seed}"), "review_key"))
    rows = prepared(train).withColumn("__slice", F.substring(digest, 1, digits))
    out = rows.repartition("__slice").withColumn("__digest", digest)
    earlier = (Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    for name in CATEGORICAL:
        inside = Window.partitionBy(name, "__slice").orderBy("__digest", "review_key").rowsBetween(*earlier)
        out = out.withColumns({
            f"__s_{name}": F.coalesce(F.sum(rating).over(inside), zero), f"__n_{name}": F.count("*").over(inside)})
    for name in CATEGORICAL:
        before = Window.partitionBy(name).orderBy("__slice").rowsBetween(*earlier)
        starts = staged(rows.groupBy(name, "__slice").agg(F.sum(rating).alias("s"), F.count("*").alias("n")).select(
            name, "__slice", F.coalesce(F.sum("s").over(before), zero).alias("__s"),
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__n")))
        code = _code(F.col("__s") + F.col(f"__s_{name}"), F.col("__n") + F.col(f"__n_{name}"), mean)
        out = out.join(starts, [name, "__slice"]).withColumn(f"{name}_code", code).drop("__s", "__n")
    return out.drop("__digest", "__slice", *[f"__{x}_{name}" for name in CATEGORICAL for x in "sn"])


def encoded(rows: DataFrame, codes: dict[str, DataFrame], mean: float) -> DataFrame:
    """Rows with category codes; values not seen in training get the overall mean."""
    out = prepared(rows)
    for name, table in codes.items():
        # One colour, or "unknown", may be on most rows.
        out = salted_join(out, table, [name], ["review_key"], how="left").withColumn(
            f"{name}_code", F.coalesce(f"{name}_code", F.lit(mean))
        )
    return out


def mean_rating(rows: DataFrame) -> float:
    return rows.agg(F.avg(F.col(TARGET).cast("double"))).first()[0] or 0.0


def min_class_count(rows: DataFrame) -> DataFrame:
    return rows.groupBy(TARGET).agg(F.count("*").alias("n")).agg(F.min("n").alias("min_count"))


def split(rows: DataFrame, fraction: float = VALIDATION, seed: int = SEED) -> DataFrame:
    """Rows with `validation`: the same share of every rating, the same rows on every run.

    If some rating has fewer than two rows the share is taken of all rows at once.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), "review_key"))
    marked = staged(rows).withColumn("__digest", digest)  # counted first, then ranked
    quota = F.ceil(F.col("n") * fraction)
    if (min_class_count(marked).first()[0] or 0) >= 2:
        return lowest_per_group(marked, [TARGET], "__digest", quota, "validation").drop("__digest")
    whole = marked.withColumn("__all", F.lit(0))
    return lowest_per_group(whole, ["__all"], "__digest", quota, "validation").drop("__digest", "__all")


@dataclass
class RatingModel:
    """Fitted trees with the bins and the category codes they were fitted on."""

    trees: boosting.Trees
    bins: boosting.Bins
    codes: dict[str, DataFrame]
    mean: float

    def predict(self, rows: DataFrame) -> DataFrame:
        """review_key and `predicted_rating` in [1, 5], as single precision."""
        cells = encoded(rows, self.codes, self.mean).select("review_key", self.bins.cell().alias("cell"))
        value = boosting.predictions(F.col("cell"), self.bins, self.trees)
        return cells.select("review_key", clip_rating(value).cast("float").cast("double").alias("predicted_rating"))

    def importances(self) -> dict[str, float]:
        """Share of each feature in what the splits gained; the shares sum to 1."""
        return dict(zip(self.bins.bounds, self.trees.importances(len(self.bins.bounds)).tolist()))

    def save(self, path: str) -> None:
        """Store trees, bins, codes and mean; the mean is written last and marks a complete model."""
        spark = SparkSession.active()
        trees = self.trees
        rows = [(i, f, s, g, v, trees.base, None) for i, (f, s, g, v) in enumerate(zip(
            trees.features.tolist(), trees.thresholds.tolist(), trees.gains.tolist(), trees.leaves.tolist()))]
        spark.createDataFrame(rows, boosting.TREES).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
        bounds = [(i, name, b) for i, (name, b) in enumerate(self.bins.bounds.items())]
        spark.createDataFrame(bounds, "place int, feature string, bounds array<double>").coalesce(1).write.mode(
            "overwrite").parquet(f"{path}/bins")
        for name, table in self.codes.items():
            table.write.mode("overwrite").parquet(f"{path}/codes_{name}")
        spark.createDataFrame([(self.mean,)], "mean double").write.mode("overwrite").parquet(f"{path}/mean")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RatingModel:
        codes = {c: spark.read.parquet(f"{path}/codes_{c}") for c in CATEGORICAL}
        mean = spark.read.parquet(f"{path}/mean").first()[0]
        bounds = sorted(spark.read.parquet(f"{path}/bins").collect(), key=lambda r: r["place"])
        trees = boosting.Trees.of(spark.read.parquet(f"{path}/trees").collect())
        return cls(trees, boosting.Bins({r["feature"]: list(r["bounds"]) for r in bounds}), codes, mean)

    @staticmethod
    def exists(spark: SparkSession, path: str) -> bool:
        marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/mean/_SUCCESS")
        return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def _fit(rows: DataFrame, rounds: int, depth: int, rate: float, held_out: DataFrame | None = None) -> tuple[RatingModel, list]:
    """A model fitted on all `rows`, and its trees with their squared error over the held-out rows."""
    mean = mean_rating(rows)
    codes = encodings(rows, mean)
    own = staged(ordered(rows, mean).select(*BINS, TARGET))
    bins = boosting.Bins.of(own, BINS)
    cells = boosting.grouped(own, bins, TARGET)
    others = None if held_out is None else boosting.grouped(encoded(held_out, codes, mean), bins, TARGET)
    trees = boosting.fitted(cells, bins, rounds, depth, rate, others)
    return RatingModel(boosting.Trees.of(trees), bins, codes, mean), sorted(trees, key=lambda r: r["tree"])


def train(rows: DataFrame, rounds: int = ROUNDS, depth: int = DEPTH,
          rate: float = LEARNING_RATE) -> tuple[RatingModel, dict[str, float]]:
    """Fit on 80 %, pick the best number of rounds on the other 20 %, refit on everything."""
    parts = staged(split(rows))
    fit_rows, held_out = parts.where(~F.col("validation")), parts.where("validation")
    trial, trees = _fit(fit_rows, rounds, depth, rate, held_out)
    best = min(trees, key=lambda r: (r["val_squared"], r["tree"]))["tree"] + 1
    chosen = RatingModel(trial.trees.first(best), trial.bins, trial.codes, trial.mean)
    value = boosting.predictions(F.col("cell"), chosen.bins, chosen.trees)
    scored = encoded(held_out, chosen.codes, chosen.mean).select(TARGET, chosen.bins.cell().alias("cell")).select(
        TARGET, value.alias("predicted"))
    found = metrics(scored, TARGET, "predicted").first()
    return _fit(parts, best, depth, rate)[0], {
        "val_rmse": found["rmse"], "val_mae": found["mae"], "best_iteration": best,
    }


def metrics(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    error = F.col(predicted) - F.col(truth)
    return rows.agg(F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"))


def prediction_stats(predictions: DataFrame) -> DataFrame:
    return predictions.agg(
        F.count("predicted_rating").alias("n"),
        F.avg("predicted_rating").alias("mean"),
        F.stddev_pop("predicted_rating").alias("std"),
    )


def predicted_ratings(spark: SparkSession, rows: DataFrame, path: str, **settings) -> DataFrame:
    """Predictions of the stored model, which is trained and stored first if there is none."""
    if RatingModel.exists(spark, path):
        model = RatingModel.load(spark, path)
    else:
        rows = staged(rows)
        train(rows, **settings)[0].save(path)
        model = RatingModel.load(spark, path)
    return model.predict(rows)
