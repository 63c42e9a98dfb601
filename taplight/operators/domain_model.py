"""A forest over lexical measures of domain names."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taplight.functions import text

# Names and order of the measures.
FEATURES = ("length", "body_length", "tld_length", "label_count", "max_label_length", "mean_label_length", "digit_count", "digit_ratio", "alpha_ratio", "vowel_ratio", "consonant_ratio", "hyphen_count", "hyphen_ratio", "unique_char_count", "unique_char_ratio", "entropy", "longest_digit_run", "longest_alpha_run", "longest_consonant_run")


def features(domains: DataFrame) -> DataFrame:
    """Distinct names with their measures as a vector; names repeat often, so each is measured once."""
    measures = text.lexical_features(F.col("domain"))
    wide = domains.select("domain").distinct().select("domain", *(F.coalesce(measures[c].cast("double"), F.lit(0.0)).alias(c) for c in FEATURES))
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(wide).select("domain", "features")


def split(rows: DataFrame, group: str = "domain", test_share: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """Disjoint by ``group``: all rows of a group fall on one side."""
    part = F.pmod(F.xxhash64(group), F.lit(1000)) < int(test_share * 1000)
    return rows.where(~part), rows.where(part)


def _digest(column: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(column).cast("string"), F.lit(""))).cast("binary"))


def split_by_family(rows: DataFrame, label: str = "label", family: str = "family", name: str = "domain", test_share: float = 0.25, seed: int = 42) -> DataFrame:
    """``rows`` with ``test``: families of class 1 go whole to one side, so that no family is known from training.

    Families follow one another by a digest; running sums of their sizes put those to the test side whose middle lies
    within the share, at least the first and never the last.  Names of other classes fall to a side each by its own
    digest.  With less than two families every class is split by names; a class of one name isn't tested.  A name's
    rows stay together throughout.
    """
    held = F.substring(_digest(name, seed), 1, 8) < F.lit(f"{int(test_share * 16**8):08x}")
    one = rows.where(F.col(label) == 1)
    sizes = one.groupBy(F.col(family).alias("sf__family")).agg(F.count(F.lit(1)).alias("n")).where(F.col("sf__family").isNotNull())
    order = Window.orderBy(_digest("sf__family", seed), "sf__family")  # a row per family
    placed = sizes.withColumns({"upto": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)), "place": F.row_number().over(order), "all": F.sum("n").over(Window.partitionBy()), "families": F.count(F.lit(1)).over(Window.partitionBy())})
    middle = F.col("upto") - F.col("n") / 2
    chosen = placed.where("families >= 2").select("sf__family", ((F.col("place") == 1) | ((middle <= F.col("all") * test_share) & (F.col("place") < F.col("families")))).alias("sf__test"))
    alone = rows.groupBy(F.col(label).alias("sf__label")).agg((F.count_distinct(name) < 2).alias("sf__alone"))
    marked = rows.join(chosen, (F.col(family) == F.col("sf__family")) & (F.col(label) == 1), "left").join(F.broadcast(alone), F.col(label).eqNullSafe(F.col("sf__label")), "left")
    return marked.withColumn("test", F.coalesce("sf__test", held & ~F.col("sf__alone"))).drop("sf__family", "sf__test", "sf__label", "sf__alone")


def _weighted(train: DataFrame) -> DataFrame:
    """Rows with measures and a weight: classes weigh the same whatever their sizes."""
    rows = train.join(features(train), "domain")
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 1
    return rows.join(F.broadcast(counts), "label").withColumn("weight", F.lit(float(total)) / (2 * F.col("n")))


def fit(train: DataFrame, trees: int = 200, seed: int = 42) -> RandomForestClassificationModel:
    return RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=10, seed=seed).fit(_weighted(train))


def fit_baseline(train: DataFrame) -> PipelineModel:
    """A logistic regression on standardised measures, to hold the forest against."""
    stages = [StandardScaler(inputCol="features", outputCol="scaled", withMean=True), LogisticRegression(featuresCol="scaled", labelCol="label", weightCol="weight", maxIter=100)]
    return Pipeline(stages=stages).fit(_weighted(train))


def importances(model: RandomForestClassificationModel) -> dict[str, float]:
    return dict(zip(FEATURES, model.featureImportances.toArray().tolist(), strict=True))


def score(model: RandomForestClassificationModel | PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with the probability of class 1: the mean of a forest's trees, or the baseline's."""
    scored = model.transform(features(rows)).select("domain", vector_to_array("probability")[1].alias("score"))
    return rows.join(scored, "domain")
