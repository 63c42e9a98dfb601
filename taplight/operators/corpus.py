"""Domain corpora: checked rows, one corpus from several sources, and how a model does on captures and unseen families."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taplight.functions import samples, text
from taplight.operators.evaluate import threshold_sweep

# What a label may be called.
LABELS = {"0": 0, "1": 1, "benign": 0, "legit": 0, "dga": 1, "malicious": 1}


def checked(rows: DataFrame) -> DataFrame:
    """(domain, label, family, reason): each normal domain once; one with several labels or families has a reason.

    ``rows`` has domain and label as texts, and perhaps family; a missing family is a reason where there is the column.
    """
    table = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    family = F.nullif(F.trim("family"), F.lit("")) if "family" in rows.columns else F.lit(None).cast("string")
    read = rows.select(F.col("domain").alias("raw"), text.normal_domain(F.col("domain")).alias("domain"), F.try_element_at(table, F.lower(F.trim("label"))).alias("label"), family.alias("family"))
    lacks = F.col("family").isNull() if "family" in rows.columns else F.lit(False)
    one = read.withColumn("wrong", F.when(F.col("domain").isNull(), "domain").when(F.col("label").isNull(), "label").when(lacks, "family"))
    bad = one.where("wrong is not null").select(F.col("raw").alias("domain"), "label", "family", F.col("wrong").alias("reason"))
    good = one.where("wrong is null").groupBy("domain").agg(F.min("label").alias("label"), F.max("label").alias("top"), F.min("family").alias("family"), F.max("family").alias("last"))
    conflict = F.when(F.col("label") != F.col("top"), "labels").when(F.col("family") != F.col("last"), "families")
    return good.select("domain", "label", "family", conflict.alias("reason")).unionByName(bad)


def build(positives: DataFrame, benign: DataFrame, per_family: int, most_benign: int, seed: int) -> DataFrame:
    """(domain, label, family): families' domains that no other family claims, so many of each at most, and benign ones
    that no family claims."""
    named = positives.select(text.normal_domain(F.col("domain")).alias("domain"), "family").where("domain is not null").distinct()
    claimed = named.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.min("family").alias("family"))
    kept = samples.capped(claimed.where("n = 1").select("domain", "family"), "family", "domain", per_family, seed)
    clean = benign.select(text.normal_domain(F.col("domain")).alias("domain")).where("domain is not null").distinct().join(claimed.select("domain"), "domain", "left_anti")
    few = samples.capped(clean.withColumn("family", F.lit("benign")), "family", "domain", most_benign, seed)
    return kept.select("domain", F.lit(1).alias("label"), "family").unionByName(few.select("domain", F.lit(0).alias("label"), "family"))


def overlap(train: DataFrame, test: DataFrame, key: str = "domain") -> DataFrame:
    """Keys that are on both sides of a split; there must be none."""
    return train.select(key).intersect(test.select(key))


def on_captures(scored: DataFrame, threshold: float, without: list[str]) -> DataFrame:
    """Confusion counts and shares on all queries, on each domain once, and without the producers named.

    ``scored`` has domain, producer, label and score.
    """
    views = {"all": scored, "distinct": scored.dropDuplicates(["domain"]), "without": scored.where(~F.col("producer").isin(*without))}
    parts = [threshold_sweep(df, [threshold]).withColumn("view", F.lit(name)) for name, df in views.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def by_producer(scored: DataFrame, threshold: float) -> DataFrame:
    over = F.count_if(F.col("score") >= threshold)
    of = lambda f: F.round(f("score"), 4)
    return scored.groupBy("producer", "label").agg(F.count(F.lit(1)).alias("queries"), over.alias("over_threshold"), of(F.min).alias("score_min"), of(F.avg).alias("score_mean"), of(F.max).alias("score_max"))


def unseen(candidates: DataFrame, train: DataFrame, cap: int, seed: int) -> DataFrame:
    """Domains of families that training didn't see, so many of each at most, none of them a training domain."""
    new = candidates.join(train.select("family").distinct(), "family", "left_anti").dropDuplicates(["domain"])
    return samples.capped(new, "family", "domain", cap, seed).join(train.select("domain").distinct(), "domain", "left_anti")


def family_recall(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.where("label = 1").groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("score") >= threshold).cast("int")), 6).alias("recall"))
