"""Domain corpora from names of the pages, and how scores do on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from taplight.operators import corpus
from taplight.plans.catalog import query
from taplight.plans.protocol_queries import _HOST
from taplight.sources import views

_P = f"p AS (SELECT page_id AS i, {_HOST} AS host FROM pages)"


def _pages(spark, sf_dir):
    return views.read(spark, sf_dir, "pages").select(F.col("page_id").alias("i"), F.expr(_HOST).alias("host"))


_ROWS = ("CASE i % 6 WHEN 0 THEN upper(host) || '.' ELSE host END AS domain", "CASE i % 50 WHEN 1 THEN 'unknown' WHEN 2 THEN ' DGA ' ELSE '0' END AS label", "CASE WHEN i % 70 = 3 THEN ' ' ELSE concat('f', i % 2) END AS family")


@query(
    "domain_rows",
    f"""WITH {_P}, r AS (SELECT i, host, CASE i % 50 WHEN 1 THEN NULL WHEN 2 THEN 1 ELSE 0 END AS label, CASE WHEN i % 70 = 3 THEN NULL ELSE concat('f', i % 2) END AS family FROM p), g AS (SELECT host, min(label) AS label, max(label) AS top, min(family) AS family, max(family) AS last FROM r WHERE label IS NOT NULL AND family IS NOT NULL AND host <> '' GROUP BY host)
    SELECT coalesce(reason, 'good') AS reason, count(*) AS n FROM (SELECT CASE WHEN label <> top THEN 'labels' WHEN family <> last THEN 'families' END AS reason FROM g UNION ALL SELECT CASE WHEN host = '' THEN 'domain' WHEN label IS NULL THEN 'label' ELSE 'family' END FROM r WHERE host = '' OR label IS NULL OR family IS NULL) t GROUP BY 1""",
)
def domain_rows(spark, sf_dir):
    rows = _pages(spark, sf_dir).selectExpr(*_ROWS)
    return corpus.checked(rows).groupBy(F.coalesce("reason", F.lit("good")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_CLAIMS = "d AS (SELECT DISTINCT host AS domain, concat('f', (i // 3) % 3) AS family FROM p WHERE host <> '' AND i % 3 = 0), c AS (SELECT domain, min(family) AS family, count(*) AS n FROM d GROUP BY 1)"


def _corpus(spark, sf_dir):
    rows = _pages(spark, sf_dir)
    return corpus.build(rows.where("i % 3 = 0").select(F.col("host").alias("domain"), F.expr("concat('f', CAST(i div 3 % 3 AS STRING))").alias("family")), rows.select(F.col("host").alias("domain")), 4, 7, seed=5)


@query(
    "corpus_sizes",
    f"""WITH {_P}, {_CLAIMS} SELECT family, 1 AS label, least(count(*), 4) AS n FROM c WHERE n = 1 GROUP BY 1 UNION ALL SELECT 'benign', 0, least((SELECT count(DISTINCT host) FROM p WHERE host <> '' AND host NOT IN (SELECT domain FROM c)), 7)""",
)
def corpus_sizes(spark, sf_dir):
    """The corpus built from the pages' names: which names a cap leaves is a hash's choice, how many is not; of benign
    names there may be none, which is a row too."""
    rows, n = _corpus(spark, sf_dir), F.count(F.lit(1)).alias("n")
    benign = rows.where("label = 0").agg(n).select(F.lit("benign").alias("family"), F.lit(0).alias("label"), "n")
    return rows.where("label = 1").groupBy("family", "label").agg(n).unionByName(benign)


_SCORED = f"{_P}, s AS (SELECT i, host AS domain, concat('p', i % 5) AS producer, CAST(i % 5 = 1 AS INT) AS label, (i * 37 % 101) / 100.0 AS score FROM p)"


def _scored(spark, sf_dir):
    return _pages(spark, sf_dir).select(F.col("i"), F.concat("host", F.col("i") % 3).alias("domain"), F.concat(F.lit("p"), F.col("i") % 5).alias("producer"), (F.col("i") % 5 == 1).cast("int").alias("label"), (F.col("i") * 37 % 101 / 100.0).alias("score"))


@query(
    "capture_scores",
    f"""WITH {_SCORED}, v AS (SELECT 'all' AS view, * FROM s UNION ALL SELECT 'without', * FROM s WHERE producer <> 'p2'), c AS (SELECT view, count(CASE WHEN score >= 0.5 AND label = 1 THEN 1 END) AS tp, count(CASE WHEN score >= 0.5 AND label = 0 THEN 1 END) AS fp, count(CASE WHEN score < 0.5 AND label = 0 THEN 1 END) AS tn, count(CASE WHEN score < 0.5 AND label = 1 THEN 1 END) AS fn FROM v GROUP BY 1)
    SELECT view, tp, fp, tn, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM c""",
)
def capture_scores(spark, sf_dir):
    """On all queries and without one producer; which of a domain's queries is scored once is left open."""
    rows = corpus.on_captures(_scored(spark, sf_dir), 0.5, ["p2"]).where("view <> 'distinct'")
    return rows.select("view", "tp", "fp", "tn", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(
    "producer_scores",
    f"WITH {_SCORED} SELECT producer, label, count(*) AS queries, count(CASE WHEN score >= 0.5 THEN 1 END) AS over_threshold, round(min(score), 4) AS score_min, round(avg(score), 4) AS score_mean, round(max(score), 4) AS score_max FROM s GROUP BY ALL",
)
def producer_scores(spark, sf_dir):
    return corpus.by_producer(_scored(spark, sf_dir), 0.5)


@query(
    "unseen_families",
    f"""WITH {_P}, c AS (SELECT host || (i % 40) AS domain, min(concat('g', i % 4)) AS family FROM p WHERE i % 4 < 3 GROUP BY 1), t AS (SELECT host || (i % 40) AS domain FROM p WHERE i % 4 = 3)
    SELECT family, count(*) AS n FROM c WHERE domain NOT IN (SELECT domain FROM t) GROUP BY 1""",
)
def unseen_families(spark, sf_dir):
    rows = _pages(spark, sf_dir).select("i", F.concat("host", (F.col("i") % 40).cast("string")).alias("domain"), F.concat(F.lit("g"), F.col("i") % 4).alias("family"))
    candidates = rows.where("i % 4 < 3").groupBy("domain").agg(F.min("family").alias("family"))
    return corpus.unseen(candidates, rows.where("i % 4 = 3"), 1_000_000_000, 3).groupBy("family").agg(F.count(F.lit(1)).alias("n"))


@query("split_overlap", f"WITH {_P} SELECT count(*) AS shared FROM (SELECT host FROM p WHERE i % 2 = 0 INTERSECT SELECT host FROM p WHERE i % 2 = 1) t")
def split_overlap(spark, sf_dir):
    rows = _pages(spark, sf_dir).withColumnRenamed("host", "domain")
    return corpus.overlap(rows.where("i % 2 = 0"), rows.where("i % 2 = 1")).agg(F.count(F.lit(1)).alias("shared"))


_NAMES = "SELECT concat('name', c_custkey % 700) AS domain, CASE WHEN c_custkey % 700 % 3 > 0 THEN 1 ELSE 0 END AS label, CASE WHEN c_custkey % 700 % 3 > 0 THEN concat('family', c_custkey % 700 % 17) END AS family, c_custkey FROM {customer}"


@query(
    "family_split",
    f"""WITH r AS ({_NAMES.format(customer="customer")}), z AS (SELECT family, count(*) AS n FROM r WHERE label = 1 GROUP BY family), p AS (SELECT family, sum(n) OVER w AS upto, n, row_number() OVER w AS place, sum(n) OVER () AS total, count(*) OVER () AS families FROM z WINDOW w AS (ORDER BY md5('42:' || family), family))
    SELECT c_custkey, family, CASE WHEN label = 1 THEN place = 1 OR (upto - n / 2 <= total * 0.25 AND place < families) ELSE substr(md5('42:' || domain), 1, 8) < '40000000' END AS test FROM r LEFT JOIN p USING (family)""",
)
def family_split(spark, sf_dir):
    """Names of generated families and of none, split so that no family is on both sides."""
    from taplight.operators.domain_model import split_by_family
    from taplight.sources import shared

    with shared.view(views.read(spark, sf_dir, "customer")) as customer:
        rows = spark.sql(_NAMES.format(customer=customer))
    return split_by_family(rows).select("c_custkey", "family", "test")
