import random

from taplight.operators import corpus, domain_model, evaluate


def test_forest_and_baseline_tell_generated_names_apart(spark):
    r = random.Random(1)
    syllables = ["ba", "no", "ri", "shop", "home", "ter", "lan", "go", "mi", "net"]
    good = [("".join(r.choice(syllables) for _ in range(r.randint(2, 4))) + ".com", 0) for _ in range(300)]
    bad = [("".join(r.choice("0123456789bcdfghjklmnpqrstvwxz") for _ in range(14)) + ".net", 1) for _ in range(120)]
    rows = spark.createDataFrame(list(dict(good + bad).items()), "domain string, label int")
    train, test = domain_model.split(rows)
    assert corpus.overlap(train, test).count() == 0
    forest = domain_model.fit(train, trees=15)
    for model in (forest, domain_model.fit_baseline(train)):
        scored = domain_model.score(model, test)
        assert evaluate.ranking_metrics(scored.select("score", "label")).first()["roc_auc"] > 0.97
    found = domain_model.importances(forest)
    assert len(found) == 19 and abs(sum(found.values()) - 1) < 1e-6
