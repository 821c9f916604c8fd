import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from riskloom.operators import metrics, models, split

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def parts(spark):
    """Label follows two columns; the third is noise."""
    df = spark.range(3000).select(
        F.col("id").alias("row_id"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 1000).alias("a"),
        (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1000)) / 1000).alias("b"),
        (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1000)) / 1000).alias("c"),
    )
    noise = F.pmod(F.xxhash64("row_id", F.lit(4)), F.lit(1000)) / 1000
    df = df.withColumn("y", (F.col("a") + F.col("b") + 0.3 * noise > 1.15).cast("int"))
    train, valid = split.modulo_split(df, 0.2)
    return train.cache(), valid.cache()


OPTIONS = {
    "LR": {"inverse_penalty": 1.0},
    "dt": {},
    "rf": {"trees": 10},
    "gbt": {},
    "gbt_slow": {"rounds": 30, "patience": 10},
    "mlp": {"hidden": [8, 4], "max_iter": 60},
}


@pytest.mark.parametrize("name", list(OPTIONS))
def test_learners_find_the_signal(parts, name):
    train, valid = parts
    model = models.fit(name, train, COLUMNS, "y", valid=valid, **OPTIONS[name])
    out = models.score(model, valid)
    assert out.count() == valid.count()
    assert out.filter("p IS NULL OR p < 0 OR p > 1").count() == 0
    assert metrics.auc(out, "y").first()["auc"] > 0.85
    assert out.select("p").distinct().count() > 1


def test_class_weights_come_from_training_rows(parts, monkeypatch):
    train, valid = parts
    seen = []
    real = models.with_class_weights
    monkeypatch.setattr(models, "with_class_weights", lambda df, *a: seen.append(df.count()) or real(df, *a))
    models.fit("gbt", train, COLUMNS, "y", valid=valid, rounds=2)
    assert seen == [train.count()]


def test_unknown_name(parts):
    with pytest.raises(ValueError, match="unknown model"):
        models.fit("svm", parts[0], COLUMNS, "y")


def test_same_seed_same_scores_and_saved_model(parts, tmp_path):
    train, valid = parts
    a = models.fit("rf", train, COLUMNS, "y", trees=5, depth=4)
    b = models.fit("rf", train, COLUMNS, "y", trees=5, depth=4)
    models.save(a, str(tmp_path / "m"))
    loaded = models.load(str(tmp_path / "m"))
    scores = [[r["p"] for r in models.score(m, valid).orderBy("row_id").collect()] for m in (a, b, loaded)]
    assert scores[0] == scores[1] == scores[2]


def test_best_setting_wins(parts):
    train, valid = parts
    model, options, found = models.best_of("dt", [{"depth": 1}, {"depth": 5}], train, valid, COLUMNS, "y")
    assert options == {"depth": 5} and found > 0.85


def test_wide_deep(parts):
    train, valid = parts
    flags = ["f0", "f1"]
    add = {"f0": (F.col("a") > 0.5).cast("int"), "f1": (F.col("b") > 0.5).cast("int")}
    model = models.fit_wide_deep(train.withColumns(add), flags, COLUMNS, "y", ["row_id"], hidden=[8, 4], max_iter=30)
    out = model.score(valid.withColumns(add))
    assert set(out.columns) == {*valid.columns, *flags, "p"}
    assert metrics.auc(out, "y").first()["auc"] > 0.8


def test_graph_inputs_help_when_neighbours_share_the_signal(spark):
    rows = spark.range(2000).select(
        F.col("id").alias("row_id"),
        (F.col("id") % 40).cast("int").alias("g"),
        ((F.col("id") % 40) / 40 + 2 * (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000)).alias("x"),
    )
    rows = rows.withColumn("y", (F.col("g") >= 20).cast("int"))
    inputs = models.graph_inputs(rows, ["x"], ["g"], share=0.2)
    assert inputs.columns == ["x", "mix_x"] and inputs.rows.count() == 2000
    train, valid = split.modulo_split(inputs.rows, 0.2)
    plain = models.score(models.fit("dt", train, ["x"], "y"), valid)
    smoothed = models.score(models.fit("dt", train, inputs.columns, "y"), valid)
    assert metrics.auc(smoothed, "y").first()["auc"] > metrics.auc(plain, "y").first()["auc"]


def test_learned_graph_inputs_lean_on_neighbours_that_tell_more(spark):
    rows = spark.range(2000).select(
        F.col("id").alias("row_id"),
        (F.col("id") % 40).cast("int").alias("g"),
        ((F.col("id") % 40) / 40 + 2 * (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000)).alias("x"),
    )
    part = F.col("row_id") % 3
    groups = rows.withColumn("y", (F.col("g") >= 20).cast("int"))
    found = models.learned_graph_inputs(groups, ["x"], ["g"], "y", part == 0, part == 1, inverse_penalty=1.0)
    assert found.share <= 0.2 and found.columns == ["x", "mix_x"] and found.rows.columns[-1] == "mix_x"
    alone = rows.withColumn("y", (F.col("x") - F.col("g") / 40 > 1).cast("int"))
    assert models.learned_graph_inputs(alone, ["x"], ["g"], "y", part == 0, part == 1, inverse_penalty=1.0).share >= 0.9


def test_infinite_input_is_bounded(spark):
    df = spark.createDataFrame([(float("inf"), 1), (None, 0), (float("nan"), 1)], "x double, y int")
    assert sorted(r["x"] for r in models.bounded(df, ["x"]).collect()) == [0.0, 0.0, 1e30]


def test_reconstruction_improves_with_more_components(spark):
    from riskloom.operators.vectors import reconstruction_error

    df = spark.range(200).select(F.array(*[F.sin(F.col("id") * (i + 1) / 7).alias(f"v{i}") for i in range(6)]).alias("x"))
    errors = [reconstruction_error(models.rebuild(df, "x", 6, k), "x", "rebuilt").first()["mse"] for k in (1, 3, 6)]
    assert errors[0] > errors[1] > errors[2] and errors[2] < 1e-12


@pytest.mark.parametrize("name", ["lr", "rf"])
def test_scores_after_rows_were_observed_in_the_session(spark, parts, name):
    """An observation in the session must not keep a two-class model from being sent to tasks."""
    seen = Observation()
    spark.range(5).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 5}
    train, valid = parts
    model = models.fit(name, train, COLUMNS, "y", **OPTIONS.get(name, OPTIONS["LR"]))
    assert models.score(model, valid).filter("p IS NULL").count() == 0
