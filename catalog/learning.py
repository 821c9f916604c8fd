"""Model queries: fitted and scored on the given tables.

Scores are those of the learners, so the ``clf_`` queries have no SQL. Beside each stands a ``check_`` query of the same learner
on a label planted in the given orders: row count, unusable scores, whether scores vary and whether they find the label. Boosting runs
to its patience on a label of which a tenth is wrong, so that there is a best prefix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.frames import frame, frame_sql, lending_tables, table
from catalog.tables import DIM, FILL_FIRST, rounded
from riskloom.operators import graph, metrics, models, multitask, neighbours, split, vectors
from riskloom.operators.running import with_row_ids
from riskloom.plans import applicants as A
from riskloom.plans import loans as L
from riskloom.session import materialise, new_path

NEAR = ["AMT_CREDIT", "DAYS_BIRTH", "REGION_POPULATION_RELATIVE"]
_SCALED = {
    "AMT_CREDIT": "AMT_CREDIT / 1e6",
    "DAYS_BIRTH": "DAYS_BIRTH / 25e3",
    "REGION_POPULATION_RELATIVE": "REGION_POPULATION_RELATIVE * 10e0",
}

# Three numbers per order, a label that follows two of them, and the orders held out.
_PLANTED = {"a": "((o_orderkey * 7919) % 1000) / 1000e0", "b": "((o_custkey * 104729 + o_orderkey * 31) % 997) / 997e0", "c": "((o_orderkey * 611953) % 991) / 991e0"}
_SIGNAL = "a + b > 1"
_WRONG = "(row_id * 48271) % 1009 < 101"
_HELD = "(row_id * 31 + 7) % 5 = 0"


# A value per order, its group, and a label that follows the mix of a value and its group's mean.
_GATED = {"g": "o_custkey % 211", "x": "CAST((o_orderkey * 7919) % 1000 + 3 * ((o_custkey % 211 * 7919) % 997) AS DOUBLE)"}
_GATE_SIGNAL = "(0.3e0 * x + 0.7e0 * {near} > 1900e0) <> (row_id % 97 = 5)"


def _near_rows(spark, sf) -> DataFrame:
    cols = [f"{e} AS {c}" for c, e in _SCALED.items()]
    return frame(spark, sf, "application").selectExpr("SK_ID_CURR", "TARGET", *cols)


def queries():
    def loans(spark, sf):
        return frame(spark, sf, "loans")

    def baseline(spark, sf):
        table = L.indicator_loans(loans(spark, sf), ["id"])
        rows = materialise(table.rows, "model-input")
        return (*L.split_loans(rows), table.values)

    def learner(name, **options):
        def run(spark, sf):
            train, test, columns = baseline(spark, sf)
            model = models.fit(name, train, columns, L.LABEL, valid=test, **options)
            return models.score(model, test).select("id", L.LABEL, "p")

        return run

    def mlp(spark, sf):
        table = L.category_loans(loans(spark, sf), ["id"])
        train, test = L.split_loans(materialise(table.rows, "model-input"))
        model = models.fit("mlp", train, table.values, L.LABEL)
        return models.score(model, test).select("id", L.LABEL, "p")

    def wide_deep(spark, sf):
        table, wide = L.wide_loans(loans(spark, sf), ["id"], ["id"])
        train, test = L.split_loans(materialise(table.rows, "model-input"))
        model = models.fit_wide_deep(train, wide, [*table.values, *table.codes], L.LABEL, ["id"])
        return model.score(test).select("id", L.LABEL, "p")

    def graph_model(spark, sf):
        table, wide = L.wide_loans(loans(spark, sf), ["id"], ["id"], named=True)
        rows = materialise(table.rows, "model-input")
        attributes = graph.attributes_by_count(rows.select(*table.codes), 10)
        train, test = L.split_loans(rows)
        # The share is learned inside the training rows: four fifths fit the scorer, the others judge it.
        fifth = F.pmod(F.xxhash64("id"), F.lit(5)) == 0
        marked = train.select("*", F.when(fifth, 2).otherwise(1).alias("__part")).unionByName(test.withColumn("__part", F.lit(0)))
        columns = [*table.values, *wide]
        inputs = models.learned_graph_inputs(marked, columns, attributes, L.LABEL, F.col("__part") == 1, F.col("__part") == 2)
        rows = materialise(inputs.rows, "graph-input")
        train, test = rows.filter("__part > 0"), rows.filter("__part = 0")
        model = models.fit("mlp", train, inputs.columns, L.LABEL)
        return models.score(model, test).select("id", L.LABEL, "p")

    def combined(spark, sf):
        table = L.indicator_loans(loans(spark, sf), ["id"])
        rows = table.rows.withColumnRenamed("id", "row_id")
        rows = vectors.combine(rows, frame(spark, sf, "vectors"), "x", 64)
        columns = [*table.values, *[f"feature_nn{i}" for i in range(64)]]
        train, test = L.split_loans(materialise(rows, "model-input"))
        model = models.fit("rf", train, columns, L.LABEL)
        return models.score(model, test).select("row_id", L.LABEL, "p")

    def scored(spark, sf):
        columns = FILL_FIRST
        rows = models.bounded(frame(spark, sf, "application"), columns)
        rows = with_row_ids(rows.select("SK_ID_CURR", "TARGET", *columns), ["SK_ID_CURR"])
        train, valid = split.modulo_split(rows, 0.1)
        model = models.fit("dt", train, columns, "TARGET")
        return models.score(model, valid).select("SK_ID_CURR", "TARGET", "p")

    def pca(spark, sf):
        rows = models.rebuild(frame(spark, sf, "vectors"), "x", DIM, 8)
        return vectors.reconstruction_error(rows, "x", "rebuilt")

    def pca_whole(spark, sf):
        rows = models.rebuild(frame(spark, sf, "vectors"), "x", DIM, DIM)
        return rounded(vectors.reconstruction_error(rows, "x", "rebuilt"), ["mse"], 9)

    def planted(spark, sf):
        rows = table(spark, sf, "orders").selectExpr("o_orderkey AS row_id", *[f"{e} AS {c}" for c, e in _PLANTED.items()])
        rows = materialise(rows.selectExpr("*", f"CASE WHEN {_SIGNAL} THEN 1 ELSE 0 END AS y"), "planted")
        return rows.filter(f"NOT ({_HELD})"), rows.filter(_HELD)

    def checked(scores):
        return scores.agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("p").isNull() | ~F.col("p").between(0, 1)).alias("unusable"),
            (F.min("p") < F.max("p")).alias("varies"),
        ).crossJoin(metrics.auc(scores, "y").select((F.col("auc") > 0.85).alias("finds_label")))

    def check(name, **options):
        def run(spark, sf):
            train, held = planted(spark, sf)
            model = models.fit(name, train, list(_PLANTED), "y", valid=held, **options)
            return checked(materialise(models.score(model, held), "scores"))

        return run

    def check_boosting(name):
        def run(spark, sf):
            train, held = (part.withColumn("y", F.expr(f"CASE WHEN (y = 1) <> ({_WRONG}) THEN 1 ELSE 0 END")) for part in planted(spark, sf))
            model = models.fit(name, train, list(_PLANTED), "y", valid=held)
            return checked(materialise(models.score(model, held), "scores"))

        return run

    def check_rf_combined(spark, sf):
        """The label's two columns come as external vectors, so a forest without them finds nothing."""
        train, held = planted(spark, sf)
        rows = train.unionByName(held)
        external = rows.select("row_id", F.array("a", "b").alias("x"))
        rows = materialise(vectors.combine(rows.select("row_id", "c", "y"), external, "x", 2), "model-input")
        columns = ["c", "feature_nn0", "feature_nn1"]
        model = models.fit("rf", rows.filter(f"NOT ({_HELD})"), columns, "y")
        return checked(materialise(models.score(model, rows.filter(_HELD)), "scores"))

    def check_multitask(spark, sf):
        """Codes of the given vectors, trained on a label that four of their elements tell."""
        rows = frame(spark, sf, "vectors").select("row_id", F.transform("x", lambda v: v.cast("double")).alias("x"))
        told = F.get("x", F.lit(0)) + F.get("x", F.lit(1)) > F.get("x", F.lit(2)) + F.get("x", F.lit(3))
        rows = materialise(rows.withColumn("y", told.cast("int")), "vectors")
        model = multitask.fit(rows, "x", "y", DIM, code=8, steps=25)
        falls = all(a > b for a, b in zip(model.losses, model.losses[1:]))
        scores = checked(materialise(model.score(rows).select("y", "p"), "scores"))
        return scores.select("*", F.lit(falls).alias("falls"), F.lit(model.aggregates <= len(model.losses) + 3).alias("one_pass_a_step"))

    def check_wide_deep(spark, sf):
        flags = {"f_a": (F.col("a") > 0.5).cast("int"), "f_b": (F.col("b") > 0.5).cast("int")}
        train, held = (part.withColumns(flags) for part in planted(spark, sf))
        model = models.fit_wide_deep(train, list(flags), list(_PLANTED), "y", ["row_id"])
        return checked(materialise(model.score(held), "scores"))

    def check_graph(spark, sf):
        train, held = planted(spark, sf)
        rows = train.unionByName(held).withColumn("g", F.floor(F.col("a") * 20).cast("int"))
        inputs = models.graph_inputs(rows, list(_PLANTED), ["g"], share=0.5)
        rows = materialise(inputs.rows, "graph-input")
        model = models.fit("mlp", rows.filter(f"NOT ({_HELD})"), inputs.columns, "y")
        return checked(materialise(models.score(model, rows.filter(_HELD)), "scores"))

    def one_split(spark, sf):
        """A label that one split tells apart, so a tree's scores are the label itself."""
        rows = table(spark, sf, "orders").selectExpr("o_orderkey AS row_id", "o_orderkey % 20 AS a", "CASE WHEN o_orderkey % 20 >= 10 THEN 1 ELSE 0 END AS y")
        rows = materialise(rows, "planted")
        return rows.filter(f"NOT ({_HELD})"), rows.filter(_HELD)

    def gate_rows(spark, sf):
        rows = table(spark, sf, "orders").selectExpr("o_orderkey AS row_id", *[f"{e} AS {c}" for c, e in _GATED.items()])
        rows = graph.propagate(rows, ["x"], by=["g"])
        return materialise(rows.withColumn("y", F.expr(f"CASE WHEN {_GATE_SIGNAL.format(near='prop_x')} THEN 1 ELSE 0 END")), "gated")

    def graph_gate(spark, sf):
        """The area of every share, and which one is chosen: the label follows the mix at 0.3 with every 97th row wrong."""
        rows = gate_rows(spark, sf)
        areas = graph.share_areas(rows, "y", "x", "prop_x")
        share, _ = graph.learned_share(rows, "y", "x", "prop_x")
        return rounded(areas.withColumn("chosen", F.col("share") == share), ["auc"], 9)

    def exact_score(spark, sf):
        train, held = one_split(spark, sf)
        return models.score(models.fit("dt", train, ["a"], "y"), held).select("row_id", "y", "p")

    def saved_score(spark, sf):
        train, held = one_split(spark, sf)
        path = new_path(spark, "model")
        models.save(models.fit("dt", train, ["a"], "y"), path)
        return models.score(models.load(path), held).select("row_id", "y", "p")

    def chosen_setting(spark, sf):
        """A label of two cuts: one level can't tell it, two can, and more add nothing."""
        rows = table(spark, sf, "orders").selectExpr("o_orderkey AS row_id", "o_orderkey % 20 AS a")
        rows = materialise(rows.withColumn("y", F.col("a").between(5, 11).cast("int")), "planted")
        settings = [{"depth": d} for d in (1, 2, 3, 4)]
        _, options, area = models.best_of("dt", settings, rows.filter(f"NOT ({_HELD})"), rows.filter(_HELD), ["a"], "y", patience=1)
        return spark.createDataFrame([(options["depth"], area)], "depth int, auc double")

    def near(spark, sf):
        rows = _near_rows(spark, sf).filter("TARGET = 1")
        return rounded(neighbours.nearest_neighbours(rows, "SK_ID_CURR", NEAR, 5), ["distance"], 9)

    def near_hashed(spark, sf):
        rows = _near_rows(spark, sf).filter("TARGET = 1")
        return rounded(neighbours.hashed_neighbours(rows, "SK_ID_CURR", NEAR, 5), ["distance"], 9)

    def check_near_hashed(spark, sf):
        found = neighbours.recall(near_hashed(spark, sf), near(spark, sf), "SK_ID_CURR")
        return found.select("n", (F.col("recall") >= 0.9).alias("finds_most"))

    def applicant_graph(spark, sf):
        table = A.coded_applicants(A.applicant_features(A.gathered(lending_tables(spark, sf))))
        rows, _ = A.applicant_clusters(table)
        return rows.select("SK_ID_CURR", "TARGET", *table.codes, "cluster_id", "degree")

    return {
        "applicant_graph": applicant_graph,
        "clf_lr": learner("lr"),
        "clf_dt": learner("dt"),
        "clf_rf": learner("rf"),
        "clf_gbt": learner("gbt"),
        "clf_gbt_slow": learner("gbt_slow"),
        "clf_mlp": mlp,
        "clf_wide_deep": wide_deep,
        "clf_graph": graph_model,
        "clf_rf_combined": combined,
        "score": scored,
        "pca_reconstruct": pca,
        "pca_whole": pca_whole,
        "graph_gate": graph_gate,
        "score_exact": exact_score,
        "score_saved": saved_score,
        "chosen_setting": chosen_setting,
        "check_gbt": check_boosting("gbt"),
        "check_gbt_leaves": check_boosting("gbt_slow"),
        "check_rf_combined": check_rf_combined,
        "check_multitask": check_multitask,
        **{f"check_{name}": check(name) for name in ("dt", "rf", "mlp")},
        "check_lr": check("lr", inverse_penalty=1.0),
        "check_wide_deep": check_wide_deep,
        "check_graph": check_graph,
        "nearest_minority": near,
        "nearest_hashed": near_hashed,
        "check_nearest_hashed": check_near_hashed,
        "smote": lambda s, d: rounded(neighbours.oversample_minority(_near_rows(s, d), "TARGET", "SK_ID_CURR", NEAR), NEAR, 9),
    }


def oracle():
    rows = f"SELECT SK_ID_CURR, TARGET, {', '.join(f'{e} AS {c}' for c, e in _SCALED.items())} FROM ({frame_sql('application')})"
    gap = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in NEAR)
    ranked = (
        f"SELECT a.SK_ID_CURR, b.SK_ID_CURR AS neighbour, sqrt({gap}) AS distance, row_number() OVER (PARTITION BY a.SK_ID_CURR ORDER BY sqrt({gap}), "
        "b.SK_ID_CURR) AS k FROM m a JOIN m b ON a.SK_ID_CURR <> b.SK_ID_CURR"
    )
    minority = f"m AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY SK_ID_CURR) - 1 AS pos FROM ({rows}) WHERE TARGET = 1)"
    seed, near = 42, 5
    drawn = {
        what: f"(id * {times} + {seed * salt}) % {below}"
        for (what, (times, salt)), below in zip(neighbours.DRAW.items(), ("pos", f"least({near}, pos - 1)", str(neighbours.GAP_STEPS)), strict=True)
    }
    between = ", ".join(f"round(a.{c} + gap * (b.{c} - a.{c}), 9) + 0e0 AS {c}" for c in NEAR)
    plan = (
        f"SELECT {drawn['pos']} AS at, 1 + {drawn['rank']} AS k, ({drawn['gap']}) / {float(neighbours.GAP_STEPS)!r}e0 AS gap FROM "
        f"(SELECT count(*) FILTER (WHERE TARGET = 1) AS pos, count(*) FILTER (WHERE TARGET = 0) AS neg FROM ({rows})), range(1000000) r(id) "
        "WHERE id < neg - pos"
    )
    made = (
        f"SELECT CAST(NULL AS BIGINT) AS SK_ID_CURR, 1 AS TARGET, {between} FROM plan JOIN m a ON a.pos = plan.at JOIN d ON d.SK_ID_CURR = a.SK_ID_CURR "
        "AND d.k = plan.k JOIN m b ON b.SK_ID_CURR = d.neighbour"
    )
    planted = f"SELECT o_orderkey AS row_id FROM orders WHERE {_HELD.replace('row_id', 'o_orderkey')}"
    found = f"SELECT count(*) AS n, CAST(0 AS BIGINT) AS unusable, true AS varies, true AS finds_label FROM ({planted})"
    mixed = (
        f"SELECT *, CASE WHEN {_GATE_SIGNAL.format(near='near')} THEN 1 ELSE 0 END AS y FROM (SELECT row_id, x, avg(x) OVER (PARTITION BY g) AS near "
        f"FROM (SELECT o_orderkey AS row_id, {', '.join(f'{e} AS {c}' for c, e in _GATED.items())} FROM orders))"
    )
    tried = " UNION ALL ".join(f"SELECT {s!r}e0 AS share, y, {s!r}e0 * x + {1 - s!r}e0 * near AS p FROM mixed" for s in graph.SHARES)
    ranked_shares = (
        f"SELECT share, y, rank() OVER (PARTITION BY share ORDER BY p) + (count(*) OVER (PARTITION BY share, p) - 1) / 2e0 AS r FROM ({tried})"
    )
    # Rank sums with mid-ranks.
    areas = (
        "SELECT share, (sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2e0) / (CAST(sum(y) AS DOUBLE) * sum(1 - y)) AS auc "
        f"FROM ({ranked_shares}) GROUP BY share"
    )
    gate = (
        f"WITH mixed AS MATERIALIZED ({mixed}), areas AS MATERIALIZED ({areas}) SELECT share, round(auc, 9) + 0e0 AS auc, "
        "share = (SELECT max(share) FROM areas WHERE auc = (SELECT max(auc) FROM areas)) AS chosen FROM areas"
    )
    names = ("lr", "dt", "rf", "mlp", "wide_deep", "graph", "gbt", "gbt_leaves", "rf_combined")
    exact = (
        "SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 20 >= 10 THEN 1 ELSE 0 END AS y, CASE WHEN o_orderkey % 20 >= 10 "
        f"THEN 1e0 ELSE 0e0 END AS p FROM orders WHERE {_HELD.replace('row_id', 'o_orderkey')}"
    )
    return {
        "nearest_minority": f"WITH {minority}, d AS ({ranked}) SELECT SK_ID_CURR, CAST(k - 1 AS INTEGER) AS rank, neighbour, "
        "round(distance, 9) + 0e0 AS distance FROM d WHERE k <= 5",
        "check_nearest_hashed": f"SELECT CAST(count(*) * least(5, count(*) - 1) AS BIGINT) AS n, true AS finds_most FROM ({rows}) WHERE TARGET = 1",
        "smote": f"WITH {minority}, d AS MATERIALIZED (SELECT * FROM ({ranked}) WHERE k <= {near}), plan AS ({plan}) SELECT SK_ID_CURR, TARGET, "
        f"{', '.join(f'round({c}, 9) + 0e0 AS {c}' for c in NEAR)} FROM ({rows}) UNION ALL {made}",
        "pca_whole": "SELECT CASE WHEN count(*) > 0 THEN 0e0 END AS mse FROM embeddings",
        "graph_gate": gate,
        "check_multitask": "SELECT count(*) AS n, CAST(0 AS BIGINT) AS unusable, true AS varies, true AS finds_label, true AS falls, "
        "true AS one_pass_a_step FROM embeddings",
        "score_exact": exact,
        "score_saved": exact,
        "chosen_setting": "SELECT CAST(2 AS INTEGER) AS depth, 1e0 AS auc",
        **{f"check_{name}": found for name in names},
    }
