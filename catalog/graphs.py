"""Queries and SQL for the applicant graph and for evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.frames import FRAMES, frame, frame_sql
from catalog.tables import _CLEAN, CLEAN, _per_column, rounded
from riskloom.operators import encode, graph, metrics, vectors
from riskloom.plans import loans as L

VALUES = ["root_amnt", "root_rate"]  # roots: their means do not fall on a rounding edge
ROOTS = {"root_amnt": "sqrt(loan_amnt)", "root_rate": "sqrt(int_rate)"}
DIM = 64


def queries():
    def clean(spark, sf):
        return L.clean_loans(frame(spark, sf, "loans"), ["id"])

    def linked(spark, sf):
        """Attributes chosen by their number of values, coded, and clusters of equal codes."""
        rows = clean(spark, sf)
        attributes = graph.attributes_by_count(rows, 10, ["id", L.LABEL, L.DATE])
        rows = rows.selectExpr("id", *attributes, *[f"{e} AS {n}" for n, e in ROOTS.items()])
        coded, _ = encode.bag_encode(rows, attributes, ["id"])
        return graph.assign_clusters(coded, attributes).select("id", *ROOTS, "cluster_id", "degree")

    def chosen(df: DataFrame, names) -> DataFrame:
        listed = F.array(*[F.lit(n) for n in names])
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.explode(listed).alias("attribute"), "n")

    def attrs_card(spark, sf):
        rows = clean(spark, sf)
        return chosen(rows, graph.attributes_by_count(rows, 10, ["id", L.LABEL, L.DATE]))

    def attrs_zero(spark, sf):
        rows = frame(spark, sf, "application")
        return chosen(rows, graph.attributes_by_zero_share(rows, 0.3, 20, ["SK_ID_CURR", "TARGET"]))

    def propagated(spark, sf):
        out = graph.propagate(linked(spark, sf), VALUES)
        return rounded(out.select("id", "prop_root_amnt", "prop_root_rate"), ["prop_root_amnt", "prop_root_rate"], 6)

    def propagated_2(spark, sf):
        def between(c):
            return {"root_rate": F.greatest(2 * c["root_rate"] - 7.6, F.lit(0.0))}

        out = graph.propagate(linked(spark, sf), ["root_rate"], between=between)
        return rounded(out.select("id", "prop_root_rate"), ["prop_root_rate"], 6)

    def mixed(spark, sf):
        out = graph.propagate(linked(spark, sf), VALUES)
        cols = [graph.gate(F.col(v), F.col("prop_" + v), 0.3).alias("mix_" + v) for v in VALUES]
        return rounded(out.select("id", *cols), ["mix_" + v for v in VALUES], 6)

    def batched(spark, sf):
        rows = linked(spark, sf).withColumn("batch_id", F.floor(F.col("id") / 500))
        out = graph.propagate(rows, ["root_rate"], by=["batch_id", "cluster_id"])
        return rounded(out.select("id", "batch_id", "prop_root_rate"), ["prop_root_rate"], 6)

    def vector_means(spark, sf):
        out = graph.propagate_vector(frame(spark, sf, "vectors"), "x", DIM)
        gated = graph.gate_vector(F.col("x"), F.col("propagated"), 0.25)
        flat = out.select("row_id", F.posexplode(gated).alias("pos", "value"))
        return rounded(flat, ["value"], 6)

    def vecs(spark, sf):
        rows = frame(spark, sf, "vectors")
        return rows.withColumn("rebuilt", F.transform("x", lambda v: F.floor(v.cast("double") * 8) / 8))

    def scored(spark, sf):
        return frame(spark, sf, "scored")

    return {
        "graph_attrs_card": attrs_card,
        "graph_attrs_zero": attrs_zero,
        "cluster_assign": lambda s, d: linked(s, d).select("id", "cluster_id", "degree"),
        "graph_degree": lambda s, d: linked(s, d).select("id", "degree"),
        "graph_membership": lambda s, d: graph.membership(linked(s, d), "id"),
        "graph_edges": lambda s, d: graph.cluster_links(linked(s, d)),
        "graph_propagate": propagated,
        "graph_propagate_2": propagated_2,
        "graph_mix": mixed,
        "graph_propagate_batched": batched,
        "graph_propagate_vector": vector_means,
        "roc_curve": lambda s, d: rounded(metrics.roc_curve(scored(s, d)), ["tpr", "fpr"], 9),
        "auc": lambda s, d: rounded(metrics.auc(scored(s, d)), ["auc"], 9),
        "auc_per_batch": lambda s, d: rounded(metrics.auc_by(scored(s, d), ["batch_id"]), ["auc"], 9),
        "auc_by_batch": lambda s, d: rounded(metrics.mean_auc_by(scored(s, d), ["batch_id"]), ["mean_auc"], 9),
        "macro_prf": lambda s, d: rounded(metrics.macro_scores(scored(s, d)), ["precision", "recall", "f1"], 9),
        "error_counts": lambda s, d: metrics.error_counts(scored(s, d)),
        "log_loss": lambda s, d: rounded(metrics.log_loss(scored(s, d)), ["log_loss"], 6),
        "reconstruction_mse": lambda s, d: rounded(vectors.reconstruction_error(vecs(s, d), "x", "rebuilt"), ["mse"], 9),
        "class_cosine": lambda s, d: rounded(vectors.class_cosine(vecs(s, d), "x", "label", DIM), ["cosine"], 6),
        "multitask_score": lambda s, d: rounded(
            metrics.multitask_score(scored(s, d), vecs(s, d), DIM, weights=(0.5, 0.5, 0.1)),
            ["log_loss", "mse", "cosine", "score"],
            6,
        ),
    }


def oracle():
    clean_cols = [c for c in _CLEAN if c not in ("id", L.LABEL, L.DATE)]
    # A value's code follows its first id; a column that isn't chosen tells no rows apart.
    few = ", ".join(f"count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) < 10 AS has_{c}" for c in clean_cols)
    first = ", ".join(f"CASE WHEN has_{c} THEN min(id) OVER (PARTITION BY {c}) ELSE 0 END AS code_{c}" for c in clean_cols)
    order = ", ".join(f"code_{c}" for c in clean_cols)
    linked = (
        f"SELECT id, {', '.join(ROOTS)}, dense_rank() OVER (ORDER BY {order}) - 1 AS cluster_id, count(*) OVER (PARTITION BY {order}) "
        f"AS degree FROM (SELECT id, {', '.join(f'{e} AS {n}' for n, e in ROOTS.items())}, {first} FROM ({CLEAN}), (SELECT {few} FROM ({CLEAN})))"
    )
    # The matrix form, pair by pair: sum over linked rows of x / (sqrt(d_i) * sqrt(d_j)).
    pairs = (
        "SELECT a.id, "
        + ", ".join(f"sum(b.{v} / (sqrt(a.degree) * sqrt(b.degree))) AS prop_{v}" for v in VALUES)
        + " FROM linked a JOIN linked b ON a.cluster_id = b.cluster_id GROUP BY a.id"
    )
    head = f"WITH linked AS MATERIALIZED ({linked}), pairs AS ({pairs}) "
    scored = frame_sql("scored")
    vec = frame_sql("vectors")
    distinct = "count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)"
    apps = frame_sql("application")
    app_cols = [c for c in FRAMES["application"][1] if c not in ("SK_ID_CURR", "TARGET")]
    text = {"NAME_SEGMENT", "FLAG_CAR"}
    zero = " UNION ALL ".join(
        f"SELECT '{c}' AS attribute, {distinct.format(c=c)} AS k, "
        + ("min(0e0)" if c in text else f"avg(CASE WHEN {c} = 0 THEN 1e0 ELSE 0e0 END)")
        + f" AS z, count(*) AS n FROM ({apps})"
        for c in app_cols
    )
    step = "SELECT score, sum(sum(pos)) OVER w AS tp, sum(sum(neg)) OVER w AS fp FROM (SELECT p AS score, label AS pos, 1 - label AS neg " \
        f"FROM ({scored})) GROUP BY score WINDOW w AS (ORDER BY score DESC)"
    totals = f"SELECT CAST(sum(label) AS DOUBLE) AS pos, CAST(sum(1 - label) AS DOUBLE) AS neg FROM ({scored})"
    # Rank-sum form with mid-ranks.
    ranks = (
        "SELECT batch_id, label, rank() OVER (PARTITION BY {by} ORDER BY p) + (count(*) OVER (PARTITION BY {by}, p) - 1) / 2e0 AS r "
        f"FROM ({scored})"
    )
    area = (
        "CASE WHEN sum(label) > 0 AND sum(1 - label) > 0 THEN (sum(CASE WHEN label = 1 THEN r ELSE 0 END) - sum(label) * "
        "(sum(label) + 1) / 2e0) / (CAST(sum(label) AS DOUBLE) * sum(1 - label)) END"
    )
    per_batch = f"SELECT batch_id, {area} AS auc FROM ({ranks.format(by='batch_id')}) GROUP BY batch_id"
    conf = (
        "SELECT count(*) FILTER (WHERE label = 1 AND p > 0.5) AS tp, count(*) FILTER (WHERE label = 0 AND p > 0.5) AS fp, "
        "count(*) FILTER (WHERE label = 1 AND p <= 0.5) AS fn, count(*) FILTER (WHERE label = 0 AND p <= 0.5) AS tn "
        f"FROM ({scored})"
    )
    true = "CASE WHEN label = 1 THEN p ELSE 1 - p END"
    loss = f"SELECT avg(-ln(least(greatest({true}, 1e-15), 1e0 - 1e-15))) AS log_loss FROM ({scored})"
    flat = f"SELECT row_id, label, cluster_id, generate_subscripts(x, 1) AS pos, CAST(unnest(x) AS DOUBLE) AS v FROM ({vec})"
    mse = f"SELECT avg((v - floor(v * 8) / 8) * (v - floor(v * 8) / 8)) AS mse FROM ({flat})"
    cosine = (
        "SELECT abs(sum(p1 * p0) / (sqrt(sum(p1 * p1)) * sqrt(sum(p0 * p0)))) AS cosine FROM (SELECT pos, sum(v * label) / "
        f"(SELECT count(*) FROM embeddings) AS p1, sum(v * (1 - label)) / (SELECT count(*) FROM embeddings) AS p0 FROM ({flat}) GROUP BY pos)"
    )
    return {
        "graph_attrs_card": f"SELECT \"column\" AS attribute, (SELECT count(*) FROM ({CLEAN})) AS n FROM "
        f"({_per_column(distinct, 'k', clean_cols, CLEAN)}) WHERE k < 10",
        "graph_attrs_zero": f"SELECT attribute, n FROM ({zero}) WHERE k < 20 AND z < 0.3",
        "cluster_assign": f"SELECT id, cluster_id, degree FROM ({linked})",
        "graph_degree": f"SELECT id, degree FROM ({linked})",
        "graph_membership": f"SELECT id, cluster_id FROM ({linked})",
        "graph_edges": f"WITH linked AS MATERIALIZED ({linked}) SELECT a.cluster_id, count(DISTINCT a.id) AS degree, count(*) AS links "
        "FROM linked a JOIN linked b ON a.cluster_id = b.cluster_id GROUP BY a.cluster_id",
        "graph_propagate": head + "SELECT id, round(prop_root_amnt, 6) + 0e0 AS prop_root_amnt, round(prop_root_rate, 6) + 0e0 AS "
        "prop_root_rate FROM pairs",
        "graph_propagate_2": f"WITH linked AS MATERIALIZED ({linked}), h AS MATERIALIZED (SELECT id, cluster_id, degree, greatest(2 * avg(root_rate) OVER "
        "(PARTITION BY cluster_id) - 7.6e0, 0e0) AS h FROM linked) SELECT a.id, round(sum(b.h / (sqrt(a.degree) * sqrt(b.degree))), 6) + 0e0 "
        "AS prop_root_rate FROM h a JOIN h b ON a.cluster_id = b.cluster_id GROUP BY a.id",
        "graph_mix": head + "SELECT id, round(0.3e0 * root_amnt + 0.7e0 * prop_root_amnt, 6) + 0e0 AS mix_root_amnt, "
        "round(0.3e0 * root_rate + 0.7e0 * prop_root_rate, 6) + 0e0 AS mix_root_rate FROM pairs JOIN linked USING (id)",
        "graph_propagate_batched": f"SELECT id, id // 500 AS batch_id, round(avg(root_rate) OVER (PARTITION BY id // 500, cluster_id), 6) "
        f"+ 0e0 AS prop_root_rate FROM ({linked})",
        "graph_propagate_vector": "SELECT row_id, CAST(pos - 1 AS INTEGER) AS pos, round(0.25e0 * v + 0.75e0 * avg(v) OVER (PARTITION BY "
        f"cluster_id, pos), 6) + 0e0 AS value FROM ({flat})",
        "roc_curve": f"SELECT score AS threshold, round(tp / pos, 9) + 0e0 AS tpr, round(fp / neg, 9) + 0e0 AS fpr FROM ({step}), ({totals})",
        "auc": f"SELECT round({area}, 9) + 0e0 AS auc FROM ({ranks.format(by='1')})",
        "auc_per_batch": f"SELECT batch_id, round(auc, 9) + 0e0 AS auc FROM ({per_batch})",
        "auc_by_batch": f"SELECT round(avg(auc), 9) + 0e0 AS mean_auc FROM ({per_batch})",
        "macro_prf": "SELECT round((tp / (tp + fp) + tn / (tn + fn)) / 2, 9) + 0e0 AS precision, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 9) "
        f"+ 0e0 AS recall, round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fn + fp)) / 2, 9) + 0e0 AS f1 FROM ({conf})",
        "error_counts": f"SELECT fp AS truth_0_predicted_1, fn AS truth_1_predicted_0 FROM ({conf})",
        "log_loss": f"SELECT round(log_loss, 6) + 0e0 AS log_loss FROM ({loss})",
        "reconstruction_mse": f"SELECT round(mse, 9) + 0e0 AS mse FROM ({mse})",
        "class_cosine": f"SELECT round(cosine, 6) + 0e0 AS cosine FROM ({cosine})",
        "multitask_score": "SELECT round(log_loss, 6) + 0e0 AS log_loss, round(mse, 6) + 0e0 AS mse, round(cosine, 6) + 0e0 AS cosine, "
        f"round(0.5e0 * log_loss + 0.5e0 * mse / 500 + 0.1e0 * cosine, 6) + 0e0 AS score FROM ({loss}), ({mse}), ({cosine})",
    }
