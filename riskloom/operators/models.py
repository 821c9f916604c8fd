"""Classifiers as distributed fits, with one interface for all of them.

Settings follow the original workloads where a learner has the same knob. Boosting is that of ``boosting``, perceptrons are fitted by ``perceptron``
where rows fill several tasks, forests by ``forest`` where rows fit a task, all others are Spark's learners; no number is meant to equal another library's.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.ml import Model, PipelineModel, Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import boosting, forest, graph, metrics, perceptron
from riskloom.operators.balance import with_class_weights
from riskloom.operators.boosting import Boosted
from riskloom.operators.forest import Forest
from riskloom.session import dealt_out, discard, materialise, path_exists, task_count

# ---- Fixed values: learner settings ----

INVERSE_PENALTY = 0.0001
TREE_DEPTH = 5
FOREST_TREES = {"loans": 100, "applicants": 1000}
FOREST_SEED = 50
FOREST_DEPTH = 30  # the originals grow without bound; 30 is the most the learner allows
BOOST_ROUNDS = {"loans": 1200, "applicants": 10000}
BOOST_MIN_GAIN = 0.098
BOOST_PATIENCE = {"gbt": 10, "gbt_slow": 100}  # rounds without a better validation area
BOOST_SUBSAMPLE = 0.5
BOOST_STEP = 0.3
BOOST_DEPTH = 6
BOOST_PENALTY = 1.0
SLOW_BOOST_ROUNDS = 10000
SLOW_BOOST_STEP = 0.02
SLOW_BOOST_LEAVES = 32
SLOW_BOOST_DEPTH = 8
SLOW_BOOST_MIN_HESSIAN = 40.0
SLOW_BOOST_MIN_ROWS = 20
HIDDEN_LAYERS = {"loans": [32, 32, 32, 16], "applicants": [512, 256, 128, 64, 32]}
DEEP_LAYERS = {"loans": [64, 64, 32, 16], "applicants": [256, 128, 64]}
BATCH_ROWS = 500

# ---- End of fixed values ----

FEATURES = "features"
BOUND = 1e30


def bounded(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values to 0 and infinities to a large finite number, as learners need complete input."""
    kept = [F.col(c) for c in df.columns if c not in set(columns)]
    fixed = [
        F.greatest(F.least(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(BOUND)), F.lit(-BOUND)).alias(c)
        for c in columns
    ]
    return df.select(*kept, *fixed)


def _assembler(columns: Sequence[str], out: str = FEATURES) -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="error")


# -- one learner per name ---------------------------------------------------------


def _given(options, **names) -> dict:
    """Learner arguments for the options that were given."""
    return {arg: options[o] for arg, o in names.items() if options.get(o) is not None}


def _logistic(train, label, width, options):
    c = options.get("inverse_penalty", INVERSE_PENALTY)
    # Summed loss weighted by C against mean loss with a penalty weight.
    return LogisticRegression(
        labelCol=label,
        featuresCol=FEATURES,
        regParam=1.0 / (c * max(1, train.count())),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=options.get("max_iter", 100),
        **_given(options, weightCol="weight"),
    )


def _tree(train, label, width, options):
    return DecisionTreeClassifier(labelCol=label, featuresCol=FEATURES, maxDepth=options.get("depth", TREE_DEPTH), impurity="gini")


def _forest(train, label, width, options):
    return RandomForestClassifier(
        labelCol=label,
        featuresCol=FEATURES,
        numTrees=options.get("trees", FOREST_TREES["loans"]),
        maxDepth=options.get("depth", FOREST_DEPTH),
        featureSubsetStrategy="sqrt",
        cacheNodeIds=True,  # rows remember their nodes, so a level doesn't walk deep trees from their roots
        seed=options.get("seed", FOREST_SEED),
    )


def _perceptron(train, label, width, options):
    return MultilayerPerceptronClassifier(
        labelCol=label,
        featuresCol=FEATURES,
        layers=[width, *options.get("hidden", HIDDEN_LAYERS["loans"]), 2],
        maxIter=options.get("max_iter", 100),
        seed=options.get("seed", FOREST_SEED),
    )


LEARNERS: dict[str, Callable] = {
    "lr": _logistic,
    "dt": _tree,
    "rf": _forest,
    "mlp": _perceptron,
}
BOOSTERS = {
    "gbt": boosting.Settings(
        rounds=BOOST_ROUNDS["loans"],
        step=BOOST_STEP,
        depth=BOOST_DEPTH,
        min_gain=BOOST_MIN_GAIN,
        penalty=BOOST_PENALTY,
        subsample=BOOST_SUBSAMPLE,
        patience=BOOST_PATIENCE["gbt"],
        seed=FOREST_SEED,
    ),
    "gbt_slow": boosting.Settings(
        rounds=SLOW_BOOST_ROUNDS,
        step=SLOW_BOOST_STEP,
        depth=SLOW_BOOST_DEPTH,
        leaves=SLOW_BOOST_LEAVES,
        min_hessian=SLOW_BOOST_MIN_HESSIAN,
        min_rows=SLOW_BOOST_MIN_ROWS,
        patience=BOOST_PATIENCE["gbt_slow"],
        from_average=True,
        seed=FOREST_SEED,
    ),
}
BALANCED = {"gbt"}  # positives weighted by negatives / positives


def fit(
    name: str,
    train: DataFrame,
    columns: Sequence[str],
    label: str,
    valid: DataFrame | None = None,
    **options,
) -> PipelineModel | Boosted | Forest:
    """Fit the learner of that name (any case). ``valid`` stops boosting early where given.

    The columns must be complete: see ``bounded``; vector columns are allowed. Class weights come from the training rows alone.
    Options of boosting are the fields of its settings.
    """
    key = name.lower()
    if key not in LEARNERS and key not in BOOSTERS:
        raise ValueError(f"unknown model {name}; one of " + ", ".join([*LEARNERS, *BOOSTERS]))
    if key in BALANCED:
        train = with_class_weights(train, label, "__weight")
        options["weight"] = "__weight"
    if key in BOOSTERS:
        weight = options.pop("weight", None)
        return boosting.fit(train, columns, label, replace(BOOSTERS[key], **options), weight, valid)
    assembler = _assembler(columns)
    weight = [options["weight"]] if options.get("weight") else []
    rows = train.count()
    learner = LEARNERS[key](train, label, len(columns), options)
    if key == "mlp" and task_count(train.sparkSession, rows) > 1:  # rows of a single task are left to Spark's learner
        return PipelineModel(stages=[assembler, _without_summary(perceptron.fit(learner, train, columns, rows))])
    if key == "rf":
        given = forest.binned(train, columns, label, rows)
        made = forest.fit(given, columns, learner.getNumTrees(), learner.getMaxDepth(), learner.getSeed()) if given.fits() else None
        discard(given.rows)
        if made is not None:  # rows beyond that are left to Spark's learner
            return made
    data = dealt_out(assembler.transform(train).select(FEATURES, label, *weight), rows)
    return PipelineModel(stages=[assembler, _without_summary(learner.fit(data))])


def _without_summary(model: Model) -> Model:
    """A model that doesn't hold on to its training rows.

    The summary of a two-class fit refers to the session, which can't be sent to tasks any more once something was observed in it.
    """
    if getattr(model, "hasSummary", False):
        model._java_obj.setSummary(SparkSession.getActiveSession()._jvm.scala.Option.empty())
    return model


def score(model: Transformer | Boosted | Forest, df: DataFrame, name: str = "p") -> DataFrame:
    """Add the probability of the positive class."""
    if isinstance(model, Boosted | Forest):
        return model.score(df, name)
    out = model.transform(df)
    probability = F.get(vector_to_array(F.col("probability")), F.lit(1))
    return out.select(*df.columns, probability.alias(name))


def save(model: PipelineModel | Boosted | Forest, path: str) -> None:
    if isinstance(model, Boosted | Forest):
        model.save(SparkSession.getActiveSession(), path)
    else:
        model.write().overwrite().save(path)


def load(path: str) -> PipelineModel | Boosted | Forest:
    spark = SparkSession.getActiveSession()
    for kind, table in ((Boosted, "nodes"), (Forest, "trees")):
        if path_exists(spark, f"{path}/{table}"):
            return kind.load(spark, path)
    return PipelineModel.load(path)


def best_of(
    name: str,
    candidates: Sequence[Mapping[str, object]],
    train: DataFrame,
    valid: DataFrame,
    columns: Sequence[str],
    label: str,
    patience: int | None = None,
) -> tuple[PipelineModel, dict, float]:
    """Fit one model per setting, keep the best exact validation AUC.

    With ``patience`` the search ends after that many settings in a row without a gain.
    """
    best, since = None, 0
    for options in candidates:
        model = fit(name, train, columns, label, **options)
        found = metrics.auc(score(model, valid), label).first()["auc"]
        if best is None or (found is not None and found > best[2]):
            best, since = (model, dict(options), found if found is not None else 0.0), 0
        else:
            since += 1
            if patience is not None and since > patience:
                break
    if best is None:
        raise ValueError("no candidate settings")
    return best


# -- wide and deep ------------------------------------------------------------------


@dataclass(frozen=True)
class WideDeep:
    """Linear on indicators, perceptron on codes and values, joined by a linear unit."""

    wide: PipelineModel
    deep: PipelineModel
    head: PipelineModel

    def score(self, df: DataFrame, name: str = "p") -> DataFrame:
        out = score(self.deep, score(self.wide, df, "__wide"), "__deep")
        return score(self.head, out, name).drop("__wide", "__deep")


def fit_wide_deep(
    train: DataFrame,
    wide: Sequence[str],
    deep: Sequence[str],
    label: str,
    key: Sequence[str],
    hidden: Sequence[int] = tuple(DEEP_LAYERS["loans"]),
    folds: int = 2,
    max_iter: int = 100,
) -> WideDeep:
    """The head learns from scores of rows its base models have not seen (out of fold)."""
    train = train.withColumn("__fold", F.pmod(F.xxhash64(*[F.col(k) for k in key]), F.lit(folds)))

    def base(rows: DataFrame) -> tuple[PipelineModel, PipelineModel]:
        return (
            fit("lr", rows, wide, label, max_iter=max_iter),
            fit("mlp", rows, deep, label, hidden=list(hidden), max_iter=max_iter),
        )

    parts = []
    for f in range(folds):
        w, d = base(train.filter(F.col("__fold") != f))
        held = train.filter(F.col("__fold") == f)
        parts.append(score(d, score(w, held, "__wide"), "__deep").select("__wide", "__deep", label))
    scored = parts[0]
    for part in parts[1:]:
        scored = scored.unionByName(part)
    head = fit("lr", materialise(scored, "scores"), ["__wide", "__deep"], label, inverse_penalty=1.0)
    w, d = base(train)
    return WideDeep(w, d, head)


# -- graph-smoothed classifier -------------------------------------------------------


@dataclass(frozen=True)
class GraphInputs:
    """Rows with their own and their graph-mixed columns, and the share of a row's own value in the mix."""

    rows: DataFrame
    columns: list[str] = field(default_factory=list)
    share: float = 0.5


def _propagated(df: DataFrame, columns: Sequence[str], attributes: Sequence[str], batch: str | None) -> DataFrame:
    """Rows with each column's mean over their cluster, ``prop_`` before its name. Attributes are read as they are; they may be among the columns."""
    keys = [f"__a{i}" for i in range(len(attributes))]
    rows = df.withColumns({k: F.col(a) for k, a in zip(keys, attributes, strict=True)})
    rows = graph.assign_clusters(rows, keys)
    by = ["cluster_id"] if batch is None else [batch, "cluster_id"]
    return graph.propagate(rows, columns, by=by).drop(*keys)


def _gated(rows: DataFrame, columns: Sequence[str], share: float) -> GraphInputs:
    rows = rows.withColumns({f"mix_{c}": graph.gate(F.col(c).cast("double"), F.col(f"prop_{c}"), share) for c in columns})
    return GraphInputs(rows.drop(*[f"prop_{c}" for c in columns]), [*columns, *[f"mix_{c}" for c in columns]], share)


def graph_inputs(
    df: DataFrame,
    columns: Sequence[str],
    attributes: Sequence[str],
    share: float = 0.5,
    batch: str | None = None,
) -> GraphInputs:
    """Each column next to its mix with the mean over the row's cluster.

    Propagation over the graph of shared attributes is a group mean, taken once outside the learner.
    """
    return _gated(_propagated(df, columns, attributes, batch), columns, share)


def learned_graph_inputs(
    df: DataFrame,
    columns: Sequence[str],
    attributes: Sequence[str],
    label: str,
    fit_on: Column,
    judge_on: Column,
    batch: str | None = None,
    shares: Sequence[float] = graph.SHARES,
    rounds: int = 2,
    **options,
) -> GraphInputs:
    """``graph_inputs`` with the share of largest area on the rows ``judge_on``, by a logistic scorer fitted on the rows ``fit_on``.

    The scorer is linear, so its margin of mixed columns is the mix of its margins of a row's own and its propagated columns. Both margins are taken
    once, and every share follows from them without fitting or propagating again. Keep test rows out of both conditions.
    """
    rows = materialise(_propagated(df, columns, attributes, batch), "propagated")
    model = fit("lr", rows.filter(fit_on), columns, label, **options).stages[-1]
    weights = [float(w) for w in model.coefficients]

    def margin(prefix: str) -> Column:
        values = F.array(*[F.col(prefix + c).cast("double") for c in columns])
        return F.aggregate(F.zip_with(values, F.array(*[F.lit(w) for w in weights]), lambda x, w: x * w), F.lit(float(model.intercept)), lambda s, v: s + v)

    margins = rows.filter(judge_on).select(F.col(label).alias("label"), margin("").alias("own"), margin("prop_").alias("near"))
    share, _ = graph.learned_share(materialise(margins, "margins"), "label", "own", "near", shares, rounds)
    return _gated(rows, columns, share)


# -- reconstruction -------------------------------------------------------------------


def rebuild(df: DataFrame, column: str, size: int, k: int, name: str = "rebuilt") -> DataFrame:
    """Reconstruct vectors from their first ``k`` principal components.

    The centre comes from one aggregate and the components from Spark's PCA; both
    are as small as the vector is long.
    """
    x = F.col(column)
    centre = df.agg(*[F.avg(F.get(x, F.lit(i)).cast("double")).alias(f"c{i}") for i in range(size)]).first()
    middle = F.array(*[F.lit(float(v)) for v in centre])
    centred = df.withColumn("__v", array_to_vector(F.zip_with(x, middle, lambda a, b: a.cast("double") - b)))
    model: Model = PCA(k=k, inputCol="__v", outputCol="__z").fit(centred)
    parts = model.pc.toArray()  # size x k
    z = vector_to_array(F.col("__z"))
    built = F.array(
        *[
            F.aggregate(
                F.zip_with(z, F.array(*[F.lit(float(w)) for w in parts[i]]), lambda a, b: a * b),
                F.lit(float(centre[i])),
                lambda acc, v: acc + v,
            )
            for i in range(size)
        ]
    )
    return model.transform(centred).withColumn(name, built).drop("__v", "__z")
