"""Model presets as Spark ML pipelines.

Preprocessing (mean imputation and scaler fitted on train -> vector assembly)
and the estimator form one ``PipelineModel``; fitting runs distributed
tree/gradient aggregations, scoring is a projection (``transform``).

Model families of the original search and their Spark form:
  linear / ridge / lasso -> LinearRegression (ridge regParam scaled so the
                            objective matches the unnormalised ridge loss)
  rf                     -> RandomForestRegressor(featureSubsetStrategy="all"); as a member
                            of unlimited depth, ``ml.boosting`` trees on bootstrapped rows
  gb / xgb / lgb         -> ``ml.boosting``: level-wise first-order trees, level-wise trees
                            with a penalty, leaf-wise trees (scalers do not change trees)
  ensemble               -> weighted mean of member predictions
  knn                    -> exact k-nearest-neighbour join (operators.knn)
  nn / svm               -> ``ml.gradient``: gradients summed over all rows
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scaling
from . import boosting, onehot, onehot_boosting

SEED = 42
MAX_TREE_DEPTH = 30          # Spark's limit for tree depth

# Ensemble recipes (members and weights) of the original search.
ENSEMBLES = [
    {"models": ["lgb", "rf", "ridge"], "weights": [0.4, 0.3, 0.3]},
    {"models": ["lgb", "xgb", "gb"], "weights": [0.5, 0.3, 0.2]},
    {"models": ["rf", "gb", "ridge"], "weights": [0.4, 0.4, 0.2]},
    {"models": ["lgb", "rf", "gb", "ridge"], "weights": [0.4, 0.2, 0.2, 0.2]},
]


#: what each member of an ensemble is when nothing else is said: the documented defaults of
#: its family (depth 0: no limit)
MEMBER_PARAMS = {
    "lgb": {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 0},
    "xgb": {"n_estimators": 100, "learning_rate": 0.3, "max_depth": 6},
    "gb": {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3},
    "rf": {"n_estimators": 100, "max_depth": 0},
    "ridge": {"alpha": 1.0},
}

# Documented defaults of the boosting families (leaves, least rows and Hessian of
# a leaf, penalty).
FAMILIES = {
    "lgb": {"leaves": 31, "min_rows": 20, "min_hessian": 1e-3},
    "xgb": {"lam": 1.0, "min_hessian": 1.0},
    "gb": {},
    "rf": {"objective": "forest"},
}


def tree_params(kind: str, params: dict | None = None, seed: int = SEED, **more) -> boosting.Params:
    """The boosting parameters of a family and its configuration."""
    p = dict(params or {})
    return boosting.Params(rounds=int(p.get("n_estimators", 100)), rate=float(p.get("learning_rate", 0.1)), depth=int(p.get("max_depth", 3)),
                           seed=seed, **{**FAMILIES[kind], **more})


def _depth(p: dict, default: int) -> int:
    depth = int(p.get("max_depth", default))
    if depth > MAX_TREE_DEPTH:
        raise ValueError(f"trees are at most {MAX_TREE_DEPTH} deep, not {depth}")
    return depth


def preprocess(train: DataFrame, cols, scaler: str = "standard", prefix: str = "_f") -> list:
    """Fitted stages: train means for missing values, then the contract's scaler
    (``operators.scaling``: population std, interpolated quartiles, a constant column to
    0), as one projection; then the feature vector.  A column that is NULL in all of
    ``train`` counts as 0."""
    cols = list(cols)
    means = scaling.fit_means(train, cols)
    means = {c: 0.0 if m is None else float(m) for c, m in means.items()}
    params = scaling.fit_scaler(scaling.apply_fill(train, means), cols, scaler)
    exprs = ", ".join(
        f"(coalesce(`{c}`, {means[c]!r}D) - {float(params[c][0] or 0.0)!r}D) / {float(params[c][1])!r}D AS `{prefix}_{c}`" for c in cols)
    return [SQLTransformer(statement=f"SELECT *, {exprs} FROM __THIS__"),
            VectorAssembler(inputCols=[f"{prefix}_{c}" for c in cols], outputCol="features", handleInvalid="keep")]


def regressor(kind: str, params: dict | None = None, label: str = "label", pred: str = "prediction",
              seed: int = SEED, y_std: float | None = None, n_rows: int | None = None):
    p = dict(params or {})
    common = dict(featuresCol="features", labelCol=label, predictionCol=pred)
    if kind == "linear":
        return LinearRegression(regParam=0.0, **common)
    if kind == "ridge":
        alpha = float(p.get("alpha", 1.0))
        # sklearn ridge: ||y - Xw||^2 + alpha ||w||^2; Spark: (1/2n)||.||^2 + reg/2 ||w||^2
        # on a standardised label -> reg = alpha * std(y) / n
        reg = alpha * (y_std or 1.0) / max(n_rows or 1, 1)
        return LinearRegression(regParam=reg, elasticNetParam=0.0, standardization=False, **common)
    if kind == "lasso":
        return LinearRegression(regParam=float(p.get("alpha", 1.0)), elasticNetParam=1.0,
                                standardization=False, **common)
    if kind == "rf":
        return RandomForestRegressor(numTrees=int(p.get("n_estimators", 100)),
                                     maxDepth=_depth(p, 10) or MAX_TREE_DEPTH,
                                     featureSubsetStrategy="all", seed=seed, **common)
    raise ValueError(f"no Spark estimator for model type {kind!r}")


def _fitted(train: DataFrame, cols, scaler: str, est, prefix: str = "_f") -> PipelineModel:
    stages = preprocess(train, cols, scaler, prefix)
    prepared = PipelineModel(stages=stages).transform(train)
    return PipelineModel(stages=[*stages, est.fit(prepared)])


def fit_trees(train: DataFrame, cols, kind: str, params: dict | None = None, label: str = "win_pct", seed: int = SEED) -> boosting.Booster | boosting.Forest:
    """Fit a tree family on ``train`` with missing values at the training means."""
    means = scaling.fit_means(train, list(cols))
    return boosting.fit_frame(train, list(cols), label, tree_params(kind, params, seed), fill={c: 0.0 if m is None else float(m) for c, m in means.items()})


def fit_regression(train: DataFrame, cols, kind: str = "linear", params: dict | None = None,
                   scaler: str = "standard", label: str = "win_pct") -> PipelineModel | boosting.Booster:
    """Fit imputation + scaling + model on ``train`` only."""
    if kind in ("gb", "xgb", "lgb"):
        return fit_trees(train, cols, kind, params, label)
    y_std = n = None
    if kind == "ridge":
        r = train.agg(F.stddev_pop(label).alias("s"), F.count(label).alias("n")).first()
        y_std, n = r["s"], r["n"]
    est = regressor(kind, params, label=label, y_std=y_std, n_rows=n)
    return _fitted(train, cols, scaler, est)


def predict(model: PipelineModel, df: DataFrame, out: str = "pred_score") -> DataFrame:
    """Batch scoring: keys and inputs kept beside the prediction."""
    scored = model.transform(df)
    keep = [c for c in df.columns] + [F.col("prediction").alias(out)]
    return scored.select(*keep)


def fit_ensemble(train: DataFrame, cols, recipe: dict, scaler: str = "standard", label: str = "win_pct",
                 member_params: dict | None = None):
    """Fit every member (``MEMBER_PARAMS``, seeds 42, 43, ...) -> list of (weight, model)."""
    out = []
    for i, (m, w) in enumerate(zip(recipe["models"], recipe["weights"])):
        params = {**MEMBER_PARAMS[m], **(member_params or {}).get(m, {})}
        if m in FAMILIES:
            out.append((w, fit_trees(train, cols, m, params, label, SEED + i)))
            continue
        y_std = n = None
        if m == "ridge":
            r = train.agg(F.stddev_pop(label).alias("s"), F.count(label).alias("n")).first()
            y_std, n = r["s"], r["n"]
        est = regressor(m, params, label=label, pred=f"_p{i}", seed=SEED + i, y_std=y_std, n_rows=n)
        out.append((w, _fitted(train, cols, scaler, est, f"_e{i}")))
    return out


def predict_ensemble(members, df: DataFrame, out: str = "pred_score") -> DataFrame:
    """Weighted mean of member predictions (weights normalised to sum 1)."""
    total = sum(w for w, _ in members)
    cur = df
    for i, (w, m) in enumerate(members):
        cur = m.transform(cur, f"_p{i}") if isinstance(m, (boosting.Booster, boosting.Forest)) else m.transform(cur).drop("features")
        cur = cur.drop(*[c for c in cur.columns if c.startswith(f"_e{i}_")])
    score = sum(F.col(f"_p{i}") * (w / total) for i, (w, _) in enumerate(members))
    return cur.withColumn(out, score).select(*df.columns, out)


# --- classifiers ---------------------------------------------------------------------


def onehot_stages(cat_cols, prefix: str = "_oh"):
    """Categoricals -> one-hot; unseen categories at scoring become all-zero
    vectors (index 'keep' = the dropped last slot)."""
    idx = [StringIndexer(inputCol=c, outputCol=f"{prefix}_{c}_i", handleInvalid="keep",
                         stringOrderType="alphabetAsc") for c in cat_cols]
    # the indexer puts unseen values at the last index; dropLast drops exactly
    # that slot, so unseen -> all zeros and every known level keeps its slot
    enc = OneHotEncoder(inputCols=[f"{prefix}_{c}_i" for c in cat_cols],
                        outputCols=[f"{prefix}_{c}_v" for c in cat_cols], dropLast=True)
    return idx + [enc], [f"{prefix}_{c}_v" for c in cat_cols]


def classifier_pipeline(train: DataFrame, num_cols, cat_cols=(), kind: str = "gbt", params: dict | None = None,
                        label: str = "label", weight_col: str | None = None, slot_cols=()) -> Pipeline:
    """Numbers scaled by the contract's population standard deviation, categories one-hot.
    ``cat_cols`` have few values; ``slot_cols`` hold indices of ``ml.onehot``, whose
    dictionary is a table, for categories of any size.  Boosted trees on all rows and columns
    are those of ``ml.onehot_boosting``, which reads the indices themselves."""
    p = dict(params or {})
    stages = preprocess(train, num_cols, "standard", "_s")
    rounds, rate, depth = int(p.get("n_estimators", 100)), float(p.get("learning_rate", 0.1)), int(p.get("max_depth", 3))
    if kind == "gbt" and weight_col is None and "subsample" not in p and "colsample" not in p:
        oh = onehot_stages(cat_cols)[0][:-1] if cat_cols else []
        est = onehot_boosting.OneHotBoostedClassifier([f"_s_{c}" for c in num_cols], [*[s.getOutputCol() for s in oh], *slot_cols], label,
                                                      onehot_boosting.Rules(rounds, rate, depth))
        return Pipeline(stages=[*stages, *oh, est])
    stages[-1].setOutputCol("_num")
    vec_cols = ["_num"]
    if cat_cols:
        oh, oh_cols = onehot_stages(cat_cols)
        stages += oh
        vec_cols += oh_cols
    for c in slot_cols:
        stages.append(onehot.vector_stage(c, f"_slots_{c}"))
        vec_cols.append(f"_slots_{c}")
    stages.append(VectorAssembler(inputCols=vec_cols, outputCol="features"))
    if kind == "gbt":
        est = GBTClassifier(labelCol=label, subsamplingRate=float(p.get("subsample", 1.0)), featureSubsetStrategy=str(p.get("colsample", "all")),
                            maxIter=rounds, stepSize=rate, maxDepth=depth, seed=SEED, featuresCol="features")
        if weight_col:
            est = est.setWeightCol(weight_col)
    elif kind == "rf":
        est = RandomForestClassifier(labelCol=label, numTrees=int(p.get("n_estimators", 100)),
                                     maxDepth=int(p.get("max_depth", 5)), seed=SEED, featuresCol="features")
    else:
        raise ValueError(kind)
    stages.append(est)
    return Pipeline(stages=stages)


def positive_probability(col: str = "probability") -> F.Column:
    return vector_to_array(F.col(col))[1]
