"""Scaling, encoding, folds, metrics, tuning, models and the two-level score."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from checks.cleaning_queries import CLEANED_SQL
from checks.data import LAYOUT, series, subjects, table
from checks.registry import over_both, query, tidy, tidy_sql
from kinecohort.functions.columns import col, threshold_label
from kinecohort.operators import tuning
from kinecohort.operators.boosting import BoostedRegressor, settings_of
from kinecohort.operators import autoencoder as A
from kinecohort.operators import ensemble as E
from kinecohort.operators import scaling
from kinecohort.operators import scoring as M
from kinecohort.operators.linear import linear_out_of_fold
from kinecohort.operators.series import series_basic_stats
from kinecohort.plans import presets as P
from kinecohort.plans.models import load_models, save_models
from kinecohort.plans.prepare import clean_train, merge_series_features, prepare_test, prepare_train
from kinecohort.plans.parzen import maximise
from kinecohort.plans.search import param_search
from kinecohort.plans.training import batch_score, train, train_level1, train_level2
from kinecohort.sources.artifacts import load_artifacts, save_artifacts
from kinecohort.sources.shared import fresh_path, materialize
from kinecohort.sources.tables import write_predictions

# --- embeddings: scaling and encoding ---------------------------------------------------

DIMS = 64
_X = [f"x{i}" for i in range(DIMS)]
_EMBEDDINGS_SQL = "SELECT vec_id AS id, {} FROM embeddings".format(
    ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS x{i}" for i in range(DIMS))
)
CODE, SEED = 8, 7


def _embeddings(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"), *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(DIMS)]
    )


@query(
    "standardize",
    tidy_sql(
        "SELECT id, {} FROM ({})".format(
            ", ".join(f"({c} - avg({c}) OVER ()) / (stddev_samp({c}) OVER () + 1e-10::DOUBLE) AS {c}" for c in _X),
            _EMBEDDINGS_SQL,
        ),
        _X,
    ),
)
def standardize(spark, sf_dir):
    return tidy(scaling.standardize(_embeddings(spark, sf_dir), _X)[0])


@query("fit_autoencoder")
def fit_autoencoder(spark, sf_dir):
    """Loss before each epoch."""
    scaled, _ = scaling.standardize(_embeddings(spark, sf_dir), _X)
    model = A.fit_autoencoder(scaled, _X, CODE, epochs=20, seed=SEED)
    return spark.createDataFrame(list(enumerate(model.losses)), "epoch int, loss double")


_START = A.initial_autoencoder(DIMS, CODE, SEED)
_CODES = [f"column_{i}" for i in range(CODE)]


def _dense_sql(inputs: str, layer: int) -> str:
    w, b = _START.weights[layer], _START.biases[layer]
    outputs = [
        f"greatest(0, list_dot_product({inputs}, [{', '.join(repr(float(v)) for v in w[:, j])}]::DOUBLE[]) + {float(b[j])!r}::DOUBLE)"
        for j in range(w.shape[1])
    ]
    return f"[{', '.join(outputs)}]"


@query(
    "encode",
    tidy_sql(
        f"""SELECT id, {", ".join(f"code[{i + 1}] AS column_{i}" for i in range(CODE))} FROM (
        SELECT id, {_dense_sql("hidden", 1)} AS code FROM (
        SELECT vec_id AS id, {_dense_sql("embedding::DOUBLE[]", 0)} AS hidden FROM embeddings))""",
        _CODES,
    ),
)
def encode(spark, sf_dir):
    return tidy(A.encode(_embeddings(spark, sf_dir), _X, _START))


@query("autoencode_features")
def autoencode_features(spark, sf_dir):
    out, _, _ = A.autoencode_features(_embeddings(spark, sf_dir), encoding_dim=CODE, epochs=10, seed=SEED)
    return out


# --- a label and three scores per order --------------------------------------------------

_SCORED = {
    "id": "o_orderkey",
    "y": "CAST(least(3, floor((o_totalprice + (o_orderkey * 7919) % 200000) / 150000)) AS INT)",
    "p1": "o_totalprice / 130000",
    "p2": "CAST((o_orderkey * 7919) % 200000 AS DOUBLE) / 66666",
    "p3": "CAST(o_custkey % 4 AS DOUBLE)",
    "status": "o_orderstatus",
}
SCORED_SQL = f"SELECT {', '.join(f'{e} AS {n}' for n, e in _SCORED.items())} FROM orders"
_LABEL = "CAST(CASE WHEN {0} < 0.5 THEN 0 WHEN {0} < 1.5 THEN 1 WHEN {0} < 2.5 THEN 2 ELSE 3 END AS INT)"


def scored(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(*[F.expr(e).alias(n) for n, e in _SCORED.items()])


FOLDED_SQL = f"""WITH r AS ({SCORED_SQL}),
c AS (SELECT y, n, sum(n) OVER (ORDER BY seen) - n AS s FROM
  (SELECT y, count(*) AS n, min(id) AS seen FROM r GROUP BY y)),
a AS (SELECT y, f, sum(floor((s + n - 1 - f) / 5.0) - floor((s - 1 - f) / 5.0)) OVER (PARTITION BY y ORDER BY f) AS filled
  FROM c, range(5) g(f)),
k AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY id) - 1 AS place FROM r)
SELECT k.id, k.y, k.p1, k.p2, k.p3, CAST(count(*) FILTER (a.f < 4 AND k.place >= a.filled) AS INT) AS fold
FROM k JOIN a ON k.y = a.y GROUP BY ALL"""


def folded(spark, sf_dir):
    return M.stratified_folds(scored(spark, sf_dir).drop("status"), "y", ["id"])


@query("stratified_folds", f"SELECT id, y, fold FROM ({FOLDED_SQL})")
def stratified_folds(spark, sf_dir):
    return folded(spark, sf_dir).select("id", "y", "fold")


@query("threshold_label", f"SELECT id, {_LABEL.format('p1')} AS label FROM ({SCORED_SQL})")
def threshold_label_query(spark, sf_dir):
    return scored(spark, sf_dir).select("id", threshold_label(F.col("p1"), P.SCORE_CUTS).alias("label"))


def kappa_sql(rows: str, by: str = "", name: str = "kappa") -> str:
    """Quadratic weighted kappa of columns y and p, weights by place among the labels."""
    key, on = (f"{by}, ", f"AND l.{by} = r.{by}") if by else ("", "")
    part = f"PARTITION BY {by} " if by else ""
    return f"""WITH rel AS ({rows}),
    l AS (SELECT {key}v, row_number() OVER ({part}ORDER BY v) - 1 AS pos FROM
      (SELECT {key}y AS v FROM rel UNION SELECT {key}p AS v FROM rel))
    SELECT {key}1 - sum((a - b) * (a - b)) / (sum(a * a + b * b) - 2.0::DOUBLE * sum(a) * sum(b) / count(*)) AS {name}
    FROM (SELECT {"r." + by + ", " if by else ""}CAST(l.pos AS DOUBLE) AS a, CAST(m.pos AS DOUBLE) AS b
      FROM rel r JOIN l ON l.v = r.y {on} JOIN l m ON m.v = r.p {on.replace("l.", "m.")})
    {"GROUP BY " + by if by else ""}"""


@query("quadratic_kappa", tidy_sql(kappa_sql("SELECT quality AS y, toxic AS p FROM labels"), ["kappa"], 9))
def quadratic_kappa(spark, sf_dir):
    return tidy(M.quadratic_kappa(table(spark, sf_dir, "labels"), "quality", "toxic"), 9)


_GROUPED = f"SELECT status, y, {_LABEL.format('p1')} AS p FROM ({SCORED_SQL})"


@query("quadratic_kappa_by_group", tidy_sql(kappa_sql(_GROUPED, "status"), ["kappa"], 9))
def quadratic_kappa_by_group(spark, sf_dir):
    labelled = M.labelled(scored(spark, sf_dir), "p1", P.SCORE_CUTS, "p")
    return tidy(M.quadratic_kappa(labelled, "y", "p", ["status"]), 9)


@query(
    "accuracy",
    tidy_sql(f"SELECT status, avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) AS accuracy FROM ({_GROUPED}) GROUP BY 1", ["accuracy"], 9),
)
def accuracy(spark, sf_dir):
    return tidy(M.accuracy(M.labelled(scored(spark, sf_dir), "p1", P.SCORE_CUTS, "p"), "y", "p", ["status"]), 9)


@query("confusion_matrix", f"SELECT y AS y_true, p AS y_pred, count(*) AS n FROM ({_GROUPED}) GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):
    return M.confusion_matrix(M.labelled(scored(spark, sf_dir), "p1", P.SCORE_CUTS, "p"), "y", "p")


_SUMMARY = ["cv_mean_kappa", "cv_std_kappa", "oof_kappa"]
_OOF_SQL = f"SELECT fold, y, {_LABEL.format('p1')} AS p FROM ({FOLDED_SQL})"


@query(
    "cv_summary",
    tidy_sql(
        f"""SELECT avg(kappa) AS cv_mean_kappa, stddev_pop(kappa) AS cv_std_kappa,
        (SELECT kappa FROM ({kappa_sql(_OOF_SQL)})) AS oof_kappa FROM ({kappa_sql(_OOF_SQL, "fold")})""",
        _SUMMARY,
        9,
    ),
)
def cv_summary(spark, sf_dir):
    return tidy(M.cv_summary(M.labelled(folded(spark, sf_dir), "p1", P.SCORE_CUTS)), 9)


# --- tuning ------------------------------------------------------------------------------------

CUTS = M.cut_grid(0.25, 3.25, 0.25)


def _search_sql(binned: str, partition: str = "") -> str:
    """Best ascending cut points over (y, b, n): all four labels occur among y."""
    cut = ", ".join(f"{c!r}::DOUBLE" for c in CUTS)
    m, key = len(CUTS), f"{partition}, " if partition else ""
    group = f"{key}i0, i1, i2"
    return f"""SELECT {key}kappa, ([{cut}])[i0 + 1] AS t0, ([{cut}])[i1 + 1] AS t1, ([{cut}])[i2 + 1] AS t2 FROM (
    SELECT *, row_number() OVER ({f"PARTITION BY {partition} " if partition else ""}
      ORDER BY kappa DESC NULLS LAST, i0, i1, i2) AS best FROM (
    SELECT {group}, 1 - sum(n * (y - p) * (y - p))::DOUBLE / (sum(n * (y * y + p * p))::DOUBLE
      - 2 * sum(n * y)::DOUBLE * sum(n * p)::DOUBLE / sum(n)::DOUBLE) AS kappa FROM (
    SELECT *, CASE WHEN b <= i0 THEN 0 WHEN b <= i1 THEN 1 WHEN b <= i2 THEN 2 ELSE 3 END AS p FROM ({binned})
      JOIN (SELECT a.i AS i0, b.i AS i1, c.i AS i2 FROM range({m}) a(i), range({m}) b(i), range({m}) c(i)
        WHERE a.i <= b.i AND b.i <= c.i) ON TRUE)
    GROUP BY {group})) WHERE best = 1"""


def _bin_sql(x: str) -> str:
    return "(" + " + ".join(f"CASE WHEN {x} >= {c!r} THEN 1 ELSE 0 END" for c in CUTS) + ")"


@query(
    "tune_thresholds",
    tidy_sql(_search_sql(f"SELECT y, {_bin_sql('p1')} AS b, count(*) AS n FROM ({SCORED_SQL}) GROUP BY 1, 2"), ["kappa"], 9),
)
def tune_thresholds(spark, sf_dir):
    return tidy(M.tune_thresholds(scored(spark, sf_dir), "y", "p1", CUTS), 9)


WEIGHTS = M.blend_weights(3, 100, 5)
_BLENDED = f"""SELECT candidate, w0, w1, w2, y, p1 * w0 + p2 * w1 + p3 * w2 AS x FROM ({SCORED_SQL}) JOIN
  (SELECT * FROM (VALUES {", ".join(f"({i}, {', '.join(f'{w!r}::DOUBLE' for w in ws)})" for i, ws in enumerate(WEIGHTS))})
   v(candidate, w0, w1, w2)) ON TRUE"""


@query(
    "tune_blend",
    tidy_sql(
        _search_sql(
            f"SELECT candidate, w0, w1, w2, y, {_bin_sql('x')} AS b, count(*) AS n FROM ({_BLENDED}) GROUP BY 1, 2, 3, 4, 5, 6",
            "candidate, w0, w1, w2",
        ),
        ["kappa", "w0", "w1", "w2"],
        9,
    ),
)
def tune_blend(spark, sf_dir):
    return tidy(M.tune_blend(scored(spark, sf_dir), "y", ["p1", "p2", "p3"], WEIGHTS, CUTS), 9)


# --- votes, stacking, cross-validation ---------------------------------------------------------

_PREDICTIONS = ["p1", "p2", "p3"]


@query(
    "stack_predictions",
    tidy_sql(f"SELECT id, p1, p2, p3 FROM ({SCORED_SQL})", _PREDICTIONS),
)
def stack_predictions(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return tidy(E.stack_predictions({p: rows.select("id", col(p).alias("raw")) for p in _PREDICTIONS}))


@query("weighted_vote", tidy_sql(f"SELECT id, (p1 * 2 + p2 + p3 * 0.5::DOUBLE) / 3.5::DOUBLE AS raw FROM ({SCORED_SQL})", ["raw"]))
def weighted_vote(spark, sf_dir):
    vote = E.weighted_vote([F.col(p) for p in _PREDICTIONS], [2, 1, 0.5])
    return tidy(scored(spark, sf_dir).select("id", vote.alias("raw")))


@query(
    "score_against",
    tidy_sql(
        f"""WITH r AS (SELECT y, {_LABEL.format("p1")} AS label FROM ({SCORED_SQL}) WHERE id % 3 <> 0),
        n AS (SELECT count(*) AS n, avg(CASE WHEN y = label THEN 1.0::DOUBLE ELSE 0 END) AS accuracy,
          sum((y - label) * (y - label)) AS apart, sum(y * y + label * label) AS squares,
          sum(y) AS true_sum, sum(label) AS pred_sum FROM r)
        SELECT n, accuracy, 1 - apart / (squares - 2 * true_sum * pred_sum / n::DOUBLE) AS kappa FROM n""",
        ["accuracy", "kappa"],
    ),
)
def score_against(spark, sf_dir):
    """Scored rows of which two thirds have a known truth."""
    rows = scored(spark, sf_dir)
    labels = M.labelled(rows.select("id", "p1"), "p1", P.SCORE_CUTS)
    truth = rows.select("id", F.when(F.col("id") % 3 != 0, F.col("y")).alias("y"))
    return tidy(M.score_against(labels, truth, "y"))


@query(
    "fold_accuracy",
    tidy_sql(
        f"""SELECT fold, avg(CASE WHEN y = {_LABEL.format("p1")} THEN 1.0::DOUBLE ELSE 0 END) AS accuracy
        FROM ({FOLDED_SQL}) GROUP BY fold""",
        ["accuracy"],
    ),
)
def fold_accuracy(spark, sf_dir):
    return tidy(M.accuracy(M.labelled(folded(spark, sf_dir), "p1", P.SCORE_CUTS), "y", "label", ["fold"]))


def _ols_sql(rows: str, key: str = "") -> str:
    """Least squares of y on p1 and p2, by the normal equations."""
    k, group = (f"{key}, ", f"GROUP BY {key}") if key else ("", "")
    return f"""SELECT {k}b1, b2, my - b1 * m1 - b2 * m2 AS b0 FROM (
    SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
      (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM (
    SELECT {k}avg(y) AS my, avg(p1) AS m1, avg(p2) AS m2, var_pop(p1) AS s11, var_pop(p2) AS s22,
      covar_pop(p1, p2) AS s12, covar_pop(p1, y) AS s1y, covar_pop(p2, y) AS s2y FROM ({rows}) {group}))"""


@query(
    "stack_linear",
    tidy_sql(
        f"""SELECT unnest(['intercept', 'p1', 'p2']) AS term, unnest([b0, b1, b2]) AS weight
        FROM ({_ols_sql(SCORED_SQL)})""",
        ["weight"],
        5,
    ),
)
def stack_linear(spark, sf_dir):
    model = E.stack_linear(scored(spark, sf_dir), ["p1", "p2"])
    rows = [("intercept", float(model.intercept))] + [(n, float(w)) for n, w in zip(["p1", "p2"], model.coefficients)]
    return tidy(spark.createDataFrame(rows, "term string, weight double"), 5)


_CV_SQL = f"""WITH d AS ({FOLDED_SQL}),
fits AS ({_ols_sql("SELECT f.k, d.* FROM d JOIN (SELECT i AS k FROM range(5) r(i)) f ON d.fold <> f.k", "k")})
SELECT id, fold, y, b0 + b1 * p1 + b2 * p2 AS raw, {_LABEL.format("b0 + b1 * p1 + b2 * p2")} AS label
FROM d JOIN fits ON fits.k = d.fold"""


@query("cv_out_of_fold", tidy_sql(_CV_SQL, ["raw"], 5))
def cv_out_of_fold(spark, sf_dir):
    def fit(rows):
        model = E.stack_linear(rows, ["p1", "p2"])
        return lambda held_out: held_out.withColumn("raw", E.linear_prediction(model, ["p1", "p2"]))

    return tidy(E.cv_out_of_fold(folded(spark, sf_dir), fit, P.SCORE_CUTS).oof, 5)


@query("train_level2", tidy_sql(_CV_SQL, ["raw"], 5))
def train_level2_query(spark, sf_dir):
    """Out-of-fold rows of the linear level."""
    return tidy(train_level2(scored(spark, sf_dir), ["p1", "p2"]).oof, 5)


# --- tree models (other learners than any SQL engine has, so rows only) ---------------------------

# The study's ensembles with few, shallow trees: these queries show the operators, and the
# full settings are in the presets.
_QUICK = {"n_estimators": 4, "max_depth": 3, "learning_rate": 0.3, "random_state": 42}
_BOOSTED = {"name": "boosted", "model_class": "LGBMRegressor", "params": _QUICK}
_FOREST = {"name": "forest", "model_class": "RandomForestRegressor", "params": {**_QUICK, "n_estimators": 10}, "weight": 2}
_NESTED = E.Ensemble((_BOOSTED, _FOREST)).to_params("both")
QUICK_MODELS = {
    "autoencoder_ensemble": {**P.AUTOENCODER_ENSEMBLE, "params": [_BOOSTED]},
    "plain_ensemble": {**P.PLAIN_ENSEMBLE, "params": [_BOOSTED]},
    "naive_ensemble": {**P.NAIVE_ENSEMBLE, "params": [_FOREST]},
}
_FEATURES = [
    "Basic_Demos-Age", "PreInt_EduHx-computerinternet_hoursday", "Physical-BMI", "BIA-BIA_Fat", "X_mean", "enmo_std",
]


def _model_rows(spark, sf_dir):
    s, people = series(spark, sf_dir), subjects(spark, sf_dir)
    merged = merge_series_features(clean_train(people, s), series_basic_stats(s, ["X", "enmo"]))
    rows = merged.select("id", "sii", *[col(c) for c in _FEATURES]).dropna(subset=["sii"])
    return materialize(rows, "model-rows")


@query("fit_regressor")
def fit_regressor(spark, sf_dir):
    rows = _model_rows(spark, sf_dir).withColumn("y", F.col("sii"))
    data = E.fit_feature_vector(rows, _FEATURES).transform(rows, ["id", "y"])
    fitted = E.Ensemble((_NESTED, _BOOSTED)).fit(data)
    return fitted.predict(data).select("id", "y", "raw")


@query("feature_importance")
def feature_importance(spark, sf_dir):
    rows = _model_rows(spark, sf_dir).withColumn("y", F.col("sii"))
    data = E.fit_feature_vector(rows, _FEATURES).transform(rows, ["y"])
    return E.feature_importance(rows, E.Ensemble((_BOOSTED, _FOREST)).fit(data), _FEATURES)


@query("param_search")
def param_search_query(spark, sf_dir):
    # All ranges but the number of trees, which decides the time.
    return param_search(_model_rows(spark, sf_dir), _FEATURES, seed=1, fixed={"n_estimators": 3}, parallelism=5)


@query("train_level1")
def train_level1_query(spark, sf_dir):
    return train_level1(_model_rows(spark, sf_dir), _FEATURES, [_BOOSTED, _FOREST]).oof


@query(
    "prepare_train",
    over_both(f"SELECT id, sii FROM ({CLEANED_SQL}) WHERE sii IS NOT NULL"),
)
def prepare_train_query(spark, sf_dir):
    """Key and target of the prepared rows (the features have queries of their own)."""
    prepared = prepare_train(
        subjects(spark, sf_dir), series(spark, sf_dir), LAYOUT,
        {"encoding_dim": 4, "epochs": 3, "learning_rate": 0.01},
    )
    return prepared.frames[P.ENCODED].select("id", "sii")


@query("batch_score")
def batch_score_query(spark, sf_dir):
    """From raw tables to labels in one go: prepare, train both levels, score every subject."""
    people, s = subjects(spark, sf_dir), series(spark, sf_dir)
    prepared = prepare_train(people, s, LAYOUT, {"encoding_dim": 8, "epochs": 10, "learning_rate": 0.001})
    trained = train(prepared, QUICK_MODELS)
    # As a scoring job of its own would: from saved models and saved fitted values.
    save_models(spark, trained, models := fresh_path(spark, "models"))
    save_artifacts(prepared.artifacts, fitted := fresh_path(spark, "artifacts"))
    scored_rows = prepare_test(people, s, load_artifacts(spark, fitted), LAYOUT)
    labels = batch_score(load_models(spark, models), scored_rows)
    path = fresh_path(spark, "labels")
    write_predictions(labels, path)
    return spark.read.parquet(path)


# --- regularised boosting --------------------------------------------------------------------------

# Columns of few values, so that every value ends a bin and SQL can try all cuts. A seventh of one is missing.
_BOOST_FEATURES = ["quantity", "discount", "tax"]
_BOOST_SQL = """SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS quantity,
  l_discount AS discount, l_tax AS tax, l_extendedprice / 1000 AS y FROM lineitem"""
_STUMP = {"n_estimators": 1, "num_leaves": 2, "learning_rate": 0.5, "min_data_in_leaf": 50, "lambda_l1": 40.0, "lambda_l2": 25.0}


def _boost_rows(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity").cast("double")).alias("quantity"),
        F.col("l_discount").cast("double").alias("discount"),
        F.col("l_tax").cast("double").alias("tax"),
        (F.col("l_extendedprice").cast("double") / 1000).alias("y"),
    )
    nan = F.lit(float("nan"))
    vector = array_to_vector(F.array(*[F.coalesce(F.col(c), nan) for c in _BOOST_FEATURES]))
    return rows.select("id", "y", *_BOOST_FEATURES, vector.alias("features"))


def _stump_sql() -> str:
    """The split of the greatest gain, and what its sides add, by trying every value of every column and both sides for null."""
    each = " UNION ALL ".join(f"SELECT id, y, '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM r" for c in _BOOST_FEATURES)
    soft = lambda g: f"greatest(abs({g}) - 40.0, 0)"
    part = lambda g, n: f"{soft(g)} * {soft(g)} / ({n} + 25.0)"
    return f"""WITH r AS ({_BOOST_SQL}), m AS (SELECT avg(CAST(y AS DOUBLE)) AS start FROM r),
    e AS (SELECT feature, x, start - y AS g FROM ({each}), m),
    v AS (SELECT feature, x, sum(g) AS g, count(*) AS n FROM e WHERE x IS NOT NULL GROUP BY 1, 2),
    c AS (SELECT feature, x, sum(g) OVER w AS gl, sum(n) OVER w AS nl FROM v WINDOW w AS (PARTITION BY feature ORDER BY x)),
    t AS (SELECT feature, sum(g) AS gt, count(*) AS nt, coalesce(sum(g) FILTER (WHERE x IS NULL), 0) AS gm,
      count(*) FILTER (WHERE x IS NULL) AS nm FROM e GROUP BY 1),
    s AS (SELECT feature, x, missing_left, gt, nt, gl + CASE WHEN missing_left THEN gm ELSE 0 END AS gl,
      nl + CASE WHEN missing_left THEN nm ELSE 0 END AS nl FROM c JOIN t USING (feature), (VALUES (false), (true)) q(missing_left)),
    b AS (SELECT *, {part("gl", "nl")} + {part("(gt - gl)", "(nt - nl)")} - {part("gt", "nt")} AS gain FROM s
      WHERE nl >= 50 AND nt - nl >= 50 ORDER BY gain DESC, feature DESC, x, missing_left LIMIT 1)
    """


_LEAF = "-0.5 * sign({0}) * greatest(abs({0}) - 40.0, 0) / ({1} + 25.0)"


@query(
    "boosted_first_split",
    tidy_sql(
        f"""{_stump_sql()} SELECT feature, x AS threshold, missing_left, gain, CAST(nl AS BIGINT) AS left_rows,
        CAST(nt - nl AS BIGINT) AS right_rows, {_LEAF.format("gl", "nl")} AS left_value,
        {_LEAF.format("(gt - gl)", "(nt - nl)")} AS right_value FROM b""",
        ["threshold", "gain", "left_value", "right_value"],
        4,
    ),
)
def boosted_first_split(spark, sf_dir):
    """The first split of a regularised tree: where, which side missing values take, its gain, and what both leaves add."""
    model = BoostedRegressor(settings_of("LGBMRegressor", _STUMP), key="id").fit(_boost_rows(spark, sf_dir))
    tree = model.trees[0]
    f, left = tree.feature[0], tree.left[0]
    row = (
        _BOOST_FEATURES[f], model.edges[f][tree.bin[0]], tree.missing_left[0], tree.gain[0],
        tree.rows[left], tree.rows[left + 1], tree.value[left], tree.value[left + 1],
    )
    schema = "feature string, threshold double, missing_left boolean, gain double, left_rows long, right_rows long, left_value double, right_value double"
    return tidy(spark.createDataFrame([row], schema), 4)


@query(
    "boosted_scores",
    tidy_sql(
        f"""{_stump_sql()} SELECT id, start + CASE WHEN CASE b.feature WHEN 'quantity' THEN coalesce(quantity <= x, missing_left)
          WHEN 'discount' THEN coalesce(discount <= x, missing_left) ELSE coalesce(tax <= x, missing_left) END
          THEN {_LEAF.format("gl", "nl")} ELSE {_LEAF.format("(gt - gl)", "(nt - nl)")} END AS raw FROM r, m, b""",
        ["raw"],
        4,
    ),
)
def boosted_scores(spark, sf_dir):
    """Every row scored by a regularised tree of one split."""
    rows = _boost_rows(spark, sf_dir)
    model = BoostedRegressor(settings_of("LGBMRegressor", _STUMP), predictionCol="raw", key="id").fit(rows)
    return tidy(model.transform(rows).select("id", "raw"), 4)


@query("boosted_libraries")
def boosted_libraries(spark, sf_dir):
    """Members of the three libraries with all their penalties, scored side by side (tests compare each with a search over all rows)."""
    rows = _boost_rows(spark, sf_dir)
    given = {"learning_rate": 0.3, "reg_alpha": 2.0, "reg_lambda": 3.0, "subsample": 0.8, "random_state": 1}
    more = {
        "LGBMRegressor": {"n_estimators": 6, "num_leaves": 15, "bagging_freq": 2},
        "XGBRegressor": {"n_estimators": 6, "max_depth": 4},
        "CatBoostRegressor": {"iterations": 6, "depth": 4},
    }
    for name, own in more.items():
        fitted = BoostedRegressor(settings_of(name, {**given, **own}), predictionCol=name, key="id").fit(rows)
        rows = fitted.transform(rows)
    return rows.select("id", "y", *more)


# --- exact cut points, fits of all folds from one scan ------------------------------------------------

# Scores to a twentieth, so that SQL can try all triples of them.
_EXACT_SQL = f"""WITH r AS (SELECT y, ROUND(p1 * 20) AS s FROM ({SCORED_SQL})),
c AS (SELECT s, count(*) FILTER (WHERE y = 0) AS a0, count(*) FILTER (WHERE y = 1) AS a1, count(*) FILTER (WHERE y = 2) AS a2,
  count(*) FILTER (WHERE y = 3) AS a3 FROM r GROUP BY s),
u AS (SELECT s, {", ".join(f"coalesce(sum(a{v}) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c{v}" for v in range(4))} FROM c
  UNION ALL SELECT 'infinity'::DOUBLE, sum(a0), sum(a1), sum(a2), sum(a3) FROM c),
t AS (SELECT count(*) AS n, sum(y) AS ys, sum(y * y) AS yy FROM r),
k AS (SELECT {", ".join(f"i.c{v} AS i{v}, j.c{v} - i.c{v} AS j{v}, k.c{v} - j.c{v} AS k{v}, w.c{v} - k.c{v} AS l{v}" for v in range(4))}
  FROM u i JOIN u j ON i.s <= j.s JOIN u k ON j.s <= k.s CROSS JOIN (SELECT * FROM u WHERE isinf(s)) w),
o AS (SELECT i1 + 4 * i2 + 9 * i3 + j0 + j2 + 4 * j3 + 4 * k0 + k1 + k3 + 9 * l0 + 4 * l1 + l2 AS apart,
  j0 + j1 + j2 + j3 AS one, k0 + k1 + k2 + k3 AS two, l0 + l1 + l2 + l3 AS three FROM k)
SELECT max(1 - apart::DOUBLE / nullif(yy + one + 4 * two + 9 * three - 2 * ys::DOUBLE * (one + 2 * two + 3 * three) / n, 0)) AS kappa FROM o, t"""


@query("exact_thresholds", tidy_sql(_EXACT_SQL, ["kappa"], 9))
def exact_thresholds(spark, sf_dir):
    """The greatest kappa that any cut points reach."""
    rows = scored(spark, sf_dir).select("y", F.round(F.col("p1") * 20).alias("s"))
    return tidy(spark.createDataFrame([(tuning.exact_thresholds(rows, "y", "s").kappa,)], "kappa double"), 9)


@query("exact_thresholds_all_scores")
def exact_thresholds_all_scores(spark, sf_dir):
    """The same over scores as they are (tests compare with every split of small tables)."""
    found = tuning.exact_thresholds(scored(spark, sf_dir), "y", "p1")
    return spark.createDataFrame([(found.kappa, *found.values)], "kappa double, t0 double, t1 double, t2 double")


@query("linear_out_of_fold", tidy_sql(_CV_SQL, ["raw"], 5))
def linear_out_of_fold_query(spark, sf_dir):
    """Out-of-fold scores of a linear model, all fits from one scan."""
    return tidy(linear_out_of_fold(folded(spark, sf_dir), ["p1", "p2"], P.SCORE_CUTS)[0], 5)


@query(
    "linear_fold_weights",
    tidy_sql(
        f"""WITH d AS ({FOLDED_SQL}) SELECT k AS fold, b1, b2, b0 FROM
        ({_ols_sql("SELECT f.k, d.* FROM d JOIN (SELECT i AS k FROM range(5) r(i)) f ON d.fold <> f.k", "k")})""",
        ["b0", "b1", "b2"],
        5,
    ),
)
def linear_fold_weights(spark, sf_dir):
    """Weights of the fit that left out each fold."""
    _, fits, _ = linear_out_of_fold(folded(spark, sf_dir), ["p1", "p2"], P.SCORE_CUTS)
    rows = [(k, *f.coefficients, f.intercept) for k, f in fits.items()]
    return tidy(spark.createDataFrame(rows, "fold long, b1 double, b2 double, b0 double"), 5)


@query("parzen_search")
def parzen_search(spark, sf_dir):
    """Twelve trials for the cut points of a score, each the kappa of all rows; every trial is led by those before it."""
    rows = scored(spark, sf_dir).select("y", "p1").persist()
    space = {f"t{i}": (i - 0.5, i + 1.5, None) for i in range(3)}

    def kappa(cuts):
        return M.quadratic_kappa(M.labelled(rows, "p1", sorted(cuts.values())), "y", "label").first()["kappa"]

    try:
        history = maximise(kappa, 12, 3, {}, space)
    finally:
        rows.unpersist()
    return spark.createDataFrame([(i, v, *p.values()) for i, (p, v) in enumerate(history)], "trial int, kappa double, t0 double, t1 double, t2 double")
