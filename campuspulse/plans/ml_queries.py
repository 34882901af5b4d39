"""Model queries. Closed-form models have SQL twins that solve the same equations; tree models have none."""

from __future__ import annotations

from pyspark.sql import functions as F

from campuspulse.functions import features as names
from campuspulse.operators import courses, ml, risk, stats
from campuspulse.operators import linear_models as lm
from campuspulse.operators.activity import KEYS
from campuspulse.plans import inputs, model_sql
from campuspulse.plans.course_queries import student_frame
from campuspulse.plans.registry import add_cte, query, rnd
from campuspulse.session import materialise

ACTIVITY = ["page_views", "participations", "total_activity_time"]
SUBMITTED = ["num_submissions", "on_time_rate", "late_rate", "missing_rate", "submission_rate", "avg_score", "first_score"]
EVERYTHING = ACTIVITY + SUBMITTED
# The part of the named feature sets that the student frame holds.
ACTIVITY_ONLY = [f for f in names.ACTIVITY_ONLY if f in ACTIVITY]
ALL_DATA = [f for f in names.ALL_DATA if not f.endswith("_level") and f != "floating" and f != "floating_rate"]
# Linear models without a penalty need features of which none follows from the others.
INDEPENDENT = ["page_views", "total_activity_time", "num_submissions", "on_time_rate", "late_rate", "avg_score", "first_score"]
LEAKY_SET = [f for f in EVERYTHING if f not in names.SCORE_BASED]
PURE_SET = [f for f in LEAKY_SET if f not in names.LEAKY]
CHOICES = {"all": EVERYTHING, "leaky": LEAKY_SET, "pure": PURE_SET}


def model_frame(spark, d, features=None, complete=False):
    """Imputed features, label, balanced weight and fold of every enrolled student; ``complete`` keeps full rows only."""
    features = features or EVERYTHING
    base = stats.pass_fail(student_frame(spark, d)).where("final_score is not null")
    rows = base.select(*KEYS, "final_score", "failed", *features)
    frame = materialise(ml.complete_rows(rows, features) if complete else rows)
    ready = ml.standardise_within(ml.impute(frame, features), features)
    return materialise(ml.stratified_folds(ml.balanced_weight(ready, "failed"), "failed"))


def course_frame(spark, d, features=None):
    """The same for models of single courses: medians of the course, contiguous folds in each course."""
    features = features or EVERYTHING
    base = stats.pass_fail(student_frame(spark, d)).where("final_score is not null")
    frame = materialise(base.select(*KEYS, "final_score", "failed", *features))
    ready = ml.standardise_within(ml.impute(frame, features, by=["course_id"]), features)
    return materialise(lm.contiguous_folds(ready, ["course_id"], "user_id"))


# --- frames, folds and steps of the twins --------------------------------------------------

model_sql.add_frame("mf", EVERYTHING)
model_sql.add_frame("mfact", ACTIVITY)
model_sql.add_frame("mfsub", SUBMITTED)
model_sql.add_frame("mfall", ALL_DATA)
model_sql.add_frame("mfridge", EVERYTHING, complete=True)
model_sql.add_frame("mflin", INDEPENDENT, complete=True)
model_sql.add_frame("cf", EVERYTHING, within=True)
model_sql.add_logistic("lr", "mf", len(EVERYTHING))
model_sql.add_logistic("lract", "mfact", len(ACTIVITY))
model_sql.add_logistic("lrsub", "mfsub", len(SUBMITTED))
model_sql.add_logistic("lrall", "mfall", len(ALL_DATA))
model_sql.add_ridge("linact", "mfact", len(ACTIVITY), alpha=0.0)
model_sql.add_ridge("rid", "mfridge", len(EVERYTHING))
model_sql.add_ridge("lin", "mflin", len(INDEPENDENT), alpha=0.0)
for _name, _features in CHOICES.items():
    model_sql.add_ridge(f"c{_name}", "cf", len(EVERYTHING), "course_id", pick=[EVERYTHING.index(f) + 1 for f in _features])


def counts_sql(oof, by=""):
    return f"""SELECT {by}count(*) FILTER (failed = 1 AND prediction = 1) AS tp, count(*) FILTER (failed = 0 AND prediction = 1) AS fp,
        count(*) FILTER (failed = 1 AND prediction = 0) AS fn, count(*) FILTER (failed = 0 AND prediction = 0) AS tn FROM {oof} GROUP BY ALL"""


def ratio_sql(a, b):
    return f"coalesce(({a}) / nullif(({b}) * 1.0, 0), 0)"


METRICS = {
    "accuracy": ratio_sql("tp + tn", "tp + fp + fn + tn"), "precision": ratio_sql("tp", "tp + fp"), "recall": ratio_sql("tp", "tp + fn"),
    "f1": ratio_sql("2 * tp", "2 * tp + fp + fn"),
}
METRIC_SQL = "tp, fp, fn, tn, " + ", ".join(rnd(sql, name) for name, sql in METRICS.items())


def auc_sql(oof, by=""):
    """Area under the ROC curve from mid-ranks."""
    part = f"PARTITION BY {by} " if by else ""
    same = f"PARTITION BY {by + ', ' if by else ''}probability"
    lead = f"{by}, " if by else ""
    return f"""SELECT {lead}(sum(rk) FILTER (failed = 1) - sum(failed) * (sum(failed) + 1) / 2.0) / nullif(sum(failed) * sum(1 - failed) * 1.0, 0) AS auc FROM (
        SELECT {lead}failed, rank() OVER ({part}ORDER BY probability) + (count(*) OVER ({same}) - 1) / 2.0 AS rk FROM {oof}) GROUP BY ALL"""


def logistic_predictions(spark, d, features=None):
    """Every student's probability by the logistic model of the other folds; all folds share the scans."""
    features = features or EVERYTHING
    return lm.logistic_out_of_fold(model_frame(spark, d, features), features)


def predictions(spark, d, estimator, features=None):
    """The same by a tree model."""
    features = features or EVERYTHING
    return ml.out_of_fold(ml.assemble(model_frame(spark, d, features), features), estimator)


@query("model_frame", "mf", "SELECT course_id, user_id, failed, fold, " + ", ".join(rnd(f"x[{i + 2}]", f) for i, f in enumerate(EVERYTHING)) + " FROM mf")
def model_frame_table(spark, d):
    """Imputed and within-course standardised features with fold and label."""
    return model_frame(spark, d).select(*KEYS, "failed", "fold", *EVERYTHING)


@query("course_model_frame", "cf", "SELECT course_id, user_id, failed, fold, " + ", ".join(rnd(f"x[{i + 2}]", f) for i, f in enumerate(EVERYTHING)) + " FROM cf")
def course_model_frame(spark, d):
    return course_frame(spark, d).select(*KEYS, "failed", "fold", *EVERYTHING)


@query("fold_sizes", "enr", """SELECT failed, CAST(fold AS INTEGER) AS fold, count(*) AS n FROM (
    SELECT CASE WHEN final_score < 57 THEN 1 ELSE 0 END AS failed, (row_number() OVER (PARTITION BY final_score < 57) - 1) % 5 AS fold FROM enr) GROUP BY ALL""")
def fold_sizes(spark, d):
    frame = stats.pass_fail(inputs.members(spark, d)).select(*KEYS, "failed")
    return ml.stratified_folds(frame, "failed").groupBy("failed", "fold").agg(F.count("*").alias("n"))


@query("balanced_weights", "enr", f"""SELECT failed, {rnd('tot / (2.0 * n)', 'weight')} FROM (SELECT CASE WHEN final_score < 57 THEN 1 ELSE 0 END AS failed, count(*) AS n, sum(count(*)) OVER () AS tot FROM enr GROUP BY 1)""")
def balanced_weights(spark, d):
    frame = stats.pass_fail(inputs.members(spark, d)).select("failed")
    return ml.balanced_weight(frame, "failed").select("failed", "weight").distinct()


_SUMMARY = [*METRICS, "auc"]


@query("lr_oof", "lr_oof", "SELECT " + ", ".join(f"{rnd(f'avg({m})', f'{m}_mean')}, {rnd(f'stddev_pop({m})', f'{m}_std')}" for m in _SUMMARY)
       + " FROM (SELECT fold, " + ", ".join(f"{sql} AS {m}" for m, sql in METRICS.items()) + f" FROM ({counts_sql('lr_oof', 'fold, ')})) JOIN ({auc_sql('lr_oof', 'fold')}) USING (fold)")
def lr_oof(spark, d):
    return ml.fold_summary(materialise(logistic_predictions(spark, d)))


@query("rf_oof")
def rf_oof(spark, d):
    return ml.fold_summary(materialise(predictions(spark, d, ml.forest(trees=100, depth=4))))


@query("rf_oof_deep")
def rf_oof_deep(spark, d):
    return ml.fold_summary(materialise(predictions(spark, d, ml.forest(trees=200, depth=10, leaf=5))))


@query("gbt_oof")
def gbt_oof(spark, d):
    """100 rounds of depth 3, without class weights."""
    return ml.fold_summary(materialise(predictions(spark, d, ml.boosted())))


@query("gbt_oof_weighted")
def gbt_oof_weighted(spark, d):
    """200 rounds of depth 5; the balanced weights of the classes stand to each other as n0 to n1."""
    return ml.fold_summary(materialise(predictions(spark, d, ml.boosted(rounds=200, depth=5, weighted=True))))


def compared(spark, d):
    frame = model_frame(spark, d)
    trees = ml.assemble(frame, EVERYTHING)
    found = {"forest": ml.out_of_fold(trees, ml.forest(depth=4)), "boosted": ml.out_of_fold(trees, ml.boosted())}
    return ml.compare_models({"logistic": lm.logistic_out_of_fold(frame, EVERYTHING)} | {n: materialise(p) for n, p in found.items()})


@query("model_comparison")
def model_comparison(spark, d):
    return compared(spark, d)


_SETS = {"activity": ("lract", ACTIVITY), "submissions": ("lrsub", SUBMITTED), "everything": ("lr", EVERYTHING)}
add_cte("lrcmp", " UNION ALL ".join(
    f"SELECT '{tag}' AS model, {METRICS['recall']} AS recall, {METRICS['f1']} AS f1, auc FROM ({counts_sql(f'{cte}_oof')}), ({auc_sql(f'{cte}_oof')})"
    for tag, (cte, _) in _SETS.items()), [f"{cte}_oof" for cte, _ in _SETS.values()])


def compared_sets(spark, d):
    # Imputation, scaling and folds do not depend on the other features, so one frame holds all three sets.
    frame = model_frame(spark, d)
    return ml.compare_models({tag: lm.logistic_out_of_fold(frame, features) for tag, (_, features) in _SETS.items()})


@query("feature_set_comparison", "lrcmp", f"SELECT model, {rnd('recall')}, {rnd('f1')}, {rnd('auc')} FROM lrcmp")
def feature_set_comparison(spark, d):
    """The logistic model on three feature sets."""
    return compared_sets(spark, d).select("model", "recall", "f1", "auc")


@query("best_model", "lrcmp", " UNION ALL ".join(
    f"SELECT '{by}' AS criterion, first(model ORDER BY round({by}, 9) DESC, model) AS model, {rnd(f'max({by})', 'value')} FROM lrcmp" for by in ("recall", "auc", "f1")))
def best_model(spark, d):
    """The feature set whose logistic model is best by recall, by AUC and by F1."""
    table = materialise(compared_sets(spark, d))
    rows = [ml.best_model(table, by).select(F.lit(by).alias("criterion"), "model", F.col(by).alias("value")) for by in ("recall", "auc", "f1")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("confusion", "lr_oof", "SELECT CAST(failed AS INTEGER) AS actual, CAST(prediction AS INTEGER) AS predicted, count(*) AS n FROM lr_oof GROUP BY ALL")
def confusion(spark, d):
    return ml.confusion(logistic_predictions(spark, d))


_NAMES = "[" + ", ".join(f"'{f}'" for f in EVERYTHING) + "]"


@query("odds_ratios", "lr", f"""SELECT {_NAMES}[i] AS feature, {rnd('w[i + 1]', 'coefficient')}, {rnd('exp(w[i + 1])', 'odds_ratio')}
    FROM lr, range(1, {len(EVERYTHING) + 1}) q(i) WHERE m = -1 AND t = {model_sql.STEPS}""")
def odds_ratios(spark, d):
    frame = model_frame(spark, d)
    weights = lm.logistic_by_fold(frame, EVERYTHING)[lm.ALL_ROWS]
    rows = [(f, float(v)) for f, v in zip(EVERYTHING, weights[1:])]
    table = spark.createDataFrame(rows, "feature string, coefficient double")
    return table.withColumn("odds_ratio", F.exp("coefficient")).orderBy(F.desc(F.abs("coefficient")), "feature")


@query("forest_importances")
def forest_importances(spark, d):
    frame = ml.assemble(model_frame(spark, d), EVERYTHING)
    return ml.importances(ml.forest(100, 5).fit(frame), EVERYTHING, spark)


@query("holdout_metrics", "lr_oof", f"""SELECT {METRIC_SQL} FROM ({counts_sql("(SELECT * FROM lr_oof WHERE fold = 0)")})
    WHERE (SELECT count(*) >= 20 AND count(DISTINCT failed) > 1 FROM lr_oof)""")
def holdout_metrics(spark, d):
    """80/20: one of five folds predicted by the model of the others; nothing below 20 students or with one class."""
    frame = model_frame(spark, d)
    pred = lm.logistic_out_of_fold(frame, EVERYTHING).where("fold = 0")
    return ml.large_enough(ml.classification_metrics(pred), frame)


@query("grade_regression")
def grade_regression(spark, d):
    """Five regressors, out-of-fold, on complete rows."""
    frame = model_frame(spark, d, complete=True)
    vectors = ml.assemble(frame, EVERYTHING)
    found = {"linear": lm.linear_out_of_fold(frame, EVERYTHING, alpha=0.0), "ridge": lm.linear_out_of_fold(frame, EVERYTHING)}
    for name, model in {"lasso": ml.lasso(), "forest": ml.forest_regressor(), "boosted": ml.boosted_regressor()}.items():
        found[name] = materialise(ml.out_of_fold(vectors, model).select("final_score", "prediction"))
    out = None
    for name, pred in found.items():
        row = ml.regression_metrics(pred.select("final_score", "prediction")).withColumn("model", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def regression_sql(tag, model, frame):
    return f"""SELECT '{tag}' AS model, count(*) AS n, {rnd('avg(e * e)', 'mse')}, {rnd('sqrt(avg(e * e))', 'rmse')}, {rnd('avg(abs(e))', 'mae')},
        {rnd('1 - sum(e * e) / (var_pop(final_score) * count(*))', 'r2')}
        FROM (SELECT final_score, list_dot_product(m.c, list_concat(f.x, [final_score])) AS e FROM {frame} f JOIN {model} m ON m.fold = f.fold)"""


@query("linear_regressions", "lin rid", regression_sql("linear", "lin", "mflin") + " UNION ALL " + regression_sql("ridge", "rid", "mfridge"))
def linear_regressions(spark, d):
    """Out-of-fold errors of least squares on independent features and of ridge on all, on complete rows."""
    linear = lm.linear_out_of_fold(model_frame(spark, d, INDEPENDENT, complete=True), INDEPENDENT, alpha=0.0)
    ridge = lm.linear_out_of_fold(model_frame(spark, d, complete=True), EVERYTHING)
    rows = [ml.regression_metrics(p).withColumn("model", F.lit(n)) for n, p in (("linear", linear), ("ridge", ridge))]
    return rows[0].unionByName(rows[1])


@query("ablation", "lract_oof lrall_oof", " UNION ALL ".join(
    f"SELECT {METRIC_SQL}, '{tag}' AS features FROM ({counts_sql(f'{cte}_oof')})" for tag, cte in (("activity_only", "lract"), ("all_data", "lrall"))))
def ablation(spark, d):
    """Activity-only features against all features, same model and folds."""
    rows = []
    for tag, features in (("activity_only", ACTIVITY_ONLY), ("all_data", ALL_DATA)):
        pred = logistic_predictions(spark, d, features)
        rows.append(ml.classification_metrics(pred).withColumn("features", F.lit(tag)))
    return rows[0].unionByName(rows[1])


LEVEL = """CASE WHEN probability > 0.7 THEN 'Critical' WHEN probability > 0.5 THEN 'High' WHEN probability > 0.3 THEN 'Medium' WHEN probability > 0 THEN 'Low' END"""


@query("model_risk_report", "lr_oof", f"SELECT course_id, user_id, failed, {rnd('probability')}, {LEVEL} AS risk_level FROM lr_oof")
def model_risk_report(spark, d):
    """Out-of-fold failure probability and level per student."""
    return risk.risk_report(logistic_predictions(spark, d)).select(*KEYS, "failed", "probability", "risk_level")


@query("model_catch_rate", "lr_oof", f"""SELECT count(*) FILTER (failed = 1) AS n_failed, count(*) FILTER (failed = 1 AND probability > 0.5) AS n_caught,
    {rnd('coalesce(count(*) FILTER (failed = 1 AND probability > 0.5) * 100.0 / nullif(count(*) FILTER (failed = 1), 0), 0)', 'catch_rate')},
    count(*) FILTER (probability > 0.5) AS n_flagged FROM lr_oof""")
def model_catch_rate(spark, d):
    return risk.catch_rate(risk.risk_report(logistic_predictions(spark, d)))


def feature_table(spark, d):
    table = inputs.engagement(spark, d)
    return materialise(table)


@query("pca_variance")
def pca_variance(spark, d):
    return ml.pca_variance(feature_table(spark, d), names.ALL_FEATURES, 8)


def clusters_of(spark, d, k):
    table = feature_table(spark, d)
    rows = ml.feature_clusters(stats.correlation_matrix(table, names.ALL_FEATURES), names.ALL_FEATURES, k)
    return spark.createDataFrame(rows, "feature string, cluster int, cluster_name string")


@query("feature_clusters")
def feature_clusters(spark, d):
    return clusters_of(spark, d, 8)


@query("feature_clusters_4")
def feature_clusters_4(spark, d):
    return clusters_of(spark, d, 4)


@query("feature_clusters_6")
def feature_clusters_6(spark, d):
    return clusters_of(spark, d, 6)


@query("feature_clusters_10")
def feature_clusters_10(spark, d):
    return clusters_of(spark, d, 10)


@query("pooled_features")
def pooled_features(spark, d):
    table = feature_table(spark, d)
    clusters = ml.feature_clusters(stats.correlation_matrix(table, names.ALL_FEATURES), names.ALL_FEATURES, 8)
    pooled = ml.pooled_features(table.select(*KEYS, "final_score", *names.ALL_FEATURES), clusters)
    return pooled.select(*KEYS, *sorted(c for c in pooled.columns if c.startswith("agg_")))


@query("reduced_vs_original")
def reduced_vs_original(spark, d):
    """Out-of-fold r2 of a forest on all features and on the pooled ones."""
    table = feature_table(spark, d)
    clusters = ml.feature_clusters(stats.correlation_matrix(table, names.ALL_FEATURES), names.ALL_FEATURES, 8)
    pooled = ml.pooled_features(table.select(*KEYS, "final_score", *names.ALL_FEATURES), clusters)
    folds = materialise(pooled.withColumn("fold", F.pmod(F.xxhash64(F.lit(ml.SEED), *KEYS), F.lit(5)).cast("int")))
    reduced = sorted(c for c in pooled.columns if c.startswith("agg_"))
    out = None
    for tag, columns in (("original", names.ALL_FEATURES), ("reduced", reduced)):
        pred = ml.out_of_fold(ml.assemble(folds, columns), ml.forest_regressor()).select("final_score", "prediction")
        row = ml.regression_metrics(materialise(pred)).withColumn("features", F.lit(tag))
        out = row if out is None else out.unionByName(row)
    return out


# --- models of single courses ---------------------------------------------------------------

def course_models(spark, d):
    """(course frame, its models): ridge models of every course on each choice of features, from one grouped aggregate."""
    frame = course_frame(spark, d)
    grams = lm.gram(frame, EVERYTHING, "final_score", ["course_id", "fold"])
    return frame, materialise(lm.cross_validated(grams, ["course_id"], EVERYTHING, CHOICES))


def strongest(df, value, name, k=5):
    """The ``k`` features of the largest ``value`` (nine digits, then by name) of each course, and the first of them."""
    order = F.array_sort(F.collect_list(F.struct((-F.round(value, 9)).alias("v"), "feature")))  # one entry per feature
    best = df.groupBy("course_id").agg(order.alias("_o"), F.max(value).alias(f"top_{name}_value"))
    listed = F.transform(F.slice("_o", 1, k), lambda s: s["feature"])
    return best.select("course_id", F.get(listed, F.lit(0)).alias(f"top_{name}"), F.array_join(listed, ",").alias(f"top_{name}s"), f"top_{name}_value")


def strongest_sql(source, value, name):
    return f"""SELECT course_id, first(feature ORDER BY round({value}, 9) DESC, feature) AS top_{name}, max({value}) AS top_{name}_value,
        array_to_string(list(feature ORDER BY round({value}, 9) DESC, feature)[1:5], ',') AS top_{name}s FROM {source} GROUP BY course_id"""


add_cte("cgate", """SELECT course_id, count(*) AS n, avg(final_score) AS grade_mean, stddev_pop(final_score) AS grade_std, avg(1 - failed) AS pass_rate
    FROM cf GROUP BY course_id HAVING count(*) >= 10 AND stddev_pop(final_score) >= 5""", ["cf"])
add_cte("cimp", f"""SELECT course_id, {_NAMES}[i] AS feature, -c[i + 1] AS coefficient,
    coalesce(abs(c[i + 1]) / nullif(list_sum(list_transform(c[2:{len(EVERYTHING) + 1}], lambda v: abs(v))), 0), 0) AS importance
    FROM call, range(1, {len(EVERYTHING) + 1}) q(i) WHERE fold = -1""", ["call"])
add_cte("crho", f"""SELECT course_id, feature, corr(rx, ry) AS r FROM (
    SELECT course_id, feature, rank() OVER (PARTITION BY course_id, feature ORDER BY v) + (count(*) OVER (PARTITION BY course_id, feature, v) - 1) / 2 AS rx,
           rank() OVER (PARTITION BY course_id, feature ORDER BY final_score) + (count(*) OVER (PARTITION BY course_id, feature, final_score) - 1) / 2 AS ry
    FROM (SELECT course_id, user_id, final_score, {_NAMES}[i] AS feature, x[i + 1] AS v FROM cf, range(1, {len(EVERYTHING) + 1}) q(i)))
    GROUP BY ALL HAVING count(*) >= 5 AND stddev_pop(rx) > 0 AND stddev_pop(ry) > 0""", ["cf"])


@query("course_profiles", "cgate call_r2 cimp crho", f"""
    SELECT course_id, n, {rnd('grade_mean')}, {rnd('grade_std')}, {rnd('pass_rate')},
           CASE WHEN pass_rate IN (0, 1) THEN 'LOW DIVERSITY' WHEN pass_rate < 0.2 OR pass_rate > 0.8 THEN 'MODERATE' ELSE 'GOOD' END AS class_diversity,
           {rnd('r2_mean')}, {rnd('r2_std')}, top_importance, top_importances, top_feature, top_features, {rnd('top_feature_value', 'top_abs_rho')}
    FROM cgate LEFT JOIN call_r2 USING (course_id) LEFT JOIN ({strongest_sql('cimp', 'importance', 'importance')}) USING (course_id)
    LEFT JOIN ({strongest_sql('crho', 'abs(r)', 'feature')}) USING (course_id)""")
def course_profiles(spark, d):
    """Per gated course: grades, diversity, cross-validated ridge r2, strongest coefficients and rank correlations."""
    frame, models = course_models(spark, d)
    gate = courses.class_diversity(frame).join(courses.grade_stats(frame).select("course_id", "grade_mean", F.col("grade_std_pop").alias("grade_std")), "course_id")
    own = models.where("choice = 'all'")
    heavy = strongest(lm.weights_of(own, ["course_id"], EVERYTHING), "importance", "importance").drop("top_importance_value")
    rho = stats.spearman(frame, EVERYTHING, "final_score", ["course_id"]).withColumn("abs_r", F.abs("r"))
    best = strongest(rho, "abs_r", "feature").withColumnRenamed("top_feature_value", "top_abs_rho")
    out = gate.join(own.select("course_id", "r2_mean", "r2_std"), "course_id", "left").join(heavy, "course_id", "left").join(best, "course_id", "left")
    return out.select("course_id", "n", "grade_mean", "grade_std", "pass_rate", "class_diversity", "r2_mean", "r2_std",
                      "top_importance", "top_importances", "top_feature", "top_features", "top_abs_rho")


@query("mean_importance", "cgate cimp", f"SELECT feature, {rnd('avg(importance)', 'importance')}, count(*) AS n_courses FROM cimp JOIN cgate USING (course_id) GROUP BY ALL")
def mean_importance(spark, d):
    """Importances averaged over one model per gated course."""
    frame, models = course_models(spark, d)
    gated = models.where("choice = 'all'").join(courses.class_diversity(frame).select("course_id"), "course_id", "left_semi")
    return ml.mean_importance(lm.weights_of(gated, ["course_id"], EVERYTHING))


@query("course_models", "cgate call_r2 cleaky_r2 cpure_r2", " UNION ALL ".join(
    f"SELECT course_id, '{c}' AS choice, n, folds, {rnd('r2_mean')}, {rnd('r2_std')} FROM cgate JOIN c{c}_r2 USING (course_id)" for c in CHOICES))
def course_model_table(spark, d):
    """Cross-validated r2 of every gated course on all, leaky and pure features."""
    frame, models = course_models(spark, d)
    gated = models.join(courses.class_diversity(frame).select("course_id"), "course_id", "left_semi")
    return gated.select("course_id", "choice", "n", "folds", "r2_mean", "r2_std")


add_cte("cboth", "SELECT course_id, l.r2_mean AS l, p.r2_mean AS p FROM cgate JOIN cleaky_r2 l USING (course_id) JOIN cpure_r2 p USING (course_id)", ["cgate", "cleaky_r2", "cpure_r2"])


@query("leaky_vs_pure_models", "cboth", f"""SELECT {rnd('avg(l)', 'with_leaky')}, {rnd('avg(p)', 'pure')}, {rnd('avg(l) - avg(p)', 'difference')},
    {rnd('(avg(l) / avg(p) - 1) * 100', 'inflation_pct', 4)}, count(*) AS n_courses FROM cboth""")
def leaky_vs_pure_models(spark, d):
    """Mean model r2 over courses with and without features that follow from submitting work."""
    frame, models = course_models(spark, d)
    gated = models.join(courses.class_diversity(frame).select("course_id"), "course_id", "left_semi").withColumnRenamed("r2_mean", "r2")
    out = stats.leaky_vs_pure(gated.where("choice = 'leaky'"), gated.where("choice = 'pure'"))
    return out.withColumn("inflation_pct", F.round("inflation_pct", 4))


@query("r2_overall_models", "cboth", f"SELECT {rnd('avg(p)', 'average')}, {rnd('max(p)', 'best')}, {rnd('min(p)', 'worst')}, {rnd('quantile_cont(p, 0.5)', 'median')} FROM cboth")
def r2_overall_models(spark, d):
    """Average, best, worst and median model r2 of the courses on pure activity."""
    frame, models = course_models(spark, d)
    gated = models.where("choice = 'pure'").join(courses.class_diversity(frame).select("course_id"), "course_id", "left_semi")
    return stats.overall(materialise(gated), "r2_mean")


@query("feasibility", "lract_oof linact", f"""SELECT {rnd('100 * (0.4 * r2 + 0.6 * f1)', 'feasibility')} FROM (SELECT {METRICS['f1']} AS f1 FROM ({counts_sql('lract_oof')})),
    ({regression_sql('linear', 'linact', 'mfact').replace(rnd('1 - sum(e * e) / (var_pop(final_score) * count(*))', 'r2'), '1 - sum(e * e) / (var_pop(final_score) * count(*)) AS r2')})""")
def feasibility(spark, d):
    """100 * (0.4 r2 + 0.6 F1) of activity-only models."""
    frame = model_frame(spark, d, ACTIVITY)
    f1 = ml.classification_metrics(lm.logistic_out_of_fold(frame, ACTIVITY)).select("f1")
    r2 = ml.regression_metrics(lm.linear_out_of_fold(frame, ACTIVITY, alpha=0.0)).select("r2")
    return courses.feasibility(stats.attach_row(f1, r2))
