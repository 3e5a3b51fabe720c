"""Registered queries: one per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from tribunal.functions import rules
from tribunal.operators import detect, explain as X, features as E, metrics as M, prepare as R, profile as P
from tribunal.operators import score as S, verdict as V
from tribunal.operators.candidates import PROFILES, TrainingFacts, candidates, logistic, ridge
from tribunal.operators.folds import kfold, stratified_folds
from tribunal.operators.knn import class_shares, feature_array, knn_fold_predictions, knn_predict
from tribunal.operators.mutual_info import (
    binned_mutual_info, neighbour_mutual_info, neighbour_mutual_info_regression,
)
from tribunal.operators.ridge import ridge_models
from tribunal.operators.ordering import order_statistics
from tribunal.plans import fixtures as T, report
from tribunal.plans.analysis import Analysis, analyze, prepared_rows
from tribunal.operators.training import refit, training_table
from tribunal.session import freeze, new_path
from tribunal.sources.json_columns import write_columns
from tribunal.sources.readers import read_table
from tribunal.sources.writers import load_run, save_run

Query = Callable[[SparkSession, str], DataFrame]

PRICE_FEATURES = ["p_partkey", "p_size", "p_type", "p_brand", "p_name"]
LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


# --- sources and profile ------------------------------------------------------

def csv_roundtrip(spark, folder):
    """Write parts as CSV, read them back with inferred types."""
    path = new_path(spark, "parts") + ".csv"
    T.part_price(spark, folder).write.csv(path, header=True)
    return read_table(spark, path)


def csv_line_breaks(spark, folder):
    """Whole documents as CSV, line breaks inside their cells, read back by as many tasks as any text."""
    path = new_path(spark, "documents") + ".csv"
    T.table(spark, folder, "documents").select("doc_id", "text", "source").write.csv(path, header=True, escape='"', quoteAll=True)
    return read_table(spark, path).select("doc_id", "source", F.sha2(F.regexp_replace("text", "\r", "").cast("binary"), 256).alias("text"))


def json_roundtrip(spark, folder):
    path = new_path(spark, "parts") + ".json"
    T.part_price(spark, folder).write.json(path)
    return read_table(spark, path)


def dataset_profile(spark, folder):
    return P.dataset_profile(T.table(spark, folder, "lineitem"))


def json_columns(spark, folder):
    """Orders as a JSON object of columns, each an object from row key to cell, read back as rows."""
    orders = T.table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("key"), "o_custkey", "o_totalprice", "o_orderstatus")
    path = new_path(spark, "orders") + ".json"
    write_columns(orders, "key", path)
    return read_table(spark, path)


def preview_rows(spark, folder):
    return P.preview(T.part_price(spark, folder), ["p_partkey"])


def dataset_info(spark, folder):
    info = P.dataset_info(P.drop_null_target(T.with_nulls(spark, folder), "some_missing"), "some_missing")
    return info.withColumn("original_columns", F.concat_ws(",", "original_columns"))


def drop_null_target(spark, folder):
    return P.drop_null_target(T.with_nulls(spark, folder), "some_missing").groupBy("l_linestatus").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("some_missing").alias("total"))


def select_features(spark, folder):
    return P.select_features(T.part_price(spark, folder), "p_retailprice", ["p_size", "absent", "p_type"])


def separate_target(spark, folder):
    return P.separate_target(T.part_price(spark, folder), "p_retailprice")


# --- detection ----------------------------------------------------------------

def _detect(source: Callable[[SparkSession, str], DataFrame], target: str) -> Query:
    return lambda spark, folder: detect.detect_problem(source(spark, folder), target)


def _lineitem(spark, folder):
    return T.table(spark, folder, "lineitem")


def target_profile(spark, folder):
    return detect.target_profile(_lineitem(spark, folder), "l_discount").select(
        "target", "dtype", "n_rows", "unique_count", F.round("_ratio", 6).alias("unique_ratio"))


def target_sample_values(spark, folder):
    values = detect.sample_values(T.table(spark, folder, "orders"), "o_orderpriority", "o_orderkey")
    return spark.createDataFrame([(i + 1, v) for i, v in enumerate(values)], "position long, value string")


def first_in_file_order(spark, folder):
    """First rows and first distinct values of a CSV copy of the orders without their key, as the files have them."""
    path = new_path(spark, "orders") + ".csv"
    kept = ["o_orderpriority", "o_orderstatus", "o_totalprice"]
    T.table(spark, folder, "orders").repartitionByRange(7, "o_orderkey").sortWithinPartitions("o_orderkey").select(*kept).write.csv(path, header=True)
    orders = read_table(spark, path, place="where")
    rows = P.preview(orders, [], 20, "where").select(F.lit("row").alias("kind"), F.concat_ws("|", *kept).alias("value"))
    values = detect.sample_values(orders, "o_orderpriority", "where")
    found = spark.createDataFrame([("value", f"{i + 1} {v}") for i, v in enumerate(values)], "kind string, value string")
    return rows.unionByName(found)


def class_distribution(spark, folder):
    return detect.class_distribution(_lineitem(spark, folder), "l_returnflag")


def target_stats(spark, folder):
    return detect.target_stats(T.table(spark, folder, "events"), "value")


# --- preparation --------------------------------------------------------------

def missing_ratio(spark, folder):
    df = T.with_nulls(spark, folder)
    return R.missing_ratio(df, df.columns).withColumn("missing_ratio", F.round("missing_ratio", 6))


def drop_high_missing(spark, folder):
    df = T.with_nulls(spark, folder)
    kept = R.drop_high_missing(df, df.columns)
    return P.dataset_profile(kept).select("column", "n_rows")


def cardinality_filter(spark, folder):
    documents = R.cardinality_report(T.table(spark, folder, "documents"), ["lang", "source"])
    parts = R.cardinality_report(T.part_price(spark, folder), ["p_name", "p_brand", "p_type"])
    return documents.unionByName(parts)


def impute_median(spark, folder):
    return R.impute_median(T.with_nulls(spark, folder), ["some_missing", "mostly_missing"]).groupBy("l_linenumber").agg(
        F.round(F.sum("some_missing"), 4).alias("some_total"), F.round(F.sum("mostly_missing"), 4).alias("mostly_total"),
        F.count("mostly_missing").alias("n_rows"))


def exact_medians(spark, folder):
    """Medians by the narrowing rounds that large tables use."""
    df = _lineitem(spark, folder).select(*[F.col(c).cast("double").alias(c) for c in LINE_NUMBERS])
    counts = df.agg(*[F.count(c).alias(c) for c in LINE_NUMBERS]).first().asDict()
    ranks = {c: [(n - 1) // 2, n // 2] for c, n in counts.items()}
    values = order_statistics(df, ranks, counts)
    return spark.createDataFrame(
        [(c, (values[c, a] + values[c, b]) / 2) for c, (a, b) in ranks.items()], "feature string, median double")


def label_encode(spark, folder):
    df = T.with_nulls(spark, folder)
    encoded = R.label_encode(df.withColumn("flag_text", F.col("flag")), ["flag", "l_linestatus"])
    return encoded.groupBy("flag_text", "flag", "l_linestatus").agg(F.count(F.lit(1)).alias("n_rows"))


def encode_target(spark, folder):
    df, _ = R.encode_target(T.table(spark, folder, "orders"), "o_orderpriority", "code")
    return df.groupBy("o_orderpriority", F.col("code").cast("long").alias("code")).agg(F.count(F.lit(1)).alias("n_rows"))


def encode_numeric_target(spark, folder):
    """Numeric class labels are coded in text order: 10 before 2."""
    return R.class_codes(T.part_price(spark, folder), "p_size")


def encode_wide_target(spark, folder):
    """More labels than literals hold: numbered by a range partitioning."""
    df, _ = R.encode_target(T.table(spark, folder, "customer"), "c_name", "code")
    return df.select("c_custkey", F.col("code").cast("long").alias("code"))


def cast_target(spark, folder):
    return R.cast_target(T.part_price(spark, folder), "p_size").select("p_partkey", "label")


def standard_scale(spark, folder):
    scaled = R.standard_scale(T.collinear(spark, folder), ["l_quantity", "l_extendedprice", "constant"])
    return scaled.groupBy("l_tax").agg(*[
        F.round(F.sum(c), 4).alias(c) for c in ("l_quantity", "l_extendedprice", "constant")])


def _price_preparation(spark, folder):
    df = T.part_price(spark, folder).select("p_partkey", "p_size", "p_type", "p_brand", "p_name", "p_retailprice")
    return df, R.fit_preparation(df, "p_retailprice", rules.REGRESSION)


def prepared_features(spark, folder):
    df, preparation = _price_preparation(spark, folder)
    prepared, _ = prepared_rows(df.withColumn("_key", F.col("p_partkey")), preparation, "_key")
    return prepared.select("row_id", *[F.round(c, 6).alias(c) for c in (*preparation.features, "label")])


def preparation_params(spark, folder):
    df = T.with_nulls(spark, folder).drop("l_orderkey")
    frame = R.fit_preparation(df, "l_linestatus", rules.CLASSIFICATION).params_frame(spark)
    return frame.select("feature", "kind", F.round("median", 4).alias("median"), F.round("mean", 4).alias("mean"),
                        F.round("std", 4).alias("std"), "mode")


# --- feature selection ---------------------------------------------------------

COLLINEAR = ["l_quantity", "l_extendedprice", "net_price", "constant", "l_discount", "twice_discount", "l_tax"]


def low_variance(spark, folder):
    return E.variances(T.collinear(spark, folder), COLLINEAR).select(
        "feature", F.round("variance", 4).alias("variance"), "decision")


def correlation_matrix(spark, folder):
    varied = [c for c in COLLINEAR if c != "constant"]
    return E.correlation_matrix(T.collinear(spark, folder), varied).select(
        "feature_i", "feature_j", F.round("corr", 6).alias("corr"))


def correlation_matrix_wide(spark, folder):
    """More pairs than one aggregate holds."""
    df = T.collinear(spark, folder).drop("constant")
    shifted = df.select("*", *[(F.col(c) * F.col(c)).alias(f"{c}_squared") for c in df.columns],
                        *[F.sqrt(F.abs(c)).alias(f"{c}_root") for c in df.columns[:3]])
    return E.correlation_matrix(shifted, shifted.columns).select(
        F.least("feature_i", "feature_j").alias("one"), F.greatest("feature_i", "feature_j").alias("other"),
        F.round("corr", 6).alias("corr"))


def correlation_prune(spark, folder):
    varied = [c for c in COLLINEAR if c != "constant"]
    pruned = E.correlation_prune(E.correlation_matrix(T.collinear(spark, folder), varied))
    return pruned.withColumn("correlated_with", F.concat_ws(",", "correlated_with"))


def feature_report(spark, folder):
    return E.select(T.collinear(spark, folder), COLLINEAR)[2]


def _coded_docs(spark, folder):
    return R.label_encode(T.doc_quality(spark, folder), ["lang", "source"])


def mi_binned_classification(spark, folder):
    scores = binned_mutual_info(
        _coded_docs(spark, folder), ["n_chars", "odd_share", "lang", "source"], "quality",
        ["lang", "source"], True, bins=16, method="width")
    return scores.select("feature", F.round("mutual_info_score", 5).alias("mutual_info_score"))


def mi_binned_regression(spark, folder):
    scores = binned_mutual_info(
        T.part_price(spark, folder), ["p_partkey", "p_size"], "p_retailprice", [], False, bins=20, method="width")
    return scores.select("feature", F.round("mutual_info_score", 5).alias("mutual_info_score"))


def mi_neighbour_classification(spark, folder):
    df, target = R.encode_target(_coded_docs(spark, folder), "quality")[0], "label"
    scores = neighbour_mutual_info(df, ["n_chars", "odd_share", "source"], target, "doc_id")
    return scores.select("feature", F.round("mutual_info_score", 4).alias("mutual_info_score"))


def mi_neighbour_regression(spark, folder):
    scores = neighbour_mutual_info_regression(
        T.part_price(spark, folder), ["p_partkey", "p_size"], "p_retailprice", "p_partkey")
    return scores.select("feature", F.round("mutual_info_score", 4).alias("mutual_info_score"))


def feature_ranking(spark, folder):
    df = R.label_encode(_lineitem(spark, folder), ["l_returnflag", "l_linestatus"])
    features = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_linestatus"]
    scores = binned_mutual_info(df, features, "l_returnflag", ["l_linenumber", "l_linestatus"], True, 10, "width")
    return E.rank_features(scores)


# --- folds, models, metrics ------------------------------------------------------

def stratified(spark, folder):
    orders = T.table(spark, folder, "orders")
    return stratified_folds(orders, "o_orderkey", "o_orderstatus", orders.count()).select(
        "o_orderkey", "o_orderstatus", "fold")


def kfolds(spark, folder):
    return kfold(T.part_price(spark, folder), "p_partkey").select("p_partkey", "fold")


def _price_vectors(spark, folder):
    rows = T.part_price(spark, folder).select(
        F.col("p_partkey").alias("row_id"), (F.col("p_partkey") / 1000).alias("key_k"),
        F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("label"))
    return VectorAssembler(inputCols=["key_k", "size"], outputCol="features").transform(rows)


def _price_ridge(rows):
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("s")).first()
    return ridge(TrainingFacts(facts["n"], facts["s"], 0)).fit(rows)


def ridge_coefficients(spark, folder):
    model = _price_ridge(_price_vectors(spark, folder))
    return spark.createDataFrame(
        [tuple(round(float(v), 6) for v in (*model.coefficients, model.intercept))],
        "key_k double, size double, intercept double")


def ridge_folds(spark, folder):
    """Coefficients without each of five folds (-1: of all rows) from one scan."""
    rows = kfold(_price_vectors(spark, folder), "row_id")
    models = ridge_models(rows, rules.N_FOLDS)
    return spark.createDataFrame(
        [(f if f < rules.N_FOLDS else -1, *(round(float(v), 6) for v in (*m.coefficients, m.intercept))) for f, m in enumerate(models)],
        "left_out int, key_k double, size double, intercept double")


def logistic_coefficients(spark, folder):
    rows = _standard_docs(spark, folder)
    n = rows.count()
    model = logistic(TrainingFacts(n, 0.0, 2)).fit(rows)
    return X.native_importance(model, ["n_chars", "odd_share"], spark)


def _standard_docs(spark, folder):
    df = R.standard_scale(T.doc_quality(spark, folder), ["n_chars", "odd_share"])
    return VectorAssembler(inputCols=["n_chars", "odd_share"], outputCol="features").transform(
        df.select(F.col("doc_id").alias("row_id"), "n_chars", "odd_share", F.col("quality").cast("double").alias("label")))


def knn_classify(spark, folder):
    docs = R.label_encode(T.doc_quality(spark, folder), ["lang"])
    found = knn_predict(docs, docs, ["n_chars", "lang"], "doc_id", "quality", True)
    return found.select(F.col("row_id").alias("doc_id"), F.col("prediction").cast("long").alias("prediction"))


def knn_regress(spark, folder):
    parts = T.part_price(spark, folder)
    found = knn_predict(parts, parts, ["p_partkey", "p_size"], "p_partkey", "p_retailprice", False)
    return found.select(F.col("row_id").alias("p_partkey"), F.round("prediction", 6).alias("prediction"))


def cv_metrics_knn(spark, folder):
    """Cross-validated neighbours: all folds from one join."""
    folded = kfold(T.part_price(spark, folder), "p_partkey")
    rows = folded.select(F.col("p_partkey").alias("row_id"), feature_array(["p_partkey", "p_size"]).alias("x"),
                         F.col("p_retailprice").alias("label"), "fold")
    predictions = knn_fold_predictions(rows, 2, False)
    by_fold = M.regression_by_fold(predictions, ["held_out", "side"], "n", 950.0)
    return M.summarise(by_fold, [], "r2", "mae")


def macro_f1(spark, folder):
    groups = ["l_suppkey", "model_name", "held_out", "side"]
    by_fold = M.classification_by_fold(M.confusion(T.supplier_guesses(spark, folder), groups, "n"), groups)
    return by_fold.select(*groups, F.round("accuracy", 6).alias("accuracy"), F.round("f1_macro", 6).alias("f1_macro"))


def regression_metrics(spark, folder):
    groups = ["l_suppkey", "model_name", "held_out", "side"]
    return M.regression_by_fold(T.supplier_estimates(spark, folder), groups).select(
        *groups, F.round("r2", 6).alias("r2"), F.round("mae", 6).alias("mae"))


def class_metrics_summary(spark, folder):
    return T.supplier_class_metrics(spark, folder).select(
        "l_suppkey", "model_name", "test_accuracy", "train_accuracy", "test_f1_macro", "train_f1_macro", "overfit_gap")


# --- verdict ---------------------------------------------------------------------

def _class_verdict(spark, folder):
    return V.judge(T.supplier_class_metrics(spark, folder), rules.CLASSIFICATION, ["l_suppkey"])


def _regression_verdict(spark, folder):
    return V.judge(T.supplier_regression_metrics(spark, folder), rules.REGRESSION, ["l_suppkey"])


def verdict_classification(spark, folder):
    return V.leaderboard(_class_verdict(spark, folder), ["l_suppkey"])


def verdict_regression(spark, folder):
    return V.leaderboard(_regression_verdict(spark, folder), ["l_suppkey"])


def verdict_winners(spark, folder):
    return V.winners(_class_verdict(spark, folder), ["l_suppkey"])


def verdict_no_winner(spark, folder):
    """Only the two weakest rules compete, so many suppliers have no winner."""
    metrics = T.supplier_class_metrics(spark, folder).filter(F.col("model_name").isin(rules.FOREST, rules.KNN))
    return V.winners(V.judge(metrics, rules.CLASSIFICATION, ["l_suppkey"]), ["l_suppkey"])


def dimension_scores_classification(spark, folder):
    return V.dimension_scores(_class_verdict(spark, folder), ["l_suppkey"]).select(
        "l_suppkey", "model_name", "dimension", "score", "weight", "contribution", "label", "explanation")


def dimension_scores_regression(spark, folder):
    return V.dimension_scores(_regression_verdict(spark, folder), ["l_suppkey"]).select(
        "l_suppkey", "model_name", "dimension", "score", "weight", "contribution", "label", "explanation")


def rationales(spark, folder):
    return V.rationales(_class_verdict(spark, folder), ["l_suppkey"])


def disqualified(spark, folder):
    return V.disqualify(T.supplier_regression_metrics(spark, folder), rules.REGRESSION).select(
        "l_suppkey", "model_name", F.concat_ws("; ", "disqualification_reasons").alias("reasons"))


# --- explanation -------------------------------------------------------------------

def linear_shap(spark, folder):
    rows = _price_vectors(spark, folder)
    return X.shap_ranking(_price_ridge(rows), rows, ["key_k", "size"])


def coefficient_importance(spark, folder):
    rows = _price_vectors(spark, folder)
    return X.native_importance(_price_ridge(rows), ["key_k", "size"], spark)


def importance_view(spark, folder):
    rows = _price_vectors(spark, folder)
    view = X.importance_view(X.shap_ranking(_price_ridge(rows), rows, ["key_k", "size"]), None, None)
    return view.withColumn("percent", F.round("percent", 3))


def _forest(spark, folder):
    """Parts as vectors, and the forest that the analyses fit."""
    rows = _price_vectors(spark, folder).repartition(8, "row_id").sortWithinPartitions("row_id")
    forest = next(c for c in candidates(rules.REGRESSION, PROFILES["full"]) if c.name == rules.FOREST)
    return rows, forest.estimator(TrainingFacts(0, 0.0, 0)).fit(rows)


def deep_forest(spark, folder):
    """A forest without a depth limit, saved and loaded: undecided leaves of each tree, and whether each part scores as before."""
    rows = _price_vectors(spark, folder).repartition(8, "row_id").sortWithinPartitions("row_id")
    candidate = next(c for c in candidates(rules.REGRESSION, PROFILES["deep"]) if c.name == rules.FOREST)
    model = candidate.estimator(TrainingFacts(0, 0.0, 0)).fit(rows)
    path = new_path(spark, "deep")
    model.write().save(path)
    undecided = spark.read.parquet(f"{path}/data").groupBy("treeID").agg(
        F.count_if((F.col("nodeData.leftChild") < 0) & (F.col("nodeData.impurity") > 1e-6)).alias("n"))
    own, again = (m.copy({m.getParam("predictionCol"): f"p{i}"}) for i, m in enumerate((model, type(model).load(path))))
    # The second model reads the rows twice, once for their vectors; frozen, the first scores them once.
    same = again.transform(freeze(own.transform(rows))).select(
        F.lit("part").alias("kind"), F.col("row_id").cast("long").alias("id"), (F.col("p0") == F.col("p1")).cast("long").alias("n"))
    return undecided.select(F.lit("tree").alias("kind"), F.col("treeID").cast("long").alias("id"), "n").unionByName(same)


def tree_shap(spark, folder):
    """Shapley values of a forest for every part; they add up to its output."""
    rows, model = _forest(spark, folder)
    ensemble = X.tree_ensemble(model, spark)
    values = X.tree_shap_values(rows, ensemble)
    total = F.aggregate("phi", F.lit(float(ensemble.base[0])), lambda a, v: a + v)
    return model.transform(rows).join(values, "row_id").select(
        "row_id", F.round("prediction", 6).alias("prediction"), F.round(total, 6).alias("base_plus_shap"))


def tree_shap_adds_up(spark, folder):
    """Whether base value and Shapley values of each part add up to the forest's prediction."""
    return tree_shap(spark, folder).select(
        "row_id", (F.abs(F.col("prediction") - F.col("base_plus_shap")) < 1e-5).alias("adds_up"))


def tree_shap_ranking(spark, folder):
    rows, model = _forest(spark, folder)
    return X.shap_ranking(model, rows, ["key_k", "size"])


def native_importance(spark, folder):
    _, model = _forest(spark, folder)
    return X.native_importance(model, ["key_k", "size"], spark)


# --- scoring -------------------------------------------------------------------------

def _blanked_docs(spark, folder):
    """Documents as rows to score: some cells blank, unreadable or unseen."""
    odd = F.try_divide(F.length(F.regexp_replace("text", "[A-Za-z ]", "")), F.length("text"))     # null for an empty text
    kind = F.col("doc_id") % 5
    return T.table(spark, folder, "documents").select(
        "doc_id",
        F.when(kind == 0, "").when(kind == 1, "null").when(kind == 2, "many")
        .otherwise(F.col("n_chars").cast("string")).alias("n_chars"),
        F.when(kind == 3, F.lit(None)).otherwise(odd).alias("odd_share"),
        F.when(kind == 1, "").when(kind == 4, "src100").otherwise(F.col("source")).alias("source"))


def _doc_preparation(spark, folder):
    return R.fit_preparation(T.doc_quality(spark, folder), "quality", rules.CLASSIFICATION, ["doc_id"])


def score_fill_defaults(spark, folder):
    filled = S.fill_missing_inputs(_blanked_docs(spark, folder), _doc_preparation(spark, folder))
    return filled.select("doc_id", "n_chars", F.round("odd_share", 6).alias("odd_share"), "lang", "source")


def score_encode_unseen(spark, folder):
    preparation = _doc_preparation(spark, folder)
    filled = S.fill_missing_inputs(_blanked_docs(spark, folder), preparation)
    kept = S.encode_inputs(filled, preparation).select("doc_id", F.col("source").cast("long").alias("code_keep"))
    inserted = S.encode_inputs(filled, preparation, "insert").select(
        "doc_id", F.col("source").cast("long").alias("code_insert"))
    return kept.join(inserted, "doc_id")


def score_refit(spark, folder):
    """Every document prepared as if it were one more row of the labelled documents, which have missing cells."""
    train = T.doc_gaps(spark, folder)
    preparation = R.with_growth(train, R.fit_preparation(train, "quality", rules.CLASSIFICATION, ["doc_id"]))
    filled = S.fill_missing_inputs(_blanked_docs(spark, folder), preparation)
    prepared = S.encode_inputs(filled, preparation, "refit")
    return S.align_features(prepared, ["n_chars", "odd_share", "lang", "source"], ["doc_id"]).select(
        "doc_id", F.round("n_chars", 6).alias("n_chars"), F.round("odd_share", 6).alias("odd_share"), "lang", "source")


def softmax_roles(spark, folder):
    """Whether the class probabilities of boosted trees for every turn's role add up to 1, and the guess is the likeliest."""
    prepared, codes = prepared_rows(
        T.turn_roles(spark, folder), R.fit_preparation(T.turn_roles(spark, folder), "role", rules.CLASSIFICATION, ["turn_id"]), "turn_id")
    rows = VectorAssembler(inputCols=["turn", "n_chars"], outputCol="features").transform(prepared)
    boosted = next(c for c in candidates(rules.CLASSIFICATION, PROFILES["full"]) if c.name == rules.BOOSTING)
    model = boosted.estimator(TrainingFacts(0, 0.0, codes.count())).fit(rows)
    shares = vector_to_array("probability")
    scored = model.transform(rows)
    total = F.aggregate(shares, F.lit(0.0), lambda a, v: a + v)
    return scored.select(
        F.col("row_id").alias("turn_id"), F.size(shares).alias("classes"), (F.abs(total - 1) < 1e-9).alias("adds_up"),
        (F.get(shares, F.col("prediction").cast("int")) == F.array_max(shares)).alias("likeliest"))


def score_align(spark, folder):
    return S.align_features(T.part_price(spark, folder), ["p_size", "not_there"], ["p_partkey"])


def _doc_shares(spark, folder):
    docs = R.label_encode(T.doc_quality(spark, folder), ["lang"])
    found = knn_predict(docs, docs, ["n_chars", "lang"], "doc_id", "quality", True)
    return S.probability_columns(
        found.withColumn("_p", class_shares(F.col("near"), 2)), F.col("_p"), ["0", "1"], ["poor", "good"])


def class_probabilities_knn(spark, folder):
    return _doc_shares(spark, folder).select(
        F.col("row_id").alias("doc_id"), "confidence", "confidence_band",
        F.element_at("class_probabilities", "0").alias("p0"), F.element_at("class_probabilities", "1").alias("p1"),
        S.decode_label(F.col("prediction"), ["poor", "good"]).alias("prediction_label"))


def sorted_probabilities(spark, folder):
    return S.sorted_probabilities(_doc_shares(spark, folder), "row_id")


def score_many_classes(spark, folder):
    """Which customer's order costs like this one: a class per customer, codes and labels as tables throughout."""
    orders = T.table(spark, folder, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("string").alias("customer"))
    coded, codes = R.encode_target(orders, "customer", "code")
    found = knn_predict(coded, coded, ["o_totalprice"], "o_orderkey", "code", True)
    rows = found.select("row_id", "prediction", S.near_entries(F.col("near")).alias("entries"))
    scored = S.sparse_probabilities(rows, "row_id", codes, codes.count())
    return scored.select(
        F.col("row_id").alias("o_orderkey"), F.col("prediction").cast("long").alias("code"), "prediction_label", "confidence",
        "confidence_band", F.size("class_probabilities").alias("classes"),
        F.element_at("class_probabilities_labeled", F.col("prediction_label")).alias("probability"))


def score_every_model(spark, folder):
    """All five regressors fitted to the parts, saved, loaded again and applied to every part.

    Ridge predictions are given; of the others, whether the loaded model says what the fitted one does.
    """
    parts = T.part_price(spark, folder)
    preparation = R.fit_preparation(parts, "p_retailprice", rules.REGRESSION, ["p_partkey"])
    chosen = ["p_size"]
    prepared, _ = prepared_rows(parts, preparation, "p_partkey")
    n_rows = prepared.count()
    table = training_table(kfold(prepared, "row_id"), chosen, rules.REGRESSION, n_rows)
    models = {c.name: refit(table, c) for c in candidates(rules.REGRESSION, PROFILES["full"])}
    run = S.ModelRun(S.Scorer(rules.RIDGE, rules.REGRESSION, preparation, chosen, [], models[rules.RIDGE]), models,
                     prepared.select("row_id", "label", *chosen))
    path = new_path(spark, "run")
    save_run(run, spark, path)
    fresh, loaded = (r.score_all(parts, "p_partkey") for r in (run, load_run(spark, path)))
    both = loaded.join(fresh.withColumnRenamed("prediction", "before"), ["p_partkey", "model_name"])
    ridge_value = F.when(F.col("model_name") == rules.RIDGE, F.round("prediction", 5))
    return both.select("p_partkey", "model_name", ridge_value.alias("ridge"), (F.col("prediction") == F.col("before")).alias("same"))


def score_linear(spark, folder):
    """Parts scored with the ridge model in one projection."""
    rows = _price_vectors(spark, folder)
    return _price_ridge(rows).transform(rows).select(
        F.col("row_id").alias("p_partkey"), F.round("prediction", 5).alias("prediction"))


def overfit_bands(spark, folder):
    return T.supplier_class_metrics(spark, folder).select(
        "l_suppkey", "model_name", S.overfit_band(F.col("overfit_gap")).alias("band"))


# --- whole analyses --------------------------------------------------------------------

def _analysis_leaderboard(a: Analysis) -> DataFrame:
    """Leaderboard without wall-clock values."""
    return a.judged.select("model_name", "verdict", "test_accuracy" if a.problem_type == rules.CLASSIFICATION
                           else "test_r2", "overfit_gap", "composite_score", "rank")


def doc_analysis(spark, folder, profile="full") -> Analysis:
    return analyze(T.doc_quality(spark, folder), "quality", key="doc_id", profile=profile)


def price_analysis(spark, folder, profile="full") -> Analysis:
    return analyze(T.part_price(spark, folder), "p_retailprice", PRICE_FEATURES, "p_partkey", profile)


def role_analysis(spark, folder, profile="full") -> Analysis:
    return analyze(T.turn_roles(spark, folder), "role", key="turn_id", profile=profile)


def analyze_classification(spark, folder):
    return _analysis_leaderboard(doc_analysis(spark, folder))


def analyze_regression(spark, folder):
    return _analysis_leaderboard(price_analysis(spark, folder))


def analyze_multiclass(spark, folder):
    return _analysis_leaderboard(role_analysis(spark, folder))


def analyze_report(spark, folder):
    """Importance table of the report of a whole analysis."""
    return report.importance_table(doc_analysis(spark, folder))


def analyze_and_score(spark, folder):
    """Train on labelled documents, then score every document."""
    scored = doc_analysis(spark, folder).scorer.score(_blanked_docs(spark, folder), "doc_id")
    return scored.select("doc_id", "prediction_label", F.round("confidence", 4).alias("confidence"), "confidence_band")


QUERIES: dict[str, Query] = {
    "csv_roundtrip": csv_roundtrip,
    "csv_line_breaks": csv_line_breaks,
    "json_columns": json_columns,
    "json_roundtrip": json_roundtrip,
    "dataset_profile": dataset_profile,
    "preview_rows": preview_rows,
    "dataset_info": dataset_info,
    "drop_null_target": drop_null_target,
    "select_features": select_features,
    "separate_target": separate_target,
    "target_profile": target_profile,
    "target_sample_values": target_sample_values,
    "first_in_file_order": first_in_file_order,
    "detect_binary_numeric": _detect(T.doc_quality, "quality"),
    "detect_string": _detect(_lineitem, "l_returnflag"),
    "detect_lowcard": _detect(_lineitem, "l_linenumber"),
    "detect_regression": _detect(T.part_price, "p_retailprice"),
    "class_distribution": class_distribution,
    "target_stats": target_stats,
    "missing_ratio": missing_ratio,
    "drop_high_missing": drop_high_missing,
    "cardinality_filter": cardinality_filter,
    "impute_median": impute_median,
    "exact_medians": exact_medians,
    "label_encode": label_encode,
    "encode_target": encode_target,
    "encode_numeric_target": encode_numeric_target,
    "encode_wide_target": encode_wide_target,
    "cast_target": cast_target,
    "standard_scale": standard_scale,
    "prepared_features": prepared_features,
    "preparation_params": preparation_params,
    "low_variance": low_variance,
    "correlation_matrix": correlation_matrix,
    "correlation_matrix_wide": correlation_matrix_wide,
    "correlation_prune": correlation_prune,
    "feature_report": feature_report,
    "mi_binned_classification": mi_binned_classification,
    "mi_binned_regression": mi_binned_regression,
    "mi_neighbour_classification": mi_neighbour_classification,
    "mi_neighbour_regression": mi_neighbour_regression,
    "feature_ranking": feature_ranking,
    "stratified_folds": stratified,
    "kfold": kfolds,
    "ridge_coefficients": ridge_coefficients,
    "ridge_folds": ridge_folds,
    "logistic_coefficients": logistic_coefficients,
    "knn_classify": knn_classify,
    "knn_regress": knn_regress,
    "cv_metrics_knn": cv_metrics_knn,
    "macro_f1": macro_f1,
    "regression_metrics": regression_metrics,
    "class_metrics_summary": class_metrics_summary,
    "disqualified": disqualified,
    "verdict_classification": verdict_classification,
    "verdict_regression": verdict_regression,
    "verdict_winners": verdict_winners,
    "verdict_no_winner": verdict_no_winner,
    "dimension_scores_classification": dimension_scores_classification,
    "dimension_scores_regression": dimension_scores_regression,
    "rationales": rationales,
    "linear_shap": linear_shap,
    "coefficient_importance": coefficient_importance,
    "importance_view": importance_view,
    "deep_forest": deep_forest,
    "tree_shap": tree_shap,
    "tree_shap_adds_up": tree_shap_adds_up,
    "tree_shap_ranking": tree_shap_ranking,
    "native_importance": native_importance,
    "score_fill_defaults": score_fill_defaults,
    "score_encode_unseen": score_encode_unseen,
    "score_refit": score_refit,
    "score_align": score_align,
    "softmax_roles": softmax_roles,
    "score_linear": score_linear,
    "class_probabilities_knn": class_probabilities_knn,
    "score_many_classes": score_many_classes,
    "score_every_model": score_every_model,
    "sorted_probabilities": sorted_probabilities,
    "overfit_bands": overfit_bands,
    "analyze_classification": analyze_classification,
    "analyze_regression": analyze_regression,
    "analyze_multiclass": analyze_multiclass,
    "analyze_report": analyze_report,
    "analyze_and_score": analyze_and_score,
}
