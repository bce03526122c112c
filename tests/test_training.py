import math
import random
import statistics

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from ebbline.operators import certify, evaluate, preprocess, ranks, train
from ebbline.operators.features import build_features
from ebbline.operators.labels import numbered_labels
from ebbline.operators.scoring import predict
from ebbline.operators.split import held_out_counts, stratified_split
from ebbline.schemas import CATEGORICAL_COLUMNS, FEATURE_COLUMNS, LABEL, NUMERIC_COLUMNS
from ebbline.session import scratch_dir


@pytest.fixture(scope="module")
def features(telco):
    return build_features(telco).persist()


@pytest.mark.parametrize("bins", [4, 1024])
def test_order_statistics_against_sorting(spark, monkeypatch, bins):
    monkeypatch.setattr(ranks, "BINS", bins)
    source = random.Random(7)
    columns = {
        "even": [source.gauss(0, 1) for _ in range(400)],
        "skewed": [math.exp(source.gauss(0, 6)) for _ in range(400)],
        "hot": [5.0 if i % 3 == 0 else source.uniform(0, 10) for i in range(400)],
        "flag": [float(i % 2) for i in range(400)],
        "same": [2.5] * 400,
        "sparse": [source.random() if i % 4 == 0 else None for i in range(400)],
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns))
    wanted = [1, 2, 50, 99, 100]
    found = ranks.order_statistics(df, list(columns), lambda counts: {c: wanted for c in counts})
    for name, values in columns.items():
        ordered = sorted(v for v in values if v is not None)
        assert found[name] == [ordered[k - 1] for k in wanted], name
    middle = ranks.medians(df, list(columns))
    assert middle == {c: statistics.median(v for v in values if v is not None) for c, values in columns.items()}


def test_medians_of_odd_columns(spark):
    df = spark.createDataFrame([(None, 1.0, math.nan), (None, 3.0, 7.0)], "a double, b double, c double")
    assert ranks.medians(df, ["a", "b", "c"]) == {"a": None, "b": 2.0, "c": 7.0}
    with pytest.raises(ValueError, match="Infinite values"):
        ranks.medians(df.withColumn("b", F.when(F.col("b") > 2, math.inf).otherwise(F.col("b"))), ["b"])


@pytest.mark.parametrize("sizes", [{0: 5, 1: 5}, {0: 7, 1: 4}, {0: 100, 1: 3}, {0: 5174, 1: 1869}, {0: 1, 1: 0}])
def test_held_out_counts(sizes):
    counts = held_out_counts(sizes, 0.2)
    rows = sum(sizes.values())
    assert sum(counts.values()) == math.ceil(0.2 * rows)
    assert all(abs(counts[c] - 0.2 * n) < 1 + 1e-9 and 0 <= counts[c] <= n for c, n in sizes.items())


def test_split_is_exact_and_stable(features):
    split = stratified_split(features)
    counts = {(r[LABEL], r["split"]): r["count"] for r in split.groupBy(LABEL, "split").count().collect()}
    sizes = {c: counts[c, "train"] + counts[c, "test"] for c in (0, 1)}
    assert {c: counts[c, "test"] for c in (0, 1)} == held_out_counts(sizes, 0.2)
    keys = split.select("customerID", "split")
    assert stratified_split(features.repartition(6)).select("customerID", "split").exceptAll(keys).isEmpty()
    other = stratified_split(features, seed=7).select("customerID", "split")
    assert not other.exceptAll(keys).isEmpty()


def test_numeric_stats_against_numpy(features):
    rows = features.select(NUMERIC_COLUMNS).collect()
    for name, stats in preprocess.numeric_stats(features).items():
        column = np.array([r[name] for r in rows], dtype=float)
        assert stats.median == np.median(column)
        assert stats.mean == pytest.approx(column.mean())
        assert stats.std == pytest.approx(column.std())


def test_preprocessing(spark, features):
    model = preprocess.fit_preprocessor(features)
    labels = [sorted(r[0] for r in features.select(c).distinct().collect()) for c in CATEGORICAL_COLUMNS]
    stats = preprocess.numeric_stats(features)
    row = features.limit(1)
    vector = model.transform(row).first()["features"].toArray()
    record = row.first()
    expected = [(record[c] - stats[c].mean) / (stats[c].std or 1.0) for c in NUMERIC_COLUMNS]
    for c, known in zip(CATEGORICAL_COLUMNS, labels):
        expected += [float(record[c] == label) for label in known]
    assert vector == pytest.approx(expected)


def test_missing_and_unseen_values(features):
    model = preprocess.fit_preprocessor(features)
    mode = {r["column_name"]: r["mode_value"] for r in preprocess.modes(preprocess.level_counts(features)).collect()}
    row = features.limit(1)
    changed = row.withColumns(
        {"Contract": F.lit(None).cast("string"), "gender": F.lit("it's \\ new"), "tenure": F.lit(None).cast("bigint")}
    )
    imputed = row.withColumns(
        {"Contract": F.lit(mode["Contract"]), "tenure": F.lit(preprocess.medians(features, ["tenure"])["tenure"])}
    )
    got, base = model.transform(changed).first()["features"].toArray(), model.transform(imputed).first()["features"].toArray()
    first_label = len(NUMERIC_COLUMNS)
    genders = features.select("gender").distinct().count()
    assert got[first_label : first_label + genders].tolist() == [0.0] * genders
    assert got[:first_label].tolist() == base[:first_label].tolist()
    assert got[first_label + genders :].tolist() == base[first_label + genders :].tolist()


def test_labels_with_quotes_are_learned(features):
    odd = features.withColumn("gender", F.lit("it's \\ 'odd'"))
    vector = preprocess.fit_preprocessor(odd).transform(odd.withColumn("gender", F.lit(None).cast("string"))).first()["features"]
    assert vector.toArray()[len(NUMERIC_COLUMNS)] == 1.0


def test_a_column_of_many_labels(spark, features, monkeypatch):
    """Each record has a label of its own: as many positions as records, in order, and none collected."""
    rows = 30_000
    many = (
        spark.range(rows)
        .crossJoin(features.limit(1).drop("PaymentMethod"))
        .withColumn("PaymentMethod", F.concat(F.lit("é"), F.lpad((F.col("id") * 7919 % rows).cast("string"), 6, "0")))
        .repartition(5)
    )
    model = preprocess.fit_preprocessor(many)
    indexer = model.stages[1]
    found = indexer.labels("PaymentMethod").collect()
    assert {r["value"]: r["place"] for r in found} == {f"é{i:06d}": i for i in range(rows)}
    assert indexer.labels("Contract").count() == 1
    hot = model.transform(many.where("id < 50")).select("PaymentMethod", "features").collect()
    ahead = len(NUMERIC_COLUMNS) + sum(1 for c in CATEGORICAL_COLUMNS[: CATEGORICAL_COLUMNS.index("PaymentMethod")])
    for r in hot:
        assert r["features"][ahead + int(r["PaymentMethod"][1:])] == 1.0
        assert r["features"].size == len(NUMERIC_COLUMNS) + len(CATEGORICAL_COLUMNS) - 1 + rows


def test_label_numbers_follow_the_sort_across_parts(spark):
    own = random.Random(11)
    labels = {c: {"".join(own.choice("aB é'/=%") for _ in range(own.randint(0, 6))) for _ in range(n)} for c, n in (("x", 3000), ("y", 1), ("z", 400))}
    rows = [(c, v) for c, values in labels.items() for v in values]
    own.shuffle(rows)
    levels = spark.createDataFrame(rows, "column_name string, value string").repartition(7)
    table = numbered_labels(levels, scratch_dir(spark, "test-labels"))
    for c, values in labels.items():
        got = {r["value"]: r["place"] for r in table.where(F.col("column_name") == c).collect()}
        assert got == {v: i for i, v in enumerate(sorted(values, key=str.encode))}


def test_modes_take_the_smallest_on_ties(features):
    tied = features.withColumn("gender", F.lit(None).cast("string")).limit(4)
    tied = tied.withColumn("gender", F.when(F.hash("customerID").isNotNull(), F.lit("z")))
    counted = preprocess.level_counts(tied.unionByName(tied.withColumn("gender", F.lit("b"))))
    mode = preprocess.modes(counted).where("column_name = 'gender'").first()["mode_value"]
    assert mode == "b"


def test_class_weights(features):
    sizes = {r[LABEL]: r["count"] for r in features.groupBy(LABEL).count().collect()}
    rows = sum(sizes.values())
    got = {r[LABEL]: r["class_weight"] for r in train.class_weights(features).collect()}
    assert got == pytest.approx({c: rows / (2 * n) for c, n in sizes.items()})
    total = train.with_class_weights(features).agg(F.sum("class_weight")).first()[0]
    assert total == pytest.approx(rows)


def brute_auc(pairs):
    wins = [(1.0 if p > q else 0.5 if p == q else 0.0) for y, p in pairs if y for z, q in pairs if not z]
    return sum(wins) / len(wins)


def test_auc_against_all_pairs(spark):
    source = random.Random(3)
    pairs = [(source.randint(0, 1), round(source.random(), 2)) for _ in range(300)]
    df = spark.createDataFrame([(y, p, i % 2) for i, (y, p) in enumerate(pairs)], "churn_flag bigint, churn_probability double, g int")
    assert evaluate.auc(df) == pytest.approx(brute_auc(pairs))
    for g in (0, 1):
        assert evaluate.auc(df.where(F.col("g") == g)) == pytest.approx(brute_auc(pairs[g::2]))


def test_threshold_metrics(spark):
    rows = [(1, 0.5), (1, 0.49), (0, 0.5), (0, 0.1), (1, 0.9)]
    df = spark.createDataFrame(rows, "churn_flag bigint, churn_probability double")
    assert tuple(evaluate.threshold_metrics(df).first()) == pytest.approx((2 / 3, 2 / 3, 2 / 3))
    none = evaluate.threshold_metrics(df.where("churn_probability < 0.4")).first()
    assert tuple(none) == (0.0, 0.0, 0.0)


def newton_logistic(x, y, w):
    """Weighted logistic regression with an L2 penalty of one half |b|^2."""
    x1 = np.column_stack([x, np.ones(len(x))])
    beta, penalty = np.zeros(x1.shape[1]), np.diag([1.0] * x.shape[1] + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x1 @ beta))
        gradient = x1.T @ (w * (p - y)) + penalty @ beta
        hessian = x1.T @ (x1 * (w * p * (1 - p))[:, None]) + penalty
        beta = beta - np.linalg.solve(hessian, gradient)
    return 1 / (1 + np.exp(-x1 @ beta))


def test_logistic_regression_against_newton(features):
    preprocessor = preprocess.fit_preprocessor(features)
    prepared = train.with_class_weights(preprocessor.transform(features)).select("features", LABEL, "class_weight").persist()
    rows = prepared.collect()
    x = np.array([r["features"].toArray() for r in rows])
    y, w = np.array([r[LABEL] for r in rows]), np.array([r["class_weight"] for r in rows])
    model = train.logistic_regression(len(rows)).setTol(1e-9).fit(prepared)
    got = np.array([r["probability"][1] for r in model.transform(prepared).select("probability").collect()])
    assert got == pytest.approx(newton_logistic(x, y, w), abs=2e-4)


def test_training_saving_and_loading(spark, features, tmp_path):
    trained = train.train_models(features, trees=10)
    table = train.model_selection(trained).collect()
    assert [r["auc"] for r in table] == sorted((r["auc"] for r in table), reverse=True)
    assert [r["selected"] for r in table] == [True, False] and table[0]["model_type"] == trained.selected
    assert all(0.0 <= r[m] <= 1.0 for r in table for m in ("auc", "precision", "recall", "f1"))

    model_path, metrics_path = str(tmp_path / "model"), str(tmp_path / "metrics")
    train.save_model(trained, model_path, metrics_path)
    train.save_model(trained, model_path, metrics_path)
    scored = predict(features, trained.model)
    assert scored.columns == [*FEATURE_COLUMNS, "churn_probability"]
    assert scored.where(~F.col("churn_probability").between(0, 1)).isEmpty()
    loaded = predict(features, train.load_model(model_path))
    assert loaded.select("customerID", "churn_probability").exceptAll(scored.select("customerID", "churn_probability")).isEmpty()

    report = spark.read.json(metrics_path).first().asDict(recursive=True)
    by_name = {r["model_type"]: r for r in table}
    assert set(report) == {"logistic_regression", "random_forest", "selected_model"}
    assert report["selected_model"] == {"name": trained.selected, "auc": table[0]["auc"]}
    for name in by_name:
        assert report[name] == {m: by_name[name][m] for m in ("auc", "precision", "recall", "f1")}

    entry = train.registry_row(spark, metrics_path, model_path).first()
    assert entry["model_type"] == trained.selected and entry["auc_score"] == table[0]["auc"]
    assert entry["model_version"] == entry["registered_at"].strftime("v%Y%m%d_%H%M%S")
    assert entry["model_name"] == "subscriber_risk"


def test_first_candidate_wins_ties(features, monkeypatch):
    monkeypatch.setattr(train, "auc", lambda df: 0.5)
    assert train.train_models(features, trees=2).selected == "logistic_regression"


def test_fits_and_ratings_run_in_no_more_tasks_than_cores(features, monkeypatch):
    seen = {}

    class Watched:
        def __init__(self, own):
            self.own = own

        def fit(self, prepared):
            seen["fit"] = prepared.rdd.getNumPartitions()
            return self.own.fit(prepared)

    own = train.candidates
    monkeypatch.setattr(train, "candidates", lambda *x: {name: Watched(e) for name, e in own(*x).items()})
    rate = train.predict
    monkeypatch.setattr(train, "predict", lambda test, model: seen.update(rated=test.rdd.getNumPartitions()) or rate(test, model))
    rows = features.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(40)))).drop("copy").repartition(64).persist()
    found = train.train_models(rows, names=("logistic_regression",))
    cores = features.sparkSession.sparkContext.defaultParallelism
    assert 1 <= seen["fit"] <= cores and 1 <= seen["rated"] <= cores and found.metrics.first()["auc"] > 0.5
    rows.unpersist()


def test_few_rows_get_few_tasks_and_many_get_more(features):
    cores = features.sparkSession.sparkContext.defaultParallelism
    assert [train._tasks(features, n) for n in (0, 1, train.ROWS_PER_TASK + 1)] == [1, 1, 2]
    assert train._tasks(features, 10**5) == cores
    assert train._tasks(features, 10**8) == 10**8 // train.ROWS_AT_MOST


def test_forest_keeps_the_reached_nodes_and_is_the_same(features):
    own = train.random_forest(trees=7, depth=6)
    assert own.getCacheNodeIds()
    prepared = train.training_rows(features, preprocess.fit_preprocessor(features)).repartition(3).persist()
    kept, walked = own.fit(prepared), own.copy().setCacheNodeIds(False).fit(prepared)
    assert kept.totalNumNodes == walked.totalNumNodes > 7
    found = [[r["probability"][1] for r in m.transform(prepared).select("probability").collect()] for m in (kept, walked)]
    assert found[0] == pytest.approx(found[1], abs=1e-9)
    prepared.unpersist()


def test_weights_are_counted_before_the_labels_are_joined(features):
    class Watched:
        def transform(self, rows):
            assert {r["class_weight"] for r in rows.collect()} == {r["class_weight"] for r in train.class_weights(features).collect()}
            return rows.withColumn("features", F.lit(0))

    assert train.training_rows(features, Watched()).count() == features.count()


def test_few_levels_are_read_in_one_task(features, monkeypatch):
    seen, own = [], preprocess.numbered_labels
    monkeypatch.setattr(preprocess, "numbered_labels", lambda levels, path: seen.append(levels.rdd.getNumPartitions()) or own(levels, path))
    shuffled = features.sparkSession.conf.get("spark.sql.shuffle.partitions")
    features.sparkSession.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        preprocess.fit_preprocessor(features)
    finally:
        features.sparkSession.conf.set("spark.sql.shuffle.partitions", shuffled)
    assert 1 <= seen[0] <= 4


def test_depths_are_found_by_doubling(spark, monkeypatch):
    written, own = [], certify.scratch_dir
    monkeypatch.setattr(certify, "scratch_dir", lambda *x: written.append(x) or own(*x))
    schema = "tree int, node int, above int, far bigint"
    chain = [(0, i + 1, i, 1) for i in range(10)]
    odd = [(1, 1, 0, 1), (1, 2, 0, 1), (1, 8, 7, 1), (1, 9, 8, 1), (1, 10, 9, 1)]  # the last three are below no root
    assert certify._depth(spark.createDataFrame(chain + odd, schema), 17) == 10
    assert len(written) <= 5
    assert certify._depth(spark.createDataFrame([], schema), 3) == 0
    round_about = [(0, 5, 6, 1), (0, 6, 5, 1), (0, 1, 0, 1)]
    assert certify._depth(spark.createDataFrame(round_about, schema), 4) == 1


def test_columns_that_cannot_be_learned(features):
    with pytest.raises(ValueError, match="No values to learn from"):
        preprocess.fit_preprocessor(features.withColumn("tenure", F.lit(None).cast("bigint")))
    with pytest.raises(ValueError, match="Not usable as categories"):
        preprocess.fit_preprocessor(features.withColumn("gender", F.lit(None).cast("string")))


class TestCertificates:
    def test_gradient_vanishes_at_the_optimum_only(self, spark):
        own = np.random.default_rng(5)
        x = own.normal(size=(300, 3))
        y = (own.random(300) < 1 / (1 + np.exp(-x @ [1.0, -2.0, 0.5]))).astype(int)
        weighted = [(Vectors.dense(v), int(t), 2.0 if t else 0.5) for v, t in zip(x, y)]
        rows = spark.createDataFrame(weighted, ["features", "churn_flag", "class_weight"])
        fitted = train.logistic_regression(300).fit(rows)
        early = train.logistic_regression(300).setMaxIter(2).fit(rows)
        at_end, before = certify.logistic_gradient(rows, fitted), certify.logistic_gradient(rows, early)
        assert at_end.rows == 300 and at_end.largest < 1e-5 and at_end.intercept < 1e-5 and at_end.gap < 1e-6
        assert before.largest > 1e-3 and before.gap > at_end.gap

        w = np.where(y, 2.0, 0.5)
        p = 1 / (1 + np.exp(-(x @ early.coefficients.toArray() + early.intercept)))
        slope = (w * (p - y)) @ x / w.sum() + early.coefficients.toArray() / 300
        assert before.largest == pytest.approx(np.abs(slope).max()) and before.gap == pytest.approx(slope @ slope * 150)

    def test_forest_shape_is_what_the_trees_say(self, spark, telco, tmp_path):
        model = train.train_models(build_features(telco), trees=7, depth=4, names=("random_forest",)).model
        model.write().save(str(tmp_path / "model"))
        nodes = certify.forest_nodes(spark, str(tmp_path / "model"))
        shape, forest = certify.forest_shape(nodes), model.stages[-1]
        assert (shape.trees, shape.depth) == (7, max(t.depth for t in forest.trees))
        assert nodes.count() == forest.totalNumNodes and shape.uneven_nodes == 0
        assert shape.smallest_leaf >= 5 and 0 <= shape.largest_feature < forest.numFeatures
        broken = nodes.withColumn("rows", F.when(F.col("node") == 0, F.col("rows") + 1).otherwise(F.col("rows")))
        assert certify.forest_shape(broken).uneven_nodes == 7
