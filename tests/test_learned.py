"""Imputation, quantile forest, artefacts and the scoring job."""

import datetime as dt
import json
import math
import random
from multiprocessing.pool import ThreadPool

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from resaleworth import config, session
from resaleworth.operators.forest import QuantileForest, QuantileForestModel
from resaleworth.operators.impute import ChainedForestImputer, ChainedForestImputerModel, ChainState
from resaleworth.operators import selection
from resaleworth.operators.calibrate import widened, widening, with_calibration
from resaleworth.operators.ranking import ranks_in_groups
from resaleworth.operators.selection import Candidate, default_candidates
from resaleworth.plans import scoring as scoring_plan
from resaleworth.plans.model_choice import choose_and_train, choose_model
from resaleworth.plans.scoring import in_request_order, score_requests
from resaleworth.plans.training import ROW_KEYS, ImputationSettings, TrainingSettings, load_run, run_digest, run_training
from resaleworth.queries.frames import SMALL_IMPUTATION, tables, trained
from resaleworth.sources import artefacts
from resaleworth.sources.inflation import inflation_factors
from resaleworth.sources.requests import accepted, parse_requests
from resaleworth.streaming import scoring as scoring_stream

SF_DIR = "/root/testdata/sf0.001"
AS_OF = dt.date(2024, 9, 1)
SEVEN = (
    '[{"bike_id":1,"template_id":9,"msrp":2499,"frame_material_code":"carbon"},'
    '{"bike_id":2,"template_id":9,"msrp":5499,"family_model_id":8258},'
    '{"bike_id":2,"template_id":9,"msrp":0,"family_model_id":8258},'
    '{"bike_id":2,"template_id":9,"msrp":null,"family_model_id":8258},'
    '{"bike_id":2,"template_id":9,"family_model_id":8258},'
    '{"bike_id":3,"condition_code":3,"msrp":4299.0,"bike_created_at_month":9,"bike_created_at_year":2024,"bike_year":2023},'
    '{"bike_id":4,"condition_code":"3","msrp":"3299","shifting_code":"mechanical","is_mobile":0,"bike_year":2021}]'
)


def payloads(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "payload_id bigint, value string")


@pytest.fixture(scope="module")
def gaps(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        a = rng.random() * 10
        b, c = 2 * a + rng.random(), rng.choice("xyz")
        d = {"x": 1, "y": 2, "z": 3}[c]
        hole = lambda v: None if rng.random() < 0.2 else v
        rows.append((i, hole(a), hole(b), None if i % 2 else 5.0, hole(c), hole(d)))
    return spark.createDataFrame(rows, "id int, a double, b double, empty double, c string, d bigint").withColumn(
        "empty", F.lit(None).cast("double")
    )


@pytest.fixture(scope="module")
def imputer(gaps):
    return ChainedForestImputer(
        numericalCols=["a", "b", "empty"], categoricalCols=["c", "d"], rounds=2, numTrees=5, maxDepth=4
    ).fit(gaps)


def test_imputation_fills_gaps_and_keeps_cells(gaps, imputer):
    filled = {r["id"]: r for r in imputer.transform(gaps).collect()}
    assert len(filled) == 400
    for row in gaps.collect():
        after = filled[row["id"]]
        for name in ("a", "b", "c", "d"):
            assert after[name] is not None
            if row[name] is not None:
                assert after[name] == row[name]
        assert after["c"] in "xyz" and after["d"] in (1, 2, 3)
        if row["a"] is None and row["b"] is not None:
            assert abs(after["a"] - row["b"] / 2) < 3
        if row["c"] is None and row["d"] is not None:
            assert after["c"] == "xyz"[row["d"] - 1]


def test_imputation_of_unseen_categories(spark, gaps, imputer):
    row = spark.createDataFrame([(1, 1.0, None, None, "new", 1)], gaps.schema)
    assert imputer.transform(row).first()["c"] == "x"


def test_imputer_survives_saving(gaps, imputer, tmp_path):
    imputer.write().save(f"{tmp_path}/imputer")
    again = ChainedForestImputerModel.load(f"{tmp_path}/imputer")
    assert again.transform(gaps).orderBy("id").collect() == imputer.transform(gaps).orderBy("id").collect()


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(2)
    rows = [(i, float(i % 50), (i % 50) * 10 + rng.random() * 5) for i in range(1000)]
    df = spark.createDataFrame(rows, "id bigint, x double, sales_price double")
    return VectorAssembler(inputCols=["x"], outputCol="features").transform(df)


@pytest.fixture(scope="module")
def forest(points):
    return QuantileForest(numTrees=7, maxDepth=5, quantiles=[0.1, 0.5, 0.9]).fit(points)


def test_quantiles_are_ordered_and_near(points, forest):
    for row in forest.transform(points).collect():
        low, mid, high = row["quantile_values"]
        assert low <= mid <= high and mid == row["prediction"]
        assert abs(mid - row["sales_price"]) < 40


def test_leaf_table_holds_labels_of_its_leaf(points, forest):
    labels = {r["sales_price"] for r in points.collect()}
    rows = forest.leaves.collect()
    assert {r["y"] for r in rows} <= labels
    per_tree = forest.leaves.groupBy("tree").agg(F.sum("samples").alias("n")).collect()
    assert [r["n"] for r in per_tree] == [1000] * 7


def test_lookup_and_join_agree_whatever_the_keys(points, forest):
    """Rows of one key and rows without a key stay apart and keep their own quantiles."""
    odd = points.where("id in (3, 40)").withColumn("id", F.lit(3).cast("bigint"))
    rows = points.unionByName(odd).unionByName(odd.withColumn("id", F.lit(None).cast("bigint")))
    values = lambda df: sorted((repr(r["id"]), r["x"], *r["quantile_values"]) for r in df.collect())
    salted = forest.copy()
    salted._set(salts=3)
    joined = values(salted.predict_by_join(rows))
    assert joined == values(forest.predict_by_lookup(rows)) and len(joined) == rows.count()


def test_a_depth_that_trees_cannot_have_is_refused(points):
    with pytest.raises(ValueError, match="maxDepth"):
        QuantileForest(maxDepth=40).fit(points)


def test_leaves_do_not_grow_with_the_rows(points):
    few = QuantileForest(numTrees=2, maxDepth=20, minLeafShare=0.05)
    twice = points.unionByName(points.withColumn("id", F.col("id") + 5000).withColumn("sales_price", F.col("sales_price") + F.rand(1)))
    for rows in (points, twice):
        assert few.fit(rows).leaf_count <= 2 * 20


def test_lookup_moves_no_rows(points, forest):
    plan = forest.predict_by_lookup(points)._jdf.queryExecution().executedPlan().toString()
    outer = plan.split("Subquery")[0]
    assert "Exchange" not in outer and "_table" not in outer.split("\n")[0]


def test_forest_survives_saving_and_repartitioning(points, forest, tmp_path):
    forest.write().save(f"{tmp_path}/forest")
    again = QuantileForestModel.load(f"{tmp_path}/forest")
    predict = lambda model, df: [r["prediction"] for r in model.transform(df).orderBy("id").collect()]
    assert predict(again, points.repartition(9)) == predict(forest, points)


def test_payload_states(spark):
    texts = ['{"bike_id":5}', "{}", "[]", "[{},{}]", '[{"bike_id":1},{}]', "nope", '{"bike_id":', '{"foo":1}', "3", '{"msrp":null}', None]
    rows = parse_requests(payloads(spark, *texts)).collect()
    states = {r["payload_id"]: r["payload_status"] for r in rows}
    assert [states[i] for i in range(len(texts))] == [
        "ok", "empty", "empty", "empty", "ok", "corrupt", "corrupt", "empty", "corrupt", "ok", "corrupt"
    ]
    assert len([r for r in rows if r["payload_id"] == 4]) == 2


def test_list_price_kinds(spark):
    text = '[{"msrp":1200},{"msrp":1200.5},{"msrp":"1200"},{"msrp":"1200.5"},{"msrp":"abc"},{"msrp":null},{"bike_id":1}]'
    rows = parse_requests(payloads(spark, text)).orderBy("request_pos").collect()
    assert [r["msrp"] for r in rows] == [1200, 1200.5, 1200, 0, 0, 0, None]


def test_scoring_seven_records(spark):
    root, run = trained(spark, SF_DIR)
    transforms, model = artefacts.load_artefacts(spark, root, run.version)
    extreme = '[{"bike_id":9,"msrp":250},{"bike_id":9,"msrp":25000},{"bike_id":9,"msrp":-5},{}]'
    requests = accepted(parse_requests(payloads(spark, SEVEN, extreme, "{}")))
    scored = in_request_order(score_requests(requests, transforms, model, inflation_factors(spark), AS_OF)).collect()
    assert [(r["payload_id"], r["request_pos"]) for r in scored] == [(0, i) for i in range(7)] + [(1, i) for i in range(4)]
    assert [r["route"] for r in scored] == ["model"] * 7 + ["rule", "rule", "model", "model"]
    for row in scored:
        assert row["interval"] == [row["low"], row["high"]] and row["low"] <= row["price"] <= row["high"]
        if row["route"] == "model":
            assert row["q_low"] <= row["q_mid"] <= row["q_high"]
    assert scored[2]["price"] == scored[3]["price"] == scored[4]["price"]


def test_scoring_gives_training_vectors(spark):
    """A saved train row and the transforms applied again give one and the same vector."""
    root, run = trained(spark, SF_DIR)
    transforms, _ = artefacts.load_artefacts(spark, root, run.version)
    prepared = artefacts.read_snapshot(spark, f"{root}/prepared/{run.version}").where(F.col("split") == "train")
    again = transforms.transform(prepared).select(*ROW_KEYS, F.col("features").alias("again"))
    stored = artefacts.read_snapshot(spark, run.snapshot, "train").select(*ROW_KEYS, "features")
    pairs = stored.join(again, list(ROW_KEYS)).collect()
    assert len(pairs) == stored.count()
    assert all(abs(a - b) < 1e-9 for row in pairs for a, b in zip(row["features"], row["again"]))


def test_newest_version_wins(spark, tmp_path):
    root, run = trained(spark, SF_DIR)
    assert artefacts.latest_version(spark, str(tmp_path)) is None
    for version in ("b", "a"):
        artefacts.publish_artefacts(str(tmp_path), version, run.transforms, run.model, spark)
    assert artefacts.latest_version(spark, str(tmp_path)) == "a"


def test_train_error_is_finite(spark):
    _, run = trained(spark, SF_DIR)
    assert 0 < run.train_error < 10
    assert config.LABEL == "sales_price"


def test_winner_is_trained_and_published(spark, tmp_path):
    """The retrained winner is a point model here; loading and scoring follow its kind."""
    _, run = trained(spark, SF_DIR)
    candidates = {
        "linear": Candidate(LinearRegression(labelCol=config.LABEL), {"regParam": [1.0, 10.0]}),
        "mean_forest": Candidate(RandomForestRegressor(labelCol=config.LABEL, seed=1, maxDepth=3), {"numTrees": [3]}),
    }
    factors = inflation_factors(spark)
    winner, _, board = choose_and_train(
        candidates, artefacts.read_snapshot(spark, run.snapshot), tables(spark, SF_DIR), factors, AS_OF,
        str(tmp_path), "w1", SMALL_IMPUTATION,
    )
    assert winner in candidates and board.count() == 5
    assert spark.read.parquet(f"{tmp_path}/leaderboard").count() == 5
    transforms, model = artefacts.load_artefacts(spark, str(tmp_path))
    scored = score_requests(accepted(parse_requests(payloads(spark, SEVEN))), transforms, model, factors, AS_OF).collect()
    assert len(scored) == 7 and all(r["price"] is not None and r["q_mid"] is None for r in scored)


def test_queries_learn_from_all_columns(monkeypatch):
    """All columns are imputed; the shared run takes the documented settings and every default besides."""
    from resaleworth.queries import frames, learned

    assert learned._NUMBERS == list(config.NUMERICAL) and learned._CATEGORIES == list(config.CATEGORICAL)
    seen = []
    for name in ("tables", "inflation_factors", "configure", "scratch_dir"):
        monkeypatch.setattr(frames, name, lambda *args: "x")
    monkeypatch.setattr(frames, "run_training", lambda *args: seen.append(args))
    frames.trained.__wrapped__(None, "x")
    settings = seen[0][6]
    assert settings == TrainingSettings(imputation=frames.IMPUTATION)
    assert frames.IMPUTATION == ImputationSettings(rounds=3, num_trees=10)


def test_a_run_is_fitted_once(spark, tmp_path):
    """The same rows, settings and learner load the published run; other settings or another learner make another one."""
    learner = LinearRegression(labelCol=config.LABEL, regParam=1.0)
    factors, listing = inflation_factors(spark), tables(spark, SF_DIR)
    first = run_training(listing, factors, AS_OF, str(tmp_path), None, learner, SMALL_IMPUTATION)
    again = run_training(listing, factors, AS_OF, str(tmp_path), None, learner, SMALL_IMPUTATION)
    assert first.fitted and not again.fitted and again.version == first.version and again.settings == SMALL_IMPUTATION
    assert again.train_error == pytest.approx(first.train_error)
    test = artefacts.read_snapshot(spark, again.snapshot, "test")
    values = lambda run: sorted(round(r["prediction"], 6) for r in run.model.transform(test).collect())
    assert values(first) == values(again)
    data = artefacts.read_snapshot(spark, f"{tmp_path}/prepared/{first.version}")
    digests = {
        run_digest(data, learner, AS_OF, SMALL_IMPUTATION),
        run_digest(data.repartition(3), learner, AS_OF, SMALL_IMPUTATION),
        run_digest(data, learner.copy({learner.regParam: 2.0}), AS_OF, SMALL_IMPUTATION),
        run_digest(data, learner, AS_OF, TrainingSettings()),
        run_digest(data.limit(50), learner, AS_OF, SMALL_IMPUTATION),
    }
    assert len(digests) == 4


def test_the_first_claim_counts(spark, tmp_path):
    with ThreadPool(4) as pool:
        got = set(pool.map(lambda name: artefacts.claim_run(spark, str(tmp_path), "d", name), "abcd"))
    assert len(got) == 1 and artefacts.published_run(spark, str(tmp_path), "d") == got.pop()
    assert artefacts.published_run(spark, str(tmp_path), "other") is None
    (tmp_path / "runs" / "half").write_text("")  # its writer has not finished
    assert artefacts.published_run(spark, str(tmp_path), "half") is None


def test_settings_survive_the_manifest():
    settings = TrainingSettings(numerical=("msrp", "bike_age"), zero_is_missing=False, bounds=config.PriceBounds(msrp_max=9000.0), recent_copies=1)
    assert TrainingSettings.from_json(settings.as_json()) == settings


def test_settings_reach_training_and_scoring(spark, tmp_path):
    """A run that keeps zeros, with fewer columns and other bounds: its scoring keeps zeros too and routes by its bounds."""
    settings = TrainingSettings(
        categorical=("brake_type_code", "motor"), numerical=("msrp", "is_mobile", "bike_age"), zero_is_missing=False, test_share=0.3,
        recent_copies=0, bounds=config.PriceBounds(msrp_max=4000.0), imputation=SMALL_IMPUTATION.imputation,
    )
    learner = LinearRegression(labelCol=config.LABEL, regParam=1.0)
    run_training(tables(spark, SF_DIR), inflation_factors(spark), AS_OF, str(tmp_path), "kept", learner, settings)
    run = load_run(spark, str(tmp_path), "kept")
    rows = artefacts.read_snapshot(spark, run.snapshot)
    prepared = artefacts.read_snapshot(spark, f"{tmp_path}/prepared/kept")
    assert run.settings == settings and rows.where("copy_no > 0").count() == 0
    assert prepared.where("is_mobile = 0 OR motor = 0").count() > 0 and "color" not in prepared.columns
    scored = score_requests(accepted(parse_requests(payloads(spark, SEVEN))), run.transforms, run.model, inflation_factors(spark), AS_OF, settings=run.settings)
    assert {r["bike_id"]: r["route"] for r in scored.collect() if r["bike_id"] != 2} == {1: "model", 3: "rule", 4: "model"}
    # A request with is_mobile 0 is scored like a training row with 0, not like one with a gap.
    price = lambda text: score_requests(
        accepted(parse_requests(payloads(spark, text))), run.transforms, run.model, inflation_factors(spark), AS_OF, settings=run.settings
    ).first()["price"]
    shared = '"msrp":1500,"bike_year":2021,"bike_created_at_year":2024,"brake_type_code":"disc","motor":0'
    assert price("{%s,\"is_mobile\":0}" % shared) is not None


def test_chain_state_keeps_the_newest_guess(spark):
    columns = [f"c{i}" for i in range(70)]  # more than a word of gaps
    rows = [[None if (i + j) % 7 == 0 else float(i * j) for j in range(70)] for i in range(20)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(3)
    state = ChainState(df, columns, {c: -1.0 for c in columns})
    gaps = state.rows.select(state.gap("c0").alias("a"), state.gap("c69").alias("b"), F.get("values", F.lit(69)).alias("v")).collect()
    assert all(r["b"] == (r["v"] == -1.0) for r in gaps) and any(r["a"] for r in gaps)
    for guess in (5.0, 6.0):
        state.guesses["c69"] = state.rows.where(state.gap("c69")).select("_row", F.lit(guess).alias("value"))
    state.guesses["c0"] = state.rows.where(state.gap("c0")).select("_row", F.lit(4.0).alias("value"))
    values = state.present().select(state.gap("c0").alias("a"), state.gap("c69").alias("b"), "values").collect()
    assert len(values) == 20
    for row in values:
        assert (row["values"][69] == 6.0) == row["b"] and (row["values"][0] == 4.0) >= row["a"]


def test_columns_rest_once_nothing_moves(spark, monkeypatch):
    """The second column is a function of the first and has the only gaps: one fit, no second round."""
    rows = [(float(i % 10), None if i % 4 == 0 else float(i % 10) * 2, float(i % 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    fits = []
    plain = ChainedForestImputer._refit
    monkeypatch.setattr(ChainedForestImputer, "_refit", lambda self, state, target, classes: fits.append(target) or plain(self, state, target, classes))
    ChainedForestImputer(numericalCols=["a", "b", "c"], categoricalCols=[], rounds=10, numTrees=3, maxDepth=4).fit(df)
    assert fits == ["b"]


def test_many_categories_go_digit_by_digit(spark):
    """3,000 categories are two digits; the imputed ones are known categories and often right."""
    rows = [(f"k{i:04d}", f"g{i // 30:03d}" if (i + r) % 9 else None, float(i)) for r in range(3) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, g string, n double")
    model = ChainedForestImputer(numericalCols=["n"], categoricalCols=["k", "g"], rounds=1, numTrees=3, maxDepth=5).fit(df)
    assert [len(forests) for _, forests in sorted(model.chains[1])] == [1, 2]
    holes = df.limit(200).withColumn("k", F.lit(None).cast("string"))
    filled = [r["k"] for r in model.transform(holes).collect()]
    assert len(filled) == 200 and all(k in {row[0] for row in rows} for k in filled)


def test_replayed_batch_keeps_its_model(spark, tmp_path):
    """A batch that is scored again after a newer model is out gives the same rows and ids, however its file is split."""
    run = trained(spark, SF_DIR)[1]
    root, source, output = (str(tmp_path / name) for name in ("models", "in", "out"))
    lines = [json.dumps({"bike_id": i, "msrp": 300 if i % 2 else 100}) for i in range(200)] + ["nope"] * 3
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(lines))
    artefacts.publish_artefacts(root, "old", run.transforms, run.model, spark)
    results = []
    for turn, size in enumerate(("128m", "1k")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        stream = scoring_stream.request_stream(spark, source)
        # A checkpoint of its own: the batch runs again from its start, as after a crash before its commit.
        cache = scoring_stream.ArtefactCache(spark, root)
        scoring_stream.start_scoring(stream, cache, output, f"{tmp_path}/check{turn}", inflation_factors(spark), lambda: AS_OF).awaitTermination()
        rows = spark.read.parquet(f"{output}/scored").orderBy("payload_id").collect()
        refused = spark.read.parquet(f"{output}/rejected").orderBy("payload_id").collect()
        results.append((rows, refused))
        artefacts.publish_artefacts(root, "new", run.transforms, run.model, spark)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert results[0] == results[1] and {r["model_version"] for r in results[1][0]} == {"old"}
    numbers = {int(r["payload_id"].rsplit("#", 1)[1]): r["bike_id"] for r in results[0][0]}
    assert numbers == {i: i for i in range(200)} and [r["payload_id"].rsplit("#", 1)[1] for r in results[0][1]] == ["200", "201", "202"]


def test_a_search_goes_on_where_it_stopped(spark, points, tmp_path, monkeypatch):
    """The second run breaks off in the middle; the third fits only what is missing, other rows start anew."""
    rows = points.withColumn("copy_no", F.lit(0)).withColumn("split", F.when(F.col("id") % 5 == 0, "test").otherwise("train"))
    candidates = default_candidates(grids={"linear": {"regParam": [0.1, 1.0]}, "mean_forest": {"numTrees": [2], "maxDepth": [2, 3]}})
    fits, plain = [], selection.fold_error

    def counted(learner, folded, fold, label):
        if len(fits) == stop:
            raise RuntimeError("lost")
        fits.append(fold)
        return plain(learner, folded, fold, label)

    monkeypatch.setattr(selection, "fold_error", counted)
    choose = lambda data, path: choose_model(candidates, data, path, shortlist_folds=2, parallelism=1)
    stop, path = 7, f"{tmp_path}/board"
    with pytest.raises(RuntimeError, match="lost"):
        choose(rows, path)
    assert selection.finished_cells(spark, f"{path}-cells").count() == 7
    stop, fits[:] = None, []
    winner, settings, board = choose(rows, path)
    assert len(fits) == 2 * 2 + 2 * 2 * 2 + 2 - 7
    fits[:] = []
    assert choose(rows, path)[:2] == (winner, settings) and not fits
    whole = choose(rows, None)
    assert whole[:2] == (winner, settings) and sorted(whole[2].collect()) == sorted(board.collect())
    fits[:] = []
    choose(rows.where("id <> 1"), path)
    assert len(fits) == 2 * 2 + 2 * 2 * 2 + 2


def test_widening_is_the_order_statistic(spark):
    rng = random.Random(4)
    rows = [(i, 10.0, 20.0, rng.uniform(0, 40)) for i in range(199)]
    df = spark.createDataFrame(rows, "id bigint, q_low double, q_high double, sales_price double")
    lacks = sorted(max(10.0 - r[3], r[3] - 20.0) for r in rows)
    for coverage in (0.1, 0.5, 0.7, 0.9):
        by = widening(df, coverage)
        assert by == lacks[math.ceil(200 * coverage) - 1]
        inside = widened(df, by).where("sales_price between q_low and q_high").count()
        assert inside >= coverage * 199 or by < -5
    assert widening(df, 0.999) == math.inf and widening(df.limit(0), 0.5) == math.inf
    narrow = widened(df, -100.0).first()
    assert narrow["q_low"] == narrow["q_high"] == 15.0


def test_copies_stay_on_their_side_of_the_calibration(spark):
    rows = spark.range(500).select("id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("copy_no"))
    marked = with_calibration(rows, 0.2)
    assert marked.groupBy("id").agg(F.count_distinct("held").alias("n")).where("n > 1").count() == 0
    assert 50 < marked.where("held AND copy_no = 0").count() < 150


def test_sketches_hold_the_labels_of_their_leaves(spark, points, tmp_path):
    """Small leaves are exact: quantiles are those of all labels in the reached leaves, a label counting once per tree."""
    model = QuantileForest(numTrees=3, maxDepth=3, leafLabels="all", sketchAccuracy=2000, quantiles=[0.0, 0.5, 1.0]).fit(points)
    model.write().save(f"{tmp_path}/sketches")
    again = QuantileForestModel.load(f"{tmp_path}/sketches")
    leafed = model.forest.transform(points).select("id", "sales_price", "_leaves").collect()
    members = {}
    for r in leafed:
        for tree, leaf in enumerate(r["_leaves"]):
            members.setdefault((tree, leaf), []).append(r["sales_price"])
    expected = {r["id"]: sorted(y for tree, leaf in enumerate(r["_leaves"]) for y in members[tree, leaf]) for r in leafed}
    rows = points.unionByName(points.where("id = 3")).unionByName(points.where("id = 4").withColumn("id", F.lit(None).cast("bigint")))
    for loaded in (model, again):
        got = loaded.transform(rows).collect()
        assert len(got) == 1002
        for r in got:
            ys = expected[4 if r["id"] is None else r["id"]]
            low, mid, high = r["quantile_values"]
            assert (low, high) == (ys[0], ys[-1]) and mid == r["prediction"] and ys[len(ys) // 2 - 2] <= mid <= ys[len(ys) // 2 + 2]
    assert model.leaves.agg(F.sum("samples")).first()[0] == 3000
    with pytest.raises(ValueError, match="leafLabels"):
        QuantileForest(leafLabels="some")


def test_a_chain_moves_no_rows(spark, gaps):
    """Refitting a column replaces its gaps in place: observed cells stay, the plan has no exchange, and the first fill of a constant is kept."""
    columns = ["a", "b"]
    numbers = gaps.select(*columns)
    state = ChainState(numbers, columns, {"a": 0.0, "b": 0.0})
    before = {r["_row"]: r for r in state.rows.collect()}
    imputer = ChainedForestImputer(numericalCols=columns, categoricalCols=[], numTrees=2, maxDepth=2)
    for _ in range(2):
        _, move = imputer._refit(state, "b", None)
    assert move < 30 and "Exchange" not in state.present()._jdf.queryExecution().executedPlan().toString()
    after = {r["_row"]: r for r in state.present().collect()}
    for row, r in before.items():
        assert after[row]["values"][0] == r["values"][0]
        assert (after[row]["values"][1] == r["values"][1]) == (not r["gaps"][0] & 2)
    state.store()
    assert {r["_row"]: r for r in state.present().collect()} == after


def test_a_row_pays_for_its_gaps_only(spark, gaps, imputer):
    """The vector of the other columns is made where the gap is asked for, not in a step of its own for all rows; a NaN is an error."""
    assert "_inputs" not in imputer.transform(gaps)._jdf.queryExecution().optimizedPlan().toString()
    row = spark.createDataFrame([(1, math.nan, 2.0, None, "x", 1)], gaps.schema)
    with pytest.raises(Exception, match="NaN in a"):
        imputer.transform(row).collect()


def test_a_constant_number_needs_no_forest(spark):
    rows = [(float(i % 10), None if i % 3 else 7.0, None if i % 4 == 0 else float(i % 5)) for i in range(100)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    model = ChainedForestImputer(numericalCols=["a", "b", "c"], categoricalCols=[], rounds=2, numTrees=2, maxDepth=2).fit(df)
    assert "b" not in dict(model.chains[0]) and {r["b"] for r in model.transform(df).collect()} == {7.0}


def test_ranks_in_groups_are_counts(spark):
    """Ties, values that no group holds and groups of very different size, against counting one by one."""
    rng = random.Random(6)
    held = [(g, float(rng.randrange(20)), i) for i, g in enumerate([0] * 300 + [1] * 3 + [2] * 40)]
    asked = [(g, v / 2) for g in range(3) for v in range(-2, 44)]
    sizes = spark.createDataFrame([(0, 300), (1, 3), (2, 40)], "g int, n bigint")
    rows = spark.createDataFrame(held, "g int, v double, tie bigint").repartition(5)
    found = ranks_in_groups(rows, spark.createDataFrame(asked, "g int, v double"), sizes, ["g"]).collect()
    assert len(found) == len(asked)
    for r in found:
        own = [v for g, v, _ in held if g == r["g"]]
        assert (r["below"], r["upto"], r["n"]) == (sum(v < r["v"] for v in own), sum(v <= r["v"] for v in own), len(own))


def test_lines_are_numbered_where_they_lie(spark):
    """Lines of a block stay with their task even where sizes are unknown, as they are in a batch of a stream."""
    rows = [(f"f{i % 2}", (i // 2 % 3) * 100, f"line {i}") for i in range(60)]
    lines = spark.createDataFrame(rows, "file string, block bigint, value string").repartition(3, "block").sortWithinPartitions("file", "block").persist()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    numbered = scoring_stream.numbered_lines(lines)
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert sorted(r["payload_id"] for r in numbered.collect()) == sorted(f"f{f}#{i}" for f in range(2) for i in range(30))
    lines.unpersist()


def test_payloads_are_parsed_in_even_parts(spark, monkeypatch):
    """Payloads that lie in one part are parsed by all cores, and every one is answered once."""
    parts, plain = [], scoring_plan.materialise
    sizes = lambda df: parts.extend(df.groupBy(F.spark_partition_id()).count().collect())
    monkeypatch.setattr(scoring_plan, "materialise", lambda df, label: sizes(df) or plain(df, label))
    none = lambda rows, *_, **__: rows.withColumns({name: F.lit(None) for name in scoring_plan.SCORED})
    monkeypatch.setattr(scoring_plan, "score_requests", none)
    texts = ['{"bike_id": 1}', "x", "{}", '{"bike_id": 1}'] * 100
    run = scoring_plan.run_scoring(payloads(spark, *texts).coalesce(1), None, None, None, AS_OF)
    assert len(parts) >= spark.sparkContext.defaultParallelism and max(r["count"] for r in parts) <= 200
    assert run.scored.count() == 200 and run.scored.select("payload_id").distinct().count() == 200
    assert sorted(r["payload_id"] for r in run.rejected.collect()) == [i for i in range(400) if i % 4 in (1, 2)]


def test_training_rows_lie_in_even_parts(spark, monkeypatch, tmp_path):
    """All steps of a run, and whoever reads its snapshot, get parts of even size, whatever the extract's files were."""
    monkeypatch.setattr(session, "LEAST_ROWS", 50)
    run = run_training(tables(spark, SF_DIR), inflation_factors(spark), AS_OF, str(tmp_path), "even", QuantileForest(keyCols=list(ROW_KEYS), numTrees=2, maxDepth=2), SMALL_IMPUTATION)
    train = artefacts.read_snapshot(spark, run.snapshot, "train")
    sizes = [r["count"] for r in train.groupBy(F.input_file_name().alias("file")).count().collect()]
    assert len(sizes) == min(spark.sparkContext.defaultParallelism, -(-artefacts.read_snapshot(spark, run.snapshot).count() // 50))
    assert max(sizes) < 1.6 * sum(sizes) / len(sizes)


def test_snapshot_rows_of_like_price_lie_together(spark, tmp_path):
    """Each file of the snapshot is in the order of the list price, so that neighbouring rows meet the same tree nodes."""
    run = run_training(tables(spark, SF_DIR), inflation_factors(spark), AS_OF, str(tmp_path), "near", QuantileForest(keyCols=list(ROW_KEYS), numTrees=2, maxDepth=2), SMALL_IMPUTATION)
    place = run.settings.numerical.index("msrp") - len(run.settings.numerical)
    prices = artefacts.read_snapshot(spark, run.snapshot, "train").select(F.input_file_name().alias("file"), F.element_at(vector_to_array("features"), place).alias("price"))
    by_file = {}
    for row in prices.collect():
        by_file.setdefault(row["file"], []).append(row["price"])
    assert by_file and all(len(set(own)) > 1 and own == sorted(own) for own in by_file.values())


def test_code_of_the_imputer_is_compiled(spark):
    """Java interprets a generated method of more than 8,000 bytes."""
    numbers, texts = [f"n{i}" for i in range(12)], [f"t{i}" for i in range(6)]
    rows = [[float((i * (k + 3)) % 11) if (i + k) % 5 else None for k in range(12)] + [f"v{(i * (k + 2)) % 4}" if (i + k) % 7 else None for k in range(6)] for i in range(60)]
    table = spark.createDataFrame(rows, ", ".join([f"{name} double" for name in numbers] + [f"{name} string" for name in texts]))
    model = ChainedForestImputer(numericalCols=numbers, categoricalCols=texts, rounds=1, numTrees=2, maxDepth=2).fit(table)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        filled = model.transform(table)
        pieces = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(filled._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [pieces.apply(i)._3().maxMethodCodeSize() for i in range(pieces.size())]
    assert sizes and max(sizes) < 8_000
    cells = [cell for row in filled.collect() for cell in row]
    assert len(cells) == 60 * 18 and None not in cells
    assert filled.rdd.getNumPartitions() == table.rdd.getNumPartitions()


def test_records_are_priced_in_a_set_number_of_parts(spark, monkeypatch):
    """Not in as many as their bytes fill, which are about as many as cores."""
    seen = []

    class Stop(Exception):
        pass

    def watched(rows, *_):
        seen.append(rows)
        raise Stop

    monkeypatch.setattr(scoring_plan, "engineer_features", watched)
    records = accepted(parse_requests(payloads(spark, *['{"bike_id": 1}'] * 4000).coalesce(1)))
    with pytest.raises(Stop):
        scoring_plan.price_model_rows(records, None, None, None, AS_OF, ("payload_id", "request_pos"))
    parts = seen[0].groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == scoring_plan.PRICING_WAVES * spark.sparkContext.defaultParallelism
    assert max(r["count"] for r in parts) <= 250 and sum(r["count"] for r in parts) == 4000


def test_rows_keep_their_nodes_between_levels(points, forest):
    """The trees are those of a forest that walks from the root at each level."""
    grown = forest.forest
    assert grown.getCacheNodeIds()
    names = ("numTrees", "maxDepth", "minWeightFractionPerNode", "minInfoGain", "maxBins", "featureSubsetStrategy", "seed")
    settings = {name: grown.getOrDefault(name) for name in names}
    walked = RandomForestRegressor(featuresCol=grown.getFeaturesCol(), labelCol=grown.getLabelCol(), **settings).fit(points)
    trees = lambda model: model.toDebugString.split("\n", 1)[1]
    assert trees(walked) == trees(grown)
