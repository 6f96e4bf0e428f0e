"""Queries for the learned operators.

SQL cannot grow forests, so most checks compare what must hold for any fit: every gap filled, observed
cells untouched, ordered quantiles, one price per record.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F

from resaleworth import config
from resaleworth.operators import pricing as pr
from resaleworth.operators.forest import QuantileForest, leaf_ids
from resaleworth.operators.impute import ChainedForestImputer
from resaleworth.operators.ranking import ranks_in_groups
from resaleworth.operators.selection import LEADERBOARD, Candidate, default_candidates, finetune, finished_cells, setting_names, shortlist
from resaleworth.plans import evaluation, model_choice, scoring
from resaleworth.plans.training import ROW_KEYS, TrainingSettings, load_run, train_calibrated
from resaleworth.queries import frames, oracle_base as sql
from resaleworth.queries.frames import trained
from resaleworth.queries.registry import Registry
from resaleworth.session import materialise, scratch_path
from resaleworth.sources import artefacts
from resaleworth.sources.inflation import inflation_factors
from resaleworth.streaming import scoring as stream

query = Registry()


def _snapshot(spark: SparkSession, sf_dir: str, split: str | None = None) -> DataFrame:
    _, run = trained(spark, sf_dir)
    return artefacts.read_snapshot(spark, run.snapshot, split)


def _imputation_report(spark: SparkSession, sf_dir: str, numerical: list[str], categorical: list[str]) -> DataFrame:
    rows = materialise(frames.split_rows(spark, sf_dir).select("id", "split", *numerical, *categorical), "gaps")
    imputation = frames.IMPUTATION
    imputer = ChainedForestImputer(
        numericalCols=numerical, categoricalCols=categorical, rounds=imputation.rounds, numTrees=imputation.num_trees, maxDepth=imputation.max_depth
    )
    filled = imputer.fit(rows.where(F.col("split") == "train")).transform(rows)
    columns = numerical + categorical
    before = rows.select("id", *[F.col(name).alias(f"{name}_before") for name in columns])
    was, now = (lambda name: F.col(f"{name}_before")), F.col
    counts = [
        F.struct(
            F.lit(name).alias("column_name"),
            F.count("*").alias("rows"),
            F.count_if(was(name).isNull()).alias("gaps_before"),
            F.count_if(now(name).isNull()).alias("gaps_after"),
            F.count_if(was(name) != now(name)).alias("observed_changed"),
        )
        for name in columns
    ]
    return filled.join(before, "id").agg(F.array(*counts).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def _imputation_check(columns: list[str]) -> str:
    parts = [
        f"SELECT '{name}' AS column_name, count(*) AS rows, count(*) FILTER ({name} IS NULL) AS gaps_before,"
        " CAST(0 AS BIGINT) AS gaps_after, CAST(0 AS BIGINT) AS observed_changed FROM split_rows"
        for name in columns
    ]
    return f"WITH {sql.FEATURES} " + " UNION ALL ".join(parts)


_NUMBERS, _CATEGORIES = list(config.NUMERICAL), list(config.CATEGORICAL)


@query(_imputation_check(_NUMBERS))
def imputed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _imputation_report(spark, sf_dir, _NUMBERS, [])


@query(_imputation_check(_CATEGORIES))
def imputed_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _imputation_report(spark, sf_dir, [], _CATEGORIES)


@query(f"WITH {sql.FEATURES} SELECT id, copy_no, 'train' AS split, round(sales_price, 6) AS sales_price FROM train_rows"
       " UNION ALL SELECT id, 0, split, round(sales_price, 6) FROM split_rows WHERE split = 'test'")
def training_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows the training job wrote, read back."""
    rows = _snapshot(spark, sf_dir)
    return rows.select("id", "copy_no", "split", F.round("sales_price", 6).alias("sales_price"))


@query(f"WITH {sql.FEATURES} SELECT id, copy_no FROM train_rows")
def train_snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One split of the snapshot; the other folder is not read."""
    return _snapshot(spark, sf_dir, "train").select("id", "copy_no")


_WIDTH = " + ".join(f"(SELECT count(DISTINCT {name}) + 1 FROM train_rows)" for name in config.CATEGORICAL)
_ALL_ROWS = (
    "(SELECT id, copy_no, split FROM train_rows UNION ALL SELECT id, 0, split FROM split_rows WHERE split = 'test')"
)


@query(
    f"WITH {sql.FEATURES} SELECT id, copy_no, split, {_WIDTH} + {len(config.NUMERICAL)} AS features,"
    f" CAST({len(config.CATEGORICAL)} AS DOUBLE) AS indicators_set, true AS complete FROM {_ALL_ROWS}"
)
def transformed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of the fitted transforms: one slot per category and an unknown one, then the numbers."""
    vector = vector_to_array("features")
    flags = F.slice(vector, F.lit(1), F.size(vector) - len(config.NUMERICAL))
    return _snapshot(spark, sf_dir).select(
        *ROW_KEYS,
        "split",
        F.size(vector).cast("bigint").alias("features"),
        F.aggregate(flags, F.lit(0.0), lambda a, b: a + b).alias("indicators_set"),
        (~F.exists(vector, lambda v: F.isnan(v) | v.isNull())).alias("complete"),
    )


@query(
    f"WITH {sql.FEATURES} SELECT CAST(tree AS INTEGER) AS tree, count(*) AS rows, true AS inside"
    " FROM train_rows, range(10) AS t(tree) GROUP BY tree"
)
def forest_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows per tree of a fitted, saved and reloaded forest of ten trees; leaf labels are training labels."""
    _, run = trained(spark, sf_dir)
    train, root = _snapshot(spark, sf_dir, "train"), scratch_path(spark, "ten-trees")
    forest = QuantileForest(keyCols=list(ROW_KEYS), numTrees=10, maxDepth=frames.FOREST_DEPTH).fit(train)
    artefacts.publish_artefacts(root, "v1", run.transforms, forest, spark)
    _, model = artefacts.load_artefacts(spark, root)
    low, high = train.agg(F.min(config.LABEL), F.max(config.LABEL)).first()
    return model.leaves.groupBy("tree").agg(
        F.sum("samples").alias("rows"), F.bool_and(F.col("y").between(low, high)).alias("inside")
    )


@query(
    f"WITH {sql.FEATURES} SELECT id, true AS ordered, true AS inside FROM split_rows WHERE split = 'test'"
)
def quantile_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles per test row: ordered, and inside the range of the training labels."""
    _, run = trained(spark, sf_dir)
    low, high = run.model.leaves.agg(F.min("y"), F.max("y")).first()
    predicted = run.model.transform(_snapshot(spark, sf_dir, "test"))
    q = [F.get("quantile_values", F.lit(i)) for i in range(3)]
    return predicted.select(
        "id",
        ((q[0] <= q[1]) & (q[1] <= q[2])).alias("ordered"),
        ((q[0] >= low) & (q[2] <= high)).alias("inside"),
    )


@query(
    f"WITH {sql.FEATURES} SELECT id, true AS ordered, true AS inside, true AS near FROM split_rows WHERE split = 'test'"
)
def leaf_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of all training labels in the reached leaves, by merged sketches: ordered, inside the range of the labels, and
    each within the sketch's rank error of the same leaves taken label by label."""
    train, test = _snapshot(spark, sf_dir, "train"), _snapshot(spark, sf_dir, "test")
    quantiles, slack = [0.2, 0.5, 0.8], 0.03
    model = QuantileForest(keyCols=list(ROW_KEYS), numTrees=5, maxDepth=6, leafLabels="all", quantiles=quantiles).fit(train)
    low, high = train.agg(F.min(config.LABEL), F.max(config.LABEL)).first()
    predicted = materialise(model.transform(test).select("id", "quantile_values"), "distributions")
    # For the check only: leaf by leaf the number of labels below, and up to, each predicted value.
    labels = leaf_ids(model.forest.transform(train), *ROW_KEYS, F.col(config.LABEL).cast("double").alias("v"))
    values = F.posexplode("quantile_values").alias("i", "v")
    reached = materialise(leaf_ids(model.forest.transform(test), "id").join(predicted, "id").select("id", "quantile_values", "tree", "leaf", values), "reached")
    sizes = model.leaves.select("tree", "leaf", F.col("samples").alias("n"))
    ranks = ranks_in_groups(labels.withColumn("tie", F.xxhash64(*ROW_KEYS)), reached.select("tree", "leaf", "v").distinct(), sizes, ["tree", "leaf"])
    each = reached.join(ranks, ["tree", "leaf", "v"]).groupBy("id", "quantile_values", "i").agg(*[F.sum(name).alias(name) for name in ("below", "upto", "n")])
    within = F.expr(f"below / n <= wanted + {slack} AND upto / n >= wanted - {slack}")
    wanted = F.get(F.array(*[F.lit(q) for q in quantiles]), F.col("i"))
    shares = each.withColumn("wanted", wanted).groupBy("id", "quantile_values").agg(F.bool_and(within).alias("near"))
    v = [F.col("quantile_values")[i] for i in range(3)]
    return shares.select("id", ((v[0] <= v[1]) & (v[1] <= v[2])).alias("ordered"), ((v[0] >= low) & (v[2] <= high)).alias("inside"), "near")


@query(f"WITH {sql.FEATURES} SELECT count(*) * 3 AS rows, CAST(0 AS BIGINT) AS different FROM split_rows WHERE split = 'test'")
def quantile_paths_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lookup for small leaf tables and the salted join for large ones give the same quantiles, to the last bit.

    Every test row comes twice with its key and once without.
    """
    _, run = trained(spark, sf_dir)
    test = _snapshot(spark, sf_dir, "test").select(*ROW_KEYS, "features")
    keyless = test.withColumn("id", F.lit(None).cast("bigint"))
    rows = test.union(test).union(keyless).withColumn("place", F.monotonically_increasing_id())
    rows, model = materialise(rows, "places"), run.model.with_keys(*ROW_KEYS)
    looked_up = model.predict_by_lookup(rows).select("place", F.col("quantile_values").alias("a"))
    joined = model.predict_by_join(rows).select("place", F.col("quantile_values").alias("b"))
    return looked_up.join(joined, "place").agg(F.count("*").alias("rows"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("different"))


@query(f"WITH {sql.FEATURES} SELECT id, true AS around, true AS five_percent FROM split_rows WHERE split = 'test'")
def point_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price and interval from a model that gives one value; the interval method follows the model."""
    model = LinearRegression(labelCol=config.LABEL, regParam=1.0).fit(_snapshot(spark, sf_dir, "train"))
    priced = pr.price_by_model(_snapshot(spark, sf_dir, "test"), model)
    price, low, high = F.col("price"), F.col("low"), F.col("high")
    width = F.abs((high - low) - F.abs(price) * config.POINT_INTERVAL_RANGE)
    return priced.select(
        "id",
        price.between(F.least(low, high), F.greatest(low, high)).alias("around"),
        (width <= 0.02).alias("five_percent"),
    )


@query(f"WITH {sql.FEATURES} SELECT id, true AS tens, true AS around FROM split_rows WHERE split = 'test'")
def model_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantile-model prices are multiples of ten with the interval around them."""
    _, run = trained(spark, sf_dir)
    priced = pr.price_by_model(_snapshot(spark, sf_dir, "test"), run.model)
    return priced.select(
        "id",
        (F.col("price") % 10 == 0).alias("tens"),
        F.col("price").between(F.col("low"), F.col("high")).alias("around"),
    )


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.request_payloads(frames.tables(spark, sf_dir).bikes)


_RECORDS = (
    "sent AS (SELECT id, CASE id % 10 WHEN 0 THEN floor(msrp) WHEN 1 THEN 0.0::DOUBLE WHEN 2 THEN 0 WHEN 3 THEN NULL"
    " ELSE msrp END AS msrp FROM bikes WHERE id % 50 NOT IN (7, 8, 9)),"
    " records AS (SELECT id AS payload_id, CAST(0 AS BIGINT) AS request_pos, CASE WHEN (msrp > 0 AND msrp <= 250)"
    " OR msrp >= 25000 THEN 'rule' ELSE 'model' END AS route FROM sent"
    " UNION ALL SELECT id, 1, 'model' FROM sent WHERE id % 3 = 0)"
)


@query(f"WITH {sql.LISTINGS}, {_RECORDS} SELECT *, true AS priced FROM records")
def scored_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole scoring job with saved and reloaded artefacts: one price per accepted record."""
    root, run = trained(spark, sf_dir)
    run = load_run(spark, root, run.version)
    scored = scoring.run_scoring(
        _payloads(spark, sf_dir), run.transforms, run.model, inflation_factors(spark), frames.AS_OF, settings=run.settings
    ).scored
    priced = F.col("price").isNotNull() & F.col("price").between(F.col("low"), F.col("high"))
    return scored.select("payload_id", "request_pos", "route", priced.alias("priced"))


@query(f"WITH {sql.LISTINGS}, {_RECORDS} SELECT route, count(*) AS rows FROM records GROUP BY route")
def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of scored requests. Two runs of one day: each reads back its own rows only."""
    _, run = trained(spark, sf_dir)
    path = scratch_path(spark, "request-log")
    settings = (run.transforms, run.model, inflation_factors(spark), frames.AS_OF, path)
    scoring.run_scoring(_payloads(spark, sf_dir).where("payload_id % 7 = 0"), *settings)
    logged = scoring.run_scoring(_payloads(spark, sf_dir), *settings).scored
    return logged.groupBy("route").agg(F.count("*").alias("rows"))


@query(f"WITH {sql.FEATURES} SELECT count(*) AS rows, true AS plausible FROM split_rows WHERE split = 'test'")
def evaluation_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores the test rows, writes the result table, reports error and coverage."""
    _, run = trained(spark, sf_dir)
    report = evaluation.run_evaluation(_snapshot(spark, sf_dir, "test"), run.model, scratch_path(spark, "evaluation"))
    wider = F.col("quantile_coverage_pct") >= F.col("coverage_pct")
    plausible = (F.col("mape_pct") > 0) & F.col("coverage_pct").between(0, 100) & wider
    return report.select("rows", plausible.alias("plausible"))


@query(f"WITH {sql.FEATURES} SELECT count(*) AS rows, true AS covered, true AS wider FROM split_rows WHERE split = 'test'")
def calibrated_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quantiles 0.2 and 0.8, widened so that they should hold three quarters of the prices: on the test rows at least 0.70 are inside."""
    settings = TrainingSettings(calibration_share=0.2, coverage=0.75)
    learner = QuantileForest(keyCols=list(ROW_KEYS), numTrees=20, maxDepth=10)
    model, _, by = train_calibrated(_snapshot(spark, sf_dir, "train"), learner, settings)
    test, path = _snapshot(spark, sf_dir, "test"), scratch_path(spark, "calibrated")
    report = evaluation.run_evaluation(test, model, path, quantiles=config.SCORING_QUANTILES, wider=by)
    raw = evaluation.run_evaluation(test, model, f"{path}-raw", quantiles=config.SCORING_QUANTILES).select(F.col("quantile_coverage_pct").alias("raw_pct"))
    covered = (F.col("quantile_coverage_pct") >= 70).alias("covered")
    wider = ((F.col("quantile_coverage_pct") >= F.col("raw_pct")) == F.lit(by >= 0)).alias("wider")
    return report.join(F.broadcast(raw)).select("rows", covered, wider)


def _one_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales with the list price as their only feature, so that linear fits have a closed form in SQL."""
    rows = frames.split_rows(spark, sf_dir).where("msrp IS NOT NULL").select("id", "split", "sales_price", "msrp")
    return materialise(VectorAssembler(inputCols=["msrp"], outputCol="features").transform(rows), "one-number")


def _linear_candidates() -> dict[str, Candidate]:
    """A line, a line through zero, and a level (all weight on the penalty)."""
    line = LinearRegression(labelCol=config.LABEL, solver="normal")
    return {
        "line": Candidate(line, {"fitIntercept": [True, False]}),
        "origin": Candidate(line, {"fitIntercept": [False]}),
        "level": Candidate(line, {"regParam": [1e15]}),
    }


def _forest_candidates() -> dict[str, Candidate]:
    return {
        "quantile_forest": Candidate(QuantileForest(keyCols=["id"], numTrees=5, maxDepth=5)),
        "mean_forest": Candidate(RandomForestRegressor(labelCol=config.LABEL, seed=42, numTrees=5, maxDepth=4)),
        "boosted_trees": Candidate(GBTRegressor(labelCol=config.LABEL, seed=42, maxIter=3, maxDepth=3)),
    }


def _linear_errors(folds: int) -> str:
    """CTEs that end in scores_<folds>(model, score): the mean fold error of the three linear fits."""
    fold = f"CAST('0x' || substr(md5('{config.SHUFFLE_SEED}' || id::VARCHAR), 1, 8) AS BIGINT) % 10000 % {folds}"
    fits = "regr_slope(sales_price, msrp) AS a, regr_intercept(sales_price, msrp) AS b, sum(sales_price * msrp) / sum(msrp * msrp) AS o, avg(sales_price) AS m"
    return f"""
  folded_{folds} AS (SELECT *, {fold} AS fold FROM one_number WHERE split = 'train'),
  fits_{folds} AS (SELECT f AS fold, {fits} FROM folded_{folds}, range({folds}) AS t(f) WHERE fold <> f GROUP BY f),
  errors_{folds} AS (
    SELECT fold, unnest([struct_pack(model := 'line', p := a * msrp + b), struct_pack(model := 'origin', p := o * msrp),
      struct_pack(model := 'level', p := m)], recursive := true), sales_price
    FROM folded_{folds} JOIN fits_{folds} USING (fold)
  ),
  scores_{folds} AS (
    SELECT model, avg(score) AS score FROM (
      SELECT model, fold, avg(abs(sales_price - p) / sales_price) AS score FROM errors_{folds} GROUP BY ALL) GROUP BY model
  )"""


_ONE_NUMBER = f"WITH {sql.FEATURES}, one_number AS (SELECT id, split, sales_price, msrp FROM split_rows WHERE msrp IS NOT NULL)"
_TEST_ERRORS = """
  final AS (
    SELECT regr_slope(sales_price, msrp) AS a, regr_intercept(sales_price, msrp) AS b,
      sum(sales_price * msrp) / sum(msrp * msrp) AS o FROM one_number WHERE split = 'train'
  ),
  tested AS (
    SELECT avg(abs(sales_price - a * msrp - b) / sales_price) AS line, avg(abs(sales_price - o * msrp) / sales_price) AS origin
    FROM one_number, final WHERE split = 'test'
  )"""


@query(
    f"{_ONE_NUMBER}, {_linear_errors(3)} SELECT model, round(score, 6) AS score, true AS positive FROM scores_3"
    " UNION ALL SELECT unnest(['quantile_forest', 'mean_forest', 'boosted_trees']), NULL, true"
)
def shortlisted_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-fold error of each candidate with its default settings; the numbers of the linear ones."""
    linear = _linear_candidates()
    _, rows = shortlist({**linear, **_forest_candidates()}, _one_number(spark, sf_dir).where("split = 'train'"))
    board = spark.createDataFrame(rows, LEADERBOARD)
    known = F.when(F.col("model").isin(*linear), F.round("score", 6))
    return board.select("model", known.alias("score"), (F.col("score") > 0).alias("positive"))


@query(
    f"{_ONE_NUMBER}, {_linear_errors(2)}, {_TEST_ERRORS}, grid AS (SELECT CASE model WHEN 'line' THEN 'fitIntercept=True'"
    " ELSE 'fitIntercept=False' END AS params, model, score FROM scores_2 WHERE model <> 'level')"
    " SELECT 'line' AS model, params, round(score, 6) AS score, CASE WHEN score = (SELECT min(score) FROM grid)"
    " THEN round(CASE model WHEN 'line' THEN line ELSE origin END, 6) END AS test_score FROM grid, tested"
)
def tuned_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-fold grid search of one candidate, with the error of its best setting on the test rows."""
    rows = _one_number(spark, sf_dir)
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    _, tried = finetune({"line": _linear_candidates()["line"]}, train, test)
    board = spark.createDataFrame(tried, LEADERBOARD)
    return board.select("model", "params", F.round("score", 6).alias("score"), F.round("test_score", 6).alias("test_score"))


@query(
    f"{_ONE_NUMBER}, {_linear_errors(3)}, {_linear_errors(2)},"
    " kept AS (SELECT model FROM scores_3 ORDER BY score, model LIMIT 2),"
    " grid AS (SELECT k.model, s.model AS fit, CASE WHEN k.model = 'level' THEN 'regParam=1e+15' WHEN s.model = 'line'"
    " THEN 'fitIntercept=True' ELSE 'fitIntercept=False' END AS params, score FROM kept k JOIN scores_2 s"
    " ON s.model = k.model OR (k.model = 'line' AND s.model = 'origin')),"
    " best AS (SELECT model, min(score) AS score FROM grid GROUP BY model),"
    " won AS (SELECT arg_min(model, struct_pack(a := score, b := model)) AS winner FROM best)"
    " SELECT 'shortlist' AS stage, model, 'default' AS params, round(score, 6) AS score, model = winner AS winner FROM scores_3, won"
    " UNION ALL SELECT 'grid', model, params, round(score, 6), model = winner FROM grid, won"
)
def model_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortlist, grid search and winner; the appended leaderboard is read back."""
    path = scratch_path(spark, "leaderboard")
    winner, _, _ = model_choice.choose_model(_linear_candidates(), _one_number(spark, sf_dir), path)
    board = spark.read.parquet(path)
    return board.select("stage", "model", "params", F.round("score", 6).alias("score"), (F.col("model") == winner).alias("winner"))


# Grids that end within a query; the full ones are in ``GRIDS``. The first value of each list is the shortlist's.
SEARCH_GRIDS = {
    "quantile_forest": {"numTrees": [10, 20], "maxDepth": [8]},
    "mean_forest": {"numTrees": [10, 20], "maxDepth": [8]},
    "boosted_trees": {"maxIter": [5], "stepSize": [0.1, 0.5]},
    "linear": {"regParam": [1.0, 10.0]},
}
_MODELS = ", ".join(f"('{name}', 'default')" for name in SEARCH_GRIDS)


@lru_cache(maxsize=4)
def _searched(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """The winner of a search over all kinds of learner on the vectors of the snapshot, and the leaderboard's folder."""
    root, run = trained(spark, sf_dir)
    path = f"{root}/search/{run.version}"
    candidates = default_candidates(keys=ROW_KEYS, grids=SEARCH_GRIDS)
    winner, _, _ = model_choice.choose_model(candidates, _snapshot(spark, sf_dir), path)
    return winner, path


@query(f"SELECT model, params, 3 AS folds, true AS positive FROM (VALUES {_MODELS}) AS t(model, params)")
def searched_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of learner on all features of the snapshot, three folds each, from the table of finished fits."""
    _, path = _searched(spark, sf_dir)
    cells = finished_cells(spark, f"{path}-cells").where("stage = 'shortlist'")
    return cells.groupBy("model", "params").agg(F.count("*").cast("int").alias("folds"), F.bool_and(F.col("error") > 0).alias("positive"))


@query("SELECT 4::BIGINT AS settings, 2 AS models, 2 AS folds, 0 AS unknown")
def searched_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best learners with two settings each, two folds; all settings come from the grids."""
    _, path = _searched(spark, sf_dir)
    known = spark.createDataFrame([(f"{name}|{params}",) for name, c in default_candidates(grids=SEARCH_GRIDS).items() for params in setting_names(c)], "known string")
    cells = finished_cells(spark, f"{path}-cells").where("stage = 'grid'").withColumn("known", F.concat_ws("|", "model", "params"))
    folds = cells.groupBy("model", "params", "known").agg(F.count("*").alias("folds")).join(known.withColumn("is_known", F.lit(1)), "known", "left")
    return folds.agg(
        F.count("*").alias("settings"),
        F.count_distinct("model").cast("int").alias("models"),
        F.max("folds").cast("int").alias("folds"),
        F.count_if(F.col("is_known").isNull()).cast("int").alias("unknown"),
    )


@query("SELECT unnest(['shortlist', 'grid', 'test']) AS stage, unnest([4, 4, 2])::BIGINT AS rows, unnest([1, 1, 1])::BIGINT AS winners")
def searched_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per stage, and how many models are the winner: one, which has the least error of its stage after tuning."""
    winner, path = _searched(spark, sf_dir)
    board = spark.read.parquet(path)
    tested = board.where("test_score IS NOT NULL").withColumn("stage", F.lit("test"))
    best = board.where("stage = 'grid'").agg(F.min_by("model", "score")).scalar()
    right = (F.col("model") == winner) & (F.lit(winner) == best)
    return board.unionByName(tested).groupBy("stage").agg(F.count("*").alias("rows"), F.count_distinct(F.when(right, F.col("model"))).alias("winners"))


@lru_cache(maxsize=4)
def _streamed(spark: SparkSession, sf_dir: str) -> str:
    """Runs two rounds of new request files; a newer model is published between them."""
    _, run = trained(spark, sf_dir)
    registry = scratch_path(spark, "registry")
    source, output = scratch_path(spark, "incoming"), scratch_path(spark, "scores")
    payloads = _payloads(spark, sf_dir)
    checkpoint, cache = scratch_path(spark, "stream"), stream.ArtefactCache(spark, registry)
    for version, half in (("v1", 0), ("v2", 1)):
        artefacts.publish_artefacts(registry, version, run.transforms, run.model, spark)
        own = payloads.where(F.pmod("payload_id", F.lit(2)) == half).select("value")
        # Every line twice: equal lines of one file stay two payloads.
        own.withColumn("value", F.explode(F.array("value", "value"))).write.mode("append").text(source)
        scores = stream.start_scoring(
            stream.request_stream(spark, source), cache, output, checkpoint, inflation_factors(spark), lambda: frames.AS_OF
        )
        scores.awaitTermination()
    return output


@query(
    f"WITH {sql.LISTINGS}, {_RECORDS} SELECT route AS outcome, 2 * count(*) AS rows, 2 * count(*) AS ids FROM records GROUP BY route"
    " UNION ALL SELECT CASE WHEN id % 50 = 9 THEN 'corrupt' ELSE 'empty' END, 2 * count(*), 2 * count(*) FROM bikes"
    " WHERE id % 50 IN (7, 8, 9) GROUP BY 1"
)
def streamed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests scored as their files arrive, each sent twice, and those that give no record."""
    output = _streamed(spark, sf_dir)
    scored = spark.read.parquet(f"{output}/scored").select(F.col("route").alias("outcome"), "payload_id", "request_pos")
    none = F.lit(None).cast("bigint")
    refused = spark.read.parquet(f"{output}/rejected").select(F.col("payload_status").alias("outcome"), "payload_id", none.alias("request_pos"))
    both = scored.unionByName(refused).withColumn("one", F.struct("payload_id", "request_pos"))
    return both.groupBy("outcome").agg(F.count("*").alias("rows"), F.count_distinct("one").alias("ids"))


@query(
    f"WITH {sql.LISTINGS} SELECT id AS payload_id, CASE WHEN id % 50 = 9 THEN 'corrupt' ELSE 'empty' END AS payload_status"
    " FROM bikes WHERE id % 50 IN (7, 8, 9)"
)
def rejected_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the scoring job answers to payloads without a record."""
    _, run = trained(spark, sf_dir)
    return scoring.run_scoring(_payloads(spark, sf_dir), run.transforms, run.model, inflation_factors(spark), frames.AS_OF).rejected


@query(
    f"WITH {sql.LISTINGS}, {_RECORDS} SELECT CASE WHEN payload_id % 2 = 0 THEN 'v1' ELSE 'v2' END AS model_version,"
    " 2 * count(*) AS rows FROM records GROUP BY 1"
)
def streamed_model_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each batch is scored by the model that was newest when it started."""
    return spark.read.parquet(f"{_streamed(spark, sf_dir)}/scored").groupBy("model_version").agg(F.count("*").alias("rows"))
