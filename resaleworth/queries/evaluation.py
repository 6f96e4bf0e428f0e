"""Error, coverage, ranking and leaderboard queries with their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from resaleworth import config
from resaleworth.operators import evaluate as ev, selection as sel
from resaleworth.operators.ranking import with_row_number
from resaleworth.operators.sampling import fold_of
from resaleworth.plans.evaluation import evaluation_report
from resaleworth.queries import frames, oracle_base as sql
from resaleworth.queries.registry import Registry

query = Registry()


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({name: F.round(name, digits) for name in names})


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.error_rows(frames.stand_in_results(spark, sf_dir))


@query(f"WITH {sql.RESULTS} SELECT * REPLACE (round(sales_price, 6) AS sales_price) FROM flagged")
def result_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(frames.stand_in_results(spark, sf_dir), "sales_price")


@query(f"WITH {sql.RESULTS} SELECT count(*) AS rows, round(avg(in_range), 9) AS share_in_range FROM flagged")
def interval_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.interval_check(frames.stand_in_results(spark, sf_dir)), "share_in_range", digits=9)


@query(f"WITH {sql.RESULTS} SELECT in_range, count(*) AS rows FROM flagged GROUP BY in_range")
def in_range_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.stand_in_results(spark, sf_dir).groupBy("in_range").agg(F.count("*").alias("rows"))


@query(
    f"WITH {sql.RESULTS} SELECT id, round(difference, 6) AS difference, round(difference_pct, 6) AS difference_pct FROM errors"
)
def error_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_errors(spark, sf_dir).select("id", "difference", "difference_pct"), "difference", "difference_pct")


@query(f"WITH {sql.RESULTS} SELECT id, difference_bin FROM binned")
def error_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _errors(spark, sf_dir).select("id", "difference_bin")


@query(
    f"WITH {sql.RESULTS} SELECT id, CAST(trunc(coalesce(sales_price, 0)) AS BIGINT) AS sales_price,"
    " CAST(trunc(prediction) AS BIGINT) AS prediction, CAST(trunc(low) AS BIGINT) AS low, CAST(trunc(high) AS BIGINT) AS high,"
    " CAST(in_range AS BIGINT) AS in_range, CAST(trunc(difference) AS BIGINT) AS difference,"
    " CAST(trunc(difference_pct) AS BIGINT) AS difference_pct, difference_bin FROM binned"
)
def whole_number_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.whole_numbers(ev.complete_rows(_errors(spark, sf_dir)), keep=("id",))


@query(f"WITH {sql.RESULTS} SELECT round(avg(abs(sales_price - prediction) / abs(sales_price)), 9) AS mape FROM results")
def mape_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.stand_in_results(spark, sf_dir).agg(
        F.round(ev.mape(F.col("sales_price"), F.col("prediction")), 9).alias("mape")
    )


@query(
    f"WITH {sql.RESULTS} SELECT count(*) AS rows, round(avg(abs((sales_price - prediction) / sales_price)) * 100, 7) AS mape_pct,"
    " round(100 * avg(CASE WHEN sales_price BETWEEN low AND high THEN 1 ELSE 0 END), 7) AS coverage_pct,"
    " NULL::DOUBLE AS quantile_coverage_pct FROM results"
)
def error_and_coverage_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = evaluation_report(frames.stand_in_results(spark, sf_dir))
    return _rounded(report, "mape_pct", "coverage_pct", digits=7)


@query(
    f"WITH {sql.RESULTS}, s AS (SELECT 'sales_price' AS series, sales_price AS v FROM results UNION ALL"
    " SELECT 'prediction', prediction FROM results), e AS (SELECT series, min(v) AS lo, max(v) AS hi FROM s GROUP BY series)"
    " SELECT s.series, CAST(least(floor((v - lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin,"
    " round(lo + least(floor((v - lo) / ((hi - lo) / 30)), 29) * ((hi - lo) / 30), 4) AS bin_low,"
    " round(lo + (least(floor((v - lo) / ((hi - lo) / 30)), 29) + 1) * ((hi - lo) / 30), 4) AS bin_high, count(*) AS rows"
    " FROM s JOIN e ON s.series = e.series GROUP BY ALL"
)
def price_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = ev.histogram(frames.stored_results(spark, sf_dir), ["sales_price", "prediction"])
    return _rounded(bins, "bin_low", "bin_high", digits=4)


@query(
    f"WITH {sql.RESULTS}, s AS (SELECT 'sales_price' AS series, sales_price AS v FROM results UNION ALL"
    " SELECT 'prediction', prediction FROM results),"
    " e AS (SELECT series, count(*) AS n, stddev_samp(v) * pow(count(*), -0.2::DOUBLE) AS h, min(v) AS lo, max(v) AS hi FROM s GROUP BY series),"
    " g AS (SELECT e.*, lo - 3 * h + i * ((hi - lo + 6 * h) / 49) AS x FROM e CROSS JOIN range(50) AS r(i))"
    " SELECT g.series, round(g.x, 4) AS x, round(sum(exp(-pow((s.v - g.x) / h, 2) / 2)) / (n * h * sqrt(2 * pi())), 10) AS density"
    " FROM g JOIN s ON s.series = g.series GROUP BY g.series, g.x, n, h"
)
def price_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = ev.density_curve(frames.stored_results(spark, sf_dir), ["sales_price", "prediction"], points=50)
    return curve.withColumns({"x": F.round("x", 4), "density": F.round("density", 10)})


@query(
    f"WITH {sql.RESULTS} SELECT difference_bin, count(*) AS rows, round(avg(difference), 4) AS mean_difference,"
    " round(avg(difference_pct), 4) AS mean_difference_pct, round(count(*) / sum(count(*)) OVER (), 9) AS share"
    " FROM binned GROUP BY difference_bin"
)
def error_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _rounded(ev.error_breakdown(_errors(spark, sf_dir)), "mean_difference", "mean_difference_pct", digits=4)
    return _rounded(table, "share", digits=9)


@query(
    f"WITH {sql.RESULTS} SELECT id, round(sales_price, 6) AS sales_price,"
    " round((sales_price - prediction) / sales_price * 100, 6) AS rel_error_pct FROM results"
)
def error_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = ev.error_scatter(frames.stand_in_results(spark, sf_dir), ["id"])
    return _rounded(points, "sales_price", "rel_error_pct")


@query(
    f"WITH {sql.RESULTS} SELECT row_number() OVER (ORDER BY sales_price, id) AS row_no, id, round(sales_price, 6) AS sales_price,"
    " prediction, low, high FROM results"
)
def price_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows numbered by sale price, as the interval plot needs them."""
    results = frames.stored_results(spark, sf_dir).drop("in_range")
    return _rounded(with_row_number(results, ["sales_price", "id"]), "sales_price")


# Stand-in candidates: fixed shares of the list price, scored per fold over all sales.
_SHARES = {"share_40": 0.4, "share_50": 0.5, "share_60": 0.6, "share_70": 0.7}
_FOLDS = (
    f"WITH {sql.CLEAN}, candidates(model, share) AS (VALUES "
    + ", ".join(f"('{name}', {share}::DOUBLE)" for name, share in _SHARES.items())
    + "), folds AS (SELECT model, CAST('0x' || substr(md5('42' || id::VARCHAR), 1, 8) AS BIGINT) % 10000 % 3 AS fold,"
    " avg(abs(sales_price - msrp * share) / abs(sales_price)) AS score FROM clean, candidates GROUP BY 1, 2),"
    " means AS (SELECT model, round(avg(score), 9) AS score FROM folds GROUP BY model)"
)


def _fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = frames.cleaned(spark, sf_dir).withColumn("fold", fold_of(F.col("id"), 3, config.SHUFFLE_SEED))
    guesses = F.explode(
        F.array(
            *[
                F.struct(F.lit(name).alias("model"), (F.col("msrp") * share).alias("prediction"))
                for name, share in _SHARES.items()
            ]
        )
    )
    rows = sales.select("fold", "sales_price", guesses.alias("g")).select("fold", "sales_price", "g.*")
    return rows.groupBy("model", "fold").agg(ev.mape(F.col("sales_price"), F.col("prediction")).alias("score"))


def _means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(sel.mean_scores(_fold_scores(spark, sf_dir)), "score", digits=9)


@query(f"{_FOLDS} SELECT * FROM means")
def mean_fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _means(spark, sf_dir)


@query(f"{_FOLDS} SELECT * FROM means ORDER BY score, model LIMIT 2")
def top_two_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.top_models(_means(spark, sf_dir))


@query(f"{_FOLDS} SELECT arg_min(model, abs(score)) AS model, min(abs(score)) AS abs_score FROM means")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.best_model(_means(spark, sf_dir))
