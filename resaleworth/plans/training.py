"""The training job: extract, clean, features, split, oversample, transforms, model."""

from __future__ import annotations

import dataclasses
import datetime as dt
import hashlib
import json
from dataclasses import dataclass
from typing import Any

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, functions as F

from resaleworth import config
from resaleworth.operators import clean, features as feat, sampling
from resaleworth.operators.calibrate import widening, with_calibration
from resaleworth.operators.encode import indicator_stages
from resaleworth.operators.evaluate import MapeEvaluator
from resaleworth.operators.impute import ChainedForestImputer
from resaleworth.operators.pricing import price_by_model
from resaleworth.operators.scale import ColumnScaler
from resaleworth.plans.extract import SALE_ORDER, sales_extract
from resaleworth.session import materialise, spread
from resaleworth.sources import artefacts
from resaleworth.sources.tables import ListingTables

ROW_KEYS = ("id", "copy_no")
# Columns by which the rows of a snapshot's file are ordered, before their keys.
LOCALITY = ("msrp",)
# Raise this when the steps of a run change, so that runs published before are not taken for new ones.
RECIPE = 5


@dataclass(frozen=True)
class ImputationSettings:
    rounds: int = 10
    num_trees: int = 100
    max_depth: int = 5
    seed: int = 0


@dataclass(frozen=True)
class TrainingSettings:
    """All that a run may be told. They are stored with its artefacts, and scoring reads them back."""

    categorical: tuple[str, ...] = config.CATEGORICAL
    numerical: tuple[str, ...] = config.NUMERICAL
    label: str = config.LABEL
    bounds: config.PriceBounds = config.BOUNDS
    zero_is_missing: bool = True
    test_share: float = config.TEST_SHARE
    split_seed: int = config.SPLIT_SEED
    recent_days: int = config.RECENT_DAYS
    recent_copies: int = config.RECENT_COPIES
    imputation: ImputationSettings = ImputationSettings()
    # Share of the train rows that a quantile model does not see and that widen its interval to ``coverage``; 0: none do.
    calibration_share: float = 0.0
    coverage: float = 0.7

    def as_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> "TrainingSettings":
        values = json.loads(text)
        nested = {"bounds": config.PriceBounds(**values["bounds"]), "imputation": ImputationSettings(**values["imputation"])}
        return cls(**{**values, **{name: tuple(values[name]) for name in ("categorical", "numerical")}, **nested})


def labelled_features(
    tables: ListingTables, factors: DataFrame, as_of: dt.date, settings: TrainingSettings = TrainingSettings()
) -> DataFrame:
    """One row per sold listing: features, label, creation time and split."""
    # The feature step needs its inputs whether or not they are features themselves.
    categorical, numerical = (tuple(dict.fromkeys([*own, *all_])) for own, all_ in ((settings.categorical, config.CATEGORICAL), (settings.numerical, config.NUMERICAL)))
    cleaned = clean.clean_sales(
        sales_extract(tables), factors, SALE_ORDER, categorical=categorical, numerical=numerical, label=settings.label, bounds=settings.bounds
    )
    engineered = feat.engineer_features(cleaned, factors, as_of, zero_is_missing=settings.zero_is_missing)
    unused = [name for name in (*categorical, *numerical) if name not in (*settings.categorical, *settings.numerical)]
    rows = feat.training_rows(engineered, settings.label).drop(*unused)
    return sampling.with_split(rows, test_share=settings.test_share, seed=settings.split_seed)


def training_data(
    tables: ListingTables, factors: DataFrame, as_of: dt.date, settings: TrainingSettings = TrainingSettings()
) -> DataFrame:
    """Train rows, recent ones repeated, and test rows once; all in one plan."""
    rows = labelled_features(tables, factors, as_of, settings)
    repeated = (F.col("split") == "train") & sampling.is_recent(F.col("bike_created_at"), as_of, settings.recent_days)
    return sampling.oversample(rows, repeated, settings.recent_copies).drop("bike_created_at")


def transform_pipeline(settings: TrainingSettings = TrainingSettings()) -> Pipeline:
    """Impute, indicators, scaling; msrp is scaled robustly and then to its own range."""
    categorical, numerical, imputation = list(settings.categorical), list(settings.numerical), settings.imputation
    others = [name for name in numerical if name != "msrp"]
    price = [
        ColumnScaler(inputCols=["msrp"], method="robust"),
        ColumnScaler(inputCols=["msrp"], method="minmax", low=0.0, high=settings.bounds.msrp_max),
    ]
    return Pipeline(
        stages=[
            ChainedForestImputer(
                numericalCols=numerical,
                categoricalCols=categorical,
                rounds=imputation.rounds,
                numTrees=imputation.num_trees,
                maxDepth=imputation.max_depth,
                seed=imputation.seed,
            ),
            *indicator_stages(categorical),
            ColumnScaler(inputCols=others, method="minmax"),
            *(price if "msrp" in numerical else []),
            VectorAssembler(inputCols=[*[f"{name}_onehot" for name in categorical], *numerical], outputCol="features"),
        ]
    )


def fit_transforms(data: DataFrame, pipeline: Pipeline) -> tuple[PipelineModel, DataFrame]:
    """Fit on the train rows only, apply to all.

    The imputed rows are written once: the later stages make several passes to fit, and none of
    them should walk all the imputation forests again.
    """
    imputer, *others = pipeline.getStages()
    fill = imputer.fit(data.where(F.col("split") == "train"))
    imputed = materialise(fill.transform(data), "imputed")
    rest = Pipeline(stages=others).fit(imputed.where(F.col("split") == "train"))
    return PipelineModel([fill, *rest.stages]), rest.transform(imputed)


def train_model(transformed: DataFrame, learner: Estimator, label: str = config.LABEL) -> tuple[Any, float]:
    """The fitted model and its error on the rows it was fitted on (median for a quantile model)."""
    model = learner.fit(transformed)
    return model, MapeEvaluator(labelCol=label).evaluate(model.transform(transformed))


def train_calibrated(train: DataFrame, learner: Estimator, settings: "TrainingSettings") -> tuple[Any, float, float | None]:
    """The model, its error, and the widening of its interval if ``settings`` hold rows back for that."""
    if not settings.calibration_share:
        return *train_model(train, learner, settings.label), None
    marked = with_calibration(train, settings.calibration_share)
    model, error = train_model(marked.where("not held").drop("held"), learner, settings.label)
    # Copies of a recent row are the same row: it counts once.
    held = price_by_model(marked.where("held AND copy_no = 0").select(*ROW_KEYS, settings.label, "features"), model)
    return model, error, widening(held, settings.coverage, settings.label)


@dataclass(frozen=True)
class TrainingRun:
    version: str
    transforms: PipelineModel
    model: Any
    snapshot: str
    train_error: float | None
    settings: TrainingSettings = TrainingSettings()
    fitted: bool = True
    widening: float | None = None


def run_digest(data: DataFrame, learner: Estimator, as_of: dt.date, settings: TrainingSettings) -> str:
    """A name for what a run would learn: its rows in any order, its settings, its learner and day."""
    rows, total = data.agg(F.count("*"), F.sum(F.xxhash64(*data.columns).cast("decimal(38,0)"))).first()
    params = sorted((param.name, repr(value)) for param, value in learner.extractParamMap().items())
    text = json.dumps([RECIPE, rows, str(total), data.columns, settings.as_json(), type(learner).__name__, params, as_of.isoformat()])
    return hashlib.sha256(text.encode()).hexdigest()[:32]


def run_training(
    tables: ListingTables,
    factors: DataFrame,
    as_of: dt.date,
    root: str,
    version: str | None,
    learner: Estimator,
    settings: TrainingSettings = TrainingSettings(),
) -> TrainingRun:
    """Writes the snapshot with features and labels, then publishes transforms, model and manifest.

    Without a ``version`` the run is named by a digest of its rows, settings and learner. Where that digest is published
    already, by this session or another, nothing is fitted: the published run is loaded. Two sessions that start the same run write to
    folders of their own, and the pointer of the digest is created once: the later one takes over what the first has published.
    """
    spark = tables.bikes.sparkSession
    data = materialise(training_data(tables, factors, as_of, settings), "extracted")
    digest = run_digest(data, learner, as_of, settings)
    if version is None:
        published = artefacts.published_run(spark, root, digest)
        if published is not None:
            return load_run(spark, root, published)
        version = artefacts.version_name(digest)
    snapshot = f"{root}/snapshots/{version}"
    # Every later step reads one file of this table, or of one made from it, per task; files of one split each would be read in pairs.
    data = materialise(spread(data, ROW_KEYS), "prepared")
    artefacts.write_snapshot(data, f"{root}/prepared/{version}")
    transforms, transformed = fit_transforms(data, transform_pipeline(settings))
    # Trees split on the list price most of all, so rows of like price meet the same nodes: a task that takes them one after the other
    # finds the counters of a node still in its core's cache.
    near = [name for name in LOCALITY if name in settings.numerical]
    ordered = transformed.sortWithinPartitions("split", *near, *ROW_KEYS)
    artefacts.write_snapshot(ordered.select(*ROW_KEYS, settings.label, "features", "split"), snapshot)
    train = artefacts.read_snapshot(spark, snapshot, "train")
    model, error, wider = train_calibrated(train, learner, settings)
    manifest = {"settings": settings.as_json(), "digest": digest, "as_of": as_of.isoformat(), "train_error": error, "widening": wider}
    artefacts.publish_artefacts(root, version, transforms, model, spark, manifest)
    run = TrainingRun(version, transforms, model, snapshot, error, settings, widening=wider)
    first = artefacts.claim_run(spark, root, digest, version)
    return run if first == version else load_run(spark, root, first)


def load_run(spark: SparkSession, root: str, version: str) -> TrainingRun:
    """A published run: artefacts, snapshot and the settings in its manifest (the defaults for one without)."""
    transforms, model = artefacts.load_artefacts(spark, root, version)
    manifest = artefacts.read_manifest(spark, root, version)
    settings = TrainingSettings.from_json(manifest["settings"]) if "settings" in manifest else TrainingSettings()
    return TrainingRun(version, transforms, model, f"{root}/snapshots/{version}", manifest.get("train_error"), settings, False, manifest.get("widening"))
