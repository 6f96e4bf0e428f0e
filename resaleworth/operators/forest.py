"""Quantile regression forest: a forest for the structure, a leaf table for the distribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import Column, DataFrame, functions as F

from resaleworth import config
from resaleworth.session import materialise

LEAVES = "_leaves"
MEAN = "_mean"
# Largest leaf table that travels with the tasks as one value (8 bytes per leaf).
LOOKUP_LIMIT = 2_000_000
# Deepest tree that Spark grows.
MAX_DEPTH = 30


def leaf_ids(df: DataFrame, *columns: str | Column) -> DataFrame:
    """One row per input row and tree, with the leaf the row falls into."""
    return df.select(*columns, F.posexplode(vector_to_array(LEAVES)).alias("tree", "leaf")).withColumn(
        "leaf", F.col("leaf").cast("int")
    )


def sampled_leaf_table(leafed: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """(tree, leaf, y, samples): one training label per leaf, drawn by the hash of the row key.

    The rows of a leaf merge map-side, so a leaf that holds most of the data is no hot spot.
    """
    draw = F.xxhash64(*keys, "tree")
    return (
        leaf_ids(leafed, *keys, label)
        .groupBy("tree", "leaf")
        .agg(F.min_by(F.col(label).cast("double"), draw).alias("y"), F.count("*").alias("samples"))
    )


def sketched_leaf_table(leafed: DataFrame, label: str, accuracy: int) -> DataFrame:
    """(tree, leaf, sketch, samples): a mergeable sketch of all training labels of a leaf; exact up to about ``accuracy`` of them.

    Rows merge into sketches map-side, so a leaf moves as one sketch per task whatever it holds.
    """
    each = leaf_ids(leafed, label).groupBy("tree", "leaf")
    return each.agg(F.kll_sketch_agg_double(F.col(label).cast("double"), F.lit(accuracy)).alias("sketch"), F.count("*").alias("samples"))


def _quantile(ordered: Column, size: int, q: float) -> Column:
    """Linear interpolation between the neighbours in a sorted array."""
    place = q * (size - 1)
    low = int(place)
    if low == size - 1 or place == low:
        return F.get(ordered, F.lit(low))
    below, above = F.get(ordered, F.lit(low)), F.get(ordered, F.lit(low + 1))
    return below + (above - below) * (place - low)


class QuantileForest(
    Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable
):
    """``keyCols`` identify a row: they decide which label a leaf keeps."""

    numTrees = Param(Params._dummy(), "numTrees", "trees in the forest", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of each tree", TypeConverters.toInt)
    minInfoGain = Param(Params._dummy(), "minInfoGain", "smallest gain of a split", TypeConverters.toFloat)
    maxBins = Param(Params._dummy(), "maxBins", "split points tried per column", TypeConverters.toInt)
    minLeafShare = Param(
        Params._dummy(), "minLeafShare", "smallest share of the rows in a leaf; a tree has 1/share leaves at most", TypeConverters.toFloat
    )
    salts = Param(Params._dummy(), "salts", "parts of a leaf when the leaf table is joined", TypeConverters.toInt)
    keyCols = Param(Params._dummy(), "keyCols", "columns that identify a row", TypeConverters.toListString)
    quantiles = Param(Params._dummy(), "quantiles", "predicted quantiles", TypeConverters.toListFloat)
    leafLabels = Param(
        Params._dummy(), "leafLabels", "drawn: one label per leaf; all: a sketch of all labels of a leaf", TypeConverters.toString
    )
    sketchAccuracy = Param(Params._dummy(), "sketchAccuracy", "size of a sketch; the rank error is about 2.3 over it", TypeConverters.toInt)

    @keyword_only
    def __init__(
        self,
        *,
        featuresCol=None,
        labelCol=None,
        predictionCol=None,
        numTrees=None,
        maxDepth=None,
        minInfoGain=None,
        maxBins=None,
        minLeafShare=None,
        salts=None,
        keyCols=None,
        quantiles=None,
        leafLabels=None,
        sketchAccuracy=None,
        seed=None,
    ):
        super().__init__()
        if leafLabels not in (None, "drawn", "all"):
            raise ValueError(f"leafLabels is {leafLabels!r}, not drawn or all")
        self._setDefault(
            labelCol=config.LABEL,
            leafLabels="drawn",
            sketchAccuracy=200,
            numTrees=100,
            maxDepth=MAX_DEPTH,
            minInfoGain=0.0,
            maxBins=64,
            minLeafShare=1e-4,
            salts=16,
            keyCols=["id"],
            quantiles=list(config.SCORING_QUANTILES),
            seed=42,
        )
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "QuantileForestModel":
        keys, label = self.getOrDefault(self.keyCols), self.getLabelCol()
        depth = self.getOrDefault(self.maxDepth)
        if depth > MAX_DEPTH:
            raise ValueError(f"maxDepth is {depth}, trees stop at {MAX_DEPTH}")
        rows = dataset.select(*keys, self.getFeaturesCol(), label)
        forest = RandomForestRegressor(
            featuresCol=self.getFeaturesCol(),
            labelCol=label,
            predictionCol=MEAN,
            leafCol=LEAVES,
            numTrees=self.getOrDefault(self.numTrees),
            maxDepth=depth,
            minWeightFractionPerNode=self.getOrDefault(self.minLeafShare),
            minInfoGain=self.getOrDefault(self.minInfoGain),
            maxBins=self.getOrDefault(self.maxBins),
            featureSubsetStrategy="all",
            # Each level starts from the node that a row has reached, instead of walking every tree again from its root.
            cacheNodeIds=True,
            seed=self.getSeed(),
        ).fit(rows)
        if self.getOrDefault(self.leafLabels) == "all":
            table = sketched_leaf_table(forest.transform(rows), label, self.getOrDefault(self.sketchAccuracy))
        else:
            table = sampled_leaf_table(forest.transform(rows), keys, label)
        leaves = materialise(table, "leaves")
        return self._copyValues(QuantileForestModel.of(forest, leaves))


class QuantileForestModel(Model, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed, MLReadable, MLWritable):
    """Adds ``quantile_values``, one per requested quantile, and the median as the prediction."""

    numTrees = QuantileForest.numTrees
    maxDepth = QuantileForest.maxDepth
    minInfoGain = QuantileForest.minInfoGain
    maxBins = QuantileForest.maxBins
    minLeafShare = QuantileForest.minLeafShare
    salts = QuantileForest.salts
    keyCols = QuantileForest.keyCols
    quantiles = QuantileForest.quantiles
    leafLabels = QuantileForest.leafLabels
    sketchAccuracy = QuantileForest.sketchAccuracy

    forest: RandomForestRegressionModel
    leaves: DataFrame
    leaf_count: int
    dense: bool

    def __init__(self):
        super().__init__()
        self._setDefault(
            labelCol=config.LABEL,
            salts=16,
            keyCols=["id"],
            quantiles=list(config.SCORING_QUANTILES),
        )

    @classmethod
    def of(cls, forest: RandomForestRegressionModel, leaves: DataFrame) -> "QuantileForestModel":
        model = cls()
        model.forest, model.leaves = forest, leaves
        per_tree = leaves.groupBy("tree").agg(F.count("*").alias("n"), F.max("leaf").alias("last"))
        total, dense = per_tree.agg(F.sum("n"), F.bool_and(F.col("n") == F.col("last") + 1)).first()
        model.leaf_count, model.dense = int(total), bool(dense)
        return model

    @property
    def trees(self) -> int:
        return self.forest.getNumTrees

    def with_keys(self, *keys: str) -> "QuantileForestModel":
        """The same model for rows that are identified by other columns."""
        other = self.copy()
        other._set(keyCols=list(keys))
        return other

    def with_quantiles(self, quantiles: Sequence[float]) -> "QuantileForestModel":
        other = self.copy()
        other._set(quantiles=list(quantiles))
        return other

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if "sketch" in self.leaves.columns:
            values = self.predict_by_sketch(dataset)
        elif self.dense and self.leaf_count <= LOOKUP_LIMIT:
            values = self.predict_by_lookup(dataset)
        else:
            values = self.predict_by_join(dataset)
        wanted = self.getOrDefault(self.quantiles)
        middle = min(range(len(wanted)), key=lambda i: abs(wanted[i] - 0.5))
        return values.withColumn(self.getPredictionCol(), F.get("quantile_values", F.lit(middle)))

    def predict_by_lookup(self, dataset: DataFrame) -> DataFrame:
        """A leaf table of checked size becomes one array per tree: no row moves and none fans out."""
        per_tree = self.leaves.groupBy("tree").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("leaf", "y"))), lambda e: e["y"]).alias("ys")
        )
        table = per_tree.agg(
            F.transform(F.array_sort(F.collect_list(F.struct("tree", "ys"))), lambda e: e["ys"]).alias("table")
        ).scalar()
        # A lambda takes no subquery, only a column; the optimizer folds the column into the lookup.
        drawn = F.transform(
            vector_to_array(LEAVES), lambda leaf, tree: F.get(F.get("_table", tree), leaf.cast("int"))
        )
        ordered = F.col("_drawn")
        wanted = [_quantile(ordered, self.trees, q) for q in self.getOrDefault(self.quantiles)]
        return (
            self.forest.transform(dataset)
            .withColumn("_table", table)
            .withColumn("_drawn", F.sort_array(drawn))
            .drop("_table", LEAVES, MEAN)
            .withColumn("quantile_values", F.array(*wanted))
            .drop("_drawn")
        )

    def _met(self, dataset: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
        """Rows with a number of their own, stored once, and (_row, column) of every leaf that each of them reaches.

        The leaf table is joined on (tree, leaf); the salt spreads leaves that most rows reach.
        """
        salts = self.getOrDefault(self.salts)
        rows = materialise(self.forest.transform(dataset).withColumn("_row", F.monotonically_increasing_id()), "leafed")
        reached = leaf_ids(rows, "_row").withColumn("salt", F.pmod("_row", F.lit(salts)).cast("int"))
        table = self.leaves.select("tree", "leaf", column, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        return rows, reached.join(table, ["tree", "leaf", "salt"]).select("_row", column)

    def predict_by_sketch(self, dataset: DataFrame) -> DataFrame:
        """Quantiles of all training labels in the leaves that a row reaches, a label counting once per tree.

        The sketches of the leaves are merged row by row, so no pair of a row and a leaf mate is made, and the way is the
        same for tables of any size.
        """
        rows, met = self._met(dataset, "sketch")
        merged = met.groupBy("_row").agg(F.kll_merge_agg_double("sketch").alias("_sketch"))
        wanted = F.array(*[F.lit(float(q)) for q in self.getOrDefault(self.quantiles)])
        values = merged.select("_row", F.kll_sketch_get_quantile_double("_sketch", wanted).alias("quantile_values"))
        return rows.drop(LEAVES, MEAN).join(values, "_row", "left").drop("_row")

    def predict_by_join(self, dataset: DataFrame) -> DataFrame:
        """Larger tables of drawn labels are joined; repeated and null keys stay apart and every row comes back."""
        rows, met = self._met(dataset, "y")
        drawn = met.groupBy("_row").agg(F.sort_array(F.collect_list("y")).alias("_drawn"))
        wanted = [_quantile(F.col("_drawn"), self.trees, q) for q in self.getOrDefault(self.quantiles)]
        values = drawn.select("_row", F.array(*wanted).alias("quantile_values"))
        return rows.drop(LEAVES, MEAN).join(values, "_row", "left").drop("_row")

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader()


class _ForestWriter(MLWriter):
    def __init__(self, instance: QuantileForestModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sc)
        self.instance.forest.write().save(f"{path}/forest")
        self.instance.leaves.write.parquet(f"{path}/leaves")


class _ForestReader(MLReader):
    def load(self, path: str) -> QuantileForestModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sc)
        forest = RandomForestRegressionModel.load(f"{path}/forest")
        leaves = self.sparkSession.read.parquet(f"{path}/leaves")
        model = QuantileForestModel.of(forest, leaves)
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
