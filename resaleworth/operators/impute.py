"""Chained forest imputation: each column with gaps is predicted from the others, in rounds.

The state of a chain is one table: a row number, all values as one array, and a mask of the gaps. It is written at the start and
after each round. In between, fitting a column replaces the values of its gaps where the rows lie, so that no row moves; the rows
are kept on the executors, and a lost part is made again from the last written state. A column is fitted again only when another
one has moved since.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import partial, reduce
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark import inheritable_thread_target, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasSeed
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
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from resaleworth.operators.encode import code_name, decode_labels, dictionary_table, encode_labels
from resaleworth.operators.fill import column_means, column_modes
from resaleworth.session import materialise, scratch_dir

INPUT, GUESS, ROW = "_inputs", "_guess", "_row"
# Codes are predicted digit by digit in this base, so that no forest has more classes.
DIGIT = 512
# Gaps per word of the mask.
WORD = 62
# Columns that are guessed in one piece of generated code. Java does not compile a method of more than 8,000 bytes but interprets it; a
# guess from 17 other columns takes about 1,000.
PIECE = 4


def gap_name(column: str) -> str:
    return f"{column}_gap"


def digits(classes: int | None) -> int:
    """Forests that a column needs: one for a number, one per digit of the largest code."""
    count = 1
    while classes is not None and classes > DIGIT**count:
        count += 1
    return count


def digit_of(code: Column, place: int) -> Column:
    return F.floor(code / DIGIT**place) % DIGIT


def _open(df: DataFrame, columns: Sequence[str], fill: Mapping[str, float]) -> DataFrame:
    """Mark the gaps, then fill them for the first round. A NaN is an error, as in the fit."""
    marks = {gap_name(name): F.col(name).isNull() for name in columns}

    def filled(name: str) -> Column:
        value = F.coalesce(F.col(name).cast("double"), F.lit(fill[name]))
        return F.when(F.isnan(value), F.raise_error(F.lit(f"NaN in {name}")).cast("double")).otherwise(value)

    return df.withColumns(marks).withColumns({name: filled(name) for name in columns})


def _guessed_value(place: int, classes: int | None) -> str:
    """The number, or the code from its predicted digits, rounded half-even and inside the known ones."""
    if classes is None:
        return f"{GUESS}{place}"
    code = " + ".join(f"{GUESS}{d} * {DIGIT**d}" for d in range(digits(classes)))
    return f"least(greatest(bround({code}), 0D), double({classes - 1}))"


def _predicted(assembled: DataFrame, forests: Sequence[Any]) -> DataFrame:
    for place, forest in enumerate(forests):
        assembled = forest.copy({forest.predictionCol: f"{GUESS}{place}"}).transform(assembled)
    return assembled


def _guessed(df: DataFrame, columns: Sequence[str], target: str, forests: Sequence[Any], classes: int | None) -> DataFrame:
    """Replace the gaps of ``target`` by the prediction; observed cells stay as they are.

    The vector is made by a deterministic function, unlike that of ``VectorAssembler``, so that the optimizer moves it and the forest's
    walk into the CASE: a row pays for its gaps only.
    """
    others = [F.col(name) for name in columns if name != target]
    predicted = _predicted(df.withColumn(INPUT, array_to_vector(F.array(*others))), forests)
    extra = ", ".join([target, INPUT, *[f"{GUESS}{place}" for place in range(len(forests))]])
    value = f"CASE WHEN {gap_name(target)} THEN {_guessed_value(0, classes)} ELSE {target} END AS {target}"
    return predicted.selectExpr(f"* EXCEPT ({extra})", value)


def in_pieces(df: DataFrame) -> DataFrame:
    """The same rows in the same parts; code that is generated for the steps before is a method of its own, apart from that for the steps behind.

    Spark ends a piece at an operator that is not generated. A coalesce to more parts than there are is one that does nothing.
    """
    return df.coalesce(2**31 - 1)


def in_threads(tasks: Sequence[Callable[[], Any]], threads: int = 8) -> list[Any]:
    """Submit independent Spark jobs side by side; results in task order."""
    if not tasks:
        return []
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPool(min(threads, len(tasks))) as pool:
        return pool.map(lambda task: task(), [inherit(task) for task in tasks])


class ChainState:
    """The rows of a chain with the newest guess in each gap, and guesses that came from elsewhere, by row number."""

    def __init__(self, df: DataFrame, columns: Sequence[str], fill: Mapping[str, float]):
        self.columns, self.guesses, self.kept = list(columns), {}, None
        bits = [F.when(F.col(name).isNull(), F.lit(1 << (i % WORD))).otherwise(F.lit(0)).cast("long") for i, name in enumerate(columns)]
        words = [reduce(lambda a, b: a.bitwiseOR(b), bits[at : at + WORD]) for at in range(0, len(bits), WORD)]
        values = [F.coalesce(F.col(name).cast("double"), F.lit(fill[name])) for name in columns]
        numbered = df.select(F.monotonically_increasing_id().alias(ROW), F.array(*values).alias("values"), F.array(*words).alias("gaps"))
        self.rows = materialise(numbered, "impute")

    def gap(self, target: str) -> Column:
        place = self.columns.index(target)
        return F.getbit(F.get("gaps", F.lit(place // WORD)), F.lit(place % WORD)) == 1

    def present(self) -> DataFrame:
        """All rows with the newest guess in each gap."""
        if not self.guesses:
            return self.rows
        each = [df.select(ROW, F.lit(self.columns.index(name)).alias("i"), "value") for name, df in self.guesses.items()]
        per_row = reduce(DataFrame.unionByName, each).groupBy(ROW).agg(F.map_from_entries(F.collect_list(F.struct("i", "value"))).alias("newest"))
        newest = F.transform("values", lambda value, i: F.coalesce(F.try_element_at(F.col("newest"), i), value))
        return self.rows.join(per_row, ROW, "left").select(ROW, "gaps", F.when(F.col("newest").isNull(), F.col("values")).otherwise(newest).alias("values"))

    def frame(self, target: str, *extra: str) -> DataFrame:
        """The other columns as a vector, the target's present value and whether it is a gap."""
        place = self.columns.index(target)
        others = F.concat(F.slice("values", F.lit(1), F.lit(place)), F.slice("values", F.lit(place + 2), F.lit(len(self.columns))))
        return self.present().select(ROW, *extra, array_to_vector(others).alias(INPUT), F.get("values", F.lit(place)).alias("y"), self.gap(target).alias("gap"))

    def fill(self, target: str, forests: Sequence[Any], classes: int | None) -> float:
        """Replace the gaps of ``target`` by new predictions; the largest move of them."""
        place = self.columns.index(target)
        predicted = _predicted(self.frame(target, "gaps", "values"), forests)
        filled = predicted.selectExpr(ROW, "gaps", "values", "y", f"CASE WHEN gap THEN {_guessed_value(0, classes)} ELSE y END AS new")
        values = F.array(*[F.col("new") if i == place else F.get("values", F.lit(i)) for i in range(len(self.columns))])
        rows = filled.select(ROW, "gaps", values.alias("values"), F.abs(F.col("new") - F.col("y")).alias("move")).persist()
        move = rows.agg(F.max("move")).first()[0]
        self._take(rows.drop("move"), rows)
        return float(move or 0.0)

    def store(self) -> None:
        """Write the present rows, so that nothing before them is needed any more."""
        self._take(materialise(self.present(), "imputed-state"), None)

    def _take(self, rows: DataFrame, kept: DataFrame | None) -> None:
        if self.kept is not None:
            self.kept.unpersist()
        self.rows, self.kept, self.guesses = rows, kept, {}


class ChainedForestImputer(Estimator, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Numbers are predicted from the other numbers, categories from the codes of the other categories.

    Columns are visited from the fewest gaps to the most, each using the values filled before it. A column moved if a filled
    value moved by more than ``tolerance`` of the largest observed one; the rounds end early once no column has another one
    that moved since its last fit. The model keeps the last forests of each column; columns without gaps in training get
    them too, since a request may leave any field out. Codes beyond ``DIGIT`` categories are predicted as digits.
    """

    numericalCols = Param(Params._dummy(), "numericalCols", "number columns", TypeConverters.toListString)
    categoricalCols = Param(Params._dummy(), "categoricalCols", "category columns", TypeConverters.toListString)
    rounds = Param(Params._dummy(), "rounds", "largest number of rounds", TypeConverters.toInt)
    numTrees = Param(Params._dummy(), "numTrees", "trees per forest", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of each tree", TypeConverters.toInt)
    tolerance = Param(Params._dummy(), "tolerance", "share of change that ends the rounds", TypeConverters.toFloat)

    @keyword_only
    def __init__(
        self,
        *,
        numericalCols=None,
        categoricalCols=None,
        rounds=None,
        numTrees=None,
        maxDepth=None,
        tolerance=None,
        seed=None,
    ):
        super().__init__()
        self._setDefault(
            numericalCols=[], categoricalCols=[], rounds=10, numTrees=100, maxDepth=5, tolerance=1e-3, seed=0
        )
        self._set(**self._input_kwargs)

    def _learner(self, classes: int | None) -> Any:
        settings = {
            "featuresCol": INPUT,
            "labelCol": "y",
            "predictionCol": GUESS,
            "numTrees": self.getOrDefault(self.numTrees),
            "maxDepth": self.getOrDefault(self.maxDepth),
            "seed": self.getSeed(),
        }
        # A number is split on all other columns, a category on a random subset, as is usual for either.
        if classes is None:
            return RandomForestRegressor(**settings, featureSubsetStrategy="all")
        return RandomForestClassifier(**settings, rawPredictionCol="", probabilityCol="")

    def _fit_column(self, frame: DataFrame, classes: int | None) -> list[Any]:
        observed = frame.where("not gap").select(INPUT, "y")
        if classes is None:
            return [self._learner(None).fit(observed)]
        forests = []
        for place in range(digits(classes)):
            kinds = min(DIGIT, -(-classes // DIGIT**place))
            digit = observed.withColumn("y", digit_of(F.col("y"), place).cast("double"))
            forests.append(self._learner(kinds).fit(digit.withMetadata("y", {"ml_attr": {"type": "nominal", "num_vals": max(2, kinds)}})))
        return forests

    def _refit(self, state: ChainState, target: str, classes: int | None) -> tuple[list[Any], float]:
        """New forests of a column and the largest move of its filled values."""
        forests = self._fit_column(state.frame(target), classes)
        return forests, state.fill(target, forests, classes)

    def _chain(
        self, df: DataFrame, columns: list[str], fill: dict[str, float], classes: dict[str, int]
    ) -> list[tuple[str, list[Any]]]:
        """Forests in visiting order."""
        if len(columns) < 2:
            return []
        marks = [F.sum(F.col(name).isNull().cast("bigint")).alias(name) for name in columns]
        ends = [f(F.col(name).cast("double")).alias(f"_{name}_{f.__name__}") for name in columns for f in (F.min, F.max)]
        stats = df.agg(F.count("*").alias("_rows"), *marks, *ends).first()
        # A column that is empty or has one value only needs its first fill.
        learnable = [name for name in columns if stats["_rows"] and stats[name] < stats["_rows"] and stats[f"_{name}_min"] < stats[f"_{name}_max"]]
        order = sorted(learnable, key=lambda name: (stats[name], columns.index(name)))
        gappy = [name for name in order if stats[name] > 0]
        reach = max((abs(stats[f"_{name}_{end}"] or 0.0) for name in columns for end in ("min", "max")), default=0.0)

        state = ChainState(df, columns, fill)
        forests: dict[str, list[Any]] = {}
        fitted, moved, clock = {}, {}, 0
        for _ in range(self.getOrDefault(self.rounds)):
            before = clock
            for target in gappy:
                if target in fitted and all(moved.get(other, 0) <= fitted[target] for other in gappy if other != target):
                    continue
                clock += 1
                forests[target], move = self._refit(state, target, classes.get(target))
                fitted[target] = clock
                if move > self.getOrDefault(self.tolerance) * reach:
                    moved[target] = clock
            if clock == before:
                break
            state.store()
        rest = [target for target in order if target not in forests]
        if rest:
            forests.update(zip(rest, in_threads([partial(self._fit_column, state.frame(target), classes.get(target)) for target in rest])))
        return [(target, forests[target]) for target in order]

    def _fit(self, dataset: DataFrame) -> "ChainedForestImputerModel":
        numerical = self.getOrDefault(self.numericalCols)
        categorical = self.getOrDefault(self.categoricalCols)
        scratch_dir(dataset.sparkSession)
        dictionary = materialise(dictionary_table(dataset, categorical), "dictionaries")
        counts = {row["column_name"]: row["n"] for row in dictionary.groupBy("column_name").agg(F.count("*").alias("n")).collect()}
        codes = [code_name(name) for name in categorical]
        classes = {code_name(name): counts.get(name, 0) for name in categorical}
        base = materialise(
            encode_labels(dataset.select(*numerical, *categorical), dictionary, categorical).select(*numerical, *codes), "observed"
        )
        means = column_means(base, numerical)
        modes = column_modes(base, codes)
        fill = {name: float(value or 0.0) for name, value in {**means, **modes}.items()}
        # Numbers and categories never look at each other, so both chains run at once.
        chains = in_threads(
            [
                partial(self._chain, base.select(*columns), columns, fill, kinds)
                for columns, kinds in ((numerical, {}), (codes, classes))
            ]
        )
        model = ChainedForestImputerModel()
        model.numerical, model.categorical = list(numerical), list(categorical)
        model.dictionary, model.classes, model.fill, model.chains = dictionary, classes, fill, chains
        return model


class _ImputerWriter(MLWriter):
    def __init__(self, instance: "ChainedForestImputerModel"):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        model = self.instance
        extra = {
            "numerical": model.numerical,
            "categorical": model.categorical,
            "classes": model.classes,
            "fill": model.fill,
            "targets": [[target for target, _ in chain] for chain in model.chains],
        }
        DefaultParamsWriter.saveMetadata(model, path, self.sc, extraMetadata=extra)
        model.dictionary.write.partitionBy("column_name").parquet(f"{path}/dictionary")
        saves = [
            partial(forest.write().save, f"{path}/forests/{target}/{place}")
            for chain in model.chains
            for target, forests in chain
            for place, forest in enumerate(forests)
        ]
        in_threads(saves)


class _ImputerReader(MLReader):
    def load(self, path: str) -> "ChainedForestImputerModel":
        metadata = DefaultParamsReader.loadMetadata(path, self.sc)
        model = ChainedForestImputerModel()
        model._resetUid(metadata["uid"])
        for name in ("numerical", "categorical", "classes", "fill"):
            setattr(model, name, metadata[name])
        model.dictionary = self.sparkSession.read.schema("value string, code bigint, column_name string").parquet(f"{path}/dictionary")
        kinds = (RandomForestRegressionModel, RandomForestClassificationModel)
        places = [(kind, target, place) for kind, targets in zip(kinds, metadata["targets"]) for target in targets for place in range(digits(model.classes.get(target)))]
        loaded = in_threads([partial(kind.load, f"{path}/forests/{target}/{place}") for kind, target, place in places])
        forests: dict[str, list[Any]] = {}
        for (_, target, _), forest in zip(places, loaded, strict=True):
            forests.setdefault(target, []).append(forest)
        model.chains = [[(target, forests[target]) for target in targets] for targets in metadata["targets"]]
        return model


class ChainedForestImputerModel(Model, MLReadable, MLWritable):
    """Fills every gap; categories are encoded, filled and decoded alike in training and scoring."""

    numerical: list[str]
    categorical: list[str]
    dictionary: DataFrame
    classes: dict[str, int]
    fill: dict[str, float]
    chains: list[list[tuple[str, list[Any]]]]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        codes = [code_name(name) for name in self.categorical]
        work = in_pieces(encode_labels(in_pieces(dataset), self.dictionary, self.categorical))
        for columns, chain in zip((self.numerical, codes), self.chains):
            work = _open(work, columns, self.fill)
            for at, (target, forests) in enumerate(chain):
                work = _guessed(in_pieces(work) if at % PIECE == 0 else work, columns, target, forests, self.classes.get(target))
        return in_pieces(decode_labels(in_pieces(work), self.dictionary, self.categorical).select(*dataset.columns))

    def write(self) -> MLWriter:
        return _ImputerWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ImputerReader()
