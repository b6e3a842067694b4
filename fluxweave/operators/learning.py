"""Training, evaluating and applying the gesture classifier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxweave.dims import DEV, FEATURE_COLUMNS, FOREST_FEATURES, FOREST_TREES, PERF
from fluxweave.operators import features as fv
from fluxweave.operators import forests
from fluxweave.operators import messages as ms
from fluxweave.operators.ordering import hash_chunk, hash_order, with_row_number
from fluxweave.session import path_exists, shared_folder

# the most that Spark allows; trees end earlier, where their leaves are pure
DEPTH = 30


def _vectors(columns: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol="__vector", handleInvalid="keep")


def train_forest(
    train: DataFrame,
    columns: Sequence[str] = FEATURE_COLUMNS,
    label: str = "gesture",
    trees: int = FOREST_TREES,
    per_split: int = FOREST_FEATURES,
    depth: int = DEPTH,
    seed: int = 0,
    share: float = 1.0,
    identity: Sequence[str] = (),
) -> PipelineModel:
    """Random forest on the feature vectors.

    With ``share`` below 1, rows are picked by the hash of ``identity``.
    """
    rows = train if share >= 1 else train.filter(_unit(hash_order(*identity, seed=seed)) < share)
    forest = RandomForestClassifier(
        featuresCol="__vector",
        labelCol=label,
        numTrees=trees,
        featureSubsetStrategy=str(per_split),
        maxDepth=depth,
        seed=seed,
        cacheNodeIds=True,  # else every level walks all rows down all trees again
        checkpointInterval=-1,
    )
    return Pipeline(stages=[_vectors(columns), forest]).fit(rows.select(*columns, F.col(label).cast("double").alias(label)))


def _unit(digest: Column) -> Column:
    """A digest as a number in [0, 1), by its first 52 bits, which a double holds exactly."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def train_mask(df: DataFrame, identity: Sequence[str], share: float, seed: int = 0) -> DataFrame:
    """Random train/test split that can be repeated."""
    return df.withColumn("is_train", _unit(hash_order(*identity, seed=seed)) < share)


def load_or_train(spark: SparkSession, path: str, train: DataFrame, **options) -> PipelineModel:
    """The stored model; a new one is trained and stored only where the path does not exist.

    A model that is there but cannot be read is an error and stays as it is.
    """
    if path_exists(spark, path):
        return PipelineModel.load(path)
    model = train_forest(train, **options)
    model.save(path)
    return model


def classify(model: PipelineModel, vectors: DataFrame) -> DataFrame:
    """Vectors with the predicted state; works on a stream as well."""
    out = model.transform(vectors)
    return out.select(*vectors.columns, F.col("prediction").cast("int").alias("prediction"))


def gesture_score(model: PipelineModel, touches: DataFrame, width: float, tick: float) -> DataFrame:
    """State of every device at every tick of its performance, 0 where it is idle."""
    predicted = classify(model, fv.rolling_features(touches, width, tick)).select(
        PERF, DEV, "time", F.col("prediction").alias("gesture")
    )
    span = touches.groupBy(PERF, DEV).agg(F.min("time").alias("a"), F.max("time").alias("b"))
    whole = span.groupBy(PERF).agg(F.min("a").alias("a"), F.max("b").alias("b"))
    bounds = span.select(PERF, DEV).join(whole, PERF).select(
        PERF, DEV, fv.bin_start("a", tick).alias("lo"), fv.bin_start("b", tick).alias("hi")
    )
    grid = fv.time_grid(bounds, [PERF, DEV], "lo", "hi", tick)
    # the grid rows carry state 0, so a maximum per tick keeps the prediction
    both = predicted.unionByName(grid.withColumn("gesture", F.lit(0)).withColumn("__g", F.lit(1)), True)
    out = both.groupBy(PERF, DEV, "time").agg(F.max("gesture").alias("gesture"), F.max("__g").alias("__g"))
    return out.filter("__g = 1").drop("__g")


def stratified_folds(
    df: DataFrame, label: str, identity: Sequence[str], folds: int = 10, run: int = 0, digits: int = 5
) -> DataFrame:
    """Fold 0..k-1 so that every label is spread evenly, in a repeatable random order.

    Rows are numbered per label through chunks of the hash, so a label that
    holds most rows is still numbered side by side.
    """
    hashed = df.withColumn("__h", hash_order(*identity, seed=run))
    numbered = with_row_number(hashed, [label], ["__h", *identity], hash_chunk("__h", digits))
    return numbered.withColumn("fold", ((F.col("row_no") - 1) % folds).cast("int")).drop("__h", "row_no")


def shuffled_slices(
    df: DataFrame, identity: Sequence[str], slices: int = 10, run: int = 0, digits: int = 5
) -> DataFrame:
    """Equal slices of a random order; the remainder belongs to no test slice (fold NULL)."""
    hashed = df.withColumn("__h", hash_order(*identity, seed=run)).withColumn("__one", F.lit(1))
    numbered = with_row_number(hashed, ["__one"], ["__h", *identity], hash_chunk("__h", digits))
    size = df.agg(F.floor(F.count(F.lit(1)) / slices)).scalar()
    fold = F.floor((F.col("row_no") - 1) / F.greatest(size, F.lit(1))).cast("int")
    return numbered.withColumn("fold", F.when(fold < slices, fold)).drop("__h", "__one", "row_no")


def training_rows(folds: DataFrame, fold: int) -> DataFrame:
    """All rows outside one test fold, rows without a fold included."""
    return folds.filter(~F.col("fold").eqNullSafe(fold))


def bootstrap(df: DataFrame, identity: Sequence[str], seed: int = 0, digits: int = 5, size: int | None = None) -> DataFrame:
    """Sample with replacement of the same size (or ``size``), repeatable.

    Every draw is a row number made from a hash; draws join rows on it.
    """
    hashed = df.withColumn("__h", hash_order(*identity, seed=seed)).withColumn("__one", F.lit(1))
    numbered = with_row_number(hashed, ["__one"], ["__h", *identity], hash_chunk("__h", digits)).drop("__h", "__one")
    total = df.agg(F.count(F.lit(1))).scalar()
    draws = numbered.select(F.col("row_no").alias("draw"))
    if size is not None:
        draws = draws.filter(F.col("draw") <= size)
    digest = F.md5(F.concat_ws(":", F.lit(f"draw{seed}"), F.col("draw").cast("string")))
    number = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")  # 60 bits: every row can be drawn, whatever their number
    picked = draws.select("draw", (number % F.greatest(total, F.lit(1)) + 1).cast("long").alias("row_no"))
    return picked.join(numbered, "row_no").drop("row_no")


def folds_of_runs(df: DataFrame, label: str, identity: Sequence[str], folds: int = 10, runs: int = 10, digits: int = 5, row: str | None = None) -> DataFrame:
    """``df`` with ``folds`` array<int>: the row's stratified fold in every run, all runs numbered in one pass.

    ``identity``, or the column ``row``, names every row once; the folds of a
    run are those of ``stratified_folds`` for that run.
    """
    names = [row] if row else list(identity)
    light = df.select(*dict.fromkeys([*identity, *names]), label).withColumn("__run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    hashed = light.withColumn("__h", F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in identity], F.col("__run").cast("string"))))
    numbered = with_row_number(hashed, ["__run", label], ["__h", *dict.fromkeys([*identity, *names])], hash_chunk("__h", digits))
    fold = ((F.col("row_no") - 1) % folds).cast("int")
    lists = numbered.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("__run", fold.alias("fold")))).alias("__folds"))
    return df.join(lists.select(*names, F.col("__folds.fold").alias("folds")), names)


def cross_validate(
    df: DataFrame,
    columns: Sequence[str],
    label: str,
    identity: Sequence[str],
    folds: int = 10,
    runs: int = 1,
    trees: int = FOREST_TREES,
    per_split: int = FOREST_FEATURES,
    depth: int = DEPTH,
) -> DataFrame:
    """(run, fold, identity, label, prediction): every row by a forest that has not seen its fold of the run.

    The forests of all runs and folds are grown together (see ``forests``);
    labels are whole numbers, and rows without one are left out. Rows may share
    their identity or have none: they are numbered when they are written.
    """
    path, known = shared_folder(df.sparkSession, "labelled"), df.filter(F.col(label).isNotNull())
    known.select(*dict.fromkeys([*identity, label, *columns])).withColumn("__row", F.monotonically_increasing_id()).write.parquet(path)
    folded = folds_of_runs(df.sparkSession.read.parquet(path), label, identity, folds, runs, row="__row")
    return forests.cross_validate(folded, columns, label, identity, folds, runs, trees, per_split, depth)


def fold_scores(predictions: DataFrame, label: str) -> DataFrame:
    """Accuracy of each run and fold."""
    hit = (F.col(label) == F.col("prediction")).cast("double")
    return predictions.groupBy("run", "fold").agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def train_bayes(train: DataFrame, columns: Sequence[str], label: str) -> PipelineModel:
    """Gaussian naive Bayes; a text label (such as a device) is indexed first."""
    stages, target = [_vectors(columns)], label
    if dict(train.dtypes)[label] == "string":
        target = "__label"
        stages.append(StringIndexer(inputCol=label, outputCol=target, stringOrderType="alphabetAsc"))
    stages.append(NaiveBayes(featuresCol="__vector", labelCol=target, modelType="gaussian"))
    return Pipeline(stages=stages).fit(train)


def importances(model: PipelineModel, columns: Sequence[str] = FEATURE_COLUMNS) -> DataFrame:
    """Features by importance, with the spread over the trees.

    One number per feature and tree: the size of the model, not of the data.
    """
    forest = model.stages[-1]
    spark = SparkSession.getActiveSession()
    rows = [
        (name, i, float(t.featureImportances[i]))
        for t in forest.trees
        for i, name in enumerate(columns)
    ]
    per_tree = spark.createDataFrame(rows, "feature string, position int, importance double")
    overall = spark.createDataFrame(
        [(name, float(forest.featureImportances[i])) for i, name in enumerate(columns)],
        "feature string, importance double",
    )
    spread = per_tree.groupBy("feature").agg(F.stddev_pop("importance").alias("std"))
    return overall.join(spread, "feature").orderBy(F.desc("importance"), "feature")


def training_set(touches: DataFrame, targets: DataFrame, width: float, tick: float) -> DataFrame:
    """Rolling vectors labelled by the asked-for gesture of the tick.

    Bad labels are dropped and idle vectors are forced to state 0.
    """
    asked = fv.resample(targets, [PERF], "target", tick, "max")
    joined = fv.rolling_features(touches, width, tick).join(asked, [PERF, "time"], "left")
    return ms.force_idle_target(ms.drop_bad_targets(joined))


def vectors_with_targets(vectors: DataFrame, targets: DataFrame) -> DataFrame:
    """Vectors with the (possibly missing) target of their bin."""
    return vectors.join(targets, [PERF, "time"], "left")
