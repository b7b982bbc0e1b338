"""Models on Spark ML, fitted on compacted rows where the features allow it."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import HashingTF, Imputer, MinMaxScaler, NGram, OneHotEncoder, RegexTokenizer, RobustScaler, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import log_gamma
from . import metrics, ranks
from .pins import pinned, tasks_for

SCALERS = {"standard": StandardScaler, "robust": RobustScaler, "minmax": MinMaxScaler}
CENTRED = {"standard": {"withMean": True}, "robust": {"withCentering": True}, "minmax": {}}


def strength_likelihoods(table: DataFrame, strengths: list[float]) -> DataFrame:
    """(strength, log_likelihood): beta-binomial likelihood of (total, positive) rows around their prevalence, up to a constant.

    Equal rows are counted first, so the listed strengths multiply distinct pairs only."""
    g = table.agg((F.sum("positive") / F.sum("total")).alias("p"))
    rows = table.groupBy("total", "positive").agg(F.count("*").alias("n")).crossJoin(F.broadcast(g)).withColumn("strength", F.explode(F.array(*[F.lit(float(s)) for s in strengths])))
    s, p, k, n = F.col("strength"), F.col("p"), F.col("positive"), F.col("total")
    a, b = s * p, s * (1 - p)
    beta = lambda x, y: log_gamma(x) + log_gamma(y) - log_gamma(x + y)
    return rows.groupBy("strength").agg(F.sum(F.col("n") * (beta(k + a, n - k + b) - beta(a, b))).alias("log_likelihood"))


def empirical_strength(table: DataFrame, strengths: list[float]) -> float:
    """The listed strength of the highest likelihood; the smaller one of ties."""
    return strength_likelihoods(table, strengths).orderBy(F.desc("log_likelihood"), "strength").first().strength


#: Compacted rows for each task of a fit.
COMPACT_ROWS = 50_000


def compacted(df: DataFrame, levels: list[str], y: str) -> DataFrame:
    """Rows of equal levels and label as one row with a weight."""
    return df.groupBy(*levels, F.col(y).cast("double").alias("label")).agg(F.count("*").cast("double").alias("weight"))


def fit_counted(head: Pipeline, last: Estimator, df: DataFrame) -> PipelineModel:
    """head fitted on the rows of df, then `last`, a model that takes weights and draws no rows, on the distinct rows with their numbers as weights: the fit of all rows, but each of its steps reads the distinct ones."""
    first = head.fit(df)
    rows = pinned(first.transform(compacted(df, [c for c in df.columns if c != "label"], "label")).select("features", "label", "weight"))
    return PipelineModel(stages=[first, last.copy().setWeightCol("weight").fit(rows)])


def fit_levels(df: DataFrame, levels: list[str], y: str, c: float = 1.0, max_iter: int = 100) -> tuple[PipelineModel, DataFrame]:
    """Weighted L2 logistic regression on one-hot levels, and its coefficients (feature, coefficient, odds_ratio).

    c is the inverse strength for the summed loss, as in least-squares texts: Spark's regParam is 1 / (c * sum of weights)."""
    rows = pinned(compacted(df, levels, y))
    whole, n = rows.agg(F.coalesce(F.sum("weight"), F.lit(1.0)), F.count("*")).first()
    rows = rows.coalesce(max(1, n // COMPACT_ROWS))  # a step of the fit is a job: a few dozen rows are one task of it
    index = StringIndexer(inputCols=levels, outputCols=[f"{x}_index" for x in levels], handleInvalid="keep", stringOrderType="alphabetAsc")
    hot = OneHotEncoder(inputCols=index.getOutputCols(), outputCols=[f"{x}_hot" for x in levels], dropLast=False)
    lr = LogisticRegression(weightCol="weight", regParam=1 / (c * whole), maxIter=max_iter, standardization=False, tol=1e-9)
    model = Pipeline(stages=[index, hot, VectorAssembler(inputCols=hot.getOutputCols(), outputCol="features"), lr]).fit(rows)
    names = [f"{x}={v}" for x, labels in zip(levels, model.stages[0].labelsArray, strict=True) for v in [*labels, "(unseen)"]]
    pairs = list(zip(["(intercept)", *names], [model.stages[-1].intercept, *model.stages[-1].coefficients.toArray().tolist()], strict=False))
    coefficients = df.sparkSession.createDataFrame(pairs, "feature string, coefficient double")
    return model, coefficients.withColumn("odds_ratio", F.exp("coefficient"))


def frequent(df: DataFrame, column: str, least: int, most: int | None = None, other: str = "(rare)") -> DataFrame:
    """df whose column keeps levels of at least `least` rows (the `most` commonest of them, by name in ties); others become `other`."""
    n = df.groupBy(column).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    keep = (n.orderBy(F.desc("_n"), column).limit(most) if most else n).select(column, F.lit(True).alias("_kept"))
    return df.join(keep, column, "left").withColumn(column, F.when(F.col(column).isNotNull(), F.when(F.col("_kept"), F.col(column).cast("string")).otherwise(other))).drop("_kept")


def preprocessor(numeric: list[str], categorical: list[str], impute: str = "median", scale: str | None = "standard") -> Pipeline:
    """Imputed and scaled numbers with missing flags, one-hot levels with a slot for unknown ones; all learned where it is fitted.

    impute: median, mean or mode, or a number as text, which then fills every gap. The input must come through with_flags()."""
    filled = [f"{c}_filled" for c in numeric]
    stages: list = []
    if numeric and impute in ("median", "mean", "mode"):
        stages.append(Imputer(strategy=impute, inputCols=numeric, outputCols=filled))
    elif numeric:
        gaps = ", ".join(f"coalesce(nanvl({c}, null), {float(impute)}D) as {c}_filled" for c in numeric)
        stages.append(SQLTransformer(statement=f"select *, {gaps} from __THIS__"))
    parts = [f"{c}_missing" for c in numeric]
    if numeric:
        stages.append(VectorAssembler(inputCols=filled, outputCol="numbers", handleInvalid="keep"))
        parts.append("scaled" if scale else "numbers")
        if scale:
            stages.append(SCALERS[scale](inputCol="numbers", outputCol="scaled", **CENTRED[scale]))
    if categorical:
        index = StringIndexer(inputCols=categorical, outputCols=[f"{c}_index" for c in categorical], handleInvalid="keep", stringOrderType="alphabetAsc")
        hot = OneHotEncoder(inputCols=index.getOutputCols(), outputCols=[f"{c}_hot" for c in categorical], dropLast=False, handleInvalid="keep")
        stages += [index, hot]
        parts += hot.getOutputCols()
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=parts, outputCol="features", handleInvalid="keep")])


def with_flags(df: DataFrame, numeric: list[str]) -> DataFrame:
    """Numbers as doubles, and a flag for each missing one."""
    return df.withColumns({f"{c}_missing": F.col(c).isNull().cast("double") for c in numeric} | {c: F.col(c).cast("double") for c in numeric})


def estimator(name: str, seed: int = 42):
    """logistic, ridge, tree, forest or boosting over `features` and `label`."""
    made = {
        "logistic": lambda: LogisticRegression(maxIter=50), "ridge": lambda: LinearRegression(regParam=1.0, elasticNetParam=0.0), "tree": lambda: DecisionTreeClassifier(maxDepth=5, seed=seed),
        "forest": lambda: RandomForestClassifier(numTrees=20, maxDepth=5, seed=seed), "boosting": lambda: GBTClassifier(maxIter=10, maxDepth=3, seed=seed),
        "prior": lambda: LogisticRegression(maxIter=50, regParam=1e12), "mean": lambda: LinearRegression(regParam=1e12, elasticNetParam=0.0),  # the intercept bears no penalty: constants
    }
    return made[name]()


def probability(df: DataFrame) -> DataFrame:
    """Predictions with score: the probability of label 1, or a regression's value."""
    return df.withColumn("score", vector_to_array("probability")[1] if "probability" in df.columns else F.col("prediction"))


def auc_of(scored: DataFrame, count: str | None = None) -> float | None:
    """Exact AUC of (score, label). count: how often a row counts."""
    n = F.col(count) if count else F.lit(1).cast("long")
    levels = scored.groupBy(F.round("score", 12).alias("score")).agg(F.sum(n).alias("total"), F.sum(n * F.col("label").cast("long")).alias("positive"))
    return metrics.auc(levels).first().auc


def metrics_of(scored: DataFrame, count: str | None = None) -> tuple[float | None, float, float, float]:
    """Exact AUC and average precision, log-loss and accuracy at 0.5 of (score, label); scores are clipped for the loss. count: how often a row counts. One order of the distinct scores serves all four."""
    n = F.col(count).cast("long") if count else F.lit(1).cast("long")
    levels = pinned(scored.groupBy(F.round("score", 12).alias("score")).agg(F.sum(n).alias("total"), F.coalesce(F.sum(n * F.col("label").cast("long")), F.lit(0)).alias("positive")))
    c = ranks.cumulative(levels, [F.desc("score")], {"ct": F.col("total"), "cp": F.col("positive")}).withColumn("negative", F.col("total") - F.col("positive"))
    c = c.crossJoin(F.broadcast(levels.agg(F.sum(F.col("total") - F.col("positive")).alias("all_negative"))))
    lower = F.col("all_negative") - (F.col("ct") - F.col("cp")) + F.col("negative") / 2
    p = F.least(F.greatest("score", F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = -(F.col("positive") * F.ln(p) + F.col("negative") * F.ln(1 - p))
    right = F.when(F.col("score") >= 0.5, F.col("positive")).otherwise(F.col("negative"))
    found = c.agg(
        (F.sum(F.col("positive") * lower) / F.nullif(F.sum("positive") * F.sum("negative"), F.lit(0))).alias("auc"),
        F.coalesce(F.sum(F.col("positive") * F.col("cp") / F.col("ct")) / F.nullif(F.sum("positive"), F.lit(0)), F.lit(0.0)).alias("ap"), (F.sum(loss) / F.sum("total")).alias("loss"), (F.sum(right) / F.sum("total")).alias("accuracy"),
    ).first()
    return found.auc, found.ap, found.loss, found.accuracy


def counted(df: DataFrame) -> DataFrame:
    """The distinct rows of df, written, with their numbers as weight."""
    return pinned(df.groupBy(*df.columns).agg(F.count("*").cast("double").alias("weight")))


def held_out(df: DataFrame, counts: DataFrame, held: Column, pipelines: dict[str, Pipeline]) -> list[tuple]:
    """(candidate, auc, average_precision, log_loss, accuracy) of each pipeline, fitted on the rows that are not held and scored on the others. counts: counted(df).

    Preprocessing is learned from the rows, once for all pipelines that have the same stages for it. Last stages see counted rows with weights, unless they take none or draw rows (forests)."""
    made, out = {}, []
    for name, p in pipelines.items():
        *head, last = p.getStages()
        key = tuple(map(id, head))
        if key not in made:
            first = Pipeline(stages=head).fit(df.where(~held))
            made[key] = first, pinned(first.transform(counts.withColumn("_held", held)).select("_held", "features", "label", "weight"))
        first, rows = made[key]
        if last.hasParam("weightCol") and not isinstance(last, RandomForestClassifier):
            model = last.copy().setWeightCol("weight").fit(rows.where("not _held"))
        else:
            model = last.fit(first.transform(df.where(~held)))
        out.append((name, *metrics_of(probability(model.transform(rows.where("_held"))), "weight")))
    return out


def cross_validated(df: DataFrame, fold: str, pipelines: dict[str, Pipeline]) -> DataFrame:
    """(candidate, fold, auc, average_precision, log_loss, accuracy): each pipeline fitted without a fold and scored on it. df has label and what the pipelines read; folds and candidates are few."""
    df, out = pinned(df), []
    counts = counted(df)
    for (k,) in counts.select(fold).distinct().orderBy(fold).collect():
        out += [(name, int(k), *found) for name, *found in held_out(df, counts, F.col(fold) == k, pipelines)]
    return df.sparkSession.createDataFrame(out, "candidate string, fold long, auc double, average_precision double, log_loss double, accuracy double")


def strength_grid(head: Pipeline, strengths: list[float], n_rows: int) -> dict[str, Pipeline]:
    """Logistic pipelines by inverse strength c of the penalty on the summed loss of n_rows rows."""
    return {f"c={c:g}": Pipeline(stages=[head, LogisticRegression(maxIter=50, regParam=1 / (c * n_rows))]) for c in strengths}


def fit_report(model: PipelineModel, compact: DataFrame) -> DataFrame:
    """One row: compacted rows, their weight, columns, iterations, whether they ended before the limit, and the weighted log-loss of the last stage, a logistic model."""
    last = model.stages[-1]
    p = vector_to_array("probability")[1]
    p = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = -F.when(F.col("label") == 1, F.ln(p)).otherwise(F.ln(1 - p)) * F.col("weight")
    facts = model.transform(compact).agg(F.count("*").alias("n_rows"), F.sum("weight").alias("weight"), (F.sum(loss) / F.sum("weight")).alias("log_loss"))
    steps = last.summary.totalIterations
    return facts.select("n_rows", "weight", F.lit(last.numFeatures).alias("n_columns"), F.lit(steps).alias("iterations"), F.lit(steps < last.getMaxIter()).alias("converged"), "log_loss")


def native_importance(model: PipelineModel, df: DataFrame, sources: list[str]) -> DataFrame:
    """(feature, importance): a tree model's importances, or absolute coefficients, summed over the vector slots that come from each source column."""
    last, at = model.stages[-1], df
    for stage in model.stages[:-1]:
        at = stage.transform(at)
    attrs = [a for kind in at.schema["features"].metadata["ml_attr"]["attrs"].values() for a in kind]
    flat = [y for x in model.stages for y in (x.stages if isinstance(x, PipelineModel) else [x])]
    inputs = {x.getOutputCol(): x.getInputCols() for x in flat if isinstance(x, VectorAssembler)}
    scaled = {x.getOutputCol(): x.getInputCol() for x in flat if x.hasParam("inputCol") and x.isDefined("inputCol") and x.getInputCol() in inputs}

    def source(slot: str) -> str:
        """The column behind a slot; slots of a scaled vector are named by their number."""
        vector, _, i = slot.rpartition("_")
        columns = inputs.get(scaled.get(vector, vector))
        return columns[int(i)] if columns and i.isdigit() else slot

    values = (last.featureImportances if hasattr(last, "featureImportances") else last.coefficients).toArray()
    held = dict.fromkeys(sources, 0.0)
    for a in attrs:
        owner = max((c for c in sources if source(a["name"]).startswith(c)), key=len, default=None)
        if owner is not None:
            held[owner] += abs(float(values[a["idx"]]))
    return df.sparkSession.createDataFrame(list(held.items()), "feature string, importance double")


def staged_losses(model: PipelineModel, df: DataFrame) -> DataFrame:
    """(trees, loss) of a boosted last stage, after each of its trees."""
    at = df
    for stage in model.stages[:-1]:
        at = stage.transform(at)
    losses = model.stages[-1].evaluateEachIteration(at)
    return df.sparkSession.createDataFrame([(i + 1, float(x)) for i, x in enumerate(losses)], "trees long, loss double")


def shuffled_column(df: DataFrame, column: str, key: str, seed: int) -> DataFrame:
    """df with one column permuted: its values by one seeded order meet the rows in another. key tells rows apart."""
    order = lambda s: [F.xxhash64(F.col(key), F.lit(s)), F.col(key)]
    values = ranks.row_numbers(df.select(key, column), [F.asc_nulls_first(c) for c in order(seed)], "_r").select("_r", F.col(column).alias("_v"))
    rows = ranks.row_numbers(df, [F.asc_nulls_first(c) for c in order(seed + 1)], "_r")
    return rows.join(values, "_r").withColumn(column, F.col("_v")).select(*df.columns)


def _seeded_positions(ids: DataFrame, seed: int, name: str) -> DataFrame:
    """_r (from 0) and the _id as `name`: rows of (_k, _id) in the order of a seeded hash of _k. Hashes are spread evenly, so buckets of them are fixed beforehand: rows move once and nothing is written."""
    n = tasks_for(ids)
    h = F.xxhash64("_k", F.lit(seed))
    rows = ids.select(h.alias("_h"), "_id", F.least(F.floor((h.cast("double") / 2.0**64 + 0.5) * n), F.lit(n - 1)).cast("int").alias("_b"))
    sizes = rows.groupBy("_b").agg(F.count("*").alias("_n")).select(F.col("_b").alias("_b2"), (F.sum("_n").over(W.orderBy("_b")) - F.col("_n")).alias("_before"))  # a row a bucket
    place = F.row_number().over(W.partitionBy("_b").orderBy("_h", "_id")) - 1
    return rows.repartition(n, "_b").withColumn("_at", place).join(F.broadcast(sizes), F.col("_b") == F.col("_b2")).select((F.col("_at") + F.col("_before")).alias("_r"), F.col("_id").alias(name))


def permutation_importance(model: PipelineModel, df: DataFrame, columns: list[str], key: str, repeats: int = 2, seed: int = 42) -> DataFrame:
    """(feature, repeat, drop): how much the AUC falls when a column is permuted as by shuffled_column(). key tells rows apart and is no input of the model.

    The columns of a repeat share one permutation. What moves for it is a number for each row, that of its distinct values; a distinct row with another's value is scored once and counted."""
    names = [c for c in df.columns if c != key]
    df = pinned(df)
    kinds = pinned(ranks.row_numbers(df.groupBy(*names).agg(F.count("*").alias("_n")), [F.asc_nulls_first(c) for c in names], "_id"))
    sent = F.broadcast if kinds.count() <= ranks.MOST_SENT else (lambda x: x)
    same = lambda a, b, by: [a[c].eqNullSafe(b[f"_by_{c}"]) for c in by]
    one = lambda by: kinds.groupBy(*(F.col(c).alias(f"_by_{c}") for c in by)).agg(F.min("_id").alias("_one"))
    owners = kinds
    for i, c in enumerate(columns):  # one row stands for all that are alike without the column, and one for all that have its value
        for what, by in (("rest", [x for x in names if x != c]), ("value", [c])):
            alike = one(by)
            owners = owners.join(sent(alike), same(owners, alike, by)).select(*owners.columns, F.col("_one").alias(f"_{what}_{i}"))
    owners = pinned(owners)
    asked = kinds.select("_id", *(F.col(c).alias(f"_by_{c}") for c in names))
    ids = pinned(df.join(sent(asked), same(df, asked, names)).select(F.col(key).alias("_k"), "_id"))
    area = lambda rows: auc_of(probability(model.transform(rows)), "_n")
    whole, out = area(kinds.drop("_id")), {}
    for r in range(repeats):
        pairs = _seeded_positions(ids, seed + 2 * r + 1, "_id").join(_seeded_positions(ids, seed + 2 * r, "_from"), "_r").drop("_r")
        rest = owners.select("_id", *(f"_rest_{i}" for i in range(len(columns))))
        value = owners.select(F.col("_id").alias("_from"), *(f"_value_{i}" for i in range(len(columns))))
        each = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"_rest_{i}").alias("rest"), F.col(f"_value_{i}").alias("value")) for i in range(len(columns)))))
        found = pinned(pairs.join(sent(rest), "_id").join(sent(value), "_from").select(each.alias("x")).groupBy("x.i", "x.rest", "x.value").agg(F.count("*").alias("_n")))
        for i, c in enumerate(columns):
            at = found.where(F.col("i") == i).join(sent(kinds.select(F.col("_id").alias("rest"), *(x for x in names if x != c))), "rest")
            at = at.join(sent(kinds.select(F.col("_id").alias("value"), c)), "value").select(*names, "_n")
            out[c, r] = whole - area(at)
    return df.sparkSession.createDataFrame([(c, r, out[c, r]) for c in columns for r in range(repeats)], "feature string, repeat long, drop double")


def pipeline_trace(model: PipelineModel, df: DataFrame) -> DataFrame:
    """(stage, name, n_rows, n_columns, n_features, density): rows, columns and vector sizes after each stage."""
    out, at = [], df
    for i, stage in enumerate(model.stages):
        at = stage.transform(at)
        column = stage.getOrDefault("outputCol") if stage.hasParam("outputCol") and stage.isDefined("outputCol") else None
        sizes = (0, None)
        if column in at.columns and at.schema[column].dataType.typeName() == "vectorudt":
            s = at.select(Summarizer.metrics("count", "numNonZeros").summary(F.col(column)).alias("s")).first().s
            sizes = (len(s.numNonZeros), float(s.numNonZeros.toArray().sum() / max(s["count"] * len(s.numNonZeros), 1)))
        out.append((i, type(stage).__name__, at.count(), len(at.columns), *sizes))
    return df.sparkSession.createDataFrame(out, "stage long, name string, n_rows long, n_columns long, n_features long, density double")


def aligned_predictions(model: PipelineModel, rows: DataFrame, sample: DataFrame, key: str) -> DataFrame:
    """(key, score) for exactly the sample's keys; raises for repeated keys, missing rows or null scores."""
    scored = pinned(probability(model.transform(rows)).select(key, "score"))
    out = pinned(sample.select(key).join(scored, key, "left"))
    facts = out.agg(F.count("*").alias("n"), F.countDistinct(key).alias("keys"), F.count_if(F.col("score").isNull()).alias("empty")).first()
    if facts.n != facts.keys or facts.empty or facts.n != sample.count():
        raise ValueError(f"{facts.n} rows, {facts['keys']} keys, {facts.empty} without a score")
    return out


def letter_bags(text: str, k: int = 3, size: int = 4096) -> Pipeline:
    """k-letter bags of whole texts, hashed to a fixed width."""
    return Pipeline(stages=[RegexTokenizer(inputCol=text, outputCol="_c", pattern="(?s).", gaps=False), NGram(n=k, inputCol="_c", outputCol="_k"), HashingTF(inputCol="_k", outputCol="features", numFeatures=size)])


def _after(loads: list[int], n: int, m: int) -> list[int]:
    """Loads after m groups of n rows went one by one to the lightest fold (the first of equal ones)."""
    low, high = min(loads), max(loads) + n * m
    taken = lambda v: sum(max(0, (v - x) // n + 1) for x in loads)  # noqa: E731  how many groups find their fold at a load of at most v
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if taken(mid) >= m else (mid + 1, high)
    steps = [max(0, (low - 1 - x) // n + 1) for x in loads]
    left = m - sum(steps)
    for i, x in enumerate(loads):
        if left and x + steps[i] * n == low:
            steps[i] += 1
            left -= 1
    return [x + s * n for x, s in zip(loads, steps, strict=True)]


def _dealt(starts):
    """Of (group, n, rank among the groups of its size, from 0): the fold, by what each fold holds before the first group of that size."""

    def run(batches):
        for b in batches:
            size, rank = (b.column(c).to_numpy() for c in (1, 2))
            out = np.zeros(len(size), np.int32)
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                loads = np.array(starts.value[int(n)], np.int64)
                want = rank[at].astype(np.int64)
                low, high = np.full(len(at), loads.min()), loads.max() + n * (want + 1)
                while (low < high).any():  # the load at which each group finds its fold
                    mid = (low + high) // 2
                    enough = np.maximum(0, (mid[:, None] - loads) // n + 1).sum(1) > want
                    low, high = np.where(enough, low, mid + 1), np.where(enough, mid, high)
                place = want - np.maximum(0, (low[:, None] - 1 - loads) // n + 1).sum(1)
                folds = (loads <= low[:, None]) & ((low[:, None] - loads) % n == 0)
                out[at] = (folds.cumsum(1) == place[:, None] + 1).argmax(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out)], [*b.schema.names[:2], "fold"])

    return run


def lightest_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """group, n, fold: groups by falling size, then name, each to the fold that has the fewest rows so far (the first of equal ones).

    Groups of one size are dealt at once: what the folds hold before them fixes where the r-th of them goes. So the driver sees a row a distinct size, never the groups."""
    sizes = pinned(df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n")))
    held, starts = [0] * folds, {}
    for n, m in sizes.groupBy("n").agg(F.count("*").alias("m")).orderBy(F.desc("n")).collect():
        starts[n] = held
        held = _after(held, n, m)
    rows = ranks.row_numbers(sizes, [F.asc(group)], "_r", ["n"]).select(group, "n", (F.col("_r") - 1).alias("_r"))
    kind = f"`{group}` {sizes.schema[group].dataType.simpleString()}, n long, fold int"
    return rows.mapInArrow(_dealt(df.sparkSession.sparkContext.broadcast(starts)), kind)


def best_strength(table: DataFrame, low: float = 1e-3, high: float = 1e9, tolerance: float = 1e-6, points: int = 33, prior: str | None = None) -> tuple[float, float]:
    """(strength, log_likelihood): the strength between low and high at which the beta-binomial likelihood of (total, positive) rows is largest, to a relative tolerance of its logarithm.

    prior: a column with the mean that a row is drawn to, else the prevalence. The likelihood is a sum of parts, each of one number (positive, negative or total) and the mean: equal ones are counted
    once and written. Each step evaluates `points` strengths in one aggregate, over as many tasks as the session has, and keeps the two intervals around the best, so the bracket shrinks by
    (points - 1) / 2 a job."""
    rows = table.where("total > 0")
    g = rows.agg((F.sum("positive") / F.sum("total")).alias("p"))
    q = F.least(F.greatest(F.col(prior) if prior else F.col("p"), F.lit(1e-12)), F.lit(1 - 1e-12))
    rows = rows.crossJoin(F.broadcast(g)).select("total", "positive", q.alias("q")).groupBy("total", "positive", "q").agg(F.count("*").alias("n"))
    part = lambda value, share, sign: F.struct(F.col(value).cast("long").alias("value"), share.alias("share"), F.lit(sign).alias("sign"))
    parts = F.array(part("positive", F.col("q"), 1), part("negative", 1 - F.col("q"), 1), part("total", F.lit(1.0), -1))
    rows = rows.withColumn("negative", F.col("total") - F.col("positive")).select(F.explode(parts).alias("x"), "n")
    rows = pinned(rows.groupBy("x.value", "x.share", "x.sign").agg(F.sum("n").alias("n")).where("value > 0"))
    a, b = math.log(low), math.log(high)
    while True:
        grid = [a + (b - a) * i / (points - 1) for i in range(points)]
        x = F.col("_s") * F.col("share")
        each = rows.repartition(tasks_for(rows)).withColumn("_s", F.explode(F.array(*[F.lit(math.exp(v)) for v in grid])))
        found = each.groupBy("_s").agg(F.sum(F.col("n") * F.col("sign") * (log_gamma(F.col("value") + x) - log_gamma(x))).alias("l"))
        best = max(found.collect(), key=lambda r: (r.l, -r._s), default=None)
        if best is None:
            raise ValueError("no rows with a total")
        i = min(range(points), key=lambda k: abs(math.exp(grid[k]) - best._s))
        a, b = grid[max(0, i - 1)], grid[min(points - 1, i + 1)]
        if b - a <= tolerance:
            return best._s, best.l


def native_categories(categorical: list[str], numeric: list[str], least: int = 1) -> Pipeline:
    """Features in which each categorical column is one slot of nominal kind, so that trees split on sets of levels. Levels of fewer than `least` rows, null and unseen ones share
    one slot: levels are numbered by falling frequency, and the rest follow as one."""
    index = [NativeLevels(c, f"{c}_level", least) for c in categorical]
    return Pipeline(stages=[*index, VectorAssembler(inputCols=[*(f"{c}_level" for c in categorical), *numeric], outputCol="features", handleInvalid="keep")])


class NativeLevels(Estimator):
    """Numbers the levels of a column by falling frequency, then name; rare, null and unseen ones share the number after the last."""

    def __init__(self, column: str, out: str, least: int = 1):
        super().__init__()
        self.column, self.out, self.least = column, out, least

    def _fit(self, df: DataFrame) -> Transformer:
        n = df.where(F.col(self.column).isNotNull()).groupBy(F.col(self.column).cast("string").alias("v")).agg(F.count("*").alias("n")).where(F.col("n") >= self.least)
        names = [r.v for r in n.orderBy(F.desc("n"), "v").limit(MOST_LEVELS + 1).collect()]
        if len(names) > MOST_LEVELS:
            raise ValueError(f"{self.column} has more than {MOST_LEVELS} levels of {self.least} rows: raise the least number of rows of a level")
        return NativeLevelsModel(self.column, self.out, names)


class NativeLevelsModel(Transformer):
    def __init__(self, column: str, out: str, names: list[str]):
        super().__init__()
        self.column, self.out, self.names = column, out, names

    def _transform(self, df: DataFrame) -> DataFrame:
        number = F.create_map(*(x for i, v in enumerate(self.names) for x in (F.lit(v), F.lit(float(i))))) if self.names else None
        last = F.lit(float(len(self.names)))
        value = F.coalesce(F.element_at(number, F.col(self.column).cast("string")), last) if self.names else last
        kind = {"ml_attr": {"type": "nominal", "name": self.out, "vals": [*self.names, "(other)"]}}
        return df.withColumn(self.out, value.alias(self.out, metadata=kind))


#: Levels of a column that trees may tell apart.
MOST_LEVELS = 1000


def feature_profile(model: PipelineModel, df: DataFrame, column: str = "features") -> DataFrame:
    """slot, name, mean, std, non_zero, n of each slot of the vector that the last but one stage leaves: one aggregate over the rows."""
    at = df
    for stage in model.stages[:-1]:
        at = stage.transform(at)
    s = at.select(Summarizer.metrics("count", "mean", "std", "numNonZeros").summary(F.col(column)).alias("s")).first().s
    attrs = at.schema[column].metadata.get("ml_attr", {}).get("attrs", {})
    names = {a["idx"]: a.get("name") for kind in attrs.values() for a in kind}
    rows = [(i, names.get(i), float(m), float(d), int(z), int(s["count"])) for i, (m, d, z) in enumerate(zip(s.mean.toArray(), s.std.toArray(), s.numNonZeros.toArray(), strict=True))]
    return df.sparkSession.createDataFrame(rows, "slot long, name string, mean double, std double, non_zero long, n long")


def stage_gaps(model: PipelineModel, df: DataFrame) -> DataFrame:
    """stage, name, column, nulls: null and NaN values of each column that a stage adds, and of the input (stage -1), one aggregate a stage."""
    out, at, seen = [], df, []
    for i, stage in enumerate([None, *model.stages]):
        at = stage.transform(at) if stage else at
        new = [c for c in at.columns if c not in seen]
        missing = lambda c: F.col(c).isNull() | (F.isnan(c) if at.schema[c].dataType.typeName() in ("double", "float") else F.lit(False))  # noqa: B023, E731
        facts = at.agg(*(F.count_if(missing(c)).alias(c) for c in new)).first() if new else []
        out += [(i - 1, type(stage).__name__ if stage else "input", c, int(facts[c])) for c in new]
        seen += new
    return df.sparkSession.createDataFrame(out, "stage long, name string, column string, nulls long")
