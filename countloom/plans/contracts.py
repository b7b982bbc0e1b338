"""Feature group contracts, the columns that a model takes, balanced tails, the precision-recall curve, and the estimators side by side."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from ..operators import metrics, models
from ..operators.pins import pinned
from ..sources import tables
from .profiles import c12_exact_cell_tails
from .ranking import LEVELS, levels
from .registry import query
from .reports import CATEGORIES, category_lines

#: The groups of lineitem's columns.
GROUPS = {"continuous": ["l_extendedprice", "l_discount", "l_tax"], "count": ["l_quantity"], "nominal": ["l_linestatus"], "key": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], "date": ["l_shipdate"]}
TAKEN = [("continuous", "l_extendedprice"), ("continuous", "l_discount"), ("count", "l_quantity"), ("nominal", "l_linestatus")]


@query(" union all ".join(f"select '{g}' as feature_group, {len(c)} as n_columns, {' + '.join(f'count({x})' for x in c)} as n_values, true as sound from lineitem" for g, c in GROUPS.items()))
def b4_group_contract(t):
    """Each group of columns: how many, how many values they hold, and whether every column is in exactly one group and of the group's kind."""
    rows = t("lineitem")
    sound = not tables.feature_groups(rows, GROUPS, "l_returnflag")
    n = rows.agg(*(F.count(c).alias(c) for g in GROUPS.values() for c in g))
    each = F.array(*(F.struct(F.lit(g).alias("feature_group"), F.lit(len(c)).alias("n_columns"), sum((F.col(x) for x in c[1:]), F.col(c[0])).alias("n_values"), F.lit(sound).alias("sound")) for g, c in GROUPS.items()))
    return n.select(F.inline(each))


@query(" union all ".join(f"select '{c}' as column_name, '{g}' as feature_group, count({c}) as n_values, count(distinct {c}) as n_distinct from lineitem" for g, c in TAKEN))
def b5_model_columns(t):
    """The columns that a model of three groups without the tax takes, with their values."""
    rows = t("lineitem")
    taken, _ = tables.feature_plan(rows, GROUPS, exclude=["l_tax"], use=["continuous", "count", "nominal"], inference=rows.drop("l_returnflag"))
    owner = {c: g for g, columns in GROUPS.items() for c in columns}
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.lit(owner[c]).alias("feature_group"), F.col(c).cast("string").alias("v")) for c in taken))).alias("x"))
    return long.groupBy("x.column_name", "x.feature_group").agg(F.count("x.v").alias("n_values"), F.countDistinct("x.v").alias("n_distinct"))


@query("""with n as (select l_suppkey, count(*) as n from lineitem group by 1) select l_suppkey, cast(floor(0.25 * n) as bigint) as bottom, cast(floor(0.25 * n) as bigint) as top from n where floor(0.25 * n) > 0""")
def c12_tail_balance(t):
    """The rows of both tails of each cell; a cell whose tails differ in size is an error."""
    n = pinned(c12_exact_cell_tails(t).groupBy("l_suppkey").agg(F.count_if(F.col("tail") == "bottom").alias("bottom"), F.count_if(F.col("tail") == "top").alias("top")))
    if not n.where("bottom <> top").isEmpty():
        raise ValueError("tails of a cell differ in size")
    return n


@query(f"""with l as ({LEVELS}), c as (select *, sum(total) over (order by score desc) as ct, sum(positive) over (order by score desc) as cp, sum(positive) over () as p from l)
select score, round(cp / ct, 10) as precision, round(cp / p, 10) as recall from c""")
def f1_precision_recall(t):
    """The precision-recall curve: a point a score."""
    return metrics.precision_recall(levels(t)).select("score", F.round("precision", 10).alias("precision"), F.round("recall", 10).alias("recall"))


@query()
def h5_estimators(t):
    """AUC, average precision, loss and accuracy on even orders of each estimator fitted on odd ones: trees on native levels, linear models on one-hot ones."""
    rows = pinned(category_lines(t).withColumn("half", F.col("l_orderkey") % 2).drop("l_orderkey"))
    native, hot = models.native_categories(CATEGORIES, ["l_quantity"], 20), models.preprocessor(["l_quantity"], CATEGORIES)
    pipelines = {}
    for name, head in (("logistic", hot), ("ridge", hot), ("tree", native), ("forest", native), ("boosting", native)):
        last = models.estimator(name)
        pipelines[name] = Pipeline(stages=[head, last.setMaxBins(64) if last.hasParam("maxBins") else last])
    out = models.held_out(rows, models.counted(rows), F.col("half") == 0, pipelines)
    return t.spark.createDataFrame(out, "model string, auc double, average_precision double, log_loss double, accuracy double")
