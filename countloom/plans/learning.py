"""Model queries. Fits have no SQL; tests/test_models.py compares them with plain solutions."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import counts, intervals, models, ranks
from ..operators.pins import pinned
from .intervals import SPANS, customer_spans
from .registry import query
from .sequences import UP, _code, _windows, sequences

STRENGTHS = [2.0**i for i in range(21)]


def suppliers(t):
    return t("lineitem").groupBy("l_suppkey").agg(F.count("*").alias("total"), F.count_if(F.col("l_returnflag") == "R").alias("positive"))


@query("""with c as (select l_suppkey, count(*) as n, sum(case when l_returnflag = 'R' then 1 else 0 end) as k from lineitem group by 1), g as (select sum(k) / sum(n) as p from c),
l as (select power(2.0, i) as strength, sum(lgamma(k + s * p) + lgamma(n - k + s * (1 - p)) - lgamma(n + s) - lgamma(s * p) - lgamma(s * (1 - p)) + lgamma(s)) as
  likelihood from c, g, (select i, power(2.0, i) as s from range(0, 21) r(i)) group by 1)
select strength, round(likelihood, 4) as log_likelihood, strength = (select arg_max(strength, likelihood) from l) as chosen from l""")
def h1_empirical_strength(t):
    """How strongly category rates are drawn to the prevalence: the likelihood of each listed strength, the best one marked."""
    table = suppliers(t)
    best = models.empirical_strength(table, STRENGTHS)
    return models.strength_likelihoods(table, STRENGTHS).select("strength", F.round("log_likelihood", 4).alias("log_likelihood"), (F.col("strength") == best).alias("chosen"))


def labelled_lines(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_discount", "l_extendedprice", "l_shipdate", "l_linestatus", (F.col("l_returnflag") == "R").cast("double").alias("label"))


@query()
def h2_level_logistic(t):
    """Coefficients of quantity and discount levels from compacted weighted rows."""
    rows = labelled_lines(t).select(F.floor(F.col("l_quantity") / 10).cast("string").alias("quantity"), F.round("l_discount", 2).cast("string").alias("discount"), "label")
    return models.fit_levels(rows, ["quantity", "discount"], "label")[1]


def candidates():
    head = models.preprocessor(["l_quantity", "l_extendedprice"], ["l_linestatus"])
    return {name: Pipeline(stages=[head, models.estimator(name)]) for name in ("logistic", "ridge", "tree")}


def folded_lines(t):
    """What the candidates read, and a fold of whole suppliers."""
    rows = labelled_lines(t).select("l_quantity", "l_extendedprice", "l_linestatus", "label", (F.col("l_suppkey") % 3).alias("fold"))
    return models.with_flags(rows, ["l_quantity", "l_extendedprice"])


@query()
def h6_cross_validation(t):
    """AUC of three pipelines on three supplier folds; preprocessing is learned in each fold."""
    return models.cross_validated(folded_lines(t), "fold", candidates())


@query()
def h9_final_predictions(t):
    """Fitted on odd orders, scored for the dearest line of each even one and aligned to those keys."""
    rows = models.with_flags(labelled_lines(t), ["l_quantity", "l_extendedprice"])
    model = candidates()["logistic"].fit(rows.where("l_orderkey % 2 = 1"))
    best = F.struct("l_extendedprice", "l_quantity", "l_quantity_missing", "l_extendedprice_missing", "l_linestatus")
    ask = rows.where("l_orderkey % 2 = 0").groupBy("l_orderkey").agg(F.max(best).alias("x")).select("l_orderkey", "x.*")
    return models.aligned_predictions(model, ask, ask.select("l_orderkey"), "l_orderkey").select("l_orderkey", F.round("score", 6).alias("score"))


@query()
def h13_probe_splits(t):
    """AUC of a probe on letter bags: documents held out at random against whole sources held out."""
    rows = t("documents").join(t("labels"), "doc_id").where("quality is not null").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"), F.col("quality").cast("double").alias("label"))
    splits = {"random": F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0, "source": F.pmod(F.xxhash64("source"), F.lit(4)) == 0}
    bags = models.letter_bags("text").fit(rows).transform(rows)  # nothing is learned: one pass over the texts serves both splits
    rows, probe, out = pinned(bags.select("doc_id", "source", "label", "features")), models.estimator("logistic").setMaxIter(10), []
    for name, held in splits.items():
        test = models.probability(probe.fit(rows.where(~held)).transform(rows.where(held)))
        out.append((name, models.auc_of(test)))
    return rows.sparkSession.createDataFrame(out, "split string, auc double")


@query("""with r as (select doc_id, quality, row_number() over (partition by quality order by md5(cast(doc_id as varchar) || ':folds'), doc_id) as r from labels)
select doc_id, quality, cast((r - 1) % 5 as bigint) as fold from r""")
def g3_stratified_folds(t):
    """Each class dealt round five folds in a seeded order; ranks are two-level, so a class is no single task."""
    rows = t("labels").select("doc_id", "quality", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":folds")).cast("binary")).alias("h"))
    return ranks.row_numbers(rows, [F.asc("h"), F.asc("doc_id")], "r", ["quality"]).select("doc_id", "quality", ((F.col("r") - 1) % 5).alias("fold"))


BIN_SQL = f"(select doc_id, cast(floor(100.0 * (length(regexp_replace({UP}, '[^CG]', '', 'g'))) / length(text)) as bigint) as gc_bin from documents where length(text) > 0)"


def joint(t):
    gc = F.floor(100.0 * sc.letter_count(F.col("seq"), "CG") / F.length("seq")).alias("gc_bin")
    return counts.kmer_counts(sequences(t).where(F.length("seq") > 0).select("seq", gc), "seq", 2, ["gc_bin"])


@query(f"select cast({_code(2)} as bigint) as code, gc_bin, count(*) as n from ({_windows(2)}) join {BIN_SQL} using (doc_id) group by 1, 2")
def e2_joint_counts(t):
    """Pairs by the GC bin of their sequence; the bin is computed before letters are exploded, so nothing is joined."""
    return joint(t)


@query(f"select cast({_code(2)} as bigint) || ':' || gc_bin as level, count(*) as n from ({_windows(2)}) join {BIN_SQL} using (doc_id) where {_code(2)} not in (0, 16) and gc_bin <> 0 group by 1")
def d10_pair_bin_levels(t):
    """Reference-coded interaction levels: no level for the first pair, for the first bin or for other letters."""
    return joint(t).where("code not in (0, 16) and gc_bin <> 0").select(F.concat_ws(":", "code", "gc_bin").alias("level"), "n")


def _permuted(rounds: int, seed: int) -> str:
    """CTEs r0, r1, ...: the halves of the numbers i after each round."""
    out = ["r0 as (select i, i >> half as l, i & mask as r from range(0, 1 << 14) k(i), g where i < size)"]
    for k in range(rounds):
        out.append(f"r{k + 1} as (select i, r as l, xor(l, cast('0x' || substr(md5(cast(r as varchar) || ':{seed}:{k}'), 1, 8) as bigint) & mask) as r from r{k}, g)")
    return ", ".join(out)


@query(f"""with s as ({SPANS}), o as (select contig, start, "end" - start as n, sum("end" - start) over (order by contig, start) - ("end" - start) as off from s),
t as (select cast(sum(n) as bigint) as total from o), h as (select total, cast(ceil(ceil(log2(total)) / 2) as bigint) as half from t),
g as (select total, half, (1::bigint << half) - 1 as mask, 1::bigint << (2 * half) as size from h), {_permuted(intervals.ROUNDS, 42)},
d as (select row_number() over (order by i) - 1 as draw, (l << half) + r as template_index from r{intervals.ROUNDS}, g where (l << half) + r < total)
select draw, contig, cast(start + template_index - off as bigint) as pos from d join o on template_index >= off and template_index < off + n where draw < 1000""")
def g6_background_positions(t):
    """A thousand positions of the customers' spans without replacement, the same on each run (sampling is the feature)."""
    return intervals.background(customer_spans(t), 1000, 42)


@query()
def h2_fit_report(t):
    """Compacted rows, columns, iterations and loss of the fit of h2_level_logistic."""
    rows = labelled_lines(t).select(F.floor(F.col("l_quantity") / 10).cast("string").alias("quantity"), F.round("l_discount", 2).cast("string").alias("discount"), "label")
    levels = ["quantity", "discount"]
    return models.fit_report(models.fit_levels(rows, levels, "label")[0], models.compacted(rows, levels, "label"))


@query()
def h6_strength_grid(t):
    """Metrics of three penalties on three supplier folds."""
    rows = folded_lines(t)
    return models.cross_validated(rows, "fold", models.strength_grid(models.preprocessor(["l_quantity", "l_extendedprice"], ["l_linestatus"]), [0.001, 1.0, 1000.0], rows.count()))


@query()
def h7_native_importance(t):
    """Importances of a tree, summed over what became of each column."""
    rows = models.with_flags(labelled_lines(t), ["l_quantity", "l_extendedprice"])
    return models.native_importance(candidates()["tree"].fit(rows), rows, ["l_quantity", "l_extendedprice", "l_linestatus"])


@query("""with a as (select avg(case when l_returnflag = 'R' then 1.0 else 0 end) as p from lineitem where l_orderkey % 2 = 1)
select m as model, count(*) as n, round(max(p), 4) as score from lineitem, a, (values ('prior'), ('mean')) k(m) where l_orderkey % 2 = 0 group by 1""")
def h5_constant_models(t):
    """The two constant models, fitted on odd orders and applied to even ones: each predicts the share of the label."""
    rows = models.with_flags(labelled_lines(t), ["l_quantity"])
    out = None
    for name in ("prior", "mean"):
        model = Pipeline(stages=[models.preprocessor(["l_quantity"], []), models.estimator(name)]).fit(rows.where("l_orderkey % 2 = 1"))
        one = models.probability(model.transform(rows.where("l_orderkey % 2 = 0"))).agg(F.lit(name).alias("model"), F.count("*").alias("n"), F.round(F.max("score"), 4).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def h8_pipeline_trace(t):
    """Rows, columns and density after each stage of the logistic pipeline."""
    rows = models.with_flags(labelled_lines(t), ["l_quantity", "l_extendedprice"])
    return models.pipeline_trace(candidates()["logistic"].fit(rows), rows)
