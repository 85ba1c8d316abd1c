"""Splits, folds, samples, metrics, learners, stacking, blending, streaming."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickfeat.functions import blend
from clickfeat.functions.encode import row_weight
from clickfeat.functions.tokens import hash_tokens, named
from clickfeat.learning import calibrate, learners, stages, tune
from clickfeat.operators import match, score, split
from clickfeat.operators.describe import feature_union, top_by_correlation
from clickfeat.plans.build import add_features
from clickfeat.plans.specs import pick
from clickfeat.registry.base import clicks_query, predictions, query, rounded
from clickfeat.session import new_folder, stored
from clickfeat.sources.readers import clicks_from_events, read_clicks, with_chunk
from clickfeat.streaming.profiles import MEASURES, latest_profiles, stream_profiles

SCORES = ["p_hour", "p_channel", "p_value"]


# ---- set operations, head and tail -------------------------------------------


@clicks_query(
    "union_sets",
    """select src, row_id, click_id, is_attributed, ip from (
         select 'train' as src, row_id, null::bigint as click_id, is_attributed, ip from clicks where day < 20
         union all select 'supplement', row_id, row_id, null, ip from clicks where day >= 20
         union all select 'test', row_id, row_id + 1000000000, null, ip from clicks
                   where day >= 20 and hour in (4,5,9,10,13,14))""",
)
def union_sets(clicks: DataFrame) -> DataFrame:
    return three_sets(clicks).select("src", "row_id", "click_id", "is_attributed", "ip")


def three_sets(clicks: DataFrame) -> DataFrame:
    late = clicks.filter("day >= 20").drop("is_attributed")
    return split.union_sets(
        {
            "train": clicks.filter("day < 20"),
            "supplement": late.withColumn("click_id", F.col("row_id")),
            "test": late.filter(F.col("hour").isin(4, 5, 9, 10, 13, 14)).withColumn(
                "click_id", F.col("row_id") + 1_000_000_000
            ),
        }
    )


@clicks_query("head_rows", "select row_id, ip from clicks order by row_id limit (select count(*) // 10 from events)")
def head_rows(clicks: DataFrame) -> DataFrame:
    return split.head_rows(clicks, clicks.count() // 10).select("row_id", "ip")


@clicks_query(
    "tail_rows", "select row_id, ip from clicks order by row_id desc limit (select count(*) * 4 // 10 from events)"
)
def tail_rows(clicks: DataFrame) -> DataFrame:
    return split.tail_rows(clicks, clicks.count() * 4 // 10).select("row_id", "ip")


UNION_COLUMNS = ["ip", "app", "device", "os", "channel", "day"]


def _top_sql(target: str) -> str:
    parts = " union all ".join(
        f"select '{c}' as feature, abs(corr({c}, {target})) as strength from clicks" for c in UNION_COLUMNS
    )
    return f"select feature from (select * from ({parts}) order by strength desc, feature limit 3)"


@clicks_query(
    "feature_union",
    f"select feature, count(*) as lists from ({_top_sql('is_attributed')} union all {_top_sql('hour')}) group by feature",
)
def feature_union_query(clicks: DataFrame) -> DataFrame:
    """Union of the columns that go most with the label and those that go most with the hour."""
    return feature_union(
        [top_by_correlation(clicks, UNION_COLUMNS, target, 3) for target in ("is_attributed", "hour")]
    )


# ---- splits and folds ---------------------------------------------------------


@clicks_query(
    "split_tail",
    """select src, row_id, case when src <> 'train' then src
              when row_id >= (select count(*) from clicks where day < 20) - 200 then 'valid' else 'train' end as split
       from (select 'train' as src, row_id from clicks where day < 20
             union all select 'test', row_id from clicks where day >= 20)""",
)
def split_tail(clicks: DataFrame) -> DataFrame:
    sets = split.union_sets({"train": clicks.filter("day < 20"), "test": clicks.filter("day >= 20")})
    return split.split_tail(sets, 200).select("src", "row_id", "split")


@clicks_query(
    "split_position_hour",
    """select row_id, case when row_id < (select count(*) * 6 // 10 from events) then 'train'
              when hour in (4,5,9,10,13,14) then 'test' else 'train' end as split from clicks""",
)
def split_position_hour(clicks: DataFrame) -> DataFrame:
    return split.split_position_hour(clicks, clicks.count() * 6 // 10).select("row_id", "split")


def _hash_sql(seed: int) -> str:
    """SQL of the seeded hash that random orders follow."""
    return f"('0x' || substr(md5('{seed}|' || row_id), 1, 15))::bigint"


def _split_sql(rows: str) -> str:
    return f"""select row_id, case when row_number() over (order by {_hash_sql(1024)}, row_id) <= {rows}
                      then 'valid' else 'train' end as split from clicks"""


@clicks_query("split_random", _split_sql("(select ceil(count(*) * 0.1::double) from clicks)"))
def split_random(clicks: DataFrame) -> DataFrame:
    return split.split_random(clicks, ratio=0.1).select("row_id", "split")


@clicks_query("split_random_rows", _split_sql("(select count(*) // 20 from clicks)"))
def split_random_rows(clicks: DataFrame) -> DataFrame:
    return split.split_random(clicks, rows=clicks.count() // 20).select("row_id", "split")


@clicks_query(
    "split_nfold_random",
    f"select row_id, case when {_hash_sql(10)} % 5 + 1 = 1 then 'test' else 'train' end as split from clicks",
)
def split_nfold_random(clicks: DataFrame) -> DataFrame:
    return split.split_nfold(clicks, k=1, n=5).select("row_id", "split")


@clicks_query(
    "folds_contiguous", "select row_id, cast(ntile(7) over (order by row_id) - 1 as int) as fold from clicks"
)
def folds_contiguous(clicks: DataFrame) -> DataFrame:
    return split.folds_contiguous(clicks, 7).select("row_id", "fold")


@clicks_query(
    "folds_by_chunk",
    """select row_id, cast(floor(row_id // 64 * 64 / ((select count(*) from events) / 4.0::double)) as int) as fold
       from clicks""",
)
def folds_by_chunk(clicks: DataFrame) -> DataFrame:
    return split.folds_by_chunk(clicks, 64, 4).select("row_id", "fold")


@clicks_query(
    "folds_stratified",
    f"""select row_id, is_attributed,
               cast((row_number() over (partition by is_attributed order by {_hash_sql(42)}, row_id) - 1) % 3 as int) as fold
        from clicks""",
)
def folds_stratified(clicks: DataFrame) -> DataFrame:
    return split.folds_stratified(clicks).select("row_id", "is_attributed", "fold")


@clicks_query(
    "sample_exact",
    f"""select row_id, ip, app, is_attributed from clicks
        qualify row_number() over (order by {_hash_sql(3)}, row_id) <= (select floor(count(*) * 0.1::double) from clicks)""",
)
def sample_exact(clicks: DataFrame) -> DataFrame:
    return split.sample_exact(clicks, 0.1, 3, ["row_id", "ip", "app", "is_attributed"])


@clicks_query(
    "shuffle_batches",
    f"""select row_id, pos, pos // 256 as batch_id
        from (select row_id, row_number() over (order by {_hash_sql(5)}, row_id) - 1 as pos from clicks)""",
)
def shuffle_batches(clicks: DataFrame) -> DataFrame:
    return split.shuffle_batches(clicks, 256, 5).select("row_id", "pos", "batch_id")


# What the random splits leave fixed, whatever the hash.


@clicks_query(
    "split_random_sizes",
    """select 'valid' as split, cast(ceil(count(*) * 0.1::double) as bigint) as n from clicks
       union all select 'train', count(*) - cast(ceil(count(*) * 0.1::double) as bigint) from clicks""",
)
def split_random_sizes(clicks: DataFrame) -> DataFrame:
    return split_random(clicks).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@clicks_query(
    "folds_stratified_sizes",
    """select is_attributed, cast(f as int) as fold, (n + 2 - f) // 3 as n
       from (select is_attributed, count(*) as n from clicks group by is_attributed), range(3) r(f)""",
)
def folds_stratified_sizes(clicks: DataFrame) -> DataFrame:
    return folds_stratified(clicks).groupBy("is_attributed", "fold").agg(F.count(F.lit(1)).alias("n"))


@clicks_query("sample_exact_size", "select count(*) // 10 as n, count(*) // 10 as distinct_rows from clicks")
def sample_exact_size(clicks: DataFrame) -> DataFrame:
    return sample_exact(clicks).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("distinct_rows")
    )


@clicks_query(
    "shuffle_batch_sizes",
    "select row_id // 256 as batch_id, count(*) as n, min(row_id) as first, max(row_id) as last from clicks group by all",
)
def shuffle_batch_sizes(clicks: DataFrame) -> DataFrame:
    """Positions are a permutation of the row numbers, so batches are as long as blocks of rows."""
    return shuffle_batches(clicks).groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last")
    )


@clicks_query(
    "pair_random_cover",
    "select row_id as neg_id, 1::bigint as pairs, 1 as pos_label from clicks where is_attributed = 0",
)
def pair_random_cover(clicks: DataFrame) -> DataFrame:
    """Every negative is paired once, with a positive."""
    pairs = match.pair_pos_neg(clicks, seed=7)
    labels = clicks.select(F.col("row_id").alias("pos_id"), "is_attributed")
    return pairs.join(labels, "pos_id").groupBy("neg_id").agg(
        F.count(F.lit(1)).alias("pairs"), F.max("is_attributed").alias("pos_label")
    )


# ---- metrics ------------------------------------------------------------------


def long_scores(spark: SparkSession, folder: str) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias("model"), F.col(c).alias("score")) for c in SCORES]
    return predictions(spark, folder).select(
        "click_id", "is_attributed", F.explode(F.array(*pairs)).alias("p")
    ).select("click_id", "is_attributed", "p.model", "p.score")


LONG_CTE = "ls as (" + " union all ".join(
    f"select click_id, is_attributed, '{c}' as model, {c} as score from preds" for c in SCORES
) + ")"


def _auc_sql(group: str, source: str, sc: str = "score", digits: int = 6) -> str:
    return f"""
    select {group}, round((sum(case when is_attributed = 1 then rk else 0 end)
             - sum(is_attributed) * (sum(is_attributed) + 1) / 2.0::double)
             / (sum(is_attributed) * sum(1 - is_attributed))::double, {digits}) as auc
    from (select *, rank() over (partition by {group} order by {sc})
                 + (count(*) over (partition by {group}, {sc}) - 1) / 2.0::double as rk from {source})
    group by {group}"""


@query("auc_exact", _auc_sql("model", "ls"), LONG_CTE)
def auc_exact(spark: SparkSession, folder: str) -> DataFrame:
    out = score.auc_exact(long_scores(spark, folder), "score", "is_attributed", ["model"])
    return rounded(out.select("model", "auc"), ["auc"])


@query(
    "auc_exact_items",
    _auc_sql("one", "(select 1 as one, l_extendedprice as score, cast(l_returnflag = 'R' as int) as is_attributed from lineitem)").replace("select one,", "select", 1),
)
def auc_exact_items(spark: SparkSession, folder: str) -> DataFrame:
    items = spark.read.parquet(f"{folder}/lineitem.parquet").select(
        "l_extendedprice", (F.col("l_returnflag") == "R").cast("int").alias("y")
    )
    return rounded(score.auc_exact(items, "l_extendedprice", "y").select("auc"), ["auc"])


@query(
    "auc_grid",
    """select round(sum(pta * (before - pfa)), 6) as auc from (
         select k, pta, pfa, coalesce(lag(pfa) over (order by k), 1.0::double) as before from (
           select k, sum(case when p_hour >= k / 999.0::double then is_attributed * n else 0 end)::double
                       / sum(is_attributed * n) as pta,
                  sum(case when p_hour >= k / 999.0::double then (1 - is_attributed) * n else 0 end)::double
                       / sum((1 - is_attributed) * n) as pfa
           from range(1000) g(k), (select p_hour, is_attributed, count(*) as n from preds group by all)
           group by k))""",
)
def auc_grid(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(score.auc_grid(predictions(spark, folder), "p_hour"), ["auc"])


@query(
    "rmse",
    "select model, round(sqrt(avg((is_attributed - score) * (is_attributed - score))), 6) as rmse from ls group by model",
    LONG_CTE,
)
def rmse(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(score.rmse(long_scores(spark, folder), "score", "is_attributed", ["model"]), ["rmse"])


@query(
    "accuracy_at",
    """select model, round(sum(case when score >= 0.5 then is_attributed else 0 end) / sum(is_attributed)::double, 6) as tp_rate,
              round(sum(case when score >= 0.5 then 1 - is_attributed else 0 end) / sum(1 - is_attributed)::double, 6) as fp_rate
       from ls group by model""",
    LONG_CTE,
)
def accuracy_at(spark: SparkSession, folder: str) -> DataFrame:
    out = score.accuracy_at(long_scores(spark, folder), "score", 0.5, by=["model"])
    return rounded(out, ["tp_rate", "fp_rate"])


CHUNKED_CTE = "ck as (select *, click_id // 250 as chunk_id from preds)"


def chunk_scores(spark: SparkSession, folder: str, which: str = "true") -> DataFrame:
    chunked = with_chunk(predictions(spark, folder), 250, "click_id")
    return score.auc_exact(chunked.filter(which), "p_channel", by=["chunk_id"]).select("chunk_id", "auc")


@query("auc_by_chunk", f"select * from ({_auc_sql('chunk_id', 'ck', 'p_channel')}) where chunk_id % 2 = 0", CHUNKED_CTE)
def auc_by_chunk(spark: SparkSession, folder: str) -> DataFrame:
    """Every second chunk is scored, as in progressive validation."""
    out = chunk_scores(spark, folder, "chunk_id % 2 = 0")
    return rounded(out, ["auc"])


@query(
    "fold_summary",
    f"""select round(avg(auc), 8) as mean, round(stddev_pop(auc), 8) as std, round(1 - avg(auc), 8) as error
        from ({_auc_sql('chunk_id', 'ck', 'p_channel', 12)})""",
    CHUNKED_CTE,
)
def fold_summary(spark: SparkSession, folder: str) -> DataFrame:
    out = score.fold_summary(chunk_scores(spark, folder))
    return rounded(out, ["mean", "std", "error"], 8)


@query(
    "running_score",
    f"""select chunk_id, round(m, 5) as running from run""",
    CHUNKED_CTE,
    f"per as ({_auc_sql('chunk_id', 'ck', 'p_channel', 12)})",
    "num as (select *, row_number() over (order by chunk_id) as i from per)",
    """w as (select a.chunk_id, sum(b.auc * (case when b.i = 1 then 1.0 else 0.2 end)::double * pow(0.8::double, a.i - b.i)) as m
       from num a join num b on b.i <= a.i group by a.chunk_id)""",
    "run as (select chunk_id, m from w)",
)
def running_score(spark: SparkSession, folder: str) -> DataFrame:
    out = score.running_score(chunk_scores(spark, folder), "chunk_id")
    return rounded(out.select("chunk_id", "running"), ["running"], 5)


@query(
    "best_trial",
    f"""select chunk_id as trial, round(1 - auc, 6) as loss from ({_auc_sql('chunk_id', 'ck', 'p_channel')})
        order by loss, trial limit 1""",
    CHUNKED_CTE,
)
def best_trial(spark: SparkSession, folder: str) -> DataFrame:
    trials = chunk_scores(spark, folder).select(
        F.col("chunk_id").alias("trial"), F.round(1 - F.col("auc"), 6).alias("loss")
    )
    return tune.best_trial(trials)


# ---- learners -----------------------------------------------------------------

NUMBERS = ["ip_app_co", "ip_cu_c", "ip_app_chl_var_h", "app_chl_co", "hour", "channel"]


def training_table(clicks: DataFrame) -> DataFrame:
    """Clicks with a handful of features as a dense vector, weights and three folds, stored."""
    features = add_features(clicks, pick("ip_app_co", "ip_cu_c", "ip_app_chl_var_h", "app_chl_co"))
    table = learners.assemble(features.withColumn("weight", row_weight()), NUMBERS)
    folds = split.folds_contiguous(table, 3)
    return stored(folds.select("row_id", "fold", "weight", "label", "features"), "training")


def _fit_and_score(name: str, params: dict, prepare=None) -> None:
    def run(clicks: DataFrame) -> DataFrame:
        table = (prepare or training_table)(clicks)
        learner = learners.get_learner(name)
        train = table.filter(F.col("fold") != 2)
        return tune.refit_predict(train, table, learner, params).select("row_id", "label", "score")

    clicks_query(f"learn_{name}")(run)


def hashed_table(clicks: DataFrame) -> DataFrame:
    words = clicks.withColumn("tokens", named())
    hashed = hash_tokens(words, "tokens")
    labelled = hashed.withColumn("label", F.col("is_attributed").cast("double"))
    weighted = labelled.withColumn("weight", row_weight())
    table = split.folds_contiguous(weighted, 3).select("row_id", "fold", "weight", "label", "features")
    # A scan has as few tasks as the log has row groups; rows are dealt over all tasks before they are fitted and scored.
    return stored(table.repartition("row_id"), "hashed")


def category_table(clicks: DataFrame) -> DataFrame:
    table = learners.hash_categories(clicks, ["ip", "app", "device", "os", "channel"], ["hour"])
    return split.folds_contiguous(table.withColumn("weight", row_weight()), 3).select(
        "row_id", "fold", "weight", "label", "features"
    )


_fit_and_score("lr", {"maxIter": 10}, category_table)
_fit_and_score("lasso", {"regParam": 0.001, "maxIter": 10})
_fit_and_score("ridge", {"regParam": 0.1, "maxIter": 10})
_fit_and_score("linear_sv", {"maxIter": 5, "regParam": 0.01})
_fit_and_score("rf", {"numTrees": 5, "maxDepth": 4})
_fit_and_score("gbm", {"maxIter": 5, "maxDepth": 3})
_fit_and_score("mlp", {"layers": [len(NUMBERS), 8, 2], "maxIter": 10, "seed": 1})


@clicks_query("learn_fm_hashed")
def learn_fm_hashed(clicks: DataFrame) -> DataFrame:
    """Factorization machine; row weights act through seeded resampling."""
    table = hashed_table(clicks)
    train = learners.resample_by_weight(table.filter("fold <> 2"), "weight")
    params = {"factorSize": 4, "maxIter": 10, "stepSize": 0.05}
    learner = learners.get_learner("fm")
    return tune.refit_predict(train, table, learner, params).select("row_id", "label", "score")


@clicks_query("learn_random_ridge")
def learn_random_ridge(clicks: DataFrame) -> DataFrame:
    table = training_table(clicks)
    fits = learners.random_ridge(
        table.filter("fold <> 2"), len(NUMBERS), {"n_estimators": 3, "subsample": 0.75, "max_features": 0.5}
    )
    return learners.score_ridges(fits, table).select("row_id", "label", "score")


# Scores of a fit hang on the fit; that every row has one between 0 and 1, and that they rank better than chance, does not.
def _sound_sql(bound: float) -> str:
    return f"select count(*) as n, true as in_range, true as auc_above_{str(bound).replace('.', '_')} from clicks"


def _sound(scored: DataFrame, bound: float) -> DataFrame:
    """One row: rows, whether all scores lie between 0 and 1, whether the AUC passes the bound."""
    scored = stored(scored, "scored")
    auc = score.auc_exact(scored, "score", "label").select((F.col("auc") > bound).alias(f"auc_above_{str(bound).replace('.', '_')}"))
    checked = scored.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.min(F.coalesce(F.col("score").between(0, 1), F.lit(False))), F.lit(True)).alias("in_range")
    )
    return checked.join(F.broadcast(auc))


@clicks_query("learn_gbt")
def learn_gbt(clicks: DataFrame) -> DataFrame:
    """Boosted trees with a class weight that stop early on the last fold."""
    table = training_table(clicks).withColumn("weight", learners.balance_weight(positive=3.0)).withColumn("valid", F.col("fold") == 2)
    model = learners.fit_boosted(table, "valid", {"maxIter": 20, "maxDepth": 3})
    return learners.score(model, table).select("row_id", "label", "score")


def staged_fit(clicks: DataFrame) -> tuple[DataFrame, DataFrame, stages.StagedModel]:
    """Boosting continued over four runs of rows, ended early on the two runs after them."""
    table = stages.with_step(training_table(clicks), "row_id", 6)
    chunks = [table.filter(F.col("step") == i) for i in range(4)]
    holdout = table.filter(F.col("step") > 3)
    return table, holdout, stages.fit_staged(chunks, {"maxIter": 3, "maxDepth": 3}, holdout=holdout)


@clicks_query("learn_gbt_chunked")
def learn_gbt_chunked(clicks: DataFrame) -> DataFrame:
    table, _, model = staged_fit(clicks)
    return model.score(table).select("row_id", "label", "score")


@clicks_query("learn_gbt_chunked_sound", "select count(*) as n, true as in_range, true as loss_within_prior from clicks")
def learn_gbt_chunked_sound(clicks: DataFrame) -> DataFrame:
    """All scores lie between 0 and 1, and the stages kept leave the holdout no loss above the prior's."""
    table, holdout, model = staged_fit(clicks)
    fits = stages.log_loss(model.add_margin(holdout)) <= stages.log_loss(model.add_margin(holdout, stages=0))
    return model.score(table).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.coalesce(F.col("score").between(0, 1), F.lit(False))).alias("in_range"),
        F.lit(fits).alias("loss_within_prior"),
    )


def random_tree_scores(clicks: DataFrame) -> DataFrame:
    table = training_table(clicks)
    model = stages.fit_random_trees(table.filter("fold <> 2"), len(NUMBERS), {"numTrees": 5, "maxDepth": 5}, groups=3)
    return model.score(table).select("row_id", "label", "score")


clicks_query("learn_extra_trees")(random_tree_scores)


@clicks_query("learn_extra_trees_sound", _sound_sql(0.5))
def learn_extra_trees_sound(clicks: DataFrame) -> DataFrame:
    return _sound(random_tree_scores(clicks), 0.5)


CHUNK_ROWS = 50
STEPS = 4


def progressive(clicks: DataFrame) -> DataFrame:
    table = with_chunk(training_table(clicks), CHUNK_ROWS, "row_id")
    return stages.progressive_scores(stored(table, "progressive"), learners.get_learner("lr"), {"maxIter": 10}, steps=STEPS)


@clicks_query(
    "progressive_steps",
    f"""select row_id, chunk_id, step, last as fitted_to, step > 0 as scored from (
          select *, lag(top) over (order by step) as last from (
            select step, max(chunk_id) as top from c group by step)) join c using (step)""",
    f"""c as (select row_id, row_id // {CHUNK_ROWS} as chunk_id,
               cast(floor((row_id // {CHUNK_ROWS}) * {STEPS} / (max(row_id // {CHUNK_ROWS}) over () + 1)) as int) as step from clicks)""",
)
def progressive_steps(clicks: DataFrame) -> DataFrame:
    """The model that scores a chunk saw chunks before it only."""
    return progressive(clicks).select("row_id", "chunk_id", "step", "fitted_to", F.col("score").isNotNull().alias("scored"))


@clicks_query("progressive_auc")
def progressive_auc(clicks: DataFrame) -> DataFrame:
    """AUC of every run of chunks under the model of the runs before it."""
    return score.auc_exact(progressive(clicks).filter("score is not null"), "score", "label", ["step"]).select("step", "auc")


STACKED = {
    "s_lr": ("lr", {"maxIter": 10}),
    "s_ridge": ("ridge", {"regParam": 0.1}),
    "s_rf": ("rf", {"numTrees": 5, "maxDepth": 4}),
}


@clicks_query(
    "stack_folds",
    """select row_id, cast(ntile(3) over (order by row_id) - 1 as int) as fold, is_attributed::double as label,
              true as out_of_fold, true as stacked from clicks""",
)
def stack_folds(clicks: DataFrame) -> DataFrame:
    """Three learners' out-of-fold columns and a perceptron on them; every value comes from fits that did not see its row."""
    base = {name: (learners.get_learner(kind), params) for name, (kind, params) in STACKED.items()}
    second = (learners.get_learner("mlp"), {"layers": [len(base), 4, 2], "maxIter": 20, "seed": 1})
    out = stages.stack(training_table(clicks), base, second, k=3)
    values = [F.col(c).isNotNull() for c in (*base, "score")]
    return out.select(
        "row_id", "fold", "label", (F.col("left_out") == F.col("fold")).alias("out_of_fold"), reduce(lambda a, b: a & b, values).alias("stacked")
    )


@clicks_query("learner_registry")
def learner_registry(clicks: DataFrame) -> DataFrame:
    """Training AUC of every registered learner with its own parameters, all iterations and trees included."""
    table = training_table(clicks)
    # A perceptron's layers follow the features, so it has no layers of its own.
    needed = {"mlp": {"layers": [len(NUMBERS), 8, 2]}}
    names = sorted(learners.REGISTRY)
    models = tune.fit_all(table, [(learners.get_learner(name), needed.get(name)) for name in names])
    rows = list(zip(names, tune.aucs_of(models, table)))
    return clicks.sparkSession.createDataFrame(rows, "learner string, auc double")


@clicks_query("cv_oof")
def cv_oof(clicks: DataFrame) -> DataFrame:
    oof, _, _ = tune.cross_validate(
        training_table(clicks), learners.get_learner("lr"), {"maxIter": 5}, k=3
    )
    return oof.select("row_id", "fold", "label", "score")


@clicks_query(
    "cv_oof_rows",
    "select row_id, cast(ntile(3) over (order by row_id) - 1 as int) as fold, is_attributed::double as label, true as scored from clicks",
)
def cv_oof_rows(clicks: DataFrame) -> DataFrame:
    """Every row has one out-of-fold score between 0 and 1."""
    scored = F.col("score").between(0, 1).alias("scored")
    return cv_oof(clicks).select("row_id", "fold", "label", scored)


@clicks_query("refit_predict")
def refit_predict(clicks: DataFrame) -> DataFrame:
    table = training_table(clicks)
    out = tune.refit_predict(
        table.filter("fold < 2"), table.filter("fold = 2"), learners.get_learner("lr"), {"maxIter": 5}
    )
    return out.select("row_id", "score")


@clicks_query("tune")
def tune_query(clicks: DataFrame) -> DataFrame:
    return tune.tune(
        training_table(clicks), learners.get_learner("lr"), trials=3, sample=None, fixed={"maxIter": 5}
    )


@clicks_query(
    "tune_halving",
    f"""select cast(k as int) as round, cast(8 >> k as int) as trials, 8 >> (k + 1) as better,
               (select count(*) from t where {_hash_sql(0)} < (1::bigint << 60) // (8 >> k)
                  and row_id in (select row_id from v)) as rows
        from range(3) g(k)""",
    f"""v as (select row_id from (select row_id, row_number() over (order by {_hash_sql(1)}, row_id) as i, count(*) over () as n from clicks)
               where i > ceil(n * 0.2))""",
)
def tune_halving(clicks: DataFrame) -> DataFrame:
    """Rounds of a search over eight trials: trials, those that go on, and rows of the nested samples."""
    log = tune.tune_halving(training_table(clicks), learners.get_learner("lr"), trials=8, fixed={"maxIter": 5})
    rounds = log.groupBy("round").agg(
        F.count(F.lit(1)).cast("int").alias("trials"),
        F.sum(F.col("survived").cast("int")).cast("int").alias("better"),
        F.max("rows").alias("rows"),
    )
    return rounds.filter(F.col("round") < 3)


@clicks_query("select_features")
def select_features(clicks: DataFrame) -> DataFrame:
    features = add_features(clicks, pick("ip_app_co", "ip_cu_c", "app_chl_co"))
    return tune.select_features(
        features, learners.get_learner("lr"), ["hour"], ["ip_app_co", "ip_cu_c", "channel"],
        params={"maxIter": 3}, searches=2, sample=None,
    )


@clicks_query("importance")
def importance(clicks: DataFrame) -> DataFrame:
    table = training_table(clicks)
    model = learners.get_learner("gbt").fit(table, {"maxIter": 5, "maxDepth": 3})
    return learners.importance(model, NUMBERS, clicks.sparkSession)


# ---- stacking, calibration, blending ------------------------------------------


@query(
    "stack_inputs",
    """select c.row_id, c.app as "0_app", c.hour as "0_hour", p.p_hour as "1_predicted", p.p_value as "2_predicted"
       from clicks c join preds p on c.row_id = p.click_id""",
)
def stack_inputs(spark: SparkSession, folder: str) -> DataFrame:
    preds = predictions(spark, folder)
    base = [(read_clicks(spark, folder), ["app", "hour"])]
    models = [
        (preds.select(F.col("click_id").alias("row_id"), F.col(c).alias("predicted")), ["predicted"])
        for c in ("p_hour", "p_value")
    ]
    return match.concat_columns(base + models)


@query(
    "isotonic",
    """select p.click_id, round(f.fit, 6) as calibrated from preds p join fit f on f.x = p.p_channel""",
    "pt as (select p_channel as x, sum(is_attributed) as sy, count(*) as n from preds group by p_channel)",
    # Monotone fit at x: the largest, over starts a <= x, of the smallest mean of a..b over ends b >= x.
    """span as (select a.x as a, b.x as b, sum(c.sy) / sum(c.n)::double as m
       from pt a join pt b on a.x <= b.x join pt c on c.x between a.x and b.x group by a.x, b.x)""",
    "low as (select i.x, s.a, min(s.m) as m from pt i join span s on s.a <= i.x and s.b >= i.x group by i.x, s.a)",
    "fit as (select x, max(m) as fit from low group by x)",
)
def isotonic(spark: SparkSession, folder: str) -> DataFrame:
    preds = predictions(spark, folder)
    model = calibrate.fit_isotonic(preds, "p_channel", "is_attributed")
    out = calibrate.apply_isotonic(model, preds, "p_channel", "calibrated")
    return rounded(out.select("click_id", "calibrated"), ["calibrated"])


ZERO = "(p_hour = 0 or p_channel = 0 or p_value = 0)"
AM = "(p_hour + p_channel + p_value) / 3"
GM = f"case when {ZERO} then 0.0::double else exp((ln(nullif(p_hour, 0)) + ln(nullif(p_channel, 0)) + ln(nullif(p_value, 0))) / 3) end"
HM = f"case when {ZERO} then 0.0::double else 1 / (1 / nullif(p_hour, 0) + 1 / nullif(p_channel, 0) + 1 / nullif(p_value, 0)) end"


def _blend(name: str, column, sql: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        out = predictions(spark, folder).select("click_id", column().alias("p"))
        return rounded(out, ["p"], 9)

    query(name, f"select click_id, round({sql}, 9) as p from preds")(run)


_blend("blend_mean", lambda: blend.mean(SCORES), AM)
_blend("blend_geo", lambda: blend.geometric(SCORES), GM)
_blend("blend_harmonic", lambda: blend.harmonic(SCORES), HM)
_blend("blend_harmonic_true", lambda: blend.harmonic(SCORES, true_form=True), HM.replace("else 1 / (", "else 3 / ("))
_blend("blend_final", lambda: blend.final(SCORES), f"({AM} + {HM} + {GM}) / 3")
_blend(
    "blend_weighted",
    lambda: blend.weighted({"p_hour": 0.5, "p_channel": 0.3, "p_value": 0.2}),
    "(0.5 * p_hour + 0.3 * p_channel + 0.2 * p_value)",
)


# ---- streaming ----------------------------------------------------------------


@query(
    "stream_profiles",
    """select ip, app, count(*) as clk, cast(sum(is_attributed) as bigint) as down,
              count(*) filter (hour // 4 = 0) as h6_0, count(*) filter (hour // 4 = 1) as h6_1,
              count(*) filter (hour // 4 = 2) as h6_2, count(*) filter (hour // 4 = 3) as h6_3,
              count(*) filter (hour // 4 = 4) as h6_4, count(*) filter (hour // 4 = 5) as h6_5
       from clicks group by ip, app""",
)
def stream_profiles_query(spark: SparkSession, folder: str) -> DataFrame:
    out, checkpoint = new_folder(spark, "stream-out"), new_folder(spark, "stream-checkpoint")
    # A glob: the file source lists folders or patterns.
    stream_profiles(
        spark, f"{folder}/events*.parquet", clicks_from_events, ["ip", "app"], out, checkpoint
    )
    return latest_profiles(spark, out, ["ip", "app"]).select("ip", "app", *MEASURES)


