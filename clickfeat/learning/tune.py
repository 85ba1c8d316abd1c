"""Cross-validation, refit, random search and feature selection.

The loops here are over fits, each of which is a distributed Spark job.
"""

from __future__ import annotations

import math
import random
import warnings
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickfeat.learning.learners import FEATURES, LABEL, SCORE, WEIGHT, Learner, assemble, score
from clickfeat.operators.score import auc_exact
from clickfeat.operators.skew import HASH_BITS, seeded_hash
from clickfeat.operators.split import sample_exact, split_random
from clickfeat.session import stored

# Fits that run at the same time, so that the short jobs of one fill the gaps of the other; each keeps its rows in memory.
FITS_AT_ONCE = 2


def auc_of(df: DataFrame, score_col: str = SCORE, label: str = LABEL) -> float:
    value = auc_exact(df, score_col, label).first()["auc"]
    return float("nan") if value is None else float(value)


def aucs_of(models: Sequence[Model], df: DataFrame, label: str = LABEL) -> list[float]:
    """AUC of each model on the rows of ``df``, which are read and ranked once for all of them; NaN without both classes."""
    out = df.select(FEATURES, label)
    names = [f"__auc{i}" for i in range(len(models))]
    for name, model in zip(names, models):
        out = score(model, out, name)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("model"), F.col(n).alias(SCORE)) for i, n in enumerate(names)]))
    long = out.select(F.col(label).alias(LABEL), each.alias("__one")).select(LABEL, "__one.*")
    found = {r["model"]: r["auc"] for r in auc_exact(long, SCORE, LABEL, ["model"]).select("model", "auc").collect()}
    return [float("nan") if found.get(i) is None else float(found[i]) for i in range(len(models))]


def fit_all(df: DataFrame, wanted: Sequence[tuple[Learner, Mapping | None]], at_once: int = FITS_AT_ONCE) -> list[Model]:
    """A model per learner and parameters, all fitted on the rows of ``df``, ``at_once`` of them at a time."""
    fit = inheritable_thread_target(df.sparkSession)(lambda one: one[0].fit(df, one[1]))
    with ThreadPool(max(1, min(at_once, len(wanted)))) as pool:
        return pool.map(fit, wanted, chunksize=1)


def cross_validate(
    df: DataFrame, learner: Learner, params: Mapping | None = None, *, fold: str = "fold", k: int, test: DataFrame | None = None, row: str = "row_id"
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Out-of-fold scores of every row, AUC per fold, and test scores averaged over the folds.

    ``df`` is read once per fold and should be a stored table.
    """
    held_out, tests = [], []
    for i in range(k):
        model = learner.fit(df.filter(F.col(fold) != i), params)
        held_out.append(score(model, df.filter(F.col(fold) == i)))
        if test is not None:
            tests.append(score(model, test).select(row, SCORE))
    oof = reduce(DataFrame.unionByName, held_out)
    per_fold = auc_exact(oof, SCORE, LABEL, [fold]).select(fold, "auc")
    averaged = None
    if tests:
        averaged = reduce(DataFrame.unionByName, tests).groupBy(row).agg(F.avg(SCORE).alias(SCORE))
    return oof, per_fold, averaged


def refit_predict(train: DataFrame, test: DataFrame, learner: Learner, params: Mapping | None = None) -> DataFrame:
    """Fit on all training rows, score the test rows."""
    return score(learner.fit(train, params), test)


def validation_loss(df: DataFrame, learner: Learner, params: Mapping | None, *, holdout: float = 0.1, seed: int = 1024, row: str = "row_id") -> float:
    """1 - AUC on a seeded holdout."""
    parts = split_random(df, ratio=holdout, seed=seed, row=row)
    model = learner.fit(parts.filter("split = 'train'"), params)
    return 1.0 - auc_of(score(model, parts.filter("split = 'valid'")))


def draw_params(space: Mapping[str, Sequence], trials: int, seed: int = 0) -> list[dict]:
    """Seeded random parameter maps without repeats: ``trials`` of them, or the whole space if it is smaller.

    A map is a number in mixed radix, so that numbers are drawn and no product is listed.
    """
    names = list(space)
    sizes = [len(space[n]) for n in names]
    total = math.prod(sizes)
    out = []
    for number in random.Random(seed).sample(range(total), min(trials, total)):
        chosen = {}
        for name, size in zip(names, sizes):
            number, at = divmod(number, size)
            chosen[name] = space[name][at]
        out.append(chosen)
    return out


def tune(
    df: DataFrame, learner: Learner, *, trials: int = 10, sample: float | None = 0.1, seed: int = 0, fixed: Mapping | None = None, row: str = "row_id"
) -> DataFrame:
    """Table of trials: number, parameters as text, loss; best first, trials without a loss last."""
    data = stored(sample_exact(df, sample, seed, row=row) if sample else df, "tune")
    rows = []
    for i, params in enumerate(draw_params(learner.space, trials, seed)):
        loss = validation_loss(data, learner, {**params, **(fixed or {})}, row=row)
        if math.isnan(loss):
            warnings.warn(f"trial {i}: the holdout has one class only, so it has no loss", stacklevel=2)
        rows.append((i, str(sorted(params.items())), None if math.isnan(loss) else loss))
    trials_table = df.sparkSession.createDataFrame(rows, "trial int, params string, loss double")
    return trials_table.orderBy(F.col("loss").asc_nulls_last(), "trial")


def nested_sample(df: DataFrame, share: float, seed: int, row: str = "row_id") -> DataFrame:
    """About ``share`` of the rows, by hash: a larger share of the same seed holds every smaller one."""
    return df if share >= 1 else df.filter(seeded_hash(seed, F.col(row)) < int(share * (1 << HASH_BITS)))


def tune_halving(
    df: DataFrame, learner: Learner, *, trials: int = 8, first_share: float = 0.125, seed: int = 0, fixed: Mapping | None = None, row: str = "row_id"
) -> DataFrame:
    """Search by successive halving: all trials on a small sample, the better half on twice the rows, and so on.

    The holdout is the same in every round, so losses of a round compare; samples are nested.  Returns a row per trial and
    round: round, trial, params, rows (fitted on), loss, survived.  It ends with one trial or with all rows.
    """
    used = [c for c in dict.fromkeys((row, FEATURES, LABEL, WEIGHT)) if c in df.columns]
    parts = stored(split_random(df.select(*used), ratio=0.2, seed=seed + 1, row=row), "halving")
    train, valid = parts.filter("split = 'train'"), parts.filter("split = 'valid'")
    alive = dict(enumerate(draw_params(learner.space, trials, seed)))
    share, turn, log = first_share, 0, []
    while alive:
        sample = stored(nested_sample(train, share, seed, row), "halving-sample") if share < 1 else train
        rows = sample.count()
        # The samples double as the trials halve: fitted all at once, they hold about as many rows in every round.
        models = fit_all(sample, [(learner, {**params, **(fixed or {})}) for params in alive.values()], at_once=trials)
        losses = {t: math.inf if math.isnan(auc) else 1.0 - auc for t, auc in zip(alive, aucs_of(models, valid))}
        ranked = sorted(alive, key=lambda t: (losses[t], t))
        last = len(alive) == 1 or share >= 1
        better = ranked[:1] if last else ranked[: math.ceil(len(ranked) / 2)]
        log += [
            (turn, t, str(sorted(alive[t].items())), rows, None if math.isinf(losses[t]) else losses[t], t in better)
            for t in sorted(alive)
        ]
        if last:
            break
        alive = {t: alive[t] for t in sorted(better)}
        share, turn = min(1.0, 2 * share), turn + 1
    return df.sparkSession.createDataFrame(
        log, "round int, trial int, params string, rows long, loss double, survived boolean"
    )


def best_trial(trials: DataFrame) -> DataFrame:
    """The trial of least loss; the earliest of equals."""
    return trials.orderBy(F.col("loss").asc_nulls_last(), "trial").limit(1)


def search_loss(data: DataFrame, learner: Learner, searches: int, fixed: Mapping | None, seed: int, row: str) -> float:
    """Least validation loss over ``searches`` drawn parameter maps; of ``fixed`` alone for none."""
    drawn = draw_params(learner.space, searches, seed) if searches else [{}]
    losses = [validation_loss(data, learner, {**params, **(fixed or {})}, row=row) for params in drawn]
    known = [x for x in losses if not math.isnan(x)]
    return min(known) if known else math.inf


def select_features(
    df: DataFrame,
    learner: Learner,
    given: Sequence[str],
    candidates: Sequence[str],
    *,
    params: Mapping | None = None,
    searches: int = 10,
    passes: int = 1,
    label: str = "is_attributed",
    sample: float | None = 0.05,
    seed: int = 0,
    row: str = "row_id",
    loss_of: Callable[[Sequence[str]], float] | None = None,
) -> DataFrame:
    """Greedy forward selection over a seeded order of the candidates.

    Each candidate is judged once per pass: with it added, the learner's parameters are searched anew
    (``searches`` maps), and it is accepted if the best loss falls.  Rejected candidates come up again in the next
    pass; a pass that accepts none is the last.
    """
    data = stored(sample_exact(df, sample, seed, row=row) if sample else df, "select")

    def searched(columns: Sequence[str]) -> float:
        return search_loss(assemble(data, columns, label), learner, searches, params, seed, row)

    judge = loss_of or searched
    order = [c for c in candidates if c not in set(given)]
    random.Random(seed).shuffle(order)
    state = {"columns": list(given), "loss": judge(list(given))}

    def accepted(name: str) -> tuple[str, float, bool]:
        trial = judge([*state["columns"], name])
        better = trial < state["loss"]
        if better:
            state.update(columns=[*state["columns"], name], loss=trial)
        return name, trial, better

    log: list[tuple] = []
    for _ in range(passes):
        verdicts = [accepted(name) for name in order]
        log += verdicts
        order = [name for name, _, better in verdicts if not better]
        if len(order) == len(verdicts):
            break
    return df.sparkSession.createDataFrame(
        [(i, *verdict) for i, verdict in enumerate(log)], "attempt int, feature string, loss double, kept boolean"
    )
