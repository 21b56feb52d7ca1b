"""Model fits, walk-forward predictions and seeded searches as Spark jobs."""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from barloom.functions.columns import attach_row
from barloom.operators import metrics as mt, targets as tg
from barloom.operators.indicators import add_indicators
from barloom.operators.ordered import BARS, Layout, index_rows, settle
from barloom.operators.selection import geometric_grid, midpoints

WORKERS = 4                         # fits that are submitted at a time
MOST_FOLDS = 62                     # bits of a set
MEDIAN_FROM = 3                     # trials before one can be pruned


def pipeline(features: list[str], params: dict, label: str = "y", weight: str = "w") -> Pipeline:
    """Median imputation, assembly and a weighted binary model; ``params['kind']`` is ``gbt`` or ``logistic``."""
    p = dict(params)
    kind = p.pop("kind", "logistic")
    imputed = [f"_f_{f}" for f in features]
    stages = [Imputer(inputCols=features, outputCols=imputed, strategy="median"),
              VectorAssembler(inputCols=imputed, outputCol="_features")]
    common = {"featuresCol": "_features", "labelCol": label, "weightCol": weight}
    stages.append(GBTClassifier(**common, **p) if kind == "gbt" else LogisticRegression(**common, **p))
    return Pipeline(stages=stages)


def fit(train: DataFrame, features: list[str], params: dict) -> PipelineModel:
    casted = train.withColumns({f: F.col(f).cast("double") for f in features})
    return pipeline(features, params).fit(casted)


def score(model: PipelineModel, rows: DataFrame, features: list[str], out: str = "p") -> DataFrame:
    casted = rows.withColumns({f: F.col(f).cast("double") for f in features})
    done = model.transform(casted)
    return done.select(*[c for c in rows.columns if c != out], vector_to_array("probability")[1].alias(out))


def _importance(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    last = model.stages[-1]
    vec = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    return [(f, float(abs(v))) for f, v in zip(features, vec.toArray())]


@dataclass(frozen=True)
class FoldRows:
    """Rows written once, with the folds in which each of them trains and is tested as two bit sets."""

    rows: DataFrame
    folds: list[int]
    live: dict[int, list[str]]          # features with any value in a fold's training rows

    def part(self, fold: int, role: str) -> DataFrame:
        return self.rows.where(F.getbit(f"_{role}", F.lit(fold)) == 1).drop("_train", "_test")


def fold_rows(indexed: DataFrame, features: list[str], folds: int, ratio: float, decision: str | None = None, mode: str = "all") -> FoldRows:
    """One table for all fits: a row is stored once however many folds it takes part in, and fits read it by filter."""
    if folds > MOST_FOLDS:
        raise ValueError(f"at most {MOST_FOLDS} folds")
    rows = settle(indexed)
    table = tg.fold_table(rows.sparkSession, 0, rows.agg(F.count(F.lit(1)).alias("n")), folds, ratio).orderBy("fold").collect()   # one row a fold
    pick = F.col(decision) if decision else F.lit(True)
    i = F.col("row_idx")

    def bits(role: str, wanted: Column) -> Column:
        inside = [F.when((i >= r[f"{role}_start"]) & (i < r[f"{role}_end"]), F.lit(1 << r["fold"])).otherwise(0) for r in table]
        return F.when(wanted, reduce(add, inside, F.lit(0).cast("bigint"))).otherwise(0).alias(f"_{role}")

    wanted = {role: pick if mode in ("decision", f"{name}_decision") else F.lit(True) for role, name in (("train", "train"), ("test", "eval"))}
    kept = settle(rows.select("*", *[bits(role, w) for role, w in wanted.items()]).where((F.col("_train") != 0) | (F.col("_test") != 0)))
    numbers = [r["fold"] for r in table]
    if not numbers:
        return FoldRows(kept, [], {})
    found = kept.agg(*[F.count_if((F.getbit("_train", F.lit(n)) == 1) & F.col(f).isNotNull()).alias(f"{n}|{f}") for n in numbers for f in features]).first()
    return FoldRows(kept, numbers, {n: [f for f in features if found[f"{n}|{f}"]] for n in numbers})


def together(job: Callable, items: list, workers: int = WORKERS) -> list:
    """Results of ``job`` for each item, in order; so many driver threads submit Spark jobs, which share the executors."""
    with ThreadPoolExecutor(workers) as pool:
        return list(pool.map(job, items))


def _weighted(rows: DataFrame, weight: Column | None) -> DataFrame:
    return rows if weight is None else rows.withColumn("w", weight)


def fit_fold(data: FoldRows, fold: int, features: list[str], params: dict, weight: Column | None = None) -> tuple[DataFrame, list]:
    """Predictions of a fold's test rows and the model's importance."""
    live = [f for f in data.live[fold] if f in features]
    model = fit(_weighted(data.part(fold, "train"), weight), live, params)
    out = score(model, _weighted(data.part(fold, "test").drop("p"), weight).withColumn("fold", F.lit(fold)), live)
    return out, [(fold, f, g) for f, g in _importance(model, live)]


def fold_score(data: FoldRows, fold: int, features: list[str], params: dict, weight: Column | None = None):
    """Metrics of one fit: one row."""
    return mt.metrics_by(fit_fold(data, fold, features, params, weight)[0], ["fold"]).first()


def walk_forward(indexed: DataFrame, features: list[str], folds: int, ratio: float, params: dict,
                 decision: str | None = None, mode: str = "all") -> tuple[DataFrame, DataFrame]:
    """Out-of-fold predictions and per-fold importance; each fold trains on rows before its test range."""
    data = fold_rows(indexed, features, folds, ratio, decision, mode)
    made = together(lambda n: fit_fold(data, n, features, params), data.folds)
    preds = None
    for out, _ in made:
        preds = out if preds is None else preds.unionByName(out)
    gains = [g for _, own in made for g in own]
    return preds, indexed.sparkSession.createDataFrame(gains, "fold bigint, feature string, gain double")


def coverage(preds: DataFrame, rows: DataFrame) -> DataFrame:
    n = rows.agg(F.count(F.lit(1)).alias("rows"))
    return attach_row(preds.agg(F.count("p").alias("predicted"), F.count_distinct("fold").alias("folds")), n).withColumn(
        "coverage", F.col("predicted") / F.col("rows"))


def trials(space: dict[str, list], n: int, seed: int) -> list[dict]:
    """``n`` distinct seeded draws from the option lists, the whole product when it is smaller."""
    names = sorted(space)
    size = 1
    for k in names:
        size *= len(space[k])
    if size <= n:
        return [dict(zip(names, v)) for v in itertools.product(*[space[k] for k in names])]
    rng, seen = random.Random(seed), {}
    while len(seen) < n:
        t = {k: rng.choice(space[k]) for k in names}
        seen.setdefault(tuple(t.items()), t)
    return list(seen.values())


def search(indexed: DataFrame, features: list[str], space: dict[str, list], n: int, seed: int, folds: int, ratio: float,
           penalty: float = 0.0, weight_of=None) -> DataFrame:
    """One row per trial with its fold summary.

    All trials fit their first fold, several at a time.  Then, in the order of trials, one whose first loss is worse than the
    median of those before it (three at least) is pruned and fits no other fold; its summary is that of the first.
    The rest fit their other folds, again several at a time, so results do not depend on which fit ends first.
    """
    data = fold_rows(indexed, features, folds, ratio)
    tried = trials(space, n, seed)

    def run(job: tuple[int, int]):
        trial, fold = job
        params = {k: v for k, v in tried[trial].items() if not k.startswith("weight_")}
        got = fold_score(data, fold, features, params, None if weight_of is None else weight_of(tried[trial]))
        return trial, fold, float(got["w_log_loss"])

    first, rest = data.folds[:1], data.folds[1:]
    done = together(run, [(t, f) for t in range(len(tried)) for f in first])
    losses = [loss for _, _, loss in done]
    pruned = [i >= MEDIAN_FROM and loss > sorted(losses[:i])[i // 2] for i, loss in enumerate(losses)]
    done += together(run, [(t, f) for t in range(len(tried)) if not pruned[t] for f in rest])
    spark = indexed.sparkSession
    summary = mt.fold_summary(spark.createDataFrame(done, "trial int, fold int, w_log_loss double"), ["trial"], "w_log_loss", None, penalty)
    named = [(i, str(sorted(t.items())), seed, "pruned" if p else "complete") for i, (t, p) in enumerate(zip(tried, pruned))]
    return spark.createDataFrame(named, "trial int, params string, seed int, state string").join(summary, "trial").select(
        "trial", "params", "seed", "mean", F.coalesce("std", F.lit(0.0)).alias("std"), "objective", "state")


def best_trial(results: DataFrame) -> DataFrame:
    return results.where("state = 'complete'").orderBy("objective", "trial").limit(1)


def candidate_pairs(extremes: DataFrame, middles: DataFrame, options: DataFrame) -> DataFrame:
    """Valid quantile pairs crossed with metric options; sizes are the option lists'."""
    pairs = extremes.join(middles, F.col("q_ext") + F.col("q_mid") <= 0.5)
    return pairs.crossJoin(options)


def population(space_size, base: int) -> Column:
    """Population grows with the logarithm of the search space and never falls below the base."""
    return F.greatest(F.lit(base), F.ceil(F.lit(base) * (1 + F.log10(F.col(space_size).cast("double")) / 10))).cast("int")


def contexts(subsets: DataFrame, views: DataFrame, profiles: DataFrame) -> DataFrame:
    """Every subset x view x profile once per distinct feature set."""
    c = subsets.crossJoin(views).crossJoin(profiles)
    kept = F.array_sort(F.array_distinct(F.filter("features", lambda f: F.regexp_like(f, F.col("pattern")))))
    c = c.withColumn("features", kept).where(F.size("features") > 0)
    c = c.withColumn("signature", F.sha2(F.concat_ws("|", F.array_join("features", ","), "profile"), 256))
    return c.groupBy("signature").agg(F.min(F.struct("subset", "view", "profile", F.array_join("features", ",").alias("names"))).alias("_c")).select("signature", "_c.*")


def indicator_search(bars: DataFrame, indicator: str, candidates: list[dict], target: str, scoring: dict, layout: Layout = BARS) -> DataFrame:
    """Score many parameter sets of one indicator at once.

    All candidates share one request table, so their common averages are built
    once; scores come from one long table with the candidate in the key.
    """
    specs = [(f"c{i}", indicator, p) for i, p in enumerate(candidates)]
    wide = settle(add_indicators(index_rows(bars, layout), specs, layout))
    names = [n for n, _, _ in specs]
    cells = F.array(*[F.struct(F.lit(n).alias("candidate"), F.col(n).alias("x")) for n in names])
    long = settle(wide.where(F.col(target).isNotNull()).select(*layout.key, layout.time, F.col(target).alias("t"), F.inline(cells)).where("x IS NOT NULL"))
    lay = Layout(key=("candidate",), time=layout.time, base_seconds=layout.base_seconds, rows=layout.rows)
    pos = index_rows(long, lay, "row_idx", order=layout.key)
    s = mt.segment_scores(settle(pos), "x", "t", keys=["candidate"], **scoring)
    return mt.information_ratio(settle(s), scoring["segments"], keys=["candidate"])


def next_generation(scored: list[tuple[str, float]], candidates: list[dict], space: dict[str, list], n: int, seed: int) -> list[dict]:
    """New candidates from the better half: one parameter of a parent drawn again."""
    order = sorted(scored, key=lambda s: -s[1])
    parents = [candidates[int(c[1:])] for c, _ in order[: max(1, len(order) // 2)]]
    rng, out = random.Random(seed), []
    while len(out) < n:
        child = dict(rng.choice(parents))
        k = rng.choice(sorted(space))
        child[k] = rng.choice(space[k])
        out.append(child)
    return out


def evaluate(contexts: dict[str, tuple[DataFrame, list[str]]], candidates: dict[str, dict], folds: int, ratio: float) -> DataFrame:
    """Walk-forward log loss and Brier score for every context and candidate.

    A candidate holds model parameters and optionally ``decision_weight``, the sample weight of decision rows.  The rows of
    a context are written once for all its candidates and folds, and all fits of the grid run several at a time.
    """
    data = {name: fold_rows(rows, features, folds, ratio) for name, (rows, features) in contexts.items()}

    def run(job: tuple[str, str, int]):
        context, candidate, fold = job
        p = dict(candidates[candidate])
        dw = p.pop("decision_weight", None)
        weight = None if dw is None else F.when(F.col("decision"), dw).otherwise((1 - dw) / 4)
        m = fold_score(data[context], fold, contexts[context][1], p, weight)
        return context, candidate, fold, m["rows"], m["log_loss"], m["brier"], m["w_log_loss"]

    done = together(run, [(c, k, f) for c in contexts for k in candidates for f in data[c].folds])
    spark = next(iter(contexts.values()))[0].sparkSession
    return spark.createDataFrame(done, "context string, candidate string, fold bigint, rows bigint, log_loss double, brier double, w_log_loss double")


def recheck(rows: DataFrame, features: list[str], top: dict[str, dict], seeds: list[int], folds: int, ratio: float) -> DataFrame:
    """Top trials again over several seeds: mean and deviation per trial."""
    grid = {f"{n}|{s}": {**p, "seed": s} for n, p in top.items() for s in seeds}
    r = evaluate({"all": (rows, features)}, grid, folds, ratio)
    r = r.withColumn("trial", F.split("candidate", r"\|")[0])
    return mt.fold_summary(r, ["trial"], "log_loss", None, 0.0)


def weight_grid(coarse: list[float]) -> dict[str, dict]:
    return {f"w{v:g}": {"decision_weight": v} for v in coarse}


def refine(coarse: list[float], best: float) -> list[float]:
    """Midpoints around the best coarse value."""
    s = sorted(coarse)
    i = s.index(best)
    return [(s[j] + best) / 2 for j in (i - 1, i + 1) if 0 <= j < len(s)]


def weight_search(rows: DataFrame, features: list[str], coarse: list[float], params: dict, folds: int, ratio: float) -> DataFrame:
    """Decision weight by grid, then around its best value."""
    def run(values):
        return evaluate({"all": (rows, features)}, {k: {**params, **v} for k, v in weight_grid(values).items()}, folds, ratio)
    first = run(coarse)
    best = mt.fold_summary(first, ["candidate"], "log_loss").orderBy("objective", "candidate").first()["candidate"]  # one row per candidate
    return first.unionByName(run(refine(coarse, float(best[1:]))))


def size_sweep(rows: DataFrame, ranked: list[str], smallest: int, ratio: float, params: dict, folds: int, fold_ratio: float) -> DataFrame:
    """Objective per top-k size: geometric sizes first, then midpoints next to the best."""
    def run(sizes):
        ctx = {str(k): (rows, ranked[:k]) for k in sizes}
        return mt.fold_summary(evaluate(ctx, {"fixed": params}, folds, fold_ratio), ["context"], "log_loss").select(
            F.col("context").cast("int").alias("k"), "objective")
    sizes = geometric_grid(len(ranked), smallest, ratio)
    first = run(sizes)
    best = first.orderBy("objective", "k").first()["k"]  # one row per size
    more = midpoints(sizes, best)
    return first if not more else first.unionByName(run(more))
