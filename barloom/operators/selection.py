"""Feature screens, correlation, importance summaries, ranking and plateau choice."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.columns import attach_row
from barloom.operators.ordered import settle
from barloom.operators.quantiles import average_ranks

_NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")


def feature_columns(df: DataFrame, exclude: tuple[str, ...] = ("symbol", "ts", "y", "w")) -> list[str]:
    """Numeric columns that are neither target, weight, time nor excluded."""
    return [n for n, t in df.dtypes if t in _NUMERIC and n not in exclude and not n.startswith("_")]


def column_profile(df: DataFrame, features: list[str]) -> DataFrame:
    """Per feature: rows, missing ratio and all-missing flag, from one wide aggregate."""
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(f).alias(f) for f in features])
    d = wide.unpivot(["_n"], features, "feature", "present")
    return d.select("feature", F.col("_n").alias("rows"), "present", (1 - F.col("present") / F.col("_n")).alias("missing_ratio"),
                    (F.col("present") == 0).alias("all_missing"))


def value_counts(df: DataFrame, features: list[str]) -> DataFrame:
    """Rows per (feature, value); NULL counts as a value.  Combines map-side, so hot values stay cheap."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(F.inline(cells)).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("rows"))


def constant_features(counts: DataFrame, share: float) -> DataFrame:
    """Distinct values, dominant count, and whether a feature is constant or nearly so."""
    a = counts.groupBy("feature").agg(F.count(F.lit(1)).alias("distinct"), F.max("rows").alias("dominant"), F.sum("rows").alias("n"))
    return a.withColumns({"constant": F.col("distinct") <= 1, "near_constant": F.col("dominant") >= F.ceil(F.lit(share) * F.col("n"))})


def duplicate_features(df: DataFrame, features: list[str], ids: list[str]) -> DataFrame:
    """``(feature, duplicate_of)``: equal columns by content hash, then confirmed cell by cell; the first name stays."""
    h = df.agg(*[F.sum(F.xxhash64(*ids, F.col(f).cast("double")).cast("decimal(38,0)")).cast("string").alias(f) for f in features])
    order = F.create_map(*[x for i, f in enumerate(features) for x in (F.lit(f), F.lit(i))])
    long = h.unpivot([], features, "feature", "hash").withColumn("pos", order[F.col("feature")])
    first = long.groupBy("hash").agg(F.min_by("feature", "pos").alias("duplicate_of"), F.count(F.lit(1)).alias("c")).where("c > 1")
    pairs = [(r["feature"], r["duplicate_of"]) for r in long.join(first, "hash").where("feature <> duplicate_of").collect()]  # column names
    if not pairs:
        return long.where("false").select("feature", F.lit("").alias("duplicate_of"))
    check = df.agg(*[F.min(F.col(a).eqNullSafe(F.col(b)).cast("int")).alias(f"{a}|{b}") for a, b in pairs])
    names = [f"{a}|{b}" for a, b in pairs]
    ok = check.unpivot([], names, "pair", "same").where("same = 1")
    parts = F.split("pair", r"\|")
    return ok.select(parts[0].alias("feature"), parts[1].alias("duplicate_of"))


def rank_frame(df: DataFrame, features: list[str], ids: list[str]) -> DataFrame:
    """Average ranks of every feature, wide again; ranks are exact for any row count."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    long = df.select(*ids, F.inline(cells))
    r = average_ranks(long, ["feature"], "value", "rank")
    return r.groupBy(*ids).agg(*[F.max(F.when(F.col("feature") == f, F.col("rank"))).alias(f) for f in features])


def _paired_ranks(df: DataFrame, pairs: list[tuple[str, str]], ids: list[str]) -> DataFrame:
    """``(pair, x, y)`` average ranks of every pair over the rows where both are present."""
    cells = F.array(*[F.struct(F.lit(f"{a}|{b}").alias("pair"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in pairs])
    long = settle(df.select(*ids, F.inline(cells)).where("x IS NOT NULL AND y IS NOT NULL"))
    return average_ranks(average_ranks(long, ["pair"], "x", "rx"), ["pair"], "y", "ry").select("pair", F.col("rx").alias("x"), F.col("ry").alias("y"))


def correlation_pairs(df: DataFrame, features: list[str], spearman: bool = False, ids: list[str] = (), least_rows: int = 3) -> DataFrame:
    """``(left, right, i, j, corr)`` for every feature pair over the rows where both are present; NULL below ``least_rows``.

    Pairs of columns without NULLs come from one pass of the distributed correlation matrix.  A pair with a
    column that has NULLs ranks only its own rows, so such pairs cost a row each for each present row.
    """
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(f).alias(f"_c_{f}") for f in features]).first()
    whole = [f for f in features if counts[f"_c_{f}"] == counts["_n"]]
    every = [(a, b) for x, a in enumerate(features) for b in features[x + 1:]]
    sparse = [(a, b) for a, b in every if not (a in whole and b in whole)]
    corr: dict[tuple[str, str], float | None] = {}
    if len(whole) > 1 and counts["_n"] >= least_rows:
        d = rank_frame(df, whole, list(ids)) if spearman else df
        vec = VectorAssembler(inputCols=whole, outputCol="_v").transform(d.select(*[F.col(f).cast("double") for f in whole]))
        m = Correlation.corr(vec, "_v", "pearson").first()[0].toArray()  # features x features
        corr = {(a, b): float(m[x, y]) for x, a in enumerate(whole) for y, b in enumerate(whole)}
    if sparse:
        present = F.array(*[F.struct(F.lit(f"{a}|{b}").alias("pair"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in sparse])
        long = _paired_ranks(df, sparse, list(ids)) if spearman else df.select(F.inline(present)).where("x IS NOT NULL AND y IS NOT NULL")
        for r in long.groupBy("pair").agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")).alias("c")).collect():  # feature pairs
            a, _, b = r["pair"].partition("|")
            corr[a, b] = r["c"] if r["n"] >= least_rows else None
    known = {k: v for k, v in corr.items() if v is not None and v == v}
    rows = [(a, b, features.index(a), features.index(b), known.get((a, b))) for a, b in every]
    return df.sparkSession.createDataFrame(rows, "left string, right string, i int, j int, corr double")


def drop_correlated(pairs: list[tuple[str, str, float | None]], features: list[str], threshold: float) -> list[tuple[str, str, float]]:
    """``(dropped, kept, corr)``: a feature falls to the earliest kept one it correlates with."""
    kept: list[str] = []
    table = {frozenset((a, b)): c for a, b, c in pairs if c is not None}
    out = []
    for f in features:
        hit = next(((k, table[frozenset((k, f))]) for k in kept if abs(table.get(frozenset((k, f)), 0.0)) >= threshold), None)
        if hit:
            out.append((f, *hit))
        else:
            kept.append(f)
    return out


def correlation_drop(df: DataFrame, features: list[str], threshold: float, ids: list[str] = ()) -> DataFrame:
    """``(dropped, kept, corr)`` of the greedy drop over pairwise-complete rank correlations, in feature order."""
    pairs = [(r["left"], r["right"], r["corr"]) for r in correlation_pairs(df, features, True, ids).collect()]  # feature pairs
    return df.sparkSession.createDataFrame(drop_correlated(pairs, features, threshold), "dropped string, kept string, corr double")


def strong_correlations(df: DataFrame, features: list[str], threshold: float, ids: list[str]) -> DataFrame:
    """Pairs at or above the threshold, exact on all rows: the whole matrix is one pass, so no sample screens it."""
    return correlation_pairs(df, features, spearman=True, ids=ids).where(F.abs("corr") >= threshold)


def prefilter_report(steps: dict[str, DataFrame]) -> DataFrame:
    """``(step, feature)`` rows of all screens."""
    out = None
    for name, d in steps.items():
        part = d.select(F.lit(name).alias("step"), "feature")
        out = part if out is None else out.unionByName(part)
    return out


def importance_summary(per_fold: DataFrame, fold_weight: Column, folds: int, min_folds: int, fraction: float) -> DataFrame:
    """Over folds: use, mean/median/weighted gain, eligibility, rank, and the candidate cut."""
    used = F.col("gain") > 0
    a = per_fold.groupBy("feature").agg(
        F.count_if(used).alias("used_folds"), (F.count_if(used) / folds).alias("used_ratio"), F.avg("gain").alias("mean_gain"),
        F.percentile("gain", 0.5).alias("median_gain"), (F.sum(F.col("gain") * fold_weight) / F.sum(fold_weight)).alias("weighted_gain"),
        F.sum("splits").alias("splits"))
    a = a.withColumn("eligible", F.col("used_folds") >= min_folds)
    w = Window.orderBy(F.col("eligible").desc(), F.col("weighted_gain").desc(), F.col("median_gain").desc(), "feature")  # one row per feature
    total = Window.partitionBy()
    a = a.withColumns({"rank": F.row_number().over(w), "_e": F.sum(F.col("eligible").cast("int")).over(total)})
    return a.withColumn("candidate", F.col("eligible") & (F.col("rank") <= F.greatest(F.floor(F.col("_e") * fraction), F.lit(1)))).drop("_e")


def permuted(df: DataFrame, features: list[str], seeds: list[int], keys: list[str], idx: str) -> DataFrame:
    """Every row once per (feature, repeat) with that feature taken from another row of the same fold.

    The permutation is a seeded affine map of row positions, ``(a * i + b) mod n``
    with ``a`` coprime to ``n``, so it is an equi-join on position and needs no sort.
    """
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    w = df.join(n, keys)
    reps = w.withColumn("repeat", F.explode(F.array(*[F.lit(s) for s in seeds]))).withColumn(
        "permuted", F.explode(F.array(*[F.lit(f) for f in features])))
    step = F.when(F.col("_n") % 104_729 == 0, 104_723).otherwise(104_729)  # a prime that does not divide n
    shift = F.pmod(F.xxhash64("repeat", "permuted"), F.col("_n"))
    reps = reps.withColumn("_src", F.pmod(F.col(idx) * step + shift, F.col("_n")))
    src = df.select(*keys, F.col(idx).alias("_src"), *[F.col(f).alias(f"p_{f}") for f in features])
    j = reps.join(src, [*keys, "_src"])
    return j.withColumns({f: F.when(F.col("permuted") == f, F.col(f"p_{f}")).otherwise(F.col(f)) for f in features}).drop(
        *[f"p_{f}" for f in features], "_n", "_src")


def permutation_summary(losses: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """Loss increase per feature over folds and repeats."""
    d = losses.join(base.select(key, F.col("log_loss").alias("_b")), key).withColumn("delta", F.col("log_loss") - F.col("_b"))
    return d.groupBy("permuted").agg(F.avg("delta").alias("mean_delta"), F.percentile("delta", 0.5).alias("median_delta"),
                                     F.stddev_pop("delta").alias("std_delta"), F.count(F.lit(1)).alias("runs"))


def final_ranking(prescreen: DataFrame, permutation: DataFrame) -> DataFrame:
    """Permuted features first by their effect, the rest by prescreen rank."""
    d = prescreen.join(permutation, "feature", "left")
    w = Window.orderBy(F.col("mean_delta").isNull(), F.col("mean_delta").desc(), "rank", "feature")  # one row per feature
    return d.withColumn("final_rank", F.row_number().over(w))


def geometric_grid(total: int, smallest: int, ratio: float) -> list[int]:
    out, k = [], float(total)
    while k > smallest:
        out.append(int(round(k)))
        k /= ratio
    return sorted({*out, min(smallest, total)})


def midpoints(done: list[int], best: int) -> list[int]:
    """Untried midpoints next to the best size."""
    s = sorted(done)
    i = s.index(best)
    around = [(s[i - 1], best)] if i else []
    around += [(best, s[i + 1])] if i + 1 < len(s) else []
    return [m for a, b in around if (m := (a + b) // 2) not in s]


def plateau(sweep: DataFrame, tolerance: float, min_saving: float) -> DataFrame:
    """Smallest size whose objective stays within tolerance of the best and saves enough features."""
    best = sweep.agg(F.min_by("k", F.struct("objective", "k")).alias("best_k"), F.min("objective").alias("best"))
    d = attach_row(sweep, best).where(F.col("objective") <= F.col("best") * (1 + tolerance))
    c = d.groupBy("best_k", "best").agg(F.min_by(F.struct("k", "objective"), "k").alias("c"))
    saves = 1 - F.col("c.k") / F.col("best_k") >= min_saving
    return c.select(F.when(saves, F.col("c.k")).otherwise(F.col("best_k")).alias("chosen_k"), "best_k", "best")
