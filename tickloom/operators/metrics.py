"""Evaluation: bucketed errors, quantile edges, rank metrics, alignment, spread, bootstrap."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.align import bracketing_events, nearest_event
from tickloom.operators.ordered import bounded_groups, counted_quantiles, framed, hash_order, join_on, per_key, quantiles, ranked, rsum, running, value_counts
from tickloom.session import stored

SEXTILES = {f"q{i}": i / 6 for i in range(1, 6)}


def displacement_edges(rows: DataFrame, size: str, floor: float, keys: Sequence[str] = (), count: str | None = None) -> DataFrame:
    """Sextile edges of the moving rows, how many stand still, and the median of the top sextile.

    With ``count`` a row stands for so many rows of its key and size, and no pair comes twice. Sizes are counted
    once and stored, so that the steps read counts and not the rows again.
    """
    if not keys:
        one = "__g"
        flagged = rows.withColumn(one, F.when(F.col(size).isNull(), 1).otherwise(0))
        return displacement_edges(flagged, size, floor, [one], count).drop(one)
    counted = rows if count else stored(value_counts(rows, keys, size), "sizes")
    n = F.col(count or "__cnt")
    counted = counted.select(*keys, size, n.alias("__cnt"))
    with bounded_groups([(counted, keys)]):
        moving = counted.filter(F.col(size) >= floor)
        edges = stored(counted_quantiles(moving, keys, size, "__cnt", SEXTILES), "edges")
        top = join_on(moving, edges.select(*keys, "q5"), keys, "inner").filter(F.col(size) >= F.col("q5"))
        median = counted_quantiles(top.drop("q5"), keys, size, "__cnt", {"top_median": 0.5}).drop("n")
    known = F.sum(F.when(F.col(size).isNotNull(), F.col("__cnt")))
    still = counted.groupBy(*keys).agg((F.coalesce(F.sum(F.when(F.col(size) < floor, F.col("__cnt"))), F.lit(0)) / known).alias("still_share"))
    return join_on(join_on(edges, still, keys, "inner"), median, keys, "inner")


def least_squares_alpha(rows: DataFrame, true: Sequence[Column], predicted: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """Scalar damping: sum of true·predicted over predicted·predicted."""
    dot = sum((t * p for t, p in zip(true, predicted)), F.lit(0.0))
    own = sum((p * p for p in predicted), F.lit(0.0))
    return rows.groupBy(*keys).agg((F.sum(dot) / F.sum(own)).alias("alpha"), F.count(F.lit(1)).alias("n"))


def bucketed_skill(rows: DataFrame, buckets: Sequence[str], baselines: Sequence[str], model: str) -> DataFrame:
    """Mean errors per bucket, the best baseline by name, and the model's skill over it in percent."""
    g = rows.groupBy(*buckets).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in (*baselines, model)])
    best = F.least(*[F.col(c) for c in baselines]) if len(baselines) > 1 else F.col(baselines[0])
    name = F.coalesce(*[F.when(F.col(c) == best, F.lit(c)) for c in baselines])
    skill = F.when(best > 0, (best - F.col(model)) / best * 100).otherwise(0.0)
    return g.withColumns({"best_baseline": name, "skill_pct": skill})


def min_median_k(rows: DataFrame, errors: str, copy_error: str, buckets: Sequence[str]) -> DataFrame:
    """Best-of-K and lower-median-of-K errors per bucket, and the coverage gained over copying."""
    middle = F.element_at(F.array_sort(errors), F.ceil(F.size(errors) / 2).cast("int"))
    g = rows.groupBy(*buckets).agg(
        F.count(F.lit(1)).alias("n"), F.avg(copy_error).alias("copy"), F.avg(F.array_min(errors)).alias("min_k"), F.avg(middle).alias("median_k")
    )
    return g.withColumn("cover_pct", F.when(F.col("copy") > 0, (F.col("copy") - F.col("min_k")) / F.col("copy") * 100).otherwise(0.0))


def huber(error: Column) -> Column:
    """Quadratic within 1, linear beyond."""
    size = F.abs(error)
    return F.when(size < 1, 0.5 * error * error).otherwise(size - 0.5)


def error_by(rows: DataFrame, keys: Sequence[str], errors: dict[str, Column]) -> DataFrame:
    """Mean of each error expression per key (feature group, roll-out depth…)."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(e).alias(n) for n, e in errors.items()])


def auc(rows: DataFrame, keys: Sequence[str], score: str, label: str, ties: str = "average", tie: Sequence[str] = ()) -> DataFrame:
    """Rank AUC per key; null when only one class is present.

    ``average`` splits ties (works on one row per distinct score); ``ordinal`` ranks tied
    scores in ``tie`` order.
    """
    rows = rows.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    base, group = (rows, list(keys)) if keys else (rows.withColumn("__g", F.col(score).isNull()), ["__g"])
    pos, neg = F.col("__p"), F.col("__n")
    if ties == "ordinal":
        placed = ranked(base, group, score, "__r", tie=tie)
        hit = F.col(label) > 0.5
        g = placed.groupBy(*group).agg(F.sum(F.when(hit, F.col("__r"))).alias("__s"), F.count_if(hit).alias("__p"), F.count_if(~hit).alias("__n"))
        value = (F.col("__s") - pos * (pos + 1) / 2) / (pos * neg)
    else:
        hit = F.col(label) > 0.5
        per = base.groupBy(*group, score).agg(F.count_if(hit).alias("__p"), F.count_if(~hit).alias("__n"))
        with bounded_groups([(base, group)]):
            below = running(per, group, score, {"__b": rsum(neg)}, exclusive=True)
        wins = pos * (F.coalesce("__b", F.lit(0)) + 0.5 * neg)
        g = below.groupBy(*group).agg(F.sum(wins).alias("__s"), F.sum("__p").alias("__p"), F.sum("__n").alias("__n"))
        value = F.col("__s") / (pos * neg)
    return g.select(*keys, pos.alias("n_pos"), neg.alias("n_neg"), F.when((pos > 0) & (neg > 0), value).alias("auc"))


def pairwise_auc(rows: DataFrame, target: str, others: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """How often the target's score beats each other one (a tie is half a win) and the mean of those rates."""

    def wins(o):
        return F.when(F.col(target) > F.col(o), 1.0).when(F.col(target) == F.col(o), 0.5).otherwise(0.0)

    g = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(wins(o)).alias(f"beats_{o}") for o in others])
    return g.withColumn("auc", sum((F.col(f"beats_{o}") for o in others), F.lit(0.0)) / len(others))


def not_beaten(rows: DataFrame, target: str, others: Sequence[str]) -> DataFrame:
    """Rows where the target fails to outrank somebody, with the names."""
    failed = F.array_compact(F.array(*[F.when(F.col(target) <= F.col(o), F.lit(o)) for o in others]))
    return rows.withColumn("failed_against", failed).filter(F.size("failed_against") > 0)


def detection_quality(detections: DataFrame, truth: DataFrame, keys: Sequence[str], order: str, tolerance: int) -> DataFrame:
    """Precision and recall within a tolerance, each side matched to its nearest counterpart."""
    p = nearest_event(detections.select(*keys, order), truth, keys, order, tie="earlier", name="hit")
    r = nearest_event(truth.select(*keys, order), detections, keys, order, tie="earlier", name="hit")

    def share(df, side):
        near = F.coalesce(F.abs(F.col(order) - F.col("hit.at")) <= tolerance, F.lit(False))
        return df.agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("n"), F.count_if(near).alias("matched"), F.avg(near.cast("double")).alias("rate"))

    return share(p, "precision").unionByName(share(r, "recall"))


def match_deltas(detections: DataFrame, truth: DataFrame, keys: Sequence[str], order: str, tolerance: int) -> DataFrame:
    """Signed distance of every detection to its nearest truth within the tolerance."""
    hit = nearest_event(detections, truth, keys, order, tie="earlier", max_distance=tolerance, name="hit").filter("hit IS NOT NULL")
    return hit.withColumn("delta", F.col(order) - F.col("hit.at")).drop("hit")


def greedy_matches(detections: DataFrame, truth: DataFrame, episode: Sequence[str], order: str, tolerance: int) -> DataFrame:
    """One-to-one matching in detection order: each takes the nearest unused truth within tolerance.

    What is left depends on earlier choices, so it is sequential. Chains of events that cannot
    influence each other are cut first: wherever two neighbours lie further apart than the
    tolerance no match can cross, so each chain is an independent unit of work. A chain is
    walked as a stream that remembers only the events within one tolerance.
    """
    both = detections.select(*episode, order, F.lit(1).alias("det")).unionByName(truth.select(*episode, order, F.lit(0).alias("det")))

    def gap(w):
        return {"__cut": F.coalesce((F.col(order) - F.lag(order).over(w) > tolerance).cast("int"), F.lit(1))}

    cut = framed(both, episode, order, gap, before=1, after=0, tie=["det"])
    clusters = running(cut, episode, order, {"cluster": rsum(F.col("__cut"))}, tie=["det"]).drop("__cut")
    keys = [*episode, "cluster"]
    placed = clusters.repartition(*keys).sortWithinPartitions(*keys, order, "det")

    def walk(batches):
        from collections import deque

        import pandas as pd

        key, waiting, open_, counts = None, deque(), [], None

        def decide(now):
            while waiting and (now is None or waiting[0] + tolerance < now):
                d = waiting.popleft()
                near = [t for t in open_ if abs(t - d) <= tolerance]
                if near:
                    open_.remove(min(near, key=lambda t: abs(t - d)))
                    counts[0] += 1
                else:
                    counts[1] += 1
            floor = (waiting[0] if waiting else now) - tolerance if (waiting or now is not None) else None
            gone = [t for t in open_ if floor is None or t < floor]
            counts[2] += len(gone)
            open_[:] = [t for t in open_ if floor is not None and t >= floor]

        for pdf in batches:
            done = []
            for *k, at, det in zip(*[pdf[c] for c in (*keys, order, "det")]):
                if tuple(k) != key:
                    if key is not None:
                        decide(None)
                        done.append((*key, *counts))
                    key, counts = tuple(k), [0, 0, 0]
                decide(at)
                waiting.append(at) if det else open_.append(at)
            yield pd.DataFrame(done, columns=[*keys, "tp", "fp", "fn"])
        if key is not None:
            decide(None)
            yield pd.DataFrame([(*key, *counts)], columns=[*keys, "tp", "fp", "fn"])

    types = dict(both.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in episode) + ", cluster bigint, tp bigint, fp bigint, fn bigint"
    per = placed.mapInPandas(walk, schema)
    return per.groupBy(*episode).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def follow_counts(rows: DataFrame, conflict: Column, truth_facing: Column, pred_facing: Column) -> DataFrame:
    """On conflict rows, how often truth and prediction follow the facing; bias in points."""
    g = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(conflict).alias("n_conflict"),
        F.count_if(conflict & truth_facing).alias("truth_facing"),
        F.count_if(conflict & pred_facing).alias("pred_facing"),
    )
    base = F.greatest(F.lit(1), F.col("n_conflict"))
    return g.withColumn("bias_pp", 100 * F.col("pred_facing") / base - 100 * F.col("truth_facing") / base)


def surprise(rows: DataFrame, frame: Sequence[str], nll: str, alive: str) -> DataFrame:
    """Mean surprise of the living per frame; a sum would fall with every elimination."""
    return rows.groupBy(*frame).agg(F.avg(F.when(F.col(alive), F.col(nll))).alias("surprise"), F.count_if(alive).alias("n_alive"))


def alignment_lift(boundaries: DataFrame, events: DataFrame, lengths: DataFrame, episode: Sequence[str], position: str, windows: Sequence[int]) -> DataFrame:
    """Share of events within ±W of a boundary, against random boundaries, per window."""
    near = bracketing_events(events.select(*episode, position), boundaries, episode, position)
    gap = F.least(F.col(position) - F.col("back.at"), F.col("ahead.at") - F.col(position))
    per_event = near.groupBy(*episode).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(gap <= w).alias(f"h{w}") for w in windows])
    picks = boundaries.groupBy(*episode).agg(F.count(F.lit(1)).alias("k"))
    full = join_on(join_on(per_event, lengths.select(*episode, "length"), episode, "inner"), picks, episode, "left")

    def chance(w):
        single = F.least(F.lit(1.0), F.lit(2.0 * w + 1) / F.col("length"))
        return (1 - F.pow(1 - single, F.coalesce("k", F.lit(0)))) * F.col("n")

    sums = full.agg(F.sum("n").alias("n_events"), *[x for w in windows for x in (F.sum(f"h{w}").alias(f"h{w}"), F.sum(chance(w)).alias(f"r{w}"))])
    rows = F.array(*[F.struct(F.lit(w).cast("long").alias("window"), (F.col(f"h{w}") / F.col("n_events")).alias("align"), (F.col(f"r{w}") / F.col("n_events")).alias("random")) for w in windows])
    out = sums.select("n_events", F.inline(rows))
    return out.withColumn("lift", F.col("align") - F.col("random"))


def timing_errors(rows: DataFrame, true_time: str, pred_time: str, true_type: str, pred_type: str) -> DataFrame:
    """Quantiles of the absolute timing error per (type, type correct)."""
    flagged = rows.withColumns({"correct": F.col(true_type) == F.col(pred_type), "__e": F.abs(F.col(true_time) - F.col(pred_time)).cast("double")})
    return quantiles(flagged, [true_type, "correct"], "__e", {"p25": 0.25, "median": 0.5, "p75": 0.75})


def vector_mean(column: str, size: int) -> Column:
    """Element-wise mean of a vector column of known length."""
    return F.array(*[F.avg(F.col(column)[i].cast("double")) for i in range(size)])


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def cluster_tightness(rows: DataFrame, vector: str, label: str, size: int, least: int = 3) -> DataFrame:
    """Mean within-class distance over the global spread; classes with fewer than ``least`` rows are left out."""
    rows = rows.select(label, F.transform(vector, lambda x: x.cast("double")).alias("__v"))
    centre = rows.agg(vector_mean("__v", size).alias("m")).first()["m"]  # one vector
    mid = F.array(*[F.lit(x) for x in centre])
    per_class = rows.groupBy(label).agg(vector_mean("__v", size).alias("__c"), F.count(F.lit(1)).alias("__n"))
    d = join_on(rows, per_class, [label], "inner").select(label, "__n", distance(F.col("__v"), F.col("__c")).alias("own"), distance(F.col("__v"), mid).alias("all"))
    g = d.groupBy(label).agg(F.avg("own").alias("own"), F.sum("all").alias("all"), F.max("__n").alias("n"))
    return g.agg(
        F.count_if(F.col("n") >= least).alias("classes"),
        (F.avg(F.when(F.col("n") >= least, F.col("own"))) / (F.sum("all") / F.sum("n"))).alias("ratio"),
    )


def group_advantages(rows: DataFrame, group: Sequence[str], reward: str, passed: Column, floor: float = 1e-8) -> DataFrame:
    """Mean, sample spread, mean-centred advantage, skip flag and passes of each sibling group."""
    stats = [F.avg(reward).alias("group_mean"), F.stddev_samp(reward).alias("group_std"), F.count_if(passed).alias("passes")]
    out = per_key(rows, group, stats)
    return out.withColumns(
        {"advantage": F.col(reward) - F.col("group_mean"), "skipped": F.coalesce(F.col("group_std") < floor, F.lit(False))}
    )


def spread_audit(rows: DataFrame, group: Sequence[str], reward: str, eps: float = 1e-6) -> DataFrame:
    """Spread among the passing members of each group, summarised by how many passed (two or more)."""
    ok = F.col(reward) > eps
    per = rows.groupBy(*group).agg(F.count_if(ok).alias("k"), F.stddev_samp(F.when(ok, F.col(reward))).alias("spread")).filter("k >= 2")
    zero = per.groupBy("k").agg(F.avg((F.col("spread") < 1e-4).cast("double")).alias("zero_share"))
    return join_on(quantiles(per, ["k"], "spread", {"p25": 0.25, "median": 0.5, "p75": 0.75}), zero, ["k"], "inner")


def majority_baseline(rows: DataFrame, label: str, predictions: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy of always guessing the larger binary class, and of each prediction column."""
    share = F.avg((F.col(label) > 0.5).cast("double"))
    g = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.greatest(share, 1 - share).alias("majority"),
        *[F.avg((F.col(label) == F.col(p)).cast("double")).alias(f"acc_{p}") for p in predictions],
    )
    return g.withColumns({f"gap_{p}": F.col(f"acc_{p}") - F.col("majority") for p in predictions})


def variance_explained(rows: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """One minus residual over total sum of squares around the mean."""
    sse = F.sum((F.col(predicted) - F.col(actual)) ** 2)
    total = F.var_pop(actual) * F.count(actual)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.when(total > 0, 1 - sse / total).alias("fve"))


def uniform(*key: Column, seed: int = 0) -> Column:
    """Reproducible number in [0, 1) from the text of the key."""
    return hash_order(*key, seed=seed) / float(1 << 52)


def poisson_weight(u: Column) -> Column:
    """Poisson(1) count for a uniform number of 52 bits, to the precision of that number."""
    weight, total, term, n = F.lit(0), 0.0, math.exp(-1), 1
    while total + term < 1 - 2**-53 and term > 2**-54:
        total += term
        weight = weight + (u >= total).cast("int")
        term /= n
        n += 1
    return weight


def cluster_bootstrap(rows: DataFrame, cluster: str, model: str, baseline: str, replicates: int, seed: int = 0) -> DataFrame:
    """Paired, cluster-resampled interval of mean(model) - mean(baseline).

    Rows are summed per cluster first, so resampling touches clusters × replicates only.
    """
    per = rows.groupBy(cluster).agg(F.sum(F.col(model) - F.col(baseline)).alias("d"), F.count(F.lit(1)).alias("n"))
    drawn = per.select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("b"))
    drawn = drawn.withColumn("w", poisson_weight(uniform(F.col(cluster), F.col("b"), seed=seed)))
    means = drawn.groupBy("b").agg((F.sum(F.col("w") * F.col("d")) / F.sum(F.col("w") * F.col("n"))).alias("diff"))
    return quantiles(means, [], "diff", {"low": 0.025, "median": 0.5, "high": 0.975})


def crps(samples: Column, actual: Column) -> Column:
    """Continuous ranked probability score of an ensemble."""
    m = F.size(samples)
    ordered = F.array_sort(samples)
    miss = F.aggregate(samples, F.lit(0.0), lambda a, x: a + F.abs(x - actual)) / m
    weighted = F.transform(ordered, lambda x, i: x * (2 * (i + 1) - m - 1))
    return miss - F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x) / (m * m)


def brier(probability: Column, outcome: Column) -> Column:
    return (probability - outcome) ** 2


def intraclass_correlation(rows: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """One-way intraclass correlation of a reward over its groups (mean group size for unequal groups)."""
    per = rows.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    s = per.agg(
        F.count(F.lit(1)).alias("g"), F.sum("n").alias("N"), F.sum(F.col("n") * F.col("v")).alias("ssw"),
        F.sum(F.col("n") * F.col("m")).alias("sm"), F.sum(F.col("n") * F.col("m") ** 2).alias("smm"),
    )
    ssb = F.col("smm") - F.col("sm") ** 2 / F.col("N")
    msb, msw, k = ssb / (F.col("g") - 1), F.col("ssw") / (F.col("N") - F.col("g")), F.col("N") / F.col("g")
    return s.select(F.col("g").alias("groups"), F.col("N").alias("n"), ((msb - msw) / (msb + (k - 1) * msw)).alias("icc"))


def reversals(rows: DataFrame, keys: Sequence[str], order: str, value: str, tie: Sequence[str] = ()) -> DataFrame:
    """Marks rows where the direction of change flips."""

    def flip(w):
        here = F.col(value) - F.lag(value, 1).over(w)
        return {"reversal": F.coalesce(here * (F.lag(value, 1).over(w) - F.lag(value, 2).over(w)) < 0, F.lit(False))}

    return framed(rows, keys, order, flip, before=2, after=0, tie=tie)


def downsampling_loss(rows: DataFrame, keys: Sequence[str], position: str, value: str, step: int) -> DataFrame:
    """Share of direction reversals visible at the full rate but not at one in ``step`` rows."""
    full = reversals(rows, keys, position, value).groupBy(*keys).agg(F.count_if("reversal").alias("full"))
    thin = reversals(rows.filter((F.col(position) - 1) % step == 0), keys, position, value).groupBy(*keys).agg(F.count_if("reversal").alias("kept"))
    both = join_on(full, thin, keys, "left").withColumn("kept", F.coalesce("kept", F.lit(0)).cast("long"))
    return both.withColumn("lost_share", F.when(F.col("full") > 0, 1 - F.least("kept", "full") / F.col("full")))
