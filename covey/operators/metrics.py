"""How well predicted communities match known ones.

``pairs`` is the table ``kid, pid, c, nk, np`` of :func:`covey.operators.overlap.overlaps`;
``known(kid, n)`` and ``predicted(pid, n)`` are sizes, so communities without any
overlap count too.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sets
from .auction import auction, settle
from .components import components
from .overlap import overlaps, sizes
from .ranges import running_sums
from ..sources.scratch import forget, stored


def _number(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias(name))


def matched_precision_recall(pairs: DataFrame, known: DataFrame, predicted: DataFrame, share: float = 0.5) -> DataFrame:
    """One row: the parts of predicted and known communities with a match, and their harmonic mean."""
    hits = pairs.filter(sets.contained(F.col("c"), F.col("nk"), F.col("np"), share)).agg(F.countDistinct("kid").alias("hit_k"), F.countDistinct("pid").alias("hit_p"))
    row = hits.crossJoin(_number(known, "n_k")).crossJoin(_number(predicted, "n_p"))  # of one row each
    row = row.select(sets.ratio(F.col("hit_p"), F.col("n_p")).alias("precision"), sets.ratio(F.col("hit_k"), F.col("n_k")).alias("recall"))
    return row.withColumn("f1", sets.harmonic_mean(F.col("precision"), F.col("recall")))


def _best(pairs: DataFrame, of: DataFrame, key: str, value) -> DataFrame:
    """The largest value of each community of one side, 0 without a pair."""
    top = pairs.select(key, value.alias("v")).groupBy(key).agg(F.max("v").alias("v"))
    return of.join(top, key, "left").select(key, "n", F.coalesce("v", F.lit(0.0)).alias("v"))


def unbiased_accuracy(pairs: DataFrame, known: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: mean best shares of predicted and known communities, and their geometric mean."""
    ppv = _best(pairs, predicted, "pid", F.col("c") / F.col("np")).agg(F.avg("v").alias("ppv"))
    sn = _best(pairs, known, "kid", F.col("c") / F.col("nk")).agg(F.avg("v").alias("sn"))
    return ppv.crossJoin(sn).withColumn("acc", sets.geometric_mean(F.col("ppv"), F.col("sn")))


def best_match_f1(pairs: DataFrame, known: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: mean best F1 in both directions, and their harmonic mean."""
    f1 = sets.f1(F.col("c"), F.col("nk"), F.col("np"))
    k = _best(pairs, known, "kid", f1).agg(F.avg("v").alias("known_f1"))
    p = _best(pairs, predicted, "pid", f1).agg(F.avg("v").alias("predicted_f1"))
    return k.crossJoin(p).withColumn("net_f1", sets.harmonic_mean(F.col("known_f1"), F.col("predicted_f1")))


def f1_summary(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """One row: perfect matches, communities without a match, and the mean best F1."""
    best = _best(pairs, known, "kid", sets.f1(F.col("c"), F.col("nk"), F.col("np")))
    return best.agg(F.sum((F.col("v") == 1).cast("long")).alias("perfect"), F.sum((F.col("v") == 0).cast("long")).alias("unmatched"), F.avg("v").alias("mean_f1"))


def maximum_matching_ratio(pairs: DataFrame, known: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: mean best affinity of known and predicted communities, and their harmonic mean."""
    na = sets.affinity(F.col("c"), F.col("nk"), F.col("np"))
    k = _best(pairs, known, "kid", na).agg(F.avg("v").alias("mmr"))
    p = _best(pairs, predicted, "pid", na).agg(F.avg("v").alias("pwmmr"))
    return k.crossJoin(p).withColumn("hmean", sets.harmonic_mean(F.col("mmr"), F.col("pwmmr")))


def size_weighted(pairs: DataFrame, known: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: best affinities weighted by size, and their harmonic mean."""
    na = sets.affinity(F.col("c"), F.col("nk"), F.col("np"))
    mean = F.sum(F.col("v") * F.col("n")) / F.sum("n")
    p = _best(pairs, predicted, "pid", na).agg(mean.alias("precision"))
    k = _best(pairs, known, "kid", na).agg(mean.alias("recall"))
    return p.crossJoin(k).withColumn("hmean", sets.harmonic_mean(F.col("precision"), F.col("recall")))


def clustering_accuracy(pairs: DataFrame, known: DataFrame, predicted: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """One row: sensitivity, positive predictive value and accuracy of a clustering.

    ``totals(pid, total)`` has the summed overlaps of a prediction where ``pairs`` are only those that can be best.
    """
    sn = _best(pairs, known, "kid", F.col("c").cast("double")).agg((F.sum("v") / F.sum("n")).alias("sensitivity"))
    columns = pairs.groupBy("pid").agg(F.max("c").alias("top"), F.sum("c").alias("total"))
    if totals is not None:
        columns = columns.select("pid", "top").join(totals, "pid")
    ppv = columns.agg(sets.ratio(F.sum("top"), F.sum("total")).alias("ppv"))
    return sn.crossJoin(ppv).withColumn("acc", sets.geometric_mean(F.col("sensitivity"), F.col("ppv")))


def assignment(weights: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows and columns of a matching of maximal weight."""
    row, column = np.nonzero(weights)
    return sparse_assignment(row, column, weights[row, column], weights.shape)


def sparse_assignment(row: np.ndarray, column: np.ndarray, weight: np.ndarray, shape: tuple[int, int]) -> list[tuple[int, int]]:
    """Pairs of rows and columns of a matching of maximal weight, by shortest augmenting paths; what isn't listed weighs 0.

    Only the listed cells are held, and one row of costs at a time.
    """
    flipped = shape[0] > shape[1]
    if flipped:
        row, column, shape = column, row, shape[::-1]
    n, m = shape
    order = np.argsort(row, kind="stable")
    column, cost = column[order], -weight[order]
    first = np.searchsorted(row[order], np.arange(n + 1))
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    row_of = np.zeros(m + 1, np.int64)
    for i in range(1, n + 1):
        row_of[0] = i
        at, least, before, used = 0, np.full(m + 1, np.inf), np.zeros(m + 1, np.int64), np.zeros(m + 1, bool)
        while True:
            used[at] = True
            r = row_of[at]
            free = ~used[1:]
            slack = -u[r] - v[1:]
            own = slice(first[r - 1], first[r])
            slack[column[own]] += cost[own]
            better = free & (slack < least[1:])
            least[1:][better] = slack[better]
            before[1:][better] = at
            to = int(np.where(free, least[1:], np.inf).argmin()) + 1
            step = least[to]
            u[row_of[used]] += step
            v[used] -= step
            least[1:][free] -= step
            at = to
            if row_of[at] == 0:
                break
        while at:
            row_of[at] = row_of[before[at]]
            at = before[at]
    found = [(int(row_of[j]) - 1, j - 1) for j in range(1, m + 1) if row_of[j]]
    return [(b, a) for a, b in found] if flipped else found


def match_communities(pairs: DataFrame, task_pairs: int = 2_000_000, epsilon: float = 1e-4) -> DataFrame:
    """``kid, pid, w``: a matching of maximal total affinity, one overlap component at a time.

    Pairs without overlap add nothing, so components don't interact.  A component
    of up to ``task_pairs`` pairs is one task, which holds them.  Of larger ones the
    pairs that a best matching certainly holds are settled in rounds of joins; what is
    left falls apart into components again, and only those that are still as large are
    matched by an auction, whose total is at most ``epsilon / 2`` a community below the best.
    """
    weighted = pairs.withColumn("w", sets.affinity(F.col("c"), F.col("nk"), F.col("np"))).select("kid", "pid", "w")
    return _matched(_parts(weighted), task_pairs, epsilon)


def _above(parts: DataFrame, task_pairs: int) -> DataFrame:
    """``component`` of those with more than ``task_pairs`` pairs, stored."""
    return stored(parts.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > task_pairs).select("component"))


def _matched(parts: DataFrame, task_pairs: int, epsilon: float) -> DataFrame:
    large = _above(parts, task_pairs)
    if large.isEmpty():
        return _solved(parts)
    done = _solved(parts.join(large, "component", "left_anti"))
    sure, left = settle(parts.join(large, "component", "left_semi").select("kid", "pid", "w"))
    parts = _parts(left)
    large = _above(parts, task_pairs)
    sold = auction(parts.join(large, "component", "left_semi").select("kid", "pid", "w"), epsilon)
    return done.unionByName(sure).unionByName(_solved(parts.join(large, "component", "left_anti"))).unionByName(sold)


def _parts(weighted: DataFrame) -> DataFrame:
    """``component`` and the columns of ``weighted(kid, pid, w)``, stored.

    All predictions that a known community meets are linked to the first of them,
    which leaves the components as they are, so copies of a link combine before the search for components.
    """
    b = F.xxhash64(F.lit("p"), "pid")
    first = stored(weighted.withColumn("first", F.min(b).over(W.partitionBy("kid"))))
    named = components(first.select(b.alias("a"), F.col("first").alias("b")).distinct()).withColumnRenamed("node", "first")
    parts = stored(first.join(named, "first", "left").select(F.coalesce("component", "first").alias("component"), *weighted.columns))
    forget(first)
    return parts


def _weight(rows: pd.DataFrame) -> tuple[pd.Index, pd.Index, list[tuple[int, int]], dict]:
    """Known communities, predictions, the pairs of a matching of maximal weight, and the weights of all pairs."""
    k, kids = pd.factorize(rows["kid"], sort=True)
    p, pids = pd.factorize(rows["pid"], sort=True)
    w = rows["w"].to_numpy()
    value = dict(zip(zip(k.tolist(), p.tolist(), strict=True), w.tolist(), strict=True))
    return kids, pids, [f for f in sparse_assignment(k, p, w, (len(kids), len(pids))) if f in value], value


def _solved(parts: DataFrame) -> DataFrame:
    """``kid, pid, w``: the matching of each component, a task each."""

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        kids, pids, found, value = _weight(rows.sort_values(["kid", "pid"]))
        return pd.DataFrame({"kid": [kids[i] for i, _ in found], "pid": [pids[j] for _, j in found], "w": [value[f] for f in found]})

    kinds = {f.name: f.dataType.simpleString() for f in parts.schema}
    return parts.select("component", "kid", "pid", "w").groupBy("component").applyInPandas(solve, f"kid {kinds['kid']}, pid {kinds['pid']}, w double")


def matching_metrics(pairs: DataFrame, known: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: the matching's total affinity over predicted and known communities, F1, and the number of matches."""
    total = match_communities(pairs).agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("w"))
    row = total.crossJoin(_number(known, "n_k")).crossJoin(_number(predicted, "n_p"))
    row = row.select(sets.ratio(F.col("w"), F.col("n_p")).alias("precision"), sets.ratio(F.col("w"), F.col("n_k")).alias("recall"), F.least("n_k", "n_p").alias("n_matches"))
    return row.withColumn("f1", sets.harmonic_mean(F.col("precision"), F.col("recall")))


def _reached(scored: DataFrame, steps: int) -> tuple[DataFrame, float, float]:
    """``pid, last``: the last of ``steps`` equal steps of the score that each prediction reaches; the lowest score and the width of a step."""
    low, high = scored.agg(F.min("score"), F.max("score")).first()
    low, width = (low or 0.0), ((high or 0.0) - (low or 0.0)) / steps
    last = F.lit(steps - 1) if width == 0 else F.greatest(F.lit(0), F.least(F.lit(steps - 1), F.floor((F.col("score") - low) / width).cast("int")))
    # Guards against a quotient that rounds over or under its step.
    for _ in range(1 if width else 0):
        last = F.when((last < steps - 1) & (F.col("score") >= F.lit(low) + (last + 1) * F.lit(width)), last + 1).when((last > 0) & (F.col("score") < F.lit(low) + last * F.lit(width)), last - 1).otherwise(last)
    return scored.select("pid", last.alias("last")), low, width


def _grid(reached: DataFrame, steps: int, low: float, width: float) -> DataFrame:
    """``step, threshold, n``: how many predictions reach each step."""
    per_step = reached.groupBy(F.col("last").alias("step")).agg(F.count("*").alias("n"))
    grid = reached.sparkSession.range(steps).select(F.col("id").cast("int").alias("step")).join(per_step, "step", "left").fillna(0)
    above = W.orderBy(F.desc("step"))  # one row for each step
    return grid.select("step", (F.lit(low) + F.col("step") * F.lit(width)).alias("threshold"), F.sum("n").over(above).alias("n"))


def threshold_curve(pairs: DataFrame, known: DataFrame, scored: DataFrame, share: float = 0.5, steps: int = 10) -> DataFrame:
    """``step, threshold, n_pred, precision, recall``: matches among predictions with at least each of ``steps`` scores.

    ``scored(pid, score)``.  A prediction is aggregated at the last step it reaches
    and the steps are summed from above, so nothing is copied per step.
    """
    reached, low, width = _reached(scored, steps)
    hits = pairs.filter(sets.contained(F.col("c"), F.col("nk"), F.col("np"), share)).select("kid", "pid").join(reached, "pid")
    hit_p = hits.groupBy("pid").agg(F.first("last").alias("step")).groupBy("step").agg(F.count("*").alias("hp"))
    hit_k = hits.groupBy("kid").agg(F.max("last").alias("step")).groupBy("step").agg(F.count("*").alias("hk"))
    above = W.orderBy(F.desc("step"))  # one row for each step
    out = _grid(reached, steps, low, width).join(hit_p, "step", "left").join(hit_k, "step", "left").fillna(0, ["hp", "hk"])
    out = out.select("step", "threshold", "n", *(F.sum(c).over(above).alias(c) for c in ("hp", "hk"))).crossJoin(_number(known, "n_k"))
    return out.select("step", "threshold", F.col("n").alias("n_pred"), sets.ratio(F.col("hp"), F.col("n")).alias("precision"), sets.ratio(F.col("hk"), F.col("n_k")).alias("recall"))


def matching_curve(pairs: DataFrame, known: DataFrame, scored: DataFrame, steps: int = 10, task_pairs: int = 2_000_000, epsilon: float = 1e-4) -> DataFrame:
    """``step, threshold, n_pred, precision, recall``: the matching of maximal affinity among predictions with at least each of ``steps`` scores.

    A pair takes part in the matching of each step its prediction reaches.  The
    pairs of a later step are some of those of the first, so a task that holds a
    component of the first step matches all steps; only the pairs of components beyond
    ``task_pairs`` are copied for each step, as communities of different steps don't meet.
    """
    reached, low, width = _reached(scored, steps)
    parts = _parts(pairs.join(reached, "pid").select("kid", "pid", sets.affinity(F.col("c"), F.col("nk"), F.col("np")).alias("w"), F.col("last").cast("int").alias("last")))
    large = _above(parts, task_pairs)

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, total = rows.sort_values(["kid", "pid"]), []
        for step in range(int(rows["last"].max()) + 1):
            _, _, found, value = _weight(rows[rows["last"] >= step])
            total.append(sum(value[f] for f in found))
        return pd.DataFrame({"step": range(len(total)), "w": total})

    some = not large.isEmpty()
    small = parts.join(large, "component", "left_anti") if some else parts
    total = small.select("component", "kid", "pid", "w", "last").groupBy("component").applyInPandas(solve, "step int, w double")
    if some:
        tag = lambda c: F.concat_ws("|", "step", F.col(c).cast("string")).alias(c)
        each = parts.join(large, "component", "left_semi").withColumn("step", F.explode(F.sequence(F.lit(0), "last")))
        matched = _matched(_parts(each.select(tag("kid"), tag("pid"), "w")), task_pairs, epsilon)
        total = total.unionByName(matched.select(F.substring_index("kid", "|", 1).cast("int").alias("step"), "w"))
    total = total.groupBy("step").agg(F.sum("w").alias("w"))
    out = _grid(reached, steps, low, width).join(total, "step", "left").fillna(0, ["w"]).crossJoin(_number(known, "n_k"))
    return out.select("step", "threshold", F.col("n").alias("n_pred"), sets.ratio(F.col("w"), F.col("n")).alias("precision"), sets.ratio(F.col("w"), F.col("n_k")).alias("recall"))


def first_predictions(predicted: DataFrame, scores: DataFrame, n: int) -> DataFrame:
    """Members of the ``n`` best of ``scores(pid, score)``, by ``pid`` on ties."""
    return predicted.join(scores.orderBy(F.desc("score"), "pid").limit(n).select("pid"), "pid", "left_semi")


def cliques(membership: DataFrame, key: str, k: int) -> DataFrame:
    """``key, n1 … nk``: all subsets of ``k`` members of each community, in the order of nodes, by ``k - 1`` joins on the community."""
    own = membership.select(key, "node").distinct()
    out = own.select(key, F.col("node").alias("n1"))
    for i in range(2, k + 1):
        out = out.join(own.select(key, F.col("node").alias(f"n{i}")), key).filter(F.col(f"n{i}") > F.col(f"n{i - 1}"))
    return out


def clique_precision_recall(known: DataFrame, predicted: DataFrame, k: int, pseudocount: float = 1e-5, excluded: DataFrame | None = None, restricted: bool = True) -> DataFrame:
    """One row: precision and recall of the distinct ``k``-subsets, exact.

    A predicted subset is right if a known community holds it; one inside a
    community of ``excluded(kid, node)`` isn't counted as wrong.  Of predictions only
    members in some known community count, all of them if not ``restricted``.
    """
    if restricted:
        predicted = known_only(predicted.select("pid", "node").distinct(), known, k)
    nodes = [f"n{i}" for i in range(1, k + 1)]
    held = lambda rows, key, name: cliques(rows, key, k).select(*nodes, F.lit(1).alias(name))
    sides = held(predicted, "pid", "p").unionByName(held(known, "kid", "g"), allowMissingColumns=True)
    if excluded is not None:
        sides = sides.unionByName(held(excluded, "kid", "x"), allowMissingColumns=True)
    else:
        sides = sides.withColumn("x", F.lit(None).cast("int"))
    # Each subset is counted once, with the sides that hold it; copies combine before the shuffle.
    seen = sides.groupBy(*nodes).agg(*(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("p", "g", "x")))
    number = lambda hit, name: F.coalesce(F.sum(hit.cast("long")), F.lit(0)).alias(name)
    p, g, x = (F.col(c) == 1 for c in ("p", "g", "x"))
    row = seen.agg(number(p & g, "tp"), number(p & ~g & ~x, "fp"), number(g & ~p, "fn"))
    e = F.lit(pseudocount)
    return row.select("tp", "fp", "fn", ((F.col("tp") + e) / (F.col("tp") + F.col("fp") + e)).alias("precision"), ((F.col("tp") + e) / (F.col("tp") + F.col("fn") + e)).alias("recall"))


def weighted_clique_precision_recall(known: DataFrame, predicted: DataFrame, k: int, pseudocount: float = 1e-5) -> DataFrame:
    """One row: precision and recall of ``k``-subsets, where those of a community of ``n`` weigh ``n`` in all.

    Of predictions only members in some known community count.  A subset counts
    once in each community that holds it: right ones are in a community of the
    other side.
    """
    nodes = [f"n{i}" for i in range(1, k + 1)]
    known, predicted = known.select("kid", "node").distinct(), known_only(predicted.select("pid", "node").distinct(), known, k)

    def held(rows: DataFrame, key: str, name: str) -> DataFrame:
        weight = sizes(rows, key, "n").filter(F.col("n") >= k).select(key, (F.col("n") / sets.combinations(F.col("n"), k)).alias(name))
        return cliques(rows, key, k).join(weight, key).select(*nodes, name)

    sides = held(predicted, "pid", "p").unionByName(held(known, "kid", "g"), allowMissingColumns=True)
    seen = sides.groupBy(*nodes).agg(F.sum("p").alias("p"), F.sum("g").alias("g"))
    part = lambda of, other, right: F.coalesce(F.sum(F.when(F.col(other).isNotNull() == right, F.col(of))), F.lit(0.0)) + pseudocount
    row = seen.agg(part("p", "g", True).alias("tp"), part("p", "g", False).alias("fp"), part("g", "p", True).alias("known_tp"), part("g", "p", False).alias("fn"))
    return row.select("tp", "fp", "known_tp", "fn", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("known_tp") / (F.col("known_tp") + F.col("fn"))).alias("recall"))


def clique_summary(curve: DataFrame) -> DataFrame:
    """One row: mean precision and recall over sizes, plain and weighted by communities, and the mean and harmonic mean of the F1 of all sizes (0 if one is 0)."""
    f1 = sets.harmonic_mean(F.col("precision"), F.col("recall"))
    w = F.col("n_communities")
    row = curve.withColumn("f1", f1).agg(
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("grand_mean"),
        (F.sum(F.col("precision") * w) / F.sum(w)).alias("weighted_precision"), (F.sum(F.col("recall") * w) / F.sum(w)).alias("weighted_recall"),
        F.min("f1").alias("least"), F.count("*").alias("k"), F.sum(F.when(F.col("f1") > 0, 1 / F.col("f1"))).alias("inverse"),
    )
    return row.withColumn("grand_f1", F.when(F.col("least") > 0, F.col("k") / F.col("inverse")).otherwise(F.lit(0.0))).drop("least", "k", "inverse")


def _ranked(scored: DataFrame) -> DataFrame:
    """``score, pos, tp, n, total_p, total`` of each distinct score, highest first.

    Rows are counted by score once, and the counts are stored, as the running sums
    over ranges of scores and the totals both read them.
    """
    by_score = stored(scored.groupBy("score").agg(F.sum("label").cast("long").alias("pos"), F.count("*").alias("all")))
    out = running_sums(by_score, [F.desc("score")], {"tp": F.col("pos"), "n": F.col("all")}).select("score", "pos", "tp", "n")
    return out.crossJoin(F.broadcast(by_score.agg(F.sum("pos").alias("total_p"), F.sum("all").alias("total"))))  # of one row


def ranked_curve(scored: DataFrame) -> DataFrame:
    """``score, tp, n, precision, recall, fpr`` at each distinct score, highest first; ``scored(score, label)`` with label 0 or 1."""
    return _ranked(scored).select(
        "score", "tp", "n", (F.col("tp") / F.col("n")).alias("precision"), sets.ratio(F.col("tp"), F.col("total_p")).alias("recall"), sets.ratio(F.col("n") - F.col("tp"), F.col("total") - F.col("total_p")).alias("fpr")
    )


def average_precision(scored: DataFrame) -> DataFrame:
    """One row: the sum over scores of the gain in recall times the precision, without interpolation."""
    curve = _ranked(scored)
    return curve.agg(F.coalesce(sets.ratio(F.sum(F.col("pos") * F.col("tp") / F.col("n")), F.sum("pos")), F.lit(0.0)).alias("average_precision"))


def confusion(results: DataFrame) -> DataFrame:
    """One row: accuracy of both classes, precision, recall and F1 of ``results(label, pred)``; null for an empty class."""
    hit = lambda label, pred: F.sum(((F.col("label") == label) & (F.col("pred") == pred)).cast("long"))
    row = results.agg(hit(1, 1).alias("tp"), hit(1, 0).alias("fn"), hit(0, 1).alias("fp"), hit(0, 0).alias("tn"))
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    over = lambda a, b: F.when(b > 0, a / b)
    row = row.select("tp", "fn", "fp", "tn", over(tp, tp + fn).alias("acc_pos"), over(tn, tn + fp).alias("acc_neg"), over(tp, tp + fp).alias("precision"), over(tp, tp + fn).alias("recall"))
    return row.withColumn("f1", sets.harmonic_mean(F.coalesce("precision", F.lit(0.0)), F.coalesce("recall", F.lit(0.0))))


def sizewise_accuracy(results: DataFrame, label: int) -> DataFrame:
    """``size, accuracy, total`` of ``results(size, pred)`` that should all be ``label``."""
    return results.groupBy(F.col("size").cast("int").alias("size")).agg(F.avg((F.col("pred") == label).cast("double")).alias("accuracy"), F.count("*").alias("total"))


def sizewise_scores(predictions: DataFrame) -> DataFrame:
    """``size, mean_score, total`` of ``predictions(size, score)``."""
    return predictions.groupBy("size").agg(F.avg("score").alias("mean_score"), F.count("*").alias("total"))


def edge_labels(scores: DataFrame, known_edges: DataFrame) -> DataFrame:
    """``score, label`` of ``scores(src, dst, score)``: 1 if the edge is known."""
    marked = scores.join(known_edges.select("src", "dst").withColumn("label", F.lit(1)), ["src", "dst"], "left")
    return marked.select("score", F.coalesce("label", F.lit(0)).alias("label"))


def edge_max_scores(induced: DataFrame, scores: DataFrame) -> DataFrame:
    """``src, dst, score``: the largest score of the communities with each edge."""
    return induced.join(scores, "cid").groupBy("src", "dst").agg(F.max("score").alias("score"))


def running_fdr(scored: DataFrame) -> DataFrame:
    """``id, score, fdr``: one less the part of positives among all rows up to each one, best first, by id on ties."""
    out = running_sums(scored, [F.desc("score"), F.col("id")], {"p": F.col("label"), "a": F.lit(1)})
    return out.select("id", "score", (1 - F.col("p") / F.col("a")).alias("fdr"))


def evaluate(known: DataFrame, predicted: DataFrame, share: float = 0.5, without: tuple[str, ...] = ()) -> DataFrame:
    """``metric, value`` of all overlap metrics of ``known(kid, node)`` and ``predicted(pid, node)`` but the blocks ``without``."""
    pairs = stored(overlaps(known, predicted))
    k, p = sizes(known, "kid", "n"), sizes(predicted, "pid", "n")
    blocks = {
        "matched": lambda: matched_precision_recall(pairs, k, p, share),
        "unbiased": lambda: unbiased_accuracy(pairs, k, p),
        "best_f1": lambda: best_match_f1(pairs, k, p),
        "matching": lambda: matching_metrics(pairs, k, p),
        "affinity": lambda: maximum_matching_ratio(pairs, k, p),
        "size_weighted": lambda: size_weighted(pairs, k, p),
        "clustering": lambda: clustering_accuracy(pairs, k, p),
    }
    blocks = {name: block() for name, block in blocks.items() if name not in without}
    tall = [df.select(F.explode(F.map_from_arrays(F.array(*(F.lit(f"{name}.{c}") for c in df.columns)), F.array(*(F.col(c).cast("double") for c in df.columns)))).alias("metric", "value")) for name, df in blocks.items()]
    out = tall[0]
    for df in tall[1:]:
        out = out.unionByName(df)
    return out


def known_only(predicted: DataFrame, nodes: DataFrame, least: int = 3) -> DataFrame:
    """Members of ``predicted(pid, node)`` in ``nodes(node)``, of predictions that keep ``least`` of them."""
    kept = predicted.join(nodes.select("node").distinct(), "node", "left_semi").select("pid", "node")
    return kept.join(kept.groupBy("pid").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("pid"), "pid", "left_semi").select("pid", "node")
