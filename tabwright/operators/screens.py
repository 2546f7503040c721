"""Feature screens: ANOVA F, information value, correlation, Boruta, permutation importance."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.order import hash_rank
from tabwright.operators import profile as P
from tabwright.operators.audit import moments
from tabwright.operators import scoring
from tabwright.operators.models import _weights, assembled, random_forest, score_table
from tabwright.operators.recode import q
from tabwright.session import materialize


def anova_f(df: DataFrame, cols: list[str], y: str) -> DataFrame:
    """One-way ANOVA F per feature from per-class counts, means and variances."""
    long = P.stack_values(df, cols, "double", [y]).where(F.col("value").isNotNull())
    per = long.groupBy("column", y).agg(
        F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    total = per.groupBy("column").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("m")).alias("s"),
        F.sum(F.col("n") * F.col("v")).alias("within")).withColumn("grand", F.col("s") / F.col("n"))
    between = per.join(F.broadcast(total.select("column", "grand")), "column").groupBy("column").agg(
        F.sum(F.col("n") * (F.col("m") - F.col("grand")) ** 2).alias("between"))
    both = total.join(F.broadcast(between), "column")
    f = (F.col("between") / (F.col("k") - 1)) / F.when(F.col("within") > 0, F.col("within") / (F.col("n") - F.col("k")))
    return both.select("column", f.alias("f_value"))


def information_value(df: DataFrame, cols: list[str], y: str, smooth: float = 0.5) -> DataFrame:
    """Weight of evidence per level and information value per column; counts carry a small constant."""
    long = P.stack_values(df, cols, "string", [y]).where(F.col("value").isNotNull())
    cells = long.groupBy("column", "value").agg(
        F.count_if(q(y) == 1).alias("events"), F.count_if(q(y) == 0).alias("others"))
    total = cells.groupBy("column").agg(F.sum("events").alias("all_events"), F.sum("others").alias("all_others"))
    pe = (F.col("events") + smooth) / F.col("all_events")
    po = (F.col("others") + smooth) / F.col("all_others")
    woe = F.log(pe / po)
    rows = cells.join(F.broadcast(total), "column").select("column", "value", woe.alias("woe"),
                                                           ((pe - po) * woe).alias("part"))
    info = rows.groupBy("column").agg(F.sum("part").alias("information_value"))
    return rows.join(F.broadcast(info), "column").select("column", "value", "woe", "information_value")


def _monotone_blocks(counts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Neighbouring bins (n, events) pooled until the event rate only rises or only falls, as it does on the whole; (first, last) bins."""
    n = sum(c[0] for c in counts)
    events = sum(c[1] for c in counts)
    trend = n * sum(i * e for i, (_, e) in enumerate(counts)) - events * sum(i * k for i, (k, _) in enumerate(counts))
    sign = 1 if trend >= 0 else -1
    blocks: list[list[int]] = []
    for i, (k, e) in enumerate(counts):
        blocks.append([i, i, k, e])
        while len(blocks) > 1 and sign * blocks[-2][3] * blocks[-1][2] >= sign * blocks[-1][3] * blocks[-2][2]:
            _, last, k2, e2 = blocks.pop()
            blocks[-1][1:] = [last, blocks[-1][2] + k2, blocks[-1][3] + e2]
    return [(a, b) for a, b, _, _ in blocks]


def _fewer_blocks(counts: list[tuple[int, int]], blocks: list[tuple[int, int]], wanted: int, smooth: float) -> list[tuple[int, int]]:
    """Neighbours joined where it costs the least information until at most ``wanted`` blocks are left."""
    total_e, total_o = sum(e for _, e in counts), sum(n - e for n, e in counts)

    def part(a: int, b: int) -> float:
        e, o = sum(e for _, e in counts[a:b + 1]), sum(n - e for n, e in counts[a:b + 1])
        pe, po = (e + smooth) / max(total_e, 1), (o + smooth) / max(total_o, 1)
        return (pe - po) * math.log(pe / po)

    blocks = list(blocks)
    while len(blocks) > max(1, wanted):
        cost = [part(*x) + part(*y) - part(x[0], y[1]) for x, y in zip(blocks, blocks[1:])]
        i = min(range(len(cost)), key=cost.__getitem__)
        blocks[i:i + 2] = [(blocks[i][0], blocks[i + 1][1])]
    return blocks


def binned_information(df: DataFrame, cols: list[str], y: str, max_bins: int = 8, fine_bins: int = 32, smooth: float = 0.5,
                       accuracy: int = 10_000) -> DataFrame:
    """(column, bin, lower, upper, n, events, woe, information_value) of numeric columns, lower < x <= upper.

    Quantile edges come from a sketch; one pass counts the at most ``fine_bins``
    bins of every column, and only these counts reach the driver. Neighbours are
    joined until the event rate is monotone, then until ``max_bins`` are left.
    Missing values are a bin of their own, 0, without bounds; the outer bins
    have no outer bound (null). ``smooth`` is added to both counts of a bin.
    """
    shares = [F.lit(i / fine_bins) for i in range(1, fine_bins)]
    cuts = P.wide_agg(df, {c: F.percentile_approx(q(c).cast("double"), F.array(*shares), F.lit(accuracy)) for c in cols})
    edges = {c: sorted(set(cuts[c] or [])) for c in cols}

    def below(x):
        return lambda edge: edge < x

    cells = [F.struct(F.lit(i).alias("column"), F.when(q(c).isNull(), -1).otherwise(
        F.size(F.filter(F.array(*map(F.lit, edges[c])).cast("array<double>"), below(q(c).cast("double"))))).alias("fine")) for i, c in enumerate(cols)]
    event = (q(y) == 1).cast("bigint")
    counted = df.where(q(y).isin(0, 1)).select(event.alias("_y"), F.explode(F.array(*cells)).alias("s")).groupBy("s.column", "s.fine").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_y").alias("events")).collect()
    rows = []
    for i, c in enumerate(cols):
        mine = {r["fine"]: (r["n"], r["events"]) for r in counted if r["column"] == i}
        total_e, total_o = sum(e for _, e in mine.values()), sum(n - e for n, e in mine.values())
        if not total_e or not total_o:
            continue  # one class only: nothing to weigh
        order = sorted(f for f in mine if f >= 0)
        counts = [mine[f] for f in order]
        blocks = _fewer_blocks(counts, _monotone_blocks(counts), max_bins, smooth) if counts else []
        listed = [(0, None, None, *mine[-1])] if -1 in mine else []
        for b, (first, last) in enumerate(blocks, 1):
            low = edges[c][order[first] - 1] if first else None
            high = edges[c][order[last]] if last < len(order) - 1 else None
            listed.append((b, low, high, sum(n for n, _ in counts[first:last + 1]), sum(e for _, e in counts[first:last + 1])))
        parts = []
        for b, low, high, n, e in listed:
            pe, po = (e + smooth) / total_e, (n - e + smooth) / total_o
            parts.append((c, b, low, high, n, e, math.log(pe / po), (pe - po) * math.log(pe / po)))
        information = sum(p[-1] for p in parts)
        rows += [(*p[:-1], information) for p in parts]
    return df.sparkSession.createDataFrame(
        rows, "column string, bin int, lower double, upper double, n bigint, events bigint, woe double, information_value double")


def correlation_screen(df: DataFrame, cols: list[str], threshold: float = 0.9) -> DataFrame:
    """Pearson correlation of every column pair and whether it exceeds the threshold.

    All pairs come from one matrix over the rows with a number in every column;
    a pair with a constant column has no correlation (null).
    """
    _, _, cov = moments(df, cols)
    scale = [float(cov[i, i]) ** 0.5 for i in range(len(cols))]
    rows = [(a, b, float(cov[i, j]) / (scale[i] * scale[j]) if scale[i] and scale[j] else None)
            for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j]
    out = df.sparkSession.createDataFrame(rows, "column_a string, column_b string, correlation double")
    return out.withColumn("flagged", F.coalesce(F.abs("correlation") > F.lit(threshold), F.lit(False)))


def home_slots(df: DataFrame, key: str, seed: int) -> DataFrame:
    """(key, _slot): the place of each row in the hash order that shuffled columns are dealt to, written once."""
    return materialize(hash_rank(df.select(key), seed, "home", key, out="_slot"))


def shuffled_columns(df: DataFrame, cols: list[str], key: str, seed: int, prefix: str = "", home: DataFrame | None = None) -> DataFrame:
    """``df`` with each named column permuted on its own: rank join of two hash orders (``home`` is that of ``home_slots``)."""
    if home is None:
        home = home_slots(df, key, seed)
    out = df.drop(*cols) if not prefix else df
    for c in cols:  # all meet by their slots, dealt out once
        moved = hash_rank(df.select(key, q(c)), seed, f"move/{c}", key, out="_slot").select(
            "_slot", q(c).alias(f"{prefix}{c}"))
        home = home.join(moved, "_slot")
    return out.join(home.drop("_slot"), key)


def _at_least(hits: int, rounds: int) -> float:
    """Chance of ``hits`` or more heads in ``rounds`` fair throws."""
    return sum(math.comb(rounds, i) for i in range(hits, rounds + 1)) / 2 ** rounds


def boruta_rounds(df: DataFrame, cols: list[str], y: str, key: str, rounds: int = 12, trees: int = 30,
                  depth: int = 5, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """(round, feature, hits, played, state): a feature hits when it beats the best shuffled shadow of a forest.

    After each round the hits are tested against a fair coin, both ways, with
    ``alpha`` divided by the number of features. ``confirmed`` features stay in
    the forest, ``rejected`` ones leave it with their shadows, the others stay
    ``tentative``. Rounds end early once none is tentative.
    """
    hits, played, state = dict.fromkeys(cols, 0), dict.fromkeys(cols, 0), dict.fromkeys(cols, "tentative")
    df = materialize(df.select(key, y, *map(q, cols)))
    rows = []
    for r in range(rounds):
        live = [c for c in cols if state[c] != "rejected"]
        wide = shuffled_columns(df.select(key, y, *map(q, live)), live, key, seed + r, "shadow_")
        names = live + [f"shadow_{c}" for c in live]
        values = _weights(random_forest(trees, depth, seed=seed + r).fit(assembled(materialize(wide), names, y)))
        bar = max(values[len(live):])
        for i, c in enumerate(live):
            if state[c] == "tentative":
                played[c] += 1
                hits[c] += int(values[i] > bar)
                if _at_least(hits[c], played[c]) * len(cols) < alpha:
                    state[c] = "confirmed"
                elif _at_least(played[c] - hits[c], played[c]) * len(cols) < alpha:
                    state[c] = "rejected"
        rows += [(r + 1, c, hits[c], played[c], state[c]) for c in cols]
        if "tentative" not in state.values():
            break
    return df.sparkSession.createDataFrame(rows, "round int, feature string, hits int, played int, state string")


def boruta(df: DataFrame, cols: list[str], y: str, key: str, rounds: int = 12, trees: int = 30,
           depth: int = 5, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """(feature, hits, rounds, state, confirmed): where ``boruta_rounds`` ends."""
    history = boruta_rounds(df, cols, y, key, rounds, trees, depth, seed, alpha)
    last = history.groupBy("feature").agg(F.max_by(F.struct("hits", "played", "state"), "round").alias("s"))
    return last.select("feature", "s.hits", F.col("s.played").alias("rounds"), "s.state", (F.col("s.state") == "confirmed").alias("confirmed"))


def permutation_importance(model, df: DataFrame, cols: list[str], y: str, key: str, seed: int = 42) -> DataFrame:
    """Drop in ROC AUC when one column is shuffled, for every column."""
    df = materialize(df.select(key, y, *map(q, cols)))
    base = scoring.roc_auc(score_table(model, assembled(df, cols, y))).first()["auc"]
    rows, home = [], home_slots(df, key, seed)
    for c in cols:
        moved = shuffled_columns(df.select(key, y, *map(q, cols)), [c], key, seed, home=home)
        auc = scoring.roc_auc(score_table(model, assembled(moved, cols, y))).first()["auc"]
        rows.append((c, base - auc))
    return df.sparkSession.createDataFrame(rows, "feature string, auc_drop double")


