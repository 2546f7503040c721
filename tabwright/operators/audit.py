"""Fidelity, utility and privacy audits of a synthetic table against a real one."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.order import hash_rank, running_sums
from tabwright.functions.rand import hash_laplace
from tabwright.operators import profile as P
from tabwright.operators.knn import knn_by_part
from tabwright.operators.recode import q
from tabwright.session import stored

TIE = 1e-9  # distances this close count as equal

# ---------------------------------------------------------------- nearest-neighbour audits


def nn_table(rows: DataFrame, **tuning) -> DataFrame:
    """Nearest distance of every row of ``rows(dataset, id, vec)`` in every dataset: (t, s, row_id, dist).

    Ids are unique over all datasets; a row is never its own neighbour, while
    a copy of it is one at distance 0.
    """
    base = rows.select(F.col("dataset").alias("part"), "id", "vec")
    near = knn_by_part(rows.select("id", "vec"), base, 1, exclude_self=True, **tuning)
    tags = rows.select(F.col("id").alias("t_id"), F.col("dataset").alias("t"))
    return near.join(tags, "t_id").select("t", F.col("part").alias("s"), F.col("t_id").alias("row_id"), "dist")


def _pairs(nn: DataFrame) -> DataFrame:
    """(t, s, row_id, d_ts, d_tt) for every foreign dataset s: one grouping per row instead of a self-join."""
    per = nn.groupBy("t", "row_id").agg(
        F.collect_list(F.struct("s", "dist")).alias("all"),
        F.max(F.when(F.col("s") == F.col("t"), F.col("dist"))).alias("d_tt"))
    return per.select("t", "row_id", "d_tt", F.explode("all").alias("x")).where(
        F.col("x.s") != F.col("t")).select("t", F.col("x.s").alias("s"), "row_id", F.col("x.dist").alias("d_ts"), "d_tt")


def _symmetric(one_way: DataFrame, value: str) -> DataFrame:
    """Mean of both directions per unordered pair, listed as a < b."""
    a, b = F.least("t", "s"), F.greatest("t", "s")
    return one_way.groupBy(a.alias("a"), b.alias("b")).agg((F.sum(value) * 0.5).alias(value))


def adversarial_accuracy(nn: DataFrame) -> DataFrame:
    """Half the sum of both shares of rows nearer to their own dataset than to the other: (a, b, accuracy)."""
    one = _pairs(nn).groupBy("t", "s").agg(
        F.avg((F.col("d_ts") > F.col("d_tt")).cast("double")).alias("accuracy"))
    return _symmetric(one, "accuracy")


def nn_discrepancy(nn: DataFrame) -> DataFrame:
    """Mean nearest distance in both directions: (a, b, discrepancy)."""
    one = nn.where(F.col("t") != F.col("s")).groupBy("t", "s").agg(F.avg("dist").alias("discrepancy"))
    return _symmetric(one, "discrepancy")


def nn_divergence(nn: DataFrame) -> DataFrame:
    """Mean log ratio of foreign to own distance in both directions over its finite terms, and how many were not."""
    ok = (F.col("d_ts") > 0) & (F.col("d_tt") > 0)
    term = F.when(ok, F.log(F.col("d_ts") / F.when(ok, F.col("d_tt"))))
    one = _pairs(nn).groupBy("t", "s").agg(
        F.avg(term).alias("divergence"), F.count_if(~ok).alias("n_not_finite"))
    a, b = F.least("t", "s"), F.greatest("t", "s")
    return one.groupBy(a.alias("a"), b.alias("b")).agg(
        (F.sum("divergence") * 0.5).alias("divergence"), F.sum("n_not_finite").alias("n_not_finite"))


def audit_summary(pairs: DataFrame, value: str, synthetic_prefix: str = "synth_") -> DataFrame:
    """Averages over replicas: rr (train-test), ra (train-synthetic), rat (test-synthetic), aa (between synthetics)."""
    fake = lambda c: F.col(c).startswith(synthetic_prefix)
    kind = (F.when(fake("a") & fake("b"), "aa").when(~fake("a") & ~fake("b"), "rr")
            .when((F.col("a") == "tr") | (F.col("b") == "tr"), "ra").otherwise("rat"))
    return pairs.groupBy(kind.alias("comparison")).agg(F.avg(value).alias(value))


def identifiability(real: DataFrame, synthetic: DataFrame, cols: list[str], key: str, **tuning) -> DataFrame:
    """Share of real rows nearer to a synthetic row than to any other real row, columns scaled by 1 / entropy.

    Columns of zero entropy carry no information and are left out.
    """
    weights = {r["column"]: r["entropy"] for r in P.rounded_entropy(real, cols).collect()}
    use = [c for c in cols if weights.get(c, 0.0) > 1e-12]
    vec = F.array(*[q(c).cast("double") / F.lit(weights[c]) for c in use]).alias("vec")
    # one search over both tables: real rows keep positive ids, synthetic ones turn negative
    r = real.select(F.lit("real").alias("part"), q(key).cast("bigint").alias("id"), vec)
    s = synthetic.select(F.lit("synthetic").alias("part"), (-q(key).cast("bigint") - 1).alias("id"), vec)
    near = knn_by_part(r.select("id", "vec"), r.unionByName(s), 1, exclude_self=True, **tuning)
    per = near.groupBy("t_id").agg(
        F.max(F.when(F.col("part") == "real", F.col("dist"))).alias("own"),
        F.max(F.when(F.col("part") == "synthetic", F.col("dist"))).alias("fake"))
    nearer = F.col("fake") < F.col("own") - F.lit(TIE)
    return per.agg(F.avg(nearer.cast("double")).alias("identifiability"),
                   F.count(F.lit(1)).alias("n_rows"))


# ---------------------------------------------------------------- distribution distance


def wasserstein_1(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    """Exact first Wasserstein distance per column: the area between both distribution functions.

    Values are grouped first; the integral over value gaps is summed by parts,
    so only running sums in value order are needed.
    """
    tagged = P.stack_values(a, cols, "double").withColumn("_a", F.lit(1)).unionByName(
        P.stack_values(b, cols, "double").withColumn("_a", F.lit(0))).where(F.col("value").isNotNull())
    counts = tagged.groupBy("column", "value").agg(
        F.sum("_a").cast("bigint").alias("n_a"), F.sum(1 - F.col("_a")).cast("bigint").alias("n_b"))
    run = running_sums(counts, ["value"], {"run_a": "n_a", "run_b": "n_b"}, by=["column"])
    size = counts.groupBy("column").agg(F.sum("n_a").alias("t_a"), F.sum("n_b").alias("t_b"))
    both = run.join(F.broadcast(size), "column")
    t_a, t_b = (F.when(F.col(c) > 0, F.col(c)) for c in ("t_a", "t_b"))  # without values in one table there is no distance: null
    after = F.abs(F.col("run_a") / t_a - F.col("run_b") / t_b)
    before = F.abs((F.col("run_a") - F.col("n_a")) / t_a - (F.col("run_b") - F.col("n_b")) / t_b)
    # sum of gap * height = sum of value * (height before - height after)
    return both.groupBy("column").agg(F.sum(F.col("value") * (before - after)).alias("wasserstein"))


# ---------------------------------------------------------------- linear utility


def moments(df: DataFrame, cols: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, means and population covariance of the rows that have a number in every column.

    Two passes in Arrow batches, which leave out the other rows: sums, then
    centred outer products; each task sends one p x p block, and Spark adds the
    blocks cell by cell.
    """
    p = len(cols)
    x = df.select(*[q(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])

    def whole(batches):
        for pdf in batches:
            z = pdf.to_numpy(dtype="float64")
            yield z[~np.isnan(z).any(axis=1)]

    def sums(batches):
        n, total = 0, np.zeros(p)
        for z in whole(batches):
            n, total = n + len(z), total + z.sum(axis=0)
        yield pd.DataFrame({"i": range(p), "n": n, "v": total})

    got = x.mapInPandas(sums, "i int, n bigint, v double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    n = got[0]["n"] if got else 0
    if not n:
        return 0, np.zeros(p), np.zeros((p, p))
    mu = np.zeros(p)
    for r in got:
        mu[r["i"]] = r["v"] / n

    def block(batches):
        total = np.zeros((p, p))
        for z in whole(batches):
            total += (z - mu).T @ (z - mu)
        yield pd.DataFrame({"i": range(p), "s": total.tolist()})

    parts = x.mapInPandas(block, "i int, s array<double>")
    cells = parts.select("i", F.posexplode("s").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    cov = np.zeros((p, p))
    for r in cells.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v")))["v"].alias("v")).collect():
        cov[r["i"]] = r["v"]
    return n, mu, cov / n


def _regressions(cov: np.ndarray, mu: np.ndarray) -> list[tuple[np.ndarray, float]]:
    """Coefficients and intercept of every column on all others: one inverse if the matrix has one, else one solve each."""
    p, out = len(mu), []
    scale = np.sqrt(np.diag(cov))
    inverse = None
    if p > 1 and (scale > 0).all():
        unit = cov / np.outer(scale, scale)
        if np.linalg.cond(unit) < 1e8:
            inverse = np.linalg.inv(unit) / np.outer(scale, scale)
    for i in range(p):
        rest = [j for j in range(p) if j != i]
        if inverse is not None:
            beta = -inverse[i, rest] / inverse[i, i]
        else:
            beta = np.linalg.lstsq(cov[np.ix_(rest, rest)], cov[rest, i], rcond=1e-12)[0]
        out.append((beta, mu[i] - mu[rest] @ beta))
    return out


def _r2(beta: np.ndarray, intercept: float, cov: np.ndarray, mu: np.ndarray, i: int) -> float | None:
    rest = [j for j in range(len(mu)) if j != i]
    bias = mu[i] - intercept - mu[rest] @ beta
    mse = cov[i, i] - 2 * beta @ cov[rest, i] + beta @ cov[np.ix_(rest, rest)] @ beta + bias * bias
    return None if cov[i, i] <= 0 else float(1 - mse / cov[i, i])


def utility_r2(train: DataFrame, test_a: DataFrame, test_b: DataFrame | None = None,
               cols: list[str] | None = None) -> DataFrame:
    """R2 of every column regressed linearly on all others, fitted on train, scored on one or two tests.

    Moments of each table are enough for all p fits and scores. A constant
    target has no R2 (null).
    """
    cols = cols or P.numeric_cols(train)
    for t in (test_a, test_b):
        if t is not None and not set(cols) <= set(t.columns):
            raise ValueError("train and test tables must share their columns")
    _, mu, cov = moments(train, cols)
    tests = [moments(t, cols) for t in (test_a, test_b) if t is not None]
    rows = []
    for i, (c, (beta, intercept)) in enumerate(zip(cols, _regressions(cov, mu))):
        scores = [_r2(beta, intercept, tc, tm, i) for _, tm, tc in tests]
        rows.append((c, *scores, *[None] * (2 - len(scores))))
    return train.sparkSession.createDataFrame(rows, "column string, r2_a double, r2_b double")


def utility_over_replicas(train: DataFrame, test: DataFrame, replicas: DataFrame, cols: list[str], tag: str = "dataset") -> DataFrame:
    """(dataset, column, train_test, train_synthetic, test_synthetic): R2 of every column, for each replica.

    The first two fits learn from ``train``, the third from ``test``; one pass
    over each table and replica gives all of them.
    """
    facts = {"train": moments(train, cols), "test": moments(test, cols)}
    fits = {n: _regressions(m[2], m[1]) for n, m in facts.items()}
    rows = []
    for name in sorted(r[0] for r in replicas.select(tag).distinct().collect()):
        _, mu, cov = moments(replicas.where(q(tag) == name), cols)
        for i, c in enumerate(cols):
            rows.append((name, c, _r2(*fits["train"][i], facts["test"][2], facts["test"][1], i),
                         _r2(*fits["train"][i], cov, mu, i), _r2(*fits["test"][i], cov, mu, i)))
    return train.sparkSession.createDataFrame(rows, "dataset string, column string, train_test double, train_synthetic double, test_synthetic double")


# ---------------------------------------------------------------- noisy votes and their privacy budget


def teacher_votes(votes: DataFrame) -> DataFrame:
    """(row_id, n0, n1) from (row_id, teacher, vote)."""
    return votes.groupBy("row_id").agg(
        F.count_if(F.col("vote") == 0).alias("n0"), F.count_if(F.col("vote") == 1).alias("n1"))


def noisy_label(counts: DataFrame, noise_scale: float, seed: int) -> DataFrame:
    """1 when the Laplace-noised share of ones exceeds one half."""
    noise = hash_laplace(noise_scale, seed, "laplace", "row_id")
    share = (F.col("n1") + noise) / (F.col("n0") + F.col("n1"))
    return counts.withColumn("noisy_label", (share > 0.5).cast("int"))


def moment_terms(gap, lam: float, steps: int = 20):
    """Per-query bounds on the log moments for orders 1..steps given |n0 - n1|.

    The data-dependent bound holds only below its published threshold on q;
    elsewhere the data-independent one applies.
    """
    lam = F.lit(float(lam))
    qv = F.exp(F.log(F.lit(2.0) + lam * gap) - F.lit(math.log(4.0)) - lam * gap)
    limit = (F.exp(2 * lam) - 1) / (F.exp(4 * lam) - 1)
    out = []
    for l in range(steps):
        safe = 2 * lam * lam * F.lit(float((l + 1) * (l + 2)))
        inside = F.greatest(1 - qv * F.exp(2 * lam), F.lit(1e-300))
        ratio = (1 - qv) / inside
        tight = F.log((1 - qv) * F.pow(ratio, F.lit(float(l + 1))) + qv * F.exp(2 * lam * (l + 1)))
        out.append(F.when(qv < limit, F.least(safe, tight)).otherwise(safe))
    return out


def privacy_moments(counts: DataFrame, lam: float, steps: int = 20) -> DataFrame:
    """(moment_order, alpha): summed log moments. Queries are grouped by vote gap first."""
    gaps = counts.select(F.abs(F.col("n0") - F.col("n1")).alias("gap")).groupBy("gap").agg(
        F.count(F.lit(1)).alias("n"))
    terms = F.array(*moment_terms(F.col("gap"), lam, steps))
    return (gaps.select("n", F.posexplode(terms).alias("l", "term")).groupBy("l")
            .agg(F.sum(F.col("n") * F.col("term")).alias("alpha"))
            .select((F.col("l") + 1).alias("moment_order"), "alpha"))


def privacy_epsilon(counts: DataFrame, lam: float, delta: float, steps: int = 20) -> DataFrame:
    """Smallest (alpha + ln(1/delta)) / order over the moments: one row (epsilon, n_queries)."""
    alphas = privacy_moments(counts, lam, steps)
    eps = (F.col("alpha") + F.lit(math.log(1 / delta))) / F.col("moment_order")
    return alphas.agg(F.min(eps).alias("epsilon")).withColumn(
        "n_queries", counts.agg(F.count(F.lit(1)).alias("n")).scalar())


def within_budget(counts: DataFrame, order: str, lam: float, delta: float, epsilon: float,
                  steps: int = 20) -> DataFrame:
    """Queries answered in ``order`` before the running epsilon reaches the budget.

    A query runs while the spend before it is below ``epsilon``; running sums
    of the moments are range-bucketed.
    """
    terms = moment_terms(F.abs(F.col("n0") - F.col("n1")), lam, steps)
    costs = counts.withColumns({f"_m{i}": t for i, t in enumerate(terms)})
    run = running_sums(costs, [order], {f"_r{i}": f"_m{i}" for i in range(steps)})
    spent = F.least(*[(F.col(f"_r{i}") - F.col(f"_m{i}") + F.lit(math.log(1 / delta))) / F.lit(float(i + 1))
                      for i in range(steps)])
    after = F.least(*[(F.col(f"_r{i}") + F.lit(math.log(1 / delta))) / F.lit(float(i + 1)) for i in range(steps)])
    started = F.when(F.col("_r0") == F.col("_m0"), F.lit(0.0)).otherwise(spent)
    return run.where(started < F.lit(epsilon)).select(*counts.columns, after.alias("epsilon_spent"))


def equal_shards(real: DataFrame, candidates: DataFrame, cols: list[str], key: str, k: int, seed: int = 42) -> DataFrame:
    """(shard, _y, cols): k shards with the same number of rows of both tables, drawn without overlap.

    The number is that of the smaller table over k; what does not fill a shard is left out.
    """
    size = min(real.count(), candidates.count()) // k
    if not size:
        raise ValueError(f"fewer rows than the {k} shards")

    def tag(df: DataFrame, y: float, salt: int) -> DataFrame:
        ranked = hash_rank(df.select(key, *map(q, cols)), seed + salt, "shard", key, out="_rank").where(F.col("_rank") <= size * k)
        return ranked.select(((F.col("_rank") - 1) / size).cast("int").alias("shard"), F.lit(y).alias("_y"), *map(q, cols))

    return tag(real, 1.0, 0).unionByName(tag(candidates, 0.0, 1))


def fit_teachers(rows: DataFrame, cols: list[str], k: int, l2: float = 1.0, rounds: int = 40, tol: float = 1e-8) -> np.ndarray:
    """(k, 1 + columns): intercept and coefficients of k logistic models, one for each ``shard`` of ``rows(shard, _y, cols)``.

    Each minimises its summed log loss plus l2 / 2 times the squared
    coefficients. All advance together by Newton steps: a step is one pass in
    which every task sums the gradient and Hessian block of each shard, so the
    passes do not depend on k. A model whose loss rose goes back half the way.
    """
    d, spark = len(cols) + 1, rows.sparkSession
    penalty = np.diag([0.0] + [l2] * (d - 1))
    width = 1 + d + d * d
    ready = rows.select("shard", "_y", F.array(*[q(c).cast("double") for c in cols]).alias("x"))

    def blocks(weights: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(weights)

        def run(batches):
            w, total = shared.value, np.zeros((k, width))
            for pdf in batches:
                for shard, part in pdf.groupby("shard"):
                    x = np.column_stack([np.ones(len(part)), np.stack(part["x"].to_numpy())])
                    y, z = part["_y"].to_numpy(), x @ w[shard]
                    p = 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
                    loss = (np.logaddexp(0.0, z) - y * z).sum()
                    total[shard] += np.concatenate([[loss], x.T @ (p - y), (x.T * (p * (1 - p)) @ x).ravel()])
            shard, slot = np.nonzero(total)
            yield pd.DataFrame({"shard": shard, "slot": slot, "v": total[shard, slot]})

        summed = ready.mapInPandas(run, "shard long, slot long, v double").groupBy("shard", "slot").agg(F.sum("v").alias("v")).toPandas()
        out = np.zeros((k, width))
        out[summed["shard"].to_numpy(), summed["slot"].to_numpy()] = summed["v"].to_numpy()
        return out

    weights = np.zeros((k, d))
    best, step, least, pulled = weights.copy(), np.zeros((k, d)), np.full(k, np.inf), np.full(k, np.inf)
    for _ in range(rounds):
        got = blocks(weights)
        loss = got[:, 0] + 0.5 * np.einsum("ki,ij,kj->k", weights, penalty, weights)
        for i in range(k):
            if loss[i] > least[i] + 1e-9 * abs(least[i]):  # went too far
                step[i] /= 2
                weights[i] = best[i] + step[i]
                continue
            best[i], least[i] = weights[i], loss[i]
            gradient = got[i, 1:1 + d] + penalty @ weights[i]
            pulled[i] = np.abs(gradient).max()
            step[i] = -np.linalg.lstsq(got[i, 1 + d:].reshape(d, d) + penalty, gradient, rcond=None)[0]
            weights[i] = best[i] + step[i]
        if np.abs(step).max() <= tol * (1 + np.abs(best).max()):
            return weights
    return best


def teachers_say(df: DataFrame, cols: list[str], key: str, weights: np.ndarray) -> DataFrame:
    """(row_id, n0, n1): how many of the logistic models in ``weights`` say 0 and 1 of each row, by one matrix product a batch."""
    kind = df.schema[key].dataType.simpleString()
    k, shared = len(weights), df.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = shared.value
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["x"].to_numpy())
                ones = (x @ w[:, 1:].T + w[:, 0] > 0).sum(axis=1)
                yield pd.DataFrame({"row_id": pdf["row_id"], "n0": k - ones, "n1": ones})

    rows = df.select(q(key).alias("row_id"), F.array(*[q(c).cast("double") for c in cols]).alias("x"))
    return rows.mapInPandas(run, f"row_id {kind}, n0 bigint, n1 bigint")


def pate_ensemble(real: DataFrame, candidates: DataFrame, cols: list[str], key: str, k: int, epsilon: float = 1.0,
                  delta: float = 1e-5, lam: float = 1.0, noise_scale: float = 1.0, seed: int = 42) -> DataFrame:
    """Private real-or-candidate labels for candidate rows, within the budget ``epsilon``.

    k logistic teachers are fitted together on disjoint shards with as many real
    rows as candidates; all score every candidate in one pass.
    """
    weights = fit_teachers(stored(equal_shards(real, candidates, cols, key, k, seed)), cols, k)
    counts = stored(teachers_say(candidates, cols, key, weights))
    return noisy_label(within_budget(counts, "row_id", lam, delta, epsilon), noise_scale, seed)
