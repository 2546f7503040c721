"""Dense networks on large tables: MLlib's net and its optimiser, with each pass in numpy over packed blocks of rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.session import materialize

ROWS = 512  # rows of a block: what a layer makes of them stays in a core's cache
SENT = 1 << 23  # bytes of gradients that the driver adds up itself
HISTORY, SEARCH = 10, 10  # corrections of L-BFGS, steps of a line search


def packed(df: DataFrame, width: int) -> DataFrame:
    """(x, y): features and labels of blocks of rows as bytes, on as many partitions as ``df`` has."""
    def run(batches):
        for batch in batches:
            x, y = batch.column(0).flatten().to_numpy().reshape(-1, width), batch.column(1).to_numpy()
            cuts = range(0, len(x), ROWS)
            yield pa.RecordBatch.from_arrays([pa.array([v[a:a + ROWS].tobytes() for a in cuts], pa.binary()) for v in (x, y)], names=["x", "y"])

    rows = df.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"))
    return materialize(rows.mapInArrow(run, "x binary, y binary"))


def layers_of(w: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views of the weights and offsets of each layer, in MLlib's order."""
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append((w[at:at + a * b].reshape(a, b), w[at + a * b:at + a * b + b]))
        at += a * b + b
    return out


def loss_and_gradient(x: np.ndarray, y: np.ndarray, w: np.ndarray, sizes: list[int]) -> tuple[float, np.ndarray]:
    """Summed cross-entropy of rows and its gradient: sigmoid hidden layers, softmax output."""
    layers, seen = layers_of(w, sizes), [x]
    for k, (weights, offset) in enumerate(layers):
        z = seen[-1] @ weights
        z += offset
        if k < len(layers) - 1:
            np.negative(z, out=z)
            with np.errstate(over="ignore"):
                np.exp(z, out=z)
            z += 1
            np.reciprocal(z, out=z)
        seen.append(z)
    out = seen.pop()
    out -= out.max(axis=1, keepdims=True)
    total = np.log(np.exp(out).sum(axis=1))
    rows = np.arange(len(x))
    loss = float((total - out[rows, y]).sum())
    delta = np.exp(out - total[:, None])
    delta[rows, y] -= 1
    gradient = np.empty(len(w))
    slots = layers_of(gradient, sizes)
    for k in range(len(layers) - 1, -1, -1):
        slots[k][0][:], slots[k][1][:] = seen[k].T @ delta, delta.sum(axis=0)
        if k:
            delta = delta @ layers[k][0].T
            delta *= seen[k] * (1 - seen[k])
    return loss, gradient


def passes(blocks: DataFrame, sizes: list[int], n: int):
    """The function from weights to mean loss and gradient: one pass over all blocks, sums in the order of the partitions."""
    width = sizes[0]
    length = sum((a + 1) * b for a, b in zip(sizes, sizes[1:]))
    parts = blocks.rdd.getNumPartitions()
    slices = 1 if parts * length * 8 <= SENT else min(length, 1 + length // 4096)
    cuts = np.linspace(0, length, slices + 1).astype(int)

    def evaluate(w: np.ndarray) -> tuple[float, np.ndarray]:
        def run(batches):
            from pyspark import TaskContext

            loss, gradient = 0.0, np.zeros(length)
            for batch in batches:
                for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    one, more = loss_and_gradient(np.frombuffer(x).reshape(-1, width), np.frombuffer(y).astype(np.int64), w, sizes)
                    loss += one
                    gradient += more
            pieces = [gradient[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
            at = [TaskContext.get().partitionId()] * slices
            losses = [loss] + [0.0] * (slices - 1)
            yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array(at, pa.int32()), pa.array(losses), pa.array(pieces, pa.binary())],
                                             names=["slice", "part", "loss", "g"])

        def added(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("part")
            return pd.DataFrame({"slice": pdf["slice"][:1], "part": [0], "loss": [pdf["loss"].sum()], "g": [sum(np.frombuffer(g) for g in pdf["g"]).tobytes()]})

        schema = "slice int, part int, loss double, g binary"
        sums = blocks.mapInArrow(run, schema)
        if slices > 1:
            sums = sums.groupBy("slice").applyInPandas(added, schema)
        rows = sorted(sums.collect(), key=lambda r: (r["slice"], r["part"]))
        total = np.zeros(length)
        for r in rows:
            total[cuts[r["slice"]]:cuts[r["slice"] + 1]] += np.frombuffer(bytes(r["g"]))
        return sum(r["loss"] for r in rows) / n, total / n

    return evaluate


def _step(evaluate, w, loss, gradient, way, first: float):
    """(weights, loss, gradient) at a step along ``way`` that meets the strong Wolfe conditions, or None."""
    slope = float(gradient @ way)
    if slope >= 0:
        return None

    def at(t: float):
        there = w + t * way
        f, g = evaluate(there)
        return t, f, float(g @ way), there, g

    def zoom(low, high):
        for _ in range(SEARCH):
            d1 = low[2] + high[2] - 3 * (low[1] - high[1]) / (low[0] - high[0])
            under = d1 * d1 - low[2] * high[2]
            t = (low[0] + high[0]) / 2
            if np.isfinite(under) and under >= 0:
                d2 = np.sign(high[0] - low[0]) * under ** 0.5
                cubic = high[0] - (high[0] - low[0]) * (high[2] + d2 - d1) / (high[2] - low[2] + 2 * d2)
                edge = 0.1 * abs(high[0] - low[0])
                if np.isfinite(cubic) and min(low[0], high[0]) + edge <= cubic <= max(low[0], high[0]) - edge:
                    t = float(cubic)
            now = at(t)
            if not now[1] <= loss + 1e-4 * t * slope or now[1] >= low[1]:
                high = now
            else:
                if abs(now[2]) <= -0.9 * slope:
                    return now
                if now[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = now
        return low if low[0] > 0 else None

    before, t, found = (0.0, loss, slope, w, gradient), first, None
    for i in range(SEARCH):
        now = at(t)
        if not now[1] <= loss + 1e-4 * t * slope or (i and now[1] >= before[1]):
            found = zoom(before, now)
            break
        if abs(now[2]) <= -0.9 * slope:
            found = now
            break
        if now[2] >= 0:
            found = zoom(now, before)
            break
        before, t, found = now, t * 1.5, now
    return found and found[3:4] + found[1:2] + found[4:5]


def lbfgs(evaluate, w: np.ndarray, max_iter: int, tol: float) -> tuple[np.ndarray, list[float]]:
    """Weights after at most ``max_iter`` steps of L-BFGS, and the loss before each and at the end; ends as MLlib's does."""
    loss, gradient = evaluate(w)
    losses, pairs = [loss], []
    for _ in range(max_iter):
        if np.linalg.norm(gradient) <= max(tol * abs(loss), 1e-8):
            break
        way, kept = -gradient, []
        for s, d in reversed(pairs):
            kept.append(float(s @ way) / float(s @ d))
            way = way - kept[-1] * d
        if pairs:
            s, d = pairs[-1]
            way = way * (float(s @ d) / float(d @ d))
        for (s, d), a in zip(pairs, reversed(kept)):
            way = way + s * (a - float(d @ way) / float(s @ d))
        done = _step(evaluate, w, loss, gradient, way, 1.0 if pairs else 1.0 / float(np.linalg.norm(way)))
        if done is None and pairs:  # start again from the gradient
            pairs = []
            done = _step(evaluate, w, loss, gradient, -gradient, 1.0 / float(np.linalg.norm(gradient)))
        if done is None:
            break
        s, d = done[0] - w, done[2] - gradient
        if float(s @ d) > 0:
            pairs = [*pairs, (s, d)][-HISTORY:]
        w, loss, gradient = done
        losses.append(loss)
        recent = losses[-21:-1]
        if len(recent) == 20 and abs(loss - max(recent)) <= tol * abs(losses[0]):
            break
    return w, losses
