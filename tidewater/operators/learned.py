"""A learned priority model of boosted trees, its additive attribution, and a guarded retrain."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.sources.stored import stored


@dataclass
class Priority:
    """Trees as arrays (tree, node): split feature or -1, threshold, value times the tree's weight. Node k has the children
    2 k + 1 (up to the threshold) and 2 k + 2. ``metrics`` is one row: mae, rmse and rounds."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    depth: int
    metrics: DataFrame


#: Bins of a feature's values, of which a split takes the lower ones, and distinct examples of one block.
BINS = 32
ROWS = 1 << 14


def fit_priority(examples: DataFrame, features: list[str], *, target: str = "target", rounds: int = 400, patience: int = 30, depth: int = 3, rate: float = 0.05, share: float = 0.9, batch: int = 32, seed: int = 42) -> Priority:
    """Boosted trees on four fifths of the examples, chosen by a hash, each tree on ``share`` of them, with errors on the
    other fifth. Of the ``rounds`` trees those are kept up to the least squared error on that fifth, the first that
    ``patience`` further trees do not improve on; then no more are grown.

    As in Spark ML, the first tree counts whole and the others by ``rate``, and these fit twice what is left. A level of a tree is one
    job: tasks sum what is left by node, feature and bin, and the driver chooses the splits from these sums. Every
    ``batch`` trees the predictions are made anew from the stored examples, which ends their lineage and changes no tree.
    """
    held = F.pmod(F.xxhash64(*features, F.lit(seed)), F.lit(5)) == 0
    cuts = _cuts(examples.filter(~held), features)
    blocks = _blocks(examples.withColumn("_held", held), features, target, cuts).persist(StorageLevel.MEMORY_AND_DISK)
    size = 2 ** (depth + 1) - 1
    feature, bins, value = np.full((0, size), -1), np.zeros((0, size), np.int64), np.zeros((0, size))
    state, best, errors = None, 0, []
    while True:
        grown = len(feature)
        since = 0 if grown % batch == 0 else grown - 1
        before, state = state, (blocks if since == 0 else state).map(_step(feature, bins, value, since, depth, share, seed)).persist(StorageLevel.MEMORY_AND_DISK)
        sums, error = state.map(_sums(None, np.zeros(1, np.uint8))).reduce(_added)
        if before is not None:
            before.unpersist()
        if grown:
            errors.append(error[0] / error[1] if error[1] else np.nan)
            best = grown - 1 if errors[-1] < errors[best] else best
            if grown == rounds or grown - 1 - best >= patience:
                break
        made = np.full((1, size), -1), np.zeros((1, size), np.int64), np.zeros((1, size))
        for level in range(depth):
            if level:
                sums = _both(sums, made[0][0], level, lambda slot, state=state, tree=(made[0][0], made[1][0], level): state.map(_sums(tree, slot)).reduce(_added)[0])
            if not _split(sums, level, *(m[0] for m in made), cuts):
                break
        # the sums are of twice what is left
        made[2][:] *= rate if grown else 0.5
        feature, bins, value = (np.concatenate(pair) for pair in zip((feature, bins, value), made, strict=True))
    state.unpersist()
    blocks.unpersist()
    limit = np.array([[cuts[f][k] if f >= 0 else 0.0 for f, k in zip(*row, strict=True)] for row in zip(feature, bins, strict=True)])
    found = feature[: best + 1], limit[: best + 1], value[: best + 1], depth
    judged = _walked(found, examples.filter(held).select(*features, target), features, [target]).withColumn("_e", F.abs(F.col("prediction") - F.col(target)))
    metrics = judged.agg(F.round(F.avg("_e"), 6).alias("mae"), F.round(F.sqrt(F.avg(F.col("_e") * F.col("_e"))), 6).alias("rmse")).withColumn("rounds", F.lit(best + 1))
    return Priority(*found, metrics)


def _cuts(rows: DataFrame, features: list[str]) -> list[np.ndarray]:
    """Per feature where its bins end: between neighbours of few values, else at quantiles. NaN is above all of them, null too."""
    known = [F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in features]
    n = rows.agg(*[F.approx_count_distinct(c, 0.02).alias(f"_{k}") for k, c in enumerate(known)]).first()
    shares = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
    row = rows.agg(*[(F.collect_set(c) if n[k] <= BINS else F.percentile_approx(c, shares, 10000)).alias(f"_{k}") for k, c in enumerate(known)]).first()
    values = [np.unique(np.array(v or [], float)) for v in row]
    ends = [(v[:-1] + v[1:]) / 2 if n[k] <= BINS else v for k, v in enumerate(values)]
    # the estimate of the number may be below it
    return [e[np.unique(np.linspace(0, len(e) - 1, BINS - 1).round().astype(int))] if len(e) >= BINS else e for e in ends]


def _blocks(examples: DataFrame, features: list[str], target: str, cuts: list[np.ndarray]) -> RDD:
    """Blocks of the distinct examples: (number, bin of each feature, target, how often it is there, how many are not held out),
    those held out last."""
    names = [f"_{k}" for k in range(len(features))]
    rows = examples.select("_held", F.col(target).cast("double").alias("_y"), *[F.col(f).cast("double").alias(n) for f, n in zip(features, names, strict=True)])
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("_n")).sortWithinPartitions(F.xxhash64(*names, "_y"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            for start in range(0, len(batch), ROWS):
                b = batch[start : start + ROWS].sort_values("_held", kind="stable")
                x = np.stack([np.searchsorted(c, b[n].to_numpy(float)) for n, c in zip(names, cuts, strict=True)]).astype(np.uint8)
                yield pd.DataFrame({"block": [part << 32 | k], "x": [x.tobytes()], "y": [b["_y"].to_numpy(float).tobytes()], "n": [b["_n"].to_numpy(np.int64).tobytes()], "own": [int((~b["_held"]).sum())]})
                k += 1

    packed = rows.mapInPandas(pack, "block long, x binary, y binary, n binary, own long")
    packed = stored(packed, "blocks")
    parts = min(packed.count(), 2 * packed.sparkSession.sparkContext.defaultParallelism)
    packed = packed.repartition(max(parts, 1), "block").sortWithinPartitions("block")
    read = lambda r: (r["block"], np.frombuffer(r["x"], np.uint8).reshape(len(names), -1), np.frombuffer(r["y"]), np.frombuffer(r["n"], np.int64), r["own"])
    return packed.rdd.map(read)


def _reached(x: np.ndarray, feature: np.ndarray, bins: np.ndarray, levels: int) -> np.ndarray:
    """The node of one tree where each column of ``x`` is after ``levels`` splits."""
    at = np.zeros(x.shape[1], np.uint16)
    for level in range(levels):
        nodes = range(2**level - 1, 2 ** (level + 1) - 1)
        moved = at.copy()
        for k in nodes:
            if feature[k] >= 0:
                here = at == k
                moved[here & (x[feature[k]] <= bins[k])] = 2 * k + 1
                moved[here & (x[feature[k]] > bins[k])] = 2 * k + 2
        at = moved
    return at


def _step(feature: np.ndarray, bins: np.ndarray, value: np.ndarray, since: int, depth: int, share: float, seed: int) -> Callable[[tuple], tuple]:
    """A block with its predictions after all trees, those from ``since`` on being new to it, and the times that each of its
    examples is drawn for the next tree."""
    grown, feature, bins, value = len(feature), feature[since:], bins[since:], value[since:]

    def step(block: tuple) -> tuple:
        key, x, y, n, own = block[:5]
        said = block[5] if since else np.zeros(len(y))
        for t in range(len(feature)):
            said = said + value[t][_reached(x, feature[t], bins[t], depth)]
        random = np.random.default_rng([seed, grown, key])
        drawn, many = (random.random(own) < share).astype(float), np.flatnonzero(n[:own] > 1)
        drawn[many] = random.binomial(n[many], share)
        return key, x, y, n, own, said, drawn

    return step


def _sums(tree: tuple[np.ndarray, np.ndarray, int] | None, slot: np.ndarray) -> Callable[[tuple], tuple[np.ndarray, np.ndarray]]:
    """Of a block: how many are drawn and twice what is left of them to say, by feature, place of the node in ``slot`` (255: none) and bin;
    and the squared error and number of those held out."""
    places = int((slot < 255).sum())

    def sums(block: tuple) -> tuple[np.ndarray, np.ndarray]:
        _, x, y, n, own, said, drawn = block
        left = y - said
        error = np.array([(n[own:] * left[own:] ** 2).sum(), n[own:].sum()])
        x, left, at = x[:, :own], 2 * left[:own], np.zeros(own, np.int64)
        if tree:
            place = slot[_reached(x, *tree)]
            used = np.flatnonzero(place < 255)
            x, left, drawn, at = x[:, used], left[used], drawn[used], place[used].astype(np.int64) * BINS
        left, out = left * drawn, np.zeros((len(x), 2, places, BINS))
        for f in range(len(x)):
            cell = at + x[f]
            out[f, 0], out[f, 1] = (np.bincount(cell, w, places * BINS).reshape(places, BINS) for w in (drawn, left))
        return out, error

    return sums


def _both(above: np.ndarray, feature: np.ndarray, level: int, summed: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sums of a level's nodes, of which the left ones are summed and the right ones are what the node above has besides."""
    slot, out = np.full(len(feature), 255, np.uint8), np.zeros((len(above), 2, 2**level, BINS))
    parents = [p for p in range(2 ** (level - 1)) if feature[2 ** (level - 1) - 1 + p] >= 0]
    for k, p in enumerate(parents):
        slot[2**level - 1 + 2 * p] = k
    found = summed(slot)
    for k, p in enumerate(parents):
        out[:, :, 2 * p] = found[:, :, k]
        out[:, :, 2 * p + 1] = above[:, :, p] - found[:, :, k]
    return out


def _added(a: tuple, b: tuple) -> tuple:
    return a[0] + b[0], a[1] + b[1]


def _split(sums: np.ndarray, level: int, feature: np.ndarray, bins: np.ndarray, value: np.ndarray, cuts: list[np.ndarray]) -> bool:
    """Fills in the splits of a level's nodes that lower the squared error most, and the values on both sides; whether there
    is one."""
    some = False
    for node in range(2**level):
        k = 2**level - 1 + node
        n, total = sums[0, :, node].sum(axis=1)
        if n < 0.5:
            continue
        if level == 0:
            value[0] = total / n
        under = sums[:, :, node].cumsum(axis=2)
        n_left, left = under[:, 0], under[:, 1]
        valid = (n_left > 0.5) & (n_left < n - 0.5) & (np.arange(BINS) < np.array([len(c) for c in cuts])[:, None])
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(valid, left**2 / n_left + (total - left) ** 2 / (n - n_left) - total**2 / n, -np.inf)
        f, b = np.unravel_index(gain.argmax(), gain.shape)
        if gain[f, b] > 1e-9 * n:
            feature[k], bins[k], some = f, b, True
            value[2 * k + 1], value[2 * k + 2] = left[f, b] / n_left[f, b], (total - left[f, b]) / (n - n_left[f, b])
    return some


def _walked(trees: tuple[np.ndarray, np.ndarray, np.ndarray, int], rows: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """The columns in ``keep`` with base, prediction and a_* per feature. The trees, at most some thousand nodes, go to the
    tasks as arrays, with what each feature changes on the way to each node."""
    feature, cut, value, depth = trees
    base, names = float(value[:, 0].sum()), [f"a_{f}" for f in features]
    change = np.zeros((*feature.shape, len(features)))
    for t, k in zip(*np.nonzero(feature >= 0), strict=True):
        for child in (2 * k + 1, 2 * k + 2):
            change[t, child] = change[t, k]
            change[t, child, feature[t, k]] += value[t, child] - value[t, k]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, parts = batch[[f"_{f}" for f in features]].to_numpy(float), np.zeros((len(batch), len(features)))
            line = np.arange(len(x))
            for t in range(len(feature)):
                at = np.zeros(len(x), np.int64)
                for _ in range(depth):
                    split = feature[t, at]
                    right = ~(x[line, np.maximum(split, 0)] <= cut[t, at])
                    at = np.where(split >= 0, 2 * at + 1 + right, at)
                parts += change[t, at]
            yield pd.DataFrame({**{c: batch[c] for c in keep}, "base": base, "prediction": base + parts.sum(1), **{n: parts[:, k] for k, n in enumerate(names)}})

    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep] + [f"{n} double" for n in ["base", "prediction", *names]]
    return rows.select(*keep, *[F.col(f).cast("double").alias(f"_{f}") for f in features]).mapInPandas(walk, ", ".join(kinds))


def attribute(priority: Priority, rows: DataFrame, features: list[str], row_id: str) -> DataFrame:
    """Per row: prediction = base + sum of a_*: along each tree's path, the change of the node's value is the split
    feature's."""
    return _walked((priority.feature, priority.cut, priority.value, priority.depth), rows, features, [row_id])


def guarded_retrain(examples: DataFrame, features: list[str], *, score: str = "score", target: str = "target", least: int = 50, least_held: int = 5, held_share: float = 0.25, least_train: int = 25, threshold: float = 40.0, seed: int = 42, **fitting) -> DataFrame:
    """One row: whether a model trained on the examples is to replace what gave them their ``score``.

    Held out are the examples whose hash falls into the larger of ``held_share`` and ``least_held`` of all, so the split
    does not depend on order or partitions. Promoted is only a model whose precision at ``threshold`` (the share with the
    larger target among those scored at or above it) on the held-out examples is strictly better. Too few examples are
    refused with a reason.
    """
    spark = examples.sparkSession
    n = examples.count()
    place = F.pmod(F.xxhash64(*features, F.lit(seed + 1)), F.lit(1 << 30)) / (1 << 30)
    held = place < max(held_share, least_held / n if n else 1.0)
    n_held = examples.filter(held).count() if n else 0
    row = {"n_examples": n, "n_held": n_held, "old_precision": None, "new_precision": None, "promoted": False, "reason": None}
    if n < least:
        row["reason"] = f"{n} of {least} examples"
    elif n - n_held < least_train:
        row["reason"] = f"{n - n_held} of {least_train} examples to train on"
    else:
        model = fit_priority(examples.filter(~held), features, target=target, seed=seed, **fitting)
        judged = _walked((model.feature, model.cut, model.value, model.depth), examples.filter(held), features, [score, target])
        good = (F.col(target) >= 50).cast("double")
        share = lambda c: F.round(F.avg(F.when(F.col(c) >= threshold, good)), 6)
        old, new = judged.agg(share(score), share("prediction")).first()
        row |= {"old_precision": old, "new_precision": new, "promoted": new is not None and (old is None or new > old)}
        row["reason"] = None if row["promoted"] else "not better"
    return spark.createDataFrame([tuple(row.values())], "n_examples long, n_held long, old_precision double, new_precision double, promoted boolean, reason string")
