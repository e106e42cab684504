"""Traffic features and isolation-forest scores.

The model is data: a table of tree nodes and a table of feature scales.  Every
tree draws its own ``max_samples`` rows from all rows, the algorithm's own
subsample, so the node table's size depends on the number of trees only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threatlens import rules, session
from threatlens.functions import lookup, text
from threatlens.schemas import NODES

MAX_SAMPLES = 256
_WIDE = 1 << 31
STRICT_FEATURES = ("status", "bytes", "path_length", "has_query", "method", "hour", "special_chars")
CLASSIC_FEATURES = ("method", "status", "bytes", "path_length", "agent_length", "query_params",
                    "special_chars", "is_error", "is_server_error", "hour")


#: The columns that training and scoring read.
INPUTS = ("seq", "path", "method", "status_code", "bytes_sent", "user_agent", "ts", "ts_hour")


def feature_names(profile: str = "strict") -> tuple[str, ...]:
    return STRICT_FEATURES if profile == "strict" else CLASSIC_FEATURES


def features(entries: DataFrame, profile: str = "strict") -> DataFrame:
    """Entries with one DOUBLE column ``f_<name>`` per feature."""
    path, status = F.coalesce(F.col("path"), F.lit("")), F.col("status_code")
    hour = F.when(F.col("ts").isNull(), F.lit(12)).otherwise(F.coalesce("ts_hour", F.lit(12)))
    values: dict[str, Column] = {
        "status": status, "bytes": F.col("bytes_sent"), "path_length": F.length(path),
        "method": lookup.method_code(F.col("method"), profile), "hour": hour,
    }
    if profile == "strict":
        values |= {"has_query": F.instr(path, "?") > 0, "special_chars": text.special_char_count(path)}
    else:
        values |= {"agent_length": F.length("user_agent"), "query_params": text.query_params(path),
                   "special_chars": text.has_special_chars(path),
                   "is_error": status >= 400, "is_server_error": status >= 500}
    return entries.withColumns({
        f"f_{name}": values[name].cast("int").cast("double") if name != "bytes"
        else values[name].cast("double") for name in feature_names(profile)})


@dataclass
class Scaler:
    names: tuple[str, ...]
    means: list[float]
    stds: list[float]
    rows: int

    def apply(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({
            f"z_{n}": (F.col(f"f_{n}") - F.lit(m)) / F.lit(s)
            for n, m, s in zip(self.names, self.means, self.stds)})


def fit_scaler(rows: DataFrame, names: tuple[str, ...]) -> Scaler:
    """Mean and population deviation of whole-number features; zero deviation becomes 1.

    Sums are of whole numbers, so the result does not depend on the order of rows: squares are summed
    in two halves; numbers of 2^31 and more, which only ``bytes`` has, are summed as decimals.
    """
    found = [F.count("*").alias("n")]
    for name in names:
        value = F.col(f"f_{name}")
        number = value.cast("long")
        if name == "bytes":
            wide = F.when(F.abs(value) >= _WIDE, value.cast("decimal(18,0)"))
            number = F.when(F.abs(value) < _WIDE, number)
            found += [F.sum(wide).alias("s_wide"), F.sum((wide * wide).cast("decimal(38,0)")).alias("q_wide")]
        square = number * number
        found += [F.sum(number).alias(f"s_{name}"), F.sum(F.shiftright(square, 32)).alias(f"h_{name}"),
                  F.sum(square.bitwiseAND(F.lit((1 << 32) - 1))).alias(f"l_{name}")]
    sums = {k: int(v or 0) for k, v in rows.agg(*found).first().asDict().items()}
    n = sums["n"]
    means, stds = [], []
    for name in names:
        total, squares = sums[f"s_{name}"], (sums[f"h_{name}"] << 32) + sums[f"l_{name}"]
        if name == "bytes":
            total, squares = total + sums["s_wide"], squares + sums["q_wide"]
        means.append(float(Fraction(total, n)) if n else 0.0)
        variance = float(Fraction(n * squares - total * total, n * n)) if n else 0.0
        stds.append(math.sqrt(variance) or 1.0)
    return Scaler(names, means, stds, n)


def scale_features(entries: DataFrame, profile: str = "strict") -> DataFrame:
    rows = features(entries, profile)
    return fit_scaler(rows, feature_names(profile)).apply(rows)


def _uniform(*columns: Column) -> Column:
    """A repeatable number in [0, 1) from a row's own content."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def _pool(scaled: DataFrame, rows: int, most: int, seed: int) -> DataFrame:
    """The ``most`` rows with the smallest hashes: a uniform sample of all rows, from one hash per row.

    Only rows that may belong to it leave the scan; the rest of the work is on at most
    ``most`` rows, whatever the size of the input.
    """
    if rows <= most:
        return scaled
    place = _uniform(F.col("seq.part"), F.col("seq.pos"), F.lit(seed), F.lit("pool"))
    share = 1.2 * most / rows + 100.0 / rows        # thirty deviations above what is wanted
    return scaled.withColumn("_v", place).where(F.col("_v") < share).orderBy(
        "_v", "seq.part", "seq.pos").limit(most).drop("_v")


def _tree_samples(scaled: DataFrame, names: tuple[str, ...], rows: int, trees: int, seed: int,
                  max_samples: int = MAX_SAMPLES) -> DataFrame:
    """The rows of each tree's sample, chosen by hash from all rows, so partitioning does not matter.

    All trees draw from one uniform sample of ``trees * max_samples`` rows (all rows, where
    there are fewer), so each tree's sample is uniform over all rows.  A row of it meets every
    tree as a number in [0, 1), and the smallest numbers win.
    """
    part, pos = F.col("seq.part"), F.col("seq.pos")
    most = trees * max_samples
    pool = _pool(scaled, rows, most, seed)
    share = min(1.0, 2.0 * max_samples / max(min(rows, most), 1))
    drawn = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(trees - 1)),
                    lambda t: F.struct(t.alias("tree"), _uniform(part, pos, t, F.lit(seed)).alias("v"))),
        lambda d: d["v"] < share)
    hits = pool.select(F.array(*[F.col(f"z_{n}") for n in names]).alias("x"), part.alias("_part"),
                       pos.alias("_pos"), drawn.alias("_drawn")).filter(F.size("_drawn") > 0)
    hits = hits.select("x", "_part", "_pos", F.inline("_drawn"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy("v", "_part", "_pos"))
    return hits.withColumn("_rank", rank).filter(F.col("_rank") <= max_samples).select("tree", "_rank", "x")


def kth_smallest(rows: DataFrame, column: str, k: int, bins: int = 1000) -> float:
    """The exact k-th smallest value (0-based) of a numeric column without a sort.

    Each pass counts the values of the range that holds it in ``bins`` slices
    and goes on in one of them, until that slice holds a single value.
    """
    value, low, high, before = F.col(column), None, None, 0
    while True:
        if low is None:
            low, high = rows.agg(F.min(value), F.max(value)).first()
        if low == high:
            return low
        slot = F.least(F.floor((value - F.lit(low)) / F.lit(high - low) * bins), F.lit(bins - 1))
        slices = (rows.filter(value.between(low, high)).groupBy(slot.alias("slot"))
                  .agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
                  .orderBy("slot").collect())
        for s in slices:
            if before + s["n"] > k:
                low, high = s["low"], s["high"]
                break
            before += s["n"]


def quantile(rows: DataFrame, column: str, share: float, total: int) -> float:
    """The exact quantile, interpolated between neighbours."""
    at = (total - 1) * share
    low = kth_smallest(rows, column, math.floor(at))
    high = low if at == math.floor(at) else kth_smallest(rows, column, math.floor(at) + 1)
    return low + (high - low) * (at - math.floor(at))


def _grow(seed: int):
    """Builds the nodes of one tree from its sample."""
    def build(sample: pd.DataFrame) -> pd.DataFrame:
        tree = int(sample["tree"].iloc[0])
        x = np.stack(sample.sort_values("_rank")["x"].to_numpy())
        rng = np.random.default_rng([seed, tree])
        limit = math.ceil(math.log2(max(len(x), 2)))
        nodes: list[tuple] = []
        pending = [(np.arange(len(x)), 0, -1, False)]
        while pending:
            index, depth, parent, is_right = pending.pop()
            node = len(nodes)
            if parent >= 0:
                slot = 5 if is_right else 4
                nodes[parent] = (*nodes[parent][:slot], node, *nodes[parent][slot + 1:])
            low, high = x[index].min(axis=0), x[index].max(axis=0)
            usable = np.flatnonzero(high > low)
            if depth >= limit or len(index) <= 1 or len(usable) == 0:
                nodes.append((tree, node, -1, 0.0, -1, -1, len(index), depth))
                continue
            feature = int(rng.choice(usable))
            threshold = float(rng.uniform(low[feature], high[feature]))
            left = x[index, feature] <= threshold
            nodes.append((tree, node, feature, threshold, -1, -1, len(index), depth))
            pending.append((index[~left], depth + 1, node, True))
            pending.append((index[left], depth + 1, node, False))
        return pd.DataFrame(nodes, columns=NODES.fieldNames())
    return build


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a random tree of n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


@dataclass
class Forest:
    """A fitted model; ``nodes`` is a table, the rest are a few numbers."""

    nodes: DataFrame
    scaler: Scaler
    sample: int
    offset: float
    profile: str
    anomalies_in_training: int = 0

    @property
    def training_samples(self) -> int:
        return self.scaler.rows

    def score(self, entries: DataFrame) -> DataFrame:
        """Entries with ``score``, ``anomaly_score`` and ``is_anomaly``."""
        return self.decide(_score(self.scaler.apply(features(entries, self.profile)),
                                  self.nodes, self.scaler.names, self.sample))

    def decide(self, scored: DataFrame) -> DataFrame:
        """Scores are negative, lower is stranger; below the offset is an anomaly."""
        return scored.withColumn("anomaly_score", F.col("score") - F.lit(self.offset)) \
            .withColumn("is_anomaly", F.col("anomaly_score") < 0)

    def save(self, path: str) -> None:
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        spark = self.nodes.sparkSession
        s = self.scaler
        session.table(
            spark, [(i, n, m, d, s.rows, self.sample, self.offset, self.profile, self.anomalies_in_training)
             for i, (n, m, d) in enumerate(zip(s.names, s.means, s.stds))],
            "position int, name string, mean double, std double, rows bigint, sample int, "
            "offset double, profile string, anomalies bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/scaler")


def load(spark: SparkSession, path: str) -> Forest:
    from threatlens.sources.files import exists
    if not (exists(spark, f"{path}/nodes") and exists(spark, f"{path}/scaler")):
        raise FileNotFoundError(f"no model in {path}")
    saved = spark.read.parquet(f"{path}/scaler").orderBy("position").collect()   # one row per feature
    first = saved[0]
    return Forest(spark.read.parquet(f"{path}/nodes"),
                  Scaler(tuple(r["name"] for r in saved), [r["mean"] for r in saved],
                         [r["std"] for r in saved], first["rows"]),
                  first["sample"], first["offset"], first["profile"], first["anomalies"])


def train(entries: DataFrame, profile: str = "strict", contamination: float | None = None,
          trees: int = 100, seed: int = 42, max_samples: int = MAX_SAMPLES) -> Forest:
    """Fits a forest; needs at least 10 entries (strict) or one (classic).

    ``max_samples`` is the size of a tree's sample, drawn from all entries.
    Features and scores are staged, because several passes read them.
    """
    p = rules.profile(profile)
    contamination = p.contamination if contamination is None else contamination
    names = feature_names(profile)
    spark = entries.sparkSession
    rows = session.stage(features(entries, profile).select("seq", *[f"f_{n}" for n in names]),
                         session.fresh_path(spark, "features"))
    scaler = fit_scaler(rows, names)
    needed = 10 if profile == "strict" else 1
    if scaler.rows < needed:
        raise ValueError(f"need at least {needed} entries, got {scaler.rows}")
    scaled = scaler.apply(rows)
    sample = min(max_samples, scaler.rows)
    built = _tree_samples(scaled, names, scaler.rows, trees, seed, max_samples) \
        .groupBy("tree").applyInPandas(_grow(seed), NODES)
    # At most 2 * max_samples nodes per tree; kept as rows of the plan so they are grown once.
    grown = built.orderBy("tree", "node").toPandas()
    roots = grown[grown["node"] == 0]
    if len(roots) != trees or not (roots["size"] == sample).all():
        raise RuntimeError("a tree did not get its whole sample")
    nodes = spark.createDataFrame(grown, NODES)
    scores = session.stage(_score(scaled, nodes, names, sample).select("score"), session.fresh_path(spark, "scores"))
    cut = quantile(scores, "score", contamination, scaler.rows)
    below = scores.filter(F.col("score") < F.lit(cut)).count()
    return Forest(nodes, scaler, sample, cut, profile, below)


def _steps(tree: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, np.ndarray]:
    """A tree to walk in whole batches: feature, threshold, next node, levels and path length.

    Nodes are renumbered by level, so that a node's children lie side by side: ``onward[node]`` is
    where a row above the threshold goes, the one after it where the others go.  Leaves lead to
    themselves, as no value is below their threshold, so after ``levels`` steps every row is in its leaf.
    """
    inner, count = tree["feature"] >= 0, 1
    order, onward = np.zeros(len(inner), np.intp), np.arange(len(inner))
    for at in range(len(inner)):
        node = order[at]
        if inner[node]:
            onward[at], order[count], order[count + 1] = count, tree["right"][node], tree["left"][node]
            count += 2
    length = tree["depth"] + np.array([average_path(n) for n in tree["size"]])
    return (np.where(inner, tree["feature"], 0).astype(np.intp)[order], np.where(inner, tree["threshold"], np.nan)[order],
            onward, int(tree["depth"].max()), length[order])


def _total_length(x: np.ndarray, trees: list[tuple]) -> np.ndarray:
    """Path lengths of the rows of ``x``, summed over the trees in their order.

    Every step writes into the same few arrays; all indices are in range by construction, so they are not checked.
    """
    n = len(x)
    flat, rows = np.ascontiguousarray(x.T).reshape(-1), np.arange(n)
    at, cell, value, limit, below = (np.empty(n, t) for t in (np.intp, np.intp, float, float, bool))
    total = np.zeros(n)
    for feature, threshold, onward, levels, length in trees:
        column = feature * n
        at[:] = 0
        for _ in range(levels):
            column.take(at, out=cell, mode="clip")
            cell += rows
            flat.take(cell, out=value, mode="clip")
            threshold.take(at, out=limit, mode="clip")
            np.less_equal(value, limit, out=below)
            onward.take(at, out=cell, mode="clip")
            np.add(cell, below, out=at)
        total += length.take(at, out=value, mode="clip")
    return total


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows in the order they appear, and which of them each row is."""
    frame = pd.DataFrame(x)
    back = frame.groupby(list(frame.columns), sort=False, dropna=False).ngroup().to_numpy()
    return x[~frame.duplicated().to_numpy()], back


def _score(scaled: DataFrame, nodes: DataFrame, names: tuple[str, ...], sample: int) -> DataFrame:
    """Adds ``score`` = -2^(-mean depth / average depth), tree by tree on whole batches."""
    table = nodes.toPandas().sort_values(["tree", "node"])     # bounded by the number of trees
    packed = scaled.sparkSession.sparkContext.broadcast([
        {c: group[c].to_numpy() for c in ("feature", "threshold", "left", "right", "size", "depth")}
        for _, group in table.groupby("tree")])
    normal = average_path(sample) or 1.0

    @F.pandas_udf("double")
    def forest_score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        trees = [_steps(t) for t in packed.value]
        for batch in batches:
            x = np.column_stack([c.to_numpy(dtype=float) for c in batch])
            # Log lines repeat: walk every distinct vector once.
            x, back = _distinct(x)
            depth = _total_length(x, trees)
            yield pd.Series((-np.exp2(-depth / len(trees) / normal))[back])
    return scaled.withColumn("score", forest_score(*[F.col(f"z_{n}") for n in names]))
