import numpy as np
import pytest

from threatlens.operators import anomaly


@pytest.fixture(scope="module")
def traffic(entries):
    rows = [("1.1.1.1", f"/page{i % 7}?a={i % 3}", 200, "Mozilla", i) for i in range(600)]
    rows += [("6.6.6.6", "/" + "<" * 90 + f"?{i}&b", 500, "x", 3600 * 9 + i) for i in range(6)]
    return entries(rows)


def test_scaler_equals_numpy(traffic):
    rows = anomaly.features(traffic)
    names = anomaly.STRICT_FEATURES
    data = np.array([[r[f"f_{n}"] for n in names] for r in rows.collect()])
    scaler = anomaly.fit_scaler(rows, names)
    assert np.allclose(scaler.means, data.mean(axis=0))
    std = data.std(axis=0)
    assert np.allclose(scaler.stds, np.where(std == 0, 1, std))


def test_outliers_first_and_share_near_contamination(traffic, spark, tmp_path):
    forest = anomaly.train(traffic, contamination=0.05, trees=40)
    scored = forest.score(traffic).select("ip", "score", "is_anomaly", "seq").collect()
    assert all(-1 <= r.score < 0 for r in scored)
    lowest = sorted(scored, key=lambda r: r.score)[:6]
    assert {r.ip for r in lowest} == {"6.6.6.6"}
    assert 0.005 < sum(r.is_anomaly for r in scored) / len(scored) < 0.08
    forest.save(str(tmp_path / "m"))
    again = anomaly.load(spark, str(tmp_path / "m")).score(traffic)
    assert {r.seq.pos: r.score for r in again.collect()} == {r.seq.pos: r.score for r in scored}
    with pytest.raises(FileNotFoundError):
        anomaly.load(spark, str(tmp_path / "none"))


def test_model_does_not_depend_on_partitions(traffic):
    a, b = (anomaly.train(traffic.repartition(n), trees=8).nodes.orderBy("tree", "node").collect() for n in (1, 6))
    assert a == b
    assert anomaly.train(traffic, trees=8, seed=7).nodes.collect() != a


def test_too_few_rows(traffic):
    with pytest.raises(ValueError):
        anomaly.train(traffic.limit(5))


def test_samples_come_from_all_rows(spark):
    """Above and below any fixed pool size every tree gets its own whole sample."""
    from pyspark.sql import functions as F
    rows = spark.range(100_000).select(
        F.struct(F.lpad((F.col("id") % 8).cast("string"), 3, "0").alias("part"), F.col("id").alias("pos")).alias("seq"),
        F.col("id").cast("double").alias("z_a"))
    found = anomaly._tree_samples(rows, ("a",), 100_000, 30, 42).select("tree", F.col("x")[0].alias("v")).collect()
    per_tree = {}
    for tree, v in found:
        per_tree.setdefault(tree, set()).add(v)
    assert len(per_tree) == 30 and all(len(s) == 256 for s in per_tree.values())
    shared = set().union(*per_tree.values())
    assert 4500 < len(shared) <= 30 * 256      # drawn from one sample of all rows
    assert abs(np.mean(list(shared)) - 50_000) < 2_000
    assert min(v for _, v in found) < 1000 and max(v for _, v in found) > 99_000
    small = anomaly._tree_samples(rows.limit(100), ("a",), 100, 5, 1, max_samples=40).groupBy("tree").count().collect()
    assert [r["count"] for r in small] == [40] * 5


def test_exact_quantiles(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=3000), np.repeat(0.25, 900), [1e9, -1e-9, 5.0]])
    rows = spark.createDataFrame([(float(v),) for v in values], "v double")
    for share in (0.0, 0.05, 0.1, 0.5, 0.617, 1.0):
        assert anomaly.quantile(rows, "v", share, len(values)) == pytest.approx(np.quantile(values, share), abs=1e-12)


def test_training_result(traffic):
    forest = anomaly.train(traffic, contamination=0.1, trees=10)
    assert forest.training_samples == 606
    flagged = forest.score(traffic).filter("is_anomaly").count()
    assert forest.anomalies_in_training == flagged <= 0.1 * 606


def test_rows_that_leave_the_scan_are_bounded(spark):
    """The shared sample has exactly its size, covers all rows evenly and does not follow partitions."""
    from pyspark.sql import functions as F
    rows = spark.range(300_000).select(F.struct(F.lit("p").alias("part"), F.col("id").alias("pos")).alias("seq"))
    pools = [sorted(r.seq.pos for r in anomaly._pool(rows.repartition(n), 300_000, 2000, 5).collect()) for n in (2, 9)]
    assert pools[0] == pools[1] and len(set(pools[0])) == 2000
    tenths = np.bincount(np.array(pools[0]) // 30_000, minlength=10)
    assert tenths.min() > 140 and tenths.max() < 270
    assert anomaly._pool(rows.limit(50), 50, 2000, 5).count() == 50


def test_walk_in_batches_equals_node_by_node():
    """Values on a threshold, beyond all of them and not a number; a tree that is a single leaf."""
    import pandas as pd
    rng = np.random.default_rng(4)
    samples = [np.round(rng.normal(size=(256, 3)), 1), np.zeros((5, 3))]
    grown = [anomaly._grow(7)(pd.DataFrame({"tree": t, "_rank": range(len(x)), "x": list(x)}))
             for t, x in enumerate(samples)]
    trees = [{c: g[c].to_numpy() for c in ("feature", "threshold", "left", "right", "size", "depth")} for g in grown]
    x = np.vstack([samples[0], rng.normal(size=(50, 3)) * 9, [[np.inf, -np.inf, np.nan]]])
    x[:len(trees[0]["threshold"]), 0] = trees[0]["threshold"][:len(x)]

    def length(tree, row):
        node = 0
        while tree["feature"][node] >= 0:
            low = row[tree["feature"][node]] <= tree["threshold"][node]
            node = tree["left" if low else "right"][node]
        return tree["depth"][node] + anomaly.average_path(tree["size"][node])
    expected = [length(trees[0], row) + length(trees[1], row) for row in x]
    assert anomaly._total_length(x, [anomaly._steps(t) for t in trees]).tolist() == expected


def test_distinct_rows_in_order():
    x = np.array([[2.0, np.nan], [1.0, 5.0], [2.0, np.nan], [0.0, 5.0], [-0.0, 5.0], [1.0, 5.0]])
    rows, back = anomaly._distinct(x)
    assert len(rows) == 3 and np.array_equal(rows[back], x, equal_nan=True)


def test_children_lie_side_by_side():
    """Leaves keep every row, -inf among them; the last rows of a batch walk as the others do."""
    tree = {"feature": np.array([0, -1, 1, -1, -1]), "threshold": np.array([0.5, 0.0, -1.0, 0.0, 0.0]),
            "left": np.array([1, -1, 3, -1, -1]), "right": np.array([2, -1, 4, -1, -1]),
            "size": np.array([4, 2, 2, 1, 1]), "depth": np.array([0, 1, 1, 2, 2])}
    _, threshold, onward, levels, length = anomaly._steps(tree)
    assert levels == 2 and onward[0] == 1 and np.isnan(threshold[onward == np.arange(5)]).all()
    x = np.array([[-np.inf, 0.0], [0.5, 9.0], [1.0, -1.0], [1.0, -0.5], [np.nan, np.nan]])
    assert anomaly._total_length(x, [anomaly._steps(tree)]).tolist() == [2.0, 2.0, 2.0, 2.0, 2.0]
    assert sorted(length.tolist()) == sorted((tree["depth"] + np.array([anomaly.average_path(n) for n in tree["size"]])).tolist())


def test_scaler_is_exact_for_wide_numbers(spark):
    """Numbers of 2^31 and more and small ones, of either sign, and nulls; narrow features take no decimals."""
    from fractions import Fraction
    wide = [0, 1, 2**31 - 1, 2**31, 2**31 + 1, 987_654_321_987, 10**17, None]
    narrow = [0, 5, -7, 2**31 - 1, -2**31, 3, 2**31 - 2, None]
    rows = spark.createDataFrame([(None if a is None else float(a), None if b is None else float(b))
                                  for a, b in zip(wide, narrow)], "f_bytes double, f_hour double")
    scaler = anomaly.fit_scaler(rows, ("bytes", "hour"))
    for values, mean, std in zip((wide, narrow), scaler.means, scaler.stds):
        total, squares = sum(v or 0 for v in values), sum((v or 0) ** 2 for v in values)
        assert mean == float(Fraction(total, 8))
        assert std == float(Fraction(8 * squares - total * total, 64)) ** 0.5
    seen = []
    class Spy:
        def agg(self, *columns):
            seen.extend(str(c).lower() for c in columns)
            return rows.agg(*columns)
    anomaly.fit_scaler(Spy(), ("bytes", "hour"))
    assert sum("decimal" in c for c in seen) == 2
    empty = anomaly.fit_scaler(rows.limit(0), ("bytes", "hour"))
    assert (empty.rows, empty.means, empty.stds) == (0, [0.0, 0.0], [1.0, 1.0])
