import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnflow.operators import datasets, sampling, trajectories, trees

TRAJ = "problem_id long, traj_ord int, length int, visit_count int, max_q_value double, is_correct boolean"


def quota(k, h, s):
    """Quotas by their rules, step by step."""
    want = round(k * 0.7)
    hard, soft = min(want, h), min(k - want, s)
    return min(hard + (k - want - soft), h), min(soft + (want - hard), s)


@given(st.integers(0, 40), st.integers(0, 30), st.integers(0, 30))
@settings(max_examples=200, deadline=None)
def test_quota_fills_k(k, h, s):
    assert sum(quota(k, h, s)) == min(k, h + s)


def test_quotas(spark):
    cases = [(10, 20, 20), (10, 9, 0), (10, 2, 7), (10, 5, 4), (10, 20, 1), (10, 1, 20), (10, 0, 5), (10, 0, 0), (5, 20, 20), (15, 20, 20)]
    cases += [(k, h, s) for k in range(12) for h in range(0, 12, 3) for s in range(0, 12, 4)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, k int, h int, s int")
    got = df.orderBy("i").select(*sampling.quotas(F.col("h"), F.col("s"), F.col("k"))).collect()
    assert [tuple(r) for r in got] == [quota(*c) for c in cases]
    assert quota(5, 20, 20) == (4, 1) and quota(15, 20, 20) == (10, 5)


def some_trajectories(n, rng):
    return [(p, o, rng.randrange(1, 6), rng.randrange(0, 5), rng.choice([0.1, 0.5, 0.9]), rng.random() < 0.5) for p in range(n) for o in range(1, rng.randrange(2, 14))]


def test_strata_and_anchor(spark):
    rows = [(1, 1, 3, 1, 0.9, True), (1, 2, 2, 1, 0.5, True), (1, 3, 2, 1, 0.9, True), (1, 4, 2, 1, 0.9, True), (1, 5, 1, 1, 0.1, False), (2, 1, 1, 1, 0.1, False)]
    df = spark.createDataFrame(rows, TRAJ)
    got = {(r["problem_id"], r["traj_ord"]): r["stratum"] for r in trajectories.stratify(df).collect()}
    assert got == {(1, 1): "soft_negative", (1, 2): "gold_positive", (1, 3): "gold_positive", (1, 4): "gold_positive", (1, 5): "hard_negative", (2, 1): "hard_negative"}
    assert [tuple(r)[:2] for r in trajectories.anchors(df).collect()] == [(1, 3)]
    assert [r[0] for r in trajectories.without_gold(df).collect()] == [2]


def test_pairs(spark):
    rows = some_trajectories(60, random.Random(3))
    df = spark.createDataFrame(rows, TRAJ)
    for k in (1, 4, 10):
        pairs = sampling.contrastive_pairs(df, k)
        got = pairs.collect()
        by = Counter(r["problem_id"] for r in got)
        for p in range(60):
            mine = [r for r in rows if r[0] == p]
            correct = [r for r in mine if r[5]]
            if not correct:
                assert by[p] == 0
                continue
            least = min(r[2] for r in correct)
            negatives = [r for r in mine if not r[5] or r[2] > least]
            assert by[p] == min(k, len(negatives))
        assert all(r["positive"]["is_correct"] and (not r["negative"]["is_correct"] or r["negative"]["length"] > r["positive"]["length"]) for r in got)
        for p in by:
            assert sorted(r["pair_ord"] for r in got if r["problem_id"] == p) == list(range(1, by[p] + 1))
        again = sampling.contrastive_pairs(df.repartition(7), k).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_first_draw_follows_visits(spark):
    rows = [(p, o, 2, v, 0.5, False) for p in range(3000) for o, v in ((1, 1), (2, 3), (3, 0))] + [(p, 4, 1, 1, 0.5, True) for p in range(3000)]
    drawn = sampling.with_draw_order(trajectories.stratify(spark.createDataFrame(rows, TRAJ)).where("stratum = 'hard_negative'"))
    first = Counter(r["traj_ord"] for r in drawn.where("draw = 1").collect())
    assert abs(first[2] / 3000 - 0.75) < 0.03 and first[3] == 0
    assert {r["traj_ord"] for r in drawn.where("draw = 3").collect()} == {3}


def test_resample(spark):
    pool = spark.createDataFrame([(i,) for i in range(20)], "x int")
    under = [r["x"] for r in sampling.resample(pool, 12, F.col("x")).collect()]
    assert len(set(under)) == 12
    over = sampling.resample(pool, 50, F.col("x")).collect()
    assert sorted(r["draw"] for r in over) == list(range(1, 51)) and {r["x"] for r in over} <= set(range(20))
    assert sampling.resample(pool.limit(0), 5, F.col("x")).count() == 0


def test_rehydrate(spark):
    rec = spark.createDataFrame([("p", "1", "s", "hard", ["a"], ["b", "c"], "1"), ("p", "1", "s", "soft", ["a"], ["b"], None)], "problem string, ground_truth string, source string, contrast_type string, positive_steps array<string>, negative_steps array<string>, positive_answer string")
    hard, soft = sampling.rehydrate(rec).orderBy("contrast_type").collect()
    assert (hard["negative"]["is_correct"], hard["negative"]["reward"], hard["negative"]["length"]) == (False, 0.0, 2)
    assert (soft["negative"]["is_correct"], soft["negative"]["reward"], soft["positive"]["max_q_value"]) == (True, 1.0, 1.0)


def test_trees(spark):
    nodes = spark.createDataFrame(
        [(1, 0, None, None, None, False), (1, 1, 0, 0, "a", False), (1, 2, 0, 1, "b", True), (1, 3, 1, 0, "c", True), (1, 4, 1, 1, "a", True), (1, 5, 4, 0, "z", True), (2, 0, None, None, None, True)],
        "problem_id long, node_id int, parent_id int, child_ord int, action string, is_terminal boolean",
    ).withColumn("reward", F.lit(None).cast("double"))
    placed = trees.with_paths(nodes)
    assert {(r["problem_id"], r["node_id"]): r["path"] for r in placed.collect()}[(1, 5)] == [0, 1, 4, 5]
    rollouts = spark.createDataFrame([(1, 3, 1.0), (1, 3, 1.0), (1, 2, 0.0), (1, 4, 0.5)], "problem_id long, node_id int, reward double")
    stats = trees.backpropagate(placed, rollouts)
    got = {(r["problem_id"], r["node_id"]): (r["visit_count"], r["total_value"]) for r in stats.collect()}
    assert got[(1, 0)] == (4, 2.5) and got[(1, 1)] == (3, 2.5) and got[(1, 5)] == (0, 0.0) and got[(2, 0)] == (0, 0.0)
    best = {(r["problem_id"], r["node_id"]): r["best_child_id"] for r in trees.best_children(stats).collect()}
    assert best[(1, 0)] == 1 and best[(1, 4)] == 5
    assert {r["problem_id"]: (r["leaf_id"], r["steps"]) for r in trees.descend(stats).collect()} == {1: (3, 2), 2: (0, 0)}
    paths = {(r["problem_id"], r["node_id"]): r for r in trees.terminal_paths(stats).collect()}
    assert set(paths) == {(1, 3), (1, 4), (1, 2), (2, 0)}  # 5 lies below a terminal node
    assert paths[(1, 3)]["traj_ord"] == 1 and paths[(1, 3)]["steps"] == ["a", "c"] and paths[(1, 3)]["max_q_value"] == 1.0 and paths[(2, 0)]["length"] == 0
    looks = spark.createDataFrame([(1, ["a", "c"]), (1, ["a", "q"]), (1, ["q", "a"]), (2, ["a"]), (1, [])], "problem_id long, steps array<string>")
    assert sorted((r["problem_id"], r["steps"], r["visits"]) for r in trees.prefix_visits(stats, looks).collect()) == [(1, [], 4), (1, ["a", "c"], 2), (1, ["a", "q"], 3), (1, ["q", "a"], 4), (2, ["a"], 0)]


@pytest.mark.parametrize("n,visits,want", [(1, 0, float("inf")), (1, 1, 1.0), (4, 2, 1.665577)])
def test_uct(spark, n, visits, want):
    df = spark.createDataFrame([(n, visits, 1.0)], "p long, n long, w double")
    value = df.select(trees.uct(F.col("n"), F.col("w"), F.col("p"))).first()[0]
    assert value == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("n,shards,want", [(10, 4, [3, 3, 3, 1]), (5, 4, [2, 2, 1])])
def test_shards(spark, n, shards, want):
    rows = datasets.shard(spark.range(n).repartition(3), [F.col("id")], shards)
    counts = Counter(r["shard"] for r in rows.collect())
    assert [counts[i] for i in sorted(counts)] == want
    assert [r["id"] for r in rows.orderBy("ord").collect()] == list(range(n))


def test_shards_of_wide_rows_keep_all(spark):
    """With one row sampled a partition the range bounds are poor, and every placement has other ones."""
    spark.conf.set("spark.sql.execution.rangeExchange.sampleSizePerPartition", 1)
    try:
        rows = spark.range(20000).select((F.col("id") * 7919 % 20000).alias("id"), F.repeat(F.lit("wide "), 200).alias("text")).repartition(9)
        got = [tuple(r) for r in datasets.shard(rows, [F.col("id")], 7).select("id", "ord", "shard").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.rangeExchange.sampleSizePerPartition")
    assert sorted(got) == [(i, i, i // 2858) for i in range(20000)]


def test_no_rows_and_ties_are_numbered(spark):
    assert datasets.shard(spark.range(0), [F.col("id")], 3).count() == 0
    rows = spark.createDataFrame([(i % 3, None if i % 2 else "x") for i in range(50)], "k int, v string")
    assert sorted(r["ord"] for r in datasets.numbered(rows, [F.col("k")]).collect()) == list(range(50))


def test_progress(spark):
    row = datasets.progress(spark.createDataFrame([(10, 4), (10, 0)], "t int, d int"), F.col("t"), F.col("d"), F.lit(8)).orderBy("d").collect()
    assert (row[1]["seconds_each"], row[1]["per_hour"]) == (2.0, 1800.0) and row[0]["seconds_each"] is None and row[0]["eta_hours"] is None


def test_deep_and_gapped_trees(spark):
    """A chain of 100, ids with gaps, a parent that isn't there, and a cycle."""
    chain = [(1, i, i - 1 if i else None, 0, f"a{i}", i == 99) for i in range(100)]
    gapped = [(2, 10 * i, 10 * (i - 1) if i else None, 0, f"b{i}", i == 40) for i in range(41)] + [(3, 5, 4, 0, "lost", True)]
    kind = "problem_id long, node_id int, parent_id int, child_ord int, action string, is_terminal boolean"
    nodes = spark.createDataFrame(chain + gapped, kind).withColumn("reward", F.lit(None).cast("double"))
    placed = trees.with_paths(nodes)
    deepest = {r["problem_id"]: (r["depth"], r["path"]) for r in placed.where("is_terminal").collect()}
    assert deepest == {1: (99, list(range(100))), 2: (40, list(range(0, 410, 10))), 3: (0, [5])}
    stats = trees.backpropagate(placed, placed.where("is_terminal").select("problem_id", "node_id", F.lit(1.0).alias("reward")))
    assert {r["visit_count"] for r in stats.collect()} == {1}
    assert {r["problem_id"]: (r["leaf_id"], r["steps"]) for r in trees.descend(stats).collect()} == {1: (99, 99), 2: (400, 40)}
    got = {r["problem_id"]: r for r in trees.terminal_paths(stats).collect()}
    assert got[1]["steps"] == [f"a{i}" for i in range(1, 100)] and got[2]["length"] == 40
    looks = spark.createDataFrame([(1, [f"a{i}" for i in range(1, 100)]), (2, ["b1", "b2", "x"])], "problem_id long, steps array<string>")
    assert {r["visits"] for r in trees.prefix_visits(stats, looks).collect()} == {1}
    assert {r["n_children"] for r in trees.with_child_counts(stats).where("problem_id = 1 and node_id < 99").collect()} == {1}
    with pytest.raises(Exception, match="doesn't end"):
        trees.with_paths(spark.createDataFrame([(1, 1, 3, 0, "", False), (1, 2, 1, 0, "", False), (1, 3, 2, 0, "", False)], kind)).collect()
    assert trees.with_paths(nodes.limit(0)).count() == 0


def test_masks(spark):
    df = spark.createDataFrame([(3, [1, 2, 3, 4, 5])], "p int, full array<int>")
    ids, mask, labels = datasets.mask_labels(F.col("p"), F.col("full"), 9, 100)
    assert tuple(df.select(ids, mask, labels).first()) == ([1, 2, 3, 4, 5, 9], [1] * 6, [-100, -100, -100, 4, 5, 9])
    ids, mask, labels = datasets.mask_labels(F.col("p"), F.col("full"), 9, 4)
    assert tuple(df.select(ids, labels).first()) == ([1, 2, 3, 9], [-100, -100, -100, 9])
    rows = spark.createDataFrame([(1, [1], [1], [1]), (1, [1, 2], [1, 1], [-100, 2])], "b int, input_ids array<int>, attention_mask array<int>, labels array<int>")
    left = {len(r["labels"]): r for r in datasets.pad_batches(rows, "b", 0, "left").where("input_ids[1] = 1").collect()}
    assert left[2]["input_ids"] == [0, 1] and left[2]["labels"] == [-100, 1] and left[2]["attention_mask"] == [0, 1]


def test_resume_and_verification(spark):
    long = "x" * 90
    pairs = spark.createDataFrame([(long + "1", "hard"), (long + "2", "hard"), (long + "1", "soft"), ("y", None)], "problem string, contrast_type string")
    done = spark.createDataFrame([(long + "1", "hard")], "problem string, contrast_type string")
    assert {r["contrast_type"] for r in datasets.resume_pairs(pairs, done, lossy=True).collect()} == {"soft", None}
    assert datasets.resume_pairs(pairs, done).count() == 3
    assert datasets.resume_pairs(pairs, pairs).count() == 0
    paths = spark.createDataFrame([("a", "1/2"), ("b", None), ("c", "3")], "problem string, final_answer string")
    truths = spark.createDataFrame([("a", "0.5"), ("b", "1")], "problem string, ground_truth string")
    verified = datasets.verify_paths(paths, truths)
    assert {r["problem"]: r["status"] for r in verified.collect()} == {"a": "passed", "b": "failed", "c": "no_ground_truth"}
    assert datasets.verification_stats(verified.limit(0)).first()["pass_rate"] == 0.0
