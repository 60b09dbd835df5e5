from cairnflow.llm import mixing


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    return [r.asDict() for r in mixing.mix_plan(docs).collect()]


def test_targets_and_words(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), ["b", "a", None, "ä", "z"][min(i % 9, 4)], "x") for i in range(3000)]
    got = run(spark, rows)
    assert len(got) == len(rows)
    sizes = {}
    for r in got:
        s = sizes.setdefault(r["source"], {"size": r["source_size"], "target": r["target"], "taken": 0})
        s["taken"] += r["taken"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    total = sum(s["size"] for s in sizes.values())
    assert abs(sum(s["target"] for s in sizes.values()) - 1.5 * total) < 1e-6
    for s in sizes.values():
        assert s["target"] <= 2 * s["size"] and abs(s["taken"] - s["target"]) <= 7
    # free sources stand at one level
    weights = dict(zip(["a", "b", "z", "ä", None], [5, 2, 1, 5, 2]))
    levels = {round(s["target"] / weights[k], 6) for k, s in sizes.items() if s["target"] < 2 * s["size"]}
    assert len(levels) == 1
    assert got and sorted(map(repr, got)) == sorted(map(repr, run(spark, rows)))


def test_edges(spark):
    assert run(spark, []) == []
    got = run(spark, [(1, None, "a", "x"), (2, "", "a", "x"), (None, " \t\n", None, None)])
    assert [(r["size"], r["taken"], r["target"]) for r in got] == [(0, 0, 0.0)] * 3
    got = run(spark, [(1, "x y", "a", "x")] * 4 + [(2, "x", "a", "x")])
    assert {r["source_size"] for r in got} == {9}
    assert sum(r["taken"] for r in got) in (9 + 8, 9 + 1, 9)
    long = run(spark, [(1, "x " * 200000, "a", "x"), (2, "y", "b", "x")])
    assert max(r["size"] for r in long) == 200000


def test_rows_without_ids_are_told_apart_by_text(spark):
    rows = [(None if i % 2 else 5, f"word{i} x y", "b", "x") for i in range(600)] + [(i, "w w w w w", "a", "x") for i in range(300)]
    got = [r for r in run(spark, rows) if r["source"] == "b"]
    taken = {r["copies"] for r in got}
    assert len(taken) == 2 and abs(sum(r["taken"] for r in got) - got[0]["target"]) <= 2


def test_mix_takes_no_empty_documents(spark):
    rows = [(i, [None, "", " \t", "one two"][i % 4], "s", "x") for i in range(40)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, h string")).collect()
    assert mixed and {r["text"] for r in mixed} == {"one two"} and {r["h"] for r in mixed} == {"x"}
