import random

import numpy as np

from cairnflow.llm import toxicity


def brute_segments(x):
    """Maximal scoring segments by their definition: recursive splitting at the best segment, ties to the shortest."""
    best, n = None, len(x)
    for i in range(n):
        total = 0.0
        for j in range(i, n):
            total += x[j]
            if total > 1e-12 and (best is None or total > best[2] + 1e-12):
                best = (i, j + 1, total)
    if best is None:
        return []
    i, j, _ = best
    return brute_segments(x[:i]) + [best] + [(a + j, b + j, s) for a, b, s in brute_segments(x[j:])]


def test_segments_equal_definition():
    rng = random.Random(2)
    for _ in range(300):
        x = [rng.choice([-3, -2, -1, 1, 2, 3]) + rng.random() / 8 for _ in range(rng.randrange(0, 25))]
        got, want = toxicity.segments(x), brute_segments(x)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def corpus():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(500)]
    docs, labels = [], []
    for i in range(1200):
        text = [rng.choice(words) for _ in range(rng.randrange(1, 120))]
        bad = rng.random() < 0.2
        if bad:
            at = rng.randrange(len(text))
            text[at:at] = [rng.choice(["zounds", "zilch", "zap"]) + rng.choice(["", "per", "ping"]) for _ in range(3)]
        docs.append((i, " ".join(text), "x"))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_held_out_accuracy_and_edges(spark):
    docs, labels = corpus()
    extra = [(5000, None, "x"), (5001, "", "x"), (None, "zap zilch", "x"), (5003, "clean " * 50000 + "zap zounds zilch zapping", "x"), docs[0], docs[0]]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string, toxic string")
    bad_labels = [(None, 1, 1), (3, None, None), (4, 0, 7)]
    lab = spark.createDataFrame(labels + bad_labels, "doc_id long, quality int, toxic int")
    rows = toxicity.score_documents(d, lab).collect()
    assert len(rows) == len(docs) + len(extra)
    truth = {i: t for i, _, t in labels}
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 150 and sum(a == b for a, b in held) / len(held) > 0.95
    by = {r["doc_id"]: r for r in rows}
    assert by[5000]["predicted"] == by[5001]["predicted"] == 0
    assert all(0 <= r["score"] <= 1 for r in rows)
    again = toxicity.score_documents(d, lab).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    passages = {r["doc_id"]: r["passages"] for r in toxicity.score(d, toxicity.train(d, lab)).collect()}
    assert [(p["first"], p["words"]) for p in passages[5003]] == [(50000, 4)]


def test_without_labels(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in toxicity.score_documents(d, none).collect()] == [0.0]
    assert toxicity.score_documents(d.limit(0), none).count() == 0
