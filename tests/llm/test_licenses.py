import random
import re

from cairnflow.llm import licenses


def brute(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_places_and_edges(spark):
    rng = random.Random(1)
    parts = ["Released under the MIT License.", "under the mit", "Apache License, Version 2.0", "CC BY-NC 4.0", "cc by nc cc by nc", "Übung", "под", "a", "K", "İI", "under\nTHE--mit, license", "x" * 3000]
    texts = [None, "", "cc", "cc by nc", "under the MIT License", "under the mit Key", "MİT"] + [" ".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(60)]
    texts += ["filler words " * 30000 + "cc by nc"]
    rows = [(i % 50, t, "z") for i, t in enumerate(texts)] + [(None, texts[-2], None), (3, texts[3], "z"), (3, texts[3], "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    got = licenses.scan(docs).collect()
    key = lambda r: (r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])
    assert sorted(map(key, got), key=repr) == sorted(((i, *brute(t)) for i, t, _ in rows), key=repr)
    for r in got:
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert licenses.scan(docs.limit(0)).count() == 0


def test_notices_with_edits(spark):
    gpl = licenses.NOTICES[0][0].split()
    mit = licenses.NOTICES[2][0].split()
    texts = [
        " ".join(gpl),
        " ".join(["pre"] * 9 + mit[:10] + ["extra"] + mit[10:] + ["post"]),  # a word put in: two diagonals, one notice
        " ".join(mit[:8]),  # a part only
        "all rights reserved",
        "all other rights are reserved by them",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert [got[i]["labels"] for i in range(5)] == ["gpl-3", "mit", "", "all-rights-reserved", ""]
    assert got[1]["spans"][0]["first"] == 9 and got[1]["spans"][0]["words"] == len(mit) + 1
    assert got[0]["score"] == 1.0 and 0 < got[2]["score"] < 0.8 and got[4]["score"] == 0
