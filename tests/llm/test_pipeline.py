import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("tiktoken")

import corpus_pipeline  # noqa: E402
from cairnflow.llm import mixing, pii, simhash, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def jaccard(a, b, k=5):
    x, y = (set(zip(*[w[i:] for i in range(k)])) for w in (a, b))
    return len(x & y) / max(len(x | y), 1)


def corpus():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(3000)]
    rows, groups, n = [], [], 0
    for g in range(60):
        text = [rng.choice(words) for _ in range(rng.randrange(150, 500))]
        ids = []
        for c in range(rng.randrange(1, 5)):
            copy = list(text)
            for _ in range(c * len(copy) // 200):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            ids.append(n)
            rows.append((n, " ".join(copy), "en", f"s{g % 4}", 0))
            n += 1
        groups.append(ids)
    return rows, groups


def test_near_copies_keep_one(spark):
    rows, groups = corpus()
    extra = [(900, None, "x", "x", 0), (901, "", "x", "x", 0), (None, "only words of mine", "x", "x", 0), rows[0], rows[0], (902, "word " * 30000, "x", None, 0)]
    docs = spark.createDataFrame(rows + extra, SCHEMA)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is None, x))
    assert got == sorted(g[0] for g in groups) + [900, 902, None]
    texts = {r[0]: r[1].split() for r in rows}
    assert min(jaccard(texts[g[0]], texts[g[1]]) for g in groups if len(g) > 1) > 0.8
    assert sorted((r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect())) == sorted(g[0] for g in groups)
    assert simhash.keep_one(docs.limit(0)).count() == 0


def pair_of(rng, n, other):
    """Two texts of n words, of which the second has every word in other replaced."""
    text = [f"{rng.randrange(1 << 40):x}" for _ in range(n)]
    return text, [f"{rng.randrange(1 << 40):x}" if i in other else w for i, w in enumerate(text)]


def test_pairs_below_the_similarity_stay(spark):
    rng = random.Random(21)
    pairs = [pair_of(rng, 204, {20 * (i + 1) for i in range(5)}) for _ in range(30)]  # 175 of 225 shingles
    assert {round(jaccard(a, b), 3) for a, b in pairs} == {0.778}
    rows = [(2 * k + x, " ".join(t), "en", "s", 0) for k, p in enumerate(pairs) for x, t in enumerate(p)]
    # a chain: neighbours are similar by 0.818 and linked, so one of it stays
    chain = [f"{rng.randrange(1 << 40):x}" for _ in range(350)]
    for k in range(12):
        rows.append((100 + k, " ".join(chain[15 * k : 15 * k + 154]), "en", "s", 0))
    # copies of one text, and candidates of theirs that are less similar
    hub = [f"{rng.randrange(1 << 40):x}" for _ in range(204)]
    for k in range(40):
        spots = rng.sample(range(10, 190, 5), 1 if k < 20 else 6)
        rows.append((200 + k, " ".join(f"{k}x{i}" if i in spots else w for i, w in enumerate(hub)), "en", "s", 0))
    got = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got >= set(range(60))
    root, words = {r[0]: r[0] for r in rows}, {r[0]: r[1].split() for r in rows}
    for i in root:
        for j in root:
            if j < i and jaccard(words[i], words[j]) >= 0.8:
                a, b = root[i], root[j]
                root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    want = {k for k, v in root.items() if k == v}
    assert want & set(range(100, 200)) == {100}
    assert {k for k in got if k < 100 or k >= 200} == {k for k in want if k < 100 or k >= 200}
    assert 100 in got and len(want & set(range(200, 240))) > 1


def test_pairs_at_the_similarity_are_found(spark):
    rng = random.Random(22)
    pairs = [pair_of(rng, 184, {10 * (i + 1) for i in range(4)}) for _ in range(400)]  # 160 of 200 shingles
    assert {jaccard(a, b) for a, b in pairs} == {0.8}
    rows = [(2 * k + x, " ".join(t), "en", "s", 0) for k, p in enumerate(pairs) for x, t in enumerate(p)]
    got = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got >= set(range(0, 800, 2)) and len(got) <= 404


def test_wide_edges_in_chunks(spark, monkeypatch):
    """Groups that are dealt again as pairs of chunks, and blocks that end within groups, give the same components."""
    rows, _ = corpus()
    fps = simhash.wide_fingerprints(spark.createDataFrame(rows, SCHEMA)).select("fp", "wide").dropDuplicates(["fp"])
    found = []
    for chunk, block in ((4096, 1 << 16), (3, 1 << 16), (3, 10), (40, 30)):
        monkeypatch.setattr(simhash, "BLOCK_ROWS", block)
        from cairnflow.llm.components import connected_components

        found.append(sorted(tuple(r) for r in connected_components(simhash.wide_edges(fps, chunk=chunk)).collect()))
    assert found[0] and all(f == found[0] for f in found)


def test_mix_repeats_rows(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 5), "en", f"s{i % 3}", i) for i in range(300)], SCHEMA)
    # names that operators use
    for name in ("size", "h", "rounds", "h_end", "at_end", "copies", "hash", "fp", "row", "spans", "_hash", "_id", "_of", "_own", "_mix_copies", "_mix_copy", "_mix_source", "_more", "a.b", "x y"):
        docs = docs.withColumn(name, F.lit("x"))
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(docs).collect()}
    mixed = mixing.mix(docs)
    clean = toxicity.keep_clean(docs, toxicity.Model({}, -1.0))
    for out in (mixed, simhash.keep_one(docs), pii.redact(docs), clean):
        assert out.columns == docs.columns
        assert all(r[c] == "x" for r in out.collect() for c in docs.columns[5:])
    times = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert times == {i: n for i, n in plan.items() if n}


def test_stages_in_order(spark, tmp_path):
    rows, groups = corpus()
    rng = random.Random(5)
    bad = [(1000 + i, " ".join(["plain"] * rng.randrange(5) + [rng.choice(["zounds", "zilch"])] * 4 + [str(rng.choice("abc"))] * 9), "en", "s1", 0) for i in range(60)]
    rows = [(i, t + f" mail me: u{i}@mail.example.com", *r) for i, t, *r in rows] + bad
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(r[0] >= 1000)) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    clean = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in clean.collect()} == {r[0] for r in rows if r[0] < 1000}
    masked = corpus_pipeline.redact_personal_data(spark, clean, str(tmp_path))
    assert masked.where(F.col("text").contains("@")).count() == 0 and masked.where(F.col("text").contains("[EMAIL]")).count() == clean.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "pii", "mixing", "bpe"]
    final = corpus_pipeline.run(spark, str(tmp_path))
    got = final.collect()
    assert all(r["exact"] and r["n_tokens"] == len(r["ids"]) for r in got)
    assert {r["doc_id"] for r in got} <= {g[0] for g in groups}
    assert pii and toxicity


def plain_mix(rows):
    """rows (doc_id, text, source) as often as the mix takes them, step by step."""
    from hashlib import md5

    hashed = lambda r: int(md5(f"{r[0]}:{md5(r[1].encode()).hexdigest()}".encode()).hexdigest()[:12], 16)
    size = {s: sum(len(t.split()) for _, t, o in rows if o == s) for s in {r[2] for r in rows}}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(size))}
    target, free, budget = {}, set(size), 1.5 * sum(size.values())
    while free:
        level = (budget - sum(target.values())) / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * size[s]}
        target |= {s: 2.0 * size[s] for s in full} if full else {s: level * weight[s] for s in free}
        free = free - full if full else set()
    out = []
    for s in size:
        rounds = int(target[s] // size[s])
        left, upto = target[s] - rounds * size[s], 0
        for r in sorted((r for r in rows if r[2] == s), key=hashed):
            n = len(r[1].split())
            more = upto + n <= left or upto <= left and upto + n - left < left - upto
            out += [r] * (rounds + more)
            upto += n
    return out


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    """Toxic rows are those planted; every other stage is done again by definition."""
    import re

    import public_tokenizers
    import tiktoken
    from base64 import b64decode

    rows, _ = corpus()
    rng = random.Random(6)
    bad = [(1000 + i, " ".join(["plain"] * rng.randrange(5) + [rng.choice(["zounds", "zilch"])] * 4 + [rng.choice("abc")] * 9), "en", "s1", 0) for i in range(60)]
    rows = [(i, f"{t} write to u{i}@mail.example.com or +1 (555) 010-{1000 + i}", *r) for i, t, *r in rows]
    spark.createDataFrame(rows + bad, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(r[0] >= 1000)) for r in rows + bad], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    words, root = [r[1].lower().split() for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and jaccard(words[i], words[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    kept = [r for k, r in enumerate(rows) if root[k] == k]  # ids rise with places
    masked = [(r[0], re.sub(r"\+[0-9][ ().0-9-]+[0-9]", "[PHONE]", re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]", r[1])), r[3]) for r in kept]
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert len(kept) < len(rows)
    assert got == sorted((i, tuple(encoding.encode_ordinary(t))) for i, t, _ in plain_mix(masked))


def test_stages_take_odd_rows(spark, tmp_path):
    rows = [(1, None, "en", "a", 0), (2, "", None, "a", None), (None, "some words here", "en", None, 3), (None, "some words here", "en", None, 3), (5, "x " * 60000, "en", "b", 1), (6, "same text of words", "de", "b", 2), (6, "same text of words", "de", "b", 2)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("hash", F.lit(1)).withColumn("size", F.lit("s"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    counts, at = [], docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
        counts.append(at.count())
    assert counts[:3] == [7, 4, 4]
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert final.where("exact").count() == final.count() == counts[3]
    none = tmp_path / "none"
    docs.limit(0).write.parquet(f"{none}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{none}/labels.parquet")
    assert corpus_pipeline.run(spark, str(none)).count() == 0
