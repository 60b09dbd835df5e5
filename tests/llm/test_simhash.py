import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from cairnflow.llm import simhash
from cairnflow.llm.components import connected_components


def brute(text, k=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, bits=3):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(ids))]


def test_fingerprint():
    for text in [None, "", " \n ", "One", "one TWO", "a b c", "É a b c d e", "x " * 70000, "a\x1cb c d e f g"]:
        assert simhash.fingerprint(text) == brute(text), text and text[:20]


def test_trie_pairs_equal_brute_force():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = base[rng.integers(0, 40, 600)] ^ np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in range(600)], dtype=np.uint64)
    values = np.unique(np.r_[flips, np.uint64(0), np.uint64(2**64 - 1)])
    groups = np.zeros(len(values), np.int64)
    i, j = simhash.trie_pairs(values, groups, 3)
    got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
    assert len(got) == len(i)
    want = {(a, b) for a in range(len(values)) for b in range(a + 1, len(values)) if (int(values[a]) ^ int(values[b])).bit_count() <= 3}
    assert got == want


def test_components_of_documents(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for _ in range(25):
        text = [rng.choice(words) for _ in range(rng.randrange(1, 400))]
        for _ in range(rng.randrange(1, 6)):
            copy = list(text)
            if rng.random() < 0.7:
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((n * 7 % 101, " ".join(copy), "s"))
            n += 1
    rows += [(500, None, "s"), (501, "", None), (502, " \t", "s"), (None, rows[0][1], "s"), (rows[3][0], rows[3][1], "s"), rows[5], (600, "Solo words here", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    for chunk in (4096, 2):  # the second deals every group as pairs of chunks
        got = sorted((tuple(r) for r in simhash.near_components(docs, chunk=chunk).collect()), key=repr)
        fps = [brute(r[1]) for r in rows]
        want = sorted(((r[0], f - (f >> 63 << 64), c) for r, f, c in zip(rows, fps, brute_components([r[0] for r in rows], fps))), key=repr)
        assert got == want
    assert simhash.near_components(docs.limit(0)).count() == 0


def test_long_chain_is_one_component(spark):
    edges = spark.range(1, 300).select((F.col("id") * 37 % 300).alias("u"), ((F.col("id") + 1) * 37 % 300).alias("v"))
    got = connected_components(edges)
    assert got.select("root").distinct().collect() == [(0,)]
    assert got.count() == 299


def test_accepted_pairs_only():
    values = np.array([0, 1, 2, 3, 7], dtype=np.uint64)
    i, j = simhash.trie_pairs(values, np.zeros(5, np.int64), 3, accept=lambda a, b: (values[a] + values[b]) % np.uint64(2) == 1)
    got = {tuple(sorted((int(values[a]), int(values[b])))) for a, b in zip(i, j)}
    assert got == {(0, 1), (0, 3), (0, 7), (1, 2), (2, 3), (2, 7)}
    i, j = simhash.trie_pairs(values, np.zeros(5, np.int64), 0, counted=~0b11 & (1 << 64) - 1)  # low bits count for nothing
    assert len(i) == 6


def test_longer_keys_find_the_same(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(-(2**63), 2**63 - 1, 60)
    flips = np.array([np.bitwise_xor.reduce(np.int64(1) << rng.choice(63, rng.integers(0, 5), replace=False)) if k % 7 else 0 for k in range(900)])
    fps = spark.createDataFrame([(int(x),) for x in np.unique(base[rng.integers(0, 60, 900)] ^ flips)], "fp long")
    found = [sorted(map(tuple, connected_components(simhash.near_edges(fps, blocks=b)).collect())) for b in (4, 5, 6)]
    assert found[0] == found[1] == found[2] and found[0]
    assert [simhash.blocks_for(n, 3) for n in (0, 10**6, 10**9, 10**12)] == [4, 4, 5, 6]


def test_keys_grow_slower_than_fingerprints():
    tables = [simhash.tables_for(b) for b in (12, 16, 20)]
    assert tables == sorted(tables) and tables[2] / tables[0] < 2**8 / 16


def test_equal_values_are_paired():
    values = np.array([5, 5, 5, 9], dtype=np.uint64)
    i, j = simhash.trie_pairs(values, np.zeros(4, np.int64), 1)
    assert {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())} == {(0, 1), (0, 2), (1, 2)} and len(i) == 3


def test_shingle_sets_tell_shingles_apart():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    for n in (0, 1, 4, 5, 6, 300):
        text = [rng.choice(words) for _ in range(n)]
        want = len({tuple(text[i : i + 5]) for i in range(max(n - 4, 1))}) if n else 0
        assert len(simhash.shingle_set(" ".join(text))) == want
    assert not set(simhash.shingle_set("a b c d e f").tolist()) & set(simhash.shingle_set("b a c d e f").tolist()) - set(simhash.shingle_set("c d e f").tolist())
    assert len(simhash.wide_fingerprint(simhash.shingle_set("x y " * 20000))) == 32


def test_labels_leave_out_what_is_joined():
    rng = np.random.default_rng(9)
    values = np.sort(rng.integers(0, 1 << 12, 300).astype(np.uint64))
    label = rng.integers(0, 3, 300)
    i, j = simhash.trie_pairs(values, np.zeros(300, np.int64), 2, label=label)
    got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
    assert got == {(a, b) for a in range(300) for b in range(a + 1, 300) if label[a] != label[b] and (int(values[a]) ^ int(values[b])).bit_count() <= 2} and len(got) == len(i)


def test_large_groups_of_copies_stay_linear():
    import time

    rng = np.random.default_rng(10)
    base = np.uint64(0x123456789ABCDEF0)
    flips = np.uint64(1) << rng.integers(0, 64, 40000).astype(np.uint64) | np.uint64(1) << rng.integers(0, 64, 40000).astype(np.uint64)
    fp = np.unique(np.r_[base, base ^ flips])
    at = time.time()
    u, v = simhash._spanning_edges(fp.view(np.int64), fp, np.zeros(len(fp), np.int64), 3, (1 << 64) - 1, lambda i, j: np.bitwise_count(fp[i] ^ fp[j]) <= 3)
    assert len(set(u.tolist())) == len(fp) - 1 and time.time() - at < 20


def test_similar_edges_span_the_links():
    """Parts as dealt and all as one, against trying every pair by similar()."""
    rng = np.random.default_rng(12)
    base = rng.integers(0, 2**63, 120).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(120) < rate, rng.integers(0, 2**63, 120).astype(np.uint64), base)) for rate in rng.choice([0.02, 0.08, 0.2], 90)]
    sets += [sets[0][:100], np.zeros(0, np.uint64)]
    n = len(sets)
    node, label = np.arange(n), np.where(np.arange(n) % 9 == 0, 0, np.arange(n))
    wide = np.stack([np.frombuffer(simhash.wide_fingerprint(s), np.uint64) for s in sets])
    for part in (np.zeros(n, np.int64), np.arange(n) % 2 + 1, np.arange(n) % 3):
        u, v = simhash.similar_edges(node, wide, sets, label, part)
        assert len(u) < n  # a spanning forest, not the pairs
        meet = [(i, j) for i in range(n) for j in range(n) if i != j and (part[i] == part[j] == 0 or (part[i], part[j]) == (1, 2))]
        near = [(i, j) for i, j in meet if simhash.similar(sets[i], sets[j])]
        assert len(near) > 2 * n if not part.any() else near
        joined = np.flatnonzero(label == 0)
        star = (joined[1:], np.zeros(len(joined) - 1, np.int64))
        a, b = (np.array(x) for x in zip(*near))
        want = simhash.spanning(n, np.r_[a, star[0]], np.r_[b, star[1]])
        got = simhash.spanning(n, np.r_[u, star[0]], np.r_[v, star[1]])
        assert (want == got).all()


def near_copies(rng, n, words, changed):
    """n texts, each one of a few versions of a text with words replaced: many candidates, few of which are similar."""
    base = [f"{rng.randrange(1 << 40):x}" for _ in range(words)]
    rows = []
    for k in range(n):
        spots = rng.sample(range(words), rng.choice(changed))
        rows.append((k, " ".join(f"{k}x{i}" if i in spots else w for i, w in enumerate(base))))
    return rows


def test_rows_of_a_large_group_of_candidates_stay_linear(spark, monkeypatch):
    rng = random.Random(31)
    rows = near_copies(rng, 300, 200, (2, 5, 8, 9))
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    sets = [simhash.shingle_set(t) for _, t in rows]
    near = [(i, j) for i in range(300) for j in range(i) if simhash.similar(sets[i], sets[j])]
    root = simhash.spanning(300, *(np.array(x) for x in zip(*near)))
    want = sorted(set(root.tolist()))
    assert 20 < len(want) < 280
    sent, dealt = [], simhash._dealt_edges

    def counted(rows, tasks):
        found = simhash.cut(dealt(rows, tasks))
        sent.append((rows.count(), found.count()))
        return found

    monkeypatch.setattr(simhash, "_dealt_edges", counted)
    whole = simhash.keep_one(docs)
    assert sorted(r["doc_id"] for r in whole.collect()) == want
    monkeypatch.setattr(simhash, "SET_ROWS", 70)  # the component is dealt in chunks
    slim = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    wide = simhash.cut(simhash.wide_fingerprints(slim))
    for chunk in (70, 7):
        found = {r["node"]: r["root"] for r in simhash.similar_components(slim, wide, chunk=chunk).collect()}
        ids = {r["doc_id"]: found.get(r["fp"], r["fp"]) for r in wide.collect()}
        assert sorted(min(k for k, v in ids.items() if v == g) for g in set(ids.values())) == want
    (dealt_once, edges), (in_chunks, more), _ = sent
    assert dealt_once == 300 and edges < 300 and in_chunks <= 300 * 6 and more < 300 * 6
