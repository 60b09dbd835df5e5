"""Toxicity by maximum-scoring segments of token log-odds.

Training. From a bounded sample of labelled documents (max_train ids, of least hash; the held-out fold never takes
part) tokens and their prefixes are counted by class in Spark. Features that occur in at least min_docs toxic documents
are kept if their log-odds under an informative Dirichlet prior (each feature's prior mass is a flat part and one that
follows its share of all tokens) are at least ODDS_MIN and lie z_min standard errors above zero. A token scores as its longest kept feature, any other token a small loss,
so that the expected score of clean text is negative.

Scoring. One linear pass (Ruzzo and Tompa) finds all maximal segments of a whole text. Segment scores have extreme-value
tails: for a text of n words, exp(-score) n is the expected number of as good segments by chance, with scale and location
fitted to clean training texts. Segments below p_max are the significant passages. A logistic fit on training rows turns
the best segment's surprise and the surprise of all significant ones into a probability.

Defined cases: a very long text takes time and memory in proportion to its tokens; null and empty texts have no segments and get the probability that goes with none; labels other than 0
and 1, or of null ids, are ignored; ids with several labels count as toxic if any is 1; if a class has no training rows,
nothing is known to tell them apart and every score is 0; repeated rows get repeated results; no rows
give no rows; other columns, of any name, are ignored by score() and kept by keep_clean().
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bound_batches, cut, join_checked

FOLDS, MAX_TRAIN, P_MAX = 5, 10_000, 0.01
#: A feature's least number and share of toxic training documents, standard errors above zero, and log-odds.
MIN_DOCS, MIN_SHARE, Z_MIN, ODDS_MIN = 3, 0.01, 3.0, 1.5
#: Words of prior text: their share by feature, and a flat part for each.
PRIOR, FLAT = 200.0, 0.5
PREFIXES = range(4, 9)
TOKEN = re.compile(r"[^\W\d_]+")


def fold(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def features(token: str) -> list[str]:
    """The whole token and its prefixes (marked by a star), longest first."""
    return [token, *(token[:k] + "*" for k in reversed(PREFIXES) if k <= len(token))]


class Scores(dict):
    """Token to score; unseen tokens are resolved by their longest kept feature."""

    LIMIT = 1 << 17

    def __init__(self, kept: dict[str, float], other: float):
        super().__init__()
        self.kept, self.other = kept, other

    def __missing__(self, token: str) -> float:
        score = next((self.kept[f] for f in features(token) if f in self.kept), self.other)
        if len(self) >= self.LIMIT:
            self.clear()
        self[token] = score
        return score


def segments(scores) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence of numbers, in linear time."""
    import numpy as np

    x = np.asarray(scores, dtype=np.float64)
    places = np.flatnonzero(x > 0)
    if not len(places):
        return []
    total = np.concatenate([[0.0], np.cumsum(x)])
    out: list[list] = []  # start, end, sum before, sum through its end, index of the last earlier one with a smaller sum before
    for p in places.tolist():
        new = [p, p + 1, total[p], total[p + 1], -1]
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= new[2]:
                j = out[j][4]
            new[4] = j
            if j < 0 or out[j][3] >= new[3]:
                out.append(new)
                break
            new = [out[j][0], new[1], out[j][2], new[3], -1]  # joins everything from j on
            del out[j:]
    return [(s, e, float(b - a)) for s, e, a, b, _ in out]


class Model:
    """Kept features, loss of other tokens, extreme-value location and scale, logistic weights."""

    def __init__(self, kept: dict[str, float], other: float):
        self.kept, self.other = kept, other
        self.place, self.scale, self.weights = 0.0, 1.0, None

    @classmethod
    def of(cls, state: dict) -> Model:
        """From vars() of another: broadcasts hold plain values, as executors need no copy of this package."""
        model = cls({}, 0.0)
        vars(model).update(state)
        return model

    def reader(self):
        scores = Scores(self.kept, self.other)

        def read(text: str | None):
            tokens = TOKEN.findall((text or "").lower())
            return len(tokens), segments(list(map(scores.__getitem__, tokens)))

        return read

    def surprise(self, score: float, n: int) -> float:
        """-ln of the expected number of as good segments in n words of clean text."""
        return (score - self.place) / self.scale - math.log(max(n, 1))

    def chance(self, score: float, n: int) -> float:
        return -math.expm1(-math.exp(-max(min(self.surprise(score, n), 700.0), -700.0)))

    def inputs(self, n: int, found: list) -> list[float]:
        best = max((self.surprise(s, n) for _, _, s in found), default=-math.log(max(n, 1)) - self.place / self.scale)
        strong = sum(x for _, _, s in found if (x := self.surprise(s, n)) > -math.log(P_MAX))
        return [1.0, max(min(best, 60.0), -20.0), math.log1p(strong), float(bool(found))]

    def probability(self, n: int, found: list) -> float:
        if self.weights is None:
            return 0.0
        z = sum(a * b for a, b in zip(self.weights, self.inputs(n, found), strict=True))
        return 1 / (1 + math.exp(-max(min(z, 500.0), -500.0)))


def _logistic(x, y, ridge: float = 1.0):
    import numpy as np

    x, y = np.asarray(x), np.asarray(y, dtype=float)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)) * 0.01, x.T @ (p - y) + ridge * 0.01 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def _odds(toxic: dict[str, tuple[int, int]], clean: dict[str, int], docs1: int, n1: int, n0: int, min_docs: int, z_min: float) -> tuple[dict[str, float], float]:
    """Kept features and the loss of other tokens, from (uses, documents) of features in toxic texts, uses in clean ones, and words of both."""
    least, kept = max(min_docs, MIN_SHARE * docs1), {}
    for f, (a, docs) in toxic.items():
        if docs < least:
            continue
        b = clean.get(f, 0)
        mass = FLAT + PRIOR * (a + b) / (n1 + n0)
        delta = math.log((a + mass) / (n1 + PRIOR)) - math.log((b + mass) / (n0 + PRIOR))
        if delta >= max(ODDS_MIN, z_min * math.sqrt(1 / (a + mass) + 1 / (b + mass))):
            kept[f] = delta
    share = sum(toxic[f][0] for f in kept if not f.endswith("*")) / max(n1, 1)
    return kept, min(-0.01, math.log1p(-min(share, 0.5)))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, min_docs: int = MIN_DOCS, z_min: float = Z_MIN) -> Model:
    """The model of the max_train labelled documents (all, if fewer) of least hash. Features come from all of them; location,
    scale and weights are fitted to scores of each half by the features of the other, so no row is judged by its own words."""
    bound_batches(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = cut(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train))
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int")
    texts = cut(join_checked(docs.select("doc_id", "text"), sample, "doc_id").select("text", "toxic", half.alias("half")))

    def count(only: frozenset | None, toxic: int):
        def run(batches: Iterator) -> Iterator:
            from collections import Counter

            import pyarrow as pa

            uses, docs_with = Counter(), Counter()

            def table():
                names, halves = zip(*uses, strict=True)
                return pa.RecordBatch.from_arrays([pa.array(names), pa.array(halves, pa.int32()), pa.array(list(uses.values()), pa.int64()), pa.array([docs_with[k] for k in uses], pa.int64())], ["feature", "half", "uses", "docs"])

            for batch in batches:
                for text, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    found = Counter((f, h) for token, n in Counter(TOKEN.findall((text or "").lower())).items() for f in features(token) * n if only is None or f in only)
                    uses.update(found)
                    docs_with.update(found.keys())
                    if only is None and len(uses) > 1 << 20:
                        yield table()
                        uses.clear()
                        docs_with.clear()
            if uses:
                yield table()

        part = texts.where(F.col("toxic") == toxic).select("text", "half").mapInArrow(run, "feature string, half int, uses long, docs long")
        return part.groupBy("feature").agg(*[F.sum(F.when(F.col("half") == h, F.col(c))).alias(f"{c}{h}") for c in ("uses", "docs") for h in (0, 1)])

    def words(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            n = [len(TOKEN.findall((t or "").lower())) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(n, pa.int64())], ["toxic", "half", "n"])

    sums = texts.select("text", "toxic", "half").mapInArrow(words, "toxic int, half int, n long").groupBy("toxic", "half").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"))
    totals = {(r["toxic"], r["half"]): (r["docs"], r["n"]) for r in sums.collect()}
    model = Model({}, -1e-3)
    if len({toxic for toxic, _ in totals}) < 2:
        return model
    total = lambda toxic, halves, k: sum(totals.get((toxic, h), (0, 0))[k] for h in halves)
    # both tables are bounded by the sample: features of at most max_train texts
    y1 = {r["feature"]: r for r in count(None, 1).where(F.coalesce("docs0", F.lit(0)) + F.coalesce("docs1", F.lit(0)) >= min_docs).collect()}
    y0 = {r["feature"]: r for r in count(frozenset(y1), 0).collect()}

    def learned(*halves: int) -> tuple[dict[str, float], float]:
        add = lambda r, c: sum(r[f"{c}{h}"] or 0 for h in halves)
        toxic, clean = {f: (add(r, "uses"), add(r, "docs")) for f, r in y1.items()}, {f: add(r, "uses") for f, r in y0.items()}
        return _odds(toxic, clean, total(1, halves, 0), total(1, halves, 1), total(0, halves, 1), min_docs, z_min)

    model.kept, model.other = learned(0, 1)
    shared = texts.sparkSession.sparkContext.broadcast([learned(1), learned(0)])  # for rows of half 0, of half 1

    def measure(batches: Iterator) -> Iterator:
        import pyarrow as pa

        read = [Model(*x).reader() for x in shared.value]
        for batch in batches:
            got = [read[h](t) for t, h in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([n for n, _ in got], pa.int64()), pa.array([[s for _, _, s in x] for _, x in got], pa.list_(pa.float64()))], ["toxic", "n", "found"])

    seen = texts.select("text", "toxic", "half").mapInArrow(measure, "toxic int, n long, found array<double>").collect()  # max_train ids' rows
    clean = [max(r["found"]) - math.log(max(r["n"], 1)) for r in seen if r["toxic"] == 0 and r["found"]]
    if len(clean) >= 20:  # moments of the Gumbel law
        mean = sum(clean) / len(clean)
        deviation = math.sqrt(sum((c - mean) ** 2 for c in clean) / (len(clean) - 1))
        model.scale = max(deviation * math.sqrt(6) / math.pi, 0.5)
        model.place = mean - 0.57722 * model.scale
    rows = [model.inputs(r["n"], [(0, 0, s) for s in r["found"]]) for r in seen]
    model.weights = _logistic(rows, [r["toxic"] for r in seen])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, and passages: the significant segments as (first word, words, score, chance)."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = Model.of(shared.value)
        read = own.reader()
        kind = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("score", pa.float64()), ("chance", pa.float64())]))
        for batch in batches:
            got = [read(t) for t in batch.column(1).to_pylist()]
            spans = [[(s, e - s, x, c) for s, e, x in found if (c := own.chance(x, n)) <= P_MAX] for n, found in got]
            spans = [[dict(zip(("first", "words", "score", "chance"), s, strict=True)) for s in x] for x in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.probability(n, x) for n, x in got], pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "passages"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, passages array<struct<first:long,words:long,score:double,chance:double>>")


def score_documents(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages."""
    scored = score(docs, train(docs, labels, **settings))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def keep_clean(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """docs without the rows whose score reaches limit. Only texts travel to Python; other columns, of any name, stay."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches):
        own = Model.of(shared.value)
        read = own.reader()
        for texts in batches:
            yield texts.map(lambda t: own.probability(*read(t)) < limit).astype(bool)

    import pandas as pd

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.where(F.pandas_udf(run, "boolean")(F.col("text")))
