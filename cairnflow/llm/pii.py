"""Personal data: base recognizers, and contextual extraction that bootstraps from what they find.

Base spans come from four recognizers, each one linear pass over the whole text. They are the seeds. What stands before a
seed (the last word, and the last two) is a lexical pattern. Identifier-like strings that no base span touches are
candidates, in shapes the recognizers don't take: spelled-out addresses, telephone numbers without a country code, IPv6
addresses. Spark counts, over all documents, every place of each pattern that enough different instances share, whatever
follows it; so "of the" is a poor pattern although many seeds follow it. Patterns and instances then score each other in
rounds, until a round accepts nothing: a pattern that enough accepted instances share by the share of its places that hold
accepted instances of its kind (places of candidates not accepted so far are left out), an instance by the patterns it
follows. Accepted instances stay accepted and become spans wherever they stand. A word glued to what follows it ("tel:+1")
is a pattern of its own: letters and digits and the signs after them, which stand within every word that goes on after them.
Tasks learn which patterns to count from a bitmap of fixed size; what passes it is counted and joined with the patterns by
a shuffle, so patterns may be many and none pass through the driver.

Defined cases: a null text is empty; a very long text takes time in proportion to its length, whatever it holds; text
without matches has the digest of the empty string; repeated rows are scanned
each for itself; corpus counts cover every row; no rows give no rows; other columns, of any name, are
ignored by scan() and kept by redact(), whose null texts stay null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, join_checked

KINDS = ("email", "ip", "card", "phone")
#: Different accepted instances that make a pattern, the score that accepts, bits of the patterns' bitmap.
SUPPORT, ACCEPT, BITMAP = 3, 0.8, 1 << 24
#: Most entries of a task's counter; fuller ones are emitted.
COUNTER = 1 << 19
#: Ends patterns whose last word is glued to what follows; never part of a word.
GLUED = "\n"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a run of digits that starts no match starts none from within either, so only its start is tried
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_CANDIDATES = (
    ("email", re.compile(r"(?<!\S)[A-Za-z0-9._%+-]{1,64}(?: at | ?[(\[]at[)\]] ?)[A-Za-z0-9-]{1,63}(?:(?: dot | ?[(\[]dot[)\]] ?)[A-Za-z0-9-]{1,63}){1,4}(?!\w)")),
    ("phone", re.compile(r"(?<![\w.+-])\(?[0-9]{2,5}\)?(?:[ .-][0-9]{2,5}){1,4}(?![\w-]|\.[0-9])")),
    ("ip", re.compile(r"(?<![\w:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![\w:])")),
)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(x * 2 - 9 * (x > 4) for x in map(int, digits[-2::-2]))
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) in order; code points."""
    out = []
    at = text.find("@")
    last = 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            last = m.end()
            out.append((start, 0, last))
        at = text.find("@", max(at + 1, last))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Identifier-like spans that no base span touches."""
    from bisect import bisect_left

    starts, ends = [], []  # of what base spans cover, in order
    for a, _, b in sorted(taken):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    out = []
    for kind, pattern in _CANDIDATES:
        if kind == "email" and "dot" not in text or kind != "email" and not _DIGIT.search(text):
            continue
        for m in pattern.finditer(text):
            s, e = m.span()
            if kind == "phone" and not 7 <= len(_DIGIT.findall(m[0])) <= 15:
                continue
            last = bisect_left(starts, e) - 1
            if last < 0 or ends[last] <= s:
                out.append((s, KINDS.index(kind), e))
    return sorted(out)


_WORD = re.compile(r"\S+")
# letters and digits (or none) and the signs after them
_HEAD = re.compile(r"([^\W_]*)([\W_]+)")


class Contexts:
    """Lexical patterns of places in a text: what stands before, the last word, and the last two."""

    def __init__(self, text: str):
        self.text, self.words = text, [m.span() for m in _WORD.finditer(text)]
        self.starts = [s for s, _ in self.words]

    def before(self, start: int) -> list[str]:
        from bisect import bisect_left

        text, k = self.text, bisect_left(self.starts, start)  # k words begin before start
        word = lambda i: context_word(text[slice(*self.words[i])])
        if not k or self.words[k - 1][1] <= start:
            words = [word(i) for i in range(max(0, k - 2), k)]
            return [" ".join(words[-n:]) for n in (1, 2) if len(words) >= n]
        first, at = self.words[k - 1][0], start
        while at > first and not text[at - 1].isalnum():
            at -= 1
        if at == start:
            return []
        while at > first and text[at - 1].isalnum():
            at -= 1
        head = context_word(text[at:start]) + GLUED
        return [head, *([f"{word(k - 2)} {head}"] if at == first and k > 1 else [])]


def context_word(word: str) -> str:
    return _DIGIT.sub("0", word.lower())


def _occurrences(docs: DataFrame) -> DataFrame:
    """One pass: row, doc_id, hash, base (sorted spans), found (every seed and candidate with its instance and patterns)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
        occurrence = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("seed", pa.bool_()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows, base, found = [], [], []
            for text in batch.column(2).to_pylist():
                text = text or ""
                spans = base_spans(text)
                more = candidates(text, spans)
                before = Contexts(text).before if spans or more else None
                rows.append(row)
                row += 1
                base.append([dict(zip(("start", "kind", "end"), s, strict=True)) for s in spans])
                found.append([{"start": s, "kind": k, "end": e, "seed": seed, "instance": text[s:e].lower(), "patterns": before(s)} for seed, part in ((True, spans), (False, more)) for s, k, e in part])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), batch.column(0), batch.column(1), pa.array(base, pa.list_(span)), pa.array(found, pa.list_(occurrence))], ["row", "doc_id", "hash", "base", "found"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = "array<struct<start:long,kind:int,end:long>>"
    return docs.select("doc_id", F.xxhash64("text").alias("hash"), "text").mapInArrow(
        run, f"row long, doc_id {kind}, hash long, base {shape}, found array<struct<start:long,kind:int,end:long,seed:boolean,instance:string,patterns:array<string>>>"
    )


def _bitmap(patterns: DataFrame) -> bytes:
    """BITMAP bits, of which each pattern's hash sets one; tasks bring theirs deflated."""

    def run(batches: Iterator) -> Iterator:
        from zlib import compress

        import numpy as np
        import pyarrow as pa

        bits = np.zeros(BITMAP // 8, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy()
            np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        if bits.any():
            yield pa.RecordBatch.from_arrays([pa.array([compress(bits.tobytes(), 1)], pa.binary())], ["bits"])

    from zlib import decompress

    import numpy as np

    found = np.zeros(BITMAP // 8, np.uint8)
    spread = patterns.select(F.pmod(F.crc32(F.col("pattern").cast("binary")), F.lit(BITMAP)).alias("at"))
    for r in spread.mapInArrow(run, "bits binary").toLocalIterator():
        found |= np.frombuffer(decompress(r["bits"]), np.uint8)
    return found.tobytes()


def _pattern_places(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern, places: how often each of patterns (a cut) stands in docs, whatever follows. One scan."""
    if patterns.isEmpty():
        return patterns.select("pattern", F.lit(0).cast("long").alias("places"))
    # last words of pairs, marked by a blank before them, are in the bitmap too
    last = F.when(F.contains("pattern", F.lit(" ")), F.concat(F.lit(" "), F.substring_index("pattern", " ", -1)))
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(patterns.select(F.explode(F.array_compact(F.array("pattern", last))).alias("pattern"))))
    glued = not patterns.where(F.col("pattern").endswith(GLUED)).isEmpty()

    def run(batches: Iterator) -> Iterator:
        from collections import Counter
        from zlib import crc32

        import pyarrow as pa

        bits, counts = shared.value, Counter()

        def wanted(pattern: str) -> bool:
            h = crc32(pattern.encode("utf-8", "surrogatepass")) % BITMAP
            return bits[h >> 3] >> (h & 7) & 1 == 1

        class Roles(dict):
            """1 for a word that is a pattern, 2 for one that ends a pair, 3 for both."""

            def __missing__(self, word: str) -> int:
                if len(self) > COUNTER:
                    self.clear()
                role = self[word] = wanted(word) + 2 * wanted(" " + word)
                return role

        roles = Roles()

        def table():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["pattern", "places"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = (_DIGIT.sub("0", text.lower()) if text else "").split()
                for i, role in enumerate(map(roles.__getitem__, words)):
                    if role:
                        if role & 1:
                            counts[words[i]] += 1
                        if role & 2 and i and wanted(p := f"{words[i - 1]} {words[i]}"):
                            counts[p] += 1
                for i, w in enumerate(words if glued else ()):
                    for m in () if w.isalnum() else _HEAD.finditer(w):
                        for before in ("", f"{words[i - 1]} ") if i and not m.start() else ("",):
                            at = crc32((before + m[1]).encode("utf-8", "surrogatepass"))
                            for n, sign in enumerate(m[2][: len(w) - 1 - m.start(2)], 1):  # something follows
                                at = crc32(sign.encode("utf-8", "surrogatepass"), at)
                                h = crc32(GLUED.encode(), at) % BITMAP
                                if bits[h >> 3] >> (h & 7) & 1:
                                    counts[before + m[1] + m[2][:n] + GLUED] += 1
                if len(counts) > COUNTER:
                    yield table()
                    counts.clear()
        yield table()

    every = docs.select("text").mapInArrow(run, "pattern string, places long").groupBy("pattern").agg(F.sum("places").alias("places"))
    return every.join(patterns, "pattern", "left_semi")


def discover(docs: DataFrame, occurrences: DataFrame, support: int = SUPPORT, accept: float = ACCEPT) -> DataFrame:
    """Accepted candidates: kind, instance, score. occurrences: a cut table of _occurrences(docs)."""
    each = occurrences.select(F.explode("found").alias("o")).select("o.kind", "o.instance", "o.seed", F.explode("o.patterns").alias("pattern"))
    edges = cut(each.groupBy("pattern", "kind", "instance").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("n")))
    useful = edges.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("all"), F.count_if(~F.col("seed")).alias("others"))
    # a pattern with no candidate can discover nothing; one of too few instances never qualifies
    useful = cut(useful.where((F.col("all") >= support) & (F.col("others") > 0)).select("pattern").distinct())
    places = cut(_pattern_places(docs, useful))
    graph = cut(join_checked(edges, places, "pattern"))
    seeds = cut(edges.where("seed").select("kind", "instance").distinct())
    known = seeds.withColumn("score", F.lit(1.0))
    while True:
        rated = graph.join(known, ["kind", "instance"], "left")
        unknown = F.coalesce(F.sum(F.when(F.col("score").isNull(), F.col("n"))), F.lit(0))
        pattern = rated.groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.coalesce("score", F.lit(0.0))).alias("held"), (F.max("places") - unknown).alias("settled"), F.count("score").alias("known"))
        pattern = pattern.where(F.col("known") >= support).select("pattern", "kind", F.least(F.lit(1.0), F.col("held") / F.greatest("settled", F.lit(1))).alias("trust"))
        doubt = rated.where(F.col("score").isNull()).join(pattern, ["pattern", "kind"]).groupBy("kind", "instance").agg(F.sum(F.log1p(-F.least("trust", F.lit(0.999999)))).alias("doubt"))
        more = cut(doubt.select("kind", "instance", (1 - F.exp("doubt")).alias("score")).where(F.col("score") >= accept))
        if more.isEmpty():
            break
        known = cut(known.unionByName(more))
    return known.join(seeds, ["kind", "instance"], "left_anti")


def _discovered(docs: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Spans of accepted instances: row, doc_id, hash, more (spans of one row)."""
    accepted = cut(discover(docs, occurrences))
    open_ = occurrences.select("row", "doc_id", "hash", F.explode(F.filter("found", lambda o: ~o["seed"])).alias("o")).select("row", "doc_id", "hash", "o.start", "o.kind", "o.end", "o.instance")
    return join_checked(open_, accepted.drop("score"), ["kind", "instance"]).groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("hash").alias("hash"), F.collect_list(F.struct("start", "kind", "end")).alias("more"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all, as kind:start:end)."""
    rows = cut(_occurrences(docs))
    more = cut(_discovered(docs, rows).select("row", "more"))
    names = F.array(*[F.lit(k) for k in KINDS])
    text = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    every = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more"))
    return join_checked(rows.drop("found"), more, "row", "left").select("doc_id", *counts, F.sha2(text(F.col("base")).cast("binary"), 256).alias("base_sha256"), text(every).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of text, base or discovered, replaced by its kind in brackets, and n_chars (if there) to match."""
    columns = docs.columns
    rows = cut(_occurrences(docs))
    more = cut(_discovered(docs, rows).select("doc_id", "hash", "more").dropDuplicates(["doc_id", "hash"]))
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_own"), F.xxhash64("text").alias("_hash"), "text")
    other = more.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_of"), "more")
    joined = join_checked(own, other, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_of")), "left").select("row", "text", "more")

    @F.pandas_udf("string")
    def masked(texts, extra):
        import pandas as pd

        def one(text: str | None, found) -> str | None:
            if text is None:
                return None
            spans = sorted(base_spans(text) + [(x["start"], x["kind"], x["end"]) for x in (found if found is not None else ())])
            parts, at = [], 0
            for s, kind, e in spans:
                if e <= at:
                    continue
                if s >= at:
                    parts += [text[at:s], f"[{KINDS[kind].upper()}]"]
                at = e
            return "".join([*parts, text[at:]])

        return pd.Series([one(t, x) for t, x in zip(texts, extra, strict=True)], dtype=object)

    told = joined.select("row", masked("text", "more").alias("masked"))
    field = lambda i: F.col("row")[columns[i]]
    kinds = {f.name: f.dataType for f in docs.schema}
    new = {"text": F.col("masked"), **({"n_chars": F.length("masked").cast(kinds["n_chars"])} if "n_chars" in columns else {})}
    return told.select(*[new.get(c, field(i)).alias(c) for i, c in enumerate(columns)])
