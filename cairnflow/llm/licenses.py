"""Licence scans by diagonal voting, with built-in functions only.

All rolling 3-grams of a text's words are joined to the grams of licence templates. Grams whose words can't stand at their
places in any template's gram are left out while they are still places in the array of words; what remains joins as text.
A hit at word p of the text and word t of a template votes for the diagonal p - t. Words put in or left out shift the rest,
so neighbouring diagonals are merged: those within DRIFT words of each other, which bounds how far a span may stray however
its hits are strung together. A merged group is verified: its span is then at most DRIFT words longer than the template,
grams over DRIFT words apart stand in the template's order, and of the template's grams, each counted once, there must be
COVER of a long one's; a shorter one may lack the grams of one replaced word, but no more than half. Base phrases stand
word for word on one diagonal. The template table is fixed and small, so broadcasting it is bounded by this file.

Defined cases: a null text is empty; texts of fewer than three words have no grams; a very long text is one row, whose hits
are a window's rows in one task; repeated rows are scanned each for itself; no rows give no rows; other columns, of any
name, are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K, DRIFT, COVER = 3, 8, 0.8
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Phrases whose every place counts, and their labels.
BASE = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
# Notices found as a whole or nearly so, and their labels.
NOTICES = [
    ("This work is licensed under the GNU General Public License version 3", "gpl-3"),
    ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gpl"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("Licensed under the Apache License, Version 2.0", "apache-2"),
    ("you may not use this file except in compliance with the License. You may obtain a copy of the License at", "apache-2"),
    ("licensed under CC BY-NC 4.0", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl-2"),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
    ("All rights reserved", "all-rights-reserved"),
]
# Whole licences, and their labels.
TEXTS = [
    (
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
        COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "mit",
    ),
    (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
        AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE.""",
        "isc",
    ),
    (
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
        SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
        WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
        THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
        "bsd",
    ),
    (
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
        it and redistribute it freely, subject to the following restrictions:
        1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
        you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
        required.
        2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
        software.
        3. This notice may not be removed or altered from any source distribution.""",
        "zlib",
    ),
]


def words_of(text: str) -> list[str]:
    """Words of a template, as the scan takes them from a text."""
    return re.findall(r"[0-9a-z]+", text.lower())


def needed(total: int, base: bool) -> int:
    """Grams that a template of total grams must show."""
    if base:
        return total
    return -(-int(COVER * 100) * total // 100) if total >= 5 * K else max(-(-total // 2), total - K)


def template_grams() -> list[tuple[int, str, bool, int, int, int, str]]:
    """template, label, whether base, its grams' count, how many are needed, a gram's word position, the gram."""
    rows = []
    for t, (phrase, label) in enumerate(BASE + NOTICES + TEXTS):
        words = words_of(phrase)
        n = len(words) - K + 1
        rows += [(t, label, t < len(BASE), n, needed(n, t < len(BASE)), i, " ".join(words[i : i + K])) for i in range(n)]
    return rows


def lower_latin(text):
    """A-Z in lower case; what else lower() changes is no ASCII letter before or after, but for two characters."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    odd = text.contains("K") | text.contains("İ")
    return F.when(odd, F.translate(text, upper, lower)).otherwise(F.lower(text))


def hits(docs: DataFrame) -> DataFrame:
    """row, doc_id, pos, template columns: a row per gram that a template has, and one of template null per document, whose pos is its number of words."""
    spark: SparkSession = docs.sparkSession
    rows = template_grams()
    grams = spark.createDataFrame([*rows, (None, None, None, None, None, None, "")], "template int, label string, base boolean, total int, need int, at int, gram string")
    words = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.regexp_extract_all(lower_latin(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0)).alias("w"))
    at_place = [sorted({r[-1].split(" ")[k] for r in rows}) for k in range(K)]

    def found(w: Column) -> Column:
        """(pos, gram) of the grams that a template might have, after one for the document: its number of words and no gram."""
        possible = lambda i: F.get(w, i).isin(at_place[0]) & F.get(w, i + 1).isin(at_place[1]) & F.get(w, i + 2).isin(at_place[2])
        places = F.when(F.size(w) >= K, F.filter(F.sequence(F.lit(0), F.size(w) - K), possible)).otherwise(F.array().cast("array<int>"))
        shown = F.transform(places, lambda i: F.struct(i.alias("pos"), F.concat_ws(" ", *[F.get(w, i + j) for j in range(K)]).alias("gram")))
        return F.concat(F.array(F.struct(F.size(w).alias("pos"), F.lit("").alias("gram"))), shown)

    # the words are bound to a lambda's variable, so that their expression runs once
    every = words.select("doc_id", "row", F.explode(F.element_at(F.transform(F.array("w"), found), 1)).alias("hit"))
    return every.select("doc_id", "row", "hit.pos", "hit.gram").join(F.broadcast(grams), "gram").drop("gram")


def scan(docs: DataFrame, drift: int = DRIFT) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (first word, label, words, cover)."""
    # base phrases' diagonals are set too far apart to merge
    line = F.when(F.col("base"), (F.col("pos") - F.col("at")) * (2 * drift + 1)).otherwise(F.col("pos") - F.col("at")).cast("long")
    votes = hits(docs).repartition("row").withColumn("line", line)
    near = Window.partitionBy("row", "template").orderBy("line")
    ahead = near.rangeBetween(0, drift)
    merged = votes.withColumns({"votes": F.size(F.collect_set("at").over(ahead)), "first": F.min("pos").over(ahead), "last": F.max("pos").over(ahead)})
    # of overlapping groups the fullest, then the first
    own = F.struct(F.col("votes"), (-F.col("line")).alias("order"))
    merged = merged.withColumn("best", F.max(own).over(near.rangeBetween(-drift, drift)) == own)
    share, found = F.col("votes") / F.col("total"), F.col("template").isNotNull() & (F.col("votes") >= F.col("need"))
    base = found & F.col("base")
    place = F.when(base & (F.col("at") == 0), F.col("pos"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    span = F.struct(F.col("first"), F.col("label"), (F.col("last") - F.col("first") + K).alias("words"), share.alias("cover"))
    return merged.groupBy("row", "doc_id").agg(
        F.max(F.when(F.col("template").isNull(), F.col("pos"))).cast("long").alias("n_words"),
        F.count(place).alias("n_base"),
        F.min(place).cast("long").alias("first_word"),
        F.max(place).cast("long").alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined(F.when(found, F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(F.col("template").isNotNull(), share)), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_set(F.when(found & F.col("best"), span))).alias("spans"),
    ).drop("row")


def oracle() -> str:
    """The same scan in SQL."""
    values = ", ".join(f"({t}, '{label}', {str(base).lower()}, {total}, {need}, {at}, '{gram}')" for t, label, base, total, need, at, gram in template_grams())
    return rf"""
with t(template, label, base, total, need, at_, gram) as (values {values}),
d as (
  select doc_id, row_number() over () as row_,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), e as (select row_, unnest(w) as word, unnest(range(len(w))) as pos from d),
g as (
  select row_, pos, word || ' ' || lead(word, 1) over p || ' ' || lead(word, 2) over p as gram from e window p as (partition by row_ order by pos)
), h as (select g.row_, g.pos, t.*, (g.pos - t.at_) * (case when base then {2 * DRIFT + 1} else 1 end) as line from g join t using (gram)),
v as (select *, len(list_distinct(list(at_) over (partition by row_, template order by line range between current row and {DRIFT} following))) as votes from h),
r as (
  select row_, count(*) filter (votes >= need and base and at_ = 0) as n_base, min(pos) filter (votes >= need and base and at_ = 0) as first_word, max(pos) filter (votes >= need and base and at_ = 0) as last_word,
    string_agg(distinct label, ',' order by label) filter (votes >= need and base) as base_labels, string_agg(distinct label, ',' order by label) filter (votes >= need) as labels, max(votes / total::double) as score
  from v group by row_
)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score
from d left join r using (row_)
"""
