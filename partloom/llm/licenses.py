"""Licence scans with a positional rare-token index, in DataFrame functions only.

Every template is a licence's notice as a row of words, with a key phrase that must occur.
One pass over all texts counts in how many each licence word occurs. A template is indexed
by words of highest inverse document frequency among those that occur at all, with their positions: ``MEET`` of its key
phrase, so that the phrase alone is found, and of its other words as many as make ``RARE``; each base phrase by its rarest word. The second pass looks a text's words up in that index, turns each hit
into the place where the template would start, and intersects the hits by that place;
where enough of them meet, the words of the key phrase are compared one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

RARE = 3  # index words of a template
MEET = 2  # of which so many must meet at one place

# The base phrases and their labels, as they are given.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
# Label, wording of the notice, key phrase within it.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("gpl", "licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl-3.0", "the gnu general public license version 3", "gnu general public license version 3"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify and or distribute"),
    ("unlicense", "free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0 universal"),
    ("cc-by", "licensed under cc by 4 0", "cc by"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null and empty texts have none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), lambda w: w != "")


def vocabulary(templates=TEMPLATES, base=BASE) -> list[str]:
    return sorted({w for _, wording, _ in templates for w in wording.split()} | {w for phrase, _ in base for w in phrase.split()})


def frequencies(documents: DataFrame, words: list[str]) -> dict[str, int]:
    """In how many of all texts each of ``words`` occurs (one row a word reaches the driver)."""
    seen = documents.select(F.explode(F.array_distinct(F.filter(words_of(F.col("text")), lambda w: w.isin(words)))).alias("w"))
    return {r["w"]: r["n"] for r in seen.groupBy("w").agg(F.count("*").alias("n")).collect()}


def rarest(wording: list[str], seen: dict[str, int], n: int) -> list[tuple[str, int]]:
    """(word, position) of the ``n`` words of highest inverse document frequency."""
    return sorted(((w, p) for p, w in enumerate(wording)), key=lambda x: (seen.get(x[0], 0), x[0], x[1]))[:n]


def indexed(wording: list[str], at: int, length: int, seen: dict[str, int]) -> list[tuple[str, int]]:
    """(word, position) of the template's index: rarest words of the key phrase, then of the rest; none that occur nowhere."""
    there = [x for x in rarest(wording, seen, len(wording)) if seen.get(x[0], 0) > 0]
    inside = [x for x in there if at <= x[1] < at + length]
    return inside[:MEET] + [x for x in there if x not in inside][:RARE - MEET]


def key_place(wording: list[str], phrase: list[str]) -> int:
    return next(i for i in range(len(wording)) if wording[i:i + len(phrase)] == phrase)


def _places(words: Column, hits: Column, phrase: list[str], seen: dict[str, int]) -> Column:
    """Where the phrase stands: hits of its rarest word, then all its words in a row."""
    (word, at), = rarest(phrase, seen, 1)
    row = F.array(*[F.lit(w) for w in phrase])
    starts = F.transform(F.filter(hits, lambda h: h["w"] == word), lambda h: h["i"] - at)
    return F.filter(starts, lambda s: (s >= 0) & (F.slice(words, F.greatest(s, F.lit(0)) + 1, len(phrase)) == row))


def _meeting(hits: Column, index: list[tuple[str, int]]) -> Column:
    """Sorted starting places of the template, one for each hit of an index word."""
    def starts(word: str, at: int) -> Column:
        return F.transform(F.filter(hits, lambda h: h["w"] == word), lambda h: h["i"] - at)

    return F.array_sort(F.concat(*[starts(w, p) for w, p in index]))


def _met(places: Column, times: int) -> Column:
    """The places that occur at least ``times`` times in the sorted list."""
    return F.filter(places, lambda x, i: F.get(places, i + (times - 1)) == x)


def scan(documents: DataFrame, templates=TEMPLATES, base=BASE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score for every row.

    Null and empty texts have no words, no labels and score 0. ``score`` is the largest
    share of a template's index words that meet at one place. Repeated rows and null ids
    give one row each; other columns are not read.
    """
    seen = frequencies(documents, vocabulary(templates, base))
    index = [indexed(w.split(), key_place(w.split(), key.split()), len(key.split()), seen) for _, w, key in templates]
    # a template of which no word occurs is in no text
    templates, index = [t for t, row in zip(templates, index) if row], [row for row in index if row]
    looked = sorted({w for row in index for w, _ in row} | {rarest(p.split(), seen, 1)[0][0] for p, _ in base})
    rows = documents.select("doc_id", words_of(F.col("text")).alias("words"))
    found = F.filter(F.transform("words", lambda w, i: F.when(w.isin(looked), F.struct(i.alias("i"), w.alias("w")))), lambda h: h.isNotNull())
    rows = rows.withColumn("hits", found)
    words, hits = F.col("words"), F.col("hits")

    # most texts have no hit at all: only the others go on
    some = F.size("hits") > 0
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), *[
        F.when(some, _places(words, hits, phrase.split(), seen)).alias(f"b{k}") for k, (phrase, _) in enumerate(base)], *[
        F.when(some, _meeting(hits, row)).alias(f"m{k}") for k, row in enumerate(index)], F.when(some, words).alias("words"))

    def label(test: Column, name: str) -> Column:
        return F.when(test, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))

    def stands(places: Column, at: int, phrase: list[str]) -> Column:
        row = F.array(*[F.lit(w) for w in phrase])
        return F.exists(_met(places, MEET), lambda s: (s + at >= 0) & (F.slice("words", F.greatest(s + at, F.lit(0)) + 1, len(phrase)) == row))

    base_labels = [label(F.size(f"b{k}") > 0, name) for k, (_, name) in enumerate(base)]
    own, shares = [], [F.lit(0.0), F.lit(0.0)]
    for k, (name, wording, key) in enumerate(templates):
        want, phrase, places = wording.split(), key.split(), F.col(f"m{k}")
        at = key_place(want, phrase)
        own.append(label(stands(places, at, phrase), name))
        n = len(index[k])
        share = F.lit(0.0)
        for m in range(1, n + 1):
            share = F.when(F.size(_met(places, m)) > 0, F.lit(m / n)).otherwise(share)
        shares.append(share)
    every = F.concat(*[F.coalesce(f"b{k}", F.array().cast("array<int>")) for k in range(len(base))])
    rows = rows.select("doc_id", "n_words", every.alias("places"), F.array_sort(F.array_distinct(F.concat(*base_labels))).alias("base"),
                       F.array_sort(F.array_distinct(F.concat(*base_labels, *own))).alias("all"), F.greatest(*shares).alias("score"))
    return rows.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"),
                       F.array_max("places").cast("long").alias("last_word"), F.array_join("base", ",").alias("base_labels"),
                       F.array_join("all", ",").alias("labels"), "score")


def oracle(templates=TEMPLATES, base=BASE) -> str:
    """The same rows in SQL, with the index and its hits as tables."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    inside = lambda wording, key, p: 0 <= p - key_place(wording.split(), key.split()) < len(key.split())
    tw = ", ".join(f"({t}, {p}, '{w}', {inside(wording, key, p)})" for t, (_, wording, key) in enumerate(templates) for p, w in enumerate(wording.split()))
    keys = []
    for t, (name, wording, key) in enumerate(templates):
        want, phrase = wording.split(), key.split()
        keys.append(f"({t}, '{name}', {key_place(want, phrase)}, {quoted(phrase)})")
    phrases = ", ".join(f"('{name}', {quoted(p.split())})" for p, name in base)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
tw(t, p, w, k) AS (VALUES {tw}), tk(t, name, kp, phrase) AS (VALUES {", ".join(keys)}), bp(name, phrase) AS (VALUES {phrases}),
u AS (SELECT rid, words, unnest(words) AS w, unnest(range(len(words))) AS i FROM d),
v AS (SELECT rid, w, i FROM u WHERE w IN (SELECT w FROM tw) OR w IN (SELECT unnest(phrase) FROM bp)),
f AS (SELECT w, count(DISTINCT rid) AS n FROM v GROUP BY w),
y AS (SELECT t, p, w, k, row_number() OVER (PARTITION BY t, k ORDER BY n, w, p) AS place FROM tw JOIN f USING (w)),
x AS (SELECT *, count(*) OVER (PARTITION BY t) AS size FROM y WHERE place <= CASE WHEN k THEN {MEET} ELSE {RARE - MEET} END),
m AS (SELECT rid, t, i - p AS o, count(*) AS n, CAST(count(*) AS DOUBLE) / any_value(size) AS share FROM v JOIN x USING (w) GROUP BY ALL),
s AS (SELECT rid, max(share) AS score FROM m GROUP BY rid),
b AS (SELECT v.rid, bp.name, v.i AS o FROM bp JOIN v ON v.w = bp.phrase[1] JOIN d USING (rid) WHERE d.words[v.i + 1:v.i + len(bp.phrase)] = bp.phrase),
bb AS (SELECT rid, count(*) AS n, min(o) AS lo, max(o) AS hi, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM b GROUP BY rid),
l AS (SELECT rid, tk.name FROM m JOIN tk USING (t) JOIN d USING (rid) WHERE m.n >= {MEET} AND m.o + tk.kp >= 0 AND d.words[m.o + tk.kp + 1:m.o + tk.kp + len(tk.phrase)] = tk.phrase
  UNION SELECT rid, name FROM b),
ll AS (SELECT rid, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM l GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(bb.n, 0) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
  coalesce(bb.names, '') AS base_labels, coalesce(ll.names, '') AS labels, coalesce(score, 0) AS score
FROM d LEFT JOIN bb USING (rid) LEFT JOIN ll USING (rid) LEFT JOIN s USING (rid)"""
