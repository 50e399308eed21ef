"""Spelling variants by asymmetric q-chunks.

Of two words one edit apart, the longer one (of equal length: either) contributes two disjoint chunks, its
halves; the other contributes positional grams of their lengths. One edit leaves a chunk whole, and in
the other word it stands in the same place or, behind the edit, is shifted by the difference of length, one at
most: only grams in such places can join, so only those are made. Words that share a chunk in
such places meet, and are compared exactly.

A chunk that very many words share is split by the same step: of what is left of two words one edit apart, one half
is whole again. Within a task the same step narrows what is compared, so the work follows the links and not
the squares of the groups.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from partloom.session import union_all, written as cut

from .common import spread_join

RUN = r"[a-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOST = 4000  # rows of a chunk that one task takes at once; larger ones are split by what follows
DIRECT = 48  # pairs that are compared without narrowing


def words(documents: DataFrame, least: int = 7, times: int = 2, every: int = 31) -> DataFrame:
    """(word, n): the distinct words and their occurrences in all ``documents``.

    Words are the letter runs of the text (null: none), A-Z lower-cased. A run loses the code point
    at h % length if ``every`` divides h, the crc32 of "<doc_id>:<run>" (null id: empty).
    """
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"{RUN}{{{least},}}+"), F.lit(0))
    run, size = F.col("run"), F.length("run")
    rows = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("_id", F.lit(":"), "run"))
    at = (h % size).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, size))
    found = rows.select(F.when(h % every == 0, shorter).otherwise(run).alias("word")).filter(F.length("word") >= least)
    return found.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= times)


def _halves(rows: DataFrame) -> DataFrame:
    """Each row twice: once per half that may be whole, with what is left open beside it.

    Rows are (key, side, word, n, lo, hi, m): ``key`` stands for what is known to be equal, [lo, hi) is the open part,
    ``m`` the length of the longer word's open part; side 0 gives chunks, side 1 grams.
    """
    lo, hi, m = F.col("lo"), F.col("hi"), F.col("m")
    right = F.floor(m / 2).cast("int")
    left = m - right
    first = F.struct(F.xxhash64("key", F.lit(0), F.substring("word", lo + 1, left)).alias("key"), (lo + left).alias("lo"), hi.alias("hi"), right.alias("m"))
    second = F.struct(F.xxhash64("key", F.lit(1), F.substring("word", hi - right + 1, right)).alias("key"), lo.alias("lo"), (hi - right).alias("hi"), left.alias("m"))
    return rows.select("side", "word", "n", F.explode(F.array(first, second)).alias("_h")).select("_h.key", "side", "word", "n", "_h.lo", "_h.hi", "_h.m")


def one_edit(x: str, y: str) -> bool:
    """Whether ``x`` and ``y``, equally long or ``x`` longer by one, differ by exactly one edit."""
    at = 0
    for at, (a, b) in enumerate(zip(x, y)):
        if a != b:
            break
    else:
        return len(x) > len(y)
    return x[at + 1:] == (y[at + 1:] if len(x) == len(y) else y[at:])


def _meet(xs: list, ys: list, m: int) -> Iterator[tuple]:
    """Pairs one edit apart. ``xs`` and ``ys`` are (open part, word, n); parts of ``xs`` have length ``m``, of ``ys`` m or m - 1."""
    if len(xs) * len(ys) <= DIRECT or m <= 1:
        for p, x, n in xs:
            for q, y, k in ys:
                if (len(p) > len(q) or x < y) and one_edit(p, q):
                    yield x, n, y, k
        return
    right = m // 2
    left = m - right
    for cut_x, cut_y, rest in ((lambda p: (p[:left], p[left:]), lambda p: (p[:left], p[left:]), right),
                               (lambda p: (p[left:], p[:left]), lambda p: (p[len(p) - right:], p[:len(p) - right]), left)):
        chunks, grams = defaultdict(list), defaultdict(list)
        for p, x, n in xs:
            whole, open_ = cut_x(p)
            chunks[whole].append((open_, x, n))
        for p, y, k in ys:
            whole, open_ = cut_y(p)
            if whole in chunks:
                grams[whole].append((open_, y, k))
        for whole, some in grams.items():
            if len(some) > 1 or len(chunks[whole]) > 1 or some[0][1] != chunks[whole][0][1]:
                yield from _meet(chunks[whole], some, rest)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both directions of each link found under a key; the partition is sorted by key."""
    key, m, xs, ys, out = None, 0, [], [], []

    def close():
        if xs and ys:
            for x, n, y, k in set(_meet(xs, ys, m)):
                out.append((x, y, k))
                out.append((y, x, n))

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.int64()))], ["word", "near", "near_n"])

    for b in batches:
        for k, side, word, n, lo, hi, m_ in zip(*(b.column(c).to_pylist() for c in ("key", "side", "word", "n", "lo", "hi", "m"))):
            if k != key:
                close()
                key, m, xs, ys = k, m_, [], []
            (ys if side else xs).append((word[lo:hi], word, n))
        if len(out) > 5000:
            yield batch()
            out.clear()
    close()
    if out:
        yield batch()


def links(vocabulary: DataFrame) -> DataFrame:
    """(word, near, near_n): all words of ``vocabulary`` (word, n; distinct) one edit apart, in both directions.

    ``vocabulary`` is read twice: it should be written.
    """
    size = F.length("word")
    start = vocabulary.select("word", "n", F.explode(F.array(*[F.struct(F.lit(s).cast("byte").alias("side"), (size + more).alias("m"))
                                                               for s, more in ((0, 0), (1, 0), (1, 1))])).alias("_r"))
    rows = start.select(F.xxhash64("_r.m").alias("key"), "_r.side", "word", "n", F.lit(0).alias("lo"), size.alias("hi"), "_r.m")
    ready = []
    while True:
        rows = cut(_halves(rows))
        hot = cut(rows.filter("m > 1").groupBy("key").agg(F.count("*").alias("_n")).filter(F.col("_n") > MOST).select("key"))
        if hot.isEmpty():
            ready.append(rows)
            break
        ready.append(rows.join(hot, "key", "left_anti"))
        rows = rows.join(hot, "key", "left_semi")
    met = union_all(ready).repartition("key").sortWithinPartitions("key")
    return met.mapInArrow(_links, "word string, near string, near_n long").distinct()


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root): where the chain of ``forms`` (word, form) ends. Each round doubles the steps."""
    ahead = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        after = ahead.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        more = ahead.join(after.select("root"), "root", "left_semi")
        if more.isEmpty():
            return ahead
        # only words that are forms themselves go on; many words may share one
        ahead = cut(spread_join(more, after, "root").select("word", F.col("_next").alias("root"))
                    .unionByName(ahead.join(after.select("root"), "root", "left_anti").select("word", "root")))


def variants(documents: DataFrame, least: int = 7, times: int = 2, every: int = 31, ratio: int = 10) -> DataFrame:
    """word, form, root, n, n_near and form_n for each word of ``documents`` (see ``words``).

    A word's form is its most frequent near word (ties: the smallest in code point order) if that
    occurs ``ratio`` times as often or more; ``root`` is where its forms end, the word itself without any.
    Null, empty and letterless texts have no words; repeated rows count again. Other columns
    are not read. No words: no rows.
    """
    vocabulary = cut(words(documents, least, times, every))
    near = links(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near"))).alias("_best"))
    known = vocabulary.join(near, "word", "left")
    formed = (-F.col("_best.minus")) >= F.col("n") * ratio
    out = cut(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                           F.when(formed, F.col("_best.near")).alias("form"), F.when(formed, -F.col("_best.minus")).alias("form_n")))
    roots = last_forms(out.filter("form IS NOT NULL").select("word", "form"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE = r"""
WITH RECURSIVE bits(i, k, v) AS (SELECT i, 0, i::BIGINT FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]{7,}')) AS run FROM documents),
c AS (SELECT id, run, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(id || ':' || run, ''), lambda s: CASE WHEN unicode(s) < 128 THEN [unicode(s)::BIGINT] ELSE [195::BIGINT, (unicode(s) - 64)::BIGINT] END))),
  lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) AS h FROM c, crc),
w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
d AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS cut FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
p AS (SELECT a.word, b.word AS near, b.n FROM d a JOIN d b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
  UNION SELECT d.word, v.word, v.n FROM d JOIN v ON v.word = d.cut UNION SELECT v.word, d.word, d.n FROM d JOIN v ON v.word = d.cut),
m AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS best, max(n) AS best_n FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * v.n THEN best END AS form, CASE WHEN best_n >= 10 * v.n THEN best_n END AS form_n FROM v LEFT JOIN m USING (word)),
z(word, stop) AS (SELECT word, word FROM f UNION ALL SELECT z.word, f.form FROM z JOIN f ON f.word = z.stop WHERE f.form IS NOT NULL),
e AS (SELECT z.word, z.stop FROM z JOIN f ON f.word = z.stop WHERE f.form IS NULL)
SELECT f.word, f.form, e.stop AS root, f.n, f.n_near, f.form_n FROM f JOIN e USING (word)"""
