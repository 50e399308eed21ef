"""Benchmark decontamination by the q-gram lemma, diagonal bands and banded alignment.

Every item is cut into windows. A text holds a window if some stretch of it is at most
``budget`` edits away. Such a stretch shares at least w + 1 - q * (budget + 1) of the window's
w - q + 1 q-grams with it, on diagonals (place in the text minus place in the window) that
differ by at most ``budget``. So q-grams that the text shares with the benchmark are counted per window and
diagonal band; bands overlap by the budget, so that no stretch falls between two; bands with
enough q-grams are kept and aligned within the band.

Texts and items are compared lower-cased, with every run of other characters than letters and
digits as one blank. The benchmark is the stated query set: it is read in blocks of bounded size,
and each block's index goes to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import union_all, written as cut
from .common import by_bytes, text_column

Q = 10
WINDOW = 48
STEP = 16
RATE = 3 / 48  # edits a character
BAND = 16
BLOCK = 2_000_000  # characters of the benchmark in one index
_FILTER = 22
_NEVER = 1 << 20  # edits * 256 of what can't be
_PRIME = 0x9E3779B97F4A7C15


def _fold_table() -> np.ndarray:
    out = np.full(1 << 16, 32, np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalnum():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    out[1] = 1
    return out


_FOLD = _fold_table()


def folded(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Comparable characters of a text, and where each stands in it. The character U+0001
    stays, to part texts."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(raw < 1 << 16, _FOLD[np.minimum(raw, 0xFFFF)], raw)
    blank = c == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    place = np.flatnonzero(keep)
    return c[place], place


def grams(c: np.ndarray) -> np.ndarray:
    """A 64-bit value of every ``Q`` characters in a row."""
    p = [np.uint64(pow(_PRIME, k, 1 << 64)) for k in range(Q)]
    h, size, at = c.astype(np.uint64), 1, {}
    while size <= Q:
        at[size] = h
        h, size = h[:max(len(h) - size, 0)] * p[size % Q] + h[size:], size * 2
    # join powers of two to Q characters
    out, have = None, 0
    for size in sorted(at, reverse=True):
        if have + size <= Q:
            part = at[size]
            if out is None:
                out, have = part, size
            else:
                n = max(len(c) - have - size + 1, 0)
                out, have = out[:n] * p[size] + part[have:have + n], have + size
    return out[:max(len(c) - Q + 1, 0)]


def budget(size: int) -> tuple[int, int]:
    """The edits a window of ``size`` characters may have, and the q-grams it then shares at
    least: the rate's edits, or as many as leave one q-gram."""
    k = min(int(size * RATE + 1e-9), (size - Q) // Q)
    return k, size + 1 - Q * (k + 1)


@dataclass(frozen=True)
class Index:
    """Windows (item, characters, budget, shared) and the places of their q-grams."""
    item: np.ndarray
    chars: np.ndarray  # windows x WINDOW, 0 behind a short one
    size: np.ndarray
    edits: np.ndarray
    shared: np.ndarray
    gram: np.ndarray
    first: np.ndarray
    window: np.ndarray
    place: np.ndarray

    def seen(self) -> np.ndarray:
        out = np.zeros(1 << _FILTER, bool)
        out[_slot(self.gram)] = True
        return out


def _slot(h: np.ndarray) -> np.ndarray:
    return (h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - _FILTER)


def index(items: list[tuple[int, str]]) -> Index:
    """The index of (number, text) items. Items of less than ``Q`` comparable characters
    hold no q-gram and are found nowhere."""
    item, chars, size, hashes, window, place = [], [], [], [], [], []
    for number, text in items:
        c = folded(text or "")[0]
        c = c[c != 1]
        c = c[1:] if len(c) and c[0] == 32 else c
        c = c[:-1] if len(c) and c[-1] == 32 else c
        if len(c) < Q:
            continue
        h = grams(c)
        starts = sorted({*range(0, max(len(c) - WINDOW, 0) + 1, STEP), max(len(c) - WINDOW, 0)})
        for s in starts:
            own = c[s:s + WINDOW]
            w = len(size)
            item.append(number)
            chars.append(np.pad(own, (0, WINDOW - len(own))))
            size.append(len(own))
            n = len(own) - Q + 1
            hashes.append(h[s:s + n])
            window.append(np.full(n, w, np.int32))
            place.append(np.arange(n, dtype=np.int32))
    limits = np.array([budget(n) for n in size], np.int32).reshape(-1, 2)
    flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    gram, first = np.unique(flat[order], return_index=True)
    join = lambda x: np.concatenate(x)[order] if x else np.zeros(0, np.int32)
    return Index(np.array(item, np.int64), np.array(chars, np.uint32).reshape(-1, WINDOW), np.array(size, np.int32), limits[:, 0], limits[:, 1], gram,
                 np.append(first, len(flat)).astype(np.int64), join(window), join(place))


def _align(text: np.ndarray, begin: np.ndarray, ix: Index, w: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pair, edits, start, end): least edits between each window ``w`` and any stretch of ``text`` on the
    diagonals from ``begin`` to ``begin`` + BAND + 3 budgets, and that stretch, once for each text that
    ``owner`` numbers, if the window's budget allows it. No stretch reaches across U+0001. All pairs go
    through the table of the window's characters together; a cell holds edits * 256 + start."""
    reach = int(ix.edits.max())
    width = BAND + 3 * reach + 1
    lanes = np.arange(width)
    begin = begin - reach
    cost = np.broadcast_to(lanes, (len(w), width)).astype(np.int32)
    for i in range(int(ix.size[w].max())):
        where = begin[:, None] + i + lanes
        inside = (where >= 0) & (where < len(text))
        letter = np.where(inside, text[np.clip(where, 0, len(text) - 1)], 1)
        wall = letter == 1
        step = np.where(wall, _NEVER, cost + 256 * (letter != ix.chars[w, i][:, None]))
        skip = np.full_like(cost, _NEVER)
        skip[:, :-1] = cost[:, 1:] + 256  # a character of the window is missing in the text
        step = np.minimum(step, skip)
        # characters of the text too many: each stretch of lanes behind a wall lies lower than all before it
        slope = 256 * lanes + 4 * _NEVER * np.cumsum(wall, axis=1)
        step = np.minimum.accumulate(step - slope, axis=1) + slope
        cost = np.where((i < ix.size[w])[:, None], step, cost).astype(np.int32)
    pair, lane = np.nonzero(cost >> 8 <= ix.edits[w][:, None])
    value = cost[pair, lane]
    end = begin[pair] + ix.size[w[pair]] + lane
    of = owner[end - 1]
    order = np.lexsort((lane, value, of, pair))
    pair, value, end, of = pair[order], value[order], end[order], of[order]
    best = np.concatenate([[True], (pair[1:] != pair[:-1]) | (of[1:] != of[:-1])])[:len(pair)]
    pair, value, end = pair[best], value[best], end[best]
    return pair, value >> 8, begin[pair] + (value & 255), end


def search(texts: list[str], ix: Index, seen: np.ndarray) -> list[list[tuple[int, int, int, int]]]:
    """For each text its (item, start, end, edits), in code points of the whole text, one for each window
    that it holds."""
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    if not len(ix.size):
        return out
    few, reach = int(ix.shared.min()), int(ix.edits.max())
    for lo, hi in by_bytes(texts):
        part = [t.replace("\x01", " ") for t in texts[lo:hi]]
        c, place = folded("\x01".join(part) + "\x01")
        h = grams(c)
        at = np.flatnonzero(seen[_slot(h)])
        g = np.searchsorted(ix.gram, h[at])
        hit = ix.gram[np.minimum(g, len(ix.gram) - 1)] == h[at]
        at, g = at[hit], g[hit]
        if len(at) < few:
            continue
        # places with enough shared q-grams around them
        dense = at[few - 1:] - at[:len(at) - few + 1] <= WINDOW + reach - Q
        cover = np.zeros(len(at) + 1, np.int64)
        cover[:len(dense)] += dense
        cover[few:few + len(dense)] -= dense
        keep = np.cumsum(cover[:-1]) > 0
        at, g = at[keep], g[keep]
        if not len(at):
            continue
        n = ix.first[g + 1] - ix.first[g]
        post = np.repeat(ix.first[g] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        w, diagonal = ix.window[post].astype(np.int64), np.repeat(at, n) - ix.place[post] + WINDOW
        band = diagonal // BAND
        low = diagonal % BAND < ix.edits[w]  # also within the band before
        key = np.concatenate([w << 40 | band, (w << 40 | (band - 1))[low]])
        key, count = np.unique(key, return_counts=True)
        key = key[count >= ix.shared[key >> 40]]
        starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in part])])
        owner = np.cumsum(c == 1)
        for a in range(0, len(key), 4096):
            w = key[a:a + 4096] >> 40
            for k, edits, s, e in zip(*_align(c, (key[a:a + 4096] & ((1 << 40) - 1)) * BAND - WINDOW, ix, w, owner)):
                s0, e0 = place[s], place[e - 1] + 1
                doc = int(np.searchsorted(starts, s0, side="right")) - 1
                out[lo + doc].append((int(ix.item[w[k]]), int(s0 - starts[doc]), int(e0 - starts[doc]), int(edits)))
    return [sorted(set(x)) for x in out]


def merged(found: list[tuple[int, int, int, int]]) -> list[list[int]]:
    """Stretches of a text that any item occupies, joined where they overlap."""
    spans: list[list[int]] = []
    for s, e in sorted((s, e) for _, s, e, _ in found):
        if spans and s <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], e)
        else:
            spans.append([s, e])
    return spans


def _blocks(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of the benchmark's items, each of about ``BLOCK`` characters; a longer item
    is alone with what falls to its block."""
    sized = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL")
    total = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    n = int(total // BLOCK) + 1
    for k in range(n):
        own = sized.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).distinct().orderBy("item_id", "text").collect()
        if own:
            yield index([(-1 if r["item_id"] is None else r["item_id"], r["text"]) for r in own])


def hit_column(spark, ix: Index):
    """text -> struct<items, spans, windows, edits>, null where no window is held."""
    fields = [("item_ids", pa.string()), ("spans", pa.string()), ("n_windows", pa.int64()), ("least_edits", pa.int64())]
    seen = None

    def run(texts: list[str]) -> dict[str, list]:
        nonlocal seen
        seen = ix.seen() if seen is None else seen
        out: dict[str, list] = {n: [] for n, _ in fields}
        for found in search(texts, ix, seen):
            out["item_ids"].append(",".join(str(i) for i in sorted({x[0] for x in found})) if found else None)
            out["spans"].append(",".join(f"{s}:{e}" for s, e in merged(found)) if found else None)
            out["n_windows"].append(len(found))
            out["least_edits"].append(min((x[3] for x in found), default=None))
        return out

    return text_column(run, fields, spark, "item_ids string, spans string, n_windows long, least_edits long")


def _joined(items: list[str], spans: list[str]) -> tuple[str, str]:
    """Item ids and spans of several blocks as one list each, overlapping spans joined."""
    ids = sorted({int(i) for x in items for i in x.split(",")})
    pairs = [tuple(map(int, s.split(":"))) for x in spans for s in x.split(",")]
    return ",".join(map(str, ids)), ",".join(f"{s}:{e}" for s, e in merged([(0, s, e, 0) for s, e in pairs]))


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_ids, spans, n_windows and least_edits for every row that holds a passage of
    the benchmark, and none for other rows.

    ``item_ids`` and ``spans`` (start:end in code points, end exclusive) are comma-joined. Null
    and empty texts hold nothing; items that are null or have fewer than ``Q`` letters and digits
    are held by nothing; repeated items count once. Repeated rows give a row each. Every block of the benchmark is a pass
    over the documents whose hits are written before the next index is built; the hits of a row
    in several blocks, few and small, are joined to one row.
    """
    spark, parts = documents.sparkSession, []
    for ix in _blocks(benchmark):
        if parts:
            parts[-1] = cut(parts[-1])
        found = documents.select("doc_id", F.md5("text").alias("_text"), hit_column(spark, ix)("text").alias("_r")).select("doc_id", "_text", "_r.*")
        parts.append(found.filter("item_ids IS NOT NULL"))
    if not parts:
        return documents.select("doc_id", *[F.lit(None).cast("string").alias(c) for c in ("item_ids", "spans")],
                                *[F.lit(None).cast("long").alias(c) for c in ("n_windows", "least_edits")]).limit(0)
    if len(parts) == 1:
        return parts[0].drop("_text")
    # rows of equal id and text have equal hits in a block: counted once, repeated at the end
    same = union_all([p.groupBy("doc_id", "_text", "item_ids", "spans", "n_windows", "least_edits").agg(F.count("*").alias("_rows")) for p in parts])
    whole = same.groupBy("doc_id", "_text").agg(F.collect_list("item_ids").alias("i"), F.collect_list("spans").alias("s"),  # as many as there are blocks
                                                F.sum("n_windows").alias("n_windows"), F.min("least_edits").alias("least_edits"), F.max("_rows").cast("int").alias("_rows"))

    @F.pandas_udf("item_ids string, spans string")
    def joined(items: pd.Series, spans: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_joined(list(i), list(s)) for i, s in zip(items, spans)], columns=["item_ids", "spans"])

    out = whole.withColumn("_r", joined("i", "s")).withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_rows"))))
    return out.select("doc_id", "_r.item_ids", "_r.spans", "n_windows", "least_edits")


def decontaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` that hold no passage of the benchmark, all columns as they are."""
    out = documents
    for k, ix in enumerate(_blocks(benchmark)):
        out = cut(out) if k else out  # a block's index is done with before the next is built
        out = out.filter(hit_column(documents.sparkSession, ix)("text")["n_windows"] == 0)
    return out
