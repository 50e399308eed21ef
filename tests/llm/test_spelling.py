"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from partloom.llm import spelling


def plain_words(rows, least=7, times=2, every=31):
    seen = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= least and n >= times}


def edits(a, b):
    """Whether exactly one insertion, deletion or replacement leads from a to b."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def plain_variants(words):
    out, forms = {}, {}
    for w, n in words.items():
        near = [o for o in words if o != w and edits(w, o)]
        best = min(near, key=lambda o: (-words[o], o), default=None)
        forms[w] = best if best is not None and words[best] >= 10 * n else None
        out[w] = (forms[w], n, len(near), words[best] if forms[w] else None)
    def root(w):
        while forms[w]:
            w = forms[w]
        return w
    return sorted((w, f or "", root(w), n, k, fn or 0) for w, (f, n, k, fn) in out.items())


def found(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in df.collect())


@pytest.mark.parametrize("most, direct", [(4000, 48), (6, 1), (2, 4)])
def test_variants_equal_brute_force(spark, documents, monkeypatch, most, direct):
    monkeypatch.setattr(spelling, "MOST", most)  # chunks that many words share are split
    monkeypatch.setattr(spelling, "DIRECT", direct)
    draw, rows = random.Random(3), []
    for k in range(60):
        bases = ["".join(draw.choice("abé") for _ in range(draw.randint(6, 9))) for _ in range(3)] + ["Spelling", "spellings", "chapter"]
        words = []
        for w in bases:
            words += [w] * draw.randint(1, 12)
            at = draw.randrange(len(w))
            words += [w[:at] + w[at + 1:], w[:at] + "x" + w[at:], w[:at] + "ÿ" + w[at + 1:]] * draw.randint(0, 2)
        rows.append((k, " ".join(words) + "1" + "-".join(words)))
    want = plain_variants(plain_words(rows))
    assert len({w for w, f, *_ in want if f}) > 5
    assert found(spelling.variants(documents(rows))) == want


def test_chains_end_at_their_last_form(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(19)] + [(f"v{k}", "w3") for k in range(50)], "word string, form string")
    got = {r["word"]: r["root"] for r in spelling.last_forms(forms).collect()}
    assert len(got) == 69 and set(got.values()) == {"w19"}


@pytest.mark.parametrize("a, b, near", [("abc", "abd", True), ("abc", "abc", False), ("abcd", "abc", True), ("abcd", "bcd", True), ("a", "", True), ("aab", "ab", True), ("abcd", "adc", False), ("ab", "ba", False)])
def test_one_edit(a, b, near):
    assert spelling.one_edit(a, b) == near


def test_odd_rows(spark, documents, odd):
    rows = odd.select("doc_id", "text").collect()
    want = plain_variants(plain_words([(r[0], r[1]) for r in rows]))
    clash = odd.withColumn("word", odd["lang"]).withColumn("n", odd["n_chars"]).withColumn("run", odd["source"])
    assert found(spelling.variants(clash)) == want
    assert spelling.variants(odd.limit(0)).count() == 0
    twice = documents([(1, "zzzzzzzz"), (1, "zzzzzzzz"), (2, None)])
    assert [r["n"] for r in spelling.variants(twice).collect()] == [n for n in plain_words([(1, "zzzzzzzz")] * 2).values()]
