"""Searches against brute force, and the work that they do."""

import random

from pyspark.sql import functions as F

from partloom.operators import lookup, matching

FIGURES = ["char_length", *matching.COMPONENTS]
SOLID = "case_id string, variant string, solid_id string, strict string, chirality int, " + ", ".join(f"{c} double" for c in FIGURES)


def test_equal_solids_are_compared_once(spark, monkeypatch):
    met = []
    search = matching.near_pairs

    def counted(*a, **k):
        out = search(*a, **k)
        met.append(out.count())
        return out

    monkeypatch.setattr(matching, "near_pairs", counted)
    rows = [("c", v, f"{v}{i}", f"s{i % 2}", 0, 1.0, 0.5, 0.1, 0.2, 0.3) for v in "ab" for i in range(60)]
    got = matching.best_partner(spark.createDataFrame(rows, SOLID)).collect()
    assert len(got) == 60 and {r.partner for r in got} == {"b0"}
    assert {r.solid_id: r.same_strict for r in got} == {f"a{i}": i % 2 == 0 for i in range(60)}
    assert sum(met) == 1


def test_best_partner_is_the_least_of_all(spark):
    draw = random.Random(3)
    rows = []
    for i in range(80):
        size, shape = draw.choice([1.0, 1.00005, 1.3, 9.0]), draw.choice([0.5, 0.50004, 0.7])
        rows.append((draw.choice("cd"), draw.choice("abe"), f"s{i:02d}", draw.choice("xy"), 0, size, shape, 0.1, 0.2, 0.3))
    rows += rows[:5] + [("c", "a", "s01", None, 0, 2.0, 0.5, 0.1, 0.2, 0.3)]
    want = {}
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] < b[1]:
                size = abs(a[5] - b[5]) / max(a[5], b[5])
                shape = max(abs(x - y) for x, y in zip(a[6:], b[6:]))
                key = (a[0], a[1], a[2], a[3], b[1])
                want[key] = min(want.get(key, (9e9, "")), (size + shape, b[2]))
    unique = {k[:3] + k[4:]: 0 for k in want}
    for k in want:
        unique[k[:3] + k[4:]] += 1
    got = {(r.case_id, r.variant, r.solid_id, r.other): r.partner for r in matching.best_partner(spark.createDataFrame(rows, SOLID)).collect()}
    for (case, variant, solid, strict, other), (_, partner) in want.items():
        if unique[(case, variant, solid, other)] == 1:
            assert got[(case, variant, solid, other)] == partner


def test_mentioned_part_against_all_parts(spark):
    numbers = ["PN-1", "PN-12", "PN-123", "BOLT-7", "X", "", None, "ÄB-1", "PN-12"]
    texts = [(1, "does pn-123 fit"), (2, "pn-1x or pn-12y"), (3, "see bolt-7"), (4, ""), (5, None), (6, "äb-1"), (7, "how about QZ-9-W then"), (7, "pn-12")]
    for known in (numbers, [n for n in numbers if n], ["PN-12", "BOLT-77"], []):
        got = lookup.mentioned_part(spark.createDataFrame(texts, "text_id int, text string"), spark.createDataFrame([(n,) for n in known], "part_number string"))
        found = {r.text_id: r.part_number for r in got.collect() if r.text_id not in (5, 7)}
        for i, t in texts[:4] + texts[5:6]:
            hits = [n for n in known if n is not None and n in t.upper()]
            word = {1: "PN-123", 3: "BOLT-7", 2: "PN-1X"}.get(i)
            assert found[i] == (min(hits, key=lambda n: (-len(n), n)) if hits else word), (i, known)
    assert got.filter("text_id = 7").count() == 2


def test_only_places_that_start_like_a_part_number_are_cut(spark):
    texts = spark.createDataFrame([(i, "no such thing here at all " * 3) for i in range(50)], "text_id int, text string").coalesce(1)
    part = spark.createDataFrame([(f"PN-{i}",) for i in range(300)], "part_number string")
    plan = lookup.mentioned_part(texts, part)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan or "Repartition " in plan  # one file of texts is cut by all tasks
    assert "substring(rest" in plan and "AS head" in plan
