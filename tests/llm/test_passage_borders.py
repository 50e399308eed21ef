"""Benchmark passages at the borders of texts that are searched together."""

import random

import pytest

from partloom.llm import decontaminate


def found(texts, ix):
    return decontaminate.search(texts, ix, ix.seen())


@pytest.mark.parametrize("cut", [1, 2, 3])
def test_a_text_that_starts_inside_an_item_keeps_its_hit(prose, cut):
    item = prose(12, 500)[:decontaminate.WINDOW]
    ix = decontaminate.index([(7, item)])
    for width in range(20):  # all places within a band
        clean = "x" * (40 + width)
        held = f"{item[cut:]} behind it"
        alone = found([held], ix)
        assert alone == [[(7, 0, len(item) - cut, cut)]]
        assert found([clean, held, clean], ix) == [[], alone[0], []]


def test_equal_short_texts_side_by_side_each_keep_their_hit():
    ix = decontaminate.index([(3, "quartz rocket")])
    assert found(["quartz rocket"] * 9, ix) == [[(3, 0, 13, 0)]] * 9


def test_a_batch_finds_what_each_text_alone_holds(prose):
    draw = random.Random(23)
    items = [(k, prose(3 + 3 * k, 600 + k)) for k in range(8)]
    ix, texts = decontaminate.index(items), []
    for _ in range(400):
        item = list(draw.choice(items)[1])
        for _ in range(draw.randrange(4)):
            item[draw.randrange(len(item))] = draw.choice("abcdefgh ")
        part = "".join(item)[draw.randrange(5):len(item) - draw.randrange(5)]
        texts.append(draw.choice(["", "a ", prose(3, draw.randrange(99))]) + part + draw.choice(["", " z", prose(2, draw.randrange(99))]))
    assert found(texts, ix) == [found([t], ix)[0] for t in texts]


def test_a_benchmark_of_several_blocks_gives_one_row_a_document(spark, documents, prose, monkeypatch):
    items = [(k, prose(20, 700 + k)) for k in range(12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    held = [(1, f"{items[0][1]} and {items[7][1]}"), (2, " ".join(t for _, t in items)), (2, " ".join(t for _, t in items)), (None, items[3][1]),
            (4, prose(50, 5)), (5, None), (6, items[5][1]), (6, items[6][1])]
    docs = documents(held)
    read = lambda: sorted((tuple(r) for r in decontaminate.leaks(docs, bench).collect()), key=str)
    whole = read()
    assert len(whole) == 6
    monkeypatch.setattr(decontaminate, "BLOCK", 400)
    assert len(list(decontaminate._blocks(bench))) > 2
    assert read() == whole
    assert decontaminate.decontaminated(docs, bench).count() == 2
