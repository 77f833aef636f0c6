import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inspectra.llm import packing as p


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80), st.just(50))
def test_every_item_is_placed_once_and_fits(sizes, capacity):
    where, used = p.sum_of_squares(sizes, capacity)
    assert len(where) == len(sizes) and all(0 < u <= capacity for u in used)
    assert [sum(s for s, w in zip(sizes, where) if w == b) for b in range(len(used))] == list(used)


def test_each_step_has_the_least_sum_of_squares():
    capacity, counts, gaps = 10, {}, {}
    sizes = [3, 7, 4, 4, 6, 2, 5, 5, 8, 1, 9, 3, 3]
    where, _ = p.sum_of_squares(sizes, capacity)
    total = lambda c: sum(v * v for v in c.values())
    for s, b in zip(sizes, where):
        options = {}
        for g in {capacity} | {g for g, n in counts.items() if n and g >= s}:
            c = dict(counts)
            if g != capacity or gaps.get(b) == capacity:
                c[g] = c.get(g, 0) - (g != capacity)
            if g - s:
                c[g - s] = c.get(g - s, 0) + 1
            options[g] = total(c)
        g = gaps.get(b, capacity)
        assert options[g] == min(options.values())
        if g != capacity:
            counts[g] -= 1
        gaps[b] = g - s
        if g - s:
            counts[g - s] = counts.get(g - s, 0) + 1


def test_round_trip_over_kinds_and_groups(spark):
    sizes = [0, 1, 5, 10, 11, 25, 99, None, 10, 3, 3, 3, 7]
    items = spark.createDataFrame([(i % 9, s, "clash") for i, s in enumerate(sizes)], "item long, size long, kind string")
    kinds = spark.createDataFrame([("small", 10), ("large", 40), ("none", None), ("zero", 0)], "k string, cap int")
    got = p.pack(items, kinds, item="item", size="size", kind="k", capacity="cap", group_items=4).collect()
    for kind, cap in (("small", 10), ("large", 40)):
        own = [r for r in got if r["container_kind"] == kind]
        assert sum(r["size"] for r in own) == sum(s or 0 for s in sizes)
        fill = {}
        for r in own:
            assert (r["container_id"] is None) == (r["size"] == 0)
            if r["size"]:
                fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["size"]
        assert max(fill.values()) <= cap
        cut = [r for r in own if r["part_no"] > 0]
        assert {r["item"] for r in cut} == {i % 9 for i, s in enumerate(sizes) if s and s > cap}
    assert {r["container_kind"] for r in got} == {"small", "large"}


def test_empty(spark):
    items = spark.createDataFrame([], "item long, size long")
    kinds = spark.createDataFrame([("small", 10)], "k string, cap int")
    assert p.pack(items, kinds, item="item", size="size", kind="k", capacity="cap").count() == 0
    assert p.pack(items, kinds.limit(0), item="item", size="size", kind="k", capacity="cap").count() == 0


@pytest.mark.skipif(not os.path.exists(p.VOCABULARY), reason="no vocabulary here")
def test_tokens_of_long_texts_add_up(spark, monkeypatch):
    enc = p.encoder()
    text = "Guests at the counter noticed nothing, said Zoë. " * 300
    monkeypatch.setattr(p, "PIECE_CHARS", 100)
    assert "".join(p.text_pieces(text)) == text and len(p.text_pieces(text)) > 50
    assert sum(len(enc.encode_ordinary(x)) for x in p.text_pieces(text)) == len(enc.encode_ordinary(text))
    df = spark.createDataFrame([(text,), ("",), (None,), ("one two",)], "t string")
    assert [r[0] for r in df.select(p.token_count(F.col("t"))).collect()] == [len(enc.encode_ordinary(text)), 0, 0, 2]


def test_groups_do_not_hang_on_the_order_of_rows(spark, rows):
    items = [(i // 2, 1 + (i * 7) % 30) for i in range(60)]
    kinds = spark.createDataFrame([("small", 10)], "k string, cap int")
    packed = lambda order, parts: rows(p.pack(spark.createDataFrame(order, "item long, size long").repartition(parts), kinds, item="item", size="size", kind="k", capacity="cap", group_items=10))
    assert packed(items, 1) == packed(items[::-1], 5)
