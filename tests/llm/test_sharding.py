"""Shard placement against a slot-by-slot simulation."""

import struct

import pytest
import xxhash

from quarry.llm.sharding import lookup_table, place, shard_sizes

NAMES = [f"s{i}" for i in range(7)]


def simulate(names, slots, weights=None):
    """Every shard's preference order written out; the shards take turns, and
    in its turn a shard crosses out what is taken until a slot is free."""
    orders = []
    for name in names:
        start, stride = xxhash.xxh3_64_intdigest(name, seed=1) % slots, xxhash.xxh3_64_intdigest(name, seed=2) % (slots - 1) + 1
        order = [(start + j * stride) % slots for j in range(slots)]
        assert sorted(order) == list(range(slots))  # a permutation
        orders.append(order[::-1])
    table = {}
    turns = [k for k, w in enumerate(weights or [1] * len(names)) for _ in range(w)]
    while True:
        for k in turns:
            slot = orders[k].pop()
            while slot in table:
                slot = orders[k].pop()
            table[slot] = names[k]
            if len(table) == slots:
                return [table[i] for i in range(slots)]


@pytest.mark.parametrize("names, slots, weights", [
    (NAMES, 101, None), (NAMES, 7, None), (["only"], 13, None), (NAMES[:3], 211, [3, 1, 2]), ([f"x{i}" for i in range(40)], 1009, None)])
def test_every_slot(names, slots, weights):
    assert [names[k] for k in lookup_table(names, slots, weights)] == simulate(names, slots, weights)


def test_every_row(spark):
    """Spark's xxhash64 of a long is XXH64 of its eight bytes with seed 42."""
    table = simulate(NAMES, 1009)
    got = place(spark.createDataFrame([(i,) for i in range(-300, 300)], "doc_id long"), ["doc_id"], NAMES, 1009).collect()
    for r in got:
        h = xxhash.xxh64_intdigest(struct.pack("<q", r.doc_id), 42)
        h -= (h >> 63) << 64
        assert r.slot == h % 1009 and r.shard == table[r.slot]


def test_keys_with_the_names_of_the_result(spark):
    df = spark.createDataFrame([(1, "a", 2), (3, "b", None)], "slot int, shard string, `a.b` int")
    out = place(df, ["slot", "shard", "a.b"], NAMES, 101)
    assert out.columns == ["key_slot", "key_shard", "a.b", "slot", "shard"]
    assert {(r.key_slot, r.key_shard, r["a.b"]) for r in out.collect()} == {(1, "a", 2), (3, "b", None)}


def test_table_is_full_and_even():
    own = lookup_table(NAMES, 1009)
    sizes = [int((own == k).sum()) for k in range(7)]
    assert sum(sizes) == 1009 and max(sizes) - min(sizes) <= 1
    double = lookup_table(NAMES, 1009, [2, 1, 1, 1, 1, 1, 1])
    assert abs(int((double == 0).sum()) - 2 * 1009 // 8) <= 2


def test_few_slots_move():
    a, b = lookup_table(NAMES, 10007), lookup_table(NAMES[:-1], 10007)
    stayed = [(x, y) for x, y in zip(a.tolist(), b.tolist()) if x != 6]
    assert sum(x != y for x, y in stayed) < 0.15 * len(stayed)


@pytest.mark.parametrize("shards, slots", [([], 7), (["a", "a"], 7), (["a"], 8)])
def test_bad_parameters(shards, slots):
    with pytest.raises(ValueError):
        lookup_table(shards, slots)


def test_place(spark):
    rows = [(i, f"t{i}", "x") for i in range(500)] + [(3, "t3", "x")] * 2 + [(None, f"n{i}", "x") for i in range(300)] + [(None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    out = place(df, ["doc_id"], NAMES, 1009, spread=["text"])
    got = out.collect()
    own = lookup_table(NAMES, 1009)
    assert len(got) == len(rows) and out.columns == ["doc_id", "slot", "shard"]
    assert all(r.shard == NAMES[own[r.slot]] for r in got)
    assert len({r.shard for r in got if r.doc_id == 3}) == 1
    assert len({r.shard for r in got if r.doc_id is None}) > 3
    assert sum(r.n_rows for r in shard_sizes(out).collect()) == len(rows)
    assert place(df.limit(0), ["doc_id"], NAMES, 1009).count() == 0
