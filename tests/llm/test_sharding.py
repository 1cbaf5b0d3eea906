"""Shards: every row once, gapless slots, sizes near equal, texts together wherever one fits into a shard."""

import collections
import random
import zlib

import pytest
from test_operators import EDGE, frame

from spanweave.llm import sharding


def size(t):
    return len((t or "").encode()) + 16


def check(spark, rows, shards, near):
    got = sharding.shard_by_bytes(frame(spark, rows).repartition(7), shards).collect()
    crc = lambda t: zlib.crc32((t or "").encode())
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter((i, size(t), crc(t)) for i, t in rows)
    assert all(r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards for r in got)
    slots, used, places = collections.defaultdict(list), collections.Counter({s: 0 for s in range(shards)}), collections.defaultdict(collections.Counter)
    for r in got:
        slots[r.shard].append(r.slot)
        used[r.shard] += r.size
        places[r.text_crc32, r.size][r.shard] += r.size
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    mean = sum(used.values()) / shards
    assert max(used.values()) <= mean * (1 + near) and min(used.values()) >= mean * (1 - near), (mean, sorted(used.values()))
    for of in places.values():
        assert len(of) <= max(1, -(-sum(of.values()) // mean)), (mean, of)


def test_identical_rows(spark):
    rng = random.Random(1)
    check(spark, [(5, "same")] * 20_000 + [(i, "x" * rng.randrange(400)) for i in range(2_000)], 40, 0.03)


def test_null_ids_and_equal_texts(spark):
    rng = random.Random(2)
    texts = [f"t{i} " * rng.randrange(1, 60) for i in range(3_000)]
    check(spark, [(None, "")] * 3_000 + [(i, rng.choice(texts)) for i in range(9_000)] + [(None, None)] * 500, 40, 0.03)


def test_groups_of_large_texts(spark):
    """Texts with copies that fill a part of a shard, a shard, and some shards; a few long records."""
    rng = random.Random(3)
    rows = [(i, f"{i} " * rng.randrange(1, 40)) for i in range(3_000)]
    for k, copies in enumerate((3, 10, 10, 30, 200, 900)):
        rows += [(10_000 + 1_000 * k + c, f"group {k} " * 20) for c in range(copies)]
    rows += [(i, f"{i}" * 1_500) for i in range(90_000, 90_005)]
    check(spark, rows, 20, 0.03)


@pytest.mark.parametrize("rows", [EDGE, [(1, "one")], [(None, None)] * 3, []])
def test_small_tables(spark, rows):
    got = sharding.shard_by_bytes(frame(spark, rows)).collect()
    assert collections.Counter((r.doc_id, r.size) for r in got) == collections.Counter((i, size(t)) for i, t in rows)
    assert len({(r.shard, r.slot) for r in got}) == len(rows)


def test_long_records_among_short_ones(spark):
    """Records of half a shard leave the emptiest shards to the others."""
    rows = [(i, "l" * 50_000 + str(i)) for i in range(6)] + [(i, "s" * 90 + str(i)) for i in range(100, 8_100)]
    check(spark, rows, 10, 0.02)
