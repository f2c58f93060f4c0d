"""Packing against its own rules and against exact search on small inputs."""

from functools import lru_cache

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import packing


def exact(sizes, capacity):
    @lru_cache(maxsize=None)
    def best(rest, rooms):
        if not rest:
            return 0
        s, after = rest[0], rest[1:]
        out = 1 + best(after, tuple(sorted((*rooms, capacity - s))))
        for r in set(rooms):
            if r >= s:
                left = list(rooms)
                left.remove(r)
                out = min(out, best(after, tuple(sorted((*left, r - s)))))
        return out

    return best(tuple(sorted(sizes, reverse=True)), ())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 10), min_size=1, max_size=7))
def test_bound_never_exceeds_the_optimum(sizes):
    best = exact(sizes, 10)
    assert packing.lower_bound(np.array(sizes), 10) <= best
    value, count = np.unique(sizes, return_counts=True)
    assert packing.weighted_bound(value, count, 10) <= best
    place = packing.best_fit(sorted(sizes, reverse=True), 10)
    assert best <= len(set(place)) and (np.bincount(place, weights=sorted(sizes, reverse=True)) <= 10).all()


def test_pack_keeps_every_token(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(x)) for i, x in enumerate(rng.integers(0, 90, 800))] + [(900, 64 * 3), (901, 64 * 2 + 5), (902, 0)]
    counts = spark.createDataFrame(rows, "doc_id long, tokens long")
    windows = spark.createDataFrame([(1, "a", 64), (2, "b", 16), (3, "c", 0), (4, "d", None), (1, "a", 64)], "window_id int, model_name string, capacity_tokens int")
    packed = packing.pack(counts, windows, part_items=60, fan_in=3).toPandas()
    assert set(packed.window_id) == {1, 2}
    for w, capacity in ((1, 64), (2, 16)):
        p = packed[packed.window_id == w]
        assert not p.duplicated(["doc_id", "piece"]).any() and p.groupby("doc_id").tokens.sum().to_dict() == dict(rows)
        assert p.groupby("container").tokens.sum().max() <= capacity
        whole = p.groupby("doc_id").size()
        assert all(whole[d] == max(1, -(-t // capacity)) for d, t in rows)
    cert = {r.window_id: r for r in packing.certificate(counts, windows, packing.pack(counts, windows)).collect()}
    assert all(c.lower_bound <= c.containers <= 1.1 * c.lower_bound + 1 for c in cert.values())


def test_nothing_to_pack(spark):
    counts = spark.createDataFrame([], "doc_id long, tokens long")
    windows = spark.createDataFrame([(1, 8)], "window_id int, capacity_tokens int")
    assert packing.pack(counts, windows).count() == 0
    assert packing.pack(spark.createDataFrame([(1, 5)], "doc_id long, tokens long"), windows.limit(0)).count() == 0


def test_partitions_are_certified_and_tasks_stay_small(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(x)) for i, x in enumerate(rng.integers(20, 60, 3000))]
    counts = spark.createDataFrame(rows, "doc_id long, tokens long")
    windows = spark.createDataFrame([(1, 100)], "window_id int, capacity_tokens int")
    certs: list = []
    packed = packing.pack(counts, windows, part_items=200, fan_in=4, certificates=certs)
    assert packed.select("doc_id").distinct().count() == 3000 and len(certs) > 1
    rounds = [c.collect() for c in certs]
    assert all(r.bound <= r.used for rows in rounds for r in rows) and len(rounds[0]) >= 15 and len(rounds[-1]) < len(rounds[0])
