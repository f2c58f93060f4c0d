"""Documents into fixed-capacity containers by bound-certified repacking.

Items are spread over partitions at random and packed there by best-fit decreasing. Dual feasible
functions give each partition a lower bound on its containers; a partition that meets it is certified.
Partitions with a gap release their least filled containers, and every partition the containers that are
half empty; released items of neighbouring partitions are exchanged and packed again, until one partition a
window is left. A document is split only if it alone exceeds the capacity: its full pieces fill containers
by themselves and only the rest is packed. A rerun is deterministic.

Defined results: a document of 0 tokens takes a place but no room; null texts have 0 tokens; windows with
null or non-positive capacity are left out; equal sizes are placed by id; no documents give no containers.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import cut

STATE = "window_id int, capacity bigint, part int, container string, doc_id bigint, piece int, tokens bigint, loose boolean, bound bigint, used bigint"
#: How many of the least filled containers a partition releases for each container above its bound.
GAP_RELEASE = 4


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The best of three families of dual feasible functions over the sizes."""
    if not len(sizes) or not sizes.sum():
        return int(len(sizes) > 0)
    value, count = np.unique(sizes, return_counts=True)
    best = -(-int((value * count).sum()) // capacity)
    for a in value[(value > 0) & (value <= capacity // 2)]:  # large items fill a container, small ones vanish
        big, mid = value > capacity - a, (value >= a) & (value <= capacity - a)
        best = max(best, int(count[big].sum()) - (-int((value * count)[mid].sum()) // capacity))
    for k in range(2, 20):  # rounding to multiples of 1/k
        x = (k + 1) * value
        scaled = np.where(x % capacity == 0, value * k, (x // capacity) * capacity)
        best = max(best, -(-int((scaled * count).sum()) // (capacity * k)))
    return best


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """Container number of each size; sizes must come in falling order."""
    rooms: list[int] = []  # distinct free rooms, sorted
    open_: dict[int, list[int]] = {}
    place, n = [], 0
    for s in sizes:
        at = bisect_left(rooms, s)
        if at == len(rooms):
            box, room = n, capacity
            n += 1
        else:
            room = rooms[at]
            box = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
        left = room - s
        if left in open_:
            open_[left].append(box)
        else:
            open_[left] = [box]
            insort(rooms, left)
        place.append(box)
    return place


def _packed(round_: int):
    def pack(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        capacity = int(items["capacity"].iloc[0])
        box = np.array(best_fit(items["tokens"].tolist(), capacity))
        fill = np.bincount(box, weights=items["tokens"])
        bound = lower_bound(items["tokens"].to_numpy(), capacity)
        gap = len(fill) - bound
        loose = fill * 2 <= capacity
        if gap > 0:  # what lies above the bound can be saved only out of the least filled containers
            loose[np.argsort(fill, kind="stable")[: GAP_RELEASE * gap + 1]] = True
            loose &= fill < capacity
        items["loose"] = loose[box]
        items["container"] = [f"{key[0]}-{round_}-{key[1]}-{b}" for b in box]
        items["bound"] = bound
        items["used"] = len(fill)
        return items[["window_id", "capacity", "part", "container", "doc_id", "piece", "tokens", "loose", "bound", "used"]]

    return pack


def pieces(counts: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_id, capacity, doc_id, piece, tokens): a document over the capacity is cut into full pieces and a rest.

    Each document meets each container size, as both are asked for; the sizes are a list on every row, so that
    nothing is joined.
    """
    sizes = windows.filter("capacity_tokens > 0").select("window_id", F.col("capacity_tokens").cast("bigint").alias("capacity")).distinct().collect()
    if not sizes:
        return counts.select(F.lit(0).alias("window_id"), F.lit(0).cast("bigint").alias("capacity"), "doc_id", F.lit(0).alias("piece"), "tokens").limit(0)
    each = F.explode(F.array(*(F.struct(F.lit(r.window_id).alias("window_id"), F.lit(r.capacity).cast("bigint").alias("capacity")) for r in sizes)))
    full = F.expr("cast(floor(tokens / capacity) as int)")
    rest = F.col("tokens") % F.col("capacity")
    parts = F.explode(F.expr("sequence(0, greatest(full - if(rest = 0 and full > 0, 1, 0), 0))"))
    cut_ = counts.select(each.alias("w"), "doc_id", "tokens").select("w.window_id", "w.capacity", "doc_id", "tokens")
    cut_ = cut_.withColumn("full", full).withColumn("rest", rest).withColumn("piece", parts)
    return cut_.select("window_id", "capacity", "doc_id", "piece", F.when(F.col("piece") < F.col("full"), F.col("capacity")).otherwise(F.col("rest")).alias("tokens"))


def pack(counts: DataFrame, windows: DataFrame, part_items: int = 20_000, fan_in: int = 8, certificates: list | None = None) -> DataFrame:
    """(window_id, container, doc_id, piece, tokens) from (doc_id, tokens).

    ``part_items`` bounds what one task packs. After a round, the loose items of ``fan_in`` neighbouring
    partitions meet in one, in as many as their number asks for; rounds end with one partition a window, or
    when partitions no longer become fewer. ``certificates`` receives (window_id, part, bound, used) a round.
    """
    items = cut(pieces(counts, windows))
    full = items.filter(F.col("tokens") == F.col("capacity")).withColumn("container", F.concat_ws("-", "window_id", F.lit("full"), "doc_id", "piece"))
    rest = items.filter(F.col("tokens") < F.col("capacity"))
    most = rest.groupBy("window_id").count().agg(F.max("count")).first()[0] or 0
    parts, round_, done = max(1, -(-most // part_items)), 0, [full.select("window_id", "container", "doc_id", "piece", "tokens")]
    now = rest.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
    while True:
        now = now.withColumns({"container": F.lit(""), "loose": F.lit(False), "bound": F.lit(0).cast("bigint")})
        state = cut(now.groupBy("window_id", "part").applyInPandas(_packed(round_), STATE))
        if certificates is not None:
            certificates.append(state.select(F.lit(round_).alias("round"), "window_id", "part", "bound", "used").distinct())
        loose = state.filter("loose").groupBy("window_id").count().agg(F.max("count")).first()[0] or 0
        fewer = max(-(-parts // fan_in), -(-loose // part_items))
        last = parts == 1 or not loose or fewer >= parts
        kept = state if last else state.filter(~F.col("loose"))
        done.append(kept.select("window_id", "container", "doc_id", "piece", "tokens"))
        if last:
            break
        now = state.filter("loose").withColumn("part", F.floor(F.col("part") * fewer / parts).cast("int")).select("window_id", "capacity", "doc_id", "piece", "tokens", "part")
        parts, round_ = fewer, round_ + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def certificate(counts: DataFrame, windows: DataFrame, packed: DataFrame) -> DataFrame:
    """(window_id, capacity, containers, lower_bound, tokens): what was used against the bound over all items.

    The bound needs only how often each size occurs, at most capacity rows a window.
    """
    sizes = pieces(counts, windows).groupBy("window_id", "capacity", "tokens").agg(F.count("*").alias("n"))

    def bound(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        capacity = int(key[1])
        return pd.DataFrame({"window_id": [key[0]], "capacity": [capacity], "lower_bound": [weighted_bound(rows["tokens"].to_numpy(), rows["n"].to_numpy(), capacity)], "tokens": [int((rows["tokens"] * rows["n"]).sum())]})

    bounds = sizes.groupBy("window_id", "capacity").applyInPandas(bound, "window_id int, capacity bigint, lower_bound bigint, tokens bigint")
    used = packed.groupBy("window_id").agg(F.countDistinct("container").alias("containers"))
    return bounds.join(used, "window_id")


def weighted_bound(value: np.ndarray, count: np.ndarray, capacity: int) -> int:
    """``lower_bound`` over sizes with their counts."""
    whole = count[value == capacity].sum()
    keep = (value > 0) & (value < capacity)
    value, count = value[keep], count[keep]
    order = np.argsort(value)
    value, count = value[order], count[order]
    if not len(value):
        return int(whole)
    best = -(-int((value * count).sum()) // capacity)
    for a in value[value <= capacity // 2]:
        big, mid = value > capacity - a, (value >= a) & (value <= capacity - a)
        best = max(best, int(count[big].sum()) - (-int((value * count)[mid].sum()) // capacity))
    for k in range(2, 20):
        x = (k + 1) * value
        scaled = np.where(x % capacity == 0, value * k, (x // capacity) * capacity)
        best = max(best, -(-int((scaled * count).sum()) // (capacity * k)))
    return int(whole) + best
