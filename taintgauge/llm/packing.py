"""Problem 7: packing documents into containers of fixed capacity.

Documents only differ by their size here, and sizes are bounded by the capacity. The plan is therefore made on the
histogram of sizes (at most one entry per size up to the capacity, however many documents there are):

* documents are routed to tiers, the smallest context size that holds them; one longer than the longest context is
  cut into full containers and a rest, nothing else is cut;
* each tier is packed by best fit, longest sizes first, on counts instead of single documents; the gaps of the longer
  tiers are then filled from the histograms of the shorter ones, largest fitting size first, before those tiers open
  containers of their own;
* containers are dealt in serpentine order of their attention cost to step groups, so that the groups of a step are
  balanced.

The plan maps (size, rank of the document among those of that size) to a container by intervals. Ranks come from a
window over (size, slice of the key), so no size, however frequent, is ever ranked by one task.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taintgauge.llm.tokens import token_counts
from taintgauge.session import materialise
from taintgauge.sources.tables import table

#: Least number of slices by which documents of one size are ranked; there are as many as shuffle partitions, if these are more.
SLICES = 64
#: Tokens that one step works on, in containers of the longest context.
STEP_CONTAINERS = 8


@dataclass
class Shape:
    """`count` containers that hold the same sizes: `sizes` maps size → documents of it in each."""

    capacity: int
    count: int
    room: int
    sizes: dict[int, int] = field(default_factory=dict)

    def cost(self) -> int:
        return sum(n * s * s for s, n in self.sizes.items())


class _Gaps:
    """Shapes by room left, for best fit."""

    def __init__(self) -> None:
        self.rooms: list[int] = []
        self.by_room: dict[int, list[Shape]] = {}

    def put(self, shape: Shape) -> None:
        if shape.room not in self.by_room:
            insort(self.rooms, shape.room)
            self.by_room[shape.room] = []
        self.by_room[shape.room].append(shape)

    def take(self, size: int) -> Shape | None:
        at = bisect_left(self.rooms, size)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        shape = self.by_room[room].pop()
        if not self.by_room[room]:
            del self.by_room[room]
            self.rooms.pop(at)
        return shape

    def all(self) -> list[Shape]:
        return [s for room in self.rooms for s in self.by_room[room]]


def _fill(gaps: _Gaps, size: int, left: int) -> int:
    """Put up to `left` documents of `size` into the tightest gaps; returns how many remain."""
    while left and (shape := gaps.take(size)):
        each = shape.room // size
        full, rest = divmod(left, each)
        used = min(full, shape.count)
        if used:
            gaps.put(Shape(shape.capacity, used, shape.room - each * size, {**shape.sizes, size: shape.sizes.get(size, 0) + each}))
            left -= used * each
        if used < shape.count:
            over = shape.count - used
            if rest:
                gaps.put(Shape(shape.capacity, 1, shape.room - rest * size, {**shape.sizes, size: shape.sizes.get(size, 0) + rest}))
                left -= rest
                over -= 1
            if over:
                gaps.put(Shape(shape.capacity, over, shape.room, shape.sizes))
    return left


def plan_shapes(histogram: dict[int, int], tiers: list[tuple[int, int]]) -> list[Shape]:
    """Container shapes for a histogram of sizes.

    tiers: (largest size routed to the tier, capacity of its containers); sizes of 0 need no room and are left out.
    """
    left = {s: n for s, n in histogram.items() if s > 0 and n > 0}
    tiers = sorted(tiers)
    done: list[Shape] = []
    for at in range(len(tiers) - 1, -1, -1):
        top, capacity = tiers[at]
        floor = tiers[at - 1][0] if at else 0
        gaps = _Gaps()
        for size in sorted((s for s in left if floor < s <= top), reverse=True):
            n = _fill(gaps, size, left.pop(size))
            if n:
                each = capacity // size
                full, rest = divmod(n, each)
                if full:
                    gaps.put(Shape(capacity, full, capacity - each * size, {size: each}))
                if rest:
                    gaps.put(Shape(capacity, 1, capacity - rest * size, {size: rest}))
        for size in sorted(left, reverse=True):
            if not gaps.rooms or gaps.rooms[-1] < min(left):
                break
            n = _fill(gaps, size, left[size])
            if n:
                left[size] = n
            else:
                del left[size]
        done += gaps.all()
    return done


@dataclass
class Plan:
    """Intervals of (size, rank) → container, and what each container belongs to."""

    start_size: np.ndarray
    start_rank: np.ndarray
    each: np.ndarray
    first: np.ndarray
    capacity_of: np.ndarray  # by shape, with `shape_first`
    shape_first: np.ndarray
    containers: int
    groups: dict[int, tuple[int, int, int]]  # capacity → (first container, containers, groups)

    def locate(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Container, its capacity and its step group for documents given by size and rank (from 0)."""
        if not len(self.start_size):
            zero = np.zeros(len(size), dtype=np.int64)
            return zero, zero, zero
        key = size.astype(np.int64) << 40 | rank.astype(np.int64)
        at = np.searchsorted(self.start_size << 40 | self.start_rank, key, side="right") - 1
        container = self.first[at] + (rank - self.start_rank[at]) // np.maximum(self.each[at], 1)
        container = np.where(size == 0, rank % self.containers, container)
        capacity = self.capacity_of[np.searchsorted(self.shape_first, container, side="right") - 1]
        group = np.zeros(len(size), dtype=np.int64)
        for cap, (first, _, groups) in self.groups.items():
            own = capacity == cap
            turn, place = np.divmod(container[own] - first, groups)
            group[own] = np.where(turn % 2 == 0, place, groups - 1 - place)
        return container, capacity, group


def make_plan(histogram: dict[int, int], tiers: list[tuple[int, int]], step_tokens: int) -> Plan:
    shapes = plan_shapes(histogram, tiers)
    shapes.sort(key=lambda s: (-s.capacity, -s.cost(), s.room))
    used: dict[int, int] = {}
    rows, firsts, caps, at = [], [], [], 0
    span: dict[int, list[int]] = {}
    for shape in shapes:
        firsts.append(at)
        caps.append(shape.capacity)
        span.setdefault(shape.capacity, [at, 0])[1] += shape.count
        for size, each in shape.sizes.items():
            rows.append((size, used.get(size, 0), each, at))
            used[size] = used.get(size, 0) + each * shape.count
        at += shape.count
    if rows and histogram.get(0):
        rows.append((0, 0, 1, 0))
    table_ = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    groups = {cap: (first, n, -(-n // max(1, step_tokens // cap))) for cap, (first, n) in span.items()}
    return Plan(*(np.ascontiguousarray(table_[:, i]) for i in range(4)), np.array(caps, dtype=np.int64), np.array(firsts, dtype=np.int64), max(at, 1), groups)


def _items(sizes: DataFrame, key: str, layouts: list[tuple[int, int]]) -> DataFrame:
    """One row per layout and piece: a document longer than the layout's longest context gives several pieces."""
    spark = sizes.sparkSession
    lay = spark.createDataFrame(layouts, "layout int, longest int")
    slices = max(SLICES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pieces = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.col("longest")).cast("int"))
    return (
        sizes.crossJoin(F.broadcast(lay))  # at most one row per row of context_windows, a fixed table
        .withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
        .withColumn("first_token", F.col("piece").cast("bigint") * F.col("longest"))
        .withColumn("size", F.least(F.col("longest").cast("bigint"), F.col("n_tokens") - F.col("first_token")))
        .withColumn("slice", F.pmod(F.xxhash64(key, "piece"), F.lit(slices)).cast("int"))
        .select("layout", key, "piece", "first_token", "size", "slice")
    )


def pack(sizes: DataFrame, key: str, layouts: dict[int, list[tuple[int, int]]], step_tokens: int) -> DataFrame:
    """(layout, key, piece, first_token, n_tokens, capacity, container_id, step_group).

    layouts: number → tiers as in `plan_shapes`. Every document of `sizes` (key, n_tokens) comes out in every layout,
    whole if its size is at most the layout's longest context. Documents of size 0 (empty or NULL texts, NULL sizes)
    take no room and are spread over the containers; a NULL key stays NULL; repeated rows are packed as often as
    they come; an empty table gives no rows.
    """
    spark = sizes.sparkSession
    sizes = sizes.select(key, F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"))
    items = _items(sizes, key, [(k, max(t for t, _ in tiers)) for k, tiers in layouts.items()])
    by_slice = materialise(items.groupBy("layout", "size", "slice").agg(F.count("*").alias("n")), "sizes_by_slice")
    # At most layouts x sizes rows, whatever the number of documents: the capacity bounds the histogram.
    histograms: dict[int, dict[int, int]] = {k: {} for k in layouts}
    for r in by_slice.groupBy("layout", "size").agg(F.sum("n").alias("n")).toLocalIterator():
        histograms[r["layout"]][r["size"]] = r["n"]
    plans = {k: make_plan(histograms[k], tiers, step_tokens) for k, tiers in layouts.items()}
    shared = spark.sparkContext.broadcast(plans)  # bounded by the capacity: a few intervals per size

    before = W.partitionBy("layout", "size").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = by_slice.select("layout", "size", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = W.partitionBy("layout", "size", "slice").orderBy(key, "piece")
    ranked = items.withColumn("own", F.row_number().over(within) - 1).join(offsets, ["layout", "size", "slice"])
    ranked = ranked.select("layout", key, "piece", "first_token", F.col("size").alias("n_tokens"), (F.col("before") + F.col("own")).alias("rank"))

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            layout, size, rank = (batch.column(i).to_numpy() for i in (0, 4, 5))
            container, capacity, group = (np.zeros(len(size), dtype=np.int64) for _ in range(3))
            for k in np.unique(layout):
                own = layout == k
                container[own], capacity[own], group[own] = shared.value[k].locate(size[own], rank[own])
            cols = [batch.column(i) for i in range(5)] + [pa.array(capacity, pa.int64()), pa.array(container, pa.int64()), pa.array(group, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    names = ["layout", key, "piece", "first_token", "n_tokens", "capacity", "container_id", "step_group"]
    kind = ranked.schema[key].dataType.simpleString()
    return ranked.mapInArrow(place, f"layout int, `{key}` {kind}, piece int, first_token bigint, n_tokens bigint, capacity bigint, container_id bigint, step_group bigint")


def _windows(spark: SparkSession, sf_dir: str) -> list[tuple[int, int]]:
    rows = table(spark, sf_dir, "context_windows", "window_id", "capacity_tokens").where("capacity_tokens > 0").distinct().collect()  # a fixed table of 4 rows
    return sorted((r["window_id"], r["capacity_tokens"]) for r in rows)


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(token_counts(table(spark, sf_dir, "documents"), "doc_id", "text"), "sizes")


def _each_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = _windows(spark, sf_dir)
    caps = [c for _, c in windows]
    layouts = {w: [(t, c) for t in sorted({*caps}) if t <= c] for w, c in windows}
    return pack(_sizes(spark, sf_dir), "doc_id", layouts, STEP_CONTAINERS * max(caps, default=1)).withColumnRenamed("layout", "window_id")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each context window all documents in containers of its capacity."""
    return _each_window(spark, sf_dir)


def p7_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents once, in containers of the tier they are routed to or in a gap of a longer tier."""
    windows = _windows(spark, sf_dir)
    caps = sorted({c for _, c in windows})
    return pack(_sizes(spark, sf_dir), "doc_id", {0: [(c, c) for c in caps]}, STEP_CONTAINERS * max(caps, default=1)).drop("layout")


def fill_report(packed: DataFrame, *by: str) -> DataFrame:
    """Containers, tokens and the share of space used, per capacity."""
    each = packed.groupBy(*by, "capacity", "container_id").agg(F.sum("n_tokens").alias("used"))
    return each.groupBy(*by, "capacity").agg(
        F.count("*").alias("containers"),
        F.sum("used").alias("tokens"),
        F.max("used").alias("fullest"),
        F.round(F.sum("used") / (F.count("*") * F.col("capacity")), 6).alias("fill"),
        F.ceil(F.sum("used") / F.col("capacity")).alias("least_containers"),
    )


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each window are."""
    return fill_report(_each_window(spark, sf_dir), "window_id")


def p7_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per window: documents packed and left out, pieces met more than once, containers over capacity, and documents cut that would fit."""
    packed = materialise(_each_window(spark, sf_dir), "packed")
    windows = spark.createDataFrame(_windows(spark, sf_dir), "window_id int, room bigint")
    each = packed.groupBy("window_id", "doc_id").agg(F.count("*").alias("pieces"), F.countDistinct("piece").alias("distinct_pieces"), F.sum("n_tokens").alias("n_tokens"))
    docs = each.join(F.broadcast(windows), "window_id").groupBy("window_id").agg(
        F.count("*").alias("documents"), F.count_if(F.col("pieces") > F.col("distinct_pieces")).alias("repeated"), F.count_if((F.col("pieces") > 1) & (F.col("n_tokens") <= F.col("room"))).alias("cut_needlessly")
    )
    full = packed.groupBy("window_id", "capacity", "container_id").agg(F.sum("n_tokens").alias("used")).groupBy("window_id").agg(F.count_if(F.col("used") > F.col("capacity")).alias("over_capacity"))
    whole = table(spark, sf_dir, "documents", "doc_id").agg(F.countDistinct("doc_id").alias("all_documents"))
    every = windows.select("window_id").join(docs, "window_id", "left").join(full, "window_id", "left").crossJoin(F.broadcast(whole))  # one row
    cols = ["documents", "repeated", "cut_needlessly", "over_capacity"]
    return every.na.fill(0, cols).select("window_id", *cols, (F.col("all_documents") - F.col("documents")).alias("left_out"))
