"""Problem 4: references to records that do not exist at the time of the reference.

The keys of the references and of their parents are encoded to dense integers by one dictionary over both sides. For
every key range and period (month) three sets of these integers are kept as compressed bitmaps: the keys *referenced*,
from the references; and the keys that live during *some* and during *all* of the period, from the parents.

    referenced AND NOT some            orphans, whatever the exact time
    referenced AND some AND NOT all    undecided by the period alone: compared by exact time afterwards
    referenced AND all                 answered

Only bitmaps meet, per range and period; only surviving bits are decoded. A key costs one row per period however often
it is referenced, so a key with a third of all references costs no more than any other; its own references are met
again only if it survives. Parents cost one row per pair of months between which they live.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taintgauge.session import materialise
from taintgauge.sources.tables import table

#: Keys per bitmap.
RANGE = 1 << 16
#: Up to this many keys a container is a sorted array of 16-bit integers, beyond it a bitmap of RANGE bits.
SPARSE = 4096
#: Surviving keys up to which they are broadcast to the references; beyond that they are joined by shuffle.
BROADCAST_KEYS = 200_000


def pack_bits(low: np.ndarray) -> bytes:
    """A compressed container of distinct integers below RANGE: tag 0 and the sorted array, or tag 1 and the bits."""
    low = np.unique(low).astype("<u2")
    if len(low) <= SPARSE:
        return b"\x00" + low.tobytes()
    bits = np.zeros(RANGE, dtype=np.uint8)
    bits[low] = 1
    return b"\x01" + np.packbits(bits, bitorder="little").tobytes()


def _words(packed: bytes | None) -> np.ndarray:
    """The container as RANGE bits in 64-bit words; a missing one is empty."""
    if packed is None:
        return np.zeros(RANGE // 64, dtype="<u8")
    if packed[0] == 1:
        return np.frombuffer(packed, dtype="<u8", offset=1)
    bits = np.zeros(RANGE, dtype=np.uint8)
    bits[np.frombuffer(packed, dtype="<u2", offset=1)] = 1
    return np.packbits(bits, bitorder="little").view("<u8")


def _members(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def and_not(a: bytes | None, b: bytes | None) -> np.ndarray:
    """Members of a that b lacks. Two sparse containers are never expanded."""
    if a is None:
        return np.zeros(0, dtype=np.int64)
    if a[0] == 0 and (b is None or b[0] == 0):
        left = np.frombuffer(a, dtype="<u2", offset=1)
        return left if b is None else np.setdiff1d(left, np.frombuffer(b, dtype="<u2", offset=1), assume_unique=True)
    return _members(_words(a) & ~_words(b))


@dataclass(frozen=True)
class Reference:
    """One reference column: `keys` of the child name rows of the parent by `parent_keys`, at time `at`."""

    child: str
    column: str
    identity: str
    keys: tuple[str, ...]
    at: str
    parent: str
    parent_keys: tuple[str, ...]
    created: str
    deleted: str


#: The references of the domain tables.
REFERENCES = (
    Reference("bag_members", "record_id", "member_id", ("record_id", "source_type"), "added_at", "labelled_records", ("record_id", "source_type"), "created_at", "deleted_at"),
    Reference("bag_members", "bag_id", "member_id", ("bag_id",), "added_at", "bags", ("bag_id",), "created_at", "deleted_at"),
    Reference("method_failure_audit", "seed", "audit_id", ("seed",), "audited_at", "run_seeds", ("seed",), "registered_at", "retired_at"),
)


def _month_number(c) -> F.Column:
    return F.year(c) * 12 + F.month(c) - 1


def _month_start(c) -> F.Column:
    return F.date_trunc("month", c)


def _key(cols) -> F.Column:
    """One string for a key of several columns, each with its length before it; a NULL (never in the named column) is a dash."""
    texts = [F.col(c).cast("string") for c in cols]
    return F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def reference_cells(refs: DataFrame) -> DataFrame:
    """Distinct (key, month) of the references as rows of the dictionary; a NULL month is NEVER."""
    month = F.coalesce("month", F.lit(NEVER))
    return refs.select("key", F.lit(True).alias("child"), month.alias("first"), month.alias("last"), month.alias("full_first"), month.alias("full_last"))


def life_cells(parents: DataFrame) -> DataFrame:
    """Months in which a parent row lives at some time (first to last) and all the time (full_first to full_last).

    A row that is never created (NULL) or is deleted before it is created never lives and gives no cell.
    """
    born, died = _month_number(F.col("created")), _month_number(F.col("deleted"))
    at_start = F.col("created") == _month_start(F.col("created"))
    last = F.when(F.col("deleted").isNull(), F.lit(EVER)).when(F.col("deleted") == _month_start(F.col("deleted")), died - 1).otherwise(died)
    return parents.where("created is not null and (deleted is null or deleted > created)").select(
        "key", F.lit(False).alias("child"), born.alias("first"), last.alias("last"), F.when(at_start, born).otherwise(born + 1).alias("full_first"), F.coalesce(died - 1, F.lit(EVER)).alias("full_last")
    )


def encode_keys(cells: DataFrame) -> DataFrame:
    """`cells` with `slice` and `code`, the dense integer of the key within its slice: one dictionary for both sides.

    The dictionary is dealt by hash into slices of their own numbering; (slice, code) is unique per key, and equal keys
    get equal codes. No key set is gathered anywhere.
    """
    slices = max(SLICES, int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    slice_ = F.pmod(F.xxhash64("key"), F.lit(slices)).cast("int")
    return cells.withColumn("slice", slice_).withColumn("code", F.dense_rank().over(W.partitionBy("slice").orderBy("key")) - 1)


#: Least number of slices of the dictionary; it has as many as there are shuffle partitions, if these are more.
SLICES = 64
#: The month of references without a time, in which no parent lives, and the last month of parents that aren't deleted.
NEVER, EVER = -1, 1 << 30
REFERENCED, SOME, ALL = range(3)


def bitmaps(cells: DataFrame, months: list[int]) -> DataFrame:
    """(slice, range, month, kind, bits): bitmaps of the codes referenced, alive in some and alive in all of each month.

    Built where the rows lie, from runs of one range; a range cut by a file split gives several bitmaps to be joined.
    """
    wanted = np.asarray(sorted(months), dtype=np.int64)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list[np.ndarray] = []
        at: tuple[int, int] | None = None

        def flush() -> Iterator:
            rows = np.concatenate(held, axis=1)
            held.clear()
            child, low = rows[0].astype(bool), rows[1]
            first, last, full_first, full_last = rows[2:, ~child]
            kid_low, kid_month, lives = low[child], rows[2][child], low[~child]
            out: list[tuple[int, int, bytes]] = []
            for m in wanted.tolist():
                for kind, found in ((REFERENCED, kid_low[kid_month == m]), (SOME, lives[(first <= m) & (m <= last)]), (ALL, lives[(full_first <= m) & (m <= full_last)])):
                    if len(found):
                        out.append((m, kind, pack_bits(found)))
            n = len(out)
            yield pa.RecordBatch.from_arrays(
                [pa.array([at[0]] * n, pa.int32()), pa.array([at[1]] * n, pa.int32()), pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary())],
                names=["slice", "range", "month", "kind", "bits"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(7)]
            slice_, range_ = cols[0], cols[1] // RANGE
            rows = np.stack([cols[2], cols[1] % RANGE, *cols[3:]])
            cuts = np.flatnonzero(np.r_[True, (slice_[1:] != slice_[:-1]) | (range_[1:] != range_[:-1])])
            for a, b in zip(cuts, np.r_[cuts[1:], len(slice_)], strict=True):
                here = (int(slice_[a]), int(range_[a]))
                if held and here != at:
                    yield from flush()
                at = here
                held.append(rows[:, a:b])
        if held:
            yield from flush()

    narrow = cells.select("slice", "code", "child", "first", "last", "full_first", "full_last")
    return narrow.mapInArrow(run, "slice int, range int, month int, kind int, bits binary")


def join_bits(packed: list[bytes]) -> bytes | None:
    """One container of the members of all."""
    if len(packed) < 2:
        return packed[0] if packed else None
    if all(p[0] == 0 for p in packed):
        return pack_bits(np.concatenate([np.frombuffer(p, dtype="<u2", offset=1) for p in packed]))
    return pack_bits(_members(np.bitwise_or.reduce([_words(p) for p in packed])))


def orphan_keys(refs: DataFrame, parents: DataFrame, difference: Callable[[bytes | None, bytes | None], np.ndarray] = and_not) -> DataFrame:
    """(key, month, certain) of the references that the bitmaps don't answer; those that aren't certain depend on the exact time.

    refs: key, month (number, NULL without a time). parents: key, created, deleted (NULL: lives on).
    """
    cells = reference_cells(refs).unionByName(life_cells(parents)).distinct()
    cells = materialise(encode_keys(cells), "cells")  # lies by slice, in the order of codes
    months = [r[0] for r in cells.where("child").select("first").distinct().collect()]  # as many as the calendar has

    def survivors(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = [[], [], [], []]
            for s, r, m, *sets in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                referenced, some, whole = (join_bits(x) for x in sets)
                gone = difference(referenced, some)
                unsure = difference(pack_bits(np.setdiff1d(difference(referenced, None), gone)), whole)
                for kind, low in ((True, gone), (False, unsure)):
                    rows[0] += [s] * len(low)
                    rows[1] += (low.astype(np.int64) + r * RANGE).tolist()
                    rows[2] += [m] * len(low)
                    rows[3] += [kind] * len(low)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.bool_())], names=["slice", "code", "month", "certain"])

    sets = bitmaps(cells, months).groupBy("slice", "range", "month").agg(*[F.collect_list(F.when(F.col("kind") == k, F.col("bits"))).alias(f"k{k}") for k in (REFERENCED, SOME, ALL)])
    left = materialise(sets.where("size(k0) > 0").mapInArrow(survivors, "slice int, code int, month int, certain boolean"), "surviving_bits")
    words = cells.where("child").select("slice", "code", F.col("first").alias("month"), "key")
    few = left.count() <= BROADCAST_KEYS
    return materialise(words.join(F.broadcast(left) if few else left, ["slice", "code", "month"]).select("key", "month", "certain"), "orphan_keys")


def orphans(sources: list[tuple[DataFrame, DataFrame, Reference]]) -> DataFrame:
    """(child_table, child_column, child_id, month): references whose parent doesn't exist at their time.

    All references are found together; each is given with its child and parent table. A NULL in the reference column
    isn't a reference. A NULL time is no time at which anything exists: such a reference is an orphan (month NULL).
    Redelivered children come out once. A NULL in another key column equals no parent. Parents with several rows answer
    if one of them lives at the time. Empty tables: no children, no rows; no parents, every reference is an orphan.
    """
    refs = parents = None
    for i, (child, parent, ref) in enumerate(sources):
        own = child.where(F.col(ref.column).isNotNull()).select(
            F.lit(i).alias("ref"), F.col(ref.identity).cast("bigint").alias("child_id"), F.concat(F.lit(f"{i}:"), _key(ref.keys)).alias("key"), F.col(ref.at).alias("at"), _month_number(F.col(ref.at)).alias("month")
        )
        complete = F.lit(True)
        for c in ref.parent_keys:
            complete = complete & F.col(c).isNotNull()
        life = parent.where(complete).select(F.concat(F.lit(f"{i}:"), _key(ref.parent_keys)).alias("key"), F.col(ref.created).alias("created"), F.col(ref.deleted).alias("deleted"))
        refs, parents = (own, life) if refs is None else (refs.unionByName(own), parents.unionByName(life))
    surviving = orphan_keys(refs.select("key", "month"), parents)
    few = surviving.count() <= BROADCAST_KEYS  # beyond that by shuffle, with AQE's skew handling
    on = F.broadcast(surviving) if few else surviving
    met = refs.withColumn("month", F.coalesce("month", F.lit(NEVER))).join(on, ["key", "month"])
    unsure = surviving.where("not certain").select("key").distinct()
    lives = materialise(parents.join(F.broadcast(unsure) if few else unsure, "key", "left_semi"), "lives")
    lives = F.broadcast(lives) if lives.count() <= BROADCAST_KEYS else lives
    # An exact check of those that the month leaves open; the certain ones answer to nothing here.
    answered = (F.col("p.key") == F.col("r.key")) & ~F.col("r.certain") & (F.col("p.created") <= F.col("r.at")) & (F.col("p.deleted").isNull() | (F.col("p.deleted") > F.col("r.at")))
    out = met.alias("r").join(lives.alias("p"), answered, "left_anti")
    name = lambda what: F.array(*[F.lit(getattr(r, what)) for _, _, r in sources])[F.col("ref")]
    return out.select(name("child").alias("child_table"), name("column").alias("child_column"), "child_id", F.date_trunc("month", "at").alias("month")).distinct()


def all_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans(
        [
            (table(spark, sf_dir, r.child, *dict.fromkeys([r.identity, *r.keys, r.at])), table(spark, sf_dir, r.parent, *r.parent_keys, r.created, r.deleted), r)
            for r in REFERENCES
        ]
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference without an answer."""
    return all_orphans(spark, sf_dir).select("child_table", "child_column", "child_id").distinct()


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per table, column and month."""
    return all_orphans(spark, sf_dir).groupBy("child_table", "child_column", "month").agg(F.countDistinct("child_id").alias("orphans"))
