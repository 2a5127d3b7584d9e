import random
from datetime import datetime, timedelta

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from taintgauge.operators.orphans import RANGE, Reference, _members, _words, and_not, join_bits, orphan_keys, orphans, pack_bits

REF = Reference("kids", "k", "id", ("k", "s"), "at", "folks", ("k", "s"), "made", "gone")
KID, FOLK = "id bigint, k string, s string, at timestamp", "k string, s string, made timestamp, gone timestamp"


@given(st.sets(st.integers(0, RANGE - 1), max_size=60), st.sets(st.integers(0, RANGE - 1), max_size=60), st.booleans(), st.booleans())
def test_and_not(a, b, wide_a, wide_b):
    fill = set(range(0, RANGE, 7))
    a, b = a | (fill if wide_a else set()), b | (fill if wide_b else set())
    pack = lambda s: pack_bits(np.array(sorted(s), dtype=np.int64))
    assert set(and_not(pack(a), pack(b)).tolist()) == a - b
    assert set(and_not(pack(a), None).tolist()) == a and len(and_not(None, pack(b))) == 0
    assert set(_members(_words(join_bits([pack(a), pack(b)]))).tolist()) == a | b and join_bits([]) is None


def test_the_rows_come_from_the_bitmaps(spark):
    """Without the AND NOT every referenced key survives; with it only those whose parent is absent, or here in a part of the month."""
    keys = spark.range(3000).selectExpr("cast(id as string) as key", "24300 + cast(id % 3 as int) as month")
    # 24300 is January 2025; every fifth key has no parent, the others live from the start, every seventh dies within 2025-02.
    parents = spark.range(3000).where("id % 5 > 0").selectExpr("cast(id as string) as key", "timestamp'2024-12-05' as created", "case when id % 7 = 0 then timestamp'2025-02-10' end as deleted")
    got = {(int(r["key"]), r["certain"]) for r in orphan_keys(keys, parents).collect()}
    want = {(i, True) for i in range(3000) if i % 5 == 0 or (i % 7 == 0 and i % 3 == 2)} | {(i, False) for i in range(3000) if i % 5 and i % 7 == 0 and i % 3 == 1}
    assert got == want
    blind = orphan_keys(keys, parents, lambda a, b: np.frombuffer(a, dtype="<u2", offset=1) if a else np.zeros(0, np.int64))
    assert blind.where("certain").count() == 3000


def brute(kids, folks):
    return {k[0] for k in kids if k[1] is not None and not any(f[0] == k[1] and f[1] is not None and f[1] == k[2] and f[2] is not None and k[3] is not None and f[2] <= k[3] and (f[3] is None or f[3] > k[3]) for f in folks)}


def test_against_all_pairs(spark):
    random.seed(2)
    base = datetime(2025, 1, 28)
    when = lambda: random.choice([base + timedelta(hours=random.randint(0, 2400)), datetime(2025, random.randint(1, 5), 1)])
    kids = [(i, random.choice([None, "hot", "hot", *(f"k{j}" for j in range(30))]), random.choice(["a", "b", None]), random.choice([when(), when(), when(), None])) for i in range(900)]
    folks = [(random.choice(["hot", *(f"k{j}" for j in range(25))]), random.choice(["a", "b", None]), random.choice([when(), when(), None]), random.choice([None, when()])) for _ in range(120)]
    kdf = spark.createDataFrame(kids + kids[:50], KID).selectExpr("*", "1 as key", "2 as month")
    fdf = spark.createDataFrame(folks, FOLK).selectExpr("*", "'x' as created", "3 as code")
    got = orphans([(kdf, fdf, REF)])
    ids = [r["child_id"] for r in got.collect()]
    assert set(ids) == brute(kids, folks) and len(ids) == len(set(ids))


def test_empty_sides(spark):
    now = datetime(2025, 3, 3)
    kids = spark.createDataFrame([(1, "a", "s", now), (2, None, "s", now), (3, "b", "s", None)], KID)
    none = spark.createDataFrame([], FOLK)
    assert {r["child_id"] for r in orphans([(kids, none, REF)]).collect()} == {1, 3}
    assert orphans([(kids.limit(0), none, REF)]).count() == 0
