import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from taintgauge.llm import digests, encoding, garble, packing, sampling, tokens
from taintgauge.llm.bpe import encoder_of

TOKENIZER = os.path.join(tokens.TOKENIZERS, "byte_bpe_50k.json")
DATA = "/root/testdata/sf0.01"
has_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="test data absent")
has_vocabulary = pytest.mark.skipif(not os.path.isfile(TOKENIZER), reason="vocabulary absent")


# Encoding


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    return t


TEXTS = st.text(alphabet=st.sampled_from(list("abcdeXYZ 01239'stll  \n\t\r.,-éß中文字ﬁ½²Ⅷ—…‍👩🔬\x1c\x1f\x85\xa0​한שم<|>")), max_size=60)


@has_vocabulary
@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_ids_are_the_public_ones(public, text):
    enc = encoder_of(tokens.vocabulary_bytes())
    ids = enc.ids(text)
    assert ids == public.encode(text, add_special_tokens=False).ids
    assert enc.vocabulary.decode(ids) == text


@has_vocabulary
def test_every_token_encodes_to_itself():
    v = encoder_of(tokens.vocabulary_bytes()).vocabulary
    assert all(v.encode_piece(raw) == [t] for t, raw in random.Random(1).sample(sorted(v.token_bytes.items()), 4000))


def by_the_merges(model, text):
    """The definition: of all pairs the one of least rank is merged, the leftmost first, until none is left."""
    ranks = {tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
    parts = list(text)
    while pairs := [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]:
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [model["vocab"][p] for p in parts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=14), st.lists(st.text("abc", min_size=1, max_size=14), min_size=1, max_size=6))
def test_any_vocabulary_with_tokens_never_made(choices, texts):
    """Random merges, among them tokens that their own bytes never yield, and a token without any merge."""
    import json

    from taintgauge.llm.bpe import Vocabulary

    tokens_ = ["a", "b", "c"]
    merges = []
    for i, j in choices:
        left, right = tokens_[i % len(tokens_)], tokens_[j % len(tokens_)]
        if len(left + right) <= 6 and f"{left} {right}" not in merges:
            merges.append(f"{left} {right}")
            if left + right not in tokens_:
                tokens_.append(left + right)
    model = {"vocab": {t: i for i, t in enumerate(tokens_)}, "merges": merges}
    if "cab" not in tokens_:
        model["vocab"]["cab"] = len(tokens_)
    v = Vocabulary(json.dumps({"model": model}).encode())
    for text in texts:
        assert v.encode_piece(text.encode()) == by_the_merges(model, text), (model, text)


@has_vocabulary
def test_encode_edges(spark, public):
    long = "word " * 200_000
    rows = [(1, None), (2, ""), (3, "<|endoftext|>"), (None, " a"), (5, long), (3, "<|endoftext|>"), (6, "x" * 5000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit("x"))
    got = [(r["doc_id"], r["ids"]) for r in tokens.encode(df, "doc_id", "text").collect()]
    want = [(k, public.encode(t, add_special_tokens=False).ids if t else []) for k, t in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert tokens.encode(df.limit(0), "doc_id", "text").count() == 0
    assert {r["n_tokens"] for r in tokens.token_counts(df, "doc_id", "text").where("doc_id in (1, 2)").collect()} == {0}
    back = {r["doc_id"]: r["text"] for r in tokens.decode(tokens.encode(df, "doc_id", "text"), "doc_id", "ids").collect()}
    assert back[5] == long and back[1] == ""


# Packing


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 9), max_size=30))
def test_shapes_hold_every_document_once(histogram):
    tiers = [(8, 8), (32, 32), (64, 64)]
    shapes = packing.plan_shapes(histogram, tiers)
    packed: dict[int, int] = {}
    for s in shapes:
        assert sum(k * n for k, n in s.sizes.items()) == s.capacity - s.room <= s.capacity and s.count > 0
        for k, n in s.sizes.items():
            packed[k] = packed.get(k, 0) + n * s.count
    assert packed == histogram


def test_pack_edges(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([0, 3, 3, 3, 7, 20, 63, 64, 65, 200])) for i in range(400)] + [(None, 5), (7, None), (8, 9), (8, 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint").withColumn("rank", F.lit(1)).withColumn("size", F.lit(2))
    out = packing.pack(df, "doc_id", {1: [(8, 64), (64, 64)], 2: [(8, 8), (64, 64)]}, 128).toPandas()
    for layout in (1, 2):
        own = out[out.layout == layout]
        assert own.n_tokens.sum() == sum(n or 0 for _, n in rows)
        used = own.groupby(["capacity", "container_id"]).n_tokens.sum().reset_index()
        assert (used.n_tokens <= used.capacity).all()
        whole = own[own.doc_id.between(0, 399)].groupby("doc_id").size()
        sizes = dict(rows[:400])
        assert all(whole[i] == max(1, -(-(sizes[i]) // 64)) for i in range(10, 400))
        assert used.n_tokens.sum() / used.capacity.sum() > 0.95
        groups = own.groupby(["capacity", "step_group"]).container_id.nunique()
        assert groups.max() <= 16
    assert packing.pack(df.limit(0), "doc_id", {1: [(64, 64)]}, 128).count() == 0
    empty = packing.pack(spark.createDataFrame([(1, 0), (2, None)], "doc_id bigint, n_tokens bigint"), "doc_id", {1: [(64, 64)]}, 128).collect()
    assert len(empty) == 2 and {r["container_id"] for r in empty} == {0}


# Digests


def test_percentiles_are_within_the_stated_error(spark):
    rng = np.random.default_rng(1)
    rows = [("hot", float(x)) for x in rng.lognormal(0, 3, 20000)] + [("ties", float(x)) for x in rng.integers(0, 3, 3000)] + [(None, 1.0), ("one", 5.0), ("inf", float("inf")), ("inf", 1.0), ("nothing", None), ("nothing", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("n", F.lit(1)).withColumn("means", F.lit(2)).repartition(7)
    out = digests.certified_percentiles(df, ["g"], "v").collect()
    assert {r["g"] for r in out} == {"hot", "ties", None, "one", "inf"} and all(r["rank_error"] <= digests.RANK_ERROR for r in out)
    data = np.sort([v for g, v in rows if g == "hot"])
    for r in (x for x in out if x["g"] == "hot"):
        at = np.searchsorted(data, r["value"]) / len(data)
        assert abs(at - r["percentile"]) <= digests.RANK_ERROR + 1 / len(data) and r["n"] == len(data)
    assert digests.certified_percentiles(df.limit(0), ["g"], "v").count() == 0


def test_infinite_values_end_and_are_certified(spark):
    """Masses of infinities at both ends, and values of all magnitudes."""
    rng = np.random.default_rng(5)
    inf = float("inf")
    groups = {
        "tenth": [*rng.normal(size=900).tolist(), *[inf] * 100],
        "both": [*rng.normal(size=100).tolist(), *[inf] * 450, *[-inf] * 450],
        "only": [inf] * 40 + [-inf] * 60,
        "wide": (np.sign(rng.normal(size=3000)) * 10.0 ** rng.uniform(-308, 308, 3000)).tolist(),
        "ends": [1.7e308] * 300 + [-1.7e308] * 300 + [5e-324] * 300 + [-0.0, 0.0] * 50,
    }
    df = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v], "g string, v double").repartition(5)
    for out in (digests.certified_percentiles(df, ["g"], "v"), digests.certified_percentiles(df, ["g"], "v", fineness=4, rounds=0)):
        got = out.collect()
        assert len(got) == 5 * len(digests.PERCENTILES)
        for r in got:
            v, n = np.array(groups[r["g"]]), len(groups[r["g"]])
            slack = max(1, digests.RANK_ERROR * n)
            assert (v < r["value"]).sum() - slack <= r["percentile"] * n <= (v <= r["value"]).sum() + slack, r
            assert r["below"] == (v < r["value"]).sum() and r["up_to"] == (v <= r["value"]).sum()


def test_selection_is_exact(spark):
    rng = np.random.default_rng(6)
    groups = {"a": rng.normal(size=777).tolist(), None: [1.0, 1.0, 2.0, -3.0], "z": [0.0, -0.0, float("inf"), -float("inf")]}
    df = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v] + [("a", None), ("nan", float("nan"))], "g string, v double")
    for r in digests.selected_percentiles(df, ["g"], "v").collect():
        v = np.sort(groups[r["g"]])
        assert r["estimates"] == [v[max(1, int(np.ceil(q * len(v)))) - 1] for q in digests.PERCENTILES]
    bits = digests.ordered_bits(np.array([-np.inf, -1.0, -5e-324, 0.0, 5e-324, 1.0, np.inf]))
    assert (np.diff(bits.astype(object)) > 0).all() and digests.from_ordered_bits(bits)[[0, 1, 6]].tolist() == [-np.inf, -1.0, np.inf]


def test_finer_digests_follow_when_the_error_is_too_large(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(5000)], "g string, v double")
    out = digests.certified_percentiles(df, ["g"], "v", fineness=8, within=0.002).collect()
    assert len(out) == len(digests.PERCENTILES) and max(r["rank_error"] for r in out) <= 0.002


def test_merging_daily_digests_equals_one_digest_closely(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(int(d), float(x)) for d, x in zip(rng.integers(0, 30, 20000), rng.normal(size=20000))], "d int, v double")
    daily = digests.merge_digests(digests.partial_digests(df, ["d"], "v"), ["d"])
    all_ = digests.merge_digests(daily.select(digests.DIGEST), [])
    r = digests.read_percentiles(all_, []).first()
    exact = np.quantile([x["v"] for x in df.collect()], digests.PERCENTILES)
    assert r["n"] == 20000 and np.abs(np.array(r["estimates"]) - exact).max() < 0.05


def test_deliveries_count_once(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 3.0), (None, 4.0), (None, 4.0), (None, 5.0)], "k bigint, v double")
    assert sorted(r["v"] for r in digests.first_deliveries(df, "k", "v").collect()) == [2.0, 3.0, 4.0, 4.0, 5.0]


# Sampling


def by_priorities(size, share, floor, available):
    """All priorities, sorted: the definition."""
    got = [min(f, a) if t > 0 else 0 for t, f, a in zip(share, floor, available)]
    rest = sorted(((r - 0.5) / t, i) for i, (t, a) in enumerate(zip(share, available)) if t > 0 for r in range(got[i] + 1, a + 1))
    for _, i in rest[: max(0, size - sum(got))]:
        got[i] += 1
    return got


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 400), st.lists(st.tuples(st.sampled_from([0.0, 0.01, 0.1, 0.2, 0.5, 0.7]), st.integers(0, 6), st.integers(0, 250)), min_size=1, max_size=6))
def test_seats_are_the_smallest_priorities(size, cats):
    share, floor, available = map(list, zip(*cats))
    got, want = sampling.seats(size, share, floor, available), by_priorities(size, share, floor, available)
    assert got == want


def test_sample_edges(spark, monkeypatch):
    monkeypatch.setattr(sampling, "HOT_ROWS", 50)
    pool = spark.createDataFrame([("p", "hot", f"h{i}") for i in range(400)] + [("p", "rare", f"r{i}") for i in range(3)] + [("q", "hot", "x")], "pool string, category string, item string").distinct()
    need = [("t", "1", "p", "hot", 100, 0.9, 90, 2), ("t", "1", "p", "rare", 100, 0.1, 10, 2), ("t", "1", "p", "gone", 100, 0.05, 5, 2), ("t", "2", "q", "hot", 10, 1.0, 10, 0)]
    demand = spark.createDataFrame(need, "target_table string, target_key string, pool string, category string, size bigint, share double, needed bigint, min_rows bigint")
    ranked, sizes = sampling.rank_rows(pool)
    ranks = sorted(r["rank"] for r in ranked.where("category = 'hot' and pool = 'p'").collect())
    assert ranks == list(range(1, 401))
    wanted = sampling.report(demand, sizes)
    rep = {(r["target_key"], r["category"]): r for r in wanted.collect()}
    assert rep["1", "rare"]["short"] == 7 and rep["1", "gone"]["available"] == 0 and rep["1", "hot"]["seats"] == 97 and rep["2", "hot"]["seats"] == 1
    drawn = sampling.draw(ranked, wanted).groupBy("target_key", "category").agg(F.countDistinct("item").alias("n")).collect()
    assert {(r["target_key"], r["category"]): r["n"] for r in drawn} == {("1", "hot"): 97, ("1", "rare"): 3, ("2", "hot"): 1}
    short = {(r["target_key"], r["category"]) for r in sampling.short_categories(ranked, sizes, demand).collect()}
    assert short == {("1", "rare"), ("1", "gone"), ("2", "hot")}
    ranked, sizes = sampling.rank_rows(pool.limit(0))
    assert sampling.short_categories(ranked, sizes, demand).count() == 4
    assert sampling.report(demand, sizes).where("seats > 0").count() == 0


def test_targets_are_cleaned(spark):
    df = spark.createDataFrame([(" 1. ",), ("1",), ("1..",), (None,), ("\t2 .",)], "t string")
    assert [r[0] for r in df.select(sampling.clean_target(F.col("t"))).collect()] == ["1", "1", "1.", None, "2"]


@has_data
@pytest.mark.parametrize("name", ["p5_ranks", "p6_decoded", "p7_audit", "p3_found", "p3_sample", "p3_report"])
def test_registered_query_equals_its_sql(spark, name):
    from oracle import compare, connect

    from taintgauge.llm import registry

    assert compare(spark, connect(DATA), registry.QUERIES[name], registry.ORACLES[name], DATA) == ""


# Garbled text


def test_tiny_and_plain_samples():
    """Samples without any garbled or accented text: every class still knows the letters."""
    for texts in ([], ["plain text"] * 5, ["für über größer"] * 5):
        judge = garble.Judge(garble.train(texts, [None] * len(texts)))
        for text, want in (("plain", False), ("M�nchen", True), ("fÃ¼r Ã¼ber grÃ¶Ã\x9fer", True), ("für", False), ("", False)):
            units = garble.units_of(text)
            judge.learn(set(units))
            assert judge.verdict(units)[0] == want, (texts[:1], text, judge.verdict(units))


@pytest.mark.parametrize("chain", garble.chains(), ids=lambda c: c.name)
def test_strict_inverse(chain):
    for text in ("größere Lösung", "déjà vu", "średnia błędów", "Доля записей", "数据包多出"):
        made = chain.garble(text)
        if made and garble.REFUSED not in made and (back := chain.restore(made)) is not None:
            assert back == text


@has_data
def test_found_and_restored(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    model = encoding.train(docs, "doc_id", "text", "lang")
    judge = garble.Judge(model)

    def verdict(text):
        units = garble.units_of(text)
        judge.learn(set(units))
        return judge.verdict(units)[0]

    clean = [r["text"] for r in docs.where("text is not null").collect() if not verdict(r["text"])]
    rng = random.Random(3)
    tried = right = restored = 0
    fit = [t.lstrip("﻿") for t in clean if len(t) > 200 and not t.isascii() and "&" not in t]
    for chain in model.chains:  # all of them, on texts that they can be undone on
        made = ((text, chain.garble(text)) for text in rng.sample(fit, 150))
        for text, bad in [(t, g) for t, g in made if g and g != t and garble.REFUSED not in g and chain.restore(g) == t][:12]:
            tried += 1
            right += verdict(bad)
            restored += judge.repair(bad)[0] == text
    assert tried > 500 and right / tried >= 0.98 and restored / tried >= 0.85, (tried, right, restored)
    # Refused characters and misread byte order marks are found by the model's odds.
    assert verdict("Sp�ter bleibt es unver�ndert") and verdict("ï»¿plain") and verdict("п»їplain") and verdict("ďťżplain")
    wide = "Die Größe\nder Stichprobe".encode("utf-16-le").decode("latin-1")
    assert verdict(wide) and judge.repair(wide)[0] == "Die Größe\nder Stichprobe"
    for text in ("", "plain", "naïve café — “quoted” 5 °C", "ﬁt ｆｕｌｌ 👩‍🔬 ──┼──┤"):
        assert not verdict(text)
    rows = [(1, None), (2, ""), (3, "x" * 100_000), (None, "Ã¼ber fÃ¼r"), (4, "für " * 50_000), (4, "für " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("garbled", F.lit(1)).withColumn("chain", F.lit(2))
    out = encoding.judge(df, "doc_id", "text", model, repair=True).collect()
    assert len(out) == 6 and {r["doc_id"] for r in out if r["garbled"]} == {None}
    assert encoding.judge(df.limit(0), "doc_id", "text", model).count() == 0
