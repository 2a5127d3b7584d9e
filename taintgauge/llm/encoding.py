"""Problem 8: documents that were read with the wrong encoding, and their original text."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taintgauge.llm import garble
from taintgauge.sources.tables import table

#: Documents that the classifier is fitted on: those of smallest key hash. Everything is then judged by it.
SAMPLE = 6000

_JUDGES: dict[str, garble.Judge] = {}


def _judge(name: str, model: garble.Model) -> garble.Judge:
    """One judge per worker process and model, so that scores of recurring units are kept between partitions."""
    if name not in _JUDGES:
        _JUDGES.clear()
        _JUDGES[name] = garble.Judge(model)
    return _JUDGES[name]


def train(df: DataFrame, key: str, text: str, language: str, sample: int = SAMPLE) -> garble.Model:
    """Fit on the `sample` documents of smallest key hash; the bound doesn't grow with the data."""
    rows = df.where(F.col(text).isNotNull())
    slices = 1 << 20
    share = min(slices, -(-sample * slices // max(1, rows.count())))
    slice_ = F.pmod(F.xxhash64(key), F.lit(slices))
    few = rows.where(slice_ < share + share // 10 + 1)  # hardly more than wanted, so that few are sorted
    picked = few.select(text, language, slice_.alias("_slice"), F.col(key).alias("_key")).orderBy("_slice", "_key", text).limit(sample).collect()
    return garble.train([r[0] for r in picked], [r[1] for r in picked])


def judge(df: DataFrame, key: str, text: str, model: garble.Model, repair: bool = False) -> DataFrame:
    """(key, garbled, log_odds, chain[, restored, units_restored, units_left]): one row per row of `df`.

    NULL and empty texts are never garbled, ASCII texts only if they hold NUL characters or character references. `restored` is the text with everything undone that can be, else the
    text as it is. One narrow stage over whole texts; a NULL key stays NULL, repeated rows are judged as often as they
    come, an empty table gives no rows, other columns are pruned.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)  # BUCKETS x classes: a fixed size
    name = f"{spark.sparkContext.applicationId}-{id(model)}-{model.logp.shape}-{float(model.logp.sum())}"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = _judge(name, shared.value)
        names = [c.name for c in own.model.chains]
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                texts = part.column(1).to_pylist()
                found = [garble.units_of(t) if t else [] for t in texts]
                own.learn({u for us in found for u in us})
                said = [own.verdict(us) for us in found]
                cols = [part.column(0), pa.array([s[0] for s in said], pa.bool_()), pa.array([s[1] for s in said], pa.float64()), pa.array([names[s[2]] if s[0] and s[2] >= 0 else None for s in said], pa.string())]
                if repair:
                    fixed = [own.repair(t) if s[0] else (t, 0, 0, None) for t, s in zip(texts, said, strict=True)]
                    cols += [pa.array([f[0] for f in fixed], pa.string()), pa.array([f[1] for f in fixed], pa.int32()), pa.array([f[2] for f in fixed], pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, names=columns)

    narrow = df.select(key, text)
    kinds = f"`{key}` {narrow.schema[key].dataType.simpleString()}, garbled boolean, log_odds double, chain string"
    columns = [key, "garbled", "log_odds", "chain"] + (["restored", "units_restored", "units_left"] if repair else [])
    return narrow.mapInArrow(run, kinds + (", restored string, units_restored int, units_left int" if repair else ""))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with garbled text."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return judge(docs, "doc_id", "text", train(docs, "doc_id", "text", "lang")).where("garbled").select("doc_id").distinct()


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled documents with the chain that explains them best and the text as far as it can be restored."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return judge(docs, "doc_id", "text", train(docs, "doc_id", "text", "lang"), repair=True).where("garbled").drop("garbled")
