"""Importance resampling towards a target distribution.

Identical texts are collapsed by grouping the full text, so features, their buckets and the weight are computed once a
text; bucket counts are multiplied by the text's multiplicity.  Weights are joined back to the documents by the text's
digest (SHA-256) before each document's own noise is added, and the highest noisy scores are drawn.

Words are runs of letters and digits, as bytes: A-Z in lower case, digits, and everything outside ASCII.

What reaches the driver has as many numbers as there are buckets.  A text that holds more than 1 of ``HOT`` rows is salted when
weights are joined back; there are fewer than ``HOT`` of these, which bounds their broadcast.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathwarden.llm.common import stored
from pathwarden.operators.ordering import numbered

BUCKETS = 10_000
LONGEST = 1
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
#: A text of more than 1 in so many rows is a hot key of the join back.
HOT = 1024

#: Bytes as they count in words: A-Z in lower case, what separates words as a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8; none for null."""
    return (text or "").encode().translate(_FOLD).split()


def features(text: str | None, longest: int = LONGEST) -> Counter:
    """Runs of 1 to ``longest`` consecutive words with their counts."""
    w = words(text)
    out = Counter(w)
    for n in range(2, longest + 1):
        out.update(b" ".join(w[i : i + n]) for i in range(len(w) - n + 1))
    return out


def collapsed(df: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[DataFrame, str]:
    """One stored row a distinct text: digest, copies, n_words, n_features, and the buckets of its features with their counts.

    A null text counts as an empty one.  Also returns the path of the stored table.
    """
    texts = df.select(F.coalesce(F.col(text), F.lit("")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("copies"))
    keyed = texts.select("t", F.unhex(F.sha2("t", 256)).alias("digest"), "copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                found = [(len(words(t)), features(t, longest)) for t in part.column(0).to_pylist()]
                offsets = pa.array(np.cumsum([0] + [len(c) for _, c in found]), pa.int32())
                at = np.fromiter((zlib.crc32(k) % buckets for _, c in found for k in c), np.int32)
                n = np.fromiter((v for _, c in found for v in c.values()), np.int64)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (at, n)]
                totals = [pa.array([k for k, _ in found], pa.int64()), pa.array([sum(c.values()) for _, c in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *totals, *lists], ["digest", "copies", "n_words", "n_features", "at", "n"])

    return stored(keyed.mapInArrow(run, "digest binary, copies long, n_words long, n_features long, at array<int>, n array<long>"), "features")


def _lists(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of each entry, bucket and count of the last two columns."""
    at, n = b.column(b.num_columns - 2), b.column(b.num_columns - 1)
    sizes = np.diff(at.offsets.to_numpy())
    return np.repeat(np.arange(b.num_rows), sizes), at.flatten().to_numpy(), n.flatten().to_numpy()


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket, copies counted, of a table by :func:`collapsed`; added up by task, then by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            row, at, n = _lists(b)
            np.add.at(total, at, n * b.column(0).to_numpy()[row])
        (there,) = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("copies", "at", "n").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down."""
    k = len(corpus)
    s, t = corpus.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def weighed(texts: DataFrame, gain: np.ndarray) -> DataFrame:
    """digest, copies, n_words, n_features and weight of a table by :func:`collapsed`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, at, n = _lists(b)
            weight = np.zeros(b.num_rows, np.int64)
            np.add.at(weight, row, gain[at] * n)
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(weight)], [*b.schema.names[:-2], "weight"])

    return texts.select("digest", "copies", "n_words", "n_features", "at", "n").mapInArrow(run, "digest binary, copies long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST,
             seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs``; rank is null where a row isn't drawn.

    Drawn is the given percentage, rounded down, of the rows with at least ``least_words`` words: those of the highest
    scores, ties to the smaller id (null ids last).  A null text has no words and weight 0; a null id adds nothing to the hashed
    seed.  Repeated rows are rows of their own with scores alike and ranks that follow each other.  No rows give no rows, an
    empty target leaves all words equally rare.  Other columns of ``docs`` play no part, whatever their names.
    """
    spark = docs.sparkSession
    own, _ = collapsed(docs, text, buckets, longest)
    wanted, _ = collapsed(target, target_text, buckets, longest)
    weights, _ = stored(weighed(own, gains(bucket_counts(own, buckets), bucket_counts(wanted, buckets))), "weights")

    rows = weights.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first()["n"]
    most = max(1, -(-rows // HOT))
    salts = F.ceil(F.col("copies") / most).cast("int")
    hot = weights.where(F.col("copies") > most).select(F.col("digest").alias("d"), salts.alias("salts"))
    spread = weights.select("digest", "n_words", "n_features", "weight", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("d"))
    dealt = slim.join(F.broadcast(hot), "d", "left").select("doc_id", "d", F.coalesce(F.floor(F.rand(seed) * F.col("salts")).cast("int"), F.lit(0)).alias("s"))
    joined = dealt.join(spread, (dealt["d"] == spread["digest"]) & (dealt["s"] == spread["salt"]))

    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0)))
    scored = joined.select("doc_id", "n_features", "weight", score.cast("long").alias("score"), (F.col("n_words") < least_words).alias("short"))
    placed = numbered(scored, ["short", F.desc("score"), F.col("doc_id").asc_nulls_last()], "place", keep=lambda df: stored(df, "scores")[0])
    long_enough = weights.agg(F.coalesce(F.sum(F.when(F.col("n_words") >= least_words, F.col("copies"))), F.lit(0)).alias("n")).first()["n"]
    drawn = percent * long_enough // 100
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") < drawn, F.col("place") + 1).cast("long").alias("rank"))


def op12_resample(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's draw of ``docs`` towards the texts of ``benchmark``; odd rows as in :func:`resample`."""
    return resample(docs, benchmark)
