"""Mixing sources to target weights.

1. The words of each source, document after document, are packed into blocks of
   ``BLOCK`` words.  A document's place in its source's word stream comes from two
   levels of running sums: over buckets of a source (a few numbers each) and over
   the documents of one bucket, so no source is ordered in one task.
2. Targets: the sources' weights share all words; a target stops at ``MAX_EPOCHS``
   times its source, the rest goes to the others by weight.
3. Every output shard draws multinomial counts of its slots over the sources.
4. A source's k-th slot takes block ``perm(k mod n)``, with a permutation of its
   blocks keyed by seed, source and epoch; slots are joined to blocks by index.

A block is thus taken ``floor`` or ``ceil`` of slots / blocks times, three at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathwarden.llm.common import WORD_PATTERN, stored
from pathwarden.operators.ordering import numbered

BLOCK = 256
MAX_EPOCHS = 3
SHARDS = 256
#: Slots that one step of filling a run makes at most.
FILL = 1 << 20
WEIGHTS = (5, 2, 1)
BUCKET_DOCS = 8192
SEED = 20240601


def count_words(text):
    """Words of a text column; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], most: int = MAX_EPOCHS) -> list[float]:
    """Shares of the total by weight, none above ``most`` times its size; the excess is reshared by weight."""
    out, open_ = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0 and weights[i] > 0]
    left = float(sum(sizes))
    while open_:
        w = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / w > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in full:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in full]
    return out


def _keys(seed: int, source: str | None, epoch: int) -> list[int]:
    d = hashlib.sha256(f"{seed}/{epoch}/{'n' if source is None else 's' + source}".encode()).digest()
    return [int.from_bytes(d[i : i + 8], "big") for i in range(0, 32, 8)]


def permuted(index: np.ndarray, n: int, keys: list[int]) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1: a four-round Feistel network, walked until it falls below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(x):
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            with np.errstate(over="ignore"):
                f = (right + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
                f ^= f >> np.uint64(29)
                f *= np.uint64(0xBF58476D1CE4E5B9)
                f ^= f >> np.uint64(32)
            left, right = right, left ^ (f & mask)
        return left << np.uint64(half) | right

    out = once(index.astype(np.uint64))
    while (over := out >= np.uint64(n)).any():
        out[over] = once(out[over])
    return out.astype(np.int64)


def draw(plan: list[dict], shards: int = SHARDS, seed: int = SEED) -> list[tuple[str | None, int, int, int, int]]:
    """(source, shard, first slot, slots, blocks): multinomial counts by shard.

    ``plan`` has source, blocks and slots wanted of each source.  The chance of a source is its share of what is
    still wanted, so the last shards even out what the first drew: no source ends far from its target or above ``MAX_EPOCHS`` epochs.
    """
    total = sum(p["slots"] for p in plan)
    left = [p["slots"] for p in plan]
    used = [0] * len(plan)
    rng = np.random.Generator(np.random.PCG64(seed))
    out = []
    for shard in range(shards):
        size = total * (shard + 1) // shards - total * shard // shards
        drawn = [0] * len(plan)
        todo = size
        while todo:  # what a source can't give is drawn anew from the others
            p = np.array([max(x - d, 0) for x, d in zip(left, drawn)], float)
            for i, k in enumerate(rng.multinomial(todo, p / p.sum())):
                drawn[i] += min(int(k), left[i] - drawn[i])
            todo = size - sum(drawn)
        for i, k in enumerate(drawn):
            if k:
                out.append((plan[i]["source"], shard, used[i], k, plan[i]["blocks"]))
                used[i] += k
                left[i] -= k
    return out


class Mix:
    """The mix of ``docs`` (doc_id, text, source).

    ``sized``: a row per document with its words' place in its source's stream.
    ``slots``: a row per output slot (shard, slot, source, block).
    ``taken``: a row per document and block (start, words, times).
    Null text or no words: size 0, nothing taken.  Null source: a source of its own, last.
    Rows that repeat a doc_id are documents of their own.  Empty table: no rows.
    """

    def __init__(self, docs: DataFrame, weights=WEIGHTS, block: int = BLOCK, seed: int = SEED):
        spark = docs.sparkSession
        self.block = block
        slim = docs.select("doc_id", "source", count_words(F.col("text")).alias("size"), F.xxhash64("text").alias("_tie"))
        slim, self.path = stored(slim, "sizes")
        by = slim.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        # Sources are labels of corpora: their list is read by the driver, their documents never are.
        self.sources = sorted((r.asDict() for r in by.collect()), key=lambda r: (r["source"] is None, r["source"] or ""))
        want = targets([r["size"] for r in self.sources], [weights[i % len(weights)] for i in range(len(self.sources))])
        for r, t in zip(self.sources, want):
            r["target"] = t
            r["blocks"] = -(-r["size"] // block)
            # A last block that isn't full makes a slot worth a little less than a block.
            r["slots"] = min(MAX_EPOCHS * r["blocks"], round(t * r["blocks"] / r["size"])) if r["size"] else 0
        self.dim = F.broadcast(spark.createDataFrame([(r["source"], r["size"], float(r["target"])) for r in self.sources], "_source string, source_size long, target double"))
        buckets = max(1, -(-sum(r["n"] for r in self.sources) // BUCKET_DOCS))
        b = slim.withColumn("_b", F.pmod(F.xxhash64("doc_id", "_tie"), F.lit(buckets)).cast("int"))
        sums = b.groupBy("source", "_b").agg(F.sum("size").alias("_s"))
        start = sums.select("source", "_b", (F.sum("_s").over(Window.partitionBy("source").orderBy("_b")) - F.col("_s")).alias("_base"))
        run = Window.partitionBy("source", "_b").orderBy("doc_id", "_tie").rowsBetween(Window.unboundedPreceding, -1)
        ranked = b.withColumn("_in", F.coalesce(F.sum("size").over(run), F.lit(0)))
        joined = ranked.alias("r").join(start.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r._b") == F.col("s._b")))
        self.sized = joined.select("r.doc_id", "r.source", "r.size", "r._tie", (F.col("s._base") + F.col("r._in")).alias("start"))
        drawn = draw([r for r in self.sources if r["slots"]], seed=seed)
        self.runs = spark.createDataFrame(drawn, "source string, shard int, first long, n long, blocks long")
        # Runs are shards times sources; their slots are made on the executors.
        self.slots = self.runs.repartition(max(1, min(len(drawn), 4 * spark.sparkContext.defaultParallelism))).mapInArrow(
            lambda batches: _fill(batches, seed), "source string, shard int, slot long, block long"
        )
        times = self.slots.groupBy("source", "block").agg(F.count("*").alias("times"))
        first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
        parts = self.sized.where("size > 0").withColumn("block", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
        lo = F.greatest(F.col("start"), F.col("block") * block)
        hi = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
        self.parts = parts.select("doc_id", "source", "_tie", "start", "block", (lo - F.col("start")).alias("first_word"), (hi - lo).alias("words"))
        p, t = self.parts.alias("p"), times.alias("t")
        self.taken = p.join(t, F.col("p.source").eqNullSafe(F.col("t.source")) & (F.col("p.block") == F.col("t.block"))).select(
            "p.doc_id", "p.source", "p._tie", "p.start", "p.block", "p.first_word", "p.words", "t.times"
        )


def _fill(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            for lo in range(r["first"], r["first"] + r["n"], FILL):
                k = np.arange(lo, min(lo + FILL, r["first"] + r["n"]), dtype=np.int64)
                block = np.empty(len(k), np.int64)
                for epoch in np.unique(k // r["blocks"]):
                    at = k // r["blocks"] == epoch
                    block[at] = permuted(k[at] % r["blocks"], r["blocks"], _keys(seed, r["source"], int(epoch)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["source"]] * len(k), pa.string()), pa.array(np.full(len(k), r["shard"], np.int32)), pa.array(k), pa.array(block)], ["source", "shard", "slot", "block"]
                )


def op2_mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of ``docs`` (doc_id, text, source); other columns don't matter.

    A null or empty text, or one without words, has size 0, and nothing is taken of it.  Rows without source are a source of their own, the last.
    Rows that repeat a doc_id, or are alike in all, are documents of their own, each with its place in the stream.  Texts of any length count whole.
    An empty table gives an empty one.
    """
    mix = Mix(docs)
    taken = mix.taken.groupBy("source", "start").agg(F.sum(F.col("words") * F.col("times")).alias("_taken"))
    # Places in a source's stream are different for all rows with words.
    s, t = mix.sized.alias("s"), taken.alias("t")
    on = F.col("s.source").eqNullSafe(F.col("t.source")) & (F.col("s.start") == F.col("t.start")) & (F.col("s.size") > 0)
    joined = s.join(t, on, "left").select("s.doc_id", "s.size", "s.source", F.coalesce("t._taken", F.lit(0)).cast("long").alias("taken"))
    return joined.join(mix.dim, F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "size", "source_size", "target", "taken")


def _fresh(names: list[str], name: str) -> str:
    while name in names:
        name += "_"
    return name


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them: each document's taken words in order, a block's part as often as it is taken.

    Only documents of which nothing is taken go.  ``n_chars`` is counted anew.  Rows alike in doc_id, text and source take the places of the stream
    that such rows have, one each.  All columns stay, whatever their names.
    """
    mix = Mix(docs)
    key = ["doc_id", "_tie", "source"]
    spans = mix.taken.groupBy(*key, "start").agg(F.sort_array(F.collect_set(F.struct("first_word", "words", "times"))).alias("spans"))
    # Of rows that are alike each has its own place; (start, spans) of all of them.
    places = spans.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("start", "spans"))).alias("places")).alias("a")
    alike = mix.sized.groupBy(*key).count().alias("b")
    both = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a._tie") == F.col("b._tie"))
    s = places.join(alike, both).select("a.doc_id", "a._tie", "a.source", "a.places", "b.count")
    schema = docs.schema
    cols = docs.columns
    mine, at, n = (_fresh(cols, c) for c in ("_spans", "_at", "_alike"))
    on = docs["doc_id"].eqNullSafe(s["doc_id"]) & docs["source"].eqNullSafe(s["source"]) & (F.xxhash64(docs["text"]) == s["_tie"])
    hit = docs.join(s, on).select(*[docs[c] for c in cols], s["places"].alias(mine), s["count"].alias(n))
    once = hit.where(F.col(n) == 1).select(*cols, F.col(mine)[0]["spans"].alias(mine))
    # Only rows that are repeated have to meet.
    many = hit.where(F.col(n) > 1).withColumn(at, F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text"), "source").orderBy(F.lit(0))))
    many = many.where(F.col(at) <= F.size(mine)).select(*cols, F.get(F.col(mine), F.col(at) - 1)["spans"].alias(mine))
    hit = once.unionByName(many)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # A part of a batch at a time bounds the memory that texts take.
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                text = [take(t.as_py(), sp.as_py()) for t, sp in zip(part.column("text"), part.column(mine))]
                made = {"text": pa.array(text, pa.string())}
                if "n_chars" in cols:
                    made["n_chars"] = pa.array([len(t) for t in text], part.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays([made.get(c, part.column(c)) for c in cols], cols)

    return hit.mapInArrow(cut, schema)


def mixed_blocks(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The output shards themselves: shard, place (gapless from 0 within a shard), source, block, n_words and text of every slot.

    A block's words are joined by single spaces; a shard's slots are in pseudorandom order, so sources alternate in it as they were drawn.
    """
    mix = Mix(docs, seed=seed)
    key = ["doc_id", "_tie", "source"]
    spans = mix.parts.groupBy(*key, "start").agg(F.collect_list(F.struct("block", "first_word", "words")).alias("_spans"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("_tie"), "source", "text").dropDuplicates(key)
    same = F.col("s.doc_id").eqNullSafe(F.col("t.doc_id")) & F.col("s.source").eqNullSafe(F.col("t.source")) & (F.col("s._tie") == F.col("t._tie"))
    found = spans.alias("s").join(texts.alias("t"), same).select("s.source", "s.start", "_spans", "t.text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        for b in batches:
            for lo in range(0, b.num_rows, 256):
                rows = []
                for source, start, parts, text in zip(*(c.to_pylist() for c in b.slice(lo, 256).columns)):
                    words = re.findall(WORD_PATTERN, text)
                    rows += [(source, start, x["block"], " ".join(words[x["first_word"] : x["first_word"] + x["words"]])) for x in parts]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["source", "start", "block", "part"])

    parts = found.mapInArrow(cut, "source string, start long, block long, part string")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "part"))), lambda x: x["part"]), " ")
    blocks = parts.groupBy("source", "block").agg(joined.alias("text")).alias("b")
    slots = numbered(mix.slots, [F.xxhash64(F.lit(seed), "source", "slot"), "source", "slot"], "place", by=["shard"], keep=lambda df: stored(df, "slots")[0]).alias("s")
    on = F.col("s.source").eqNullSafe(F.col("b.source")) & (F.col("s.block") == F.col("b.block"))
    return slots.join(blocks, on).select("s.shard", "s.place", "s.source", "s.block", count_words(F.col("b.text")).alias("n_words"), "b.text")


def take(text: str, spans) -> str:
    """The words of ``spans`` (first_word, words, times) with the white space that follows them."""
    import re

    starts = [m.start() for m in re.finditer(WORD_PATTERN, text)]
    out = []
    for s in spans:
        first, words, times = (s["first_word"], s["words"], s["times"]) if isinstance(s, dict) else s
        end = starts[first + words] if first + words < len(starts) else len(text)
        piece = text[starts[first] : end]
        if times > 1 and not piece[-1:].isspace():
            piece += "\n"
        out.append(piece * int(times))
    return "".join(out)
