"""Jaccard join on word n-grams with token-combination prefixes.

A document's set is that of its distinct five-word shingles; two link when
100 * |x & y| >= 80 * |x | y|.  Documents with equal sets are one class.

Tokens have a global order: rare ones first, then frequent ones, each by hash.  A token is
frequent when a lossy count over all documents finds it in more than one of
``FREQUENT_SHARE`` of them; there are at most so many times the mean set size over that, which bounds what is broadcast.  Which tokens are called
frequent changes the work, never the result.

A set of n tokens misses at most t = n // 5 of them in a partner.  Rare tokens of its prefix are
indexed singly.  Where they don't reach t + 1, the prefix goes on into frequent tokens,
which are dealt by hash to groups and indexed as pairs within a group: a group of m
prefix tokens survives m - 1 misses, so the prefix is extended until the survivors add up to
t + 1.  Then any two sets that link share a single or a pair.  The number of groups follows the
set's size by powers of two; a set is indexed for its own level and for that of partners
up to 5/4 its size.

Candidates share a single or a pair and pass the length and positional filters; each is verified on whole sets.  Buckets
that hold the same classes are one, with each class's first position among them.  Since
classes of a component need not be compared, every class is first verified against one
other of another component, ``STARS`` times over, and then all pairs of different components that are left.
There the classes of a bucket, in order of size, are held against those of near size, many buckets at a time, and by sketches too: ``BITS`` parities of how many
tokens fall into each range of hashes.  Sets differ in at
least as many tokens as their sketches in bits, and sets that link differ in at most a ninth of their tokens, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathwarden.llm.common import components, discard, stored
from pathwarden.llm.shingles import WORDS, distinct, mix, set_key, shingle_hashes, word_hashes

#: A token is frequent in more than this share of the tokens, and at least in this many documents.
FREQUENT_SHARE = 1 / (1 << 19)
FREQUENT_LEAST = 32
#: Sets below this size index frequent tokens singly.
SMALL = 64
#: Rounds in which every class is held against one other.
STARS = 3
#: Parities in a sketch, 64 a word; they tell sets of up to about twice as many tokens apart.
BITS = 2048
#: Classes whose texts are found by a broadcast list; more move the texts.
FEW = 2_000
#: Pairs whose sketches are compared at once.
_BLOCK = 1 << 12
_ONE, _PAIR = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def misses(n: int) -> int:
    """The most tokens of a set of n that a linked set lacks: n less the least overlap, ceil(4n/5)."""
    return n // 5


def level(n: int) -> int:
    """0 for small sets; else the power of two that gives the number of groups of frequent tokens."""
    return 0 if n < SMALL else n.bit_length() - 4


def prefix(s: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, positions) of an ascending set of token hashes.

    A pair's position is the number of rare tokens: sets that meet in pairs have all their rare tokens as
    singles, so either they meet there too or they share none of them.
    """
    n = len(s)
    need = misses(n) + 1
    if len(frequent):
        at = np.searchsorted(frequent, s)
        often = frequent[np.minimum(at, len(frequent) - 1)] == s
        rare, often = s[~often], s[often]
    else:
        rare, often = s, s[:0]
    singles = rare[:need]
    sig, pos = [singles], [np.arange(len(singles), dtype=np.int32)]
    short = need - len(singles)
    if short > 0:
        base = len(rare)
        for lv in sorted({level(n), level(n * 5 // 4)}):
            if lv == 0:
                sig.append(mix(often[:short] ^ _ONE))
                pos.append(np.arange(base, base + min(short, len(often)), dtype=np.int32))
                continue
            group = (often >> np.uint64(20)) & np.uint64((1 << lv) - 1)
            order = np.argsort(group, kind="stable")
            first = np.empty(len(often), bool)
            sorted_ = group[order]
            first[order] = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
            gain = np.cumsum(~first)
            size = int(np.searchsorted(gain, short)) + 1
            group, tokens = group[:size], often[:size]
            order = np.argsort(group, kind="stable")
            group, tokens = group[order], tokens[order]
            step = 1
            while step < size:
                same = group[step:] == group[:-step]
                if not same.any():
                    break
                a, b = tokens[:-step][same], tokens[step:][same]
                sig.append(mix(mix(a ^ _PAIR) * np.uint64(3) + b + np.uint64(lv)))
                pos.append(np.full(len(a), base, np.int32))
                step += 1
    return np.concatenate(sig), np.concatenate(pos)


def _sets(texts: pa.Array) -> Iterator[np.ndarray]:
    for t in texts:
        raw = t.as_buffer() if t.is_valid else None
        yield distinct(shingle_hashes(word_hashes(raw.to_pybytes()), WORDS)) if raw is not None and raw.size else np.empty(0, np.uint64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def sketch(s: np.ndarray) -> np.ndarray:
    """The parities of the numbers of tokens in ``BITS`` ranges of hashes, 64 a word."""
    at = (s >> np.uint64(64 - (BITS.bit_length() - 1))).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=BITS).astype(np.uint8) & 1).view(np.int64)


def _measure(share: float):
    """Per document its id, the hash of its text, set size, class and sketch; per task the tokens that are often in it (doc_id null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "tie", "n", "key", "sketch"]
        total, seen, counts = 0, np.empty(0, np.uint64), np.empty(0, np.int64)
        pending: list[np.ndarray] = []
        held = 0

        def fold() -> None:
            nonlocal seen, counts, pending, held
            if not pending:
                return
            t, c = np.unique(np.concatenate(pending), return_counts=True)
            both, at = np.unique(np.concatenate([seen, t]), return_inverse=True)
            add = np.bincount(at, np.concatenate([counts, c])).astype(np.int64)
            # Lossy counting: what has fewer than its share of the tokens so far is forgotten.
            keep = add >= max(2, share * total / 2)
            seen, counts, pending, held = both[keep], add[keep], [], 0

        for b in batches:
            n, key, bits = [], [], [np.empty(0, np.int64)]
            for s in _sets(b.column(2)):
                n.append(len(s))
                key.append(set_key(s) if len(s) else None)
                bits.append(sketch(s))
                pending.append(s)
                held += len(s)
                total += len(s)
                if held > 1 << 20:
                    fold()
            sketches = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * (BITS // 64)), pa.array(np.concatenate(bits)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(key, pa.int64()), sketches], names)
        fold()
        for lo in range(0, len(seen), 10_000):
            part = seen[lo : lo + 10_000]
            none = pa.nulls(len(part), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(-counts[lo : lo + 10_000]), _signed(part), pa.nulls(len(part), pa.list_(pa.int64()))], names)

    return run


def _emit(frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value
        done: set[int] = set()
        for b in batches:
            out: list[tuple] = []
            size = 0

            def flush(out):
                return pa.RecordBatch.from_arrays([_signed(np.concatenate([o[0] for o in out])), pa.array(np.concatenate([np.full(len(o[0]), o[1], np.int64) for o in out])), pa.array(np.concatenate([np.full(len(o[0]), o[2], np.int32) for o in out])), pa.array(np.concatenate([o[3] for o in out]))], ["sig", "key", "n", "pos"])

            for s in _sets(b.column(0)):
                if not len(s) or (key := set_key(s)) in done:
                    continue
                if len(done) < 200_000:  # copies within a task are sent once; others are merged later
                    done.add(key)
                sig, pos = prefix(s, often)
                out.append((sig, key, len(s), pos))
                size += len(sig)
                if size > 200_000:
                    yield flush(out)
                    out, size = [], 0
            if out:
                yield flush(out)

    return run


def outline(s: np.ndarray) -> np.ndarray:
    """How many tokens of a set fall into each of about n / 2 ranges of hashes, 255 for more."""
    bits = max(3, len(s).bit_length() - 1)
    return np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8)


def may_link(x: np.ndarray, y: np.ndarray, nx: int, ny: int, percent: int = 80) -> bool:
    """Whether outlines leave room for a link: sets share no more in a range than the smaller count there."""
    x, y = x.astype(np.int64), y.astype(np.int64)
    if (x == 255).any() or (y == 255).any():
        return True
    while len(x) > len(y):
        x = x.reshape(-1, 2).sum(axis=1)
    while len(y) > len(x):
        y = y.reshape(-1, 2).sum(axis=1)
    most = int(np.minimum(x, y).sum())
    return 100 * most >= percent * (nx + ny - most)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 512):
            part = b.slice(lo, 512)
            sets = list(_sets(part.column(1)))
            # Texts with equal hashes may differ; only the class's own counts.
            own = pa.array([len(s) > 0 and set_key(s) == k for s, k in zip(sets, part.column(0).to_pylist())], pa.bool_())
            made = [part.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array([outline(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(made, ["key", "n", "outline", "tokens"]).filter(own)


def verify(pairs: DataFrame, sets: DataFrame, percent: int = 80) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets link; outlines settle most that don't, and whole sets the rest."""
    side = lambda k, c: sets.select(F.col("key").alias(k), *[F.col(x).alias(f"{k}_{x}") for x in c])

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [may_link(np.frombuffer(p.as_buffer(), np.uint8), np.frombuffer(q.as_buffer(), np.uint8), m, n, percent) for p, q, m, n in zip(b.column(2), b.column(3), b.column(4).to_pylist(), b.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for p, q in zip(b.column(2), b.column(3)):
                p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                common = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum()) if len(p) else 0
                keep.append(common > 0 and 100 * common >= percent * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    slim = ["n", "outline"]
    left = pairs.join(side("a", slim), "a").join(side("b", slim), "b").select("a", "b", "a_outline", "b_outline", "a_n", "b_n").mapInArrow(sift, "a long, b long")
    return left.join(side("a", ["tokens"]), "a").join(side("b", ["tokens"]), "b").select("a", "b", "a_tokens", "b_tokens").mapInArrow(check, "a long, b long")


def _near(a: str, b: str):
    """The length filter, and the positional one: what follows the first common token must suffice."""
    na, nb = F.col(f"{a}.n").cast("long"), F.col(f"{b}.n").cast("long")
    rest = F.least(na - F.col(f"{a}.pos"), nb - F.col(f"{b}.pos"))
    return (na * 5 >= nb * 4) & (nb * 5 >= na * 4) & (rest * 9 >= (na + nb) * 4)


def candidates(sig: np.ndarray, key: np.ndarray, n: np.ndarray, pos: np.ndarray, c: np.ndarray, sketches: np.ndarray) -> np.ndarray:
    """Pairs (a < b) of classes of different components in a bucket, near in size and position, whose sketches differ in no more bits than sets that link may in tokens.

    Rows ascend by ``sig`` and then ``n``, so a row is held against the next ones until the first that is too large.
    """
    rest, found, step = n - pos, [np.empty((0, 2), np.int64)], 1
    at = np.arange(len(sig))
    while True:
        at = at[at + step < len(sig)]
        at = at[(sig[at] == sig[at + step]) & (n[at + step] * 4 <= n[at] * 5)]
        if not len(at):
            return np.unique(np.concatenate(found), axis=0)
        p, q = at, at + step
        ok = (c[p] != c[q]) & (np.minimum(rest[p], rest[q]) * 9 >= (n[p] + n[q]) * 4)
        p, q = p[ok], q[ok]
        for lo in range(0, len(p), _BLOCK):
            x, y = p[lo : lo + _BLOCK], q[lo : lo + _BLOCK]
            apart = np.bitwise_count((sketches[x] ^ sketches[y]).view(np.uint64)).sum(axis=1, dtype=np.int64)
            hit = apart * 9 <= n[x] + n[y]
            x, y = key[x[hit]], key[y[hit]]
            found.append(np.column_stack([np.minimum(x, y), np.maximum(x, y)]))
        step += 1


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """:func:`candidates` of rows (sig, key, n, pos, c, sketch) in order of sig and n; a bucket that goes on in the next batch waits for it."""
    held: list[list[np.ndarray]] = []

    def compared(rows: list[list[np.ndarray]]) -> pa.RecordBatch:
        pairs = candidates(*(np.concatenate(x) for x in zip(*rows)))
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    for b in batches:
        if not b.num_rows:
            continue
        rows = [b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)] + [b.column(5).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)]
        last = int(np.searchsorted(rows[0], rows[0][-1]))
        if last or (held and held[-1][0][-1] != rows[0][-1]):
            yield compared([*held, [x[:last] for x in rows]])
            held = []
        held.append([x[last:] for x in rows])
    if held:
        yield compared(held)


def classes(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """(doc_id, tie, n_shingles, component, component_id) of documents (doc_id, text), and the stored tables behind it.

    tie is the hash of the text.  component is a number of each component, null for documents without words.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", F.xxhash64("text").alias("tie"), "text")
    # Null ids are kept apart from the rows that carry token counts by n, which is negative there.
    measured, measured_path = stored(slim.mapInArrow(_measure(FREQUENT_SHARE), "doc_id long, tie long, n long, key long, sketch array<bigint>"), "set-sizes")
    per_doc = measured.where("n >= 0")
    tokens = per_doc.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = measured.where("n < 0").groupBy("key").agg(F.sum(-F.col("n")).alias("c")).where(F.col("c") >= max(FREQUENT_LEAST, FREQUENT_SHARE * tokens))
    # At most 1 / FREQUENT_SHARE tokens can have that share of all tokens.
    frequent = np.sort(often.select("key").toPandas()["key"].to_numpy(np.int64).view(np.uint64))
    shared = spark.sparkContext.broadcast(frequent)
    rows = slim.select("text").mapInArrow(_emit(shared), "sig long, key long, n int, pos int")
    bucket, by_size = Window.partitionBy("sig"), Window.partitionBy("sig").orderBy("n", "key")
    # In order of size, a class whose neighbours are too far in size has no partner in the bucket; copies sent by several tasks are neighbours.
    n = F.col("n").cast("long")
    rows = rows.withColumns({"below": F.lag("n").over(by_size).cast("long"), "above": F.lead("n").over(by_size).cast("long"), "twin": F.lag("key").over(by_size), "lo": F.min("key").over(bucket), "hi": F.max("key").over(bucket)})
    rows = rows.where((F.col("lo") < F.col("hi")) & (F.col("twin").isNull() | (F.col("twin") != F.col("key"))) & ((F.col("below") * 5 >= n * 4) | (n * 5 >= F.col("above") * 4)))
    # Buckets of the same classes, told by two hashes of their keys, become one.
    alike = {"m": F.count("*").over(bucket), "g": F.bit_xor(F.xxhash64("key")).over(bucket), "h": F.bit_xor(F.xxhash64("key", F.lit(1))).over(bucket)}
    rows = rows.select("sig", "key", "n", "pos").withColumns(alike).where("m > 1").groupBy("m", "g", "h", "key").agg(F.min("sig").alias("sig"), F.first("n").alias("n"), F.min("pos").alias("pos"), F.count("*").alias("times"))
    buckets, buckets_path = stored(rows.select("sig", "key", "n", "pos", "times"), "buckets")
    shared.unpersist()
    # A class is read again from one row, found by doc_id and the hash of its text; rows without doc_id stand in only where there is no other.
    reps = per_doc.where("n > 0").groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie")).alias("rep"))
    # The more of its tokens a class shares, the likelier it is the middle of a group.
    weights = buckets.groupBy("key").agg((F.sum("times") / F.first("n")).alias("weight"))
    open_, path = stored(buckets.join(weights, "key").withColumn("c", F.col("key")), "buckets-open")
    discard(spark, buckets_path)
    old, done, sets, links = [], None, None, None

    def tested(pairs: DataFrame) -> bool:
        """Verify ``pairs`` (a < b) that no round had, and keep those that link; whether there were any."""
        nonlocal done, sets, links
        new, new_path = stored(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"), "pairs")
        if done is not None and not new.limit(1).count():
            discard(spark, new_path)
            return False
        keys = new.select(F.col("a").alias("key")).union(new.select("b")).distinct()
        keys = keys if sets is None else keys.join(sets.select("key"), "key", "left_anti")
        wanted, wanted_path = stored(keys.join(reps, "key").select("key", F.col("rep.doc_id").alias("rep_id"), F.col("rep.tie").alias("rep_tie")), "wanted")
        wanted = F.broadcast(wanted) if wanted.limit(FEW + 1).count() <= FEW else wanted.hint("merge")
        texts = slim.join(wanted, slim["doc_id"].eqNullSafe(wanted["rep_id"]) & (slim["tie"] == wanted["rep_tie"])).select("key", "text")
        more, more_path = stored(texts.mapInArrow(_tokens, "key long, n int, outline binary, tokens binary").dropDuplicates(["key"]), "sets")
        sets = more if sets is None else sets.unionByName(more)
        found, found_path = stored(verify(new, sets), "links")
        done, links = (new, found) if done is None else (done.unionByName(new), links.unionByName(found))
        old.extend((new_path, wanted_path, more_path, found_path))
        return True

    def relabelled() -> None:
        """Buckets by the components so far; only those that hold two or more stay open."""
        nonlocal open_, path
        comp, comp_path = components(links)
        named = open_.drop("c").join(comp.withColumnRenamed("node", "key"), "key", "left").withColumn("c", F.coalesce("component", "key")).drop("component")
        named = named.withColumns({"lo": F.min("c").over(bucket), "hi": F.max("c").over(bucket)}).where("lo < hi").drop("lo", "hi")
        was = path
        open_, path = stored(named, "buckets-open")
        discard(spark, was, comp_path)

    # Every class against one other of another component, a few times over: what is left to compare shrinks to classes that don't link.
    for _ in range(STARS):
        me = F.struct("weight", "key", "n", "pos", "c")
        hubs = open_.withColumn("hub", F.max(me).over(bucket))
        hubs = hubs.withColumn("second", F.max(F.when(F.col("c") != F.col("hub.c"), me)).over(bucket))
        hubs = hubs.select("key", "times", F.struct("n", "pos").alias("own"), F.when(F.col("c") != F.col("hub.c"), F.col("hub")).otherwise(F.col("second")).alias("hub"))
        votes = hubs.where("hub is not null").where(_near("own", "hub")).groupBy("key", F.col("hub.key").alias("h")).agg(F.sum("times").alias("count"))
        votes = votes.withColumns({"a": F.least("key", "h"), "b": F.greatest("key", "h")})
        votes = votes if done is None else votes.join(done, ["a", "b"], "left_anti")
        best = votes.groupBy("key").agg(F.max_by(F.struct("a", "b"), F.struct("count", "h")).alias("p"))
        if not tested(best.select("p.a", "p.b").distinct()):
            break  # nor would the next rounds find any
        relabelled()
    sketches = per_doc.where("n > 0").select("key", "sketch").dropDuplicates(["key"])
    drawn = open_.join(sketches, "key").select("sig", "key", "n", "pos", "c", "sketch").repartition("sig").sortWithinPartitions("sig", "n", "key")
    tested(drawn.mapInArrow(_compare, "a long, b long").distinct())
    final, final_path = components(links)
    joined = reps.join(final.withColumnRenamed("node", "key"), "key", "left").withColumn("c", F.coalesce("component", "key"))
    least = joined.groupBy("c").agg(F.min("rep.doc_id").alias("component_id"))
    named = joined.join(least, "c").select("key", "c", "component_id")
    out = per_doc.join(named, "key", "left").select("doc_id", "tie", F.col("n").alias("n_shingles"), F.col("c").alias("component"), F.coalesce("component_id", "doc_id").alias("component_id"))
    discard(spark, path, *old)
    return out, [measured_path, final_path]


def op6_jaccard(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text); other columns don't matter.

    A null or empty text, or one without words, has an empty set and links with nothing.  Rows that repeat a doc_id are documents of their own, each with
    its own text.  A row without doc_id links like any other; its component_id is the smallest doc_id of its component, null if
    that has none.  Texts of any length count whole.  An empty table gives an empty one.
    """
    return classes(docs)[0].select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id (then of the smallest hash of the text; rows without doc_id come last).

    Rows without words stay.  Of rows alike in doc_id and text any one stays.  A row goes or stays by its own text, whatever other rows share its doc_id.
    """
    spark = docs.sparkSession
    label, paths = classes(docs)
    label, label_path = stored(label.where("component is not null").select("doc_id", "tie", "component"), "labels")
    discard(spark, *paths)
    me = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie")
    chosen = label.groupBy("component").agg(F.min(me).alias("kept"))
    gone = label.join(chosen, "component").where(me != F.col("kept")).select(F.col("doc_id").alias("_gone_id"), F.col("tie").alias("_gone_tie")).distinct()
    same = lambda other, i, t: docs["doc_id"].cast("long").eqNullSafe(other[i]) & (F.xxhash64(docs["text"].cast("string")) == other[t])
    kept = docs.join(gone, same(gone, "_gone_id", "_gone_tie"), "left_anti")
    again = label.groupBy("doc_id", "tie").count().where("count > 1").select(F.col("doc_id").alias("_again_id"), F.col("tie").alias("_again_tie"))
    if not again.limit(1).count():
        return kept
    # Only rows that are repeated as they are have to meet once more.
    once = docs.join(again, same(again, "_again_id", "_again_tie"), "left_anti").join(gone, same(gone, "_gone_id", "_gone_tie"), "left_anti")
    twice = docs.join(again, same(again, "_again_id", "_again_tie")).join(gone, same(gone, "_gone_id", "_gone_tie"), "left_anti")
    return once.unionByName(twice.dropDuplicates(["_again_id", "_again_tie"]).select(*[docs[c] for c in docs.columns]))
