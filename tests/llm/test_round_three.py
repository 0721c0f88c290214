"""Packing, resampling and manifests against brute force, with odd rows."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathwarden.llm import merkle, packing, queries, resampling, sql

ODD = "doc_id long, text string, lang string, source string, n_chars long, part int, weight string, digest int, path string, g long, row int"
OWN = (7, "w", 3, "p", 4, 5)  # columns whose names the operators use themselves


def odd_rows():
    long = " ".join(f"Word{i % 977} and, more; ÄÖ" for i in range(9_000))
    rows = [(1, None, "en", "a", None), (2, "", None, "a", 0), (3, " \n\t ", "de", None, 4), (4, "One two\tTHREE", "en", "b", 13), (4, "One two\tTHREE", "en", "b", 13),
            (None, "no id Here", "en", "b", 9), (None, None, None, None, None), (6, long, "fr", "c", len(long)), (7, long.upper(), "fr", "c", 5), (8, "x" * 60_000, "en", "c", 1),
            (9, "ends <|endoftext|> here", "en", "d", 1)]
    rng = random.Random(12)
    words = [f"v{i}" for i in range(50)] + ["Ünter", "naïve", "x9"]
    copies = " ".join(rng.choice(words) for _ in range(40))
    rows += [(10 + k, copies if k % 3 == 0 else " ".join(rng.choice(words) for _ in range(rng.choice([3, 19, 20, 21, 200]))), rng.choice(["en", "de", None]), "s", k) for k in range(150)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, *OWN) for r in odd_rows()], ODD).repartition(5)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.vocabulary())


@pytest.mark.parametrize("name", ["op12_resample", "op13_merkle"])
def test_same_as_sql(spark, sf, duck, same, name):
    same(queries.queries()[name](spark, sf).toPandas(), duck.sql(sql.ORACLES[name]).df())


# Packing


def check_packing(got, texts, tokenizer, capacity):
    """Pieces are those of whole texts, and sequences are gapless; returns the number of sequences."""
    want = Counter()
    for i, t in texts:
        ids = [*(tokenizer.encode(t or "", add_special_tokens=False).ids), 0]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(itertools.pairwise(cuts)):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    of = {}
    for r in got:
        of.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in of.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return len(of)


def test_packing_of_odd_rows(odd, tokenizer):
    got = packing.op11_pack(odd).collect()
    n = check_packing(got, [(r[0], r[1]) for r in odd_rows()], tokenizer, 2048)
    assert n <= math.ceil(sum(r["length"] for r in got) / 2048) + 1
    assert packing.op11_pack(odd.limit(0)).count() == 0


def test_packing_of_a_table(spark, sf, tokenizer):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = packing.op11_pack(docs)
    used = check_packing(got.collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], tokenizer, 2048)
    assert packing.certificate(got)[0] == used


def test_exchange_saves_sequences(spark):
    """Lengths that fill sequences only together with lengths of other partitions."""
    rng = random.Random(5)
    lengths = []
    for _ in range(400):
        a = rng.randint(20, 70)
        lengths += [a, 100 - a]
    rows = spark.createDataFrame(list(enumerate(lengths)), "row long, length long")
    counts = np.bincount(lengths, minlength=101)
    used = lambda **k: packing.packed(rows, 100, **k).select("sequence_id").distinct().count()
    alone, exchanged = used(rows=50, rounds=1), used(rows=50, rounds=8)
    assert packing.least_sequences(counts, 100) <= exchanged < alone
    placed = packing.packed(rows, 100, rows=50).collect()
    assert sorted(r["row"] for r in placed) == list(range(800))


def fewest(lengths, capacity):
    """Bins of an optimal packing, by search."""
    best = [len(lengths)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(rooms)
            return
        for s in sorted({*rooms}):
            if s >= lengths[k]:
                left = list(rooms)
                left.remove(s)
                go(k + 1, [*left, s - lengths[k]])
        go(k + 1, [*rooms, capacity - lengths[k]])

    go(0, [])
    return best[0]


def test_bounds_hold():
    rng = random.Random(6)
    tight = 0
    for _ in range(150):
        capacity = rng.choice([10, 24, 60])
        lengths = sorted((rng.randint(1, capacity - 1) for _ in range(rng.randint(1, 9))), reverse=True)
        optimum = fewest(lengths, capacity)
        bound = packing.least_sequences(np.bincount(lengths, minlength=capacity + 1), capacity)
        where, offsets, held = packing.best_fit(lengths, capacity)
        assert bound <= optimum <= len(held) and max(held) <= capacity
        assert sorted(held) == sorted(sum(n for n, s in zip(lengths, where) if s == k) for k in range(len(held)))
        tight += bound == optimum
        # Best fit by its definition.
        rooms = []
        for n in lengths:
            fits = [r for r in rooms if r >= n]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else capacity) - n)
        assert sorted(capacity - r for r in rooms) == sorted(held)
    assert tight > 120


def test_ranks_give_the_same_ids(tokenizer):
    rng = random.Random(7)
    encoder = packing.Encoder(packing.vocabulary(), packing.vocabulary(packing.RANKS))
    letters = "abc XYZ'sé漢字😀\n\t\r  .,!?--0123  ​́ß"
    for n in [0, 1, 2, 3, 5, 30, 200] * 60:
        t = "".join(rng.choice(letters) for _ in range(n))
        assert encoder.encode(t) == tokenizer.encode(t, add_special_tokens=False).ids
    for t in ["a" * 50_000, " " * 50_000, "-" * 5000, "\n" * 3000 + "x", "it's we'll I'D", "a <|endoftext|> b"]:
        assert encoder.encode(t) == tokenizer.encode(t, add_special_tokens=False).ids


def test_sequences_hold_the_ids(spark, tokenizer):
    docs = spark.createDataFrame([(k, f"some text number {k} " * (k % 9)) for k in range(40)], "doc_id long, text string")
    parts = packing.pack(docs, capacity=64, rows=10, ids=True).persist()
    for r in packing.sequences(parts).collect():
        own = sorted((p for p in parts.collect() if p["sequence_id"] == r["sequence_id"]), key=lambda p: p["offset"])
        assert r["ids"] == [x for p in own for x in p["ids"]] and r["doc_ids"] == [p["doc_id"] for p in own] and len(r["ids"]) <= 64


# Resampling


def words(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return "".join(c if c.isascii() and c.isalnum() or ord(c) >= 128 else " " for c in t).split(" ")


def brute_resample(docs, targets, longest=1, buckets=10_000, seed=2024, least=20, percent=10):
    def runs(t):
        w = [x for x in words(t) if x]
        return w, [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    at = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(at(f) for _, x in docs for f in runs(x)[1]), Counter(at(f) for x in targets for f in runs(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    rows = []
    for i, x in docs:
        w, f = runs(x)
        weight = sum(gain(at(g)) for g in f)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    enough = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(enough[: percent * len(enough) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in rows)


def test_resampling_of_odd_rows(spark, odd):
    targets = [None, "", "v1 v2 v3 NAÏVE x9 v1", "v1 v2", "one two"]
    target = spark.createDataFrame([(t, 1) for t in targets], "text string, weight int")
    docs = [(r[0], r[1]) for r in odd_rows()]
    assert Counter(map(tuple, resampling.op12_resample(odd, target).collect())) == brute_resample(docs, targets)
    got = resampling.resample(odd, target, buckets=97, longest=2, seed=5, least_words=3, percent=50).collect()
    assert Counter(map(tuple, got)) == brute_resample(docs, targets, 2, 97, 5, 3, 50)


def test_resampling_with_hot_texts(spark, odd, monkeypatch):
    """With every repeated text as a hot one, salted."""
    monkeypatch.setattr(resampling, "HOT", 4000)
    target = spark.createDataFrame([("v1 v2 v3",)], "text string")
    docs = [(r[0], r[1]) for r in odd_rows()]
    assert Counter(map(tuple, resampling.op12_resample(odd, target).collect())) == brute_resample(docs, ["v1 v2 v3"])


def test_resampling_of_empty_tables(spark, odd):
    none = spark.createDataFrame([], "text string")
    assert resampling.op12_resample(odd.limit(0), odd).count() == 0
    docs = [(r[0], r[1]) for r in odd_rows()]
    assert Counter(map(tuple, resampling.op12_resample(odd, none).collect())) == brute_resample(docs, [])


# Manifests


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """All levels of the tree of some leaves."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, i):
    out = []
    for nodes in levels[:-1]:
        start = i // 8 * 8
        out.append(("".join(nodes[start:i]), "".join(nodes[i + 1 : start + 8])))
        i //= 8
    return out


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 72, 73, 128, 513, 600, 4096])
@pytest.mark.parametrize("band", [1, 2, 3])
def test_traversal_gives_the_paths(n, band):
    leaves = [H(str(k)) for k in range(n)]
    levels = tree(leaves)
    assert merkle.height(n) == len(levels) - 1 and merkle.block_root(leaves, merkle.height(n)) == levels[-1][0]
    got = list(merkle.traverse(leaves, merkle.height(n), band))
    assert got == [siblings(levels, i) for i in range(n)]
    assert all(merkle.fold(leaves[i], got[i]) == levels[-1][0] for i in (0, n // 2, n - 1))


def test_traversal_keeps_few_nodes(monkeypatch):
    """Existing and desired subtrees of a large block hold far fewer nodes than its tree."""
    alive = []
    was = merkle.Growing.__init__

    def counted(self, low, high):
        was(self, low, high)
        alive.append(self)

    monkeypatch.setattr(merkle.Growing, "__init__", counted)
    most = 0
    leaves = [H(str(k)) for k in range(32_768)]
    for k, _ in enumerate(merkle.traverse(leaves, 5, 1)):
        if k % 997 == 0:
            most = max(most, sum(len(x) for t in alive[-10:] for x in t.nodes))
    assert most <= 2 * 5 * 8


def brute_manifest(rows):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    leaf = lambda i, t, lang, s, n: H(*map(part, (i, s, lang, n, t)))
    groups = {}
    for i, t, lang, s, n in rows:
        hit = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        groups.setdefault(lang, []).append((i, leaf(i, t, lang, s, n), leaf(i, low(t) if hit else t, lang, s, n)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[g] = tree([r[1] for r in groups[g]])
    top = tree([trees[g][-1][0] for g in order])
    out = Counter()
    for k, g in enumerate(order):
        for j, (i, own, read) in enumerate(groups[g]):
            path = siblings(trees[g], j) + siblings(top, k)
            folded = merkle.fold(read, path)
            out[i, own, trees[g][-1][0], top[-1][0], H(*(a + b for a, b in path)), folded, folded == top[-1][0]] += 1
    return out


def test_manifest_of_odd_rows(odd):
    got = merkle.op13_merkle(odd).collect()
    assert Counter(map(tuple, got)) == brute_manifest([r[:5] for r in odd_rows()])
    assert {r["verified"] for r in got} == {True, False}
    assert merkle.op13_merkle(odd.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1, 2])
def test_manifest_in_many_rounds(spark, block):
    """Blocks of 8 and 64 leaves, and more groups than a block holds."""
    rng = random.Random(8)
    rows = [(k, H(str(k)), rng.choice(["big", "big", "big", *(f"g{j}" for j in range(80)), None])) for k in range(1500)]
    df = spark.createDataFrame(rows, "k long, leaf string, g string").repartition(5)
    made = merkle.manifest(df, "leaf", "g", ["k"], ["k"], block=block)
    got = made.withColumns({"again": merkle.folded(F.col("leaf"), F.col("path")), "proof": merkle.proof_digest(F.col("path"))}).collect()
    groups = {}
    for k, h, g in rows:
        groups.setdefault(g, []).append((k, h))
    order = sorted(groups, key=lambda g: (g is not None, g or ""))
    trees = {g: tree([h for _, h in groups[g]]) for g in order}
    top = tree([trees[g][-1][0] for g in order])
    want = {k: (trees[g][-1][0], siblings(trees[g], j) + siblings(top, x)) for x, g in enumerate(order) for j, (k, _) in enumerate(groups[g])}
    assert len(got) == len(rows)
    for r in got:
        assert r["root"] == r["again"] == top[-1][0] and r["proof"] == H(*(a + b for a, b in want[r["k"]][1]))
        assert (r["subroot"], [tuple(p) for p in r["path"]]) == want[r["k"]]
