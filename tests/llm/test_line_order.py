"""The order of line tokens: read once, the same whether told by the least hashes or by all of them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pathwarden.llm import line_dedup


class Stop(Exception):
    pass


def test_texts_are_split_once_before_tokens_are_stored(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")

    def stop(*_):
        raise Stop

    def early(*_):
        raise AssertionError("a pass over the texts before the tokens are stored")

    monkeypatch.setattr(line_dedup, "stored", stop)
    monkeypatch.setattr(type(docs), "collect", early)
    with pytest.raises(Stop):
        line_dedup.removed_lines(docs)


def test_least_hashes_tell_the_order_or_nothing(spark):
    rng = random.Random(3)
    place = [0] * line_dedup.BUCKETS
    for i, b in enumerate(rng.sample(range(line_dedup.BUCKETS), line_dedup.BUCKETS // 4)):
        place[b] = i + 1
    rows = []
    for _ in range(200):
        t = sorted({rng.randrange(-(1 << 63), 1 << 63) for _ in range(rng.randint(1, 60))})
        rows.append((t, t[: len(t) // 5 + 1 + len(t) // 10 + 1], len(t)))
    df = spark.createDataFrame(rows, "t array<long>, low array<long>, n int")
    got = df.select("t", line_dedup.first_tokens(F.col("low"), F.col("n"), place).alias("a"), line_dedup.first_tokens(F.col("t"), F.col("n"), place).alias("b")).collect()
    for r in got:
        want = sorted(r["t"], key=lambda x: (place[x & (line_dedup.BUCKETS - 1)], x))[: len(r["t"]) // 5 + 1]
        assert r["b"] == want and r["a"] in (want, None)
    assert any(r["a"] is None for r in got) and any(r["a"] is not None and r["a"] != r["t"][: len(r["a"])] for r in got)


def test_lines_with_crowded_tokens(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(70):
        words = list(base)
        for at in rng.sample(range(40), rng.choice([0, 1, 2, 4])):
            words[at] = f"x{rng.randrange(5)}"
        rows.append((i, " ".join(words)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(36)} for i, t in rows}
    want = {i for i in sets if any(j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in sets)}
    read = []
    count = line_dedup.crowded
    monkeypatch.setattr(line_dedup, "crowded", lambda lines: read.append(count(lines)) or read[-1])
    got = line_dedup.op5_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got if r["n_removed"]} == want and 0 < len(want) < 69
    # Tokens beyond the least hashes are crowded as well, and counted.
    assert len(read) == 2 and sum(map(bool, read[1])) > sum(map(bool, read[0])) > 0


def test_lines_that_share_few_tokens_are_not_read_whole(spark, monkeypatch):
    rows = []
    for i in range(60):
        runs = [" ".join(f"r{i // 2}_{k}_{j}" for j in range(5)) for k in range(10)]
        rows.append((i, " ".join(f"{r} {' '.join(f'u{i}_{k}_{j}' for j in range(5))}" for k, r in enumerate(runs))))
    base = [f"b{j}" for j in range(60)]
    rows += [(100, " ".join(base)), (101, " ".join(base[:-1] + ["other"]))]
    pairs, verified = [], line_dedup._verified
    monkeypatch.setattr(line_dedup, "_verified", lambda p, sets: pairs.append(p.count()) or verified(p, sets))
    got = line_dedup.op5_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got if r["n_removed"]} == {101} and sum(pairs) == 1


def test_pairs_at_the_bound_stay(spark):
    """No similar pair is lost by the tokens that its prefixes share, whatever the order and the sizes."""
    rng = random.Random(9)
    rows, want = [], set()
    for k in range(3000):
        n = rng.randint(1, 60)
        common = rng.sample(range(400), n)
        x, y = (set(common) | {1000 + s + rng.randrange(100) for _ in range(rng.randint(0, max(1, n // 6)))} for s in (0, 1000))
        a, b = sorted(x), sorted(y)
        if 9 * len(x & y) >= 4 * (len(x) + len(y)):
            want.add(k)
        order = rng.sample(range(3000), 3000)
        a, b = (sorted(v, key=order.__getitem__) for v in (a, b))
        pa, pb = a[: len(a) // 5 + 1], b[: len(b) // 5 + 1]
        rows += [(k, 0, len(a), len(b), pa.index(t), pb.index(t)) for t in pa if t in pb]
    got = line_dedup._enough(spark.createDataFrame(rows, "y long, x long, ny int, nx int, py int, px int")).select("y").collect()
    assert want <= {r["y"] for r in got} and 100 < len(want) < 3000
