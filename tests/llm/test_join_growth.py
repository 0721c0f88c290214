"""The last join of operator 6: against a plain loop, and over batches of any length."""

import numpy as np
import pyarrow as pa

from pathwarden.llm import jaccard_join as J


def _rows(seed, buckets=40, classes=60):
    rng = np.random.default_rng(seed)
    n = rng.integers(5, 60, classes)
    sets = [np.unique(rng.integers(0, 2**63, k, dtype=np.uint64)) for k in n]
    for k in range(0, classes, 2):  # half of the classes are near another one
        sets[k] = np.unique(np.concatenate([sets[k - 1][1:], sets[k][:1]]))
    bits, c = [J.sketch(s) for s in sets], rng.integers(0, classes // 2, classes)
    rows = [(b, k, len(sets[k]), int(rng.integers(0, max(1, len(sets[k]) // 4))), int(c[k]), bits[k]) for b in range(buckets) for k in rng.choice(classes, rng.integers(1, 25), replace=False)]
    return sorted(rows, key=lambda r: (r[0], r[2], r[1]))


def _plain(rows):
    out = set()
    for p in rows:
        for q in rows:
            if p[0] == q[0] and p[1] < q[1] and p[4] != q[4] and p[2] * 5 >= q[2] * 4 and q[2] * 5 >= p[2] * 4 and min(p[2] - p[3], q[2] - q[3]) * 9 >= (p[2] + q[2]) * 4:
                if sum(int(x).bit_count() for x in (p[5] ^ q[5]).view(np.uint64)) * 9 <= p[2] + q[2]:
                    out.add((p[1], q[1]))
    return out


def _batches(rows, size):
    for lo in range(0, len(rows), size):
        part = rows[lo : lo + size]
        cols = [pa.array([r[i] for r in part], pa.int32() if i in (2, 3) else pa.int64()) for i in range(5)]
        yield pa.RecordBatch.from_arrays([*cols, pa.array([r[5].tolist() for r in part], pa.list_(pa.int64()))], ["sig", "key", "n", "pos", "c", "sketch"])


def test_candidates_are_those_of_a_plain_loop():
    for seed in range(3):
        rows = _rows(seed)
        want = _plain(rows)
        assert len(want) > 5
        for size in (1, 7, 100, 10_000):
            got = [(int(a), int(b)) for out in J._compare(_batches(rows, size)) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist())]
            assert set(got) == want
    assert list(J._compare(iter([]))) == []


def test_bits_of_negative_words_count():
    """Sketches that differ in the highest bit of a word and in one more differ in two bits."""
    x, y = np.zeros((1, 32), np.int64), np.zeros((1, 32), np.int64)
    y[0, 0] = np.int64(-(2**63) + 1)
    got = J.candidates(*(np.array(v) for v in ([5, 5], [2, 1], [9, 9], [0, 0], [1, 2])), np.concatenate([x, y]))
    assert got.tolist() == [[1, 2]]


def test_buckets_of_the_same_classes_are_one(spark):
    # Twenty texts share a passage of 60 words and differ in the rest: the shingles of the passage are in twenty classes.
    passage = " ".join(f"p{i}" for i in range(60))
    docs = spark.createDataFrame([(k, passage + " " + " ".join(f"w{k}-{i}" for i in range(40))) for k in range(20)], "doc_id long, text string")
    kept, was = {}, J.stored

    def stored(df, label):
        out = was(df, label)
        if label == "buckets":
            kept["rows"] = out[0].collect()
        return out

    J.stored = stored
    try:
        got = J.op6_jaccard(docs).toPandas()
    finally:
        J.stored = was
    # The passage's least hashes are in all prefixes: one bucket of twenty stands for several.
    assert max(r["times"] for r in kept["rows"]) > 1
    same = {}
    for r in kept["rows"]:
        same.setdefault(r["sig"], set()).add(r["key"])
    assert len({frozenset(x) for x in same.values()}) == len(same)
    assert (got["component_id"] == got["doc_id"]).all() and (got["n_shingles"] == 96).all()


def test_texts_moved_or_found_by_a_list_give_the_same(spark, monkeypatch):
    words = [" ".join(f"w{k // 3}-{i}" for i in range(60)) + f" end{k}" for k in range(12)]
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    got = []
    for few in (0, J.FEW):
        monkeypatch.setattr(J, "FEW", few)
        got.append({r["doc_id"]: r["component_id"] for r in J.op6_jaccard(docs).collect()})
    assert got[0] == got[1] == {k: k - k % 3 for k in range(12)}
