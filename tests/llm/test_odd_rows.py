"""Null ids, repeated rows and clashing names where links, lines or words could get lost; contracts recounted."""

import re
import zlib

import numpy as np

from pathwarden.llm import common, forest, jaccard_join, line_dedup, mixing, mpeg, queries, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows, more=""):
    return spark.createDataFrame(rows, "doc_id long, text string, source string" + more)


def chain():
    """Three texts of which the first links to the second and the second to the third only."""
    a = [f"w{i}" for i in range(104)]
    b = a[:92] + [f"x{i}" for i in range(6)] + a[98:]
    c = [f"y{i}" for i in range(6)] + b[6:]
    sets = [{tuple(t[k : k + 5]) for k in range(100)} for t in (a, b, c)]
    near = lambda p, q: 100 * len(p & q) >= 80 * len(p | q)
    assert near(sets[0], sets[1]) and near(sets[1], sets[2]) and not near(sets[0], sets[2])
    return [" ".join(t) for t in (a, b, c)]


def test_rows_without_id_link_others(spark):
    a, b, c = chain()
    got = jaccard_join.op6_jaccard(frame(spark, [(5, a, "s"), (None, b, "s"), (9, c, "s"), (None, "alone and without a number", "s")])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (0, 5), (5, 5), (9, 5)]


def test_one_of_each_group_stays_by_its_own_text(spark):
    x, unique = chain()[0], "a text that no other row of the whole table has at all"
    twice = "these words stand in two rows with one number"
    rows = [(1, x, "s", 1), (2, x, "s", 2), (2, unique, "s", 3), (None, x, "s", 4), (7, twice, "s", 5), (7, twice, "s", 6), (8, None, "s", 7), (8, None, "s", 8)]
    kept = jaccard_join.keep_one(frame(spark, rows, ", _gone_id long")).collect()
    got = sorted((r["doc_id"], r["text"] or "") for r in kept)
    assert got == [(1, x), (2, unique), (7, twice), (8, ""), (8, "")]


def test_lines_of_rows_without_id_come_first(spark):
    line = " ".join(f"w{i}" for i in range(60))
    rows = [(None, line, "s"), (1, line.replace("w59", "other") + "\nmy own line of words", "s")]
    d = frame(spark, [(i, t, s, 3, 4) for i, t, s in rows], ", want long, tie long")
    got = {r["doc_id"]: r["removed_lines"] for r in line_dedup.op5_lines(d).collect()}
    assert got == {None: "", 1: "0"}
    kept = {r["doc_id"]: (r["text"], r["want"], r["tie"]) for r in line_dedup.without_repeated_lines(d).collect()}
    assert kept == {None: (line, 3, 4), 1: ("my own line of words", 3, 4)}


def test_rows_alike_are_mixed_one_by_one(spark):
    a, b = " ".join(f"a{i}" for i in range(300)), " ".join(f"b{i}" for i in range(500))
    rows = [(1, a, "s"), (1, a, "s"), (2, b, "t"), (None, b, None), (3, None, "t")]
    d = frame(spark, [(*r, 1) for r in rows], ", _tie long")
    taken = sorted((r["doc_id"] or 0, r["taken"]) for r in mixing.op2_mix(d).collect())
    texts = sorted((r["doc_id"] or 0, len(WORD.findall(r["text"]))) for r in mixing.mixed_documents(d).collect())
    assert texts == [x for x in taken if x[1]] and all(t <= 900 for i, t in taken if i == 1) and len(taken) == 5


def test_taken_words_are_in_the_mixed_texts(spark, sf):
    """Words recounted in the texts themselves: as many as op2 says, each document's own."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    own = {r["doc_id"]: set(WORD.findall(r["text"] or "")) for r in d.collect()}
    said = {r["doc_id"]: r["taken"] for r in queries.op2_mix(spark, sf).collect() if r["taken"]}
    found = {r["doc_id"]: WORD.findall(r["text"]) for r in mixing.mixed_documents(d).collect()}
    assert {i: len(w) for i, w in found.items()} == said
    assert all(set(w) <= own[i] for i, w in found.items())


def test_toxicity_contract(spark):
    sf = "/root/testdata/sf0.01"
    got = toxicity.op8_toxicity(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got)
    assert {r["held_out"] for r in got} == {True, False}


def test_sketches_never_part_sets_that_link():
    rng = np.random.default_rng(6)
    for n in (1, 5, 40, 146, 1000, 6000):
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        for lost in (0, 0.05, 0.1):
            y = np.unique(np.concatenate([x[rng.random(len(x)) >= lost], rng.integers(0, 1 << 63, int(n * lost), dtype=np.uint64)]))
            common_ = len(np.intersect1d(x, y))
            if len(y) and 100 * common_ >= 80 * (len(x) + len(y) - common_):
                apart = sum(int(v).bit_count() for v in (jaccard_join.sketch(x) ^ jaccard_join.sketch(y)).view(np.uint64))
                assert apart <= len(np.setxor1d(x, y)) and 9 * apart <= len(x) + len(y)


def test_vectors_with_repeated_and_null_ids(spark):
    v, w = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    d = spark.createDataFrame([(1, v, 5), (1, v, 6), (None, v, 7), (4, w, 8), (None, None, 9)], "vec_id long, embedding array<double>, rep long")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in forest.op1_forest(d).collect())
    assert got == [(0, 0, 0, False), (0, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True), (4, 0, 4, True)]


def test_durations_are_exact_at_any_rate():
    """1,000 frames at 44.1 kHz, whose single durations are no whole microseconds."""
    head = bytes([0xFF, 0xFB, 0x90, 0xC0])  # no checksum, 128 kbit/s, 44.1 kHz, mono
    n = mpeg.frame_length(head)
    s = mpeg.scan(head.ljust(n, b"\0") * 1000)
    assert s["frames"] == 1000 and s["duration_us"] == 1152 * 1000 * 1_000_000 // 44100


def test_tags_are_read():
    s = mpeg.scan(mpeg.encode(mpeg.pad(b"x")))
    assert s["tag_texts"] == {"TXXX:unit": "576"}


def test_stored_tables_are_released(spark):
    before = common.kept_tables()
    df = jaccard_join.op6_jaccard(frame(spark, [(1, "a b c d e f", "s"), (2, "a b c d e f", "s")]))
    assert df.count() == 2 and len(common.kept_tables()) > len(before)
    common.release(spark, but=before)
    assert common.kept_tables() == before
