"""Output shards of the mix, its targets, and lexicon hits, against plain counts."""

import random
import re
from collections import Counter

from pathwarden.llm import mixing, queries, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_shards_hold_what_was_drawn(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()] + [(None, "three lonely words", None), (7, None, "x"), (None, "three lonely words", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix, got = mixing.Mix(docs), mixing.mixed_blocks(docs).collect()
    # Streams of the sources, laid out by the documents' places.
    text = {}
    for i, t, s in rows:
        text.setdefault((i, s), []).append(WORD.findall(t or ""))
    stream = {}
    for r in sorted(mix.sized.where("size > 0").collect(), key=lambda r: (r["source"] or "", r["start"])):
        own = stream.setdefault(r["source"], [])
        assert len(own) == r["start"]
        own += next(w for w in text[r["doc_id"], r["source"]] if len(w) == r["size"])
    for r in got:
        words = stream[r["source"]][r["block"] * mixing.BLOCK : (r["block"] + 1) * mixing.BLOCK]
        assert WORD.findall(r["text"]) == words and r["n_words"] == len(words)
    drawn = Counter()
    for source, shard, _, n, _ in mixing.draw([s for s in mix.sources if s["slots"]]):
        drawn[source, shard] += n
    assert Counter((r["source"], r["shard"]) for r in got) == drawn
    by_shard = {}
    for r in got:
        by_shard.setdefault(r["shard"], []).append(r["place"])
    sizes = [len(by_shard.get(k, [])) for k in range(mixing.SHARDS)]
    assert all(sorted(p) == list(range(len(p))) for p in by_shard.values()) and max(sizes) - min(sizes) <= 1
    taken = {r["doc_id"]: r["taken"] for r in queries.op2_mix(spark, sf).collect()}
    assert sum(taken.values()) > 0 and mixing.mixed_blocks(docs.limit(0)).count() == 0


def test_targets_are_fair():
    """Of sources below their stop all have the same share by weight, and all words are shared out where stops allow."""
    rng = random.Random(3)
    for _ in range(200):
        sizes = [rng.choice([0, 1, 10, 500, 10_000]) for _ in range(rng.randint(1, 9))]
        weights = [rng.choice([5, 2, 1]) for _ in sizes]
        got = mixing.targets(sizes, weights)
        assert all(t <= 3 * s + 1e-9 for t, s in zip(got, sizes)) and abs(sum(got) - min(sum(sizes), 3 * sum(sizes))) < 1e-6
        rates = [t / w for t, w, s in zip(got, weights, sizes) if s and t < 3 * s - 1e-9]
        assert not rates or max(rates) - min(rates) < 1e-6
        assert all(not rates or 3 * s / w <= max(rates) + 1e-6 for t, w, s in zip(got, weights, sizes) if s and t >= 3 * s - 1e-9)


def naive_hits(lexicon, folded):
    total, at, excepted = 0.0, 0, []
    for phrase in lexicon.exceptions:
        p = " " + " ".join(toxicity.fold(phrase).split())
        k = folded.find(p)
        while k >= 0:
            excepted.append((k, k + len(p) - 1))
            k = folded.find(p, k + 1)
    for m in re.finditer(r" ([^ ]*)", folded):
        best = max((w for s, w in lexicon.weights.items() if m.group(1).startswith(s)), default=0.0)
        if best > 0 and not any(x <= m.start() <= y for x, y in excepted):
            total += best
        at += 1
    return total


def test_hits_are_those_of_a_plain_search(spark):
    rng = random.Random(4)
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    learned = toxicity.learn(docs, labels)
    assert learned.weights
    texts = [r["text"] for r in docs.limit(150).collect()]
    made = toxicity.Lexicon({"bad": 2.0, "badly": 3.0, "idi": 1.5, "kill": 4.0}, ("kill time", "bad luck"))
    letters = ["bad", "badly", "b4d", "вad", "id1ot", "kill", "time", "luck", "KILL TIME", "unbad", "baд", "x", "kill-time", "1d!"]
    for _ in range(300):
        texts.append(" ".join(rng.choice(letters) for _ in range(rng.randint(0, 12))))
    for lexicon in (learned, made):
        for t in texts:
            folded = toxicity.fold(t)
            assert abs(lexicon.hits(folded) - naive_hits(lexicon, folded)) < 1e-9
