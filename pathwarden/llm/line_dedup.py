"""Line dedup by an exact set-similarity join, in DataFrame operations alone.

A line's tokens are its distinct five-word shingles (with fewer words, the whole
line), lower-cased.  A line goes if an earlier one, by doc_id and place, has a Jaccard
similarity of 0.8 or more.  Lines without words stay.

Tokens are ordered by hash, those of crowded hash buckets last: a bucket (of ``BUCKETS``, whatever the input) is crowded
if far more tokens of the classes are in it than in the middle one; among these the fuller bucket is the later one.
Every line keeps its least hashes, some more than its index takes, so its first tokens in the order are known
without the crowded ones being known before; only classes with too many crowded ones are read again.  The order changes work, not results.
Lines with equal tokens are one class, known by two hashes and by
its earliest line.  A class of n tokens is indexed under its first n // 5 + 1 tokens; classes
that share one are candidates if they pass the length filter, and are verified on
all tokens.  A class needs but one earlier match: it is first held against the
earliest class of the bucket that it meets most often, and only classes that this leaves open are held against all.
Pairs are first held against the number of indexed tokens that they share, and whole sets are read for those that
may still be similar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathwarden.llm.common import discard, stored

WORDS = 5
BUCKETS = 1 << 15
#: A bucket is crowded beyond the middle count by this many times what the middle is above the count that a sixth of them don't reach.
CROWDED = 6


def line_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, line_no, w) of every line: its words in order; a null text is one empty line."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), spaced(F.coalesce(F.col("text"), F.lit(""))).alias("_t"))
    return slim.select("doc_id", "tie", F.posexplode(F.split("_t", "\n")).alias("line_no", "line")).select("doc_id", "tie", "line_no", words_of(F.col("line")).alias("w"))


def spaced(text: Column) -> Column:
    """Lower case, and spaces for all other gaps but line feeds."""
    plain = text
    for gap in "\t\x0b\x0c\r":
        plain = F.replace(plain, F.lit(gap), F.lit(" "))
    # Few texts have other gaps, and one search tells.
    return F.lower(F.when(text.rlike(r"[\t\x0B\f\r]"), plain).otherwise(text))


def words_of(line: Column) -> Column:
    """A spaced line's words."""
    return F.array_remove(F.split(line, " "), "")


def tokens_of(words: Column) -> Column:
    """The distinct shingle hashes of a line's words, of which there must be one at least.

    Words are hashed as pairs, and a shingle as two pairs and a word, which takes fewer steps than five words.
    Nulls behind the last word leave a hash as it is, so fewer words give the hash of the whole line.
    """

    def shingles(w, pairs):
        starts = F.slice(pairs, F.lit(1), F.greatest(F.size(pairs) - (WORDS - 1), F.lit(1)))
        return F.transform(starts, lambda p, i: F.xxhash64(p, F.try_element_at(pairs, i + 3), F.try_element_at(w, i + 5)))

    # An array of one binds the words and the pairs, so that they are made once for a line and not for each shingle.
    pairs = lambda w: F.transform(w, lambda x, i: F.xxhash64(x, F.try_element_at(w, i + 2)))
    of = lambda w: F.transform(F.array(pairs(w)), lambda p: F.array_distinct(shingles(w, p)))[0]
    return F.transform(F.array(words), of)[0]


def indexed(n: Column) -> Column:
    """The number of tokens that a class of n is indexed under."""
    return F.floor(n / 5).cast("int") + 1


def bucket_of(token: Column) -> Column:
    return token.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def crowded(lines: DataFrame) -> list[int]:
    """0 for each bucket that isn't crowded, and the place (from 1) of each that is; counted over the tokens in ``low``."""
    counted = lines.select(F.explode("low").alias("t")).groupBy(bucket_of(F.col("t")).alias("b")).count()
    counts = [0] * BUCKETS
    for r in counted.collect():
        counts[r["b"]] = r["count"]
    by_count = sorted(range(BUCKETS), key=lambda b: (counts[b], b))
    middle = counts[by_count[BUCKETS // 2]]
    most = middle + CROWDED * max(1, middle - counts[by_count[BUCKETS // 6]])
    place = [0] * BUCKETS
    for i, b in enumerate(b for b in by_count if counts[b] > most):
        place[b] = i + 1
    return place


def first_tokens(tokens: Column, n: Column, place: list[int]) -> Column:
    """The first tokens of a class of n in the order, as many as it is indexed under.

    ``tokens`` are its least hashes, ascending; null if these don't tell.
    """
    table = F.split(F.lit(",".join(map(str, place))), ",").cast("array<int>")
    level = lambda t: table[bucket_of(t)]
    k = indexed(n)
    head = F.slice(tokens, F.lit(1), k)
    free = F.filter(tokens, lambda t: level(t) == 0)
    whole = F.transform(F.sort_array(F.transform(tokens, lambda t: F.struct(level(t).alias("level"), t.alias("t")))), lambda s: s["t"])
    # Most classes have no crowded token among their least hashes.
    return F.when(~F.exists(head, lambda t: level(t) > 0), head).when(F.size(tokens) == n, F.slice(whole, F.lit(1), k)).when(F.size(free) >= k, F.slice(free, F.lit(1), k))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (y, x) of classes with a Jaccard similarity of 0.8 or more."""
    a, b = sets.select(F.col("id").alias("y"), F.col("tokens").alias("ty")), sets.select(F.col("id").alias("x"), F.col("tokens").alias("tx"))
    common = F.size(F.array_intersect("ty", "tx")).cast("long")
    return pairs.join(a, "y").join(b, "x").where(common * 100 >= 80 * (F.size("ty") + F.size("tx") - common)).select("y", "x")


def _near(a, b) -> Column:
    """The length filter on two rows' n."""
    na, nb = a("n").cast("long"), b("n").cast("long")
    return (na * 5 >= nb * 4) & (nb * 5 >= na * 4)


def _enough(pairs: DataFrame) -> DataFrame:
    """Rows of tokens that both of (y, x) are indexed under, with n and pos of either, as pairs that may be similar.

    Behind the end of the prefix that ends first in the order, the two share at most what the other tokens of either allow.
    """
    told = pairs.groupBy("y", "x").agg(
        F.count("*").alias("both"), F.first("ny").cast("long").alias("ny"), F.first("nx").cast("long").alias("nx"), F.max("py").alias("py"), F.max("px").alias("px")
    )
    ny, nx, py, px = (F.col(c) for c in ("ny", "nx", "py", "px"))
    rest = F.greatest(F.least(ny - indexed(ny), nx - px - 1), F.least(ny - py - 1, nx - indexed(nx)))
    return told.where((F.col("both") + rest) * 9 >= (ny + nx) * 4)


def removed_lines(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """(doc_id, tie, line_no, removed) of every line of ``docs`` (doc_id, text), and the stored tables behind it; tie is the hash of the text.

    Rows alike in doc_id and text are one document.  Rows without doc_id come before all others, by the hash of their texts.
    """
    spark = docs.sparkSession
    t = F.when(F.size("w") > 0, F.sort_array(tokens_of(F.col("w"))))
    toks = line_rows(docs).select("doc_id", "tie", "line_no", t.alias("t"))
    n = F.size("t")
    # Two hashes of all tokens and n name the class.
    there = F.col("t").isNotNull()
    low = F.slice("t", F.lit(1), indexed(n) + F.floor(n / 10).cast("int") + 1)
    slim = toks.select("doc_id", "tie", "line_no", F.when(there, n).alias("n"), F.when(there, F.xxhash64("t", n)).alias("cls"), F.when(there, F.xxhash64(n, "t")).alias("cls2"), low.alias("low"))
    whole_lines, whole_path = stored(slim, "lines")

    def fetch(wanted: DataFrame) -> tuple[DataFrame, str]:
        """The tokens of classes (id, first), made anew from their lines."""
        wanted = wanted.select("id", "first.*")
        key = lambda doc_id, tie: [F.coalesce(doc_id, F.lit(0)).alias("_doc"), doc_id.isNull().alias("_none"), tie.alias("_tie")]
        keys = ["_doc", "_none", "_tie"]
        want_docs = wanted.groupBy(*key(F.col("doc_id"), F.col("tie"))).agg(F.collect_set(F.struct("line_no", "id")).alias("_want"))
        text = docs.select(*key(F.col("doc_id").cast("long"), F.xxhash64("text")), "text").join(want_docs, keys)
        pick = lambda ls: F.transform("_want", lambda w: F.struct(w["id"].alias("id"), F.get(ls, w["line_no"]).alias("line")))
        lines = text.select(F.explode(F.transform(F.array(F.split(spaced(F.col("text")), "\n")), pick)[0]).alias("_w")).select("_w.*")
        # Rows alike in doc_id and text give a line more than once.
        return stored(lines.select("id", F.sort_array(tokens_of(words_of(F.col("line")))).alias("tokens")).dropDuplicates(["id"]), "line-sets")

    at = F.struct("doc_id", "tie", "line_no")
    # The earliest line brings the tokens along.
    known = F.struct("doc_id", "tie", "line_no", "n", "low")
    classes = whole_lines.where("cls is not null").select("cls", "cls2", at.alias("at"), known.alias("known")).groupBy("cls", "cls2").agg(F.min("known").alias("known"), F.max("at").alias("last"))
    first = F.struct(*[F.col(f"known.{c}").alias(c) for c in ("doc_id", "tie", "line_no")])
    classes = classes.select(F.monotonically_increasing_id().alias("id"), "cls", "cls2", first.alias("first"), "last", "known.n", "known.low")
    classes, classes_path = stored(classes, "line-classes")
    all_lines, lines_path = stored(whole_lines.select("doc_id", "tie", "line_no", "cls", "cls2"), "lines")
    discard(spark, whole_path)

    place = crowded(classes.select("low"))
    of_low = lambda: first_tokens(F.col("low"), F.col("n"), place)
    sets, sets_path = fetch(classes.where(of_low().isNull()).select("id", "first"))
    if sets.limit(1).count():
        # The other tokens of these may be crowded too.
        place = crowded(classes.select("low").unionByName(sets.select(F.col("tokens").alias("low"))))

    size = F.col("n").cast("long")
    read = lambda s: s.select("id", F.size("tokens").alias("n"), first_tokens(F.col("tokens"), F.size("tokens"), place).alias("prefix"))
    lacking, lacking_path = stored(classes.where(of_low().isNull()).select("id", "first"), "line-wants")
    again_path = [sets_path, lacking_path]
    told = classes.select("id", "n", of_low().alias("prefix")).unionByName(read(sets.join(lacking, "id", "left_semi")))
    more = lacking.join(sets, "id", "left_anti")
    if more.limit(1).count():
        again, path = fetch(more)
        again_path.append(path)
        told = told.unionByName(read(again))
    rows = told.select("id", "n", F.posexplode("prefix").alias("pos", "tok"))
    # In order of size, a class whose neighbours are too far in size has no partner in the bucket.
    by_size = Window.partitionBy("tok").orderBy("n", "id")
    rows = rows.withColumns({"below": F.lag("n").over(by_size).cast("long"), "above": F.lead("n").over(by_size).cast("long")})
    rows = rows.where((F.col("below") * 5 >= size * 4) | (size * 5 >= F.col("above") * 4))
    rows, rows_path = stored(rows.select("tok", "id", "n", "pos"), "line-buckets")
    discard(spark, *again_path)
    # Few classes are left, which are numbered in the order of their earliest lines.
    order = classes.select("id", "first").join(rows.select("id").distinct(), "id", "left_semi").orderBy("first")
    order, order_path = stored(order.withColumn("no", F.monotonically_increasing_id()), "line-order")
    rows = rows.join(order.select("id", "no"), "id").select("tok", F.col("no").alias("id"), "n", "pos")
    buckets, buckets_path = stored(rows.withColumn("early", F.min(F.struct("id", "n", "pos")).over(Window.partitionBy("tok"))), "line-buckets")
    discard(spark, rows_path)

    def similar(pairs: DataFrame) -> DataFrame:
        """The later classes of the similar ones among stored ``pairs`` (y, x)."""
        ids = pairs.select(F.explode(F.array("y", "x")).alias("no")).distinct()
        sets, path = fetch(order.select("no", "first").join(ids, "no", "left_semi").withColumnRenamed("no", "id"))
        out = stored(_verified(pairs, sets).select("y").distinct(), "lines-gone")
        discard(spark, path)
        return out

    own, early = (lambda c: F.col(c)), (lambda c: F.col(f"early.{c}"))
    names = lambda a, b: [f(c).alias(f"{c}{k}" if c != "id" else k) for k, f in (("y", a), ("x", b)) for c in ("id", "n")] + [a("pos").alias("py"), b("pos").alias("px")]
    votes = _enough(buckets.where(own("id") != early("id")).where(_near(own, early)).select(*names(own, early)))
    first, first_path = stored(votes.groupBy("y").agg(F.max_by("x", F.struct("both", "x")).alias("x")), "line-pairs")
    gone, gone_path = similar(first)
    p, q = buckets.join(gone, buckets["id"] == gone["y"], "left_anti").alias("p"), buckets.alias("q")
    of_p, of_q = (lambda c: F.col(f"p.{c}")), (lambda c: F.col(f"q.{c}"))
    more = _enough(p.join(q, (F.col("p.tok") == F.col("q.tok")) & (F.col("q.id") < F.col("p.id")) & _near(of_p, of_q)).select(*names(of_p, of_q)))
    more, more_path = stored(more.select("y", "x").join(first, ["y", "x"], "left_anti"), "line-pairs")
    gone_more, gone_more_path = similar(more)
    gone2, gone2_path = stored(order.select("no", "id").join(gone.unionByName(gone_more), F.col("no") == F.col("y"), "left_semi").select(F.col("id").alias("y")), "lines-gone")
    discard(spark, buckets_path, order_path, first_path, gone_path, more_path, gone_more_path)
    # Only classes of which some line goes are joined back.
    state = classes.select("id", "cls", "cls2", "first", "last").join(gone2, classes["id"] == gone2["y"], "left")
    state = state.where("y is not null or first <> last").select("cls", "cls2", "first", F.col("y").isNotNull().alias("all_gone"))
    hit = all_lines.select("doc_id", "tie", "line_no", "cls", "cls2").join(state, ["cls", "cls2"], "left")
    removed = F.coalesce(F.col("all_gone") | (F.struct("doc_id", "tie", "line_no") > F.col("first")), F.lit(False))
    return hit.select("doc_id", "tie", "line_no", removed.alias("removed")), [lines_path, classes_path, gone2_path]


def op5_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and removed_lines (places from 0, ascending, joined by commas) per document.

    A null or empty text is one line without words, which stays.  Rows alike in doc_id and text are one document and give one row; rows that
    share a doc_id and differ in text are documents of their own, in the order of their texts' hashes.  Rows without doc_id come first.
    Texts and lines of any length count whole.  An empty table gives an empty one.  Columns but doc_id and text don't matter.
    """
    per = removed_lines(docs)[0].groupBy("doc_id", "tie").agg(F.max("line_no").alias("m"), F.sort_array(F.collect_set(F.when(F.col("removed"), F.col("line_no")))).alias("r"))
    return per.select("doc_id", (F.col("m") + 1).cast("long").alias("n_lines"), F.size("r").cast("long").alias("n_removed"), F.array_join(F.col("r").cast("array<string>"), ",").alias("removed_lines"))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the removed lines taken out of their texts and ``n_chars`` counted anew; every row stays, with its own columns, whatever their names.

    A null text stays null.  Odd rows are as in :func:`op5_lines`; rows alike in doc_id and text lose the same lines.
    """
    spark = docs.sparkSession
    removed, paths = removed_lines(docs)
    per = removed.where("removed").groupBy("doc_id", "tie").agg(F.collect_set("line_no").alias("gone"))
    per, _ = stored(per, "removed-lines")
    discard(spark, *paths)
    # Columns are taken from their own frames, so names that docs has too don't clash.
    hit = docs.join(per, docs["doc_id"].cast("long").eqNullSafe(per["doc_id"]) & (F.xxhash64(docs["text"]) == per["tie"]), "left")
    kept = F.array_join(F.filter(F.split(docs["text"], "\n"), lambda x, i: ~F.array_contains(per["gone"], i)), "\n")
    text = F.when(per["gone"].isNull(), docs["text"]).otherwise(kept)
    out = {c: docs[c] for c in docs.columns} | {"text": text}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.char_length(text).cast(docs.schema["n_chars"].dataType)
    return hit.select(*[v.alias(c) for c, v in out.items()])
