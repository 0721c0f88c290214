"""Packing documents into sequences of at most ``CAPACITY`` tokens, as few as best fit decreasing finds, with certificates.

Documents become pieces: their ids and an end mark, cut into whole sequences behind a first piece that takes the rest.  Only lengths
matter for packing.  Pieces are dealt to partitions of some ``ROWS`` and packed there by best fit decreasing; dual feasible functions of
the lengths give a lower bound of each partition's sequences.  A partition that meets its bound is certified.  Those with a gap exchange
documents: the pieces of their sequences that aren't full are dealt anew, to other partitions, and packed again; so are the pieces of the least
filled sequence of each certified partition, whose bounds are rounded up one by one.  Rounds end when no gap is left, when one saves
nothing, or after ``ROUNDS``.  Nothing but counts reaches the driver.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathwarden.llm.common import stored

CAPACITY = 2048
END = 0
ROWS = 16_384
ROUNDS = 8
VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"

#: Stretches so long are left to the slower tokenizer, which takes them in linear time and stack.
_STRETCH = re.compile(r"\S{2000}|\s{2000}|[^\w\s]{2000}")


def vocabulary(name: str = VOCABULARY) -> str:
    """Place of a public tokenizer's file, the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts in a byte-level vocabulary.

    The vocabulary is at hand in two forms.  The ranks give the same ids several times faster (no offsets are kept) and
    serve ordinary texts; the other form takes texts that spell a special token and those with endless stretches.
    """

    def __init__(self, path: str, ranks: str | None):
        self.path, self.ranks = path, ranks
        self._fast = self._exact = None

    def __getstate__(self):
        return {"path": self.path, "ranks": self.ranks, "_fast": None, "_exact": None}

    def _open(self) -> None:
        from tokenizers import Tokenizer

        self._exact = Tokenizer.from_file(self.path)
        self.special = [t.content for t in self._exact.get_added_tokens_decoder().values()]
        if self.ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(self.ranks, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, no special ones added; none for null or empty texts."""
        if not text:
            return []
        if self._exact is None:
            self._open()
        if self._fast is None or any(s in text for s in self.special) or _STRETCH.search(text):
            return self._exact.encode(text, add_special_tokens=False).ids
        return self._fast.encode_ordinary(text)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: the rest first, then whole sequences."""
    rest = n % capacity
    starts = range(rest, n, capacity)
    return ([(0, rest)] if rest else []) + [(s, capacity) for s in starts]


def pieces(docs: DataFrame, encoder: Encoder, capacity: int = CAPACITY, end: int = END, doc_id: str = "doc_id", text: str = "text", ids: bool = False) -> tuple[DataFrame, str]:
    """Stored pieces of all documents: row (a number of the piece), doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A null or empty text is a piece of the end mark alone.  Also returns the path of the table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(encoder)
    slim = docs.select(F.col(text).alias("text"), F.col(doc_id).alias("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = shared.value.encode
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                row, at, start, length, crc, own = [], [], [], [], [], []
                for k, t in enumerate(part.column(0).to_pylist()):
                    raw = memoryview(array("I", [*encode(t), end]).tobytes())
                    for p, (s, n) in enumerate(cut(len(raw) // 4, capacity)):
                        piece = raw[4 * s : 4 * (s + n)]
                        row.append(k)
                        at.append(p)
                        start.append(s)
                        length.append(n)
                        crc.append(zlib.crc32(piece))
                        if ids:
                            own.append(np.frombuffer(piece, "<u4").astype(np.int32))
                got = [part.column(1).take(pa.array(row, pa.int64())), pa.array(at, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays([*got, *([pa.array(own, pa.list_(pa.int32()))] if ids else [])], ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])])

    schema = f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if ids else "")
    return stored(slim.mapInArrow(run, schema).select(F.monotonically_increasing_id().alias("row"), "*"), "pieces")


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Sequence and offset of each length, which must come longest first, and how much each sequence holds.

    A length goes into the sequence with the least room that suffices; bit k of ``rooms`` says whether one has room k.
    """
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, held = 0, []
    where, offsets = [], []
    for n in lengths:
        if fits := rooms >> n:
            room = n + (fits & -fits).bit_length() - 1
            s = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
        else:
            s, room = len(held), capacity
            held.append(0)
        where.append(s)
        offsets.append(held[s])
        held[s] += n
        if room > n:
            with_room[room - n].append(s)
            rooms |= 1 << (room - n)
    return where, offsets, held


def least_sequences(counts: np.ndarray, capacity: int) -> int:
    """A lower bound of the sequences that pieces need; ``counts[n]`` of them have length n.

    The greatest over two families of dual feasible functions: lengths above ``capacity - k`` count as whole and those below k as none, for
    each k; multiples of ``capacity / (k + 1)`` are kept and others rounded down to k-ths, for small k, also applied after the first.
    """
    n = np.arange(capacity + 1)
    c = np.asarray(counts, np.int64)
    many, total = np.cumsum(c), np.cumsum(c * n)
    k = np.arange(0, capacity // 2 + 1)
    below = np.maximum(k - 1, 0)
    tops = capacity - k
    large = many[-1] - many[tops]
    middle = total[tops] - np.where(k > 0, total[below], 0)
    bound = int(np.max(large + -(-middle // capacity)))
    for j in range(1, 33):
        whole = n * (j + 1) % capacity == 0
        # In units of capacity * j, so that all stays in integers.
        worth = np.where(whole, n * j, n * (j + 1) // capacity * capacity)
        upto = np.cumsum(c * worth)
        middle = upto[tops] - np.where(k > 0, upto[below], 0)
        bound = max(bound, int(np.max(large + -(-middle // (capacity * j)))))
    return bound


def _packed(rows: DataFrame, parts: int, first: int, salt: int, capacity: int) -> DataFrame:
    """Pack ``rows`` (row, length), dealt by hash to ``parts`` partitions: sequence_id, offset, held, part, gap and least are added.

    A partition's number starts at ``first``; least marks the rows of its least filled sequence.
    """

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("row", "ascending")])
        lengths = t["length"].to_pylist()
        where, offsets, held = best_fit(lengths, capacity)
        bound = least_sequences(np.bincount(lengths, minlength=capacity + 1), capacity)
        part, where = t["part"][0].as_py(), np.array(where, np.int64)
        full = np.array(held, np.int64)
        more = [(part << 24) + where, np.array(offsets, np.int64), full[where], np.full(len(where), len(held) - bound), where == int(np.argmin(full))]
        return pa.table([t["row"], t["length"], t["part"], *map(pa.array, more)], names=["row", "length", "part", "sequence_id", "offset", "held", "gap", "least"])

    dealt = rows.select("row", "length", (F.lit(first) + F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(parts))).cast("long").alias("part"))
    return dealt.groupBy("part").applyInArrow(run, "row long, length long, part long, sequence_id long, offset long, held long, gap long, least boolean")


def packed(pieces: DataFrame, capacity: int = CAPACITY, rows: int = ROWS, rounds: int = ROUNDS) -> DataFrame:
    """row, length, sequence_id and offset of every piece (row, length); a piece as long as a sequence is alone in one.

    Stored round by round; an exchange is taken over only if it saves sequences.
    """
    whole = pieces.where(F.col("length") >= capacity).select("row", "length", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    done, first, used = [whole], 0, None
    loose = pieces.where(F.col("length") < capacity).select("row", "length")
    for k in range(rounds):
        n = loose.count()
        parts = -(-n // rows)
        if not n:
            break
        again, _ = stored(_packed(loose, parts, first, k, capacity), "packed")
        first += parts
        if used is not None and again.where("offset = 0").count() >= used:
            break
        more = (F.col("held") < capacity) & ((F.col("gap") > 0) | F.col("least"))
        done.append(again.where(~more))
        loose = again.where(more)
        used = loose.where("offset = 0").count()
        if parts == 1:  # no other partition is left to exchange with
            break
    if used is not None:
        done.append(loose)
    return reduce(DataFrame.unionByName, (x.select("row", "length", "sequence_id", "offset") for x in done))


def pack(docs: DataFrame, encoder: Encoder | None = None, capacity: int = CAPACITY, end: int = END, doc_id: str = "doc_id", text: str = "text", rows: int = ROWS, rounds: int = ROUNDS, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, (ids,) sequence_id and offset of every piece of ``docs``."""
    encoder = encoder or Encoder(vocabulary(), vocabulary(RANKS))
    own, _ = pieces(docs, encoder, capacity, end, doc_id, text, ids)
    placed = packed(own, capacity, rows, rounds).select(F.col("row").alias("at"), "sequence_id", "offset")
    return own.join(placed, own["row"] == placed["at"]).drop("row", "at")


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """sequence_id, ids and doc_ids of whole sequences, from :func:`pack` with ``ids``; each has ``CAPACITY`` ids at most."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("p")
    return packed_pieces.groupBy("sequence_id").agg(parts).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))


def certificate(packed_pieces: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """Sequences used, and the lower bound of all pieces' lengths together (``capacity`` counts reach the driver)."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in packed_pieces.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    return packed_pieces.where("offset = 0").count(), least_sequences(counts, capacity)


def op11_pack(docs: DataFrame) -> DataFrame:
    """Every piece of ``docs`` with its place.

    A null text counts as empty: its document is the end mark alone.  Null and repeated doc_ids are documents of their own.
    Texts of any length are cut, none is dropped.  Ties in length are packed in the order of the stored pieces.  No rows give no rows.
    Other columns play no part, whatever their names.
    """
    return pack(docs)
