"""SentencePiece encoding and decoding with a unigram search.

An Aho-Corasick automaton over the pieces reports, at every position, the pieces
that end there (longest first, along output links); each relaxes the best score of that
position.  One pass gives the segmentation with the greatest sum of scores; of equal
sums the longest last piece wins.  A character that is no piece costs ``UNKNOWN`` less than
the least score and becomes byte pieces, so decoding gives back any text.

Texts get one space in front, spaces become U+2581; a U+2581 in a text becomes bytes.
No piece has U+2581 behind another character, so a text falls into stretches (spaces and what
follows them) that can be searched on their own and remembered; when a model has such
pieces, whole texts are searched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN = 10.0
#: Stretches that a worker remembers, in each of two generations.
REMEMBERED = 300_000
_LONGEST = 200


def load(path: str = MODEL) -> list[tuple[str, float, str]]:
    """(piece, score, kind) by id from a model file; kinds are normal, byte and other."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: "byte" if m.is_byte(i) else "other" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else "normal"
    return [(m.id_to_piece(i), m.get_score(i), kind(i)) for i in range(m.get_piece_size())]


class Pieces:
    """A model's pieces, ready to encode and decode."""

    def __init__(self, pieces: list[tuple[str, float, str]]):
        self.pieces = pieces
        self._made = False

    def __getstate__(self):
        return {"pieces": self.pieces, "_made": False}

    def _make(self) -> None:
        normal = [(p, s, i) for i, (p, s, k) in enumerate(self.pieces) if k == "normal" and p]
        self.auto = ahocorasick.Automaton()
        for p, s, i in normal:
            if p not in self.auto:
                self.auto.add_word(p, (len(p), s, i))
        self.auto.make_automaton()
        self.single = {p for p, _, _ in normal if len(p) == 1}
        self.unknown = min(s for _, s, _ in normal) - UNKNOWN
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(self.pieces) if k == "byte"}
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no piece for every byte")
        inside = any(SPACE in p.lstrip(SPACE) for p, _, _ in normal)
        lines = not any("\n" in p for p, _, _ in normal)
        self.split = None if inside else re.compile(rf"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+" if lines else rf"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        back = {i: b for b, i in self.byte_ids.items()}
        self.bytes_of = [bytes([back[i]]) if i in back else p.replace(SPACE, " ").encode() if k == "normal" else b"" for i, (p, _, k) in enumerate(self.pieces)]
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self._made = True

    def search(self, s: str) -> list[int]:
        """Ids of the best segmentation of a prepared string."""
        n = len(s)
        ends: list[list] = [[] for _ in range(n)]
        for end, match in self.auto.iter(s):
            ends[end].append(match)
        best, back = [0.0] * (n + 1), [(0, 0)] * (n + 1)
        for e in range(n):
            top, how = float("-inf"), (1, -1)
            for length, score, i in ends[e]:
                c = best[e + 1 - length] + score
                if c > top:
                    top, how = c, (length, i)
            if s[e] not in self.single:
                c = best[e] + self.unknown
                if c > top:
                    top, how = c, (1, -1)
            best[e + 1], back[e + 1] = top, how
        out, e = [], n
        while e:
            length, i = back[e]
            if i >= 0:
                out.append(i)
            else:
                c = s[e - 1]
                out.extend(self.byte_ids[b] for b in reversed((SPACE if c == _MARK else c).encode("utf-8", "surrogatepass")))
            e -= length
        out.reverse()
        return out

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids as little-endian int32; none for null or empty texts."""
        if not self._made:
            self._make()
        if not text:
            return b""
        if _MARK in text:
            own = np.array([self.byte_ids[b] for b in _MARK.encode()], "<i4").tobytes()
            return own.join(self._encode(x) if k else self._encode(" " + x) for k, x in enumerate(text.split(_MARK)))
        return self._encode(" " + text)

    def _encode(self, text: str) -> bytes:
        s = text.replace(SPACE, _MARK).replace(" ", SPACE)
        if self.split is None:
            return np.array(self.search(s), "<i4").tobytes()
        new, old, out = self.new, self.old, []
        for part in self.split.findall(s):
            got = new.get(part)
            if got is None:
                got = old.get(part)
                if got is None:
                    got = np.array(self.search(part), "<i4").tobytes()
                if len(part) <= _LONGEST:
                    if len(new) >= REMEMBERED:
                        self.old = old = new
                        self.new = new = {}
                    new[part] = got
            out.append(got)
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<i4").tolist()

    def decode(self, ids) -> str:
        if not self._made:
            self._make()
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        return raw[1 if raw[:1] == b" " else 0 :].decode("utf-8", "surrogatepass")


#: Stands for a U+2581 of the text while it is searched; where a text holds this noncharacter itself, it is set apart first.
_MARK = "\ufdd0"


def encode_texts(docs: DataFrame, model: list[tuple[str, float, str]], others: list[str] = ["doc_id"], check: bool = True) -> DataFrame:  # noqa: B006
    """``others`` columns, n_tokens, token_ids and, with ``check``, whether decoding gives the text back.

    Null texts have no tokens and decode to an empty text, which counts as given back.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Pieces(model))
    slim = docs.select("text", *others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        for b in batches:
            # A part of a batch at a time bounds the memory that tokens take.
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                texts = part.column(0).to_pylist()
                raw = [pieces.encode_bytes(t) for t in texts]
                offsets = np.cumsum([0] + [len(x) // 4 for x in raw])
                flat = np.frombuffer(b"".join(raw), "<i4")
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                back = [[pieces.decode(np.frombuffer(x, "<i4").tolist()) == (t or "") for x, t in zip(raw, texts)]] if check else []
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(np.diff(offsets), pa.int64()), ids, *(pa.array(x) for x in back)], [*b.schema.names[1:], "n_tokens", "token_ids", *(["round_trip"] if check else [])])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[1:])
    return slim.mapInArrow(run, f"{kinds}, n_tokens long, token_ids array<int>" + (", round_trip boolean" if check else ""))


def decode_tokens(df: DataFrame, model: list[tuple[str, float, str]], others: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """``others`` columns and the text of ``token_ids``; null ids decode to an empty text."""
    shared = df.sparkSession.sparkContext.broadcast(Pieces(model))
    slim = df.select("token_ids", *others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([shared.value.decode(x or []) for x in b.column(0).to_pylist()], pa.string())], [*b.schema.names[1:], "text"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[1:])
    return slim.mapInArrow(run, f"{kinds}, text string")


def op3_pieces(docs: DataFrame, model: str = MODEL) -> DataFrame:
    return encode_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), load(model))
