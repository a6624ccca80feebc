"""SentencePiece encoding and decoding as weighted finite-state transducers.

A model compiles to machines whose weights are costs, and whose composition with an input has the encoding as its
shortest path in the tropical semiring (costs add up along a path, the least of them counts):

* the normaliser, one state: its first arc writes the blank mark, an arc turns a blank into the mark, all other
  characters are copied;
* the piece machine, a trie over the pieces, read backwards, whose final arcs write a piece and return to the start; a
  unigram piece costs its negative score, a BPE piece nothing;
* the byte machine: an arc for each character without a piece, at a cost over that of all pieces, which writes the
  character's UTF-8 bytes;
* the order machine of a BPE model: its state is the piece written last, and it has an arc over another piece only
  where the merges of the two spelled together give back just these two; the cost of what has no arc is infinite. A
  BPE encoding is not the path of least additive score, but the one path that this machine accepts throughout. The
  order machine of a unigram model has one state and accepts everything.

Composing normaliser and input gives a string; piece and byte machine over it the arcs between character positions;
the order machine over those the states (position, last piece), whose costs are relaxed from left to right.

No piece crosses the borders between chunks (before blanks; around characters that occur in no longer piece), so
paths are searched per distinct chunk and kept.
"""

from __future__ import annotations

import array
import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only_cache

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
NONE = -1
INFINITE = float("inf")
MEMO = 1_000_000
LATIN = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ɏ"


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = out = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, raw[at : at + size]
            at += size


class Machines:
    """A compiled model."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = list(fields(f.read()))
        self.pieces: list[tuple[str, float, int]] = []
        for number, value in model:
            if number == 1:
                p = dict(fields(value))
                self.pieces.append((p.get(1, b"").decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
        train = dict(fields(next((v for n, v in model if n == 2), b"")))
        norm = dict(fields(next((v for n, v in model if n == 3), b"")))
        if norm.get(2) or norm.get(4, 1) or not norm.get(5, 1):
            raise ValueError("only models with the identity normaliser that keep blanks are compiled")
        self.kind, self.prefix = train.get(3, UNIGRAM), bool(norm.get(3, 1))
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are compiled")
        self.ids = {p: i for i, (p, _, t) in enumerate(self.pieces) if t in (NORMAL, USER, UNUSED)}
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == BYTE}
        self.longest = max(map(len, self.ids), default=1)
        self.trie: dict = {}
        for p, i in self.ids.items():  # backwards, so that a walk from a position finds the pieces that end there
            node = self.trie
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = i
        self.costs = [-score if self.kind == UNIGRAM else 0.0 for _, score, _ in self.pieces]
        self.unseen = min((s for _, s, t in self.pieces if t == NORMAL), default=0.0) - 10.0
        self.follows: dict[int, bool] = {}
        self.memo: dict[str, bytes] = {}
        self.spell: list[str] | None = None
        self.cut = re.compile(self._borders())

    def _borders(self) -> str:
        long = [p for p in self.ids if len(p) > 1]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in long):
            return r"(?s:.+)"
        inner = set("".join(long))
        alone = "".join(chr(c) for c in range(1, 128) if chr(c) not in inner and c != 32)
        after = set(re.findall(f"(?<=[{LATIN}])[!-/:-@\\[-`{{-~]", " ".join(long)))
        stop = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in after)
        alone, stop = (re.escape(x) for x in (alone, stop + alone))
        solo = f"|[{alone}]" if alone else ""
        return rf"{MARK}*[{LATIN}]+(?=[{MARK}{stop}]|\Z)|{MARK}*[^{MARK}{alone}]+|{MARK}+{solo}"

    def merged(self, text: str) -> list[int]:
        """BPE by its definition: join the pair of the best score, the leftmost of equals, until none is left. -1: no piece."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.pieces[i][1], -k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                break
            parts[-best[1] : 2 - best[1]] = [parts[-best[1]] + parts[1 - best[1]]]
        return [self.ids.get(p, -1) for p in parts]

    def may_follow(self, a: int, b: int) -> bool:
        """Has the order machine an arc from the state of piece `a` over piece `b`? NONE: the start, or a character without a piece."""
        if b < 0:
            return True
        if a < 0:
            return self._whole(b)
        key = a << 32 | b
        out = self.follows.get(key)
        if out is None:
            if len(self.follows) > 2 * MEMO:
                self.follows.clear()
            out = self.follows[key] = self.merged(self.pieces[a][0] + self.pieces[b][0]) == [a, b]
        return out

    def normalised(self, text: str) -> str:
        """Composition of an input with the normaliser."""
        text = text.replace(" ", MARK)
        return MARK + text if self.prefix else text

    def shortest(self, text: str) -> list[int]:
        """Pieces on the shortest path of a normalised text through the machines; NONE: a character without a piece.

        The composition is made as it is searched: at each position the piece machine walks back over the text, an arc
        for every piece that ends there, and the order machine takes those that it accepts from the state reached at
        their start. Either order machine is in one state at a position: a unigram machine has no other, and of a text
        up to there a BPE machine accepts just the one encoding, so that the first arc it accepts is the only one. Of
        equal costs the longer piece wins.
        """
        ordered, follows, trie, costs, n = self.kind == BPE, self.follows, self.trie, self.costs, len(text)
        cost, last, back = [0.0] + [INFINITE] * n, [NONE] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            node, at, least, single = trie, end, INFINITE, False
            while at:
                at -= 1
                node = node.get(text[at])
                if node is None:
                    break
                piece = node.get("")
                if piece is None:
                    continue
                single = single or at == end - 1
                if ordered:
                    before = last[at]
                    accepts = follows.get(before << 32 | piece if before >= 0 else NONE - piece)
                    if not (self.may_follow(before, piece) if accepts is None else accepts):
                        continue
                total = cost[at] + costs[piece]
                if total <= least:
                    least, last[end], back[end] = total, piece, at
                    if ordered:
                        break
            if not single and cost[end - 1] - self.unseen < least and not (ordered and least < INFINITE):  # the byte machine
                least, last[end], back[end] = cost[end - 1] - self.unseen, NONE, end - 1
            cost[end] = least
        out: list[int] = []
        while n:
            out.append(last[n])
            n = back[n]
        return out[::-1]

    def _whole(self, piece: int) -> bool:
        """The order machine's arc from the start: the piece is what its own text encodes to."""
        key = NONE - piece
        if key not in self.follows:
            self.follows[key] = self.merged(self.pieces[piece][0]) == [piece]
        return self.follows[key]

    def _chunk(self, text: str) -> bytes:
        out: list[int] = []
        at = 0
        for piece in self.shortest(text):
            if piece >= 0:
                out.append(piece)
                at += len(self.pieces[piece][0])
            else:
                raw = text[at].encode("utf-8", "replace")
                if self.bytes:
                    out += [self.bytes[b] for b in raw]
                elif not out or out[-1] != self.unknown:
                    out.append(self.unknown)
                at += 1
        return array.array("I", out).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; none for null and empty texts."""
        if not text:
            return b""
        chunks = self.cut.findall(self.normalised(text))
        memo = self.memo
        try:
            return b"".join(map(memo.__getitem__, chunks))
        except KeyError:
            if len(memo) > MEMO:
                memo.clear()
            for c in chunks:
                if c not in memo:
                    memo[c] = self._chunk(c)
            return b"".join(map(memo.__getitem__, chunks))

    def decode(self, ids: bytes | None) -> str:
        """Text of ids: the machines run backwards; bytes that are no UTF-8 become replacement characters."""
        if self.spell is None:  # a byte above 127 is a lone surrogate until all bytes are together
            value = {i: chr(b) if b < 128 else chr(0xDC00 + b) for b, i in self.bytes.items()}
            self.spell = [value.get(i, "") if t in (BYTE, CONTROL) else " ⁇ " if t == UNKNOWN else p.replace(MARK, " ") for i, (p, _, t) in enumerate(self.pieces)]
        text = "".join(map(self.spell.__getitem__, array.array("I", ids or b"")))
        if not text.isascii():
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_compiled: dict[str, Machines] = {}


def machines(path: str) -> Machines:
    only_cache("pieces", _compiled.clear)
    if path not in _compiled:
        _compiled[path] = Machines(path)
    return _compiled[path]


def encode(docs: DataFrame, *, model_path: str, text_col: str = "text") -> DataFrame:
    """All columns of `docs` and piece_ids (binary, little-endian unsigned 32-bit); empty for null and empty texts. A column of that name is replaced."""

    @F.pandas_udf("binary")
    def ids(texts: pd.Series) -> pd.Series:
        m = machines(model_path)
        return pd.Series([m.encode(t) for t in texts], dtype=object)

    kept = docs.select(*[docs[c] for c in docs.columns if c.lower() != "piece_ids"])
    return kept.withColumn("piece_ids", ids(F.col(text_col)))


def decode(rows: DataFrame, *, model_path: str, ids_col: str = "piece_ids") -> DataFrame:
    """All columns of `rows` and piece_text, the text of the ids; empty for null. A column of that name is replaced."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        m = machines(model_path)
        return pd.Series([m.decode(i) for i in ids], dtype=object)

    kept = rows.select(*[rows[c] for c in rows.columns if c.lower() != "piece_text"])
    return kept.withColumn("piece_text", text(F.col(ids_col)))
