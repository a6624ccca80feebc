"""Vector best-fit packing of tokenized documents into sequences.

Every bin has three capacities: tokens, documents and attention cost (the sum of squared piece lengths). What is left
of each is the bin's state, in exact integers. A piece goes, of the bins where it meets every constraint, to the one
whose residual vector is then shortest, or whose residuals have the largest weighted dot product with its demands.

An item's demands follow from its length alone, so items of one length are alike: the driver packs the histogram of
lengths (at most `capacity` numbers) in falling order, and rows then take the slots of their length by rank. Bins in
the same state are kept as ranges. A length ends in at most two new states more than it uses up, so the plan grows
with the number of lengths and not with the rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release
from .tokens import tokenizer

ROWS_PER_SALT = 20_000
BROADCAST_SLOTS = 1_000_000


@dataclass(frozen=True)
class Slots:
    """Items ranked first .. first + items - 1 of `length` go, `per_bin` to a bin, to bins from `bin` on, at `offset`."""

    length: int
    first: int
    items: int
    bin: int
    per_bin: int
    offset: int


class _Bins:
    """Open bins by state: residual tokens, documents and cost, and the ranges of bin numbers in that state."""

    def __init__(self):
        self.at: dict[tuple[int, int, int], int] = {}
        self.left = np.zeros((64, 3), np.int64)
        self.ranges: list[list[tuple[int, int]]] = []
        self.free: list[int] = []

    def add(self, state: tuple[int, int, int], lo: int, hi: int) -> None:
        if state[0] < 1 or state[1] < 1 or state[2] < 1:
            return  # full
        k = self.at.get(state)
        if k is None:
            k = self.free.pop() if self.free else len(self.ranges)
            if k == len(self.ranges):
                self.ranges.append([])
                if k == len(self.left):
                    self.left = np.concatenate([self.left, np.zeros_like(self.left)])
            self.at[state], self.left[k] = k, state
        self.ranges[k].append((lo, hi))

    def drop(self, k: int) -> None:
        del self.at[tuple(self.left[k].tolist())]
        self.left[k] = 0
        self.free.append(k)


def plan(counts: dict[int, int], capacity: int, max_docs: int, max_cost: int, select: str = "norm", weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> tuple[list[Slots], int]:
    """Best fit in falling order of length. select="norm": the bin whose residual vector, each part over its capacity
    and times its weight, is then shortest; "dot": the bin whose residuals have the largest weighted dot product with
    the item's demands. Ties go to the smaller state. Returns the slots and the number of bins.
    """
    full = np.array([capacity, max_docs, max_cost], np.int64)
    weight = np.array(weights, float)
    bins, out, opened = _Bins(), [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        need = np.array([length, 1, length * length], np.int64)
        if (need > full).any():
            raise ValueError(f"a piece of {length} tokens fits no empty sequence")
        held = bins.left[: len(bins.ranges)]
        fits = np.flatnonzero((held >= need).all(1))
        states = held[fits]
        if select == "dot":
            score = -((states / full) @ (weight * need / full))
        else:
            score = (((states - need) / full) ** 2) @ weight
        for k in fits[np.lexsort((states[:, 2], states[:, 1], states[:, 0], score))].tolist():
            if not left:
                break
            state = bins.left[k].copy()
            per = int((state // need).min())
            ranges = bins.ranges[k]
            while left and ranges:
                lo, hi = ranges.pop()
                whole = min(hi - lo, left // per)
                for n, each in ((whole, per), (1, left - whole * per)):
                    each = min(each, per)
                    if not n or not each or lo >= hi:
                        continue
                    out.append(Slots(length, rank, n * each, lo, each, capacity - int(state[0])))
                    bins.add(tuple((state - each * need).tolist()), lo, lo + n)
                    rank, left, lo = rank + n * each, left - n * each, lo + n
                if lo < hi:
                    ranges.append((lo, hi))
            if not ranges:
                bins.drop(k)
        if left:
            per = int((full // need).min())
            for n, each in ((left // per, per), (1, left % per)):
                if n and each:
                    out.append(Slots(length, rank, n * each, opened, each, 0))
                    bins.add(tuple((full - each * need).tolist()), opened, opened + n)
                    rank, opened = rank + n * each, opened + n
    return out, opened


def tokenize_pieces(docs: DataFrame, *, tokenizer_path: str, end_id: int, capacity: int, text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit, binary).

    A document is its ids and then `end_id`; one longer than `capacity` is cut into pieces of that length, the
    last of which may be shorter. Null and empty texts are the end id alone; rows that repeat are pieces of their own.
    """

    @F.pandas_udf("array<struct<start: long, ids: binary>>")
    def cut(texts: pd.Series) -> pd.Series:
        end, size = int(end_id).to_bytes(4, "little"), 4 * capacity
        whole = [ids + end for ids in tokenizer(tokenizer_path).encode(texts.tolist())]
        return pd.Series([[{"start": k // 4, "ids": ids[k : k + size]} for k in range(0, len(ids), size)] for ids in whole], dtype=object)

    rows = docs.select("doc_id", F.posexplode(cut(F.col(text_col))).alias("piece", "p"))
    return rows.select("doc_id", "piece", F.col("p.start").alias("start"), (F.octet_length("p.ids") / 4).cast("long").alias("length"), F.col("p.ids").alias("ids"))


def pack(pieces: DataFrame, *, capacity: int, max_docs: int | None = None, max_cost: int | None = None, select: str = "norm", weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """All columns of `pieces` (one is `length`, 1 to `capacity`) with sequence_id and offset.

    `max_docs` pieces and `max_cost` of squared lengths are the further capacities of a sequence; None: those of a
    sequence of single tokens and of one piece (`capacity` and its square), which never bind but take part in the choice
    of bins. A piece longer than `capacity`, or whose squared length is over `max_cost`, fits no sequence and is an
    error. Rows of null length are left out of every sequence: both columns are null. Rows of equal length, copies
    too, take slots of their own. Columns named sequence_id or offset are replaced; an empty table gives an empty one.
    """
    max_docs, max_cost = max_docs or capacity, max_cost or capacity * capacity
    own = ("sequence_id", "offset", "_row", "_salt", "_rank")
    kept = pieces.select(*[pieces[c] for c in pieces.columns if c.lower() not in own])
    rows = materialize(kept.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["count"] for r in rows.where("length is not null").groupBy("length").count().collect()}  # at most `capacity` rows
    slots, _ = plan(histogram, capacity, max_docs, max_cost, select, weights)
    salts = max(64, math.ceil(sum(histogram.values()) / ROWS_PER_SALT))
    spark = pieces.sparkSession
    # rank within a length: rank within (length, salt), plus the rows of the salts before
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = salted.withColumn("_in", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_row")))
    ranked = ranked.join(starts, ["length", "_salt"], "left").withColumn("_rank", F.col("_before") + F.col("_in") - 1)
    frame = pd.DataFrame([(s.length, s.first, s.first + s.items, s.bin, s.per_bin, s.offset) for s in slots], columns=["_len", "_lo", "_hi", "_bin", "_per", "_off"])
    table = spark.createDataFrame(frame, "_len long, _lo long, _hi long, _bin long, _per long, _off long")
    if len(slots) <= BROADCAST_SLOTS:
        table = F.broadcast(table)
    out = ranked.join(table, (F.col("length") == F.col("_len")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")), "left")
    at = F.col("_rank") - F.col("_lo")
    out = out.select(
        *kept.columns,
        (F.col("_bin") + F.floor(at / F.col("_per"))).cast("long").alias("sequence_id"),
        (F.col("_off") + at % F.col("_per") * F.col("length")).cast("long").alias("offset"),
    )
    out = materialize(out, "packed")
    release(rows)
    return out
