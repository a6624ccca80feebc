"""MinHash near-duplicates with sequential Bayesian verification.

1. Each text becomes its set of word shingles (64-bit hashes), a signature of 128 minima and a 128-bit key of the
   whole set. Texts with equal sets are one representative, the smallest doc_id.
2. Bands of minima (`banding`: five a band at 0.85, four at 0.8) put representatives into buckets. A bucket is first compared with its smallest member
   only: a star, not all pairs.
3. A pair is compared 32 minima at a time and dropped as soon as the posterior probability (uniform prior) that
   its similarity reaches the threshold is under `miss`. Survivors are verified on their full shingle sets.
4. The verified links give components. Buckets whose members are still in several components are then compared
   in full, block by block, but only between components: first by set sizes, then by the same sequential test,
   which goes on through batches of one-bit minima (4,096 more hashes) that only these documents get. Survivors
   are verified the same way. No link that the bands can see is lost, and a bucket of copies costs as many pairs
   as it has members.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binomial_tail, give_back, join_back, materialize, only_cache, release
from .components import components

HASHES = 128
BATCH = 32
MISS = 1e-7
BAND_MISS = 1e-6
BLOCK = 512
BITS, BIT_BATCH = 4096, 1024
BROADCAST_IDS = 2_000_000
_rng = np.random.default_rng(20240607)
_MUL = _rng.integers(0, 1 << 31, HASHES + BITS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, HASHES + BITS, dtype=np.uint32)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a whole text; all its words as one if fewer; none without words.

    Bytes are lower-cased and split at white space in the ASCII range only, which is what the contract asks for.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(width, len(h))
    acc = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        acc = acc * _STEP + h[i : len(h) - n + 1 + i]
        acc ^= acc >> np.uint64(29)
    return np.unique(_mix(acc + np.uint64(n)))


def _minima(sets: np.ndarray, which: slice) -> np.ndarray:
    """32-bit minima of a non-empty set under the hash functions `which`."""
    mul, add = _MUL[which], _ADD[which]
    out = np.full(len(mul), np.uint32(2**32 - 1))
    x = (sets >> np.uint64(32)).astype(np.uint32)
    step = max(1, (1 << 17) // len(mul))
    for lo in range(0, len(x), step):
        h = x[lo : lo + step, None] * mul
        h += add
        np.minimum(out, h.min(0), out=out)
    return out


def signature(sets: np.ndarray) -> np.ndarray:
    """HASHES 32-bit minima of a non-empty set."""
    return _minima(sets, slice(0, HASHES))


def bit_sketch(sets: np.ndarray) -> bytes:
    """One bit of each of BITS further minima, packed; equal with probability (1 + similarity) / 2."""
    m = _minima(sets, slice(HASHES, HASHES + BITS))
    m = (m * np.uint32(0x9E3779B1)) >> np.uint32(31)
    return np.packbits(m.astype(np.uint8)).tobytes()


def banding(threshold: float, miss: float = BAND_MISS) -> tuple[int, int]:
    """Bands and minima a band: the longest bands of HASHES minima that lose a pair at the threshold with probability `miss` at most."""
    rows = next((r for r in range(HASHES, 1, -1) if (1 - threshold**r) ** (HASHES // r) <= miss), 1)
    return HASHES // rows, rows


def set_key(sets: np.ndarray) -> tuple[int, int]:
    """128-bit key of a whole set, as two longs."""
    key = hashlib.blake2b(sets.tobytes(), digest_size=16).digest()
    return int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True)


def with_set_key(docs: DataFrame, *, text_col: str = "text", width: int = 5) -> DataFrame:
    """All columns of `docs` and set_key (hi, lo), the key of the shingle set of a text."""

    @F.pandas_udf("hi long, lo long")
    def keys(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([set_key(shingles(t, width)) for t in texts], columns=["hi", "lo"], dtype="int64")

    return docs.withColumn("set_key", keys(F.col(text_col)))


def least_matches(threshold: float, miss: float = MISS) -> list[int]:
    """By batches compared: the fewest matching minima with which a pair stays, P(similarity >= threshold | matches) >= miss."""
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        m = next(m for m in range(n + 1) if m == n or binomial_tail(n + 1, threshold, m + 1) >= miss)
        out.append(m)
    return out


def least_bits(threshold: float, miss: float = MISS) -> list[int]:
    """By batches of one-bit minima: the fewest equal bits with which P(similarity >= threshold | bits) >= miss.

    The posterior of the share of equal bits is taken as normal, which it is closely at a thousand bits and more.
    """
    out = []
    for n in range(BIT_BATCH, BITS + 1, BIT_BATCH):

        def stays(h: int, n: int = n) -> bool:
            mean = (h + 1) / (n + 2)
            sd = math.sqrt(mean * (1 - mean) / (n + 3))
            return 0.5 * math.erfc(((1 + threshold) / 2 - mean) / (sd * math.sqrt(2))) >= miss

        out.append(next(h for h in range(n // 2, n + 1) if h == n or stays(h)))
    return out


def surviving(a: np.ndarray, b: np.ndarray, floor: list[int]) -> np.ndarray:
    """Sequential test of rows a[i] against b[i]: positions of the pairs that no batch drops."""
    at, hits = np.arange(len(a)), np.zeros(len(a), int)
    for k, least in enumerate(floor):
        cut = slice(k * BATCH, (k + 1) * BATCH)
        hits = hits + (a[at, cut] == b[at, cut]).sum(1)
        keep = hits >= least
        at, hits = at[keep], hits[keep]
    return at


def near_duplicates(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", numerator: int = 4, denominator: int = 5, width: int = 5, with_key: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of `docs`; on demand set_key, the key of its shingle set.

    Texts are linked where denominator * |intersection| >= numerator * |union| of their shingle sets. Texts without
    words, null ones too, have empty sets and are linked with nothing. Rows with a null id belong to the component
    of their copies, or have a null component_id and are kept. Rows that repeat an id and text repeat in the
    result; one id with several texts is linked where any of them is. The id column is cast to long; other columns
    are ignored.
    """
    threshold = numerator / denominator
    floor = least_matches(threshold)
    n_bands, n_rows = banding(threshold)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        only_cache("near-duplicates")
        for batch in batches:
            give_back()  # what the batch before has left
            n, hi, lo, sigs = [], [], [], []
            for t in batch["t"]:
                s = shingles(t, width)
                key = set_key(s)
                n.append(len(s))
                hi.append(key[0])
                lo.append(key[1])
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pd.DataFrame({"id": batch["id"].astype("Int64"), "n": n, "hi": hi, "lo": lo, "sig": sigs})

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    signed = materialize(texts.mapInPandas(sign, "id long, n long, hi long, lo long, sig binary"), "signatures")
    reps = materialize(signed.where("n > 0 and id is not null").groupBy("hi", "lo").agg(F.min("id").alias("rep")), "representatives")
    # a representative's signature and set; a repeated id may bring several texts, each under its own key
    own = signed.where("n > 0").join(reps.select(F.col("rep").alias("id"), "hi", "lo"), ["id", "hi", "lo"], "left_semi").dropDuplicates(["id", "hi", "lo"])
    own = materialize(own.select("id", "hi", "lo", "n", "sig"), "own-signatures")

    @F.pandas_udf("array<long>")
    def banded(sigs: pd.Series) -> pd.Series:
        if not len(sigs):
            return pd.Series([], dtype=object)
        a = np.frombuffer(b"".join(sigs), "<u4").reshape(-1, HASHES).astype(np.uint64)
        acc = np.zeros((len(a), n_bands), np.uint64) + np.arange(n_bands, dtype=np.uint64)
        for r in range(n_rows):
            acc = _mix(acc * _STEP + a[:, r : n_bands * n_rows : n_rows])
        return pd.Series(list(acc.view(np.int64)))

    buckets = own.select("id", F.posexplode(banded("sig")).alias("band", "bucket"))
    least = buckets.groupBy("bucket").agg(F.min("id").alias("hub"), F.count("*").alias("size")).where("size > 1")
    buckets = materialize(join_back(buckets, least.select("bucket", "hub"), "bucket"), "buckets")
    star = buckets.where("id <> hub").select(F.col("hub").alias("u"), F.col("id").alias("v")).distinct()
    texts = _wanted(texts.where("id is not null"), buckets.select("id").distinct())
    links = _verified(star, own, texts, floor, numerator, denominator, width, screened=False)
    comps = components(links)
    # buckets with several components left: full comparison between components, in blocks
    named = buckets.select("bucket", "band", "id").join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id"))
    named = materialize(named.select("bucket", "band", "id", "c"), "members")
    split = named.groupBy("bucket").agg(F.min("c").alias("lo_c"), F.max("c").alias("hi_c"), F.count("*").alias("size")).where("lo_c < hi_c and size > 2")
    left = materialize(join_back(named, split.select("bucket", "size"), "bucket").select("bucket", "band", "size", "id", "c"), "unsettled")
    release(named)
    pairs = _between(left, own, texts, floor, least_bits(threshold), threshold, width)
    more = _verified(pairs, own, texts, floor, numerator, denominator, width, screened=True)
    release(left)
    comps = materialize(components(links.unionByName(more)), "components")
    for x in (links, more, buckets, texts, own):
        release(x)
    classes = reps.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("hi", "lo", F.coalesce("component", "rep").alias("class"))
    out = signed.select("id", "n", "hi", "lo").join(classes, ["hi", "lo"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("class", "id")).otherwise(F.col("id"))
    key = [F.struct("hi", "lo").alias("set_key")] if with_key else []
    out = out.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.col("id").isNull() & F.col("class").isNull()).alias("kept"),
        *key,
    )
    out = materialize(out, "near-duplicates")
    for x in (signed, reps, comps):
        release(x)
    return out


def _wanted(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts of the documents that share a bucket; up to BROADCAST_IDS ids go to the texts, more meet them by a shuffle."""
    ids = materialize(ids, "bucket-ids")
    few = ids.count() <= BROADCAST_IDS
    out = materialize(texts.join(F.broadcast(ids) if few else ids, "id", "left_semi"), "bucket-texts")
    release(ids)
    return out


def _between(left: DataFrame, own: DataFrame, texts: DataFrame, floor: list[int], bit_floor: list[int], threshold: float, width: int) -> DataFrame:
    """Pairs of different components within a bucket that pass the sequential test, block against block."""
    n_bands, n_rows = banding(threshold)

    @F.pandas_udf("binary")
    def bits(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: bit_sketch(shingles(t, width)))

    ids = left.select("id").distinct()
    sketched = own.join(ids, "id", "left_semi").join(texts.join(ids, "id", "left_semi"), "id").select("id", "n", "sig", bits("t").alias("bits"))
    sketched = materialize(sketched, "sketches")
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    rows = left.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("mine", mine)
    # block i meets block j >= i once: send a member of block i to (i, j) and (j, i)
    meet = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("bucket", "band", "id", "c", "mine", meet).select("bucket", "band", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "id", "c")
    rows = rows.join(sketched, "id").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(batches, ["bucket", "i", "j"]):
            sig = np.frombuffer(b"".join(g["sig"]), "<u4").reshape(-1, HASHES)
            more = np.frombuffer(b"".join(g["bits"]), "u1").reshape(len(sig), -1)
            ids, c, n, mine = (g[k].to_numpy() for k in ("id", "c", "n", "mine"))
            i, j, band = int(g["i"].iloc[0]), int(g["j"].iloc[0]), int(g["band"].iloc[0])
            first, second = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
            for x in first:
                y = second[(c[second] != c[x]) & ((ids[second] > ids[x]) if i == j else True)]
                y = y[np.minimum(n[y], n[x]) >= threshold * np.maximum(n[y], n[x]) - 1e-9]
                y = y[surviving(np.broadcast_to(sig[x], (len(y), HASHES)), sig[y], floor)]
                unequal = np.zeros(len(y), int)
                for k, least in enumerate(bit_floor):
                    cut = slice(k * BIT_BATCH // 8, (k + 1) * BIT_BATCH // 8)
                    unequal = unequal + np.bitwise_count(more[x, cut] ^ more[y, cut]).sum(1, dtype=int)
                    keep = (k + 1) * BIT_BATCH - unequal >= least
                    y, unequal = y[keep], unequal[keep]
                if len(y):  # of the bands in which the two meet, the first reports them
                    meets = (sig[x, : n_bands * n_rows] == sig[y, : n_bands * n_rows]).reshape(-1, n_bands, n_rows).all(2)
                    z = y[meets.argmax(1) == band]
                    yield pd.DataFrame({"u": np.minimum(ids[x], ids[z]), "v": np.maximum(ids[x], ids[z])})

    pairs = materialize(rows.mapInPandas(compare, "u long, v long").where("u <> v").distinct(), "pairs")
    release(sketched)
    return pairs


def groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of equal keys in sorted batches."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        k = batch[keys].to_numpy()
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
        parts = np.split(np.arange(len(batch)), cuts)
        for n, part in enumerate(parts):
            piece = batch.iloc[part]
            if held and (n > 0 or (held[-1][keys].iloc[-1].to_numpy() != k[0]).any()):
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(piece)
    if held:
        yield pd.concat(held, ignore_index=True)


def _verified(pairs: DataFrame, own: DataFrame, texts: DataFrame, floor: list[int], numerator: int, denominator: int, width: int, screened: bool) -> DataFrame:
    """The pairs (u, v) whose full shingle sets meet the threshold, written; first the sequential test, unless it is done and `pairs` written."""
    if not screened:

        @F.pandas_udf("boolean")
        def stays(a: pd.Series, b: pd.Series) -> pd.Series:
            if not len(a):
                return pd.Series([], dtype=bool)
            x, y = (np.frombuffer(b"".join(s), "<u4").reshape(-1, HASHES) for s in (a, b))
            keep = np.zeros(len(x), bool)
            keep[surviving(x, y, floor)] = True
            return pd.Series(keep)

        sig = own.select("id", "sig")
        pairs = pairs.join(sig.select(F.col("id").alias("u"), F.col("sig").alias("su")), "u").join(sig.select(F.col("id").alias("v"), F.col("sig").alias("sv")), "v")
        pairs = pairs.where(stays("su", "sv")).select("u", "v").distinct()
        pairs = materialize(pairs, "pairs")
    ends = pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).distinct()
    full = texts.join(ends, "id", "left_semi").select("id", "t")

    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        memo: dict[str, np.ndarray] = {}

        def of(t: str) -> np.ndarray:
            if t not in memo:
                if len(memo) > 200:
                    memo.clear()
                memo[t] = shingles(t, width)
            return memo[t]

        out = []
        for x, y in zip(a, b):
            p, q = of(x), of(y)
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(both > 0 and denominator * both >= numerator * (len(p) + len(q) - both))
        memo.clear()
        give_back()
        return pd.Series(out, dtype=bool)

    a = full.select(F.col("id").alias("u"), F.col("t").alias("tu"))
    b = full.select(F.col("id").alias("v"), F.col("t").alias("tv"))
    links = materialize(pairs.join(a, "u").join(b, "v").where(linked("tu", "tv")).select("u", "v").distinct(), "links")
    release(pairs)
    return links
