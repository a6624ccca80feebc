"""Embedding near-duplicates by spherical-cap filters from structured random product codes.

A vector is, for each of several codes, rotated or permuted at random and cut into three parts; each part has 64
random code words, and a filter is one code word of each part, so 262,144 filter directions a code need 192 words.
List decoding finds all filters whose inner product with the vector reaches the cap, without visiting the others. The
cap follows from the dimension: two vectors at the threshold share a filter of one code with probability SHARE, as
measured on random pairs, and there are as many codes as make the probability of sharing none at most `miss`.

Vectors of one label that meet in a filter are compared by way of leaders, so that a group of near copies is neither
joined nor written as pairs:

1. Equal vectors are one representative with a count. A filter's smallest member is its hub; a vector that is linked
   with hubs takes the smallest of them for its leader, another one leads itself.
2. Filters, with each leader once, give pairs of leaders. A pair stays if its angle allows a link between the
   followers: the angle of the threshold, and once more that for each of the two that has followers.
3. Leaders without followers are linked as they are. Followers of two leaders, or of one, are compared in blocks, each
   pair of vectors in one place only; a block gives the number of links of each vector and the links of a spanning
   forest, so the rows that leave it are no more than its members.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_back, materialize, release
from .components import components
from .neardup import groups

PARTS, WORDS = 3, 64
SHARE, MISS = 0.25, 5e-4
PAIRS = 600  # random pairs that the cap is measured on
SKETCH_SIGMAS = 7.0
OWN_ROTATION = 128  # dimensions
CHUNK = 256
BLOCK = 140  # two of them are one comparison; a group of a thousand is dealt over dozens of tasks


class Codes:
    """The product codes for one dimension; equal in every process."""

    def __init__(self, dim: int, count: int, seed: int = 7):
        rng = np.random.default_rng([seed, dim])
        rotation = _rotation(rng, dim)
        self.planes = rng.normal(size=(dim, 64))
        # where the parts of a rotated vector differ much in length, every code needs a rotation of its own
        self.rotations = [_rotation(rng, dim) if dim <= OWN_ROTATION else rotation for _ in range(count)]
        self.codes = [self._code(np.random.default_rng([seed, dim, n]), dim) for n in range(count)]

    @staticmethod
    def _code(rng: np.random.Generator, dim: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each part its coordinates and its words."""
        cuts = [c for c in np.array_split(rng.permutation(dim), PARTS) if len(c)]
        out = []
        for c in cuts:
            w = rng.normal(size=(WORDS, len(c)))
            out.append((c, w / np.linalg.norm(w, axis=1, keepdims=True) / math.sqrt(len(cuts))))
        return out

    def sketch(self, unit: np.ndarray) -> np.ndarray:
        bits = np.packbits(unit @ self.planes > 0, axis=1, bitorder="little")
        return np.ascontiguousarray(bits).view("<i8").ravel()

    def products(self, unit: np.ndarray, code: int) -> list[np.ndarray]:
        """Inner products of the parts with their words, PARTS tables."""
        y = unit @ self.rotations[code]
        s = [y[:, c] @ w.T for c, w in self.codes[code]]
        return s + [np.zeros((len(unit), 1))] * (PARTS - len(s))

    def decode(self, unit: np.ndarray, code: int, cap: float) -> tuple[np.ndarray, np.ndarray]:
        """Row and filter of every filter of a code that a row reaches."""
        s = self.products(unit, code)
        pair = (s[0][:, :, None] + s[1][:, None, :]).reshape(len(unit), -1)
        row, ab = np.nonzero(pair >= (cap - s[2].max(1))[:, None])
        at, c = np.nonzero(s[2][row] + pair[row, ab][:, None] >= cap)
        return row[at], ((code * WORDS * WORDS + ab[at]) * WORDS + c).astype("i8")


def _rotation(rng: np.random.Generator, dim: int) -> np.ndarray:
    q, r = np.linalg.qr(rng.normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def cap_for(dim: int, threshold: float) -> float:
    """The cap that a share SHARE of random pairs at the threshold both reach in one filter of a code."""
    rng = np.random.default_rng([11, dim])
    f = Codes(dim, 30)
    u = rng.normal(size=(PAIRS, dim))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    z = rng.normal(size=(PAIRS, dim))
    z -= (z * u).sum(1, keepdims=True) * u
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    v = threshold * u + math.sqrt(1 - threshold**2) * z
    best = []
    for code, at in enumerate(np.array_split(np.arange(PAIRS), len(f.codes))):
        x, y = f.products(u[at], code), f.products(v[at], code)
        for i in range(len(at)):
            a = (x[0][i][:, None] + x[1][i]).ravel()[:, None] + x[2][i]
            b = (y[0][i][:, None] + y[1][i]).ravel()[:, None] + y[2][i]
            best.append(float(np.minimum(a, b, out=a).max()))
    return float(np.quantile(best, 1 - SHARE))


def code_count(miss: float) -> int:
    return max(1, math.ceil(math.log(miss) / math.log(1 - SHARE)))


_codes: dict[int, Codes] = {}
_caps: dict[tuple[int, float], float] = {}


def codes(dim: int, count: int) -> Codes:
    if dim not in _codes or len(_codes[dim].codes) != count:
        _codes[dim] = Codes(dim, count)
    return _codes[dim]


def sketch_bits(angle: float) -> int:
    """Differing bits of 64 that two vectors at `angle` have, and SKETCH_SIGMAS standard deviations more."""
    p = min(0.5, angle / math.pi)
    return min(64, math.ceil(64 * p + SKETCH_SIGMAS * math.sqrt(64 * p * (1 - p))))


def clean(vectors) -> list[np.ndarray | None]:
    """Vectors as doubles; None for null, empty or zero ones and for null or non-finite components."""
    out = []
    for v in vectors:
        a = None if v is None else np.array([np.nan if x is None else x for x in v], float) if getattr(v, "dtype", None) == object else np.asarray(v, float)
        out.append(a if a is not None and a.size and np.isfinite(a).all() and a.any() else None)
    return out


def vector_duplicates(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, miss: float = MISS) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of `rows`.

    Only vectors of equal, non-null label and equal dimension are compared; null, empty and zero vectors and those
    with null or non-finite components are linked with nothing. Copies are linked with each other. Rows of a null
    id take no part: no links, a null component_id, and they are kept. Rows that repeat an id count as vectors of
    their own, which share a component. Other columns are ignored, whatever their names.
    """
    spark = rows.sparkSession

    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hi, lo, raw = [], [], []
            for v in clean(b["v"]):
                if v is None:
                    hi.append(None), lo.append(None), raw.append(None)
                    continue
                v = v + 0.0  # one zero
                d = hashlib.blake2b(v.tobytes(), digest_size=16).digest()
                hi.append(int.from_bytes(d[:8], "little", signed=True))
                lo.append(int.from_bytes(d[8:], "little", signed=True))
                raw.append(v.tobytes())
            yield pd.DataFrame({"id": b["id"].astype("Int64"), "label": b["label"].astype("Int64"), "hi": pd.array(hi, "Int64"), "lo": pd.array(lo, "Int64"), "raw": raw})

    taken = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"))
    keyed = materialize(taken.mapInPandas(key, "id long, label long, hi long, lo long, raw binary"), "vectors")
    valid = keyed.where("id is not null and label is not null and hi is not null")
    reps = materialize(valid.groupBy("label", "hi", "lo").agg(F.min("id").alias("rep"), F.count("*").alias("size")), "representatives")
    # a repeated id may bring several vectors, so representatives have numbers of their own
    own = valid.select("label", "hi", "lo", "raw").dropDuplicates(["label", "hi", "lo"]).join(reps, ["label", "hi", "lo"])
    own = materialize(own.select(F.monotonically_increasing_id().alias("no"), "label", "hi", "lo", "rep", "size", "raw"), "own-vectors")

    count = code_count(miss)
    dims = [r[0] // 8 for r in own.select(F.octet_length("raw")).distinct().collect()]  # a few
    for dim in dims:
        if (dim, threshold) not in _caps:
            _caps[dim, threshold] = cap_for(dim, threshold)
    caps = {dim: _caps[dim, threshold] for dim in dims}

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for n, part in b.groupby(b["raw"].map(len)):
                dim = int(n) // 8
                f = codes(dim, count)
                for lo in range(0, len(part), CHUNK):
                    p = part.iloc[lo : lo + CHUNK]
                    x = units(p["raw"])
                    no, label, sketch = p["no"].to_numpy(), p["label"].to_numpy(), f.sketch(x)
                    for code in range(count):
                        row, name = f.decode(x, code, caps[dim])
                        yield pd.DataFrame({"no": no[row], "label": label[row], "dim": dim, "filter": name, "sketch": sketch[row]})

    spots = own.select("no", "label", "raw").mapInPandas(spread, "no long, label long, dim int, filter long, sketch long")
    spots = materialize(spots.select("no", "sketch", F.xxhash64("label", "dim", "filter").alias("cell")), "filters")
    angle = math.acos(threshold)
    apart = F.bit_count(F.col("sketch").bitwiseXOR(F.col("other_sketch")))

    # 1. leaders
    hubs = spots.groupBy("cell").agg(F.min(F.struct("no", "sketch")).alias("hub"), F.count("*").alias("n")).where("n > 1")
    star = join_back(spots, hubs.select("cell", F.col("hub.no").alias("hub"), F.col("hub.sketch").alias("other_sketch")), "cell")
    star = star.where((F.col("no") != F.col("hub")) & (apart <= sketch_bits(angle))).select("no", "hub").distinct()
    bound = F.lit(threshold)
    linked = _near(star.select(F.col("no").alias("u"), F.col("hub").alias("v")), own, bound)
    best = linked.groupBy("u").agg(F.min("v").alias("leader")).withColumnRenamed("u", "no")
    led = materialize(own.select("no", "label").join(best, "no", "left").select("no", F.coalesce("leader", "no").alias("leader")), "leaders")
    # a leader without followers has itself alone; one with followers may follow another
    sizes = led.groupBy("leader").agg(F.count("*").alias("members"), F.max((F.col("no") != F.col("leader")).cast("int")).alias("wide"))

    # 2. pairs of leaders
    sketches = spots.select(F.col("no").alias("leader"), "sketch").distinct()
    heads = materialize(sizes.join(sketches, "leader"), "heads")
    cells = spots.select("no", "cell").join(led, "no").select("cell", "leader").distinct().join(heads, "leader")
    cells = materialize(cells.select("cell", "leader", "wide", "sketch"), "cells")
    other = cells.select("cell", F.col("leader").alias("other"), F.col("wide").alias("other_wide"), F.col("sketch").alias("other_sketch"))
    reach = F.col("wide") + F.col("other_wide")
    allowed = F.when(reach == 0, sketch_bits(angle)).when(reach == 1, sketch_bits(2 * angle)).otherwise(sketch_bits(3 * angle))
    pairs = cells.join(other, "cell").where((F.col("leader") < F.col("other")) & (apart <= allowed))
    pairs = pairs.select(F.col("leader").alias("u"), F.col("other").alias("v"), reach.alias("reach")).distinct()
    slack = 1e-9
    bound = F.when(F.col("reach") == 0, threshold).when(F.col("reach") == 1, math.cos(min(math.pi, 2 * angle)) - slack).otherwise(math.cos(min(math.pi, 3 * angle)) - slack)
    pairs = materialize(_near(pairs, own, bound), "leader-pairs")

    # 3. links
    found = materialize(_between(pairs.where("reach > 0"), heads.where("wide = 1"), led, own, threshold), "block-links")
    single = pairs.where("reach = 0").select("u", "v")
    numbered = own.select("no", "size")
    ends = single.unionByName(single.select(F.col("v").alias("u"), F.col("u").alias("v")))
    degree = ends.join(numbered.withColumnRenamed("no", "v"), "v").groupBy("u").agg(F.sum("size").alias("n"))
    degree = degree.unionByName(found.where("v is null").groupBy("u").agg(F.sum("n").alias("n"))).groupBy("u").agg(F.sum("n").alias("others"))
    names = own.select("no", "rep")
    links = single.unionByName(found.where("v is not null").select("u", "v"))
    links = links.join(names.select(F.col("no").alias("u"), F.col("rep").alias("a")), "u").join(names.select(F.col("no").alias("v"), F.col("rep").alias("b")), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    # rows that repeat an id tie its vectors
    valid_ids = valid.select("id", "label", "hi", "lo").distinct().join(reps, ["label", "hi", "lo"]).select(F.col("id").alias("u"), F.col("rep").alias("v"))
    repeated = valid.select("id", "label", "hi", "lo").distinct().groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("u"))
    comps = components(links.unionByName(valid_ids.join(repeated, "u", "left_semi")))
    known = own.join(degree.withColumnRenamed("u", "no"), "no", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("label", "hi", "lo", (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("links"), F.coalesce("component", "rep").alias("class"))
    out = keyed.select("id", "label", "hi", "lo").join(known, ["label", "hi", "lo"], "left")
    takes = F.col("id").isNotNull()
    component = F.when(takes, F.coalesce("class", "id"))
    out = materialize(
        out.select(
            F.col("id").alias("vec_id"),
            F.when(takes, F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
            component.alias("component_id"),
            F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
        ),
        "vector-duplicates",
    )
    for x in (keyed, reps, own, spots, led, heads, cells, pairs, found, comps):
        release(x)
    return out


def _near(pairs: DataFrame, own: DataFrame, bound) -> DataFrame:
    """The pairs (u, v, ...) of one label and dimension whose cosine is at least `bound`, a column."""

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
        out = np.zeros(len(a), bool)
        sizes = a.map(len).to_numpy()
        for n in np.unique(sizes):
            at = np.flatnonzero((sizes == n) & (b.map(len).to_numpy() == n))
            for lo in range(0, len(at), 4096):
                p = at[lo : lo + 4096]
                x, y = (np.frombuffer(b"".join(s.iloc[p]), "f8").reshape(len(p), -1) for s in (a, b))
                out[p] = cosines(x, y) >= least.to_numpy()[p]
        return pd.Series(out)

    side = own.select("no", "label", "raw")
    a = side.select(F.col("no").alias("u"), F.col("label").alias("lu"), F.col("raw").alias("ru"))
    b = side.select(F.col("no").alias("v"), F.col("label").alias("lv"), F.col("raw").alias("rv"))
    return pairs.join(a, "u").join(b, "v").where("lu = lv").where(near("ru", "rv", bound)).select(*pairs.columns)


def _between(pairs: DataFrame, wide: DataFrame, led: DataFrame, own: DataFrame, threshold: float) -> DataFrame:
    """Links among the followers of pairs of leaders (u, v) and of each of the leaders `wide`, block against block.

    Rows (u, n, null): vector u has n more links; rows (u, 0, v): a link of the spanning forest of a block.
    """
    size = led.groupBy("leader").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    tasks = pairs.select("u", "v").unionByName(wide.select(F.col("leader").alias("u"), F.col("leader").alias("v")))
    tasks = tasks.join(size.select(F.col("leader").alias("u"), F.col("blocks").alias("bu")), "u").join(size.select(F.col("leader").alias("v"), F.col("blocks").alias("bv")), "v")
    tasks = tasks.select("u", "v", "bv", F.explode(F.sequence(F.lit(0), F.col("bu") - 1)).alias("i"))
    tasks = tasks.select("u", "v", "i", F.explode(F.sequence(F.lit(0), F.col("bv") - 1)).alias("j")).where("u <> v or i <= j")
    members = led.join(size, "leader").join(own.select("no", "size", "raw"), "no")
    members = members.select("leader", F.pmod(F.xxhash64("no"), F.col("blocks")).cast("int").alias("block"), "no", "size", "raw")
    sides = [("u", "i", 0), ("v", "j", 1)]
    sent = None
    for leader, block, s in sides:
        part = tasks.withColumns({"leader": F.col(leader), "block": F.col(block)}).join(members, ["leader", "block"])
        part = part.where("u <> v or i <> j or " + ("true" if s == 0 else "false")).select("u", "v", "i", "j", F.lit(s).alias("side"), "no", "size", "raw")
        sent = part if sent is None else sent.unionByName(part)
    sent = sent.repartition("u", "v", "i", "j").sortWithinPartitions("u", "v", "i", "j")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(batches, ["u", "v", "i", "j"]):
            same = bool(g["u"].iloc[0] == g["v"].iloc[0] and g["i"].iloc[0] == g["j"].iloc[0])
            first = g[g["side"] == 0]
            second = first if same else g[g["side"] == 1]
            yield _block(first, second, same, threshold)

    return sent.mapInPandas(compare, "u long, n long, v long")


def _block(first: pd.DataFrame, second: pd.DataFrame, same: bool, threshold: float) -> pd.DataFrame:
    a, b = (f["no"].to_numpy() for f in (first, second))
    near = np.zeros((len(a), len(b)), bool)
    if len(a) and len(b):  # of one dimension, as their leaders are
        x, y = units(first["raw"]), units(second["raw"])
        cosine = x @ y.T
        near = cosine >= threshold
        r, c = np.nonzero(np.abs(cosine - threshold) < 1e-9)  # by the same sums as pairs
        if len(r):
            rx, ry = (np.frombuffer(b"".join(f["raw"]), "f8").reshape(len(f), -1) for f in (first, second))
            near[r, c] = cosines(rx[r], ry[c]) >= threshold
        if same:
            near = near | near.T
            np.fill_diagonal(near, False)
    rows = [(int(u), int(n), None) for u, n in zip(a, near @ second["size"].to_numpy()) if n]
    if not same:
        rows += [(int(u), int(n), None) for u, n in zip(b, near.T @ first["size"].to_numpy()) if n]
    rows += [(int(p), 0, int(q)) for p, q in _forest(a, b, near, same)]
    out = pd.DataFrame(rows, columns=["u", "n", "v"])
    return out.astype({"u": "int64", "n": "int64", "v": "Int64"})


def _forest(a: np.ndarray, b: np.ndarray, near: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Links from a first vector of each component to the others."""
    left = near.any(1)
    out = []
    while left.any():
        root = int(np.argmax(left))
        rows, cols = np.zeros(len(a), bool), np.zeros(len(b), bool)
        rows[root] = True
        while True:
            more = near[rows].any(0)
            back = near[:, more].any(1) | rows | (more if same else False)
            if (back == rows).all() and (more == cols).all():
                break
            rows, cols = back, more
        out += [(a[root], q) for q in {*a[rows].tolist(), *b[cols].tolist()} - {int(a[root])}]
        left &= ~rows
    return out


def units(raws) -> np.ndarray:
    """Unit rows, scaled so that no square overflows."""
    x = np.frombuffer(b"".join(raws), "f8").reshape(len(raws), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, scaled so that no square overflows."""
    a, b = a / np.abs(a).max(1, keepdims=True), b / np.abs(b).max(1, keepdims=True)
    return (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))
