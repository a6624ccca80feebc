"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

Words are lower-cased and cut to their first seven letters, a plain stemmer that joins the forms of a word in any
language. All terms of at least two examples are indexed, whichever label they lean to; document frequencies are those
of all documents. A term's weight is its TF-IDF times how closely chi-square ties it to the label (supervised term
weighting), LEAST_TIE at least, so that every term counts. The neighbours vote with weight 1 / (1.05 - cosine); a
logistic calibration fitted on leave-one-out votes makes the vote a probability.

The index: short posting lists are added up whole. The lists of common terms, those of a fifth of the examples or
more, are cut into blocks of 16 examples, each with its maximum. A query adds up its short lists, whose k-th best sum
is a floor under the k-th best cosine, and visits of the common lists only the blocks whose maxima can lift one of
their examples to the floor. So the k best cosines are exact. Weights are kept in single precision and summed in double.
"""

from __future__ import annotations

import gc
import hashlib
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fit_logistic, give_back, materialize, only_cache, release, sigmoid

WORD = re.compile(r"\w+")
BORDERS = {i: " " for i in range(128) if not WORD.match(chr(i))}
STEM = 7
SAMPLE_PER_CLASS = 3000
MIN_DF = 2
LEAST_TIE = 0.02
NEIGHBOURS = 64
SHARPNESS = 1.05
BLOCK, COMMON = 16, 0.2
TOGETHER = 64  # texts whose common lists are added up in one product
SEEN = 5000  # texts whose verdict is kept for copies
SLACK = 1e-11  # of sums in another order
TERM_ROWS = 50_000  # rows of one batch to Spark


def words(text: str | None) -> list[str]:
    """The matches of WORD in the lower-cased text; texts in ASCII are split, which takes less time."""
    text = (text or "").lower()
    return text.translate(BORDERS).split() if text.isascii() else WORD.findall(text)


def terms(text: str | None) -> Counter:
    """Counts of the terms of a whole text."""
    return Counter([w[:STEM] for w in words(text)])


class BlockMaxIndex:
    """Postings of unit vectors by term, long lists in blocks with their maxima; `nearest` is exact top-k by cosine."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, weights: np.ndarray, ids: np.ndarray, terms: int, block: int = BLOCK, common: float = COMMON):
        """From the cells of a sparse matrix of unit vectors, one row for each of `ids`."""
        self.ids, self.block = ids, block
        df = np.bincount(cols, minlength=terms)
        self.place = np.full(terms, -1)  # of a common term: its column
        long = np.flatnonzero(df >= max(2, common * len(ids)))
        self.place[long] = np.arange(len(long))
        blocks = -(-len(ids) // block)
        dense = np.zeros((blocks * block, len(long)))
        in_long = self.place[cols] >= 0
        dense[rows[in_long], self.place[cols[in_long]]] = weights[in_long].astype("f4")
        self.dense = dense.reshape(blocks, block, len(long))
        self.maxima = self.dense.max(1)
        rows, cols, weights = rows[~in_long], cols[~in_long], weights[~in_long]
        by = np.lexsort((rows, cols))
        self.examples, self.parts = rows[by].astype("i4"), weights[by].astype("f4")
        self.sizes = np.bincount(cols, minlength=terms)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines (over 0) of the k nearest; ties to the smaller example id. `without`: a position left out."""
        return self.nearest_many([(at, w)], k, without)[0]

    def nearest_many(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: int = -1) -> list[tuple[np.ndarray, np.ndarray]]:
        """`nearest` of each query. Those that can leave out hardly any block share one product with the common lists."""
        n, out, whole = len(self.ids), [], []
        for at, w in queries:
            place = self.place[at]
            short = place < 0
            acc = self._short_sums(at[short], w[short])
            acc[n:] = -np.inf
            if without >= 0:
                acc[without] = -np.inf
            if not short.all():
                rest = np.zeros(self.dense.shape[2])
                rest[place[~short]] = w[~short]
                # weights are positive, so the k-th best sum so far is under the k-th best cosine
                floor = float(np.partition(acc, len(acc) - k)[len(acc) - k]) - SLACK if n > k else 0.0
                by_block = acc.reshape(-1, self.block)
                live = by_block.max(1) + self.maxima @ rest >= floor
                if 2 * live.sum() > len(live):  # hardly any block can be left out: without a copy of the others
                    whole.append((acc, rest))
                else:
                    full = np.full(by_block.shape, -np.inf)
                    full[live] = by_block[live] + self.dense[live] @ rest
                    acc = full.ravel()
            out.append(acc)
        if whole:
            sums = np.stack([rest for _, rest in whole]) @ self.dense.reshape(-1, self.dense.shape[2]).T
            for (acc, _), more in zip(whole, sums):
                acc += more
        return [self._best(acc, k) for acc in out]

    def _short_sums(self, few: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Sums over the short lists, by example."""
        room, sizes = self.dense.shape[0] * self.block, self.sizes[few]
        ends = np.cumsum(sizes)
        if not len(ends) or not ends[-1]:
            return np.zeros(room)
        at = np.repeat(self.starts[few] - (ends - sizes), sizes)  # places of all postings, list after list
        at += np.arange(ends[-1])
        return np.bincount(self.examples[at], self.parts[at] * np.repeat(w, sizes), minlength=room)

    def _best(self, acc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        least = float(np.partition(acc, len(acc) - k)[len(acc) - k]) - SLACK if len(self.ids) > k else 0.0
        found = np.flatnonzero(acc >= least) if least > 0 else np.flatnonzero(acc > 0)
        cos = np.round(acc[found], 12)  # the same whatever queries share a product
        by = np.lexsort((self.ids[found], -cos))[:k]
        return found[by], cos[by]


@dataclass
class ToxicityModel:
    vocabulary: list[str]
    idf: np.ndarray  # times the tie to the label
    cells: tuple[np.ndarray, np.ndarray, np.ndarray]  # example, term and weight
    ids: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    beta: list[float]
    silent: float  # score of a text without a term of the vocabulary
    fitted: bool = False  # were there labelled texts of both classes?
    neighbours: int = NEIGHBOURS
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


class _Lookup:
    """Vocabulary positions of the terms of a text."""

    def __init__(self, vocabulary: list[str]):
        self.at = {t: i for i, t in enumerate(vocabulary)}

    def positions(self, text: str | None) -> list[int]:
        """Of each term of a text once."""
        return [self.at[t] for t in {w[:STEM] for w in words(text)} & self.at.keys()]

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Rising positions of the terms of a text, and how often it has them."""
        found = terms(text)
        pos = np.fromiter(map(self.at.get, found, repeat(-1)), int, len(found))
        n = np.fromiter(found.values(), int, len(found))
        order = np.argsort(pos)
        order = order[np.searchsorted(pos[order], 0) :]
        return pos[order], n[order]


class _Voter:
    def __init__(self, m: ToxicityModel):
        self.idf, self.neighbours, self.beta, self.silent = m.idf, m.neighbours, m.beta, m.silent  # the cells live on in the index only
        self.lookup = _Lookup(m.vocabulary)
        self.index = BlockMaxIndex(*m.cells, m.ids, len(m.vocabulary))
        self.y, self.w = m.labels, m.weights
        self.prior = float((m.weights * m.labels).sum() / max(1e-9, m.weights.sum())) if len(m.labels) else 0.0
        self.seen: dict[bytes, tuple] = {}

    def query(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Vocabulary positions and unit TF-IDF weights of a whole text."""
        pos, counts = self.lookup.counts(text)
        return pos, unit(pos, counts, self.idf)

    def vote(self, pos: np.ndarray, w: np.ndarray, without: int = -1) -> tuple[float, list, list]:
        return self._weigh(*self.index.nearest(pos, w, self.neighbours, without))

    def _weigh(self, found: np.ndarray, cos: np.ndarray) -> tuple[float, list, list]:
        pull = self.w[found] / (SHARPNESS - np.minimum(cos, 1.0))
        raw = (float((pull * self.y[found]).sum()) + self.prior) / (float(pull.sum()) + 1.0)
        return raw, self.index.ids[found[:5]].tolist(), [round(float(c), 6) for c in cos[:5]]

    def judge(self, text: str | None) -> tuple[float, list, list]:
        return self.judge_many([text])[0]

    def judge_many(self, texts) -> list[tuple[float, list, list]]:
        """The verdict of each text; copies are judged once."""
        keys = [hashlib.blake2b((t or "").encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
        out: list = [None] * len(keys)
        for lo in range(0, len(keys), TOGETHER):
            if len(self.seen) > SEEN:
                self.seen.clear()
            new = {k: t for k, t in zip(keys[lo : lo + TOGETHER], texts[lo : lo + TOGETHER]) if k not in self.seen}
            queries = {k: self.query(t) for k, t in new.items()}
            self.seen |= {k: (self.silent, [], []) for k, (pos, _) in queries.items() if not len(pos)}
            asked = {k: q for k, q in queries.items() if len(q[0])}
            for k, near in zip(asked, self.index.nearest_many(list(asked.values()), self.neighbours)):
                raw, ids, cos = self._weigh(*near)
                self.seen[k] = float(calibrate(np.array([raw]), self.beta)[0]), ids, cos
            for i, k in enumerate(keys[lo : lo + TOGETHER], lo):
                out[i] = self.seen[k]
        return out


def unit(pos: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = (1 + np.log(counts)) * idf[pos] if len(pos) else np.zeros(0)
    return w / max(1e-12, float(np.sqrt((w * w).sum())))


def calibrate(raw: np.ndarray, beta: list[float]) -> np.ndarray:
    raw = np.clip(raw, 1e-4, 1 - 1e-4)
    return sigmoid(beta[0] + beta[1] * np.log(raw / (1 - raw)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", label_col: str = "toxic", sample_per_class: int = SAMPLE_PER_CLASS, neighbours: int = NEIGHBOURS) -> ToxicityModel:
    """Index at most `sample_per_class` labelled documents of each class, chosen by hash, whole texts.

    Null ids and labels other than 0 and 1 are left out; of rows that repeat an id the smallest text and label
    count. Example weights undo the unequal sampling of the classes. With a class missing, the model is not `fitted`
    and every text gets the share of label 1, smoothed so that it is 1/3 without any label.
    """
    known = labels.select("doc_id", F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.min("y").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    base = (n1 + 1) / (n0 + n1 + 3)
    empty = ToxicityModel([], np.zeros(0), (np.zeros(0, int), np.zeros(0, int), np.zeros(0)), np.zeros(0, "int64"), np.zeros(0), np.zeros(0), [0.0, 1.0], base, False, neighbours)
    if not n0 or not n1:
        return empty
    picked = bounded_sample(known.where("y = 0"), "doc_id", sample_per_class, n0).unionByName(bounded_sample(known.where("y = 1"), "doc_id", sample_per_class, n1))

    def termed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, ys, words, counts = [], [], [], []

        def table() -> pd.DataFrame:
            out = pd.DataFrame({"doc_id": ids, "y": ys, "term": words, "n": counts})
            for column in (ids, ys, words, counts):
                column.clear()
            return out

        for batch in batches:
            for d, y, t in zip(batch["doc_id"].tolist(), batch["y"].tolist(), batch["t"]):
                found = terms(t)
                ids.extend([d] * len(found))
                ys.extend([y] * len(found))
                words.extend(found)
                counts.extend(found.values())
                if len(ids) > TERM_ROWS:
                    yield table()
        if ids:
            yield table()

    sample = (
        docs.select("doc_id", F.coalesce(F.col(text_col), F.lit("")).alias("t"))
        .join(F.broadcast(picked), "doc_id")  # at most 2 x sample_per_class rows of two numbers
        .groupBy("doc_id", "y")
        .agg(F.min("t").alias("t"))
        .mapInPandas(termed, "doc_id long, y int, term string, n int")
    )
    sample = materialize(sample, "toxic-terms")
    per = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.countDistinct("doc_id").alias("n")).collect()}
    p, q = per.get(1, 0), per.get(0, 0)
    if not p or not q:
        release(sample)
        return empty
    found = sample.groupBy("term").agg(F.sum("y").alias("a"), F.count("*").alias("df")).where(F.col("df") >= MIN_DF).orderBy("term").toArrow()
    vocab = found["term"].to_pylist()  # no more than the sampled texts hold
    if not vocab:
        release(sample)
        return empty
    a, df = found["a"].to_numpy().astype(float), found["df"].to_numpy().astype(float)
    n = float(p + q)
    cross = a * (q - (df - a)) - (df - a) * (p - a)
    tie = np.abs(cross) / np.sqrt(np.maximum(df * p * q * (n - df), 1e-9))  # root of chi-square / n
    r1, r0 = n1 / p, n0 / q
    idf = _idf(docs, text_col, vocab) * (LEAST_TIE + tie)
    box = docs.sparkSession.sparkContext.broadcast(vocab)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = {t: i for i, t in enumerate(box.value)}
        for batch in batches:
            t = batch["term"].map(at)
            known = t.notna()
            yield pd.DataFrame({"doc_id": batch["doc_id"][known], "y": batch["y"][known], "t": t[known].astype("int32"), "n": batch["n"][known]})

    hits = sample.mapInPandas(placed, "doc_id long, y int, t int, n int").toArrow()  # a cell for each term of a sampled text
    release(sample)
    box.destroy()
    by_cell = np.lexsort((hits["t"].to_numpy(), hits["doc_id"].to_numpy()))
    doc, cell_y, cols, times = (hits[c].to_numpy()[by_cell] for c in ("doc_id", "y", "t", "n"))
    del hits, by_cell
    ids, first, rows = np.unique(doc, return_index=True, return_inverse=True)
    w = (1 + np.log(times)) * idf[cols]
    w = w / np.sqrt(np.bincount(rows, w * w))[rows]
    y = cell_y[first].astype(float)
    mean = (n0 + n1) / (p + q)
    weights = np.where(y == 1, r1, r0) / mean
    quiet1, quiet0 = (p - y.sum()) * r1, (q - (len(y) - y.sum())) * r0
    silent = float((quiet1 + base) / (quiet1 + quiet0 + 1))
    model = ToxicityModel(vocab, idf, (rows.astype("i4"), cols.astype("i4"), w.astype("f4")), ids, y, weights, [0.0, 1.0], silent, True, neighbours)
    voter = _Voter(model)
    ends = [*first.tolist(), len(doc)]
    raw = np.array([voter.vote(cols[lo:hi], w[lo:hi], i)[0] for i, (lo, hi) in enumerate(zip(ends, ends[1:]))])
    x = np.log(np.clip(raw, 1e-4, 1 - 1e-4) / np.clip(1 - raw, 1e-4, 1))[:, None]
    model.beta = fit_logistic(x, voter.y, voter.w).tolist()
    del voter, doc, cell_y, cols, times, rows, w  # the driver keeps the model only
    gc.collect()
    give_back()
    return model


def _idf(docs: DataFrame, text_col: str, vocab: list[str]) -> np.ndarray:
    """Inverse document frequencies of the terms over all documents."""
    box = docs.sparkSession.sparkContext.broadcast(vocab)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lookup = _Lookup(box.value)
        df = np.zeros(len(box.value) + 1, "int64")  # the last: documents
        for batch in batches:
            for t in batch["t"]:
                df[lookup.positions(t)] += 1
            df[-1] += len(batch)
        t = np.flatnonzero(df)
        for lo in range(0, len(t), TERM_ROWS):
            yield pd.DataFrame({"t": t[lo : lo + TERM_ROWS], "n": df[t[lo : lo + TERM_ROWS]]})

    sums = docs.select(F.col(text_col).alias("t")).mapInPandas(count, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    box.destroy()
    df = np.zeros(len(vocab) + 1)
    df[sums["t"].to_numpy()] = sums["n"].to_numpy()
    return np.log((df[-1] + 1) / (df[:-1] + 1)) + 1


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text") -> DataFrame:
    """All columns of `docs` and toxicity_score (0 to 1), toxicity_label (1 if score >= 0.5), toxicity_evidence.

    toxicity_evidence: ids and cosines of the five nearest labelled examples. A text without a term of the
    vocabulary, an empty or null one too, has no neighbours and gets the share of label 1 among such examples.
    Columns of these names in the input are replaced.
    """

    box, key = docs.sparkSession.sparkContext.broadcast(model), model.key

    @F.pandas_udf("score double, ids array<long>, cosines array<double>")
    def judge(texts: pd.Series) -> pd.DataFrame:
        give_back()  # what the batch before has left
        voter = _cached(key, box)
        rows = voter.judge_many(texts.tolist())
        return pd.DataFrame({"score": [r[0] for r in rows], "ids": [r[1] for r in rows], "cosines": [r[2] for r in rows]})

    own = ("toxicity_score", "toxicity_label", "toxicity_evidence", "_judged")
    kept = docs.select(*[docs[c] for c in docs.columns if c.lower() not in own])
    out = kept.withColumn("_judged", judge(F.col(text_col)))
    return out.select(
        *kept.columns,
        F.col("_judged.score").alias("toxicity_score"),
        (F.col("_judged.score") >= 0.5).cast("int").alias("toxicity_label"),
        F.arrays_zip(F.col("_judged.ids").alias("doc_id"), F.col("_judged.cosines").alias("cosine")).alias("toxicity_evidence"),
    )


_voters: dict[str, _Voter] = {}


def _cached(key: str, box) -> _Voter:
    only_cache("toxicity", _voters.clear)
    if key not in _voters:
        _voters.clear()
        _voters[key] = _Voter(box.value)
    return _voters[key]
