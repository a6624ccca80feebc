"""Secret scans with DataFrame functions only: fixed patterns, and character Markov models.

Base kinds (leftmost, not overlapping within a kind): assign, access, hex. The method adds kind "markov": tokens
of 16 and more characters that a first-order character model of random strings explains better than one of
ordinary identifiers, by a log-likelihood ratio over the log odds of `prior`, where no base span lies.

Training samples are (token, label): label 1 for tokens found by a base pattern and for strings made from hashes,
label 0 for tokens of letters, underscores and hyphens with at most four digits at the end. Counts are sums over
all distinct tokens of the corpus; the table of transitions has the size of the alphabet squared.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns and the order of kinds.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
HEX_LONG = r"[0-9a-f]{24,}"  # a run of 24 is a whole run of HEX, which is greedy
ACCESS_LONG = r"AKIA[A-Z0-9]{16,}"  # likewise: later starts in one run are shorter still
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
STATES = len(ALPHABET) + 1  # 0: start
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
LEARN = r"[A-Za-z0-9+/_=-]{12,}"
ORDINARY = r"^[A-Za-z]+([_-][A-Za-z]+)*[0-9]{0,4}$"
MADE = 1024
PRIOR = 1e-4
SMOOTH = 0.5
BACKOFF = 8.0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)


def located(text: Column, pattern: str, kind: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """Array of (start, rank, end, kind) of the matches of `pattern`, in code points.

    Starts are prefix sums of the lengths of what lies between the matches and of the matches; they are summed
    in blocks as many as a block has matches, so a text costs its matches to the power of 1.5 and not their square.
    """
    rank = KINDS.index(kind)
    span = "array<struct<start:int,rank:int,end:int,kind:string>>"

    def place(s: Column) -> Column:
        m, gaps, steps, block = s["m"], s["gaps"], s["steps"], s["block"]
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / block).cast("int")), lambda b: total(F.slice(steps, b * block + 1, block)))

        def one(blocks: Column) -> Column:
            def at(x: Column, i: Column) -> Column:
                b = F.floor(i / block).cast("int")
                start = total(F.slice(blocks, F.lit(1), b)) + total(F.slice(steps, b * block + 1, i - b * block)) + F.length(F.get(gaps, i))
                return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(x)).alias("end"), F.lit(kind).alias("kind"))

            return F.transform(m, at)

        spans = let(sums, one)
        return F.filter(spans, lambda s, i: keep(F.get(m, i))) if keep else spans

    def from_matches(m: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        parts = let(gaps, lambda g: F.struct(m.alias("m"), g.alias("gaps"), F.zip_with(F.slice(g, F.lit(1), F.size(m)), m, lambda a, b: F.length(a) + F.length(b)).alias("steps"), F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(m)))).cast("int").alias("block")))
        return F.when(F.size(m) > 0, let(parts, place)).otherwise(F.array().cast(span)).cast(span)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), from_matches)


def base_spans(text: Column) -> Column:
    """All base spans, by start and then kind."""
    assign = located(text, ASSIGN, "assign", lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6)
    found = F.concat(assign, located(text, ACCESS_LONG, "access"), located(text, HEX_LONG, "hex"))
    return F.array_sort(found)


class MarkovModel:
    """Log-likelihood ratios of transitions, [from * STATES + to], and the decision threshold."""

    def __init__(self, ratios: list[float], threshold: float):
        self.ratios, self.threshold = ratios, threshold

    def score(self, token: Column) -> Column:
        """Log-likelihood ratio, random against ordinary, of a token over ALPHABET."""
        table = F.split(F.lit(",".join(f"{r:.9g}" for r in self.ratios)), ",").cast("array<double>")  # folded to one constant
        codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
        start = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("sum"))
        return F.aggregate(codes, start, lambda a, c: F.struct(c.alias("at"), (a["sum"] + F.get(table, a["at"] * STATES + c)).alias("sum")), lambda a: a["sum"])


def fit_markov(docs: DataFrame, *, text_col: str = "text", made: int = MADE, prior: float = PRIOR) -> MarkovModel:
    """Count transitions over the distinct labelled tokens of all texts, and over 3 x `made` hash-made strings."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    tokens = docs.select(F.explode(F.regexp_extract_all(text, F.lit(LEARN), F.lit(0))).alias("token")).distinct()
    random = F.col("token").rlike(f"^({HEX_LONG}|{ACCESS_LONG})$")
    tokens = tokens.select("token", F.when(random, 1).when(F.col("token").rlike(ORDINARY), 0).alias("label")).where("label is not null")
    digest = F.sha2(F.col("id").cast("string").cast("binary"), 256)
    strings = F.array(F.substring(digest, 1, 40), F.base64(F.unhex(F.substring(digest, 1, 48))), F.regexp_replace(F.base64(F.unhex(digest)), "[+/=]", ""))
    tokens = tokens.unionByName(spark.range(made).select(F.explode(strings).alias("token"), F.lit(1).alias("label")))
    codes = F.concat(F.array(F.lit(0)), F.transform(F.split("token", ""), lambda c: F.instr(F.lit(ALPHABET), c)))
    steps = tokens.select("label", codes.alias("c")).select("label", F.explode(F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.get("c", i - 1) * STATES + F.get("c", i))).alias("step"))
    counts = np.zeros((2, STATES, STATES))
    for r in steps.groupBy("label", "step").count().collect():  # at most 2 x STATES x STATES rows
        counts[r["label"], r["step"] // STATES, r["step"] % STATES] += r["count"]
    # a transition that a state has not shown falls back on how common its target is in the class
    overall = counts.sum(1, keepdims=True) + SMOOTH
    overall[:, :, 0] = 1e-9
    overall /= overall.sum(2, keepdims=True)
    logs = np.log((counts + BACKOFF * overall) / (counts.sum(2, keepdims=True) + BACKOFF))
    ratios = logs[1] - logs[0]
    ratios[:, 0] = 0.0
    return MarkovModel(ratios.ravel().tolist(), math.log((1 - prior) / prior))


def find_secrets(docs: DataFrame, model: MarkovModel, *, text_col: str = "text") -> DataFrame:
    """All columns of `docs` and secret_spans, an array of (start, rank, end, kind) by start and kind.

    Positions are code points, ends exclusive; a null text is an empty one. Tokens of digits only are not scored.
    A column named secret_spans is replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = docs.select(*[docs[c] for c in docs.columns if c.lower() != "secret_spans"])
    scored = located(text, TOKEN, "markov", lambda m: m.rlike("[A-Za-z]") & (model.score(m) > model.threshold))

    def both(base: Column) -> Column:
        free = F.filter(scored, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
        return F.array_sort(F.concat(base, free))

    return kept.withColumn("secret_spans", let(base_spans(text), both))


def span_text(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def redact(docs: DataFrame, *, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replace what secret_spans covers by `mark` (overlapping spans by one), and drop secret_spans; null texts stay null."""
    text = F.col(text_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        piece = F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], piece).otherwise(a["out"]).alias("out"))

    clean = F.aggregate(F.col("secret_spans"), start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    hit = F.size("secret_spans") > 0
    return docs.withColumn(text_col, F.when(hit, clean).otherwise(text)).drop("secret_spans")
