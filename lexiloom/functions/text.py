"""Text and token-array functions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "[empty]"
WORD = r"([\p{L}\p{N}]+)"


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def fix_empty(text: Column) -> Column:
    """Empty and null texts become a visible placeholder, so that no encoder sees an empty input."""
    t = text_or_empty(text)
    return F.when(F.length(t) == 0, F.lit(EMPTY)).otherwise(t)


def truncate_chars(text: Column, max_tokens: int) -> Column:
    """Four characters a token: enough for the tokenizer that follows, and cheap."""
    return F.substring(text_or_empty(text), 1, 4 * max_tokens)


def prefixed_short(prefix: Column, text: Column) -> Column:
    return F.concat(prefix, F.lit(": "), text_or_empty(text))


def prefixed_long(instruction: Column, bos: str, text: Column) -> Column:
    return F.concat(instruction, F.lit(bos + " "), text_or_empty(text))


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(WORD), F.lit(1))


def hash_id(word: Column, vocabulary: int) -> Column:
    """A word's id by md5, which any engine can reproduce; 0 is kept for padding."""
    return F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long") % (vocabulary - 1) + 1


def token_ids(text: Column, vocabulary: int, max_length: int) -> Column:
    return F.transform(F.slice(words(text), 1, max_length), lambda w: hash_id(w, vocabulary))


def pad(tokens: Column, length: Column | int, value: int = 0) -> Column:
    n = F.lit(length) if isinstance(length, int) else length
    return F.concat(F.slice(tokens, F.lit(1), n), F.array_repeat(F.lit(value).cast("long"), F.greatest(n - F.size(tokens), F.lit(0)).cast("int")))


def attention_mask(tokens: Column, length: int) -> Column:
    real = F.least(F.size(tokens), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), real), F.array_repeat(F.lit(0), F.lit(length) - real))


def collapse_repeats(text: Column, token: str) -> Column:
    quoted = "".join("\\" + c if not c.isalnum() else c for c in token)
    return F.regexp_replace(text_or_empty(text), f"({quoted})+", token)


def corpus_text(title: Column, text: Column) -> Column:
    return F.trim(F.concat(text_or_empty(title), F.lit(" "), text_or_empty(text)))


def preview(text: Column, length: int = 200) -> Column:
    t = text_or_empty(text)
    return F.when(F.length(t) > length, F.concat(F.substring(t, 1, length), F.lit("..."))).otherwise(t)


def uniform(*keys: Column | str) -> Column:
    """A number in [0, 1) from the md5 of the keys: the same on every engine and in every run."""
    parts = [F.lit(k) if isinstance(k, str) else k.cast("string") for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / 4294967296.0


def hash_order(*keys: Column | str) -> Column:
    """A pseudo-random total order by md5 of the keys."""
    parts = [F.lit(k) if isinstance(k, str) else k.cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *parts))
