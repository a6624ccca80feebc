"""Token ids by the tokenizers library, with a memo of chunks.

Byte-level and word-level pre-tokenizers alike end a token where white space follows other text, and where a
white space or ASCII punctuation mark other than the apostrophe follows a run of Latin letters. So a text is the
sequence of its chunks and each distinct chunk is encoded once. A tokenizer that lower-cases gets lower case, one
that drops white space gets none, which makes fewer chunks. Texts with white space that regular expression engines
disagree on, and those with the string of a special token, which the library finds before it cuts a text, are encoded
whole.
"""

from __future__ import annotations

import array
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import only_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_SPACE = r" \t\n\r"
_LATIN = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f"  # without the capital I with dot, whose lower case is two characters
_MARKS = r"\x21-\x26\x28-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e"
_WORD = rf"[{_LATIN}]+(?=[{_SPACE}{_MARKS}]|$)"
CHUNK = re.compile(rf"(?<![{_SPACE}])\n(?=[{_LATIN}])|[{_SPACE}]*{_WORD}|[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
BARE_CHUNK = re.compile(rf"{_WORD}|[^{_SPACE}]+")
SIMPLE = re.compile(rf"[\x00-\x7f{_LATIN}]*")
DISPUTED = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f-\u2064\u3000\ufeff]")
CUT = "\x02"
BORDER = rf"([{_LATIN}])([{_MARKS}])".replace(r"\u", r"\x{").replace(r"\x{012f", r"\x{12f}").replace(r"\x{0131", r"\x{131}").replace(r"\x{024f", r"\x{24f}")
PORTION = 10_000_000  # characters cut and numbered at a time
MEMO = 400_000
LONGEST = 64  # longer chunks are not kept


class MemoTokenizer:
    """Encodes texts to little-endian unsigned 32-bit ids, exactly as the tokenizer does on the whole text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo: dict[str, bytes] = {}
        config = json.loads(self.tokenizer.to_str())
        added = [t["content"] for t in config.get("added_tokens", [])]
        lead = os.path.commonprefix(added)
        self.lead = lead if not re.search(r"\w", lead) else ""  # what every special token begins with, in either case
        self.special = re.compile("|".join(map(re.escape, added)), re.I) if added else None
        steps = [config.get("normalizer") or {}, *(config.get("normalizer") or {}).get("normalizers", [])]
        cuts = [config.get("pre_tokenizer") or {}, *(config.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.lower = any(s.get("type") == "Lowercase" for s in steps)
        drops = any(c.get("type") == "Split" and c.get("behavior") == "Removed" and c.get("invert") and r"[^\s\p{L}\p{N}]+" in c["pattern"].get("Regex", "") for c in cuts)
        self.drops, self.chunk = drops, BARE_CHUNK if drops else CHUNK
        # words that can be encoded side by side: the ids that end (or start) a word tell them apart again
        size, suffix = self.tokenizer.get_vocab_size(), config["model"].get("end_of_word_suffix")
        self.border = np.zeros(size, bool)
        self.single = re.compile(rf"[{_LATIN}]+" if drops and suffix else rf" [{_LATIN}]+")
        self.ends = bool(drops and suffix)
        self.joins = self.ends or (not suffix and any(c.get("type") == "ByteLevel" and c.get("use_regex") for c in cuts))
        for token, i in self.tokenizer.get_vocab().items():
            self.border[i] = token.endswith(suffix) if self.ends else token.startswith("\u0120")

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words that match `single`."""
        out: list[bytes] = []
        for lo in range(0, len(words), 2000):
            part = words[lo : lo + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([(" " if self.ends else "").join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = 4 * np.flatnonzero(self.border[ids])
            if len(cuts) != len(part):
                out += self._plain(part)
                continue
            flat, cuts = ids.tobytes(), cuts.tolist()
            cuts = [0, *(c + 4 for c in cuts)] if self.ends else [*cuts, len(flat)]
            out += [flat[a:b] for a, b in zip(cuts, cuts[1:])]
        return out

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [array.array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts. Most texts have single blanks and line feeds only, which Arrow cuts and numbers."""
        texts = [(t or "") if t is None or t.isascii() else _valid(t) for t in texts]
        if self.special:
            at = [i for i, t in enumerate(texts) if self.lead in t and self.special.search(t)]
            if at:
                taken = set(at)
                rest, whole = iter(self._cut([t for i, t in enumerate(texts) if i not in taken])), dict(zip(at, self._plain([texts[i] for i in at])))
                return [whole[i] if i in whole else next(rest) for i in range(len(texts))]
        return self._cut(texts)

    def _cut(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        part: list[str] = []
        chars = 0
        for t in texts:
            part.append(t)
            chars += len(t)
            if chars > PORTION:
                out += self._portion(part)
                part, chars = [], 0
        return out + self._portion(part)

    def _portion(self, texts: list[str]) -> list[bytes]:
        # printable: no control character and no white space but single blanks and line feeds
        flat = [t.replace("\n", " ") for t in texts]
        easy = [i for i, t in enumerate(flat) if "  " not in t and t.isprintable()]
        out: list = [None] * len(texts)
        for i, ids in zip(easy, self._by_table([texts[i] for i in easy])):
            out[i] = ids
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, self._by_chunk([texts[i] for i in rest])):
            out[i] = ids
        return out

    def _by_table(self, texts: list[str]) -> list[bytes]:
        """Chunks of texts whose white space is single blanks and line feeds, cut and numbered by Arrow; Python sees each distinct chunk once."""
        if not texts:
            return []
        if self.lower:
            texts = [t.lower() if SIMPLE.fullmatch(t) else t for t in texts]
        blank, line = (CUT, CUT) if self.drops else (CUT + " ", CUT + "\n" + CUT)
        marked = pa.array([t.replace(" ", blank).replace("\n", line) for t in texts], pa.large_string())
        marked = pc.replace_substring_regex(marked, BORDER, r"\1" + CUT + r"\2")
        chunks = pc.split_pattern(marked, CUT)
        coded = chunks.values.dictionary_encode()
        keys, codes, ends = coded.dictionary.to_pylist(), coded.indices.to_numpy(), chunks.offsets.to_numpy()
        if len(self.memo) > MEMO:
            self.memo.clear()
        got = list(map(self.memo.get, keys))
        new = dict.fromkeys(k for k, g in zip(keys, got) if g is None)
        if new:
            self._encode_new(new)
            got = [new[k] if g is None else g for k, g in zip(keys, got)]
        sizes = np.fromiter(map(len, got), np.int32, len(got)) // 4
        starts = np.cumsum(sizes, dtype=np.int32) - sizes  # a portion has far fewer than 2^31 ids
        n = sizes[codes]
        stops = np.cumsum(n, dtype=np.int32)
        ids = np.frombuffer(b"".join(got), "<u4")[np.repeat(starts[codes] - (stops - n), n) + np.arange(int(stops[-1]) if len(stops) else 0, dtype=np.int32)]
        flat, cuts = ids.tobytes(), (4 * np.concatenate([[0], stops.astype(np.int64)]))[ends].tolist()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]

    def _encode_new(self, new: dict[str, bytes]) -> None:
        """Fill in the ids of chunks and remember them."""
        single = self.single.fullmatch
        words = [c for c in new if self.joins and single(c)]
        new.update(zip(words, self._words(words)))
        rest = [c for c, ids in new.items() if ids is None]
        new.update(zip(rest, self._plain(rest)))
        self.memo.update(new if max(map(len, new)) <= LONGEST else {c: ids for c, ids in new.items() if len(c) <= LONGEST})

    def _by_chunk(self, texts: list[str]) -> list[bytes]:
        if len(self.memo) > MEMO:
            self.memo.clear()
        out = []
        cut, get = self.chunk.findall, self.memo.get
        holes: list[tuple[list, list[str], list[int]]] = []
        new: dict[str, bytes] = {}
        for t in texts:
            if DISPUTED.search(t):
                out.append([self._plain([t])[0]])
                continue
            chunks = cut(t.lower() if self.lower and SIMPLE.fullmatch(t) else t)
            got = list(map(get, chunks))
            out.append(got)
            if None in got:
                at = [i for i, g in enumerate(got) if g is None]
                new.update(dict.fromkeys([chunks[i] for i in at]))
                holes.append((got, chunks, at))
        if new:
            self._encode_new(new)
        for got, chunks, at in holes:
            for i in at:
                got[i] = new[chunks[i]]
        return list(map(b"".join, out))


def _valid(text: str) -> str:
    return text.encode("utf-8", "replace").decode("utf-8")


_loaded: dict[str, MemoTokenizer] = {}


def tokenizer(path: str) -> MemoTokenizer:
    """One tokenizer a worker process."""
    only_cache("tokens", _loaded.clear)
    if path not in _loaded:
        _loaded[path] = MemoTokenizer(path)
    return _loaded[path]
