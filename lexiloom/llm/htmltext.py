"""Main text of web pages with a site style tree.

Every page is read into blocks of text, each with its path: its article or main element, or else the body, and the
names and classes of the elements from there down to the block. The trees of a host's pages are merged by path.

1. A path that bears text has an importance of 0.1 x presentation + 0.9 x content: presentation is the entropy of how
   many blocks the path has on a page, content is one less the mean entropy of its texts over the pages that hold
   them, both in units of log(pages of the path). A template block (the same text, equally often, on every page) has
   0, a block that each page writes anew has 1. A path on one page has 1.
2. The importance of a branch, a path and all below it, is composed of its text-bearing paths: their mean, weighted by
   their blocks and by 0.9 for every level between.
3. A branch is removed from every page of the host, with all that it holds, where its importance, raised by the doubt
   that 1 / pages leaves, is under LEAST_IMPORTANCE times that of the whole article or body. So nothing goes on a host
   of copies, where all is alike, nor on hosts of a few pages.

Elements whose name, role or class says what they are (menus, page headers, footers, sidebars, notices, adverts,
forms, comments of readers) are branches of importance 0 on any host, known in advance, unless they hold the article
or main element or most of the page's text: these are wrappers. A class counts if all its words are such words or
words of place and form, so `cookie-notice` does and `has-sidebar` or `notice-of-hearing` does not. An article or main
element is never such a branch. Inside an article, class words that articles use too (alert, related, social) only
halve the importance, and hide what is mostly links. On pages without a marked article a list of nothing but links is
a menu.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

#: Names of elements, roles and class words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
DROPPED = frozenset("script style noscript template iframe svg math canvas object audio video nav aside footer form button select textarea dialog menu head title fieldset noembed noframes datalist option".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split()
)
CLOSES_P = BLOCKS - {"body", "html", "li", "dd", "dt", "tbody", "tfoot", "thead", "tr", "caption"}
SCOPE = frozenset("article aside body caption div fieldset footer form header html main nav section table td th li blockquote".split())
SPACED = frozenset("br td th option img".split())
NOISE_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments reply replies respond disqus share sharing social related recommended recommendations widget login toolbar pagination pager skip masthead topbar".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
OUTER_NOISE = frozenset("header masthead topbar".split())
#: Words of place and form that stand beside such words in a class.
PLACE_WORDS = frozenset(
    "site main page global primary secondary left right top bottom upper lower inner outer wrapper wrap container holder box block list items item area section bar strip slot unit panel pane group row column col button buttons link links icon icons form post posts article articles entry story stories news recent popular latest message text title header head banner image img google dfp desktop mobile sticky fixed floating".split()
)
#: Never text; the other elements of DROPPED and the words are overruled for wrappers.
NEVER = DROPPED - frozenset("head nav aside footer form dialog menu fieldset".split())
#: Of NOISE_WORDS those that sections of an article carry as well.
AMBIGUOUS = frozenset("banner promo promotion notice notification alert popup modal overlay sidebar menu share sharing social related recommended recommendations widget toolbar skip masthead topbar respond subscription".split())
LOWERED = "~"  # ends the name of such a section in a path

TAG = re.compile(r"""<!--(?:.*?-->|-?>|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORDS = re.compile(r"[a-z0-9]+")
CAMEL = re.compile("([a-z0-9])([A-Z])")
HOST = re.compile(r"^[a-z][a-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)")

LEAST_IMPORTANCE = 0.3
DECAY = 0.9
LEVELS = 40  # levels below are one level
MENU_LINKS = 0.8
BROADCAST_PATHS = 200_000


class Block:
    __slots__ = ("path", "text", "link", "root", "list")

    def __init__(self, path: str, text: str, link: float, root: int, list_: int):
        self.path, self.text, self.link, self.root, self.list = path, text, link, root, list_


def host(url: str | None) -> str:
    m = HOST.match((url or "").strip().lower())
    return m[1] if m else ""


def _attributes(raw: str) -> dict[str, str]:
    if not raw or raw == "/":
        return {}
    return {m[1].lower(): next((g for g in m.groups()[1:] if g is not None), "") for m in ATTRIBUTE.finditer(raw)}


def noise_words(attributes: dict[str, str]) -> set[str]:
    """Words of NOISE_WORDS, and of OUTER_NOISE, in the classes and ids that consist of such words and words of place."""
    found: set[str] = set()
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = set(WORDS.findall(CAMEL.sub(r"\1 \2", name).lower()))
        noise = words & (NOISE_WORDS | OUTER_NOISE)
        if noise and all(w in noise or w in PLACE_WORDS or w.isdigit() for w in words):
            found |= noise
    return found


def read_blocks(page: str | None) -> list[Block]:
    """Blocks of a page outside elements known as noise. root: 2 in an article, 1 in the main element, 0 elsewhere."""
    page = page or ""
    # path, text with the suspects around it and whether it is linked, root, list
    raw_blocks: list[tuple[str, list[tuple[str, tuple[int, ...], bool]], int, int]] = []
    # of every open element: name, style name, its number as a suspect or -1, root, its number as a list or -1
    stack: list[tuple[str, str, int, int, int]] = []
    lists = 0
    parts: list[tuple[str, tuple[int, ...], bool]] = []
    #: of every suspect: may an article or main element clear it, may most of the text
    suspects: list[tuple[bool, bool]] = []
    around: tuple[int, ...] = ()
    never = 0
    at, end = 0, len(page)

    def flush() -> None:
        if parts:
            root = max((s[3] for s in stack), default=0)
            top = next((d for d, s in enumerate(stack) if s[3] == root), 0) if root else -1
            chain = [s[1] for s in stack[top + 1 :] if (s[0] in BLOCKS or s[0] in ("td", "th")) and s[0] not in ("html", "body")]
            path = "/".join([("body", "main", "article")[root], *chain[:LEVELS]])
            raw_blocks.append((path, parts.copy(), root, max((s[4] for s in stack), default=-1)))
        parts.clear()

    def close(depth: int) -> None:
        nonlocal around, never
        if any(s[0] in BLOCKS for s in stack[depth:]):
            flush()
        gone = sum(s[2] >= 0 for s in stack[depth:])
        around = around[: len(around) - gone]
        never -= sum(s[2] == -2 for s in stack[depth:])
        del stack[depth:]

    while at < end:
        m = TAG.search(page, at)
        upto = m.start() if m else end
        if upto > at and not never:
            parts.append((page[at:upto], around, any(s[0] == "a" for s in stack[-3:])))
        if not m:
            break
        at = m.end()
        slash, name, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name or (m[5] and m.end() == end and page[-1:] != ">"):  # comments, doctypes, a tag cut off at the end
            continue
        name = name.lower()
        if slash:
            for d in range(len(stack) - 1, -1, -1):
                if stack[d][0] == name:
                    close(d)
                    break
                if stack[d][0] in SCOPE and name not in BLOCKS | {"td", "th"}:
                    break
                if name in ("p", "li") and stack[d][0] in SCOPE - {"div", "li"}:
                    break
            continue
        if name in CLOSES_P:
            for d in range(len(stack) - 1, -1, -1):
                if stack[d][0] == "p":
                    close(d)
                    break
                if stack[d][0] in SCOPE:
                    break
        if name in ("li", "dd", "dt", "tr", "td", "th", "option"):
            same = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th")}.get(name, (name,))
            stop = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "option": ("select",)}.get(name, ("tr", "table"))
            for d in range(len(stack) - 1, -1, -1):
                if stack[d][0] in stop:
                    break
                if stack[d][0] in same:
                    close(d)
                    if name != "tr" or not stack or stack[-1][0] not in same:
                        break
        if name in BLOCKS:
            flush()
        if name in SPACED and not never:
            parts.append((" ", around, False))
        if name in VOID or raw.endswith("/") and name in ("svg", "path"):
            continue
        attributes = _attributes(raw)
        words = WORDS.findall(f"{attributes.get('class', '')} {attributes.get('id', '')}".lower())
        noisy = noise_words(attributes)
        root = 2 if name == "article" else 1 if name == "main" or attributes.get("role", "").lower() == "main" else 0
        inside = root or any(s[3] for s in stack)
        named = noisy & NOISE_WORDS if name not in ("html", "body") and not root else frozenset()
        ambiguous = bool(inside) and named <= AMBIGUOUS
        certain = (
            (name in DROPPED and not root)
            or attributes.get("role", "").lower() in NOISE_ROLES
            or "hidden" in attributes
            or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        )
        worded = bool(named) and not ambiguous or (not inside and (name == "header" or (name not in ("html", "body") and bool(noisy & OUTER_NOISE))))
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            if not certain and not worded and not never:
                parts.append((page[at : stop.start() if stop else end], around, False))
            at = stop.end() if stop else end
            continue
        number = -1
        if name in NEVER:
            number = -2
            never += 1
        elif certain or worded:
            number = len(suspects)
            # inside an article only a form can be the wrapper of its text
            suspects.append((worded and not certain or name == "form", not any(s[3] for s in stack) or name == "form"))
            around += (number,)
        style = ".".join([name, *sorted(set(words))[:4]]) + (LOWERED if named and ambiguous else "")
        lists += name in ("ul", "ol", "dl")
        stack.append((name, style, number, root, lists if name in ("ul", "ol", "dl") else -1))
    flush()

    whole, rooted, held, held_root = 0, 0, [0] * len(suspects), [0] * len(suspects)
    if suspects:
        for _, pieces, root, _ in raw_blocks:
            for t, marks, _ in pieces:
                n = len(t.strip())
                whole += n
                rooted += n if root else 0
                for k in marks:
                    held[k] += n
                    held_root[k] += n if root else 0
    guilty = {k for k, (by_root, by_size) in enumerate(suspects) if not (by_size and 2 * held[k] > whole or by_root and by_size and 2 * held_root[k] > rooted)}
    out: list[Block] = []
    for path, pieces, root, list_ in raw_blocks:
        mine = [(t, link) for t, marks, link in pieces if guilty.isdisjoint(marks)]
        text = " ".join(html.unescape("".join(t for t, _ in mine)).split())
        if text:
            out.append(Block(path, text, sum(len(t.strip()) for t, link in mine if link) / len(text), root, list_))
    return out


def chosen(blocks: list[Block]) -> tuple[list[Block], bool]:
    """The blocks of the article, or of the main element, or of the page; is the article marked?"""
    for level in (2, 1):
        inner = [b for b in blocks if b.root >= level]
        if inner:
            return inner, True
    return blocks, False


def menus(blocks: list[Block]) -> set[int]:
    """Lists of two blocks or more in which every block is a link."""
    linked: dict[int, list[bool]] = {}
    for b in blocks:
        linked.setdefault(b.list, []).append(b.link >= MENU_LINKS)
    return {k for k, v in linked.items() if k >= 0 and len(v) > 1 and all(v)}


def branches(path: str) -> list[str]:
    """The branches that a path lies in, from its root on, itself the last."""
    parts = path.split("/")
    return ["/".join(parts[: n + 1]) for n in range(len(parts))]


def main_text(page: str | None, dull: frozenset[str] | set[str] = frozenset()) -> str:
    """Text of a page; `dull`: the branches that go on its host."""
    blocks, marked = chosen(read_blocks(page))
    lists = set() if marked else menus(blocks)
    gone = {p: not dull.isdisjoint(branches(p)) for p in {b.path for b in blocks}} if dull else {}
    kept = [b for b in blocks if not gone.get(b.path) and b.list not in lists and not (LOWERED in b.path and b.link >= 0.5)]
    return "\n".join(b.text for b in kept)


def style_tree(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path, importance, pages: the merged trees with the composed importance of every branch. Pages without a host have no tree."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts: Counter = Counter()
        shape: Counter = Counter()

        def table() -> pd.DataFrame:
            rows = [(h, p, "text", k, n) for (h, p, k), n in texts.items()] + [(h, p, "shape", k, n) for (h, p, k), n in shape.items()]
            texts.clear()
            shape.clear()
            return pd.DataFrame(rows, columns=["host", "path", "kind", "value", "n"])

        for batch in batches:
            for url, page in zip(batch["u"], batch["h"]):
                name = host(url)
                if not name:
                    continue
                times: Counter = Counter()
                seen: set = set()
                for b in chosen(read_blocks(page))[0]:
                    times[b.path] += 1
                    seen.add((name, b.path, int.from_bytes(hashlib.blake2b(b.text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)))
                texts.update(seen)
                shape.update((name, p, n) for p, n in times.items())
            if len(texts) > 200_000:
                yield table()
        yield table()

    rows = pages.select(F.col(url_col).alias("u"), F.col(html_col).alias("h")).mapInPandas(read, "host string, path string, kind string, value long, n long")
    sums = rows.groupBy("host", "path", "kind", "value").agg(F.sum("n").alias("n"))
    n = F.col("n")
    is_text, is_shape = F.col("kind") == "text", F.col("kind") == "shape"
    per = sums.groupBy("host", "path").agg(
        F.sum(F.when(is_shape, n)).alias("pages"),
        F.sum(F.when(is_shape, n * F.log(n))).alias("shape_log"),
        F.sum(F.when(is_shape, n * F.col("value"))).alias("blocks"),
        F.sum(F.when(is_text, n)).alias("texts"),
        F.sum(F.when(is_text, n * F.log(n))).alias("text_log"),
    )
    log_m = F.log(F.col("pages"))
    presentation = F.lit(1) - F.col("shape_log") / F.col("pages") / log_m  # entropy of a count distribution, in units of log(pages)
    content = F.lit(1) - F.col("text_log") / F.col("texts") / log_m
    own = F.when(F.col("pages") > 1, 0.1 * presentation + 0.9 * content).otherwise(1.0)
    own = own * F.when(F.col("path").contains(LOWERED), 0.5).otherwise(1.0)
    # every path counts in the branches above it, the farther the less
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("branch"), (F.size(parts) - k).alias("far")))
    spread = per.select("host", "pages", "blocks", own.alias("own"), F.explode(above).alias("a"))
    weight = F.col("blocks") * F.pow(F.lit(DECAY), F.col("a.far"))
    return spread.groupBy("host", F.col("a.branch").alias("path")).agg((F.sum(weight * F.col("own")) / F.sum(weight)).alias("importance"), F.max("pages").alias("pages"))


def dull_branches(tree: DataFrame, least: float = LEAST_IMPORTANCE) -> DataFrame:
    """host, path: the branches below a root whose importance, raised by 1 / pages of doubt, is under `least` times the root's."""
    root = F.substring_index("path", "/", 1)
    roots = tree.where(~F.contains("path", F.lit("/"))).select("host", F.col("path").alias("root"), F.col("importance").alias("whole"))
    doubted = F.col("importance") + (1 - F.col("importance")) / F.col("pages")
    return tree.where(F.contains("path", F.lit("/"))).withColumn("root", root).join(roots, ["host", "root"]).where(doubted < least * F.col("whole")).select("host", "path")


def extract(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", least: float = LEAST_IMPORTANCE) -> DataFrame:
    """All columns of `pages` and main_text, the blocks of the main text in page order, one to a line.

    A null or empty page has an empty text. Pages without a host in their url are read without a style tree, pages of
    a host with one page keep all but what its elements say is noise. Pages that repeat are read alike and count as
    pages. A page is read whole whatever its length. Columns named main_text, _dull or _host are replaced or dropped.
    """
    spark = pages.sparkSession
    kept = pages.select(*[pages[c] for c in pages.columns if c.lower() not in ("main_text", "_dull", "_host")])
    tree = materialize(style_tree(pages, url_col=url_col, html_col=html_col), "style-tree")
    dull = materialize(dull_branches(tree, least), "dull-branches")
    release(tree)
    if dull.count() <= BROADCAST_PATHS:  # a few dozen bytes each
        by: dict[str, set[str]] = {}
        for r in dull.collect():
            by.setdefault(r["host"], set()).add(r["path"])
        release(dull)
        box = spark.sparkContext.broadcast(by)

        @F.pandas_udf("string")
        def text(urls: pd.Series, pages: pd.Series) -> pd.Series:
            return pd.Series([main_text(p, box.value.get(host(u), frozenset())) for u, p in zip(urls, pages)], dtype=object)

        return kept.withColumn("main_text", text(F.col(url_col), F.col(html_col)))

    @F.pandas_udf("string")
    def named(urls: pd.Series) -> pd.Series:
        return urls.map(host)

    @F.pandas_udf("string")
    def text_of(pages: pd.Series, dull: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, set(d) if d is not None else frozenset()) for p, d in zip(pages, dull)], dtype=object)

    # written, so that the join has an exchange of its own on either side and Spark can split a hot host
    sets = materialize(dull.groupBy("host").agg(F.collect_set("path").alias("_dull")).withColumnRenamed("host", "_host"), "dull-sets")
    release(dull)
    joined = kept.withColumn("_host", named(F.col(url_col))).join(sets, "_host", "left")
    return joined.withColumn("main_text", text_of(F.col(html_col), F.col("_dull"))).select(*kept.columns, "main_text")
