"""Main text of web pages: a template of each host, deduced from tokens that occur alike on its pages, and the text of its slots."""

from __future__ import annotations

import html
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stash
from tessera.llm.wordcodes import arrow_rows

# --- fixed values: the names of HTML ---------------------------------------------------------------------------------

#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
#: Elements that stand within a line; all others begin and end a block.
INLINE = frozenset("script style template noscript button input select option textarea object iframe svg math canvas audio video picture source map area a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that hold no article text.
NO_TEXT = frozenset("head script style title noscript template iframe object embed applet canvas svg math audio video map nav footer aside form button select option textarea input fieldset dialog menu noembed noframes xmp".split())
#: Elements, and words of role, class and id, that hold the article.
ARTICLE_TAGS = frozenset("article main".split())
ARTICLE_NAMES = frozenset("article main content post entry story".split())
#: Words by which an article element is no article but one of many small ones beside it.
NO_ARTICLE = frozenset("comment comments reply ad advert sponsored promo related teaser widget".split())
#: Words of role, class and id that hold something else.
OTHER_NAMES = frozenset(
    "ad ads adv adbox adslot adunit adsbygoogle advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promotion banner banners cookie cookies consent gdpr notice notices alert alerts notification popup modal overlay "
    "nav navbar navigation navigational menu menus breadcrumb breadcrumbs pagination pager toc header masthead topbar footer bottombar copyright sidebar aside complementary widget widgets rail "
    "comment comments commentlist disqus respond reply replies discussion share sharing social related recommended recommendations trending newsletter subscribe subscription signup login search form contentinfo banner hidden".split()
)
#: Start tags that close an open element of the second set (implied end tags).
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "thead": {"tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "body": {"head"},
}
#: Start tags that close an open paragraph.
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements that an implied or wrong end tag does not reach beyond.
LIMITS = frozenset("article aside body div footer form header html main nav section table ul ol dl td th".split())

# --- reading a page -----------------------------------------------------------------------------------------------

_MARKUP = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"""(?<![\w-])(role|class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
#: Where a run of text stands: nothing is known of it; something else than the article; a place named like an article; an
#: article element. TAG: a start or an end of an element.
PLAIN, OTHER, NAMED, ARTICLE, TAG = 0, 1, 2, 3, 4
#: What an element says that is a header, by its tag or its names: something else, but a part of an article that it stands in.
HEADER = 5
#: Places named like an article hold the article only if at least this share of a page's text that is not something else stands in them.
NAMED_SHARE = 0.3
_UNSEEN = re.compile(r"""aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none""", re.I)
_QUOTED, _HIDDEN = re.compile(r""""[^"]*"|'[^']*'"""), re.compile(r"(?<![\w-])hidden(?![\w-])", re.I)


class Piece(NamedTuple):
    """A token of a page. name: the path of elements to it; kind: where it stands; text: of a run of text, decoded, or a
    blank where only white space is; block: it begins or ends a block."""

    name: str
    kind: int
    linked: bool
    text: str | None
    block: bool


@lru_cache(1 << 14)
def _kind_of(tag: str, attributes: str) -> tuple[int, str]:
    """(what an element's tag and names say of its text, its name in paths)."""
    names = " ".join(sorted(f"{a.lower()}={(x or y or z).strip()}" for a, x, y, z in _NAMES.findall(attributes))) if attributes else ""
    full = f"{tag} {names}" if names else tag
    if tag == "header":
        return HEADER, full
    if tag in NO_TEXT or attributes and (_UNSEEN.search(attributes) or _HIDDEN.search(_QUOTED.sub("", attributes))):
        return OTHER, full
    words = {w.lower() for part in names.split() for w in _WORDS.findall(part.partition("=")[2] or part)} if names and tag not in ("html", "body") else set()
    if tag in ARTICLE_TAGS:
        return OTHER if words & NO_ARTICLE else ARTICLE, full
    other = words & OTHER_NAMES
    if other:
        return HEADER if other == {"header"} else OTHER, full
    return NAMED if words & ARTICLE_NAMES else PLAIN, full


def pieces(page: str) -> Iterator[Piece]:
    """The tokens of a page in order. End tags that were left out are implied, unknown ones are passed over, and a page
    may end anywhere. Text is decoded; text in scripts, styles and the like is passed over."""
    stack: list[tuple[str, str, int, bool]] = []  # tag, path, kind, within a link
    path, kind, linked, at = "", PLAIN, False, 0

    def close(upto: int):
        nonlocal path, kind, linked
        while len(stack) > upto:
            tag, own, _, _ = stack.pop()
            yield Piece(f"/{own}", TAG, False, None, tag not in INLINE)
        path, kind, linked = stack[-1][1:] if stack else ("", PLAIN, False)

    def run(text: str):
        if text and not text.isspace():
            clean = html.unescape(text) if "&" in text else text
            yield Piece(path, kind, linked, clean, False)
        elif text:
            yield Piece(path, OTHER, linked, " ", False)

    while at < len(page):
        m = _MARKUP.search(page, at)
        if not m:
            yield from run(page[at:])
            break
        yield from run(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:  # a comment or a declaration
            continue
        tag, ends = tag.lower(), bool(m[1] or m[4])
        if ends:
            if tag == "br":
                yield Piece(path, OTHER, False, " ", False)
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    yield from close(i)
                    break
                if stack[i][0] in LIMITS and tag not in LIMITS:
                    break
            continue
        shut = CLOSES.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
        if shut:
            least = None
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in shut:
                    least = i
                elif stack[i][0] in LIMITS and stack[i][0] not in shut:
                    break
            if least is not None:
                yield from close(least)
        own, name = _kind_of(tag, m[3] or m[6] or "")
        below = f"{path}>{name}"
        if len(below) > 400:  # a path of any depth keeps one size
            below = blake2b(below.encode(), digest_size=8).hexdigest()
        # what is inside something else is so too
        now = kind if own == HEADER and kind == ARTICLE else OTHER if own in (OTHER, HEADER) or kind == OTHER else max(own, kind)
        yield Piece(below, TAG, False, " " if tag == "br" else None, tag not in INLINE)
        if tag in VOID or (m[3] or "").endswith("/") and tag not in INLINE and tag not in RAW and tag not in LIMITS:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else len(page)
        stack.append((tag, below, now, linked or tag == "a"))
        path, kind, linked = stack[-1][1:]
    yield from close(0)


@lru_cache(1 << 16)
def code(name: str) -> int:
    """A token's name as a number."""
    return int.from_bytes(blake2b(name.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def token_of(piece: Piece) -> int:
    """The token that a piece counts as in a template: text too, by its words, where nothing says that it is an article's."""
    if piece.kind == TAG:
        return code(piece.name)
    return code.__wrapped__(f"{piece.name}#{tidy(piece.text)}") if piece.kind == PLAIN else 0


def tidy(text: str) -> str:
    """White space (the no-break space too) turned into single blanks."""
    return " ".join(text.split())


def level_of(chars: dict[int, int]) -> int:
    """The best place that a page has text in, from the characters in each: an article element, else places named like one if they hold
    enough, else any place that is not something else."""
    if chars.get(ARTICLE):
        return ARTICLE
    named, plain = chars.get(NAMED, 0), chars.get(PLAIN, 0)
    return NAMED if named and named >= NAMED_SHARE * (named + plain) else PLAIN


def counts_at(level: int, kind: int) -> bool:
    """Whether text of a kind may be the article's on a page of a level."""
    return kind == level or level == PLAIN and kind == NAMED


def chars_of(texts: Iterator[tuple[int, int]]) -> dict[int, int]:
    found: dict[int, int] = defaultdict(int)
    for kind, size in texts:
        found[kind] += size
    return found


# --- templates ------------------------------------------------------------------------------------------------------


class Walk:
    """Follows the instances of token classes through a page. A class is a list of tokens in order; `at` is where the walk stands: (class,
    gap), the gap behind the class's token of that number; (-1, 0) is outside all."""

    def __init__(self, classes: list[list[int]]):
        self.classes = classes
        self.index = {t: (c, j) for c, tokens in enumerate(classes) for j, t in enumerate(tokens)}
        self.begin()

    def begin(self) -> None:
        self.open: list[list[int]] = []
        self.broken: set[int] = set()
        self.parents: dict[int, set[tuple[int, int]]] = defaultdict(set)

    @property
    def at(self) -> tuple[int, int]:
        return tuple(self.open[-1]) if self.open else (-1, 0)

    def _drop_above(self, c: int, blame_itself: bool) -> None:
        """What is open above class c overlaps it: the later class of each two is broken, classes being in order of size."""
        while self.open and self.open[-1][0] != c:
            other = self.open.pop()[0]
            self.broken.add(max(c, other))
        if blame_itself and self.open:
            self.broken.add(self.open.pop()[0])

    def step(self, token: int) -> bool:
        """Take a token; whether it is one of a class."""
        found = self.index.get(token)
        if not found:
            return False
        c, j = found
        is_open = any(o[0] == c for o in self.open)
        if j == 0:
            if is_open:
                self._drop_above(c, True)
            self.parents[c].add(self.at)
            self.open.append([c, 0])
            return True
        if not is_open:
            self.broken.add(c)
            return True
        self._drop_above(c, False)
        if self.open[-1][1] != j - 1:
            self._drop_above(c, True)
            return True
        self.open[-1][1] = j
        if j == len(self.classes[c]) - 1:
            self.open.pop()
        return True

    def end(self) -> None:
        self.broken.update(c for c, _ in self.open)
        self.broken.update(c for c, p in self.parents.items() if len(p) > 1)


@lru_cache(256)
def template(text: str) -> tuple[Walk, dict]:
    """A host's classes and accepted slots, from JSON."""
    made = json.loads(text)
    return Walk([c["tokens"] for c in made["classes"]]), {(s["level"], s["c"], s["gap"], s["kind"]) for s in made.get("slots") or []}


# --- passes over pages -----------------------------------------------------------------------------------------------

_SKELETON = "host string, mark1 long, mark2 long, tokens array<long>, kinds array<tinyint>, firsts array<boolean>, sizes array<int>"


def _rows(rows: list[tuple], fields: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64()), "array<tinyint>": pa.list_(pa.int8()), "array<boolean>": pa.list_(pa.bool_()), "array<int>": pa.list_(pa.int32())}
    names, types = zip(*(f.split(" ") for f in fields.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _skeletons(batches):
    """Pages to their tokens, without those in something else than the article. sizes: characters of text, negative in links."""
    held, size = [], 0
    for host, page in arrow_rows(batches, "host", "html"):
        tokens, kinds, firsts, sizes, seen = [], [], [], [], set()
        for p in pieces(page.decode("utf-8", "replace")):
            if p.kind == OTHER:
                continue
            token = token_of(p)
            tokens.append(token)
            kinds.append(p.kind)
            firsts.append(token not in seen)
            seen.add(token)
            n = len(p.text) if p.kind != TAG else 0
            sizes.append(-n if p.linked else n)
        if not tokens:
            continue
        digest = blake2b(page, digest_size=8).digest()
        held.append((host.decode(), int.from_bytes(digest[:4], "little") >> 1, int.from_bytes(digest[4:], "little") >> 1, tokens, kinds, firsts, sizes))
        size += len(tokens)
        if size > 50_000:
            yield _rows(held, _SKELETON)
            held, size = [], 0
    if held:
        yield _rows(held, _SKELETON)


def _skeleton_rows(batches):
    for b in batches:
        for lo in range(0, b.num_rows, 64):
            yield from b.slice(lo, 64).to_pylist()


_FAULTS = "host string, c int, broken int, parent int, gap int"


def _faults(batches):
    """For each page and class: is it broken there, and in which gap of which class does it lie?"""
    held = []
    for r in _skeleton_rows(batches):
        walk, _ = template(r["plan"])
        walk.begin()
        for token, kind in zip(r["tokens"], r["kinds"], strict=True):
            if kind in (TAG, PLAIN):
                walk.step(token)
        walk.end()
        for c in walk.broken | walk.parents.keys():
            parent, gap = min(walk.parents[c], default=(-1, 0))
            held.append((r["host"], c, int(c in walk.broken), parent, gap))
        if len(held) > 10_000:
            yield _rows(held, _FAULTS)
            held = []
    if held:
        yield _rows(held, _FAULTS)


_SLOTS = "host string, level int, c int, gap int, kind int, chars long, linked long"


def _slots(batches):
    """Characters in each slot of the template, and how many of them are links, summed over this task's pages."""
    sums: dict[tuple, list[int]] = defaultdict(lambda: [0, 0])
    for r in _skeleton_rows(batches):
        walk, _ = template(r["plan"])
        walk.begin()
        level = level_of(chars_of((k, abs(n)) for k, n in zip(r["kinds"], r["sizes"], strict=True)))
        for token, kind, size in zip(r["tokens"], r["kinds"], r["sizes"], strict=True):
            if kind in (TAG, PLAIN) and walk.step(token) or kind == TAG:
                continue
            s = sums[(r["host"], level, *walk.at, kind)]
            s[0] += abs(size)
            s[1] += max(0, -size)
        if len(sums) > 10_000:
            yield _rows([(*k, *v) for k, v in sums.items()], _SLOTS)
            sums.clear()
    if sums:
        yield _rows([(*k, *v) for k, v in sums.items()], _SLOTS)


def main_text(page: str, plan: str | None) -> str:
    """The text of a page's accepted slots, a block a line. Without a template, or where its slots hold nothing on this page, the
    text in the best place that the page has, and of blocks in no place those that are not mostly links."""
    walk, accepted = template(plan) if plan else (Walk([]), set())
    walk.begin()
    own = list(pieces(page))
    level = level_of(chars_of((p.kind, len(p.text)) for p in own if p.text is not None and p.kind not in (TAG, OTHER)))
    blocks: list[list[tuple[str, bool, bool]]] = [[]]  # text, accepted by its slot, linked
    for p in own:
        if p.block and blocks[-1]:
            blocks.append([])
        in_class = plan is not None and p.kind in (TAG, PLAIN) and walk.step(token_of(p))
        if p.text == " ":
            blocks[-1].append((" ", False, False))
        elif p.text is not None and p.kind != TAG and counts_at(level, p.kind):
            blocks[-1].append((p.text, not in_class and (level, *walk.at, p.kind) in accepted, p.linked))
    by_slots = [tidy("".join(t for t, slot, _ in b if slot or t == " ")) for b in blocks] if accepted else []
    if any(by_slots):
        return "\n".join(filter(None, by_slots))
    unlinked = [b for b in blocks if level != PLAIN or 2 * sum(len(t) for t, _, linked in b if linked) <= sum(len(t) for t, _, _ in b)]
    return "\n".join(filter(None, (tidy("".join(t for t, _, _ in b)) for b in unlinked)))


def _texts(batches):
    for b in batches:
        pages, texts = b.column("page"), []
        for _, page, plan in arrow_rows([b], "page", "html", "plan"):
            texts.append(main_text(page.decode("utf-8", "replace"), plan.decode() or None))
        yield pa.RecordBatch.from_arrays([pages, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page", "text", "n_chars"])


# --- the operator ---------------------------------------------------------------------------------------------------

#: A template is deduced from at least so many different pages of a host, by tokens on at least this share of its pages.
LEAST_PAGES, SHARE = 3, 0.5
#: Text of a slot that is named like nothing is taken if links are less than this share of it.
LINKS = 0.5
#: Hosts with templates that are broadcast, and the tokens that these have in all; more are joined by shuffle.
MOST_HOSTS, MOST_TOKENS = 10_000, 1_000_000


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _joined(rows: DataFrame, plans: DataFrame, few: bool, how: str) -> DataFrame:
    return rows.join(F.broadcast(plans) if few else plans, "host", how)


def token_classes(skeletons: DataFrame, least_pages: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """host, tokens: equivalence classes of two or more tokens with one occurrence vector, largest first within a host (c from 0).

    A token's occurrence vector (how often on each page of the host) is known by two sums over its occurrences of random numbers of the
    page: equal vectors have equal sums, other ones differ but by a chance of 2^-62, and sums are made in parts. Only tokens on at least
    a share of the host's pages are grouped, so that all classes of a host hold at most 1 / share times the tokens of a page."""
    hosts = skeletons.groupBy("host", "mark1", "mark2").agg(F.count(F.lit(1)).alias("n")).groupBy("host").agg(F.sum("n").alias("n_pages"), F.count(F.lit(1)).alias("n_distinct"))
    hosts = hosts.filter((F.col("host") != "") & (F.col("n_distinct") >= least_pages))
    each = skeletons.select("host", "mark1", "mark2", F.posexplode(F.arrays_zip("tokens", "kinds", "firsts")).alias("place", "t")).filter(F.col("t.kinds").isin(TAG, PLAIN))
    tokens = each.groupBy("host", F.col("t.tokens").alias("token")).agg(F.sum("mark1").alias("v1"), F.sum("mark2").alias("v2"), F.count(F.lit(1)).alias("n"), F.sum(F.col("t.firsts").cast("int")).alias("pages"), F.sum(F.col("place").cast("long")).alias("places"))
    often = tokens.join(hosts, "host").filter((F.col("pages") >= least_pages) & (F.col("pages") >= share * F.col("n_pages")))
    classes = often.groupBy("host", "v1", "v2", "n", "pages").agg(F.transform(F.sort_array(F.collect_list(F.struct("places", "token"))), lambda x: x["token"]).alias("tokens")).filter(F.size("tokens") > 1)
    order = Window.partitionBy("host").orderBy(F.desc(F.size("tokens")), F.desc("pages"), "v1", "v2")
    return classes.select("host", "tokens", (F.row_number().over(order) - 1).alias("c"))


def templates(skeletons: DataFrame, least_pages: int = LEAST_PAGES, share: float = SHARE) -> tuple[DataFrame, bool]:
    """(host, plan), a row for each host with a template, and whether these are few: its valid classes, nested by where they
    lie in each other, and the slots between their tokens that hold the article, as JSON.

    A class is valid if on every page its tokens come in one order, its instances overlap those of no larger class, and all of them lie in the same gap of
    the same class."""
    classes = stash(token_classes(skeletons, least_pages, share), "classes")
    sized = classes.agg(F.count_distinct("host").alias("hosts"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("tokens")).first()
    few = sized["hosts"] <= MOST_HOSTS and sized["tokens"] <= MOST_TOKENS

    def listed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("c", "tokens"))).alias("classes"))

    tried = listed(classes).select("host", F.to_json(F.struct("classes")).alias("plan"))
    faults = _joined(skeletons, tried, few, "inner").select("host", "plan", "tokens", "kinds").mapInArrow(_faults, _FAULTS)
    place = F.struct("parent", "gap")
    valid = faults.groupBy("host", "c").agg(F.max("broken").alias("broken"), F.min(place).alias("low"), F.max(place).alias("high")).filter("broken = 0 AND low = high").select("host", "c")
    kept = stash(listed(classes.join(valid, ["host", "c"])), "valid-classes")
    slots = _joined(skeletons, kept.select("host", F.to_json(F.struct("classes")).alias("plan")), few, "inner").select("host", "plan", "tokens", "kinds", "sizes").mapInArrow(_slots, _SLOTS)
    slots = slots.groupBy("host", "level", "c", "gap", "kind").agg(F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    fits = (F.col("kind") == F.col("level")) | ((F.col("level") == PLAIN) & (F.col("kind") == NAMED))
    taken = slots.filter(fits & ((F.col("level") != PLAIN) | (F.col("linked") < LINKS * F.col("chars"))))
    accepted = taken.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("level", "c", "gap", "kind"))).alias("slots"))
    return stash(kept.join(accepted, "host").select("host", F.to_json(F.struct("classes", "slots")).alias("plan")), "templates"), few


def extract_text(pages: DataFrame, least_pages: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """The main text of each page: page_id, url, text, n_chars.

    A template of each host is deduced from the tokens (tags with their path and names, runs of text) that have one occurrence
    vector over its pages; text is taken from the slots between them that are named, by element or by class, id or
    role, as an article, or, where nothing is named so, from slots whose text differs from page to page and is not mostly links. Text
    within elements that hold something else (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
    comments) is left out. Hosts with fewer than `least_pages` different pages have no template: their pages, and pages
    without a host, go by the names on the page alone.

    Null html is empty, an empty page has an empty text; a null url is kept and belongs to no host; repeated rows and rows
    without page_id are answered each; other columns are not read. Pages may have any length. An empty table gives an empty
    result."""
    rows = pages.select(F.struct("page_id", "url").alias("page"), host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    skeletons = stash(rows.select("host", "html").mapInArrow(_skeletons, _SKELETON), "skeletons")
    plans, few = templates(skeletons, least_pages, share)
    kind = f"struct<page_id:{dict(pages.dtypes)['page_id']},url:string>"
    out = _joined(rows, plans, few, "left").select("page", "html", "plan").mapInArrow(_texts, f"page {kind}, text string, n_chars long")
    return out.select("page.page_id", "page.url", "text", "n_chars")
