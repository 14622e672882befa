"""HTML extraction: the main text of a page, without what its site repeats on other pages.

Element subtrees are hashed, and their pages counted for each host in Spark; subtrees that recur across many
pages of a host are its template and are deleted, as are elements that are boilerplate by their tag or name.
Paragraphs of an article are never template, however often they recur, and no name makes a part of its prose boilerplate
but that of an advert. Comment sections go with all that is in them. A heading beside the article is none of it; a
``<header>`` within it is its title and stays.
"""

from __future__ import annotations

import html as html_lib
import re
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import Staged, lookup, table, unused

#: A subtree is of the template if it is on so many pages of a host, and on this share of them.
LEAST_PAGES, LEAST_SHARE = 5, 0.1
#: Digests of all templates that are handed to every task at most (8 bytes each); more are joined to the pages.
BROADCAST_DIGESTS = 1_000_000

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>", re.S)
NAMING = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[A-Za-z][a-z]*|[0-9]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: What an opening tag ends if it is open, up to the nearest of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"}),
}
NOT_IN_P = BLOCKS - {"body", "html", "caption", "option", "optgroup", "legend", "tbody", "td", "tfoot", "th", "thead", "tr", "summary", "figcaption"}
FENCES = frozenset("article section div main body html td th table form".split())
DROPPED = RAW | frozenset("head nav footer aside form button select svg math object audio video canvas map dialog menu".split())
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner banners sponsor sponsored promo promos promotion menu nav navbar "
    "navigation breadcrumb breadcrumbs sidebar sidebars masthead footer cookie cookies consent gdpr notice notices notification notifications popup "
    "modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments reply replies disqus "
    "respond pagination pager toolbar alert alerts widget widgets copyright disclaimer search banner contentinfo complementary skip".split()
)
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promos promotion".split())
COMMENTS = frozenset("comment comments reply replies disqus respond".split())
CONTENT = frozenset("articlebody main content article post entry story maincontent".split())
#: Parts of a name that say where something is or what holds it; a name is boilerplate if its other parts are.
LAYOUT = frozenset(
    "top bottom left right upper lower first second third last primary secondary inner outer box boxes wrap wrapper container holder section area "
    "block blocks list lists item items links link bar bars button buttons icon icons panel group row col column columns site page global mobile "
    "desktop sticky fixed floating in inline slot unit zone module region text body form message thread threads policy".split()
)
#: Parts of a name that leave open what it is of.
NEUTRAL = frozenset("post posts article articles story stories content news user users reader readers site main blog our your this".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote b i em strong span a code br q cite sub sup u s small mark time abbr td th tr tbody li".split())
#: Elements that a name can make boilerplate within an article, and those that it can nowhere.
HOLDERS = frozenset("div section ul ol dl table figure details center article header iframe".split())
INLINE = PROSE - frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote a li".split())


@lru_cache(maxsize=1 << 14)
def kinds(name: str) -> frozenset[str]:
    """What a class, id or role says that an element is: boilerplate, advert, comments, header, main, content."""
    parts = [p.lower() for p in PART.findall(name) if not p.isdigit()]
    rest = {p for p in parts if p not in LAYOUT}
    whole = name.lower()
    if not rest:
        return frozenset()
    out = set()
    if rest <= BOILERPLATE | NEUTRAL and rest & BOILERPLATE or whole in BOILERPLATE:
        out.add("boilerplate")
        out |= {k for k, some in (("advert", ADVERTS), ("comments", COMMENTS)) if rest & some}
    elif rest <= {"header", "topbar", "main"} and rest != {"main"}:
        out.add("header")
    elif rest <= CONTENT | {"single", "hentry", "blog", "news"}:
        out.add("content")
        if "main" in rest:
            out.add("main")
    return frozenset(out)


class Page:
    """A page as events in order: a text, None for a break, i for the start of node i, ~i for its end."""

    def __init__(self, html: str):
        self.events: list = []
        self.tag: list[str] = []
        self.kinds: list[frozenset] = []
        self.parent: list[int] = []
        self.digest: list[int] = []
        self.length: list[int] = []
        self._open: list[int] = []
        self._parts: list[list[bytes]] = []
        self._parse(html)
        self.roots = self._roots()
        #: Nodes that hold the main text, which nothing makes boilerplate.
        self.holding: set[int] = set()
        for i in self.roots:
            while i >= 0 and i not in self.holding:
                self.holding.add(i)
                i = self.parent[i]

    def _start(self, tag: str, attributes: str) -> None:
        found = NAMING.findall(attributes) if attributes else ()
        names = {v for x in found for y in x for v in y.split()}
        i = len(self.tag)
        self.tag.append(tag)
        self.kinds.append(frozenset().union(*map(kinds, names)) if names else frozenset())
        self.parent.append(self._open[-1] if self._open else -1)
        self.digest.append(0)
        self.length.append(0)
        self.events.append(i)
        self._open.append(i)
        self._parts.append([tag.encode("utf-8", "replace"), *sorted(n.lower().encode("utf-8", "replace") for n in names)])

    def _end(self) -> None:
        i, parts = self._open.pop(), self._parts.pop()
        self.digest[i] = xxhash.xxh64_intdigest(b"\0".join(parts), 42) - (1 << 63)
        self.events.append(~i)
        if self._open:
            up = self._open[-1]
            self._parts[-1].append(b"%d" % self.digest[i])
            self.length[up] += self.length[i]

    def _text(self, text: str) -> None:
        text = html_lib.unescape(text) if "&" in text else text
        self.events.append(text)
        if self._open and (own := " ".join(text.split())):
            self._parts[-1].append(own.encode("utf-8", "replace"))
            self.length[self._open[-1]] += len(own)

    def _close_to(self, tags, fences) -> None:
        """End open nodes down to the outermost of ``tags`` above the nearest of ``fences``."""
        depth = None
        for k in range(len(self._open) - 1, -1, -1):
            t = self.tag[self._open[k]]
            if t in tags:
                depth = k
            elif t in fences:
                break
        if depth is not None:
            while len(self._open) > depth:
                self._end()

    def _parse(self, html: str) -> None:
        at = 0
        for m in TAG.finditer(html):
            if m.start() < at:
                continue
            if m.start() > at:
                self._text(html[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            attributes = m[3] if m[2] else m[6]
            if m[1] or m[4]:
                if tag == "br":
                    self.events.append(" ")
                elif tag in ENDS or tag == "p" or tag not in BLOCKS:
                    self._close_to_last(tag, FENCES)
                else:
                    self._close_to_last(tag, ())
                continue
            if tag in NOT_IN_P:
                self._close_to({"p"}, FENCES)
            if tag in ENDS:
                self._close_to(*ENDS[tag])
            if tag in VOID:
                self.events.append(None if tag == "hr" else " " if tag == "br" else "")
                continue
            self._start(tag, attributes)
            if attributes.endswith("/") and tag in ("svg", "path", "math"):
                self._end()
            elif tag in RAW:
                end = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
                stop = end.start() if end else len(html)
                self._end()
                close = html.find(">", stop)
                at = close + 1 if end and close >= 0 else len(html)
        if at < len(html):
            self._text(html[at:])
        while self._open:
            self._end()

    def _close_to_last(self, tag: str, fences) -> None:
        """End the innermost open node of this tag and what it holds, if none of ``fences`` is between."""
        for k in range(len(self._open) - 1, -1, -1):
            t = self.tag[self._open[k]]
            if t == tag:
                while len(self._open) > k:
                    self._end()
                return
            if t in fences:
                return

    def _comments(self, i: int) -> bool:
        return "comments" in self.kinds[i] and self.tag[i] not in ("html", "body", "main") and self.tag[i] not in INLINE

    def _named(self, i: int, in_article: bool) -> bool:
        """Whether its tag or name says that node i is none of the main text."""
        tag, own = self.tag[i], self.kinds[i]
        if tag in DROPPED or not in_article and (tag == "header" or "header" in own and tag in HOLDERS):
            return True
        if tag in ("html", "body", "main") or tag in INLINE:
            return False
        if in_article and tag not in HOLDERS:
            return "advert" in own
        return "boilerplate" in own

    def boilerplate(self, i: int, in_article: bool) -> bool:
        if self.tag[i] in RAW or self.tag[i] == "head":
            return True
        return i not in self.holding and (self._comments(i) or self._named(i, in_article))

    def deletable(self, i: int, in_article: bool) -> bool:
        """Whether node i may be deleted as a part of the template."""
        return i not in self.holding and self.length[i] > 0 and self.tag[i] not in ("html", "body") and not (in_article and self.tag[i] in PROSE)

    def _roots(self) -> frozenset[int]:
        """Nodes whose text is the main text: articles, else main elements, else content by name, else none, which
        stands for all. Those in comment sections don't count, those in other boilerplate only if there are no others."""
        nodes = range(len(self.tag))
        comments, aside = [False] * len(nodes), [False] * len(nodes)
        for i in nodes:
            up = self.parent[i]
            comments[i] = self._comments(i) or up >= 0 and comments[up]
            aside[i] = comments[i] or self._named(i, False) or up >= 0 and aside[up]
        for fits in (
            lambda i: self.tag[i] == "article" and "boilerplate" not in self.kinds[i],
            lambda i: self.tag[i] == "main" or "main" in self.kinds[i] and self.tag[i] in ("div", "section"),
            lambda i: self.tag[i] in ("div", "section", "td") and "content" in self.kinds[i],
        ):
            found = [i for i in nodes if fits(i) and not comments[i] and self.length[i] > 0]
            if found:
                return frozenset([i for i in found if not aside[i]] or found)
        return frozenset()

    def walk(self, template=frozenset()):
        """(inside the main text, text or None for a break between blocks), without boilerplate and template."""
        roots = self.roots
        inside, skip = 0, None
        article = 0
        for e in self.events:
            if e is None or isinstance(e, str):
                if skip is None:
                    yield inside > 0 or not roots, e
                continue
            i = e if e >= 0 else ~e
            if skip is not None:
                if e < 0 and i == skip:
                    skip = None
                continue
            if e >= 0:
                if self.boilerplate(i, article > 0) or self.digest[i] in template and self.deletable(i, article > 0):
                    skip = i
                    yield inside > 0 or not roots, None if self.tag[i] in BLOCKS else ""
                    continue
                inside += i in roots
                article += self.tag[i] in ("article", "main")
            else:
                inside -= i in roots
                article -= self.tag[i] in ("article", "main")
            yield inside > 0 or not roots or e < 0 and i in roots, None if self.tag[i] in BLOCKS else ""

    def subtrees(self) -> set[int]:
        """Digests of the nodes that could be template and that tags and names leave."""
        out, article, skip = set(), 0, None
        for e in self.events:
            if e is None or isinstance(e, str):
                continue
            i = e if e >= 0 else ~e
            if skip is not None:
                skip = None if e < 0 and i == skip else skip
                continue
            step = self.tag[i] in ("article", "main")
            if e >= 0:
                if self.boilerplate(i, article > 0):
                    skip = i
                    continue
                if self.deletable(i, article > 0):
                    out.add(self.digest[i])
                article += step
            else:
                article -= step
        return out


def main_text(html: str | None, template=frozenset()) -> str:
    """Blocks of the main text in page order, joined by line feeds."""
    blocks: list[str] = []
    own: list[str] = []
    for inside, piece in Page(html or "").walk(template):
        if piece is None:
            blocks.append(" ".join("".join(own).split()))
            own = []
        elif inside:
            own.append(piece)
    blocks.append(" ".join("".join(own).split()))
    return "\n".join(b for b in blocks if b)


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; empty if it has none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(host, template): the digests of subtrees that recur across a host's pages.

    Equal pages count once. Digests are counted with partial sums, so a host with a third of all pages is no
    one task's load; a host's list is bounded, as each of its digests is on a share of its pages.
    """

    def emit(batches):
        for batch in batches:
            found = [sorted(Page(t).subtrees()) for t in batch["html"]]
            yield pd.DataFrame({"host": batch["host"], "h": batch["h"], "m": batch["m"], "digests": found})

    html = F.coalesce("html", F.lit(""))
    once = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64(html).alias("h"), F.crc32(html.cast("binary")).alias("m"), html.alias("html"))
    found = once.mapInPandas(emit, "host string, h bigint, m bigint, digests array<bigint>")
    # equal pages count once; only digests are shuffled for that, not the pages
    found = found.groupBy("host", "h", "m").agg(F.first("digests").alias("digests"))
    counts = found.select("host", F.explode(F.array_append("digests", F.lit(0).cast("long"))).alias("digest")).groupBy("host", "digest").agg(F.count(F.lit(1)).alias("n"))
    staged = Staged(pages.sparkSession, "templates")
    counts = staged.keep(counts.where(f"n >= {least_pages}"), "counts")
    pages_of = counts.where("digest = 0").select("host", F.col("n").alias("pages"))
    some = counts.where("digest <> 0").join(pages_of, "host").where(F.col("n") >= F.col("pages") * least_share)
    out = staged.keep(some.groupBy("host").agg(F.collect_set("digest").alias("template")), "templates")
    staged.only(out)
    return out


def extracted(pages: DataFrame) -> DataFrame:
    """``pages`` with ``text``, the main text of the whole html.

    A null or empty html, and a page of nothing but boilerplate, has an empty text. A page without a host, or without a
    url, shares the empty host's template. Rows, repeated ones too, and other columns stay (a ``text`` is replaced); an
    empty table gives an empty result.
    """
    sites = templates(pages)
    rest = pages.drop("text")
    plain = [F.col(f"`{c}`") for c in rest.columns]
    digests = sites.agg(F.sum(F.size("template"))).first()[0] or 0
    if digests <= BROADCAST_DIGESTS:
        known = pages.sparkSession.sparkContext.broadcast({r.host: frozenset(r.template) for r in sites.toLocalIterator()})

        @F.pandas_udf("string")
        def run(htmls: pd.Series, hosts: pd.Series) -> pd.Series:
            none: frozenset = frozenset()
            return pd.Series([main_text(h, known.value.get(x, none)) for h, x in zip(htmls, hosts, strict=True)], dtype=object)

        return rest.select(*plain, run(F.coalesce("html", F.lit("")), host_of(F.col("url"))).alias("text"))

    @F.pandas_udf("string")
    def run_joined(htmls: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, frozenset(() if x is None else [int(d) for d in x])) for h, x in zip(htmls, lists, strict=True)], dtype=object)

    key, own = unused("host", rest), unused("template", rest)
    sites = sites.select(F.col("host").alias(key), F.col("template").alias(own))
    joined = lookup(rest.withColumn(key, host_of(F.col("url"))), sites, key, most=0)
    return joined.select(*plain, run_joined(F.coalesce("html", F.lit("")), F.col(own)).alias("text"))


def op4_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    out = extracted(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
