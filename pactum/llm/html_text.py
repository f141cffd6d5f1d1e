"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree of element branches (tag, class and id along the path, numbers made equal). A
branch's content counts as noise where the same blocks of text return on many of the host's pages, its presentation where
all pages have the same sequence of children; both are entropies over the host's different pages, and a branch whose
composite importance is low goes from each page. Names are a prior: an element that only says what it is not (nav, footer,
class="cookie-notice") goes whatever its entropy, one whose name merely has such a word (class="banner-history") goes
unless the tree finds it important, and no name removes html, body, main, what holds main, or all that a page has.
Paragraphs that stand directly in an article are kept whatever their entropy: sites copy articles.

Each page is parsed once, into blocks with the numbers of their branches, in a table; the tree is made from that table and
its low branches are taken from it. Counts by host and branch are aggregated before they are shuffled, so a host with a
third of all pages is no single task's.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.llm.shared import materialize, slices

#: Branches below the first importance go, below the second if their name has a word for what is no article; pages of a
#: host that a branch must be on; share of a node's own presentation that each presentation style leaves to its children.
LOW, LOW_NAMED, FEWEST, GAMMA = 0.3, 0.6, 8, 0.9
#: Elements nested deeper than browsers nest them belong to the branch at this depth.
DEPTH = 512
#: Largest table of branches that is broadcast; a larger one is joined by host and branch.
BROADCAST_BYTES = 8 << 20

# HTML elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
GONE = frozenset("aside button canvas datalist dialog embed footer form head iframe input map menu nav noscript object script select style svg template textarea title".split())
LANDMARKS = frozenset(("article", "main"))
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
# Words in class, id and role that name what is not the article.
HINTS = frozenset("ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted related respond search share sharing sidebar signup skip social sponsor sponsored subscribe teaser teasers toolbar widget widgets".split())
OUTER_HINTS = frozenset(("header",))
#: Hints that also count at the start or end of a longer word.
STEMS = ("advert", "breadcrumb", "cookie", "disqus", "footer", "masthead", "navbar", "newsletter", "sidebar", "sponsor")
# Words that say of what kind or where an element is, and words that tell a state of what it holds.
GENERIC = frozenset("a an and area article articles author bar big block body bottom box btn button by caption card cards center col column container content controls count cta desktop div element fixed flex float floating for form global grid group head header heading holder hover icon icons image inline inner input item items js label large layer left level link links list main mini mobile module more my news of on outer overlay page panel placeholder post posts primary read region right row secondary section site slot small space sticky stories story tab text the title to toggle top unit view wrap wrapper".split())
STATES = frozenset("active closed collapsed disabled enabled has hidden is layout no not off open opened show with without".split())
_FIRM = re.compile("comment|disqus|promo|related|respond|teaser")
_PARTS, _DIGITS, _CAMEL = re.compile(r"[^a-z0-9]+"), re.compile(r"\d+"), re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def _hint(word: str) -> bool:
    return word in HINTS or word.startswith(STEMS) or word.endswith(STEMS)


def named(names: str, outside: bool = False) -> int:
    """How surely class and id say that an element is not the article: 2, a name has nothing but such words; 1, it has one
    beside others; 0, none has, or only as a state (has-sidebar). outside: a header counts too."""
    most = 0
    for name in names.split():
        words = [w for w in _PARTS.split(_CAMEL.sub("-", name).lower()) if w]
        hints = [w for w in words if _hint(w) or outside and w in OUTER_HINTS]
        if hints and not STATES.intersection(words):
            rest = [w for w in words if w not in hints and w not in GENERIC and len(w) > 1 and not w.isdigit()]
            # a word that hints only in front of what it describes: related work, search results
            most = max(most, 1 if any(len(w) > 2 for w in rest) else 2)
    return most


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode()) - (1 << 63)


class _Page(HTMLParser):
    """One page. blocks: [text, chain of branch numbers from the root, names it is in, landmarks it is in, plain in one];
    styles: the children of each branch, in order. Elements that are never the article are left out as they are met."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple] = []  # (tag, state before it)
        self.chain, self.path, self.names, self.inside, self.plain, self.gone = (), "", (), (), False, False
        self.blocks: list[list] = []
        self.styles: dict[int, list[str]] = {}
        self.sure: list[int] = []  # by name: how sure it is
        self.holds: list[bool] = []  # by name: whether main is in it
        self.firm: list[bool] = []  # by name: whether it is an article's own, or names readers' words or other articles
        self.marks: list[str] = []
        self.text: list[str] = []
        self.feed(html)
        self.close()
        self.flush()

    def _state(self) -> tuple:
        return self.chain, self.path, self.names, self.inside, self.plain, self.gone

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.blocks.append([text, self.chain, self.names, self.inside, self.plain])

    def _pop(self, to: int) -> None:
        if any(x[0] in BLOCK or x[0] in GONE for x in self.open[to:]):
            self.flush()
        self.chain, self.path, self.names, self.inside, self.plain, self.gone = self.open[to][1]
        del self.open[to:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.text.append(" ")
        if tag in BLOCK:
            closed = CLOSES.get(tag, set()) | {"p"}
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] in closed:
                    self._pop(k)
                    break
                if self.open[k][0] in BLOCK and self.open[k][0] not in ("p",):
                    break
        if tag in BLOCK or tag in GONE:
            self.flush()
        if tag in VOID:
            return
        own = {k: v or "" for k, v in attrs if k in ("class", "id", "role", "hidden", "style", "aria-hidden")} if attrs else {}
        names, role = f"{own.get('class', '')} {own.get('id', '')}", own.get("role", "").lower()
        self.open.append((tag, self._state()))
        hidden = "hidden" in own or own.get("aria-hidden", "").lower() == "true" or "display:none" in own.get("style", "").lower().replace(" ", "")
        outside = not self.inside
        sure = 0 if tag in ("html", "body", "main") or role == "main" else max(named(names, outside), 2 * (role in HINTS))
        if tag in GONE or hidden and tag not in ("html", "body") or tag == "header" and outside:
            self.gone = True
        elif sure:
            if tag not in BLOCK:
                self.gone = self.gone or sure == 2
            else:
                self.names = (*self.names, len(self.sure))
                self.sure.append(sure)
                self.holds.append(False)
                self.firm.append(tag == "article" or role == "article" or bool(_FIRM.search(names.lower())))
        if tag in BLOCK and not self.gone:
            if len(self.chain) < DEPTH:
                step = tag + "".join(f".{x}" for x in sorted(_DIGITS.sub("0", names.lower()).split()))
                if self.chain:
                    self.styles.setdefault(self.chain[-1], []).append(step)
                self.path = f"{self.chain[-1] if self.chain else ''}/{step}"
                self.chain = (*self.chain, _hash(self.path))
                self.styles.setdefault(self.chain[-1], [])
            self.plain = tag in PLAIN and self.plain
            if tag in LANDMARKS or role in LANDMARKS:
                self.inside, self.plain = (*self.inside, len(self.marks)), True
                kind = "main" if tag == "main" or role == "main" else "article"
                self.marks.append(kind)
                if kind == "main":
                    for k in self.names:
                        self.holds[k] = True

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if self.open and self.open[-1][0] == tag and tag in ("svg", "math", "iframe", "script"):
            self._pop(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self._pop(k)
                return
            if tag not in BLOCK and self.open[k][0] in BLOCK:
                return  # an inline end tag closes nothing outside its block

    def handle_data(self, data: str) -> None:
        if not self.gone:
            self.text.append(data)

    def candidates(self) -> list[tuple[str, tuple, int]]:
        """(text, chain, weight) of the blocks of the article as names and landmarks tell it, in page order; weight 0: stays
        whatever the tree says, 1: goes if its branch is low, 2: a name speaks against it."""
        size = lambda blocks: sum(len(b[0]) for b in blocks)
        void = {k for k, holds in enumerate(self.holds) if holds}
        strong = lambda b: [k for k in b[2] if self.sure[k] == 2 and k not in void]
        article = lambda b: any(self.marks[k] == "article" for k in b[3])
        while True:
            kept = [b for b in self.blocks if not strong(b)]
            held: dict[int, int] = defaultdict(int)  # text that stands or falls with one name, the outermost
            for b in self.blocks:
                out = strong(b)
                if out and (not kept or not any(map(article, kept)) and article(b) and len(out) == 1 and not self.firm[out[0]]):
                    held[out[0]] += len(b[0])
            worst = max(held, key=lambda k: held[k], default=None)
            if worst is None or held[worst] <= 5 * size(kept):
                break
            void.add(worst)
        within = [b for b in kept if article(b)]
        rest = [b for b in kept if b[3] and not article(b)]
        own = within if within and size(within) >= size(rest) else rest or kept
        return [(b[0], b[1], 0 if b[4] else 2 if any(self.sure[k] == 1 and k not in void for k in b[2]) else 1) for b in own]


def page_text(html: str) -> str:
    """The main text of one page by its names and landmarks alone: its articles, or its main part, or all of it; blocks in
    page order, joined by an empty line."""
    return "\n\n".join(b[0] for b in _Page(html).candidates())


def host_of(url):
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def parse(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, host, page, styles, leaves, blocks) of every row: a hash of the page's text, the style of each branch,
    the branches of all blocks with a hash of their text, and the candidate blocks of the article."""
    kind = pages.schema[id_col].dataType.simpleString()
    styles_t = pa.list_(pa.struct([("node", pa.int64()), ("style", pa.int64())]))
    leaves_t = pa.list_(pa.struct([("chain", pa.list_(pa.int64())), ("value", pa.int64())]))
    blocks_t = pa.list_(pa.struct([("text", pa.string()), ("chain", pa.list_(pa.int64())), ("weight", pa.int32())]))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                hashes, styles, leaves, blocks = [], [], [], []
                for html in part.column("html").to_pylist():
                    page = _Page(html or "")
                    hashes.append(_hash("\n".join(b[0] for b in page.blocks)))
                    styles.append([{"node": n, "style": _hash(" ".join(own))} for n, own in page.styles.items()])
                    leaves.append([{"chain": list(chain), "value": _hash(text)} for chain, text in dict.fromkeys((b[1], b[0]) for b in page.blocks)])
                    blocks.append([{"text": t, "chain": list(c), "weight": w} for t, c, w in page.candidates()])
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), part.column("host"), pa.array(hashes, pa.int64()), pa.array(styles, styles_t), pa.array(leaves, leaves_t), pa.array(blocks, blocks_t)], ["page_id", "url", "host", "page", "styles", "leaves", "blocks"])

    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    return own.mapInArrow(run, f"page_id {kind}, url string, host string, page bigint, styles array<struct<node:bigint,style:bigint>>, leaves array<struct<chain:array<bigint>,value:bigint>>, blocks array<struct<text:string,chain:array<bigint>,weight:int>>")


def style_tree(parsed: DataFrame) -> DataFrame:
    """parse() rows -> (host, node, pages, importance) of every branch of every host's tree. Pages of a host with the same
    blocks count once; pages without a host are in no tree. Importance is 1 for a branch on a single page; else it is made
    of the entropy of the branch's children sequences and that of the texts below it, as a share of the greatest possible."""
    once = parsed.where("host <> ''").groupBy("host", "page").agg(F.first("styles").alias("styles"), F.first("leaves").alias("leaves"))
    c = F.col("c")
    style = once.select("host", F.explode("styles").alias("s")).groupBy("host", "s.node", "s.style").agg(F.count("*").alias("c"))
    style = style.groupBy("host", "node").agg(F.sum(c).alias("pages"), F.sum(c * F.log(c)).alias("style_log"), F.count("*").alias("styles"))
    texts = once.select("host", F.explode("leaves").alias("x")).groupBy("host", F.col("x.chain").alias("chain"), F.col("x.value").alias("value")).agg(F.count("*").alias("c"))
    below = texts.groupBy("host", "chain").agg(F.sum(c * F.log(c)).alias("content_log"), F.sum(c).alias("contents"))
    below = below.select("host", F.explode("chain").alias("node"), "content_log", "contents").groupBy("host", "node").agg(F.sum("content_log").alias("content_log"), F.sum("contents").alias("contents"))
    m = F.log("pages")
    node = (m - F.col("style_log") / F.col("pages")) / m
    content = 1 - F.col("content_log") / F.col("contents") / m
    left = F.pow(F.lit(GAMMA), F.col("styles"))
    return style.join(below, ["host", "node"]).select("host", "node", "pages", F.when(F.col("pages") > 1, (1 - left) * node + left * content).otherwise(1.0).alias("importance"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_low) of every row, from its whole html; n_low counts the blocks that the tree took. A
    null or empty html, or one without a main text, gives the empty string; what would leave a page empty is set aside;
    repeated rows stay; pages without a host are judged by their elements alone; an empty table gives an empty result.
    Only the three named columns are read."""
    parsed = materialize(parse(pages, id_col, url_col, html_col).withColumn("row", F.monotonically_increasing_id()))
    low = materialize(style_tree(parsed).where((F.col("importance") < LOW_NAMED) & (F.col("pages") >= FEWEST)).select("host", "node", (F.col("importance") < LOW).alias("low")))
    sets = [F.collect_set(F.when(F.col("low"), F.col("node"))).alias("low"), F.collect_set("node").alias("doubtful")]
    n = low.count()
    if n * 32 <= BROADCAST_BYTES:
        joined = parsed.join(F.broadcast(low.groupBy("host").agg(*sets)), "host", "left")
    else:
        branches = parsed.select("row", "host", F.explode(F.array_distinct(F.flatten("blocks.chain"))).alias("node"))
        joined = parsed.join(branches.join(low, ["host", "node"]).groupBy("row").agg(*sets), "row", "left")
    none = F.array().cast("array<bigint>")
    hit = lambda b, among: F.arrays_overlap(b["chain"], F.coalesce(F.col(among), none))
    stays = F.filter("blocks", lambda b: (b["weight"] == 0) | ~hit(b, "low") & ((b["weight"] == 1) | ~hit(b, "doubtful")))
    left = joined.withColumn("stays", F.when(F.col("low").isNull(), F.col("blocks")).otherwise(stays)).withColumn("stays", F.when(F.size("stays") > 0, F.col("stays")).otherwise(F.col("blocks")))
    text = F.array_join("stays.text", "\n\n")
    return left.select("page_id", "url", text.alias("text"), F.length(text).cast("bigint").alias("n_chars"), (F.size("blocks") - F.size("stays")).alias("n_low"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")
