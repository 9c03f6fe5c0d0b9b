"""Operator 7: main text of pages by consensus host paths.

A page is read once into text blocks and the containers (body, article, div,
...) that hold them. Menus, footers, sidebars, forms, scripts and the like are
left out by element and role. A container's path generalises tags and classes
from the root (numbers become 0) and is kept as a running hash. Each page votes
for its containers by their share of its unlinked text (deeper ones and article
elements weigh more); votes are added per host in Spark, the path with the most
wins, and pages are read again with the winning path of their host. So a page
with little text of its own follows its host. A page without the winning path
uses its own best container.

Class names (ad, comments, notice, related, ...) are evidence, not a cut. An
element with such a name is a zone; its share of the unlinked text and of links
is added up per host and generalised path. A strong name (adverts, comments,
consent, menus, sidebars) is left out unless the zone holds at least half of its
pages' text and few links, so the main container of a host survives an unlucky
name; reader comments never do. A weak name (notice, related, social, ...) is
left out outside article and main, and inside them only if it is mostly links.
Names of content beside it (article-body, content, post, ...) lift a weak name.

Blocks are joined in page order by an empty line; inside a block character
references are decoded and white space becomes one space.

Work and memory grow in proportion to a page, however deep or unclosed its tags
are: open elements are found by position lists per tag, an inline end tag only
marks its element, and open links and articles are counters.

Cases: null or empty html gives an empty text; a page without tags is one block;
a null or odd url belongs to the host ""; unclosed and stray tags are repaired as
far as nesting goes; very long and very deep pages are read whole; ties between
paths go to the larger hash, by rounded votes, so the order of adding does not
decide; repeated rows are extracted alike (and vote each); empty table: no rows;
other columns are ignored.
"""
from __future__ import annotations

import html as _html
import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_DIGITS = re.compile(r"\d+")
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in
        ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("body article main section div td center details figure".split())
BLOCKS = CONTAINERS | frozenset(
    "html head p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr th caption blockquote pre hr "
    "address figcaption summary hgroup header footer nav aside form fieldset noscript template dialog".split())
SKIP = frozenset("head nav footer aside form script style noscript template iframe object svg math button select "
                 "textarea dialog menu canvas audio video fieldset".split())
_SKIP_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu "
                       "menubar toolbar".split())
_STRONG = re.compile(
    r"(?:^|[-_\s])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|cookies?|consent|gdpr|popup|modal|overlay|"
    r"comments?|commentlist|disqus|replies|respond|sidebar|side-?bar|menu|nav|navbar|navigation|breadcrumbs?|footer|"
    r"masthead|newsletter|subscribe|subscription|signup|login|pagination|pager|skip-?link)(?:$|[-_\s])", re.I)
_COMMENTS = re.compile(r"(?:^|[-_\s])(?:comments?|commentlist|disqus|replies|respond)(?:$|[-_\s])", re.I)
_WEAK = re.compile(
    r"(?:^|[-_\s])(?:promo(?:tion)?|banner|notices?|alert|share|sharing|social|related|recommended|toolbar|"
    r"widget)(?:$|[-_\s])", re.I)
_CONTENT = re.compile(r"(?:^|[-_\s])(?:article|content|post|entry|body|main|story|text|prose)(?:$|[-_\s])", re.I)
_HEADER_NAME = re.compile(r"(?:^|[-_\s])(?:site-?header|page-?header|header|topbar)(?:$|[-_\s])", re.I)
_HOLDS = 0.5                    # a zone of this share of the text is no boilerplate
_LINKS = 0.3                    # from this share of links on it is
# an open element of the first kind is closed by a start tag of the second, up to the third
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
           "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


_M = (1 << 61) - 1


def _step(h: int, key: str) -> int:
    """Running hash of a path."""
    return (h * 0x9E3779B1 + zlib.crc32(key.encode("utf-8", "surrogatepass")) + 1) % _M


class Zone:
    """An element named like boilerplate: what the page says about it."""
    __slots__ = ("path", "parent", "weak", "comments", "inside", "free", "linked")

    def __init__(self, path, parent, weak, comments, inside):
        self.path, self.parent, self.weak, self.comments, self.inside = path, parent, weak, comments, inside
        self.free = self.linked = 0


def left_out(weak: bool, comments: bool, inside: bool, free: float, linked: float, total: float) -> bool:
    """Whether a zone goes, from its unlinked and linked text and the unlinked
    text of its pages."""
    many_links = linked >= _LINKS * (free + linked)
    if comments:
        return True
    if weak and inside:
        return many_links and linked > 0
    return many_links or free < _HOLDS * total


class Page:
    """``blocks``: (container, text, unlinked characters, zone); ``keys``,
    ``hashes`` and ``parents`` per container; ``zones``."""

    def __init__(self, html: str):
        self.blocks: list[tuple[int, str, int, int]] = []
        self.keys, self.hashes, self.parents, self.tags, self.depth = [""], [0], [-1], [""], [0]
        self.zones: list[Zone] = []
        # open elements: [tag, container, zone, skipped, closed]
        self._stack: list[list] = []
        self._places: dict[str, list[int]] = {}             # of open elements, by tag
        self._blocks_open: list[int] = []                   # places of open block elements
        self._links = self._articles = 0
        self._buf: list[str] = []
        self._linked = 0
        self._read(html)
        for z in reversed(self.zones):                      # a zone's text is also that of its outer zone
            if z.parent >= 0:
                self.zones[z.parent].free += z.free
                self.zones[z.parent].linked += z.linked

    def _flush(self) -> None:
        if self._buf:
            text = " ".join("".join(self._buf).split())
            if text:
                zone = self._stack[-1][2] if self._stack else -1
                linked = min(self._linked, len(text))
                self.blocks.append((self._where, text, len(text) - linked, zone))
                if zone >= 0:
                    self.zones[zone].free += len(text) - linked
                    self.zones[zone].linked += linked
            self._buf = []
        self._linked = 0

    @property
    def _where(self) -> int:
        return self._stack[-1][1] if self._stack else 0

    def _count(self, tag: str, by: int) -> None:
        if tag == "a":
            self._links += by
        elif tag in ("article", "main"):
            self._articles += by

    def _push(self, tag: str, where: int, zone: int, skipped: bool) -> None:
        self._places.setdefault(tag, []).append(len(self._stack))
        if tag in BLOCKS:
            self._blocks_open.append(len(self._stack))
        self._stack.append([tag, where, zone, skipped, False])
        self._count(tag, 1)

    def _pop(self) -> None:
        tag, _, _, _, closed = self._stack.pop()
        if not closed:
            self._places[tag].pop()
            self._count(tag, -1)
        if tag in BLOCKS:
            self._blocks_open.pop()

    def _last(self, names) -> int:
        return max((self._places[t][-1] for t in names if self._places.get(t)), default=-1)

    def _close(self, names, stop=()) -> None:
        """Close the innermost open element of ``names`` unless one of ``stop`` is
        further in."""
        i = self._last(names)
        if i >= 0 and (not stop or i >= self._last(stop)):
            self._flush()
            while len(self._stack) > i:
                self._pop()

    def _end_inline(self, tag: str) -> None:
        i = self._last((tag,))
        if i < 0 or (self._blocks_open and self._blocks_open[-1] > i):
            return                                          # closes nothing outside its block
        self._stack[i][4] = True
        self._places[tag].pop()
        self._count(tag, -1)
        while self._stack and self._stack[-1][4]:
            self._pop()

    def _open(self, tag: str, attrs: str) -> None:
        where = self._where
        zone = self._stack[-1][2] if self._stack else -1
        skipped = bool(self._stack) and self._stack[-1][3]
        inside = self._articles > 0
        key, names = tag, ""
        if not skipped:
            skipped = tag in SKIP or (tag == "header" and not inside)
            if attrs and not skipped:
                got = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)}
                names = " ".join((got.get("class", ""), got.get("id", ""))).strip()
                skipped = got.get("role", "").lower() in _SKIP_ROLE and tag != "body"
                if tag in CONTAINERS:
                    key = ".".join([tag, *sorted({_DIGITS.sub("0", x) for x in got.get("class", "").split()})])
                    if got.get("id"):
                        key += "#" + _DIGITS.sub("0", got["id"])
        if not skipped and tag in CONTAINERS:
            self.keys.append(key)
            self.hashes.append(_step(self.hashes[where], key))
            self.parents.append(where)
            self.tags.append(tag)
            self.depth.append(self.depth[where] + 1)
            where = len(self.keys) - 1
        if names and not skipped and tag not in ("html", "body", "article", "main"):
            strong = bool(_STRONG.search(names)) or (not inside and bool(_HEADER_NAME.search(names)))
            weak = not strong and bool(_WEAK.search(names)) and not _CONTENT.search(names)
            if strong or weak:
                path = self.hashes[where] if tag in CONTAINERS else _step(self.hashes[where], f"{tag}.{names}")
                self.zones.append(Zone(path, zone, weak, bool(_COMMENTS.search(names)), inside))
                zone = len(self.zones) - 1
        self._push(tag, where, zone, skipped)

    def _read(self, html: str) -> None:
        at = 0
        while True:
            m = _MARKUP.search(html, at)
            text = html[at:m.start() if m else len(html)]
            if text and not (self._stack and self._stack[-1][3]):
                text = _html.unescape(text) if "&" in text else text
                self._buf.append(text)
                if self._links:
                    self._linked += len(text)
            if not m:
                break
            at = m.end()
            tag = (m.group(2) or "").lower()
            if not tag:                                     # comment, doctype: nothing, not even a space
                continue
            if tag == "br":
                self._buf.append(" ")
            elif m.group(1):
                if tag in VOID:
                    continue
                if tag in BLOCKS:
                    self._flush()
                    self._close((tag,))
                else:
                    self._end_inline(tag)
            else:
                if tag in BLOCKS:
                    self._flush()
                    self._close(("p",), CONTAINERS)
                if tag in _CLOSES:
                    self._close(*_CLOSES[tag])
                if tag in _RAW:
                    end = _RAW[tag].search(html, at)
                    at = end.start() if end else len(html)
                    if end:
                        close = html.find(">", at)
                        at = close + 1 if close >= 0 else len(html)
                    if tag == "xmp":
                        continue
                elif tag not in VOID and (not m.group(3).endswith("/") or tag in BLOCKS or tag in SKIP):
                    self._open(tag, m.group(3))             # a self-closed inline element holds nothing
        self._flush()

    def total(self) -> int:
        return sum(free for _, _, free, _ in self.blocks)

    def dropped(self, kept=None) -> list[bool]:
        """Per zone whether its text goes: by the host's consensus (``kept``, the
        paths of zones that stay) or else by this page alone."""
        total, out = self.total(), []
        for z in self.zones:
            own = (z.path not in kept if kept is not None
                   else left_out(z.weak, z.comments, z.inside, z.free, z.linked, total))
            out.append(own or (z.parent >= 0 and out[z.parent]))
        return out

    def votes(self) -> dict[int, float]:
        """Vote per path hash: share of unlinked text, plus depth and element bonus."""
        gone = self.dropped()
        mass = [0] * len(self.keys)
        for where, _, free, zone in self.blocks:
            if zone < 0 or not gone[zone]:
                mass[where] += free
        for i in range(len(mass) - 1, 0, -1):               # children come after parents
            mass[self.parents[i]] += mass[i]
        share: dict[int, list] = {}
        for i in range(1, len(mass)):
            if mass[i]:
                s = share.setdefault(self.hashes[i], [0, i])
                s[0] += mass[i]
        out = {}
        for path, (n, i) in share.items():
            part = min(1.0, n / mass[0])
            if part >= 0.5:
                out[path] = (part + 0.8 * self.depth[i] / (self.depth[i] + 6)
                             + (0.3 if self.tags[i] in ("article", "main") else 0.0))
        return out

    def text(self, path: int | None = None, kept=None) -> tuple[str, str]:
        """(text, path) of the blocks under the container of hash ``path``; of the
        page's own best where it has none."""
        gone = self.dropped(kept)
        for p in (path, None):
            if p is None:
                v = self.votes()
                p = max(v, key=lambda x: (round(v[x], 6), x)) if v else None
            own, first = self._under(p, gone)
            if own:
                break
        return "\n\n".join(own), self._name(first)

    def _under(self, path: int | None, gone) -> tuple[list[str], int]:
        inside = [path is None] * len(self.keys)
        first = 0
        for i in range(1, len(self.keys)):                  # parents come before children
            inside[i] = inside[self.parents[i]] or self.hashes[i] == path
            first = first or (i if self.hashes[i] == path else 0)
        return [t for where, t, _, z in self.blocks if inside[where] and (z < 0 or not gone[z])], first

    def _name(self, i: int) -> str:
        out = []
        while i > 0:
            out.append(">" + self.keys[i])
            i = self.parents[i]
        return "".join(reversed(out))


def host_of(url_col: str):
    """Lower-case host of a url column, "" where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(
        url_col, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, kept): the winning container of each host (hash) and the
    zones that stay (hashes, mostly none)."""
    import pyarrow as pa
    names = ["host", "path", "vote", "weak", "comments", "inside", "free", "linked", "total"]

    def run(batches):
        for batch in batches:
            rows = []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                page = Page(html or "")
                rows += [(host, p, v, None, None, None, 0, 0, 0) for p, v in page.votes().items()]
                total = page.total()
                rows += [(host, z.path, None, z.weak, z.comments, z.inside, z.free, z.linked, total)
                         for z in page.zones]
            cols = list(zip(*rows)) if rows else [()] * 9
            kinds = [pa.string(), pa.int64(), pa.float64(), *[pa.bool_()] * 3, *[pa.int64()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)
    got = pages.select(host_of(url_col).alias("host"), F.col(html_col).alias("html")).mapInArrow(
        run, "host string, path long, vote double, weak boolean, comments boolean, inside boolean, "
             "free long, linked long, total long")
    # one row a host and path; rounded sums: the order of adding does not decide a tie
    sums = got.groupBy("host", "path").agg(
        F.round(F.sum("vote"), 6).alias("votes"), F.max("weak").alias("weak"), F.max("comments").alias("comments"),
        F.max("inside").alias("inside"), F.sum("free").alias("free"), F.sum("linked").alias("linked"),
        F.sum("total").alias("total"))
    many = F.col("linked") >= _LINKS * (F.col("free") + F.col("linked"))
    gone = F.when(F.col("comments"), True).when(F.col("weak") & F.col("inside"), many & (F.col("linked") > 0)).otherwise(
        many | (F.col("free") < _HOLDS * F.col("total")))
    return sums.groupBy("host").agg(
        F.max_by("path", F.when(F.col("votes").isNotNull(), F.struct("votes", "path"))).alias("path"),
        F.collect_list(F.when(F.col("weak").isNotNull() & ~gone, F.col("path"))).alias("kept"))


SALTS = 16


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
              html_col: str = "html") -> DataFrame:
    """page_id, url, text, path (of the container the text is from)."""
    import pyarrow as pa
    win = cut_lineage(host_paths(pages, url_col, html_col), "html-paths")
    d = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
                     host_of(url_col).alias("host"))
    size = win.agg(F.sum(F.length("host") + 8 * F.size("kept") + 48)).first()[0] or 0
    if size <= 32 << 20:
        d = d.join(F.broadcast(win), "host", "left")
    else:                                                   # a host with many pages is split
        salted = win.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        d = (d.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
             .join(salted, ["host", "salt"], "left"))

    def run(batches):
        for batch in batches:
            html, path, kept = (batch.column(c).to_pylist() for c in ("html", "path", "kept"))
            got = [Page(h or "").text(p, frozenset(k or ())) for h, p, k in zip(html, path, kept)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array([t for t, _ in got], pa.string()),
                 pa.array([p for _, p in got], pa.string())], names=["page_id", "url", "text", "path"])
    kind = d.schema["page_id"].dataType.simpleString()
    return d.select("page_id", "url", "html", "path", "kept").mapInArrow(
        run, f"page_id {kind}, url string, text string, path string")


def query(spark, sf_dir):
    from .common import prepare, table
    prepare(spark)
    return main_text(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "path")
