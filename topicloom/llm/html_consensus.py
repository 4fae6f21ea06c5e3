"""Main text by consensus host paths.

Each page's containers are scored: running text counts, link text counts against. A container is named by its generalised path, the tags and
classes from the root with digits left out, and handled by the hash of it. From its best path a page climbs while the containers around add running text and hardly
any link text, so that an article of several parts is taken whole. The pages of a host vote with their scores, Spark adds the votes up, and each page
is extracted again from the container at its host's winning path, or from its own best one if it has none there.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from .textbytes import pieces

# HTML element kinds and the class words of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset(
    "head title script style noscript template nav header footer aside button select textarea iframe object svg canvas menu dialog".split()
)
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
BLOCKS = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre "
    "section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article body div main section td".split())
CLOSES = {"p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th", "tr"]),
          "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "option": frozenset(["option"])}
FURNITURE = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer footer header menu modal nav navbar "
    "navigation newsletter notice pagination popup promo promoted recommended related reply replies share sharing sidebar social sponsor sponsored "
    "subscribe toolbar widget".split()
)
# A class name that has one of these besides a furniture word speaks of the page's layout or of an article's own heading.
LAYOUT = frozenset("with without no not has is open closed enabled disabled on off article entry post story".split())
FURNITURE_ROLES = frozenset("alert banner complementary contentinfo dialog menu menubar navigation search".split())
LINKED_PART = 10  # an enclosing container may add one character of link text for so many of running text
SPACE = re.compile(r"\s+")
WORD = re.compile("[a-z]+")
DIGITS = re.compile(r"\d+")
ATTRIBUTES = frozenset(["class", "id", "role", "hidden", "aria-hidden"])
NO_VALUES: dict[str, str] = {}
DEEPEST_OPEN = 64  # open elements looked at for one whose end tag is left out


def is_furniture(names: str) -> bool:
    """Whether one of the names of a class or id attribute is that of page furniture: `ad-banner` is, `with-sidebar` and `entry-header` are not."""
    for name in names.split():
        words = set(WORD.findall(name))
        if not FURNITURE.isdisjoint(words) and LAYOUT.isdisjoint(words):
            return True
    return False


KNOWN: dict[str, tuple[bool, str]] = {}  # names seen before, as pages of a site share theirs; emptied at MOST_KNOWN
MOST_KNOWN = 1 << 14


def names_of(names: str) -> tuple[bool, str]:
    """Whether a class or id attribute is that of furniture, and its names as a part of a path, without digits."""
    found = KNOWN.get(names)
    if found is None:
        classes = ".".join(sorted({DIGITS.sub("#", c) for c in names.split()}))
        found = is_furniture(names), f".{classes}" if classes else ""
        if len(KNOWN) >= MOST_KNOWN:
            KNOWN.clear()
        KNOWN[names] = found
    return found


class Page(HTMLParser):
    """One reading of a page: the text blocks outside page furniture, each with the innermost container that is open around it.

    Forms are furniture unless the page stands in one: if a form holds more running text than all that is outside forms, forms count as
    plain elements. Memory and time grow with the page, however deep its elements are nested.
    """

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool, int, bool, int]] = []  # tag, path, skipped, innermost container or -1, in a form, element
        self.elements: list[tuple[int, str]] = []  # the element around each element, and its name in paths
        self.open: Counter[str] = Counter()
        self.paths: list[int] = []  # hash of the path of each container
        self.places: list[int] = []  # element of each container
        self.parents: list[int] = []  # the container around each container
        self.blocks: list[str] = []
        self.inner: list[int] = []  # container of each block
        self.in_form: list[bool] = []
        self.links: list[int] = []  # characters of each block that are link text
        self.parts: list[str] = []
        self.linked = self.in_link = 0
        comment = html.rfind("<!--")
        if comment >= 0 and html.find("-->", comment) < 0:  # one that never ends hides the rest
            html = html[:comment]
        self.feed(html)
        self.close()
        self.end_block()
        outside = sum(len(b) - n for b, n, f in zip(self.blocks, self.links, self.in_form) if not f)
        inside = sum(len(b) - n for b, n, f in zip(self.blocks, self.links, self.in_form) if f)
        kept = [i for i, f in enumerate(self.in_form) if not f or inside > outside]
        self.blocks, self.links, self.inner = ([x[i] for i in kept] for x in (self.blocks, self.links, self.inner))

    def updatepos(self, i: int, j: int) -> int:
        """Nobody asks for line numbers."""
        return j

    def end_block(self) -> None:
        if not self.parts:
            return
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.blocks.append(text)
            self.links.append(min(self.linked, len(text)))
            self.inner.append(self.stack[-1][3] if self.stack else -1)
            self.in_form.append(bool(self.stack) and self.stack[-1][4])
        self.parts, self.linked = [], 0

    def close_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag = self.stack[-1][0]
            self.in_link -= tag == "a"
            if tag in BLOCKS or tag == "form":
                self.end_block()
            self.open[tag] -= 1
            self.stack.pop()

    def end_head(self, tag: str) -> None:
        """Close a head whose end tag is left out, as `tag` (empty for text) may not stand in it."""
        if self.open["head"] and (tag == "body" or (self.stack[-1][0] == "head" and tag not in IN_HEAD)):
            for depth, above in enumerate(self.stack):
                if above[0] == "head":
                    self.close_to(depth)
                    return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.end_head(tag)
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            elif tag == "hr":
                self.end_block()
            return
        for depth in range(len(self.stack) - 1, max(len(self.stack) - 1 - DEEPEST_OPEN, -1), -1):
            open_tag = self.stack[depth][0]
            if tag in CLOSES.get(open_tag, ()):
                self.close_to(depth)
                break
            if open_tag in CONTAINERS or open_tag in ("ul", "ol", "dl", "table", "select"):
                break
        if tag in BLOCKS or tag == "form":
            self.end_block()
        values = {k: (v or "").lower() for k, v in attrs if k in ATTRIBUTES} if attrs else NO_VALUES
        furniture, classes = names_of(values["class"]) if "class" in values else (False, "")
        above = self.stack[-1] if self.stack else ("", 0, False, -1, False, -1)
        skipped = above[2] or (tag in SKIPPED and not (tag == "header" and (self.open["article"] or self.open["main"])))
        if not skipped and tag not in ("html", "body", "article", "main"):
            skipped = furniture or ("id" in values and names_of(values["id"])[0])
        if values and not skipped:
            skipped = values.get("role") in FURNITURE_ROLES or "hidden" in values or values.get("aria-hidden") == "true"
        label = f"/{tag}{classes}"
        path = xxhash.xxh64_intdigest(label, seed=above[1])
        container = above[3]
        self.elements.append((above[5], label))
        if tag in CONTAINERS and not skipped:
            container = len(self.paths)
            self.paths.append(path - (1 << 63))
            self.places.append(len(self.elements) - 1)
            self.parents.append(above[3])
        self.in_link += tag == "a"
        self.open[tag] += 1
        in_form = above[4] or tag == "form" or values.get("role") == "form"
        self.stack.append((tag, path, skipped, container, in_form, len(self.elements) - 1))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if not self.open[tag]:
            return
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth][0] == tag:
                self.close_to(depth)
                return

    def handle_data(self, data: str) -> None:
        if not data.isspace():
            self.end_head("")
        if self.stack and self.stack[-1][2]:
            return
        self.parts.append(data)
        if self.in_link:
            self.linked += len(data)

    def scores(self) -> list[float]:
        """For each container: running text, less the share that lies far from it, less link text."""
        out = [0.0] * len(self.paths)
        for text, links, container in zip(self.blocks, self.links, self.inner):
            if container >= 0:
                out[container] += len(text) - 3 * links + 10 * sum(text.count(x) for x in ".,;!?")
        for container in range(len(out) - 1, -1, -1):  # inner ones come later
            if self.parents[container] >= 0:
                out[self.parents[container]] += out[container] / 2
        return out

    def path_scores(self) -> dict[int, float]:
        """Score of each path, where the outermost path that the best one climbs to has the best one's score besides."""
        out: dict[int, float] = {}
        for path, score in zip(self.paths, self.scores()):
            out[path] = out.get(path, 0.0) + score
        best = max(out, key=lambda p: (out[p], p), default=None)
        if best is not None and out[best] > 0:
            top = self.climbed(best)
            if top != best:
                out[top] = max(out[top], 0.0) + out[best]
        return out

    def climbed(self, path: int) -> int:
        """The outermost path above `path` to which each step adds running text with a tenth of link text at most; steps that add nothing are passed."""
        covered = self.covered()
        inner, (running, linked) = path, covered[path]
        outer = self.parents[self.paths.index(path)]
        while outer >= 0:
            more, more_linked = covered[self.paths[outer]]
            if (more_linked - linked) * LINKED_PART > more - running:
                break
            if more > running:
                inner, running, linked = self.paths[outer], more, more_linked
            outer = self.parents[outer]
        return inner

    def covered(self) -> dict[int, tuple[int, int]]:
        """Characters of running text and of link text in the containers at each path."""
        running, linked = [0] * len(self.paths), [0] * len(self.paths)
        for text, links, container in zip(self.blocks, self.links, self.inner):
            if container >= 0:
                running[container] += len(text) - links
                linked[container] += links
        out: dict[int, tuple[int, int]] = {}
        for container in range(len(running) - 1, -1, -1):
            if self.parents[container] >= 0:
                running[self.parents[container]] += running[container]
                linked[self.parents[container]] += linked[container]
            r, n = out.get(self.paths[container], (0, 0))
            out[self.paths[container]] = r + running[container], n + linked[container]
        return out

    def within(self, path: int | None) -> list[bool]:
        """For each container whether it is at `path` or inside one that is."""
        out: list[bool] = []
        for own, parent in zip(self.paths, self.parents):
            out.append(own == path or (parent >= 0 and out[parent]))
        return out

    def path_text(self, path: int) -> str:
        """A path as text, from the root."""
        element, labels = self.places[self.paths.index(path)], []
        while element >= 0:
            element, label = self.elements[element]
            labels.append(label)
        return "".join(reversed(labels))

    def text(self, path: int | None) -> tuple[str, str | None]:
        """Text of the containers at `path`, else of the best container, else of all blocks; and the path used, by its containers."""
        chosen = self.within(path)
        if not any(c >= 0 and chosen[c] for c in self.inner):
            scores = self.path_scores()
            path = max(scores, key=lambda p: (scores[p], p), default=None)
            if path is None or scores[path] <= 0:
                return "\n".join(self.blocks), None
            chosen = self.within(path)
        return "\n".join(b for b, c in zip(self.blocks, self.inner) if c >= 0 and chosen[c]), self.path_text(path)


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def main_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """id, url, host, path, text, n_chars: one row per row of `pages`.

    Blocks are joined by one \\n, white space inside a block is one blank, character references are decoded. Null and empty html give
    an empty text without votes. Pages whose url is null or has no host form one host with an empty name. Of equally voted paths
    the one with the greater hash wins. `path` names the containers from the root; null where the page has none. Repeated rows vote as often as they occur. Other columns are not read.
    """
    source = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"))
    source = source.withColumn("host", host_of(F.col("url")))

    def vote(batches):
        for batch in batches:
            for piece in pieces(batch, "html"):
                hosts, paths, scores = [], [], []
                for host, html in zip(piece.column("host").to_pylist(), piece.column("html").to_pylist()):
                    for path, score in Page(html or "").path_scores().items():
                        if score > 0:
                            hosts.append(host)
                            paths.append(path)
                            scores.append(round(score))
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.int64()), pa.array(scores, pa.int64())], ["host", "path", "score"])

    votes = source.select("host", "html").mapInArrow(vote, "host string, path long, score long")
    votes = votes.groupBy("host", "path").agg(F.sum("score").alias("score"))
    winners = materialize(votes.groupBy("host").agg(F.max(F.struct("score", "path")).alias("won")).select("host", "won.path"), "paths")
    id_type, url_type = dict(source.dtypes)["id"], dict(source.dtypes)["url"]

    def extract(batches):
        for batch in batches:
            for piece in pieces(batch, "html"):
                found = [Page(h or "").text(p) for h, p in zip(piece.column("html").to_pylist(), piece.column("path").to_pylist())]
                texts = [t for t, _ in found]
                columns = [piece.column("id"), piece.column("url"), piece.column("host"), pa.array([p for _, p in found], pa.string()), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "host", "path", "text", "n_chars"])

    joined = source.join(winners, "host", "left").select("id", "url", "host", "html", "path")
    schema = f"id {id_type}, url {url_type}, host string, path string, text string, n_chars long"
    return joined.mapInArrow(extract, schema).withColumnsRenamed({"id": id_column, "url": url_column})
