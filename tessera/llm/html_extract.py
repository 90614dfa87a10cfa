"""Main text of web pages by consensus host paths.

Every page's containers are scored by the text of their blocks, less their links; each page votes for the path of its
best container, generalised to tags and classes with digits masked. The votes are counted per host in Spark, and all
pages of a host are read again with its winning path; a page without such a container keeps its own best one. Blocks
inside menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comment sections are left out:
by element, role, or a class or id that names such a part, as a whole word or in a usual compound ("site-header", but not
"entry-header" or "side-by-side"). An article's own headings are its text; a header element is not.

The best container is the innermost article or main element that holds most of the text; on pages without one, the
innermost container outside of which no prose to speak of is left.

Character references are decoded, white space inside a block becomes one space, blocks are joined in page order by one
space. Null and empty pages give an empty text; a null url is a host of its own, as are urls without a host. Repeated
rows vote and are extracted each. Ties of votes go to the path that sorts first. Other columns are ignored, whatever
their names; an empty table gives none. Pages are read whole, one at a time, however long or deep.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import cut

#: Characters from which on a block is taken for prose; the share of the prose that may stay outside of the best container.
PROSE, OUTSIDE = 100, 0.05
#: So many hosts are joined by broadcast; more are joined by a shuffle.
FEW_HOSTS = 20_000

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)>|<[!?][^>]*+>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
SPACES = re.compile(r"\s+")
# Elements of HTML by their part in a page.
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = set("article body div main section td".split())
LEFT_OUT = set("aside button canvas datalist dialog footer form head header iframe input menu nav noscript select svg template textarea title".split())
RAW = {"script": re.compile(r"</script[\s/>]", re.I), "style": re.compile(r"</style[\s/>]", re.I), "textarea": re.compile(r"</textarea[\s/>]", re.I), "title": re.compile(r"</title[\s/>]", re.I)}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an opening tag ends, and where the search for them stops.
ENDS_OPEN = {"li": ({"li"}, {"ul", "ol"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
# Class and id words that name parts outside of the article, whole and in compounds.
NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert alerts warning sidebar side menu navbar nav navigation "
    "breadcrumb breadcrumbs masthead footer header comment comments commentlist disqus replies reply respond share sharing social related recommended popup modal overlay newsletter subscribe signup "
    "login search toolbar widget pagination pager skip".split()
)
COMPOUNDS = re.compile(
    r"(?:^|[_-])(?:advert\w*|sponsored|cookies?|consent|gdpr|sidebar|navbar|nav|navigation|breadcrumbs?|footer|commentlist|disqus|newsletter|popup|modal)(?:$|[_-]|\d)"
    r"|^(?:comments?|widget|menu|social|pagination|skip)[_-]|[_-](?:comments|menu|widget|pagination)$"
    r"|(?:^|[_-])ads?[_-]?(?:slot|banner|box|unit|container|wrapper|block|space|top|bottom|left|right|\d+)(?:$|[_-])|[_-]ads?$"
    r"|^(?:site|page|main|top|global)[_-](?:header|banner|notice)|^(?:privacy|legal|copyright)[_-]notice|^side[_-](?:bar|nav|column|panel)"
    r"|^(?:share|sharing)[_-](?:bar|box|button|icon|link|tool|this)|^(?:related|recommended)[_-](?:article|content|item|link|post|storie|story|read)"
    r"|^(?:search|login|signup|subscribe|reply)[_-](?:form|box|bar|field|button|modal)"
)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}


@lru_cache(1 << 14)
def left_out_name(names: str) -> bool:
    """Whether a class or id attribute names a part outside of the article."""
    return any(re.sub(r"\d+$", "", x).strip("_-") in NAMES or COMPOUNDS.search(x) for x in names.lower().split())


class Page:
    """blocks: (text, its characters in links, the innermost container around it or -1, whether it is left out)."""

    def __init__(self, html: str):
        self.blocks: list[tuple[str, int, int, bool]] = []
        # Of containers, in page order: label, the container around (or -1), number of containers around, hash of the path.
        self.labels: list[str] = []
        self.above: list[int] = []
        self.depth: list[int] = []
        self.paths: list[int] = []
        # Open elements: tag, container number or -1, left out (here or above).
        stack: list[tuple[str, int, bool]] = []
        around = -1
        out, links, text, in_links, at = False, 0, [], 0, 0

        def flush() -> None:
            nonlocal text, in_links
            if text:
                if whole := SPACES.sub(" ", "".join(text)).strip():
                    self.blocks.append((whole, in_links, around, out))
                text = []
            in_links = 0

        def add(s: str) -> None:
            nonlocal in_links
            if s:
                s = unescape(s)
                text.append(s)
                if links:
                    in_links += len(s)

        def close(to: int) -> None:
            nonlocal around, out, links
            flush()
            for tag, container, _ in stack[to:]:
                if container >= 0 and around >= container:
                    around = self.above[container]
                if tag == "a":
                    links -= 1
            del stack[to:]
            out = stack[-1][2] if stack else False

        while m := TOKEN.search(html, at):
            add(html[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        if any(x[0] in BLOCKS or x[2] != out or x[1] >= 0 for x in stack[k:]) or (k and stack[k - 1][2] != out):
                            close(k)
                        else:
                            links -= sum(x[0] == "a" for x in stack[k:])
                            del stack[k:]
                        break
                    if tag not in BLOCKS and stack[k][0] in BLOCKS:
                        break  # an inline end tag without its start
                if tag == "p":
                    flush()
                continue
            if tag in RAW:
                end = RAW[tag].search(html, at)
                at = end.start() if end else len(html)
                stop = html.find(">", at)
                at = stop + 1 if stop >= 0 and end else len(html)
                continue
            if tag == "br":
                text.append("\n")
                continue
            if tag in BLOCKS:
                flush()
                if stack and tag in ENDS_OPEN:
                    ended, stop = ENDS_OPEN[tag]
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] in stop:
                            break
                        if stack[k][0] in ended:
                            close(k)
                            break
                elif tag not in ("body", "html"):
                    # A paragraph ends at the next block.
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] in BLOCKS:
                            if stack[k][0] == "p":
                                close(k)
                            break
            if tag in VOID:
                continue
            attributes = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in ATTRIBUTE.finditer(m[3])} if m[3] and not m[3].isspace() else {}
            hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "")
            named = tag not in ("html", "body", "article", "main") and any(left_out_name(attributes[x]) for x in ("class", "id") if x in attributes)
            left_out = out or tag in LEFT_OUT or hidden or named or attributes.get("role") in ROLES
            if left_out != out:
                flush()
            if m[3].endswith("/") and tag not in BLOCKS:
                continue
            container = -1
            if tag in CONTAINERS:
                classes = ".".join(sorted(set(re.sub(r"\d+", "#", attributes.get("class", "")).replace("/", "|").split())))
                container = len(self.labels)
                self.labels.append(f"{tag}.{classes}" if classes else tag)
                self.above.append(around)
                self.depth.append(self.depth[around] + 1 if around >= 0 else 0)
                self.paths.append(hash((self.paths[around] if around >= 0 else 0, self.labels[-1])))
                around = container
            stack.append((tag, container, left_out))
            out = left_out
            if tag == "a":
                links += 1
        rest = html[at:]
        add(rest if "<" not in rest else rest[: rest.index("<")] if re.match(r"[^<]*<[/a-zA-Z!?]", rest) else rest)
        flush()

    def path(self, container: int) -> str:
        labels = []
        while container >= 0:
            labels.append(self.labels[container])
            container = self.above[container]
        return "".join(f"/{x}" for x in reversed(labels))

    def best(self) -> int:
        """The best container; -1 without any."""
        prose = any(len(text) >= PROSE and not out for text, _, _, out in self.blocks)
        gain, every = [0.0] * len(self.labels), 0.0
        for text, links, container, out in self.blocks:
            if not out:
                worth = max(0, len(text) - 2 * links) / (10 if prose and len(text) < PROSE else 1)
                every += worth
                if container >= 0:
                    gain[container] += worth
        for c in range(len(gain) - 1, -1, -1):
            if self.above[c] >= 0:
                gain[self.above[c]] += gain[c]
        if not every:
            return -1
        tags = [x.partition(".")[0] for x in self.labels]
        full = [c for c, x in enumerate(gain) if x >= 0.6 * every and tags[c] in ("article", "main")]
        pick = full or [c for c, x in enumerate(gain) if x and tags[c] == "article"] or [c for c, x in enumerate(gain) if x >= (1 - OUTSIDE) * every]
        return max(pick, key=lambda c: (self.depth[c] if pick is not full or tags[c] == "article" else -1, gain[c]), default=-1)

    def text(self, path: str | None) -> str:
        """The text inside the containers of a path; of the page's best container and those alike, if there is none here."""
        wanted = 0
        for label in (path or "").split("/")[1:]:
            wanted = hash((wanted, label))
        if not path or wanted not in self.paths:
            best = self.best()
            if best < 0:
                return " ".join(t for t, _, _, out in self.blocks if not out)
            wanted = self.paths[best]
        inside = []
        for c, p in enumerate(self.paths):
            inside.append(p == wanted or (self.above[c] >= 0 and inside[self.above[c]]))
        return " ".join(t for t, _, c, out in self.blocks if not out and c >= 0 and inside[c])


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#\s]*)", 1), F.lit("")))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        votes: Counter[tuple[str, str]] = Counter()
        for h, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if html.is_valid and (best := (page := Page(html.as_py())).best()) >= 0:
                votes[h, page.path(best)] += 1
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in votes], pa.string()), pa.array([p for _, p in votes], pa.string()), pa.array(list(votes.values()), pa.int64())], ["host", "path", "votes"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [Page(html.as_py()).text(path) if html.is_valid else "" for path, html in zip(batch.column(3).to_pylist(), batch.column(2), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path, votes: the winning path of each host."""
    votes = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(_votes, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    return votes.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), "path")).alias("path"), F.max("votes").alias("votes"))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages."""
    paths = cut(host_paths(pages)).select(F.col("host").alias("of"), "path")
    if paths.count() <= FEW_HOSTS:
        paths = F.broadcast(paths)
    joined = pages.select("page_id", "url", "html", host(F.col("url")).alias("host")).join(paths, F.col("host") == F.col("of"), "left")
    schema = "page_id {}, url {}, text string".format(*(pages.schema[c].dataType.simpleString() for c in ("page_id", "url")))
    texts = joined.select("page_id", "url", "html", "path").mapInArrow(_extracted, schema)
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
