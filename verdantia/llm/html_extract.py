"""Main text of web pages by consensus host paths (operator 8).

Each page is read, in one pass without backtracking, into containers and text blocks; chrome (menus, headers, footers, side
bars, notices, adverts, forms, comments, hidden parts) is left out. A container's path is a hash of its parent's path and
of its own tag, classes and ids (digits become #). The container with the most text outside links, the parent of a
container counting half, gets the page's vote for its path. Spark counts the votes of every host, and each page is
extracted again at its host's winning path; a page without text there uses its own container.

Tags and words such as "comments" mark chrome for certain. Words that articles use too ("social", "related", "search")
only raise a doubt, which the host's pages settle together: such a path is kept, however short its texts, where they mostly
differ from page to page and are no list of links. Rows of equal address and plain text count as one page there, so repeated
rows don't make a passage look like chrome; what several addresses of a host repeat does.

Null or empty html gives an empty text; a null url is a host of its own; an unclosed tag or comment runs to the end of its
parent or page; equal votes go to the higher score, then the smaller path; repeated rows are extracted row by row; very
long or deeply nested pages take time and memory in proportion to their length; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, short_batches

#: Hosts whose winners are broadcast at most (about 100 bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 100_000
#: Characters outside links from which a doubtful container counts in its own page's vote.
PROSE = 200
# Tags by what they do, and words of classes, ids and roles that mark chrome.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea svg title".split())
DROPPED = frozenset("head nav aside footer header form menu dialog script style noscript template iframe textarea svg title object select button".split())
CONTAINERS = frozenset("article main section div td body".split())
BLOCKS = CONTAINERS | DROPPED | frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr th caption blockquote pre figure figcaption address fieldset details summary hr br html option".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = CONTAINERS | frozenset("h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre nav aside footer header form address figure hr p".split())
SCOPE = CONTAINERS | frozenset("ul ol dl table blockquote".split())
CERTAIN = frozenset(
    "nav navbar navigation menu sidebar aside footer header masthead breadcrumb breadcrumbs ad ads adv advert adverts advertisement sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "newsletter signup popup modal comment comments disqus respond replies reply contentinfo".split()
)
DOUBTFUL = frozenset("banner alert overlay subscribe share sharing social related recommended recommendations widget toolbar pagination pager login search skip hidden complementary form dialog".split())
NEUTRAL = frozenset("bar block bottom box buttons container global group inner items left links list outer page panel posts primary right secondary section site slot text top unit wrap wrapper".split())
LETTER = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?>\"[^\"]*+\"|'[^']*+'|[^'\">]++)*+)>")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"([^\s=\"'/]++)(?>\s*+=\s*+(?>\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
NO_DISPLAY = re.compile(r"display\s*:\s*none")
SPLIT = re.compile(r"[^a-z0-9]+")


@functools.cache
def raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*+>", re.I)


@functools.lru_cache(100_000)
def path_of(parent: int, label: str) -> int:
    return int.from_bytes(hashlib.blake2b(label.encode("utf-8", "replace"), digest_size=8, key=parent.to_bytes(8, "little", signed=True)).digest(), "little", signed=True)


@functools.lru_cache(100_000)
def suspicion(word: str) -> int:
    """2: a class, id or role that marks chrome; 1: perhaps; 0: not at all."""
    parts = {x for x in SPLIT.split(word) if x and not x.isdigit()} - NEUTRAL
    if not parts or not parts <= CERTAIN | DOUBTFUL:
        return 0
    return 2 if parts & CERTAIN else 1


class Page:
    """Containers (path, parent, tag, doubtful) and blocks (container, text, characters in links) of one page."""

    def __init__(self, source: str):
        self.nodes: list[tuple[int, int, str, bool]] = [(0, -1, "", False)]
        self.blocks: list[tuple[int, str, int]] = []
        self.stack: list[tuple[str, int, bool, int]] = [("", 0, False, 0)]  # tag, container, gone, place of the last scope
        self.spots: dict[str, list[int]] = {}  # places of each open tag
        self.read(source)

    def read(self, source: str) -> None:
        text: list[str] = []
        links = in_link = at = 0
        tag_at, look = TAG, 0
        while (lt := source.find("<", look)) >= 0:
            nxt = source[lt + 1 : lt + 2]
            end, m = -1, None
            if nxt in LETTER or nxt == "/":
                m = tag_at.match(source, lt)
                if m is None and tag_at is TAG and (nxt in LETTER or source[lt + 2 : lt + 3] in LETTER):
                    tag_at = PLAIN_TAG  # a quote never ends: from here on quotes don't count
                    m = tag_at.match(source, lt)
                    if m is None:  # no tag ends any more
                        break
                end = m.end() if m else -1
            elif nxt in ("!", "?"):
                end = source.find("-->", lt + 4) if source.startswith("<!--", lt) else source.find(">", lt)
                end = end + (3 if source.startswith("<!--", lt) else 1) if end >= 0 else len(source) if source.startswith("<!--", lt) else -1
            if end < 0:
                look = lt + 1
                continue
            if lt > at and not self.stack[-1][2]:
                text.append(source[at:lt])
                links += (lt - at) * in_link
            at = look = end
            if m is None:
                continue
            tag, closes, attributes = m[2].lower(), bool(m[1]), m[3]
            if tag == "a":
                in_link = 0 if closes else 1
            if tag in BLOCKS:
                self.flush(text, links)
                text, links = [], 0
            if closes:
                self.close(tag)
                continue
            self.close_before(tag)
            if tag in RAW and not attributes.endswith("/"):
                over = raw_end(tag).search(source, at)
                at = look = over.end() if over else len(source)
            elif tag not in VOID and not attributes.endswith("/"):
                self.open(tag, attributes)
        if not self.stack[-1][2]:
            text.append(source[at:])
        self.flush(text, links)

    def drop(self, to: int) -> None:
        for tag, *_ in reversed(self.stack[to:]):
            self.spots[tag].pop()
        del self.stack[to:]

    def close(self, tag: str) -> None:
        spots = self.spots.get(tag)
        if spots and (tag in SCOPE or tag in DROPPED or spots[-1] > self.stack[-1][3]):
            self.drop(spots[-1])

    def close_before(self, tag: str) -> None:
        """Ends what the start of tag ends within its scope, such as an open paragraph."""
        if tag in ENDS_P or tag in CLOSES:
            ends = CLOSES.get(tag, frozenset()) | ({"p"} if tag in ENDS_P else frozenset())
            last = max((s[-1] for t in ends if (s := self.spots.get(t))), default=0)
            if last and last >= self.stack[-1][3]:
                self.drop(last)

    def open(self, tag: str, attributes: str) -> None:
        _, node, gone, scope = self.stack[-1]
        if not gone and (tag in BLOCKS or attributes):
            level, label = self.judge(tag, attributes)
            gone = level == 2
            if not gone and (tag in CONTAINERS or level):
                self.nodes.append((path_of(self.nodes[node][0], label), node, tag, level == 1))
                node = len(self.nodes) - 1
        place = len(self.stack)
        self.spots.setdefault(tag, []).append(place)
        self.stack.append((tag, node, gone, place if tag in SCOPE else scope))

    def judge(self, tag: str, attributes: str) -> tuple[int, str]:
        """(how surely it is chrome, its part of the path)."""
        article = any(self.spots.get(t) for t in ("article", "main"))
        if tag in DROPPED and not (tag == "header" and article):
            return 2, ""
        if not attributes:
            return 0, tag
        level, label = 0, [tag]
        for k, *v in ATTRIBUTE.findall(attributes):
            k, value = k.lower(), "".join(v).lower()
            if k == "hidden" or k == "aria-hidden" and value.strip() == "true" or k == "style" and NO_DISPLAY.search(value):
                return 2, ""
            if k in ("class", "id", "role"):
                for word in value.split():
                    if tag != "body" and not (article and word == "header"):
                        level = max(level, suspicion(word))
                    if k != "role":
                        label.append(("." if k == "class" else "#") + re.sub(r"\d+", "#", word))
        return level, "".join([tag, *sorted(label[1:])])

    def flush(self, text: list[str], links: int) -> None:
        if text:
            whole = "".join(text)
            if "&" in whole:
                whole = html.unescape(whole)
            whole = " ".join(whole.split())
            if whole:
                self.blocks.append((self.stack[-1][1], whole, min(links, len(whole))))

    def doubts(self) -> dict[int, tuple[int, int, int]]:
        """For each doubtful container: characters outside and inside links, and a digest of its text."""
        if not any(n[3] for n in self.nodes):
            return {}
        total = [[0, 0, 0] for _ in self.nodes]
        for node, text, links in self.blocks:
            t = total[node]
            t[0] += len(text) - links
            t[1] += links
            t[2] = path_of(t[2], text)
        for i in range(len(total) - 1, 0, -1):
            up = total[self.nodes[i][1]]
            up[0] += total[i][0]
            up[1] += total[i][1]
            up[2] = path_of(up[2], str(total[i][2]))
        return {i: tuple(total[i]) for i, n in enumerate(self.nodes) if n[3]}

    def closed(self, keep) -> list[bool]:
        """Whether each container lies within a doubtful one that isn't kept."""
        out = [False] * len(self.nodes)
        for i, (_, parent, _, doubtful) in enumerate(self.nodes):
            out[i] = parent >= 0 and out[parent] or doubtful and not keep(i)
        return out

    def best(self, closed: list[bool]) -> tuple[int, float]:
        """The container with the highest score, or the article around it."""
        score = [0.0] * len(self.nodes)
        for node, text, links in self.blocks:
            if not closed[node]:
                score[node] += max(0, len(text) - 2 * links)
        for i in range(len(score) - 1, 0, -1):
            score[self.nodes[i][1]] += 0.5 * score[i]
        top = max(range(len(score)), key=lambda i: (score[i], -i))
        value, up = score[top], top
        while up > 0:
            if self.nodes[up][2] == "article":
                return up, value
            up = self.nodes[up][1]
        return top, value

    def text(self, closed: list[bool], inside) -> str:
        """The blocks of the containers that `inside` accepts and of all within them."""
        ok = [False] * len(self.nodes)
        for i, (path, parent, *_) in enumerate(self.nodes):
            ok[i] = not closed[i] and (inside(i, path) or parent >= 0 and ok[parent])
        return " ".join(t for node, t, _ in self.blocks if ok[node])


def prose(own, links) -> bool:
    return own >= PROSE and 2 * links <= own


VOTE = "host string, path long, doubtful boolean, score double, own long, links long, digest long, page long"


def vote(batches):
    for batch in batches:
        out = []
        for host, source, place in zip(*(c.to_pylist() for c in batch.columns)):
            page = Page(source or "")
            doubts = page.doubts()
            node, score = page.best(page.closed(lambda i: prose(*doubts[i][:2])))  # noqa: B023
            if score > 0:
                out.append((host, page.nodes[node][0], False, score, None, None, None, None))
            if doubts:
                plain = page.closed(lambda i: False)
                same = path_of(place, " ".join(t for at, t, _ in page.blocks if not plain[at]))
                out += [(host, page.nodes[i][0], True, 0.0, *x, same) for i, x in doubts.items()]
        types = [pa.string(), pa.int64(), pa.bool_(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 8, types)], [f.split()[0] for f in VOTE.split(", ")])


def extract_at(batches):
    for batch in batches:
        out = []
        for source, path, kept in zip(*(batch.column(c).to_pylist() for c in ("source", "path", "kept"))):
            page = Page(source or "")
            closed = page.closed(lambda i: kept is not None and page.nodes[i][0] in kept)  # noqa: B023
            text = page.text(closed, lambda _, p: p == path) if path is not None else ""  # noqa: B023
            if not text:
                node = page.best(closed)[0]
                text = page.text(closed, lambda i, _: i == node)  # noqa: B023
            out.append(text)
        yield pa.record_batch([batch.column("rest"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["rest", "text", "n_chars"])


def winners(pages: DataFrame) -> DataFrame:
    """(host, path, kept): the path with the most votes, and the doubtful paths that hold prose."""
    votes = cut(pages.select("host", "source", "place").mapInArrow(vote, VOTE))
    counted = votes.filter("not doubtful").groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(F.floor("score")).alias("score"))
    first = F.row_number().over(W.partitionBy("host").orderBy(F.desc("n"), F.desc("score"), "path"))
    won = counted.withColumn("first", first).filter("first = 1").select("host", "path")
    once = votes.filter("doubtful").dropDuplicates(["host", "path", "digest", "page"])
    texts = once.groupBy("host", "path", "digest").agg(F.count("*").alias("n"), F.sum("own").alias("own"), F.sum("links").alias("links"))
    doubts = texts.groupBy("host", "path").agg(F.sum("n").alias("n"), F.count("*").alias("texts"), F.sum("own").alias("own"), F.sum("links").alias("links"))
    kept = doubts.filter((2 * F.col("texts") >= F.col("n")) & (F.col("own") > 0) & (2 * F.col("links") <= F.col("own")))
    return won.join(kept.groupBy("host").agg(F.collect_list("path").alias("kept")), "host", "full_outer")


def extract(pages: DataFrame, source: str = "html", url: str = "url") -> DataFrame:
    """pages without their html, with text and n_chars."""
    host = F.lower(F.regexp_replace(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), r"^[^@]*@|:\d+$", ""))
    rest = [c for c in pages.columns if c.lower() not in ("text", "n_chars") and c != source]
    rows = short_batches(pages).select(F.struct(*rest).alias("rest"), host.alias("host"), F.col(source).alias("source"), F.xxhash64(url).alias("place"))
    won = cut(winners(rows))
    if won.count() <= BROADCAST_ROWS:
        won = F.broadcast(won)
    met = rows.join(won, "host", "left").select("rest", "source", "path", "kept")
    return met.mapInArrow(extract_at, f"rest {rows.dtypes[0][1]}, text string, n_chars long").select("rest.*", "text", "n_chars")


def op8_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
