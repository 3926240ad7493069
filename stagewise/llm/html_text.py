"""Main text of web pages by consensus host paths.

1. Each page is read into elements and text runs. Every container is scored by
   the plain text of its children (in full) and grandchildren (by half), link
   text counting against it; the best one, widened to the article or main
   element around it, is the page's own choice.
2. A container's generalised path is its elements' tags and classes from the
   root, digits replaced, hashed step by step from its parent's. Each page gives its host's ballot a vote for its
   choice and shares for all others with a score; votes are summed by (host, path) with
   map-side combining, so a host of any size is a few rows a task, and each
   host's best path wins.
3. Pages are read again and the text of the elements on the winning path is
   taken; a page without that path keeps its own choice.

Elements that aren't the article are left out wherever they stand: menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader
comments; known by tag, role, or a word of class or id. A form, or an element that has
such a word only as a part of a name (`has-sidebar`), may as well be what wraps the page: it stays
if it has twenty times the text of all that is left without it, the largest such element first, what lies in it being
judged in turn (for names about comments, only if nothing else is left). Character
references are decoded, white space inside a block becomes one space, blocks
are trimmed and joined by line feeds; nothing else is dropped or cut.

Defined results: null or empty html, or html without text, gives an empty text;
a page whose url is null or has no host keeps its own choice; repeated rows get equal
texts; ties between paths go to the more frequent, then the lesser hash; any depth of elements takes time in
proportion; an empty table gives no rows; input columns named like results are replaced.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.llm.common import checkpointed, ship

#: Hosts up to which the table of winning paths is broadcast; beyond, it is joined.
BROADCAST_HOSTS = 100_000

#: HTML's void, raw-text and block elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes xmp".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = set("article main section div td body center dd blockquote".split())
#: An opening tag ends open elements of these kinds, up to the scope.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements that are no article text, by tag, role, and words of class or id.
DROP_TAG = RAW | set("head nav header footer aside button select menu noscript template svg canvas object embed dialog search".split())
#: Elements of forms, which may wrap a page, and words that stand for comments in any name.
FORM_TAG = set("form label fieldset".split())
COMMENT_WORD = set("comment comments commentlist disqus respond reply replies".split())
#: What an element that may wrap the page must have, times all text that is left without it.
WRAPS = 20
DROP_ROLE = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
DROP_WORD = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar side aside rail widget widgets nav navbar navigation menu menus submenu topbar toolbar breadcrumb breadcrumbs pagination pager"
    " header masthead footer foot colophon copyright comment comments commentlist disqus respond reply replies cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login form search share sharing social related recommended recommendations skip hidden".split()
)

#: How an element is left out: surely, or unless it wraps the page, or unless there is nothing else.
SURELY, MAYBE, HARDLY = 3, 1, 2

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S | re.I)
WORDS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def path_key(steps: str, key: int = 0) -> int:
    """The key of a path, given as its steps with > between."""
    for step in steps.split(">"):
        key = xxhash.xxh64_intdigest(step, seed=key)
    return key


class Page:
    """Elements: parent, tag, step (tag and classes), key (of the path), dropped. Runs: (element, block, text, in a link), dropped ones left out."""

    def __init__(self, source: str) -> None:
        self.parent, self.tag, self.step, self.key, self.dropped, self.linked = [-1], [""], [""], [0], [False], [False]
        # the nearest element, from each one up, that may be left out, is a container, is an article; 0 is none
        self.wrapper, self.container, self.article, self.kind = [0], [0], [0], {0: 0}
        self.runs: list[tuple[int, int, str, bool]] = []
        stack, opened, block, at, n = [0], Counter(), 0, 0, len(source)
        lower = None
        while at < n:
            m = TOKEN.search(source, at)
            start = m.start() if m else n
            if start > at and not self.dropped[stack[-1]]:
                self.runs.append((stack[-1], block, html.unescape(source[at:start]), self.linked[stack[-1]]))
            if not m:
                break
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                block += tag in BLOCK
                if tag == "br":
                    self.runs.append((stack[-1], block, " ", False))
                for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                    if self.tag[stack[k]] == tag:
                        self._cut(stack, opened, k)
                        break
                    if self.tag[stack[k]] in ("td", "th", "table") and tag in ("p", "div", "li"):
                        break
                continue
            block += tag in BLOCK
            if tag in BLOCK:
                self._close(stack, opened, {"p"}, {"td", "th", "table", "button"})
            if tag in CLOSES:
                self._close(stack, opened, *CLOSES[tag])
            i = self._add(stack[-1], tag, m[3])
            if tag == "br" and not self.dropped[i]:
                self.runs.append((stack[-1], block, " ", False))
            if tag in RAW:
                lower = lower if lower is not None else source.lower()
                end = lower.find(f"</{tag}", at)
                at = n if end < 0 else end
            if tag not in VOID and (not m[3].endswith("/") or tag in BLOCK):  # HTML ignores the slash of a block element
                stack.append(i)
                opened[tag] += 1
        self._settle()

    def _cut(self, stack: list[int], opened: Counter, k: int) -> None:
        opened.subtract(self.tag[i] for i in stack[k:])
        del stack[k:]

    def _close(self, stack: list[int], opened: Counter, kinds: set[str], scope: set[str]) -> None:
        if not any(opened[x] for x in kinds):
            return
        end = len(stack)
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[k]]
            if tag in kinds:
                end = k
            elif tag in scope:
                break
        self._cut(stack, opened, end)

    @staticmethod
    def _kind(tag: str, name: str, value: str) -> int:
        """How an attribute leaves its element out."""
        if name in ("class", "id"):
            kind = 0
            for word in value.split() if tag not in ("html", "body", "article", "main") else ():
                words = WORDS.findall(CAMEL.sub("-", word).lower())
                if not DROP_WORD.isdisjoint(words):
                    kind = max(kind, SURELY if len(words) == 1 else MAYBE if COMMENT_WORD.isdisjoint(words) else HARDLY)
            return kind
        gone = value.lower() in DROP_ROLE if name == "role" else name == "hidden" or (value.lower() == "true" if name == "aria-hidden" else bool(re.search(r"display\s*:\s*none", value, re.I)))
        return SURELY if gone else 0

    def _add(self, parent: int, tag: str, attributes: str) -> int:
        classes, kind = "", SURELY if tag in DROP_TAG else MAYBE if tag in FORM_TAG else 0
        if attributes.strip():
            for m in ATTRIBUTE.finditer(attributes):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name == "class":
                    classes = value
                kind = max(kind, self._kind(tag, name, value))
        i = len(self.tag)
        self.parent.append(parent)
        self.tag.append(tag)
        self.step.append(".".join([tag, *sorted(re.sub(r"\d+", "#", classes).split())]))
        self.key.append(xxhash.xxh64_intdigest(self.step[i], seed=self.key[parent]))
        self.dropped.append(kind == SURELY or self.dropped[parent])
        self.linked.append(tag == "a" or self.linked[parent])
        self.wrapper.append(i if 0 < kind < SURELY else self.wrapper[parent])
        self.container.append(i if tag in CONTAINER else self.container[parent])
        self.article.append(i if tag in ("article", "main") else self.article[parent])
        if 0 < kind < SURELY:
            self.kind[i] = kind
        return i

    def _settle(self) -> None:
        """Drop the elements that may be left out, but for those that wrap the page."""
        if len(self.kind) == 1:
            return
        own = Counter()
        for i, _, text, linked in self.runs:
            if not linked:
                own[self.wrapper[i]] += sum(map(len, text.split()))
        whole, inner = Counter(own), {}
        for i in sorted(self.kind, reverse=True)[:-1]:  # children come behind their parents
            up = self.wrapper[self.parent[i]]
            whole[up] += whole[i]
            inner.setdefault(up, []).append(i)
        kept, left, stay = own[0], inner.get(0, []), {0}
        while left:
            best = max(left, key=lambda i: (self.kind[i] == MAYBE, whole[i], -i))
            if not whole[best] or whole[best] < WRAPS * kept or (self.kind[best] == HARDLY and kept):
                break
            stay.add(best)
            kept += own[best]
            left = [i for i in left if i != best] + inner.get(best, [])
        self.dropped = [d or w not in stay for d, w in zip(self.dropped, self.wrapper, strict=True)]
        for i in range(1, len(self.dropped)):
            self.dropped[i] |= self.dropped[self.parent[i]]
        self.runs = [r for r in self.runs if not self.dropped[r[0]]]

    def path(self, i: int) -> str:
        steps = []
        while i > 0:
            steps.append(self.step[i])
            i = self.parent[i]
        return ">".join(reversed(steps))

    def choices(self) -> list[tuple[int, float]]:
        """Containers with their scores, the page's own choice first."""
        score: dict[int, float] = {}
        for i, _, text, linked in self.runs:
            size = len(text) - text.count(" ") if text.strip() else 0
            size = -size if linked else size
            share, i = 1.0, self.container[i]
            while i > 0 and share > 0.2:
                score[i] = score.get(i, 0.0) + share * size
                share, i = share / 2, self.container[self.parent[i]]
        ranked = sorted(score.items(), key=lambda x: (-x[1], x[0]))
        out: dict[int, float] = {}
        for i, s in ranked:
            if s > 0:
                out.setdefault(self.article[i] or i, s)
        return list(out.items())

    def text(self, roots: set[int]) -> str:
        inside = [False] * len(self.tag)
        for i in range(len(self.tag)):
            inside[i] = i in roots or (i > 0 and inside[self.parent[i]])
        blocks: list[str] = []
        now, parts = None, []
        for i, block, text, _ in [*self.runs, (0, -1, "", False)]:
            if block != now:
                if said := " ".join("".join(parts).split()):
                    blocks.append(said)
                now, parts = block, []
            if inside[i]:
                parts.append(text)
        return "\n".join(blocks)

    def main_text(self, key: int | None) -> str:
        """The text of the elements on the path with that key; by the page's own choice if there is none."""
        roots = {i for i in range(1, len(self.tag)) if self.key[i] == key and not self.dropped[i]} if key is not None else set()
        if roots and (text := self.text(roots)):
            return text
        own = self.choices()
        return self.text({own[0][0]} if own else {0})


def signed(key: int) -> int:
    return key - 2**64 if key >> 63 else key


def host(url: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path: the key of each host's winning path."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[tuple[str, int], tuple[float, int]] = {}
            for h, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page = Page(source or "")
                choices = page.choices()
                for k, (i, s) in enumerate(choices):
                    key = (h, page.key[i])
                    vote = 1.0 if k == 0 else 0.5 * s / choices[0][1]
                    v, n = out.get(key, (0.0, 0))
                    out[key] = (v + round(vote, 6), n + 1)
            cols = list(zip(*[(h, signed(p), v, n) for (h, p), (v, n) in out.items()], strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.string(), pa.int64(), pa.float64(), pa.int64()], strict=True)], names=["host", "path", "vote", "n"])

    votes = pages.select(host(url_col).alias("host"), html_col).where("host <> ''").mapInArrow(run, "host string, path long, vote double, n long")
    votes = votes.groupBy("host", "path").agg(F.round(F.sum("vote"), 4).alias("vote"), F.sum("n").alias("n"))
    best = votes.groupBy("host").agg(F.min(F.struct(-F.col("vote"), -F.col("n"), F.col("path").alias("path"))).alias("best"))
    return best.select("host", F.col("best.path").alias("path"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars of every page."""
    winners = checkpointed(host_paths(pages, url_col, html_col).select(F.col("host").alias("__h"), F.col("path").alias("__path")))
    if winners.count() <= BROADCAST_HOSTS:
        winners = F.broadcast(winners)
    rows = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), F.col(html_col).alias("__html"), host(url_col).alias("__host"))
    rows = rows.join(winners, F.col("__host") == F.col("__h"), "left").select("__id", "__url", "__html", "__path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                texts = [Page(s or "").main_text(None if p is None else p % 2**64) for s, p in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return rows.mapInArrow(run, f"`{id_col}` {pages.schema[id_col].dataType.simpleString()}, `{url_col}` string, text string, n_chars long")
