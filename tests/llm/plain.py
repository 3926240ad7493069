"""Plain versions of operators, one document at a time, that queries are compared with."""

import math
import re
from html.parser import HTMLParser

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MASK = 2**64 - 1


def hash_long(value, seed=42):
    return xxhash.xxh64_intdigest((value & MASK).to_bytes(8, "little"), seed=seed)


def signed(x):
    return x - 2**64 if x >> 63 else x


def plain_fingerprint(text, bins=128, bits=8, shingle=5):
    """One-permutation MinHash: least hash of each bin, empty bins filled from the bin that comes first in their own order."""
    words = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in WORD.findall(text)]

    def chained(values):
        h = 42
        for v in values:
            h = hash_long(v, h)
        return h

    runs = [words[i : i + shingle] for i in range(len(words) - shingle + 1)] if len(words) >= shingle else [words] if words else []
    least = {}
    for run in runs:
        h = signed(chained(run))
        b = (h >> (64 - bins.bit_length() + 1)) + bins // 2
        least[b] = min(least.get(b, h), h)
    if not least:
        return ""
    out = []
    for i in range(bins):
        # an int is hashed as four bytes, a long as eight
        fill = lambda b, i=i: signed(hash_long(b, xxhash.xxh64_intdigest(i.to_bytes(4, "little"), seed=42)))
        h = least[i] if i in least else least[min(least, key=fill)]
        out.append(f"{h & (2**bits - 1):0{bits // 4}x}")
    return "".join(out)


def plain_likeness(a, b, bins=128, bits=8):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    d, c = bits // 4, 2.0**-bits
    same = sum(a[k : k + d] == b[k : k + d] for k in range(0, bins * d, d))
    return max(0.0, (same / bins - c) / (1 - c))


def plain_score(text, model):
    """Length-weighted mean of each line's probability of good, by sums over labels in logarithms."""
    lines = text.split("\n")

    def own(line):
        words = WORD.findall(line)
        low = [c for c in line if c not in " \t\n\x0b\x0c\r"]
        known = [c if ord(c) < 0x24F else "\u024f" for c in low]
        upper, letter = sum(c.isupper() for c in known if c.isalpha()), sum(c.isalpha() for c in known)
        digit = sum(c.isdigit() and not c.isalpha() for c in known)
        rest = [c for c in known if not c.isalpha() and not c.isdigit()]
        mark = sum(c in ".,;:'\"?()-" for c in rest)
        ink, n = max(len(low), 1), max(len(words), 1)
        again = sum(a == b for a, b in zip(words, words[1:], strict=False))
        return [upper / max(letter, 1), (len(rest) - mark) / ink, digit / ink, mark / ink, again / n, math.log1p(len(words)) / 4, min(ink / n, 30) / 10, float(not words)]

    feats = [own(x) for x in lines]
    none = [0.0] * 9
    weights, pairs = model
    odds = []
    for k, f in enumerate(feats):
        x = [1.0, *f, *(feats[k - 1] + [1.0] if k else none), *(feats[k + 1] + [1.0] if k + 1 < len(feats) else none)]
        odds.append(min(40.0, max(-40.0, sum(a * float(b) for a, b in zip(x, weights, strict=True)))))
    p = [[min(20.0, max(-20.0, float(v))) for v in row] for row in pairs]

    def both(a, b):
        m = max(a, b)
        return m + math.log(math.exp(a - m) + math.exp(b - m))

    fwd = [(0.0, odds[0])]
    for e in odds[1:]:
        bad, good = fwd[-1]
        fwd.append((both(bad + p[0][0], good + p[1][0]), both(bad + p[0][1], good + p[1][1]) + e))
    bwd = [(0.0, 0.0)]
    for e in reversed(odds[1:]):
        bad, good = bwd[-1]
        bwd.append((both(p[0][0] + bad, p[0][1] + e + good), both(p[1][0] + bad, p[1][1] + e + good)))
    bwd.reverse()
    total = weight = 0.0
    for line, (f0, f1), (b0, b1) in zip(lines, fwd, bwd, strict=True):
        size = max(len(line), 1)
        total += size / (1 + math.exp(min(700.0, f0 + b0 - f1 - b1)))
        weight += size
    return total / weight


class _Article(HTMLParser):
    """Blocks of text in the one article or main element, but for what is nested there and isn't article text."""

    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
    INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "data"}

    #: From looking at the pages, not from the code under test.
    NO_ARTICLE = {"script", "style", "title", "head", "nav", "header", "footer", "aside", "form", "button", "textarea", "select", "noscript", "iframe", "label"}
    NO_NAME = r"\b(ads?|advert\w*|sponsor\w*|promo\w*|banner|sidebar|widget|nav\w*|menu|breadcrumbs?|header|footer|comments?|cookies?|consent|notice|popup|modal|newsletter|subscribe|share|sharing|social|related|pagination|hidden|skip)\b"

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.blocks, self.roots = [], [[]], 0

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        names = f"{a.get('class', '')} {a.get('id', '')}".lower()
        out = tag in self.NO_ARTICLE or a.get("role") in ("navigation", "banner", "contentinfo", "complementary", "search", "alert") or "hidden" in a or a.get("aria-hidden") == "true" or "none" in a.get("style", "") or (tag not in ("html", "body", "article", "main") and bool(re.search(self.NO_NAME, names)))
        up = self.stack[-1] if self.stack else (None, False, False)
        root = tag in ("article", "main") and not up[2] and not (out or up[1])
        self.roots += root
        if tag not in self.INLINE and tag != "br":
            self.blocks.append([])
        if tag == "br":
            self.blocks[-1].append(" ")
        if tag not in self.VOID:
            self.stack.append((tag, out or up[1], root or up[2]))

    def handle_endtag(self, tag):
        if tag not in self.INLINE:
            self.blocks.append([])
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                break

    def handle_data(self, data):
        if self.stack and self.stack[-1][2] and not self.stack[-1][1]:
            self.blocks[-1].append(data)


def plain_text(source):
    """Text of the page's only article or main element; None where a page has another number of them."""
    parser = _Article()
    parser.feed(source)
    parser.close()
    if parser.roots != 1:
        return None
    said = (" ".join("".join(b).split()) for b in parser.blocks)
    return "\n".join(x for x in said if x)
