"""Pages as block trees: a forgiving reader of HTML, and what the extractor looks at in each node."""

from __future__ import annotations

import html
import math
import re

import numpy as np

# Element names of the HTML standard by what they do to text, and words used in attributes.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSE_P = BLOCKS - frozenset("body html td th tr tbody thead tfoot".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes".split())
UNSEEN = frozenset("template svg math select button object canvas audio video datalist head".split())
GROUPS = {
    "article": "article", "main": "main", "section": "section", "div": "div", "p": "p", "h1": "h", "h2": "h", "h3": "h", "h4": "h", "h5": "h", "h6": "h",
    "li": "li", "ul": "list", "ol": "list", "dl": "list", "dt": "li", "dd": "li", "nav": "nav", "header": "header", "footer": "footer", "aside": "aside",
    "form": "form", "fieldset": "form", "table": "table", "tr": "table", "td": "table", "th": "table", "tbody": "table", "blockquote": "quote", "pre": "quote",
    "figure": "quote", "figcaption": "quote", "body": "body", "html": "body", "#run": "run",
}
KINDS = sorted({*GROUPS.values(), "other"})
WORDS = {
    "body": "article articlebody content post entry story text main body prose page",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc links skip tabs",
    "top": "header masthead banner topbar branding logo head",
    "foot": "footer foot copyright bottom colophon legal",
    "side": "sidebar side aside widget rail related recommended more also trending popular teaser complementary",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner dfp adsense",
    "notice": "notice notices cookie cookies consent alert warning gdpr popup modal overlay disclaimer paywall message",
    "form": "form subscribe subscription newsletter signup login search searchbox register contact",
    "talk": "comment comments respond reply replies discussion disqus thread reviews feedback",
    "share": "share sharing social follow tags meta byline author tools print rating",
}
_SORT = {w: k for k, words in enumerate(WORDS.values()) for w in words.split()}
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+(?:["'][^"']*\Z)?)(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""\b(class|id|role|itemprop|aria-label|data-\w+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_STOPS = re.compile(r"[.!?]")


class Page:
    """Nodes in page order: `tag`, `parent`, flags of attribute words, own text; a #run is text beside blocks."""

    def __init__(self, source: str):
        self.tag, self.parent, self.words, self.text = ["html"], [-1], [0], [""]
        self.linked, self.inputs, self.images = [0], [0], [0]
        self._open, self._run, self._in_link, self._link_size = [0], [], False, 0
        self._read(source)

    def _read(self, s: str) -> None:
        at, unseen = 0, None
        while at < len(s):
            m = _TOKEN.search(s, at)
            if unseen is None:
                self._chars(s[at : m.start() if m else len(s)])
            if not m:
                break
            at, name = m.end(), (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                if unseen == name:
                    unseen = None
                elif unseen is None:
                    self._end(name)
                continue
            if unseen is not None:
                if unseen in ("button", "select", "head") and (name in BLOCKS):
                    unseen = None
                else:
                    continue
            if name in RAW:
                close = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(s, at)
                at = close.end() if close else len(s)
            elif name in UNSEEN:
                unseen = None if m[3].rstrip().endswith("/") else name
                self.inputs[self._open[-1]] += name in ("select", "button")
            else:
                self._start(name, m[3])
        self._flush()

    def _chars(self, s: str) -> None:
        if s:
            s = html.unescape(s) if "&" in s else s
            self._run.append(s)
            if self._in_link:
                self._link_size += len(s)

    def _flush(self) -> None:
        text = " ".join("".join(self._run).split())
        if text:
            self._node("#run", self._open[-1], 0)
            self.text[-1], self.linked[-1] = text, min(self._link_size, len(text))
        self._run, self._link_size = [], 0

    def _node(self, tag: str, parent: int, words: int) -> int:
        for values, v in ((self.tag, tag), (self.parent, parent), (self.words, words), (self.text, ""), (self.linked, 0), (self.inputs, 0), (self.images, 0)):
            values.append(v)
        return len(self.tag) - 1

    def _start(self, name: str, attributes: str) -> None:
        if name == "a":
            self._in_link = True
        elif name == "br":
            self._run.append(" ")
        elif name in ("input", "label"):
            self.inputs[self._open[-1]] += 1
        elif name in ("img", "picture"):
            self.images[self._open[-1]] += 1
        if name not in BLOCKS:
            return
        self._flush()
        self._in_link = False
        if name in CLOSE_P:
            self._pop({"p"}, {"td", "th", "li", "div", "body"})
        if name in ("li", "dt", "dd"):
            self._pop({name} if name == "li" else {"dt", "dd"}, {"ul", "ol", "dl"})
        elif name in ("td", "th", "tr"):
            self._pop({"td", "th"} if name != "tr" else {"tr"}, {"table"} if name == "tr" else {"tr", "table"})
        if name == "hr" or name == "html":
            return
        flags = 0
        if attributes and not attributes.isspace():
            for a in _NAMED.finditer(attributes):
                for w in _PART.findall(a[2]):
                    k = _SORT.get(w.lower())
                    flags |= 0 if k is None else 1 << k
            flags |= bool(_HIDDEN.search(attributes)) << len(WORDS)
        self._open.append(self._node(name, self._open[-1], flags))

    def _pop(self, names: set[str], within: set[str]) -> None:
        """Close the innermost of `names`, unless one of `within` is nearer."""
        for k in range(len(self._open) - 1, 0, -1):
            tag = self.tag[self._open[k]]
            if tag in names:
                del self._open[k:]
                return
            if tag in within:
                return

    def _end(self, name: str) -> None:
        if name == "a":
            self._in_link = False
        if name in BLOCKS and name not in ("body", "html"):
            for k in range(len(self._open) - 1, 0, -1):
                if self.tag[self._open[k]] == name:
                    self._flush()
                    del self._open[k:]
                    return

    def rows(self) -> list[tuple]:
        """What table() makes features of, a row for each node."""
        n = len(self.tag)
        size, linked, below, inputs, images = [len(t) for t in self.text], list(self.linked), [0] * n, list(self.inputs), list(self.images)
        stops = [len(_STOPS.findall(t)) for t in self.text]
        kinds = [GROUPS.get(t, "other") for t in self.tag]
        p, li, heads, within = [0] * n, [0] * n, [0] * n, list(self.words)
        for i in range(n - 1, 0, -1):
            u = self.parent[i]
            for v in (size, linked, inputs, images, stops, p, li, heads):
                v[u] += v[i]
            below[u] += below[i] + 1
            p[u] += kinds[i] == "p"
            li[u] += kinds[i] == "li"
            heads[u] += kinds[i] == "h"
            within[u] |= within[i]
        depth, above, kinds_above, children, before = [0] * n, [0] * n, [0] * n, [0] * n, 0
        place, seen = [0] * n, [0] * n
        number = {k: i for i, k in enumerate(KINDS)}
        for i in range(1, n):
            u = self.parent[i]
            depth[i], above[i] = depth[u] + 1, above[u] | self.words[u]
            kinds_above[i] = kinds_above[u] | 1 << number[kinds[u]]
            place[i] = children[u]
            children[u] += 1
            seen[i] = before
            before += len(self.text[i])
        total = max(1, size[0])
        out = []
        for i in range(n):
            u = max(0, self.parent[i])
            out.append((
                depth[i], place[i], children[u], children[i], math.log1p(size[i]), size[i] / (below[i] + 1), linked[i] / (size[i] + 1), stops[i] / (size[i] + 20) * 100,
                p[i], li[i], heads[i], inputs[i], images[i], size[i] / total, seen[i] / total, math.log1p(size[u]), linked[u] / (size[u] + 1), p[u], inputs[u], size[i] / (size[u] + 1),
                number[kinds[u]], below[i], number[kinds[i]], self.words[i], above[i], within[i] & ~self.words[i], kinds_above[i],
            ))
        return out

    def kept(self, score: np.ndarray) -> np.ndarray:
        """Labels of the highest joint likelihood (score: log-odds of each node) where a node's parent is kept if it is."""
        n = len(self.tag)
        keep, drop = (-np.logaddexp(0, -score)).tolist(), (-np.logaddexp(0, score)).tolist()
        for i in range(n - 1, 0, -1):
            keep[self.parent[i]] += max(keep[i], drop[i])
            drop[self.parent[i]] += drop[i]
        label = np.zeros(n, bool)
        label[0] = keep[0] >= drop[0]
        for i in range(1, n):
            label[i] = label[self.parent[i]] and keep[i] >= drop[i]
        return label

    def blocks(self, label: np.ndarray) -> list[str]:
        return [t for t, k in zip(self.text, label.tolist(), strict=True) if t and k]


_PLAIN = 22


def table(rows: list[tuple]) -> np.ndarray:
    """Features of nodes: the numbers, the node's kind, and flags of attribute words and of kinds above."""
    x = np.array(rows, np.float64).reshape(-1, _PLAIN + 5)
    kind, flags, above = x[:, _PLAIN].astype(np.int64), x[:, _PLAIN + 1 : _PLAIN + 4].astype(np.int64), x[:, _PLAIN + 4].astype(np.int64)
    words = [flags >> j & 1 for j in range(len(WORDS) + 1)]
    return np.concatenate([x[:, :_PLAIN], np.eye(len(KINDS))[kind], *words, above[:, None] >> np.arange(len(KINDS)) & 1], 1).astype(np.float32)


FEATURES = _PLAIN + len(KINDS) + 3 * (len(WORDS) + 1) + len(KINDS)
