"""Main text of web pages by a tree-structured graphical model.

Every block element (and every text that stands beside block elements) is a node that is content or not. What a node looks like
gives its potential, and potentials between parent and child say how content hangs together. Messages pass up the tree and down
again (sum-product), which gives each node's exact marginal. The weights maximise the likelihood of labelled pages; unless others are
given, those are written by `labelled_pages`, in many layouts and with known content.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_tree import Page

# Tags and name parts that features tell apart.
TAGS = "#root body div section article main p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody thead tfoot tr td th blockquote pre figure figcaption nav header footer aside form fieldset button address details summary dialog menu center hr #text".split()
HINTS: dict[str, str] = {
    "content": r"article|content|main|post|entry|story|body-?text|prose|text|page-?body",
    "menu": r"nav|menu|breadcrumb|pagination|pager|toc|tabs|links",
    "header": r"header|masthead|banner|topbar|top-bar|logo|brand|hero",
    "footer": r"foot|copyright|legal|colophon|bottom",
    "side": r"side|aside|widget|rail|related|recommend|trending|popular|more-|see-?also",
    "advert": r"\bads?\b|\bad-|-ad\b|advert|sponsor|promo|banner|\bdfp|outbrain|taboola|affiliate|shop|deal",
    "notice": r"cookie|consent|notice|gdpr|alert|popup|modal|overlay|paywall|message|warning|toast|dialog",
    "comment": r"comment|disqus|respon[sd]|repl(?:y|ies)|discussion|reader|feedback|review",
    "form": r"form|subscri|newsletter|signup|sign-up|login|search|contact|input",
    "share": r"share|social|follow|tweet|facebook|byline|author|meta|tags?\b|date|avatar|profile",
    "hidden": r"display:\s*none|visibility:\s*hidden|\bhidden\b|aria-hidden=true|sr-only",
}
_HINT = {k: re.compile(v, re.I) for k, v in HINTS.items()}
_TAG_AT = {t: i for i, t in enumerate(TAGS)}
_WORDS = (0, 1, 4, 10, 25, 60, 150)
_LINKS = (0.0, 0.05, 0.35, 0.8)
_H0 = len(TAGS) + 1
_OWN = _H0 + len(HINTS)
_SUB = _OWN + len(_WORDS) + 1 + len(_LINKS) + 4
_REGION = _SUB + len(_WORDS) + 1 + len(_LINKS) + 6
REGIONS = ("article", "main", "nav", "header", "footer", "aside", "form")
SIZE = _REGION + len(REGIONS) + len(HINTS) + 1
EDGES = 4  # kinds of edges: to an element with block children, to a heading, to list items and cells, to other text


@lru_cache(100_000)
def _hints(attrs: str) -> tuple[int, ...]:
    return tuple(i for i, r in enumerate(_HINT.values()) if r.search(attrs))


def _bin(v: float, edges: tuple) -> int:
    i = 0
    while i < len(edges) and v > edges[i]:
        i += 1
    return i


def features(page: Page) -> tuple[list[list[int]], list[int]]:
    """Indices of each node's features, and the kind of the edge to its parent."""
    n = len(page.tags)
    text: dict[int, str] = {}
    for node, block in page.blocks:
        text[node] = f"{text[node]} {block}" if node in text else block
    chars, linked, stops, blocks = [0] * n, [0] * n, [0] * n, [0] * n
    own_words = [0] * n
    for node, t in text.items():
        own_words[node] = t.count(" ") + 1
        chars[node], linked[node], blocks[node] = len(t), page.linked[node], 1
        stops[node] = t.count(". ") + t.count(", ") + (t[-1] in ".!?…")
    sub_words = own_words[:]
    order = sorted(range(n), key=page.depth.__getitem__, reverse=True)
    for i in order:
        p = page.parent[i]
        if p >= 0:
            chars[p] += chars[i]
            linked[p] += linked[i]
            stops[p] += stops[i]
            blocks[p] += blocks[i]
            sub_words[p] += sub_words[i]
    total = max(1, chars[0])
    out, kinds = [], []
    regions: list[tuple[int, ...]] = []  # what the nearest telling element around a node is
    for i in range(n):
        tag = page.tags[i]
        f = [_TAG_AT.get(tag, len(TAGS))]
        hints = _hints(page.attrs[i]) if page.attrs[i] else ()
        f.extend(_H0 + h for h in hints)
        around = regions[page.parent[i]] if i else (_REGION + len(REGIONS) + len(HINTS),)
        f.extend(around)
        telling = tuple(_REGION + len(REGIONS) + h for h in hints) + ((_REGION + REGIONS.index(tag),) if tag in REGIONS else ())
        regions.append(telling or around)
        if i in text:
            t = text[i]
            f.append(_OWN + _bin(own_words[i], _WORDS))
            at = _OWN + len(_WORDS) + 1
            f.append(at + _bin(page.linked[i] / max(1, len(t)), _LINKS))
            at += len(_LINKS)
            if t[-1] in ".!?…:;":
                f.append(at + 1)
            if "©" in t or "All rights" in t:
                f.append(at + 2)
        f.append(_SUB + _bin(sub_words[i], _WORDS))
        at = _SUB + len(_WORDS) + 1
        f.append(at + _bin(linked[i] / max(1, chars[i]), _LINKS))
        at += len(_LINKS) + 1
        share = chars[i] / total
        if share > 0.5:
            f.append(at)
        elif share > 0.2:
            f.append(at + 1)
        if stops[i] > 0.08 * sub_words[i] and sub_words[i] > 3:
            f.append(at + 2)
        if blocks[i] > 2:
            f.append(at + 3)
        if not chars[i]:
            f.append(at + 4)
        out.append(f)
        kinds.append(0 if page.has_children[i] else 1 if tag[0] == "h" and tag[1:].isdigit() else 2 if tag in ("li", "td", "th", "dt", "dd") else 3)
    return out, kinds


class Forest:
    """Nodes of several pages as arrays, level by level."""

    def __init__(self, pages: list[Page]):
        flat, owner, kinds, parents, depth, at = [], [], [], [], [], 0
        self.first = [0]
        for p in pages:
            f, k = features(p)
            for i, x in enumerate(f):
                flat.extend(x)
                owner.extend([at + i] * len(x))
            kinds.extend(k)
            parents.extend(at + q if q >= 0 else -1 for q in p.parent)
            depth.extend(p.depth)
            at += len(f)
            self.first.append(at)
        self.n, self.flat, self.owner = at, np.array(flat, np.int64), np.array(owner, np.int64)
        self.kind, self.parent = np.array(kinds, np.int64), np.array(parents, np.int64)
        level = np.array(depth, np.int64)
        self.levels = [np.flatnonzero(level == d) for d in range(1, level.max() + 1)] if at else []

    def messages(self, weights: np.ndarray, edges: np.ndarray):
        """Log marginals (n, 2) of nodes and (n, 2, 2) of edges (parent's label, own label), and each root's log partition."""
        unary = np.zeros((self.n, 2))
        unary[:, 1] = np.bincount(self.owner, weights[self.flat], self.n)
        up, sent = unary.copy(), np.zeros((self.n, 2))
        for nodes in reversed(self.levels):
            m = np.logaddexp(edges[self.kind[nodes], :, 0] + up[nodes, 0:1], edges[self.kind[nodes], :, 1] + up[nodes, 1:2])
            sent[nodes] = m
            np.add.at(up, self.parent[nodes], m)
        belief = up.copy()
        pair = np.zeros((self.n, 2, 2))
        for nodes in self.levels:
            p = self.parent[nodes]
            without = belief[p] - sent[nodes]
            joint = without[:, :, None] + edges[self.kind[nodes]] + up[nodes][:, None, :]
            pair[nodes] = joint
            belief[nodes] = np.logaddexp(joint[:, 0], joint[:, 1])
        return belief, pair


class Model:
    def __init__(self, weights: np.ndarray, edges: np.ndarray):
        self.weights, self.edges = weights, edges

    def marginals(self, pages: list[Page]) -> list[np.ndarray]:
        """For each page, each node's probability of being content."""
        forest = Forest(pages)
        belief, _ = forest.messages(self.weights, self.edges)
        p = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -50, 50)))
        return [p[a:b] for a, b in zip(forest.first, forest.first[1:])]


def train(pages: list[tuple[Page, list[int]]], steps: int = 250, ridge: float = 1e-3, rate: float = 0.1) -> Model:
    """Adam on the mean log likelihood of the labels of all nodes."""
    forest = Forest([p for p, _ in pages])
    y = np.array([v for _, labels in pages for v in labels])
    weights, edges = np.zeros(SIZE), np.zeros((EDGES, 2, 2))
    child = np.flatnonzero(forest.parent >= 0)
    seen_w = np.bincount(forest.flat, y[forest.owner].astype(float), SIZE)
    seen_e = np.zeros_like(edges)
    np.add.at(seen_e, (forest.kind[child], y[forest.parent[child]], y[child]), 1)
    state = [np.zeros_like(a) for a in (weights, edges, weights, edges)]
    for t in range(1, steps + 1):
        belief, pair = forest.messages(weights, edges)
        p = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -50, 50)))
        joint = pair[child].reshape(-1, 4)
        joint = np.exp(joint - joint.max(1, keepdims=True))
        joint = (joint / joint.sum(1, keepdims=True)).reshape(-1, 2, 2)
        want_e = np.zeros_like(edges)
        np.add.at(want_e, forest.kind[child], joint)
        grads = ((seen_w - np.bincount(forest.flat, p[forest.owner], SIZE)) / len(pages) - ridge * weights, (seen_e - want_e) / len(pages) - ridge * edges)
        for i, (v, g) in enumerate(zip((weights, edges), grads)):
            state[i] = 0.9 * state[i] + 0.1 * g
            state[i + 2] = 0.99 * state[i + 2] + 0.01 * g * g
            v += rate * (state[i] / (1 - 0.9**t)) / (np.sqrt(state[i + 2] / (1 - 0.99**t)) + 1e-8)
    return Model(weights, edges)


def labels_of(page: Page, is_content) -> list[int]:
    """A node below the body is content if most of its text, its descendants' too, is content."""
    n = len(page.tags)
    good, bad = [0] * n, [0] * n
    for node, block in page.blocks:
        (good if is_content(block) else bad)[node] += len(block)
    for i in sorted(range(n), key=page.depth.__getitem__, reverse=True):
        p = page.parent[i]
        if p >= 0:
            good[p] += good[i]
            bad[p] += bad[i]
    return [int(g > b and t not in ("body", "#root")) for g, b, t in zip(good, bad, page.tags)]


def labelled_pages(n: int = 400, seed: int = 5) -> list[tuple[Page, list[int]]]:
    """Pages in many layouts. Words of the content begin with "k", all others with "x"; no feature looks at letters."""
    rng = random.Random(seed)
    pick, chance = rng.choice, lambda p: rng.random() < p

    def words(mark: str, lo: int, hi: int, end: str = ".") -> str:
        out = []
        for i in range(rng.randint(lo, hi)):
            w = mark + "".join(pick("aeioulnrst") for _ in range(rng.randint(1, 8)))
            out.append(w + (pick([",", ".", "", "", "", "", ""]) if i else ""))
        return " ".join(out).rstrip(",.") + end

    def paragraph() -> str:
        t = words("k", *pick([(1, 4), (5, 20), (20, 60), (40, 120)]), end=pick([".", ".", ".", "", "?"]))
        if chance(0.25):
            t = t.replace(" ", f' <a href="/x">{words("k", 1, 3, "")}</a> ', 1)
        if chance(0.2):
            t = f"<b>{t}<br>" if chance(0.5) else f"<strong>{words('k', 1, 4, '')}</strong> {t}"
        return f"<p>{t}" if chance(0.15) else f"<p>{t}</p>"

    def content() -> str:
        out = [f"<h1>{words('k', 2, 10, pick(['.', '', '?']))}</h1>"] if chance(0.8) else []
        for _ in range(pick([0, 1, 1, 2, 3, 5, 8, 14]) if out else rng.randint(1, 10)):
            out.append(paragraph())
            if chance(0.12):
                out.append(f"<h{(h := pick('23'))}>{words('k', 1, 6, '')}</h{h}>")
            if chance(0.1):
                out.append("<ul>" + "".join(f"<li>{words('k', 2, 14, pick(['', '.']))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            if chance(0.07):
                out.append(f"<blockquote><p>{words('k', 5, 30)}</p></blockquote>")
            if chance(0.05):
                out.append(f"<figure><img src=a><figcaption>{words('k', 3, 12)}</figcaption></figure>")
            if chance(0.05):
                out.append("<table><tr>" + "".join(f"<td>{words('k', 1, 4, '')}</td>" for _ in range(3)) + "</tr></table>")
            if chance(0.04):
                out.append(f"<pre>{words('k', 5, 30, '')}</pre>")
            if chance(0.07):
                out.append(junk(pick(["advert", "share", "side", "form", "notice"])))
        if chance(0.15):  # paragraphs without elements
            return "".join(re.sub(r"</?p>", "<br><br>", x) for x in out)
        return "".join(out)

    def links(k: int) -> str:
        item = lambda: f'<a href="/x">{words("x", 1, 3, "")}</a>'
        return "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(k)) + "</ul>" if chance(0.7) else pick([" | ", " ", " · "]).join(item() for _ in range(k))

    def junk(kind: str) -> str:
        named = lambda *names: f' {pick(["class", "id"])}="{pick(names)}"' if chance(0.85) else ""
        text = lambda lo, hi: pick(["{}", "<p>{}</p>", "<span>{}</span>"]).format(words("x", lo, hi, pick([".", ""])))
        if kind == "menu":
            tag = pick(["nav", "nav", "div", "menu"])
            return f"<{tag}{named('nav', 'main-menu', 'menu', 'breadcrumbs', 'navbar', 'pagination')}>{links(rng.randint(2, 9))}</{tag}>"
        if kind == "header":
            tag = pick(["header", "header", "div"])
            return f"<{tag}{named('header', 'site-header', 'masthead', 'topbar', 'logo')}>{pick(['', '<h1>' + words('x', 1, 4, '') + '</h1>', text(1, 8)])}{links(rng.randint(1, 5)) if chance(0.6) else ''}</{tag}>"
        if kind == "footer":
            tag = pick(["footer", "footer", "div"])
            return f"<{tag}{named('footer', 'site-footer', 'copyright', 'legal')}>{pick(['&copy; ', '', '&copy; 2020 '])}{words('x', 1, 4, '')} &middot; {text(2, 25)}{links(3) if chance(0.4) else ''}</{tag}>"
        if kind == "side":
            tag = pick(["aside", "aside", "div", "section"])
            inner = pick([links(rng.randint(2, 6)), f"<h3>{words('x', 1, 4, '')}</h3>{links(3)}", f"<h3>{words('x', 1, 3, '')}</h3><p>{words('x', 5, 50)}</p>"])
            return f"<{tag}{named('sidebar', 'widget', 'related', 'recommended', 'right-rail', 'trending')}>{inner}</{tag}>"
        if kind == "advert":
            tag = pick(["div", "div", "aside", "section"])
            name = pick(["ad", "ads", "advert", "ad-slot", "sponsored", "promo", "banner-ad", "advertisement"])
            return f'<{tag} {pick(["class", "id"])}="{name}">{text(3, 40)}</{tag}>'
        if kind == "notice":
            return f'<div {pick(["class", "id"])}="{pick(["cookie-notice", "notice", "consent", "alert", "gdpr", "paywall", "popup"])}">{text(4, 40)}{"<button>" + words("x", 1, 2, "") + "</button>" if chance(0.6) else ""}</div>'
        if kind == "form":
            return f"<form{named('newsletter', 'search-form', 'login', 'subscribe', 'contact')}>{pick(['', '<h3>' + words('x', 1, 4, '') + '</h3>'])}<label>{words('x', 1, 4, '')}</label><input name=a><button>{words('x', 1, 2, '')}</button>{text(2, 12) if chance(0.4) else ''}</form>"
        if kind == "share":
            return f'<div class="{pick(["share", "social", "byline", "meta", "author", "tags"])}">{text(1, 6)}{links(2) if chance(0.4) else ""}</div>'
        each = pick(["div", "li", "article", "p"])
        inner = "".join(f'<{each} class="{pick(["comment", "comment-body", "reply"])}"><p>{words("x", 3, 60)}</p></{each}>' if each != "p" else f"<p>{words('x', 3, 60)}</p>" for _ in range(rng.randint(1, 5)))
        tag = pick(["section", "div", "div", "ul" if each == "li" else "div"])
        return f'<{tag} {pick(["id", "class"])}="{pick(["comments", "comment-list", "disqus_thread", "responses", "reader-comments", "discussion"])}">{"<h2>" + words("x", 1, 3, "") + "</h2>" if chance(0.6) and tag != "ul" else ""}{inner}</{tag}>'

    out = []
    for _ in range(n):
        holder = pick(['article', 'article', 'article', 'main', 'div class="content"', 'div id="main-content"', 'div class="post-body"', 'div class="entry-content"', 'div class="article-text"', 'section class="story"', "div", "div"])
        main = f"<{holder}>{content()}{junk('comment') if chance(0.08) else ''}</{holder.split()[0]}>"
        if chance(0.3):
            main = f"<{pick(['main', 'div', 'div class=wrapper', 'div id=page', 'section'])}>{junk('share') if chance(0.2) else ''}{main}{junk('comment') if chance(0.3) else ''}</div>"
        before = [junk(k) for k, p in (("menu", 0.8), ("header", 0.5), ("notice", 0.35), ("advert", 0.5), ("form", 0.2), ("side", 0.15)) if chance(p)]
        after = [junk(k) for k, p in (("share", 0.2), ("comment", 0.45), ("side", 0.5), ("advert", 0.25), ("form", 0.25), ("footer", 0.85), ("notice", 0.15)) if chance(p)]
        rng.shuffle(before)
        body = "".join(before) + main + "".join(after)
        page = Page(f"<html><head><title>x</title></head><body>{body}" + ("</body></html>" if chance(0.9) else ""))
        out.append((page, labels_of(page, lambda t: sum(w[:1] == "k" for w in t.split()) * 2 > len(t.split()))))
    return out


@lru_cache(1)
def default_model() -> Model:
    return train(labelled_pages())


_UNSEEN = re.compile(r"(?:^| )hidden=|style=[^=]*display\s*:\s*none", re.I)


def unseen(page: Page) -> list[bool]:
    """Nodes that are controls or that no reader sees: buttons, and what an attribute hides, with all below them."""
    out: list[bool] = []
    for tag, attrs, parent in zip(page.tags, page.attrs, page.parent):
        out.append(parent >= 0 and out[parent] or tag == "button" or bool(attrs) and _UNSEEN.search(attrs) is not None)
    return out


def main_text(pages: list[Page], model: Model, threshold: float = 0.5) -> list[str]:
    """Content blocks of each page in page order, joined by one space; none that is a button's or hidden."""
    out = []
    for page, p in zip(pages, model.marginals(pages)):
        gone = unseen(page)
        out.append(" ".join(t for node, t in page.blocks if p[node] >= threshold and not gone[node]))
    return out


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each page; the text is empty where nothing is content. No shuffle.

    Null html is empty. Repeated rows are rows. Very long pages are read whole, up to 128 of a batch at a time. An empty table gives an
    empty result. Further columns are ignored, whatever their names.
    """
    model = model or default_model()

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        out = []
        for i in range(0, len(column), 128):
            out += main_text([Page(x) for x in column.iloc[i : i + 128]], model)
        return pd.Series(out, dtype=object)

    text = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), run(F.coalesce(F.col(html_column), F.lit(""))).alias("text"))
    return text.withColumn("n_chars", F.length("text").cast("long"))
