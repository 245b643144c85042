"""Main text of web pages: boosted trees over DOM-node features, decoded along the tree.

Each page becomes a tree of block elements. Features of a node: text, link and punctuation density of its
subtree, attribute tokens of itself and its ancestors, depth, position and sibling statistics. Gradient-boosted
trees (Spark ML) give the probability that a node is content. Decoding picks the likeliest assignment in which
every node is wrapper, content or cut, where below content only content or cut may follow and below cut only
cut: ancestors and descendants can't contradict each other. Text counts where its block is content.

Labelled nodes are made here: in a bounded, seeded sample of pages, semantic elements tell content from the
rest; their pieces are also set anew in layouts with other elements, class names and additional parts
(sidebars, notices, forms, comments), whose labels are known by construction, so that the trees learn structure
and wording instead of one element name.

Defined results: null html counts as empty; a page without content gives an empty text and n_chars 0; repeated
rows are read each; unclosed, stray and cut-off tags are closed as browsers do, near enough; no step recurses,
so deep trees are safe; a table without labelled pages is decoded with the layouts' labels alone; further
columns are not read.
"""
from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import map_rows
from patronage.session import materialise

SAMPLE_PAGES = 300
ROUNDS = 30
DEPTH = 5

# Kinds of HTML elements and words in their attributes.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes xmp template".split())
INLINE = set("a abbr acronym b bdi bdo big button cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup "
             "time tt u var wbr br img picture source map area object output".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
               "main menu nav ol p pre section summary table ul".split())
CLOSED_BY = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
             "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
             "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "tr"}, {"table"}), "tfoot": ({"tbody", "tr", "td", "th"}, {"table"})}
NEVER = set("script style noscript head title template iframe object svg math select textarea button form input dialog canvas audio video noembed noframes".split())
GOOD_ELEMENTS = {"article", "main"}
BAD_ELEMENTS = set("nav footer aside form menu".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
GOOD_TOKENS = set("article articles content post entry story body main text page blog news document doc richtext prose paragraph body-text hentry instapaper".split())
BAD_TOKENS = set("nav navbar navigation menu menubar topbar footer foot header masthead sidebar side aside ad ads adv advert advertisement adverts banner promo "
                 "promoted sponsor sponsored cookie cookies consent gdpr notice alert popup modal overlay form login signup subscribe subscription newsletter "
                 "share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager widget tags meta toolbar search copyright "
                 "legal skip toc trending popular more".split())
COMMENT_TOKENS = set("comment comments commentlist disqus reply replies respond discussion reviews responses thread feedback".split())

FEATURES = ("own", "all", "share", "links", "children", "descendants", "density", "depth", "place", "siblings", "same", "around", "stops", "block_words", "good", "bad",
            "comment", "good_above", "bad_above", "comment_above", "good_element", "bad_element", "heading", "paragraph", "list", "box", "offset", "controls", "prose_beside", "header_element", "bad_element_itself")

_TAG_END = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|data-y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass
class Page:
    """Block elements in page order; node 0 is the root."""
    tag: list[str] = field(default_factory=lambda: ["#root"])
    parent: list[int] = field(default_factory=lambda: [-1])
    tokens: list[frozenset] = field(default_factory=lambda: [frozenset()])
    label: list[str] = field(default_factory=lambda: [""])
    links: list[int] = field(default_factory=lambda: [0])  # characters inside links, own text
    controls: list[int] = field(default_factory=lambda: [0])
    runs: list[tuple[int, str]] = field(default_factory=list)  # (block, text), one for each stretch between breaks


def parsed(source: str | None) -> Page:
    """The tree of block elements with their texts; scripts, styles and comments are gone."""
    page, text = Page(), source or ""
    stack: list[tuple[str, int]] = [("#root", 0)]  # open elements and their block
    parts: list[str] = []
    links = at = 0
    n = len(text)

    def flush() -> None:
        nonlocal links
        if parts:
            whole = " ".join("".join(parts).split())
            if whole:
                block = stack[-1][1]
                page.runs.append((block, whole))
                page.links[block] += min(links, len(whole))
            parts.clear()
        links = 0

    def close(upto: int) -> None:
        if any(t not in INLINE for t, _ in stack[upto:]):
            flush()
        del stack[upto:]

    while at < n:
        mark = text.find("<", at)
        if mark < 0:
            mark = n
        if mark > at:
            piece = html.unescape(text[at:mark]) if "&" in text[at:mark] else text[at:mark]
            parts.append(piece)
            if any(t == "a" for t, _ in stack[-4:]):
                links += len(piece.strip())
        if mark == n:
            break
        if text.startswith("<!--", mark):
            end = text.find("-->", mark + 4)
            at = n if end < 0 else end + 3
            continue
        if text[mark + 1:mark + 2] in ("!", "?"):
            end = text.find(">", mark)
            at = n if end < 0 else end + 1
            continue
        closing = text[mark + 1:mark + 2] == "/"
        name = _NAME.match(text, mark + 1 + closing)
        if not name:
            if closing:
                end = text.find(">", mark)
                at = n if end < 0 else end + 1
            else:
                parts.append("<")
                at = mark + 1
            continue
        tag = name.group().lower()
        end = _TAG_END.match(text, name.end())
        at = end.end() if end else (text.find(">", mark) + 1 or n)
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if tag in INLINE and stack[i][0] not in INLINE:
                    break
            continue
        if tag in RAW:
            end_at = _find_close(text, tag, at)
            at = end_at
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in CLOSES_P:
            _close_to(stack, {"p"}, {"table", "button", "object"} | {"td", "th"}, close)
        if tag in CLOSED_BY:
            _close_to(stack, *CLOSED_BY[tag], close)
        if tag in INLINE:
            if tag not in VOID:
                stack.append((tag, stack[-1][1]))
            continue
        flush()
        block = stack[-1][1]
        if tag in ("input",):
            page.controls[block] += 1
        if tag in VOID:
            continue
        attributes = {m.group(1).lower(): m.group(2) or m.group(3) or m.group(4) or "" for m in _ATTRIBUTE.finditer(text, name.end(), at)}
        page.tag.append(tag)
        page.parent.append(block)
        page.tokens.append(frozenset(t.lower() for k in ("class", "id", "role") if k in attributes for t in _TOKENS.findall(attributes[k])))
        page.label.append(attributes.get("data-y", ""))
        page.links.append(0)
        page.controls.append(0)
        stack.append((tag, len(page.tag) - 1))
    flush()
    return page


def _find_close(text: str, tag: str, at: int) -> int:
    found = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(text, at)
    return found.end() if found else len(text)


def _close_to(stack: list[tuple[str, int]], names: set[str], fence: set[str], close) -> None:
    """Close the open elements from the outermost of ``names`` inside the fence."""
    low = None
    for i in range(len(stack) - 1, 0, -1):
        if stack[i][0] in names:
            low = i
        elif stack[i][0] in fence or stack[i][0] in ("#root", "body", "article", "div", "section", "main") and low is None and names == {"p"}:
            break
    if low is not None:
        close(low)


def features(page: Page) -> np.ndarray:
    """nodes x FEATURES."""
    n = len(page.tag)
    tag, parent = page.tag, page.parent
    own, stops, blocks = [0] * n, [0] * n, [0] * n
    words, offset, upto = [0] * n, [0] * n, 0
    first_at: list[int | None] = [None] * n
    for block, text in page.runs:
        own[block] += len(text)
        stops[block] += sum(map(text.count, ".,;!?"))
        words[block] += text.count(" ") + 1
        blocks[block] += 1
        if first_at[block] is None:
            first_at[block] = upto
        upto += len(text)
    total = max(1, upto)
    everything, links, below, all_stops, all_words, all_blocks, controls = own[:], page.links[:], [0] * n, stops[:], words[:], blocks[:], page.controls[:]
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(n - 1, 0, -1):
        p = parent[i]
        everything[p] += everything[i]
        links[p] += links[i]
        below[p] += below[i] + 1
        all_stops[p] += all_stops[i]
        all_words[p] += all_words[i]
        all_blocks[p] += all_blocks[i]
        controls[p] += controls[i]
        if first_at[i] is not None and (first_at[p] is None or first_at[i] < first_at[p]):
            first_at[p] = first_at[i]
        children[p].append(i)
    depth, good_up, bad_up, com_up, good_el, bad_el, head_el = ([0] * n for _ in range(7))
    rows = np.zeros((n, len(FEATURES)))
    log = np.log1p
    prose = [sum(everything[c] for c in kids if tag[c] == "p") for kids in children]
    for i in range(n):
        p = parent[i]
        t, tokens = tag[i], page.tokens[i]
        good, bad, com = bool(tokens & GOOD_TOKENS), bool(tokens & BAD_TOKENS), bool(tokens & COMMENT_TOKENS)
        if p >= 0:
            depth[i] = depth[p] + 1
            good_up[i], bad_up[i], com_up[i] = good_up[p] or good, bad_up[p] or bad, com_up[p] or com
            good_el[i], bad_el[i], head_el[i] = good_el[p] or t in GOOD_ELEMENTS, bad_el[p] or t in BAD_ELEMENTS, head_el[p] or t == "header"
        kids = children[p] if p >= 0 else [i]
        size = everything[i]
        rows[i] = (own[i], size, size / total, links[i] / max(1, size), len(children[i]), below[i], size / (below[i] + 1), min(depth[i], 30),
                   0.0, len(kids), 0.0, (everything[p] - size) / max(1, len(kids) - 1) if p >= 0 else 0.0, 100 * all_stops[i] / max(1, size), all_words[i] / max(1, all_blocks[i]),
                   good, bad, com, good_up[i], bad_up[i], com_up[i], good_el[i], bad_el[i], t in HEADINGS, t == "p", t in ("li", "ul", "ol", "dl", "dd", "dt"),
                   t in ("div", "section", "body", "td"), (first_at[i] if first_at[i] is not None else total) / total, controls[i], prose[p] if p >= 0 else 0,
                   head_el[i], t in BAD_ELEMENTS)
    for kids in children:
        if kids:
            m, counts = len(kids), {}
            for c in kids:
                counts[tag[c]] = counts.get(tag[c], 0) + 1
            for k, c in enumerate(kids):  # kids are in falling order
                rows[c, 8] = (m - 1 - k) / max(1, m - 1)
                rows[c, 10] = counts[tag[c]] / m
    for k in (0, 1, 4, 5, 6, 9, 11, 13, 28):
        rows[:, k] = log(rows[:, k])
    return rows


@dataclass
class Trees:
    """Boosted trees as arrays: node k of a tree has children 2k + 1 and 2k + 2."""
    feature: np.ndarray  # trees x nodes
    limit: np.ndarray
    value: np.ndarray
    weight: np.ndarray
    depth: int

    def probability(self, rows: np.ndarray) -> np.ndarray:
        score = np.zeros(len(rows))
        each = np.arange(len(rows))
        for feature, limit, value, weight in zip(self.feature, self.limit, self.value, self.weight):
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (rows[each, feature[at]] > limit[at])
            score += weight * value[at]
        return 1.0 / (1.0 + np.exp(-2.0 * score))


_LINE = re.compile(r"(If|Else) \(feature (\d+) (<=|>) ([-0-9.eE]+)\)|Predict: ([-0-9.eE]+)")


def trees_of(model, depth: int = DEPTH) -> Trees:
    """The fitted trees, from the model's own description; leaves above the last level are passed down."""
    size = (1 << (depth + 1)) - 1
    count = len(model.treeWeights)
    feature, limit, value = np.zeros((count, size), np.int64), np.full((count, size), np.inf), np.zeros((count, size))
    tree, places = -1, []
    for line in model.toDebugString.splitlines():
        if re.match(r"\s*Tree \d+", line):
            tree, places = tree + 1, [0]
            continue
        m = _LINE.search(line)
        if not m or tree < 0:
            continue
        if m.group(5) is not None:
            below = [places.pop()]
            while below:
                k = below.pop()
                value[tree, k] = float(m.group(5))
                below += [c for c in (2 * k + 1, 2 * k + 2) if c < size]
        elif m.group(1) == "If":
            k = places.pop()
            feature[tree, k], limit[tree, k] = int(m.group(2)), float(m.group(4))
            places += [2 * k + 2, 2 * k + 1]
    return Trees(feature, limit, value, np.array(model.treeWeights), depth)


def decoded(page: Page, p: np.ndarray) -> list[bool]:
    """Whether each node is content, in the likeliest assignment without contradictions."""
    n, parent = len(page.tag), page.parent
    own = [0] * n
    for block, text in page.runs:
        own[block] += len(text)
    p = np.clip(p, 1e-4, 1 - 1e-4)
    never = [t in NEVER for t in page.tag]
    weight = 0.2 + np.log1p(own)
    yes, no = (np.log(p) * weight).tolist(), (np.log(1 - p) * weight).tolist()
    wrapper, content, cut = no[:], yes[:], no[:]
    for i in range(n - 1, 0, -1):
        up = parent[i]
        if never[i]:
            content[i] = wrapper[i] = float("-inf")
        wrapper[up] += max(wrapper[i], content[i], cut[i])
        content[up] += max(content[i], cut[i])
        cut[up] += cut[i]
    state = [0] * n  # 0 wrapper, 1 content, 2 cut
    for i in range(n):
        above = state[parent[i]] if i else 0
        if above == 2:
            state[i] = 2
        elif above == 1:
            state[i] = 1 if content[i] >= cut[i] else 2
        elif content[i] > max(wrapper[i], cut[i]):
            state[i] = 1
        else:
            state[i] = 0 if wrapper[i] >= cut[i] else 2
    return [s == 1 for s in state]


def main_text(page: Page, keep: list[bool]) -> str:
    return "\n\n".join(text for block, text in page.runs if keep[block])


# --- labelled nodes

def semantic_labels(page: Page) -> list[int] | None:
    """1 inside article or main, but not in menus, asides, forms and the like; None where the page has neither."""
    n = len(page.tag)
    inside, bad = [False] * n, [False] * n
    for i in range(1, n):
        p, t = page.parent[i], page.tag[i]
        inside[i] = inside[p] or t in GOOD_ELEMENTS
        bad[i] = bad[p] or t in NEVER or t in ("nav", "aside", "footer", "menu") or bool(page.tokens[i] & (COMMENT_TOKENS | {"ad", "ads", "share", "related", "cookie"}))
    if not any(inside):
        return None
    return [int(a and not b) for a, b in zip(inside, bad)]


def layout(paragraphs: list[str], short: list[str], rng: random.Random) -> str:
    """A page of other elements made of the given texts; data-y marks content."""
    pick = rng.choice
    esc = html.escape

    def some(k: int) -> list[str]:
        return [esc(pick(short)) for _ in range(k)]

    def links(k: int) -> str:
        return "".join(f'<li><a href="#">{s}</a></li>' for s in some(k))

    def box(names: list[str], inner: str, tags: tuple[str, ...] = ("div", "section")) -> str:
        t, name = pick(tags), pick(names)
        attribute = f' class="{name}"' if rng.random() < 0.6 else f' id="{name}"' if rng.random() < 0.8 else ""
        return f"<{t}{attribute}>{inner}</{t}>"

    def menu() -> str:
        return box(["menu", "navbar", "main-nav", "topNavigation", "nav-links"], f"<ul>{links(rng.randint(3, 9))}</ul>", ("div", "nav", "header"))

    def prose(k: int) -> str:
        return "".join(f"<p>{esc(pick(paragraphs))}</p>" for _ in range(k))

    def comments() -> str:
        return box(["comments", "comment-list", "disqus_thread", "user-comments", "replies"],
                   f"<h3>{pick(some(3))}</h3>" + "".join(box(["comment", "comment-body", "reply"], f"<b>{some(1)[0]}</b>{prose(rng.randint(1, 2))}", ("div", "li"))
                                                       for _ in range(rng.randint(1, 5))))

    extras = [
        lambda: box(["sidebar", "side-column", "widget-area"], f"<h3>{some(1)[0]}</h3><ul>{links(rng.randint(2, 6))}</ul>" + (prose(1) if rng.random() < 0.3 else ""), ("div", "aside")),
        lambda: box(["ad", "ads", "advert", "banner-ad", "sponsored"], esc(pick(short))),
        lambda: box(["cookie-notice", "consent", "notice", "gdpr-banner", "alert"], f"<p>{esc(pick(short))} {esc(pick(short))}</p><button>{some(1)[0]}</button>"),
        lambda: box(["newsletter", "subscribe", "signup"], f"<form><p>{esc(pick(short))}</p><input><button>{some(1)[0]}</button></form>"),
        lambda: box(["share", "social-links"], f"<ul>{links(3)}</ul>"),
        lambda: box(["related", "related-posts", "recommended"], f"<h3>{some(1)[0]}</h3><ul>{links(rng.randint(2, 5))}</ul>"),
        lambda: box(["breadcrumb", "breadcrumbs"], " &gt; ".join(f'<a href="#">{s}</a>' for s in some(3))),
        lambda: f"<form><label>{some(1)[0]}</label><input><p>{some(1)[0]}</p></form>",
    ]
    body = []
    k = rng.randint(1, 9)
    if rng.random() < 0.2:  # hardly any text
        paragraphs, k = short, rng.randint(1, 2)
    for i in range(k):
        body.append(f'<p data-y="1">{esc(pick(paragraphs))}</p>')
        r = rng.random()
        if r < 0.08:
            body.append(f'<h2 data-y="1">{some(1)[0]}</h2>')
        elif r < 0.14:
            body.append('<ul data-y="1">' + "".join(f'<li data-y="1">{s}</li>' for s in some(rng.randint(2, 5))) + "</ul>")
        elif r < 0.18:
            body.append(f'<blockquote data-y="1"><p data-y="1">{esc(pick(paragraphs))}</p></blockquote>')
        elif r < 0.21:
            cells = "".join('<tr data-y="1">' + "".join(f'<td data-y="1">{s}</td>' for s in some(3)) + "</tr>" for _ in range(rng.randint(2, 4)))
            body.append(f'<table data-y="1"><tbody data-y="1">{cells}</tbody></table>')
        elif r < 0.23:
            body.append(f'<pre data-y="1">{some(1)[0]}</pre>')
        elif r < 0.25:
            body.append(f'<figure data-y="1"><img><figcaption data-y="1">{some(1)[0]}</figcaption></figure>')
        elif r < 0.33:
            body.append(pick(extras)())
    title = f'<h1 data-y="1">{esc(pick(short))}</h1>'
    if rng.random() < 0.15:
        title = f'<header data-y="1">{title}<p data-y="1">{some(1)[0]}</p></header>'
    style = rng.random()
    inner = title + "".join(body)
    if rng.random() < 0.12:  # nothing but the text
        inner = "".join(f'<p data-y="1">{esc(pick(paragraphs))}</p>' for _ in range(rng.randint(1, 3))) if rng.random() < 0.7 else inner
        return f"<html><body>{inner}</body></html>"
    if rng.random() < 0.25:
        inner += pick((comments, extras[4], extras[5]))()
    if style < 0.35:
        main = f'<{(t := pick(("article", "main")))} data-y="1">{inner}</{t}>'
    elif style < 0.85:
        name = pick(["content", "post-content", "entry-content", "article-body", "story", "main-text", "post", "page-body", "x1", "wrap", "col-8", "container"])
        main = f'<div {pick(("class", "id"))}="{name}" data-y="1">{inner}</div>'
    else:
        main = f'<div data-y="1">{inner}</div>' if rng.random() < 0.6 else inner
    head = (box(["header", "masthead", "top"], f"<p>{some(1)[0]}</p>", ("header", "div")) if rng.random() < 0.5 else "") + (menu() if rng.random() < 0.85 else "")
    before, after = (("".join(pick(extras)() for _ in range(rng.randint(0, 2)))) for _ in range(2))
    tail = (comments() if rng.random() < 0.35 else "") + after + (box(["footer", "site-footer", "copyright", "legal"], f"&copy; {some(1)[0]} &middot; {esc(pick(short))}", ("footer", "div")) if rng.random() < 0.9 else "")
    middle = before + main + tail
    for name in ("container", "wrapper", "page", "site")[:rng.randint(0, 3)]:
        middle = f'<div {pick(("class", "id"))}="{name}">{middle}</div>'
    return f"<html><head><title>x</title></head><body>{head}{middle}</body></html>"


def labelled_nodes(source: str, seed: int, layouts: int = 4) -> Iterator[tuple[np.ndarray, list[int]]]:
    """(features, labels) of a page by its semantic elements, and of layouts made from its texts."""
    page = parsed(source)
    labels = semantic_labels(page)
    texts = [t for _, t in page.runs]
    if labels is not None:
        yield from [(features(page), labels)] * 2  # as it is, a page weighs twice
        texts = [t for b, t in page.runs if labels[b]] or texts
    paragraphs = [t for t in texts if len(t) > 60]
    short = [" ".join(t.split()[:8]) for t in texts if t] or ["more"]
    rng = random.Random(seed)
    for _ in range(layouts if paragraphs else 0):
        made = parsed(layout(paragraphs, short, rng))
        yield features(made), [int(y == "1") for y in made.label]


def train(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, rounds: int = ROUNDS, depth: int = DEPTH, seed: int = 42) -> Trees | None:
    """Fit the trees on the nodes of about ``sample_pages`` pages; None where no page has text."""
    from pyspark.ml.classification import GBTClassifier  # here, since tasks that only extract needn't load it
    from pyspark.ml.functions import array_to_vector

    rows = pages.select("page_id", "html").where(F.col("html").isNotNull())
    n = rows.count()
    share = min(1.0, sample_pages / n) if n else 0.0
    mark = F.pmod(F.xxhash64("page_id", "html", F.lit(seed)), F.lit(1 << 40))  # with the text: pages without id are drawn one by one

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            out: dict[str, list] = {"label": [], "features": []}
            for source, s in zip(batch["html"], batch["mark"]):
                for values, labels in labelled_nodes(source, s):
                    out["label"] += [float(y) for y in labels]
                    out["features"] += values.tolist()
                if len(out["label"]) > 10_000:
                    yield out
                    out = {"label": [], "features": []}
            yield out

    sample = rows.select("html", mark.alias("mark")).where(F.col("mark") < F.lit(share * (1 << 40)))
    nodes = materialise(map_rows(sample, "label double, features array<double>", work), "dom-nodes")
    if nodes.select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, maxBins=64, stepSize=0.3, seed=seed).fit(
        nodes.select("label", array_to_vector("features").alias("features")).coalesce(4))
    return trees_of(model, depth)


def extracted(source: str | None, trees: Trees | None) -> str:
    page = parsed(source)
    if not page.runs:
        return ""
    p = trees.probability(features(page)) if trees is not None else np.full(len(page.tag), 0.9)
    return main_text(page, decoded(page, p))


def main_texts(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    trees = train(pages) if trees is None else trees
    shared = pages.sparkSession.sparkContext.broadcast(trees)

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            for a in range(0, len(batch["page_id"]), 256):
                parsed_pages = [parsed(h) for h in batch["html"][a:a + 256]]
                rows = [features(p) for p in parsed_pages]
                chance = shared.value.probability(np.concatenate(rows)) if shared.value is not None else np.full(sum(map(len, rows)), 0.9)
                texts, upto = [], 0
                for p, r in zip(parsed_pages, rows):
                    texts.append(main_text(p, decoded(p, chance[upto:upto + len(r)])))
                    upto += len(r)
                yield {"page_id": batch["page_id"][a:a + 256], "url": batch["url"][a:a + 256], "text": texts, "n_chars": list(map(len, texts))}

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return map_rows(rows, "page_id long, url string, text string, n_chars long", work)
