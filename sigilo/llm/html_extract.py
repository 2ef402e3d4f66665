"""HTML extraction: a recurrent labeller of text blocks.

A page is a sequence of leaf blocks in page order, each with its tag path and
text. A block's input is a hashed tag path (tags and words of class, id and
role), a hashed word vector and a few shapes (length, share of link text,
digits, punctuation). A bidirectional LSTM in numpy reads the whole sequence
and labels every block; the main text is the blocks labelled as content.

The model is trained here, from a fixed seed, on generated layouts and on a
bounded sample of the given pages, whose blocks are labelled where the tags or
classes of what they stand in leave no doubt. An element that holds most of a
page's text, as a body or a wrapper does, is no boilerplate whatever its theme
calls it: such words are left out before anything is learned or labelled. A share of these pages is shown with neutral tags
and names, so that text, place and neighbours are learned too. The model does
not depend on the order of the rows.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATH_DIMS, WORD_DIMS, SHAPES, HIDDEN = 64, 24, 8, 16
INPUT = PATH_DIMS + WORD_DIMS + SHAPES
#: Bounds of training: pages of the table, blocks of each that are learned from, generated pages, steps, pages per step.
SAMPLE_PAGES, SAMPLE_BLOCKS, LAYOUTS, STEPS, BATCH = 64, 200, 320, 240, 24
#: The share of training pages that are shown with neutral tags and names, so that text and neighbours must tell.
UNNAMED = 0.3
#: Characters of a page that training may take; the share of an element's parent in its path vector.
SAMPLE_CHARS, DECAY = 262_144, 0.9
SEED = 11

#: Fixed values of HTML: elements without end tag, of raw text, and set within a line.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Of the elements of raw text these end with the page if they are never closed; the others then hold ordinary markup.
TO_THE_END = ("script", "style", "textarea")
RAW = ("script", "style", "template", "noscript", "iframe", "svg", "math", "object", "canvas", "textarea", "select")
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
#: Elements that end an open paragraph or an open item of their own kind.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "article", "section", "div", "body", "nav", "aside", "main", "footer", "header", "form", "td", "th", "blockquote"}
OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
MARK = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
NAME = re.compile(r"[a-z]+")

#: Words of tags, classes, ids and roles that leave no doubt.
BOILERPLATE = set(
    "nav navigation navbar menu header masthead footer aside sidebar widget ad ads advert advertisement sponsor sponsored promo banner notice alert cookie consent gdpr popup modal "
    "form login search newsletter subscribe signup comment comments reply replies discussion disqus related share social breadcrumb breadcrumbs pagination pager copyright legal contentinfo complementary toolbar tags"
    .split()
)
CONTENT = set("article main content post entry story body text articlebody prose page".split())


class Tags:
    """The tags of a page, found in time linear in its length, however broken it is."""

    def __init__(self, source: str) -> None:
        self.source = source
        #: Places outside quotes from which no tag ends, and spans without any mark.
        self.dead: set[int] = set()
        self.clear = (0, -1)
        self.plain = (0, -1)

    def mark(self, at: int) -> int:
        """The next mark from ``at`` on, or the end."""
        if not self.clear[0] <= at <= self.clear[1]:
            m = MARK.search(self.source, at)
            self.clear = (at, m.start() if m else len(self.source))
        return self.clear[1]

    def close(self, at: int) -> int:
        """The next ``>`` from ``at`` on, quotes or not, or the end."""
        if not self.plain[0] <= at <= self.plain[1]:
            k = self.source.find(">", at)
            self.plain = (at, k if k >= 0 else len(self.source))
        return self.plain[1]

    def end(self, at: int) -> int:
        """Where the tag whose name ends at ``at`` is closed: beyond quoted values, or at any ``>`` where a quote stays open."""
        seen, p, n = [], at, len(self.source)
        while p not in self.dead:
            seen.append(p)
            k = self.mark(p)
            if k < n and self.source[k] == ">":
                return k
            quote = self.source.find(self.source[k], k + 1) if k < n else -1
            if quote < 0:
                break
            p = quote + 1
        self.dead.update(seen)
        return self.close(at)

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(begin, end, name, whether it closes, attributes) of the first tag from ``at`` on; comments have no name."""
        m = OPEN.search(self.source, at)
        if m is None:
            return None
        n = len(self.source)
        if m[1]:
            k = self.source.find("-->", m.end())
            return m.start(), n if k < 0 else k + 3, "", False, ""
        k = self.close(m.end()) if m[2] else self.end(m.end())
        return None if k >= n else (m.start(), k + 1, (m[4] or "").lower(), m[3] == "/", self.source[m.end() : k])


class Node:
    """An element: its tag and the words of its class, id and role, joined by blanks, and the element it stands in."""

    __slots__ = ("element", "hidden", "parent", "tag")

    def __init__(self, element: str, parent: Node | None = None) -> None:
        self.element, self.parent = element, parent
        self.tag = element.split(" ", 1)[0]
        self.hidden = self.tag in ("head", "title") or parent is not None and parent.hidden

    def child(self, *elements: str) -> Node:
        node = self
        for e in elements:
            node = Node(e, node)
        return node

    def up(self) -> Iterator[Node]:
        """The element and all that it stands in."""
        node: Node | None = self
        while node is not None:
            yield node
            node = node.parent


Block = tuple[Node, str, int]


class Open:
    """The elements that are open, with the places of each name, so that no tag looks at more of them than it closes."""

    def __init__(self) -> None:
        self.stack: list[Node] = []
        self.at: dict[str, list[int]] = {}
        #: Places of elements that are not set within a line, and of those that an open paragraph or item does not reach beyond.
        self.blocks: list[int] = []
        self.scopes: list[int] = []

    def push(self, element: str) -> None:
        node, place = Node(element, self.stack[-1] if self.stack else None), len(self.stack)
        self.stack.append(node)
        self.at.setdefault(node.tag, []).append(place)
        if node.tag not in INLINE:
            self.blocks.append(place)
        if node.tag in SCOPE:
            self.scopes.append(place)

    def last(self, name: str) -> int:
        own = self.at.get(name)
        return own[-1] if own else -1

    def pop(self, to: int) -> None:
        while len(self.stack) > to:
            place, node = len(self.stack) - 1, self.stack.pop()
            self.at[node.tag].pop()
            for places in (self.blocks, self.scopes):
                if places and places[-1] == place:
                    places.pop()

    def close(self, name: str) -> None:
        """An end tag; one within a line closes nothing beyond the block it stands in."""
        place = self.last(name)
        if place >= 0 and (name not in INLINE or place > (self.blocks[-1] if self.blocks else -1)):
            self.pop(place)

    def make_room(self, name: str) -> None:
        """Ends the open paragraph, and an open item of the kind that ``name`` ends."""
        place = max(self.last(n) for n in ("p", *CLOSES.get(name, ())))
        if place >= 0 and place >= (self.scopes[-1] if self.scopes else -1):
            self.pop(place)


def blocks(page: str | None) -> list[Block]:
    """(element, text, characters inside links) of every leaf block, in page order, in time linear in the page.

    Character references are decoded and white space is one blank.
    """
    source, out = page or "", []
    opened = Open()
    buffer: list[str] = []
    where: Node | None = None
    linked, at = 0, 0
    unclosed: set[str] = set()
    top = Node("")

    def add(raw: str) -> None:
        nonlocal where, linked
        if raw:
            if where is None and not raw.isspace():
                where = opened.stack[-1] if opened.stack else top
            buffer.append(raw)
            if opened.last("a") >= 0:
                linked += len(raw.strip())

    def flush() -> None:
        nonlocal where, linked
        text = " ".join(html.unescape("".join(buffer)).split())
        if text:
            out.append((where or top, text, min(linked, len(text))))
        buffer.clear()
        where, linked = None, 0

    tags = Tags(source)
    while tag := tags.next(at):
        begin, end_at, name, closing, rest = tag
        add(source[at:begin])
        at = end_at
        if not name:
            continue
        if name not in INLINE:
            flush()
        if name == "br":
            buffer.append(" ")
        if closing:
            opened.close(name)
            continue
        if name in VOID or rest.endswith("/") and name in RAW:
            continue
        if name in RAW and name not in unclosed:
            end = re.compile(rf"</{name}\b", re.IGNORECASE).search(source, at)
            if end:
                at = min(tags.close(end.end()) + 1, len(source))
                continue
            unclosed.add(name)
        if name in RAW and name in TO_THE_END:
            at = len(source)
            continue
        if name not in INLINE:
            opened.make_room(name)
        words = [name]
        for a in ATTRIBUTE.finditer(rest):
            words += NAME.findall((a[2] or a[3] or a[4] or "").lower())
        opened.push(" ".join(words))
    add(source[at:])
    flush()
    return [b for b in out if not b[0].hidden]


def tells(node: Node) -> int:
    """1 content, 0 boilerplate, -1 neither or both, by an element's own tag and words."""
    words = set(node.element.split(" ")[1:])
    content, other = bool(words & CONTENT), bool(words & BOILERPLATE)
    if node.tag in BOILERPLATE:
        return 0
    if node.tag in ("article", "main"):
        return -1 if other else 1
    return -1 if content == other or node.tag in ("html", "body") else int(content)


def tidied(page: list[Block]) -> dict[Node, str]:
    """The elements of a page as they are read: without words of boilerplate where they hold most of the page.

    That is an element with more than half of the page's text that is or holds
    content, and the one article or main element of the most text if its words
    say both.
    """
    size: dict[Node, int] = {}
    order: list[Node] = []
    for node, text, _ in page:
        fresh = []
        for n in node.up():
            if n in size:
                break
            fresh.append(n)
        for n in reversed(fresh):  # what an element stands in comes before it
            size[n] = 0
            order.append(n)
        size[node] += len(text)
    holds: set[Node] = set()
    for n in reversed(order):
        if tells(n) == 1 or n.tag in ("article", "main"):
            holds.add(n)
        if n.parent is not None:
            size[n.parent] += size[n]
            if n in holds:
                holds.add(n.parent)
    whole = sum(len(text) for _, text, _ in page)
    largest = max((n for n in order if n.tag in ("article", "main")), key=lambda n: size[n], default=None)
    out = {}
    for n in order:
        mixed = n is largest and bool(set(n.element.split(" ")[1:]) & CONTENT)
        clean = n.tag in ("html", "body") or n in holds and 2 * size[n] > whole or mixed
        out[n] = " ".join(w for k, w in enumerate(n.element.split(" ")) if not (clean and w in BOILERPLATE and (k or size[n] * 2 > whole))) if clean else n.element
    return out


_hashes: dict[str, int] = {}


def hashed(word: str) -> int:
    h = _hashes.get(word)
    if h is None:
        if len(_hashes) > 200_000:
            _hashes.clear()
        h = _hashes[word] = zlib.crc32(word.encode("utf-8", "replace"))
    return h


def features(page: list[Block]) -> np.ndarray:
    """The input vectors of a page's blocks."""
    x = np.zeros((len(page), INPUT), dtype=np.float32)
    element = tidied(page)
    vectors: dict[Node, np.ndarray] = {}

    def of(node: Node) -> np.ndarray:
        """An element's words, and in lesser share those of all that it stands in."""
        fresh = []
        for n in node.up():
            if n in vectors:
                break
            fresh.append(n)
        for n in reversed(fresh):
            v = vectors[n.parent] * np.float32(DECAY) if n.parent is not None else np.zeros(PATH_DIMS, dtype=np.float32)
            for word in element[n].split(" "):
                h = hashed(word)
                v[h % PATH_DIMS] += 1.0 if h & 0x10000 else -1.0
            vectors[n] = v
        return vectors[node]

    for k, (node, text, linked) in enumerate(page):
        x[k, :PATH_DIMS] = np.clip(of(node), -2, 2)
        words = text.split(" ")
        counts = np.bincount([hashed(w) % WORD_DIMS for w in words], minlength=WORD_DIMS)
        x[k, PATH_DIMS : PATH_DIMS + WORD_DIMS] = counts / np.sqrt((counts**2).sum())
        n = len(text)
        x[k, PATH_DIMS + WORD_DIMS :] = (
            np.log1p(n) / 8, linked / n, min(1, len(words) / 50), sum(text.count(c) for c in ".,;:!?") / n * 5, text.endswith((".", "!", "?")),
            node.tag in ("h1", "h2", "h3"), k / len(page), 1.0,
        )
    return x


def sure_labels(page: list[Block]) -> list[int]:
    """1 content, 0 boilerplate, -1 unknown of every block, by the elements it stands in as ``tidied`` has them."""
    element = tidied(page)
    said = {n: tells(Node(e)) if e else -1 for n, e in element.items()}
    out = []
    for node, *_ in page:
        own = {said[n] for n in node.up()}
        out.append(0 if 0 in own else 1 if 1 in own else -1)
    return out


def sure_label(node: Node) -> int:
    """``sure_labels`` of a block by itself."""
    return sure_labels([(node, "x", 0)])[0]


def layout(rng: np.random.Generator) -> tuple[list[Block], list[int]]:
    """A generated page as blocks, and its labels."""
    syllables = "an er th on re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve que ción sch ung aux ment eau".split()
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    text = lambda lo, hi: " ".join(word() for _ in range(rng.integers(lo, hi))).capitalize() + rng.choice([".", ".", "", "!"])
    names = lambda pool: " ".join(rng.choice(sorted(pool), rng.integers(1, 3)))
    out: list[Block] = []
    labels: list[int] = []
    top = Node("html").child("body")
    if rng.random() >= 0.6:
        top = top.child("div " + str(rng.choice(["wrapper", "container", "page", "site"])))

    def put(path: Node, s: str, linked: bool, label: int) -> None:
        out.append((path, s, len(s) if linked else 0))
        labels.append(label)

    def boiler(path: Node) -> None:
        kind = rng.integers(0, 5)
        tag = str(rng.choice(["nav", "header", "footer", "aside", "form", "div", "section", "ul", "div"]))
        own = tag if tag in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.6 else f"{tag} {names(BOILERPLATE)}"
        path = path.child(own)
        if kind == 0:
            for _ in range(rng.integers(2, 9)):
                put(path.child("ul", "li", "a"), text(1, 3).rstrip(".!"), True, 0)
        elif kind == 1:
            put(path.child("p") if rng.random() < 0.5 else path, text(2, 40), False, 0)
        elif kind == 2:
            for _ in range(rng.integers(1, 5)):
                put(path.child("div", "p"), text(3, 60), False, 0)
        elif kind == 3:
            put(path.child("h3"), text(1, 4), False, 0)
            put(path.child("p"), text(4, 30), rng.random() < 0.3, 0)
        else:
            put(path, text(2, 12), rng.random() < 0.5, 0)

    for _ in range(rng.integers(1, 4)):
        boiler(top)
    style = rng.integers(0, 4)
    body = top.child("article" if style < 2 else "main" if style == 2 else f"div {names(CONTENT)}")
    if rng.random() < 0.3:
        body = body.child(f"div {names(CONTENT)}")
    if rng.random() < 0.8:
        put(body.child("h1"), text(2, 12), False, 1)
    for _ in range(rng.integers(1, 30)):
        r = rng.random()
        if r < 0.72:
            put(body.child("p") if rng.random() < 0.9 else body.child("p", "b"), text(1, 90) if rng.random() < 0.8 else text(1, 4), False, 1)
        elif r < 0.8:
            put(body.child("h2"), text(1, 7), False, 1)
        elif r < 0.86:
            put(body.child("blockquote", "p"), text(4, 40), False, 1)
        elif r < 0.95:
            for _ in range(rng.integers(1, 6)):
                put(body.child("ul", "li"), text(1, 15), rng.random() < 0.1, 1)
        else:
            boiler(body)
    for _ in range(rng.integers(1, 4)):
        boiler(top if rng.random() < 0.8 else body)
    return out, labels


def initial(rng: np.random.Generator) -> dict[str, np.ndarray]:
    p = {}
    for side in "fb":
        p[f"wx_{side}"] = rng.standard_normal((INPUT, 4 * HIDDEN)) / np.sqrt(INPUT)
        p[f"wh_{side}"] = rng.standard_normal((HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)
        p[f"b_{side}"] = np.concatenate((np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)))
    p["out"] = rng.standard_normal(2 * HIDDEN) / np.sqrt(2 * HIDDEN)
    p["bias"] = np.zeros(1)
    return p


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def lstm(p: dict[str, np.ndarray], side: str, x: np.ndarray, mask: np.ndarray, record: bool = False) -> tuple[np.ndarray, list[tuple]]:
    """States (steps x pages x HIDDEN) of one direction, and what ``back`` needs if it is to be recorded; padding keeps the state."""
    steps, pages = x.shape[:2]
    z_in = x @ p[f"wx_{side}"] + p[f"b_{side}"]
    h, c = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
    states, tape = np.zeros((steps, pages, HIDDEN)), [()] * steps if record else []
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        z = z_in[t] + h @ p[f"wh_{side}"]
        s, g = sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        new = f * c + i * g
        tanh = np.tanh(new)
        m = mask[t][:, None]
        if record:
            tape[t] = (h, c, i, f, o, g, tanh, m)
        h, c = np.where(m, o * tanh, h), np.where(m, new, c)
        states[t] = h
    return states, tape


def back(p: dict[str, np.ndarray], side: str, x: np.ndarray, tape: list[tuple], d_states: np.ndarray, grad: dict[str, np.ndarray]) -> None:
    """Adds the gradients of one direction."""
    steps, pages = x.shape[:2]
    dh, dc = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
    dz_all = np.zeros((steps, pages, 4 * HIDDEN))
    for t in range(steps - 1, -1, -1) if side == "f" else range(steps):
        h, c, i, f, o, g, tanh, m = tape[t]
        dh = dh + d_states[t]
        d = np.where(m, dh, 0)
        dnew = np.where(m, dc, 0) + d * o * (1 - tanh**2)
        dz = np.concatenate((dnew * g * i * (1 - i), dnew * c * f * (1 - f), d * tanh * o * (1 - o), dnew * i * (1 - g**2)), axis=1)
        dz_all[t] = dz
        grad[f"wh_{side}"] += h.T @ dz
        dh = np.where(m, 0, dh) + dz @ p[f"wh_{side}"].T
        dc = np.where(m, dnew * f, dc)
    grad[f"wx_{side}"] += np.einsum("tpi,tpo->io", x, dz_all, optimize=True)
    grad[f"b_{side}"] += dz_all.sum(axis=(0, 1))


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(x) for x in pages)
    x, mask = np.zeros((steps, len(pages), INPUT), dtype=np.float32), np.zeros((steps, len(pages)), dtype=bool)
    for k, own in enumerate(pages):
        x[: len(own), k], mask[: len(own), k] = own, True
    return x, mask


def unnamed(node: Node) -> Node:
    """An element without names, and without the tags that tell by themselves, and so all that it stands in."""
    out: Node | None = None
    for n in reversed(list(node.up())):
        out = Node("div" if n.tag in BOILERPLATE or n.tag in CONTENT or n.tag == "section" else n.tag, out)
    return out


def train(pages: list[list[Block]], steps: int = STEPS, layouts: int = LAYOUTS) -> dict[str, np.ndarray]:
    """Parameters fitted by Adam on generated layouts and on the given pages' sure blocks."""
    rng = np.random.default_rng(SEED)
    data = []
    for _ in range(layouts):
        page, labels = layout(rng)
        if rng.random() < UNNAMED:
            page = [(unnamed(path), text, linked) for path, text, linked in page]
        data.append((features(page), np.array(labels)))
    for page in pages:
        if page:  # the first blocks of training pages alone; labelling always reads whole pages
            labels, x = np.array(sure_labels(page)), features(page)
            page, labels, x = page[:SAMPLE_BLOCKS], labels[:SAMPLE_BLOCKS], x[:SAMPLE_BLOCKS]
            data.append((x, labels))
            if rng.random() < UNNAMED:
                data.append((features([(unnamed(path), text, linked) for path, text, linked in page]), labels))
    p = initial(rng)
    m, v = {k: np.zeros_like(w) for k, w in p.items()}, {k: np.zeros_like(w) for k, w in p.items()}
    lengths = np.argsort([len(d[0]) for d in data], kind="stable")
    for step in range(1, steps + 1):
        at = rng.integers(0, max(1, len(data) - BATCH + 1))
        chosen = [data[k] for k in lengths[at : at + BATCH]]
        x, mask = padded([c[0] for c in chosen])
        y = np.full(mask.shape, -1)
        for k, c in enumerate(chosen):
            y[: len(c[1]), k] = c[1]
        fs, ft = lstm(p, "f", x, mask, True)
        bs, bt = lstm(p, "b", x, mask, True)
        both = np.concatenate((fs, bs), axis=2)
        d = np.where(mask & (y >= 0), sigmoid(both @ p["out"] + p["bias"]) - y, 0) / max(1, (y >= 0).sum())
        grad = {k: np.zeros_like(w) for k, w in p.items()}
        grad["out"], grad["bias"] = np.einsum("tp,tph->h", d, both), np.array([d.sum()])
        ds = d[:, :, None] * p["out"]
        back(p, "f", x, ft, ds[:, :, :HIDDEN], grad)
        back(p, "b", x, bt, ds[:, :, HIDDEN:], grad)
        norm = np.sqrt(sum((g**2).sum() for g in grad.values()))
        rate = 0.03 * min(1.0, 1.5 - 1.4 * step / steps)
        for k, g in grad.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g**2
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return p


def label(p: dict[str, np.ndarray], pages: list[np.ndarray]) -> list[np.ndarray]:
    """The probability of content of every block; pages of like length are read together."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
    lo = 0
    while lo < len(order):
        hi = min(len(order), lo + max(1, min(128, 60_000 // len(pages[order[lo]]))))
        own = order[lo:hi]
        x, mask = padded([pages[k] for k in own])
        both = np.concatenate((lstm(p, "f", x, mask)[0], lstm(p, "b", x, mask)[0]), axis=2)
        prob = sigmoid(both @ p["out"] + p["bias"])
        for j, k in enumerate(own):
            out[k] = prob[: len(pages[k]), j]
        lo = hi
    return out


def sample_pages(pages: DataFrame, html_col: str, n: int) -> list[str]:
    """``n`` pages of bounded length at most, by a hash of their html."""
    rows = pages.filter(F.length(html_col) <= SAMPLE_CHARS).select(F.col(html_col).alias("html"))
    kept = rows.withColumn("h", F.xxhash64("html")).orderBy("h", "html").limit(n)
    return [r.html for r in kept.collect()]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample: int = SAMPLE_PAGES) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_content of every page.

    Null and empty pages have an empty text. Whole pages are read, however
    long; blocks labelled as content are joined in page order by a line feed.
    Repeated rows give equal rows, null ids and null urls too; ties at one half
    are content; other columns, whatever their names, are ignored. With no
    pages to learn from, the generated layouts alone train the model.
    """
    model = train([blocks(h) for h in sample_pages(pages, html_col, sample)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                found = [blocks(h) for h in part.column(2).to_pylist()]
                probs = label(model, [features(b) for b in found])
                texts = ["\n".join(b[1] for b, q in zip(own, prob, strict=True) if q >= 0.5) for own, prob in zip(found, probs, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:2], pa.array(texts, pa.string()), *[pa.array(c, pa.int64()) for c in ([len(t) for t in texts], [len(b) for b in found], [int((q >= 0.5).sum()) for q in probs])]],
                    ["page_id", "url", "text", "n_chars", "n_blocks", "n_content"],
                )

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_content long")
