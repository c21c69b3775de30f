"""Main text of web pages: a recurrent network labels every block with the whole page in view.

A page becomes a sequence of leaves: runs of text that no block element interrupts, each with its tag path (tags, class and
id words of the open block elements). A leaf's vector holds its hashed path, its hashed words and a few measures (length,
link share, place in the page). A bidirectional LSTM in numpy reads the sequence both ways and gives each leaf the chance
that it is part of the article; leaves from one half on are kept.

The network is trained anew for each run, with fixed seeds, on at most ``rows`` pages of the table (those with the least
hash of their html). Their leaves get first labels by the roles in their paths, and each page is laid out again in several
other ways: the article in other containers, with menus, notices, sidebars, forms, adverts and reader comments around and
inside it, whose labels are known as they were put there. Training looks at no page longer than ``SEGMENT`` leaves at once;
extraction reads whole pages.

Defined results: null and empty html have an empty text; white space, that of character references included, becomes one
blank; a line break element is white space; broken markup is read as far as it goes; null page_id and url stay; repeated
rows give repeated results; other columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
import re
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidewatch.llm.common import map_rows, pick

ROWS = 160
SEGMENT = 64
HIDDEN = 16
PATH_BINS, WORD_BINS, MEASURES = 256, 64, 8
WIDTH = PATH_BINS + WORD_BINS + MEASURES
#: Leaves times pages that are padded to one array at once.
PADDED = 20_000

#: Elements that do not end a block. Fixed values.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
#: Elements whose text is never shown, or not as text. Fixed values.
HIDDEN_TEXT = frozenset("script style noscript template textarea svg math iframe object select option canvas".split())
#: Elements without content. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a new element of the set on the right ends. Fixed values.
ENDS = {
    "p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "head": {"body"},
}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[a-z]+")


class Leaf(NamedTuple):
    path: str
    text: str
    linked: float


def leaves(html: str | None) -> list[Leaf]:
    """Text leaves of a page, in order."""
    found: list[Leaf] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    linked, links = 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append(Leaf(">".join(s for _, s in stack), text, min(1.0, linked / len(text))))
            parts.clear()
            linked = 0

    html = html or ""
    at = 0
    while at < len(html):
        m = _TAG.search(html, at)
        chunk = html[at : m.start()] if m else html[at:]
        if chunk:
            chunk = unescape(chunk)
            parts.append(chunk)
            if links:
                linked += len(chunk.strip())
        if not m:
            break
        at = m.end()
        if m[1]:
            parts.append(m[1])
        closing, name, rest = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not name:
            continue
        name = name.lower()
        if name == "a":
            links = max(0, links + (-1 if closing else 1))
        if name == "br":
            parts.append(" ")
        if name in INLINE:
            continue
        flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    links = 0
                    break
            continue
        if name in HIDDEN_TEXT and not rest.rstrip().endswith("/"):
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        while stack and stack[-1][0] in ENDS and (ENDS[stack[-1][0]] is None or name in ENDS[stack[-1][0]]):
            stack.pop()
        if name not in VOID and not rest.rstrip().endswith("/"):
            words = [w for a in _ATTRIBUTE.finditer(rest) for w in _NAME.findall((a[2] or a[3] or a[4] or "").lower())]
            stack.append((name, ".".join([name, *words])))
    flush()
    return found


#: Words in a path that say what a part of a page is for. Fixed values.
BODY_ROLES = frozenset("article main content post entry story body".split())
OTHER_ROLES = frozenset(
    "nav header footer aside form ad ads advert sidebar menu comment comments cookie notice banner promo related share social "
    "breadcrumb head title popup newsletter subscribe login search pagination tags widget sponsor consent".split()
)


def first_label(leaf: Leaf) -> int:
    """1 for leaves below a body role that no other role is below."""
    label = 0
    for step in leaf.path.split(">"):
        words = step.split(".")
        # The body element itself says nothing.
        own = {w for k, w in enumerate(words) if not (k == 0 and w == "body")}
        if own & OTHER_ROLES and not (label and words[0] == "header"):
            return 0
        if own & BODY_ROLES:
            label = 1
    return label


@lru_cache(maxsize=20_000)
def _path_bins(path: str) -> tuple[int, ...]:
    steps = path.split(">")
    names = set()
    for step in steps:
        words = step.split(".")
        names.add("t:" + words[0])
        names.update("w:" + w for w in words[1:])
    names.add("last:" + steps[-1].split(".")[0])
    names.update(f"pair:{a.split('.')[0]}>{b.split('.')[0]}" for a, b in zip(steps[-3:], steps[-2:]))
    return tuple(sorted({xxhash.xxh32_intdigest(n) % PATH_BINS for n in names}))


def vectors(page: list[Leaf]) -> np.ndarray:
    out = np.zeros((len(page), WIDTH), np.float32)
    for k, leaf in enumerate(page):
        row = out[k]
        row[list(_path_bins(leaf.path))] = 1
        words = leaf.text.lower().split()
        bins = [PATH_BINS + xxhash.xxh32_intdigest(w) % WORD_BINS for w in words]
        np.add.at(row, bins, 1 / len(bins) ** 0.5)
        marks = sum(leaf.text.count(c) for c in ".,;:!?")
        row[-MEASURES:] = (
            min(3.0, np.log10(len(leaf.text) + 1)), leaf.linked, min(2.0, 10 * marks / len(leaf.text)), k / len(page),
            min(1.0, len(words) / 40), leaf.text[-1] in ".!?", k == 0, k == len(page) - 1,
        )
    return out


class Net(NamedTuple):
    """Two LSTMs (input, recurrent and bias weights for each direction) and the output weights."""

    wx: tuple[np.ndarray, np.ndarray]
    wh: tuple[np.ndarray, np.ndarray]
    b: tuple[np.ndarray, np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def flat(self) -> list[np.ndarray]:
        return [*self.wx, *self.wh, *self.b, self.out, self.bias]


def new_net(seed: int) -> Net:
    r = np.random.default_rng(seed)
    make = lambda a, b: (r.standard_normal((a, b)) / a**0.5).astype(np.float32)
    forget = np.zeros(4 * HIDDEN, np.float32)
    forget[HIDDEN : 2 * HIDDEN] = 1
    return Net(
        (make(WIDTH, 4 * HIDDEN), make(WIDTH, 4 * HIDDEN)), (make(HIDDEN, 4 * HIDDEN), make(HIDDEN, 4 * HIDDEN)),
        (forget.copy(), forget.copy()), make(2 * HIDDEN, 1)[:, 0], np.zeros(1, np.float32),
    )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _turned(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each sequence back to front within its own length."""
    t = np.arange(x.shape[1])
    index = np.where(t < lengths[:, None], lengths[:, None] - 1 - t, t)
    return np.take_along_axis(x, index[:, :, None] if x.ndim == 3 else index, axis=1)


def _run(z: np.ndarray, wh: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (pages, steps, HIDDEN) from the projected inputs ``z``."""
    n, steps, _ = z.shape
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    out = np.empty((n, steps, HIDDEN), np.float32)
    for t in range(steps):
        a = z[:, t] + h @ wh
        gates = _sigmoid(a[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(a[:, 3 * HIDDEN :])
        if keep is not None:
            keep.append((h, c, i, f, o, g))
        c = f * c + i * g
        h = o * np.tanh(c)
        out[:, t] = h
    return out


def _back(dh_all: np.ndarray, kept: list, wh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of ``wh``."""
    n, steps, _ = dh_all.shape
    dz, dwh = np.empty((n, steps, 4 * HIDDEN), np.float32), np.zeros_like(wh)
    dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g = kept[t]
        dh = dh + dh_all[:, t]
        new = f * c + i * g
        th = np.tanh(new)
        dc = dc + dh * o * (1 - th * th)
        da = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        dz[:, t] = da
        dwh += h.T @ da
        dh, dc = da @ wh.T, dc * f
    return dz, dwh


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([*map(len, pages)])
    x = np.zeros((len(pages), max(1, lengths.max(initial=1)), pages[0].shape[1]), np.float32)
    for k, p in enumerate(pages):
        x[k, : len(p)] = p
    return x, lengths


def train_net(pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 12, batch: int = 32, rate: float = 0.02, seed: int = 3) -> Net:
    """Fits the network by back-propagation through time and Adam; deterministic."""
    net = new_net(seed)
    params = net.flat()
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    order, step = np.random.default_rng(seed), 0
    for epoch in range(epochs):
        for at in np.array_split(order.permutation(len(pages)), max(1, len(pages) // batch)):
            x, lengths = padded([pages[k] for k in at])
            y, _ = padded([labels[k][:, None] for k in at])
            y = y[:, :, 0]
            mask = np.arange(x.shape[1]) < lengths[:, None]
            xs = (x, _turned(x, lengths))
            kept: tuple[list, list] = ([], [])
            hs = [_run(xs[d] @ net.wx[d] + net.b[d], net.wh[d], kept[d]) for d in (0, 1)]
            both = np.concatenate([hs[0], _turned(hs[1], lengths)], axis=2)
            p = _sigmoid(both @ net.out + net.bias)
            d = ((p - y) * mask / mask.sum()).astype(np.float32)
            dboth = d[:, :, None] * net.out
            ds = (dboth[:, :, :HIDDEN], _turned(dboth[:, :, HIDDEN:], lengths))
            backs = [_back(ds[k], kept[k], net.wh[k]) for k in (0, 1)]
            flat = [xs[k].reshape(-1, WIDTH).T @ backs[k][0].reshape(-1, 4 * HIDDEN) for k in (0, 1)]
            grads = [
                *flat, backs[0][1], backs[1][1], backs[0][0].sum((0, 1)), backs[1][0].sum((0, 1)),
                np.einsum("bt,bth->h", d, both), np.array([d.sum()]),
            ]
            step += 1
            for w, g, m, v in zip(params, grads, first, second):
                np.clip(g, -1, 1, out=g)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= rate * (0.3 if epoch > epochs // 2 else 1) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def chances(net: Net, pages: list[np.ndarray]) -> list[np.ndarray]:
    """The chance of each leaf to be article text."""
    out: list[np.ndarray] = [np.empty(0)] * len(pages)
    order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
    while order:
        group = [order.pop()]
        longest = len(pages[group[0]])
        while order and (len(group) + 1) * longest <= PADDED:
            group.append(order.pop())
        forward, lengths = padded([pages[k] @ net.wx[0] + net.b[0] for k in group])
        backward, _ = padded([(pages[k] @ net.wx[1] + net.b[1])[::-1] for k in group])
        one, two = _run(forward, net.wh[0]), _run(backward, net.wh[1])
        for r, k in enumerate(group):
            n = lengths[r]
            both = np.concatenate([one[r, :n], two[r, :n][::-1]], axis=1)
            out[k] = _sigmoid(both @ net.out + net.bias)
    return out


#: Phrases of the parts that layouts put around an article. Fixed values.
PHRASES = {
    "menu": ("Home", "News", "About us", "Contact", "Products", "Blog", "Archive", "Support", "Sign in", "Search"),
    "notice": (
        "We use cookies to improve your experience.", "Accept all", "This site uses cookies.", "By continuing you agree to our terms.",
        "Please enable notifications.", "Subscribe to our newsletter for weekly updates.",
    ),
    "form": ("Name", "Email", "Your message", "Send", "Leave a reply", "Post comment", "Search", "Sign up", "Password"),
    "footer": ("All rights reserved.", "Privacy policy", "Terms of use", "Copyright", "Imprint", "Powered by our team"),
    "aside": ("Related articles", "Most read", "Popular posts", "Read more", "Advertisement", "Follow us", "Share", "Tags"),
    "comment": ("Great post!", "Thanks for sharing.", "I do not agree.", "Reply", "Guest wrote:", "2 comments"),
}
#: Paths in which layouts put each part. Fixed values.
PLACES = {
    "article": (
        "html>body>article", "html>body>main>article", "html>body>main.main", "html>body>div.content", "html>body>div.main.content>div.post",
        "html>body>div.entry.content", "html>body>div.wrapper>section.story", "html>body>div.page>div.article.body", "html>body>main>section",
        "html>body>div.container>div.post.body",
    ),
    "menu": ("html>body>nav>ul>li", "html>body>header>nav>ul>li", "html>body>div.menu>ul>li", "html>body>div.navbar.nav", "html>body>ul.menu>li"),
    "top": ("html>body>header>h1", "html>body>header.site.header>div", "html>body>div.header>p", "html>body>div.top.bar", "html>head>title"),
    "notice": (
        "html>body>div.cookie.banner>p", "html>body>div.notice", "html>body>div.consent>p", "html>body>section.notice>p",
        "html>body>div.popup.newsletter>p", "html>body>div.alert>p",
    ),
    "aside": (
        "html>body>aside>ul>li", "html>body>aside>p", "html>body>div.sidebar>p", "html>body>aside.sidebar>div>p", "html>body>div.related>ul>li",
        "html>body>div.sidebar.widget>ul>li", "html>body>div.share",
    ),
    "advert": ("html>body>div.ad", "html>body>div.ads>p", "html>body>div.advert", "html>body>div.ad.banner>p", "html>body>div.sponsored", "html>body>div.promo>p"),
    "form": ("html>body>form>p", "html>body>form>div", "html>body>form.search", "html>body>div.comment.form>form>p", "html>body>form>fieldset>p"),
    "comment": (
        "html>body>section.comments>div.comment>p", "html>body>div.comments>ul>li", "html>body>div.comments>div.comment.body>p",
        "html>body>ol.comment.list>li>p", "html>body>section.comments>h",
    ),
    "footer": ("html>body>footer", "html>body>footer>p", "html>body>div.footer>p", "html>body>footer>ul>li", "html>body>div.copyright"),
}


def laid_out(page: list[Leaf], others: list[str], r: np.random.Generator) -> tuple[list[Leaf], np.ndarray]:
    """A page's article in another layout, with parts around and inside it, and the labels."""
    own = [leaf for leaf in page if first_label(leaf)]
    base = PLACES["article"][r.integers(len(PLACES["article"]))]
    rows: list[tuple[Leaf, int]] = []

    def text(kind: str, real: float) -> str:
        if others and r.random() < real:
            words = others[r.integers(len(others))].split()
            return " ".join(words[: r.integers(2, 40)]) or "Home"
        phrases = PHRASES.get(kind, PHRASES["aside"])
        return phrases[r.integers(len(phrases))]

    def part(kind: str, most: int, real: float, links: float, inside: str = "") -> None:
        places = PLACES[kind]
        place = places[r.integers(len(places))]
        place = place.replace("html>body", inside) if inside else place
        for _ in range(r.integers(1, most + 1)):
            rows.append((Leaf(place, text(kind, real), float(r.random() < links)), 0))

    if r.random() < 0.7:
        part("top", 2, 0.6, 0.3)
    if r.random() < 0.9:
        part("menu", 8, 0.4, 0.95)
    if r.random() < 0.5:
        part("notice", 2, 0.5, 0.1)
    if r.random() < 0.6:
        part("advert", 2, 0.9, 0.3)
    if r.random() < 0.3:
        part("aside", 4, 0.6, 0.6)
    for k, leaf in enumerate(own):
        tail = leaf.path.split(">")[-1].split(".")[0]
        tail = tail if tail in ("p", "h", "li", "pre", "blockquote", "td") or tail[:1] == "h" and tail != "html" else "p"
        rows.append((Leaf(f"{base}>{tail}", leaf.text, leaf.linked), 1))
        if k and r.random() < 0.08:
            part(("advert", "aside", "notice", "form")[r.integers(4)], 2, 0.7, 0.4, base)
    if r.random() < 0.5:
        part("comment", 5, 0.8, 0.1, base if r.random() < 0.2 else "")
    if r.random() < 0.4:
        part("form", 4, 0.2, 0.0)
    if r.random() < 0.4:
        part("aside", 6, 0.6, 0.7)
    if r.random() < 0.9:
        part("footer", 3, 0.5, 0.4)
    return [leaf for leaf, _ in rows], np.array([y for _, y in rows], np.float32)


def fit_pages(htmls: list[str], variants: int, seed: int) -> Net:
    """The network of these pages and of their other layouts."""
    read = [page for page in map(leaves, htmls) if page]
    others = [leaf.text for page in read for leaf in page]
    r = np.random.default_rng(seed)
    xs, ys = [], []

    def add(page: list[Leaf], labels: np.ndarray) -> None:
        x = vectors(page)
        for at in range(0, len(page), SEGMENT):
            xs.append(x[at : at + SEGMENT])
            ys.append(labels[at : at + SEGMENT])

    for page in read:
        add(page, np.array([first_label(leaf) for leaf in page], np.float32))
        for _ in range(variants):
            other, labels = laid_out(page, others, r)
            if other:
                add(other, labels)
    return train_net(xs, ys, seed=seed) if xs else new_net(seed)


def train(pages: DataFrame, rows: int = ROWS, variants: int = 3, html_col: str = "html", seed: int = 3) -> Net:
    """The network of at most ``rows`` pages, fitted in one task, whose input that bound limits."""
    sample = pick(pages, html=html_col).where("html is not null").orderBy(F.xxhash64("html"), "html").limit(rows).coalesce(1)

    def fitted(batches):
        htmls = [h for (part,) in batches for h in part]
        yield ([pickle.dumps(tuple(fit_pages(htmls, variants, seed)))],)

    return Net(*pickle.loads(map_rows(sample, "net binary", fitted).first()["net"]))


def extract(
    pages: DataFrame, net: Net, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per page: page_id, url, text (kept blocks joined by an empty line) and n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(net)

    def extracted(batches):
        for ids, urls, htmls in batches:
            read = [leaves(h) for h in htmls]
            scores = chances(shared.value, [vectors(p) for p in read])
            texts = ["\n\n".join(leaf.text for leaf, s in zip(p, c) if s >= 0.5) for p, c in zip(read, scores)]
            yield ids, urls, texts, [len(t) for t in texts]

    rows = pick(pages, _id=id_col, _url=url_col, _html=html_col)
    rows = rows.select(F.col("_id").cast("long"), F.col("_url").cast("string"), "_html")
    return map_rows(rows, "page_id long, url string, text string, n_chars long", extracted, rows=128)
