"""Main text of web pages by a recurrent block labeller.

A page is read into its leaf blocks: runs of text between block-level tags, each with its path of tags and class words.
A bidirectional LSTM in numpy reads a page's blocks in order, each as a vector of hashed path words, hashed words and a
few measures, so a block is judged with the whole page as context. Blocks labelled as content are the text.

The labeller is trained here: on MADE_PAGES made pages whose makers know what each block is, with usual, foreign, coded
or no names on their elements, so that it learns from text, tags and order as well; and on at most TRAIN_PAGES pages of
the table (least hashed page_id) whose markup says what a block is, each with its names and without. Every page is
labelled, however long; nothing of its text is cut.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.staging import table
from . import caches

TRAIN_PAGES, MADE_PAGES, EPOCHS = 120, 420, 6
#: Pages of the table that are longer (in characters) are no examples.
TRAIN_CHARS = 200_000
PATH_DIMS, WORD_DIMS, HIDDEN = 96, 64, 16
#: Blocks labelled together: several pages, or one part of a long page after the other.
GROUP_BLOCKS = 4096

# HTML elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style noscript template iframe object svg math textarea select option canvas audio video".split())
#: Elements and class words whose blocks are not main text, and those that hold it: labels for training.
NOISE_TAGS = frozenset("nav header footer aside form button menu dialog head title figcaption label".split())
NOISE_WORDS = frozenset("nav navbar navigation menu breadcrumb breadcrumbs header masthead footer foot copyright sidebar side aside widget related recommended ad ads advert advertisement banner sponsor sponsored promo cookie cookies consent notice alert popup modal newsletter subscribe signup login search share sharing social comment comments reply replies discussion respond tags pagination pager".split())
MAIN_TAGS = frozenset("article main".split())
MAIN_WORDS = frozenset("article content post entry story main body text prose".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*?)(?:>|\Z)", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: What made pages say of their elements; the labeller's inputs leave it out.
_SAID = re.compile(r"\bdata-is=([01])")
_WORD = re.compile(r"[a-z]+")


def _bucket(word: str, dims: int) -> tuple[int, float]:
    h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
    return h % dims, 1.0 if h & 0x80000000 else -1.0


class Node:
    """An open element: its tag, its words, and what its path adds up to. Equal paths of a page are one node."""

    __slots__ = ("tag", "names", "parent", "vector", "own", "mark", "said", "children")

    def __init__(self, tag: str, names: tuple[str, ...], said: int | None, parent: Node | None):
        self.tag, self.names, self.parent, self.children = tag, names, parent, {}
        self.own = np.zeros(PATH_DIMS, dtype=np.float32)
        for w in [f"<{tag}>", *(f".{x}" for x in names)] if tag else ():
            i, s = _bucket(w, PATH_DIMS)
            self.own[i] += s
        self.vector = self.own if parent is None else parent.vector + self.own
        self.said = said if said is not None else parent.said if parent else None
        self.mark = parent.mark if parent else None
        words = set(names)
        if self.mark != 0 and tag:
            if tag in NOISE_TAGS and not (tag == "header" and self.mark == 1) or words & NOISE_WORDS:
                self.mark = 0
            elif tag in MAIN_TAGS or words & MAIN_WORDS:
                self.mark = 1

    def inner(self, tag: str, names: tuple[str, ...], said: int | None) -> Node:
        key = (tag, names, said)
        node = self.children.get(key)
        if node is None:
            node = self.children[key] = Node(tag, names, said, self)
        return node

    def input(self) -> np.ndarray:
        """The path's hashed words; the last two elements weigh more."""
        near = self.own + (self.parent.own if self.parent else 0)
        return np.clip(0.7 * self.vector + 0.3 * near, -2, 2)


Block = tuple[str, Node, float]


def blocks(page: str | None, names: bool = True) -> list[Block]:
    """(text, node, share of characters in links) of each leaf block in page order, character references decoded.

    Without names, elements have only their tags. The time is linear in the page, whatever is left unclosed.
    """
    page = page if isinstance(page, str) else ""
    out: list[Block] = []
    root = Node("", (), None, None)
    # Open elements: their node for the path (that of the last block-level or named one), tag, and the place of an open p that a block-level tag would end.
    stack: list[tuple[Node, str, int | None]] = []
    open_: Counter[str] = Counter()
    endless: set[str] = set()
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, stack[-1][0] if stack else root, min(1.0, linked / len(text))))
        parts, linked = [], 0

    def close(i: int) -> None:
        if any(t not in INLINE for _, t, _ in stack[i:]):
            flush()
        for _, t, _ in stack[i:]:
            open_[t] -= 1
        del stack[i:]

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else n]
        if text:
            parts.append(text)
            if open_["a"]:
                linked += len(text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if open_[tag]:
                i = len(stack) - 1
                while stack[i][1] != tag:
                    i -= 1
                close(i)
            elif tag not in INLINE:
                flush()
            continue
        if tag in RAW:
            end = None if tag in endless else re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            if end is None:
                endless.add(tag)
            at = end.end() if end else (n if tag in ("script", "style") else at)
            continue
        if tag == "br":
            parts.append(" ")
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag not in INLINE:
            flush()
            if stack and stack[-1][2] is not None:
                close(stack[-1][2])  # a block-level tag ends an open paragraph
            if tag in ("li", "td", "th", "tr", "dt", "dd") and stack and stack[-1][1] == tag:
                close(len(stack) - 1)
        said = _SAID.search(m[3]) if "data-is" in m[3] else None
        found = " ".join(a or b or c for a, b, c in _NAMES.findall(m[3])) if names and m[3] else ""
        words = tuple(sorted(set(_WORD.findall(found.lower())))) if found else ()
        above = stack[-1][0] if stack else root
        node = above if tag in INLINE and not words and not said else above.inner(tag, words, int(said[1]) if said else None)
        ends = len(stack) if tag == "p" else stack[-1][2] if tag in INLINE and stack else None
        stack.append((node, tag, ends))
        open_[tag] += 1
    flush()
    return out


class _WordBuckets(dict):
    def __missing__(self, word: str) -> int:
        i, sign = _bucket(word.lower().strip(".,:;!?()[]\"'"), WORD_DIMS)
        b = self[word] = i if sign > 0 else i + WORD_DIMS
        return b


_words = _WordBuckets()
caches.register("pages", _words.clear)
MEASURES = 11
INPUTS = PATH_DIMS + WORD_DIMS + MEASURES


def vectors(page: list[Block], first: int = 0, total: int | None = None) -> np.ndarray:
    """One row for each block; first and total place a part of a page in it."""
    caches.claim("pages")
    x = np.zeros((len(page), INPUTS), dtype=np.float32)
    last = max(1, (len(page) if total is None else total) - 1)
    if len(_words) > 300_000:
        _words.clear()
    paths: dict[int, np.ndarray] = {}
    for r, (text, node, links) in enumerate(page):
        v = paths.get(id(node))
        if v is None:
            v = paths[id(node)] = node.input()
        x[r, :PATH_DIMS] = v
        words = text.split()
        n = len(words)
        hits = np.bincount(np.fromiter(map(_words.__getitem__, words), dtype=np.int64, count=n), minlength=2 * WORD_DIMS)
        x[r, PATH_DIMS : PATH_DIMS + WORD_DIMS] = np.clip(3 * (hits[:WORD_DIMS] - hits[WORD_DIMS:]) / n, -2, 2)
        stops = text.count(".") + text.count("!") + text.count("?")
        x[r, -MEASURES:] = [np.log1p(n) / 4, links, min(stops, 10) / 5, min(1.0, stops / n), min(4.0, len(text) / n / 8), (first + r) / last, float(text[-1] in ".!?…"), float(text[0] == "©"), float(node.tag == "p"), np.log1p(last) / 5, 1.0]
    return x


# --- the labeller -------------------------------------------------------------------------------------------------


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


def new_model(seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    model = {}
    for d in ("f", "b"):
        model[f"W{d}"] = r.normal(0, 0.15, (INPUTS, 4 * HIDDEN))
        model[f"U{d}"] = r.normal(0, 0.15, (HIDDEN, 4 * HIDDEN))
        model[f"c{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    model["v"], model["o"] = r.normal(0, 0.3, 2 * HIDDEN), np.zeros(1)
    return model


def _run(model: dict, d: str, x: np.ndarray, mask: np.ndarray, state=None):
    """One direction over x (pages, blocks, inputs); states and gates for each step. state: where to go on, (h, c)."""
    b, t, _ = x.shape
    pre = x @ model[f"W{d}"] + model[f"c{d}"]
    h, c = state if state else (np.zeros((b, HIDDEN)), np.zeros((b, HIDDEN)))
    hs, trace = np.zeros((b, t, HIDDEN)), []
    for k in range(t) if d == "f" else range(t - 1, -1, -1):
        a = pre[:, k] + h @ model[f"U{d}"]
        i, f, o, g = (_sigmoid(a[:, :HIDDEN]), _sigmoid(a[:, HIDDEN : 2 * HIDDEN]), _sigmoid(a[:, 2 * HIDDEN : 3 * HIDDEN]), np.tanh(a[:, 3 * HIDDEN :]))
        m = mask[:, k, None]
        c2 = (f * c + i * g) * m
        tc = np.tanh(c2)
        h2 = o * tc * m
        trace.append((k, h, c, i, f, o, g, tc))
        h, c = h2, c2
        hs[:, k] = h
        if state is not None:
            trace.clear()
    return (hs, trace) if state is None else (hs, (h, c))


def probabilities(model: dict, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    hs = np.concatenate([_run(model, "f", x, mask)[0], _run(model, "b", x, mask)[0]], axis=2)
    return _sigmoid(hs @ model["v"] + model["o"][0])


def long_page(model: dict, page: list[Block]) -> np.ndarray:
    """The probabilities of a long page's blocks, in parts: each direction hands its state on, so the result is that of the whole."""
    cuts = range(0, len(page), GROUP_BLOCKS)
    hs = np.zeros((len(page), 2 * HIDDEN), dtype=np.float32)
    for d, order, side in (("f", cuts, slice(0, HIDDEN)), ("b", reversed(cuts), slice(HIDDEN, None))):
        state = (np.zeros((1, HIDDEN)), np.zeros((1, HIDDEN)))
        for at in order:
            part = page[at : at + GROUP_BLOCKS]
            x = vectors(part, at, len(page))[None]
            out, state = _run(model, d, x, np.ones((1, len(part))), state)
            hs[at : at + len(part), side] = out[0]
    return _sigmoid(hs @ model["v"] + model["o"][0])


def gradients(model: dict, x: np.ndarray, mask: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, dict]:
    """Mean cross-entropy over blocks of weight w, and its gradient by back-propagation through both directions."""
    (hf, tf), (hb, tb) = _run(model, "f", x, mask), _run(model, "b", x, mask)
    hs = np.concatenate([hf, hb], axis=2)
    p = _sigmoid(hs @ model["v"] + model["o"][0])
    total = max(1.0, w.sum())
    loss = -(w * (y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12))).sum() / total
    d = w * (p - y) / total
    grad = {"v": np.einsum("bt,bth->h", d, hs), "o": np.array([d.sum()])}
    dh_all = d[:, :, None] * model["v"]
    for name, trace, part in (("f", tf, dh_all[:, :, :HIDDEN]), ("b", tb, dh_all[:, :, HIDDEN:])):
        b = x.shape[0]
        dh, dc = np.zeros((b, HIDDEN)), np.zeros((b, HIDDEN))
        da = np.zeros((b, x.shape[1], 4 * HIDDEN))
        du = np.zeros_like(model[f"U{name}"])
        for k, h, c, i, f, o, g, tc in reversed(trace):
            m = mask[:, k, None]
            dh = (dh + part[:, k]) * m
            dct = (dc + dh * o * (1 - tc * tc)) * m
            a = np.concatenate([dct * g * i * (1 - i), dct * c * f * (1 - f), dh * tc * o * (1 - o), dct * i * (1 - g * g)], axis=1)
            da[:, k] = a
            du += h.T @ a
            dh, dc = a @ model[f"U{name}"].T, dct * f
        grad[f"W{name}"] = np.einsum("bti,btj->ij", x, da, optimize=True)
        grad[f"U{name}"], grad[f"c{name}"] = du, da.sum(axis=(0, 1))
    return loss, grad


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max((len(p) for p in pages), default=0)
    x, mask = np.zeros((len(pages), t, INPUTS), dtype=np.float32), np.zeros((len(pages), t))
    for r, p in enumerate(pages):
        x[r, : len(p)], mask[r, : len(p)] = p, 1
    return x, mask


def fit(pages: list[tuple[np.ndarray, np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = 7) -> dict[str, np.ndarray]:
    """pages: (vectors, labels, weights). Adam over groups of 12 pages of like length."""
    model, r = new_model(seed), np.random.default_rng(seed)
    m1, m2, step = {k: np.zeros_like(v) for k, v in model.items()}, {k: np.zeros_like(v) for k, v in model.items()}, 0
    pages = sorted((p for p in pages if len(p[0])), key=lambda p: len(p[0]))
    groups = [pages[i : i + 12] for i in range(0, len(pages), 12)]
    for _ in range(epochs):
        for g in r.permutation(len(groups)):
            x, mask = padded([p[0] for p in groups[g]])
            y, w = np.zeros(mask.shape), np.zeros(mask.shape)
            for i, (_, labels, weight) in enumerate(groups[g]):
                y[i, : len(labels)], w[i, : len(labels)] = labels, weight
            _, grad = gradients(model, x, mask, y, w)
            step += 1
            for k in model:
                m1[k] = 0.9 * m1[k] + 0.1 * grad[k]
                m2[k] = 0.999 * m2[k] + 0.001 * grad[k] ** 2
                model[k] -= 0.02 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return model


# --- what it learns from ------------------------------------------------------------------------------------------


# Words that stand in the parts of pages around the text, for made pages.
SMALL_TALK = {
    "nav": "Home News Contact About Login Sport Shop Blog Archive Startseite Kontakt Impressum Accueil Actualités Inicio Contacto Noticias Search Menu Next Previous".split(),
    "notice": "We use cookies to improve your experience|Accept all cookies|By using this site you agree to our cookie policy|Wir verwenden Cookies|Ce site utilise des cookies|Este sitio utiliza cookies|Please enable JavaScript".split("|"),
    "ad": "Advertisement|Sponsored|Buy now and save|Special offer only today|Anzeige|Publicité|Publicidad|Limited time deal|Shop the sale".split("|"),
    "foot": "All rights reserved|Privacy policy|Terms of use|Alle Rechte vorbehalten|Tous droits réservés|Todos los derechos reservados|Contact us|Datenschutz".split("|"),
    "form": "Subscribe to our newsletter|Your email|Password|Sign up|Search|Anmelden|Abonnez-vous|Suscríbete|Send".split("|"),
    "comment": "Reply|says:|wrote|2 days ago|Antworten|vor 3 Stunden|Répondre|il y a 2 jours|Responder|hace 1 hora|Like|Report|Share".split("|"),
    "comments": "Comments|Leave a comment|Kommentare|Commentaires|Comentarios|Discussion|What readers say".split("|"),
    "side": "Related articles|Most read|You may also like|Tags|Mehr zum Thema|À lire aussi|Lo más leído|Trending|Popular posts".split("|"),
}
# Names of elements by what they hold, usual and foreign.
USUAL = {
    "main": "content post-body entry-content story article-text td-post-content mw-parser-output main-column prose text".split(),
    "nav": "menu navigation navbar nav main-menu breadcrumbs".split(),
    "notice": "cookie notice consent alert banner popup".split(),
    "ad": "ad ads advert sponsored promo advertisement".split(),
    "side": "sidebar widget related recommended side aside".split(),
    "form": "login search newsletter signup subscribe".split(),
    "comments": "comments comment-list discussion replies respond".split(),
    "foot": "footer foot site-footer copyright colophon".split(),
}
FOREIGN = {
    "main": "inhalt beitrag artikeltext contenu corps contenido cuerpo noticia".split(),
    "nav": "navi hauptmenue menu-principal migas".split(),
    "notice": "hinweis avis aviso".split(),
    "ad": "werbung anzeige publicite publicidad".split(),
    "side": "seitenleiste marginal encart lateral".split(),
    "form": "anmeldung suche connexion acceso".split(),
    "comments": "kommentare leserbriefe commentaires comentarios".split(),
    "foot": "fusszeile pied pie-de-pagina".split(),
}


def _made_text(r: Random, least: int, most: int) -> str:
    syllables = "an re th ou in es la de en ti st on er ge che do mi sa lo pa".split()
    words = ["".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(r.randint(least, most))]
    if most > 12:
        for i in range(0, len(words), r.randint(6, 14)):
            words[i] = ("" if not i else "") + words[i].capitalize()
            if i:
                words[i - 1] += r.choice(".,.?")
    text = " ".join(words)
    text = text[:1].upper() + text[1:]
    return text + (r.choice([".", ".", "!", "?"]) if most > 6 else "")


def made_page(r: Random) -> str:
    """A page of a random layout and naming; data-is says of each part whether it is main text (1) or not (0)."""
    pick = lambda *x: r.choice(x)
    yes = lambda p: r.random() < p
    t = lambda a, b: _made_text(r, a, b)
    say = lambda kind: r.choice(SMALL_TALK[kind])
    naming = pick("usual", "usual", "foreign", "coded", "none")
    soup = naming != "usual" and yes(0.5)  # only div for the page's parts
    codes: dict[str, str] = {}

    def named(kind: str, is_main: int, tags: str) -> tuple[str, str]:
        tag = "div" if soup else r.choice(tags.split())
        if naming == "coded":
            name = codes.setdefault(kind, "".join(r.choices("abcdefghijkxyz", k=r.randint(3, 7))) + "-" + "".join(r.choices("abcdef0123456789", k=4)))
        else:
            name = r.choice({"usual": USUAL, "foreign": FOREIGN}[naming][kind]) if naming in ("usual", "foreign") and (tag == "div" or yes(0.5)) else ""
        attribute = f' {pick("class", "class", "id")}="{name}"' if name else ""
        return f"<{tag}{attribute} data-is={is_main}>", f"</{tag}>"

    def links(n: int, words=lambda: "") -> str:
        out = [f'<a href="/x">{words() or t(1, 3)}</a>' for _ in range(n)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in out) + "</ul>" if yes(0.8) else pick(" | ", " ", " &middot; ").join(out)

    def nav() -> str:
        a, b = named("nav", 0, "nav nav div ul")
        return a + links(r.randint(3, 9), lambda: say("nav") if yes(0.4) else "") + b

    def noise(kind: str) -> str:
        a, b = named(kind, 0, {"ad": "div div aside", "side": "aside div section", "notice": "div section", "form": "form form div", "comments": "div section ol"}[kind])
        if kind == "ad":
            return a + (say("ad") + " " if yes(0.4) else "") + t(2, 40) + b
        if kind == "side":
            return f"{a}<h3>{say('side') if yes(0.5) else t(1, 4)}</h3>{links(r.randint(2, 6))}" + (f"<p>{t(4, 30)}</p>" if yes(0.5) else "") + b
        if kind == "notice":
            return f"{a}<p>{say('notice') if yes(0.7) else t(6, 30)}</p>" + (f"<button>{t(1, 2)}</button>" if yes(0.6) else "") + b
        if kind == "form":
            return f"{a}<label>{say('form') if yes(0.6) else t(1, 3)}</label><input><p>{say('form') if yes(0.4) else t(3, 12)}</p><button>{t(1, 2)}</button>{b}"
        out = f"{a}<h3>{say('comments') if yes(0.6) else t(1, 3)}</h3>"
        for _ in range(r.randint(1, 7)):
            e = pick("p", "div", "li")
            by = f"<{pick('b', 'div', 'span', 'h4')}>{t(1, 2)} {say('comment') if yes(0.6) else ''}</{pick('b', 'div', 'span', 'h4')}>" if yes(0.6) else ""
            out += f"{by}<{e}>{t(4, 60)}</{e}>" + (f"<a href=#>{say('comment')}</a>" if yes(0.4) else "")
        return out + b

    def body() -> str:
        out = [f"<h1>{t(2, 9)}</h1>"] if yes(0.9) else []
        plain = yes(0.3)
        for _ in range(r.randint(1, 16)):
            if plain:
                out.append(f"<{(e := pick('p', 'p', 'div'))}>{t(10, 90)}</{e}>")
                continue
            out.append(pick(f"<p>{t(6, 90)}</p>", f"<p>{t(6, 90)}", f"<p>{t(1, 8)}</p>", f"<p><b>{t(3, 40)}<br>{t(5, 20)}</p>", f"<h2>{t(1, 6)}</h2><p>{t(10, 60)}</p>", f"<ul><li>{t(4, 20)}</li><li>{t(2, 20)}</li></ul>", f"<blockquote>{t(8, 40)}</blockquote>", f"<table><tr><td>{t(1, 5)}</td><td>{t(1, 5)}</td></tr></table>", f"<pre>{t(4, 12)}</pre>", f'<p>{t(6, 30)} <a href="/y">{t(1, 4)}</a> {t(3, 20)}</p>', f"<div>{t(10, 60)}</div>", f"<p>{t(20, 120)}</p><hr>"))
            if yes(0.05):
                word = t(1, 1)
                out.append(f"<p>{' '.join([word] * r.randint(2, 60))}</p>")
            if yes(0.05):
                out.append(noise(pick("ad", "side", "form", "ad")))
        return "".join(out)

    a, b = named("main", 1, "article main div section")
    if naming == "usual" and a.startswith("<div data") or a.startswith("<section data"):
        a, b = f'<div class="{r.choice(USUAL["main"])}" data-is=1>', "</div>"
    head = f"<html><head><title data-is=0>{t(2, 9)}</title></head><body>"
    before = [nav() if yes(0.8) else "", f"<header data-is=0>{t(1, 5)}<p>{t(2, 12)}</p></header>" if yes(0.5) and not soup else "", *(noise(k) for k in ("ad", "notice", "side", "form") if yes(0.35))]
    after = [noise(k) for k in ("comments", "side", "ad", "form") if yes(0.4)]
    fa, _ = named("foot", 0, "footer footer div")
    foot = f"{fa}{pick('&copy; ', '&copy; 2024 ', '')}{t(1, 4)} {say('foot') if yes(0.5) else t(2, 20)}" if yes(0.85) else ""
    return head + "".join(before) + a + body() + b + "".join(after) + foot


def _example(page: list[Block], labels: list[int | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    if not any(v is not None for v in labels):
        return []
    return [(vectors(page), np.array([v or 0 for v in labels], dtype=float), np.array([v is not None for v in labels], dtype=float))]


def examples(made: list[str], taken: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Vectors, labels and weights: of made pages as their makers say, of others as far as their markup says, with their names and without."""
    out = []
    for page in made:
        found = blocks(page)
        out += _example(found, [n.said for _, n, _ in found])
    for page in taken:
        found, bare = blocks(page), blocks(page, names=False)
        labels = [n.mark for _, n, _ in found]
        out += _example(found, labels)
        if len(bare) == len(found):
            out += _example(bare, labels)
    return out


def train(pages: DataFrame, n: int = TRAIN_PAGES, made: int = MADE_PAGES) -> dict[str, np.ndarray]:
    """The labeller for a table of pages: n of its pages at most, and made ones."""
    short = pages.where(F.length("html").between(1, TRAIN_CHARS))
    wanted = short.select("page_id", "html").orderBy(F.xxhash64("page_id"), "page_id", F.xxhash64("html")).select("html").limit(n)
    taken = [x.html for x in wanted.collect()]
    r = Random(11)
    return fit(examples([made_page(r) for _ in range(made)], taken))


def label(model: dict, pages: list[list[Block]]) -> list[np.ndarray]:
    """The probability of main text for each block of each page, grouped by length so that padding stays small."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    while order:
        take = [order.pop()]
        if len(pages[take[0]]) > GROUP_BLOCKS:
            out[take[0]] = long_page(model, pages[take[0]])
            continue
        while order and len(pages[take[0]]) * (len(take) + 1) <= GROUP_BLOCKS:
            take.append(order.pop())
        x, mask = padded([vectors(pages[i]) for i in take])
        for i, p in zip(take, probabilities(model, x, mask), strict=True):
            out[i] = p[: len(pages[i])]
    return out


def extract(pages: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html).

    A null or empty html has an empty text; so has a page without a content block. Repeated rows give the same text.
    Pages of any length are read whole, their blocks in parts of bounded size.
    An empty table gives no rows. Other columns are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)
    kind = lambda c: pages.schema[c].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                read = [blocks(h) for h in part.column("html").to_pylist()]
                texts = [" ".join(b[0] for b, p in zip(page, probs, strict=True) if p >= 0.5) for page, probs in zip(read, label(shared.value, read), strict=True)]
                # Ids stay Arrow values: through pandas a null among them would turn large ones into other numbers.
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind('page_id')}, url {kind('url')}, text string, n_chars long")


def op2_recurrent_block_labeller(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(pages))
