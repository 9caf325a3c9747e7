"""HTML extraction: a bidirectional LSTM labels every block of a page as main text or not.

A page becomes a sequence of leaves (see ``html_leaves``). A leaf's vector has its tag path (which of TAGS and
NAMES are in it; a name counts as the one it holds), its words, hashed, and a few measures (length, linked share, punctuation, place, words shared with the
page's title). A numpy LSTM reads the sequence from both ends, so a block's label depends on the whole page, and a
logistic layer gives the probability of main text. Short pages are read side by side; a page of over LONG leaves is
read in steps of LONG, forwards and then backwards, the states carried from one to the next, so that beside the
leaves themselves it takes one number for each.

The model is trained here, from pages that ``practice_pages`` writes in many layouts with known
labels (the tables have none). The text is the blocks labelled as main, a line each.

Defined results: a null or empty page, or one without main text, has the empty text. White space in
a block, also the non-breaking space, becomes one space. Repeated rows repeat; an empty table gives
an empty result; columns named like the new ones are replaced.
"""

from __future__ import annotations

import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts
from .html_leaves import WORDS, Leaf, Node, Page, parsed

#: Tags that are told apart in a path; all others are one.
TAGS = (
    "html body div section article main nav header footer aside p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th tbody thead tfoot caption form fieldset legend button select option textarea blockquote pre center"
    " figure figcaption address details summary noscript template iframe dialog menu"
).split()
#: Names that sites give to what surrounds an article, and to what holds one; all others are one.
NAMES = {
    "menu": "nav menu navbar topnav navigation tabs mainmenu submenu toc", "crumbs": "breadcrumb breadcrumbs crumbs path", "side": "sidebar related widget recommended popular trending more-stories rail",
    "ad": "ad ads advert banner sponsor promo sponsored adsbox advertisement", "notice": "cookie notice consent gdpr alert popup modal paywall disclaimer banner-cookie", "signup": "newsletter subscribe signup mailing",
    "search": "search searchbox finder query", "share": "share social sharing follow buttons", "comments": "comments comment discussion replies responses disqus thread", "foot": "footer copyright legal colophon bottom",
    "head": "header masthead top branding site-header logo", "pager": "pagination pager pages paging", "script": "noscript js-warning", "body": "content post entry article story main body text post-body article-content page prose copy",
}
KNOWN = {x: i for i, x in enumerate(dict.fromkeys(w for v in NAMES.values() for w in WORDS.findall(v)))}
IN_NAME = re.compile("|".join(sorted((x for x in KNOWN if len(x) > 4), key=len, reverse=True)))

PATH_DIMS, WORD_DIMS, HIDDEN = 2 * len(TAGS) + 2 + len(KNOWN) + 1, 256, 32
MEASURES = 13
DIMS = PATH_DIMS + WORD_DIMS + MEASURES
#: Leaves, padding included, whose vectors are held at once; leaves of a page beyond which it is read in steps of so many.
AT_ONCE, LONG = 8_000, 4_000
PRACTICE, ROUNDS, SEED = 8000, 8, 7


def hashed(word: str, dims: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % dims


class Hashes(dict):
    """Hash numbers of words met before, up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        k = self[word] = hashed(word.strip(".,;:!?"), WORD_DIMS)
        return k


class Vectors:
    """Leaves to vectors; the hashed tags and words met before are kept up to a bound."""

    def __init__(self) -> None:
        self.tags: dict[str, list[int]] = {}
        self.words = Hashes()

    def tag(self, own: str) -> list[int]:
        """Places of a tag and its names, the first for the tag as a leaf's own."""
        at = self.tags.get(own)
        if at is None:
            tag, *names = own.split(".")
            k = TAGS.index(tag) if tag in TAGS else len(TAGS)
            known = [KNOWN.get(n, KNOWN.get(m[0]) if (m := IN_NAME.search(n)) else len(KNOWN)) for n in names]
            at = [k, len(TAGS) + 1 + k, *(2 * len(TAGS) + 2 + n for n in known)]
            if len(self.tags) > 20_000:
                self.tags.clear()
            self.tags[own] = at
        return at

    def path(self, node: Node) -> np.ndarray:
        """Of all tags above; each tag adds its own to what its parent has."""
        todo = []
        while node.vector is None and node.parent is not None:
            todo.append(node)
            node = node.parent
        v = np.zeros(PATH_DIMS, np.float32) if node.vector is None else node.vector
        for x in reversed(todo):
            v = v.copy()
            v[self.tag(x.own)[1:]] = 1
            x.vector = v
        return v

    def words_of(self, text: str) -> np.ndarray:
        """Counts of the hashed words of the whole text, scaled to length one."""
        n = np.bincount([self.words[w] for w in text.lower().split()], minlength=WORD_DIMS)
        return n / max(1.0, np.sqrt(n @ n))

    def of(self, leaves: list[Leaf], title: str = "", first: int = 0, total: int | None = None) -> np.ndarray:
        """Vectors of leaves, the ``first`` of which has this place among the page's ``total``."""
        n, total = len(leaves), len(leaves) if total is None else total
        out = np.zeros((n, DIMS), np.float32)
        if not n:
            return out
        named = set(title.lower().split())
        shared = np.zeros(n)
        for i, x in enumerate(leaves):
            out[i, :PATH_DIMS] = self.path(x.path)
            if x.path.parent is not None:
                out[i, self.tag(x.path.own)[0]] = 1
            out[i, PATH_DIMS:-MEASURES] = self.words_of(x.text)
            if named and len(x.text) <= 2 * len(title) + 20:
                own = set(x.text.lower().split())
                shared[i] = len(own & named) / len(own)
        size = np.array([len(x.text) for x in leaves])
        words = np.array([x.text.count(" ") + 1 for x in leaves])
        stops = np.array([x.text.count(".") + x.text.count(",") + x.text.count(";") for x in leaves])
        place = np.arange(first, first + n)
        out[:, -MEASURES:] = np.stack([
            np.log1p(size) / 8, np.array([x.linked for x in leaves]) / size, stops / size * 10, size > 80,
            place / max(1, total - 1), 1 / (1 + place), np.array([min(x.path.depth, 12) for x in leaves]) / 12, np.ones(n),
            shared, [x.text[-1] in ".!?\"”»…" for x in leaves], np.minimum(words, 12) / 12,
            ["©" in x.text or "|" in x.text or "›" in x.text or "»" in x.text for x in leaves], [any(c.isdigit() for c in x.text) for x in leaves],
        ], axis=1)
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def new_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    w = {}
    for side in ("f", "b"):
        w[side + "x"] = rng.normal(0, 1 / np.sqrt(DIMS), (DIMS, 4 * HIDDEN))
        w[side + "h"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
        w[side + "o"] = rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN)
    w["x"] = rng.normal(0, 0.1, DIMS)  # the leaf's own vector also reaches the label directly
    w["bias"] = np.zeros(1)
    return {k: v.astype(np.float32) for k, v in w.items()}


State = tuple[np.ndarray, np.ndarray]


def forward(w: dict, side: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None, state: State | None = None) -> tuple[np.ndarray, State]:
    """Hidden states of a batch (pages, leaves, DIMS) in one direction, and the last state, to go on from;
    ``keep`` gets what training needs."""
    n, steps, _ = x.shape
    gates = x.reshape(n * steps, -1) @ w[side + "x"]
    gates = gates.reshape(n, steps, -1)
    h, c = state or (np.zeros((n, HIDDEN), x.dtype), np.zeros((n, HIDDEN), x.dtype))
    out = np.zeros((n, steps, HIDDEN), x.dtype)
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        z = gates[:, t] + h @ w[side + "h"]
        i, f, o = (sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN] + (k == 1)) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = mask[:, t, None]
        c_new = f * c + i * g
        tc = np.tanh(c_new)
        if keep is not None:
            keep.append((t, h, c, i, f, o, g, tc, m))
        h, c = np.where(m, o * tc, h), np.where(m, c_new, c)
        out[:, t] = h
    return out, (h, c)


def logits(w: dict, x: np.ndarray, mask: np.ndarray, keeps: dict | None = None) -> tuple[np.ndarray, dict]:
    hs = {s: forward(w, s, x, mask, None if keeps is None else keeps.setdefault(s, []))[0] for s in ("f", "b")}
    return sum(hs[s] @ w[s + "o"] for s in hs) + x @ w["x"] + w["bias"], hs


def gradients(w: dict, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross entropy of the labels, through both directions."""
    keeps: dict[str, list] = {}
    z, hs = logits(w, x, mask, keeps)
    d = (sigmoid(z) - y) * mask / max(1, mask.sum())
    g = {"x": np.einsum("nt,ntd->d", d, x), "bias": d.sum(keepdims=True).reshape(1)}
    n, steps, dims = x.shape
    for s in ("f", "b"):
        g[s + "o"] = np.einsum("nt,nth->h", d, hs[s])
        dz_all = np.zeros((n, steps, 4 * HIDDEN), x.dtype)
        gh = np.zeros_like(w[s + "h"])
        dh, dc = np.zeros((n, HIDDEN), x.dtype), np.zeros((n, HIDDEN), x.dtype)
        for t, h, c, i, f, o, gg, tc, m in reversed(keeps[s]):
            dh = dh + d[:, t, None] * w[s + "o"]
            on = dh * m
            dct = on * o * (1 - tc**2) + dc * m
            dz = np.concatenate([dct * gg * i * (1 - i), dct * c * f * (1 - f), on * tc * o * (1 - o), dct * i * (1 - gg**2)], axis=1)
            dz_all[:, t] = dz
            gh += h.T @ dz
            dh, dc = dh * ~m + dz @ w[s + "h"].T, dc * ~m + dct * f
        g[s + "h"] = gh
        g[s + "x"] = x.reshape(-1, dims).T @ dz_all.reshape(n * steps, -1)
    return g


def batched(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, seqs))
    x = np.zeros((len(seqs), steps, DIMS), np.float32)
    mask = np.zeros((len(seqs), steps), bool)
    for i, s in enumerate(seqs):
        x[i, : len(s)] = s
        mask[i, : len(s)] = True
    return x, mask


@lru_cache(maxsize=1)
def trained(pages: int = PRACTICE, rounds: int = ROUNDS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Weights after ``rounds`` passes over practice pages, by Adam: the mean of those of the second half."""
    vectors, rng = Vectors(), np.random.default_rng(seed)
    data = []
    for html in practice_pages(pages, seed):
        page, labels = known(html)
        data.append((vectors.of(page.leaves, page.title), labels))
    w = new_weights(rng)
    m = {k: np.zeros_like(v) for k, v in w.items()}
    v = {k: np.zeros_like(x) for k, x in w.items()}
    step, mean, summed = 0, {k: np.zeros_like(x) for k, x in w.items()}, 0
    for r in range(rounds):
        order = sorted(rng.permutation(len(data)), key=lambda i: len(data[i][0]) // 8)
        groups = [order[i : i + 40] for i in range(0, len(order), 40)]
        for k in rng.permutation(len(groups)):
            some = [data[i] for i in groups[k]]
            x, mask = batched([a for a, _ in some])
            y = np.zeros(mask.shape, np.float32)
            y[mask] = np.concatenate([b for _, b in some])
            x *= rng.random((len(x), 1, DIMS)) > 0.08  # no single hashed name decides
            x[rng.random(len(x)) < 0.1, :, :PATH_DIMS] = 0  # nor tags and names alone
            step += 1
            for name, g in gradients(w, x, mask, y).items():
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.999 * v[name] + 0.001 * g * g
                w[name] = (w[name] - (0.01 / (1 + r)) * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            if 2 * r >= rounds:
                summed += 1
                for name in w:
                    mean[name] += (w[name] - mean[name]) / summed
    return mean


def long_page(w: dict, vectors: Vectors, page: Page) -> np.ndarray:
    """The logits of a page of any length, LONG leaves at a time: once forwards, once backwards."""
    n = len(page.leaves)
    z = np.zeros(n, np.float32)
    for side in ("f", "b"):
        state = None
        starts = range(0, n, LONG)
        for at in starts if side == "f" else reversed(starts):
            x = vectors.of(page.leaves[at : at + LONG], page.title, at, n)[None]
            h, state = forward(w, side, x, np.ones(x.shape[:2], bool), state=state)
            z[at : at + LONG] += (h @ w[side + "o"])[0]
            if side == "f":
                z[at : at + LONG] += (x @ w["x"])[0] + w["bias"]
    return z


def labelled(w: dict, vectors: Vectors, pages: list[Page]) -> list[np.ndarray]:
    """For each page which leaves are main text. Pages of similar length are read side by side."""
    size = [len(p.leaves) for p in pages]
    out = [long_page(w, vectors, p) > 0 if n > LONG else np.zeros(0, bool) for p, n in zip(pages, size, strict=True)]
    order = sorted((i for i, n in enumerate(size) if 0 < n <= LONG), key=size.__getitem__)
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * size[order[end]] <= AT_ONCE:
            end += 1
        group = order[at:end]
        x, mask = batched([vectors.of(pages[i].leaves, pages[i].title) for i in group])
        z, _ = logits(w, x, mask)
        for row, i in enumerate(group):
            out[i] = z[row, : size[i]] > 0
        at = end
    return out


def extracted(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars``, the main text of the page in ``column``."""
    sent = pages.sparkSession.sparkContext.broadcast(trained())  # some tens of thousands of numbers

    def make():
        vectors, w = Vectors(), sent.value

        def work(texts: list) -> list[list]:
            read = [parsed(t) for t in texts]
            main = labelled(w, vectors, read)
            found = ["\n".join(x.text for x, on in zip(p.leaves, m, strict=True) if on) for p, m in zip(read, main, strict=True)]
            return [found, [len(t) for t in found]]

        return work

    return map_texts(pages, column, {"text": pa.string(), "n_chars": pa.int64()}, "text string, n_chars long", make)


# --- practice pages: sites of many makes, with known labels ------------------------------------

#: Marks main text in practice pages; it gives a leaf's label and is taken out before its vector is made.
MAIN = "⁣"
PLAIN = (
    "the of and to in a is that for it was on are as with they be at this have from or had by but some what there we can out other were all your when up use how said an each she which do their time if will way "
    "about many then them would write like so these her long make thing see him two has look more day could go come did my sound no most number who over know water than call first people may down side been now "
    "city river market teacher winter council music garden village engine season report doctor history mountain science player station summer family bridge letter kitchen harbour minister museum forest school "
    "la el de que en los se del las un por con no una su para es al lo como más pero sus le ya este entre cuando muy sin sobre también hasta hay donde quien desde todo nos durante ciudad noche agua mundo casa "
    "le les des est dans qui pas sur plus par je avec tout faire son mettre autre on mais nous comme ou leur bien deux même prendre aussi celui donner ville maison temps enfant monde "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum Haus Stadt Jahr Wasser Zeit"
).split()
SEMANTIC = {"menu": "nav", "crumbs": "nav", "pager": "nav", "side": "aside", "foot": "footer", "head": "header", "body": "article", "search": "form", "signup": "form"}
LINKS = "Home|News|Sport|Contact|About us|Shop|Login|Archive|Blog|Products|Services|Help|FAQ|Inicio|Noticias|Contacto|Accueil|Actualités|Startseite|Kontakt|Über uns|Weather|Travel|Culture|Business|Health|Opinion|Video|Photos|Jobs|Register|My account|Cart|Sitemap|Privacy|Terms|Imprint|Impressum".split("|")
SAYS = {
    "side": "Related articles|Related|Read also|Most read|Popular posts|You may also like|Recommended|More from us|Trending now|Latest news|Recent posts|Tags|Categories|Más leídas|À lire aussi|Mehr zum Thema|In other news|Don't miss|Elsewhere",
    "ad": "Advertisement|Sponsored|Anzeige|Publicidad|Publicité|Ad|Promoted|Buy now|Special offer|Save 20% today|Order today, free shipping|Try it free for 30 days|Sale ends soon|Best price guaranteed|Shop the new collection|Get a quote|Limited offer|Click here for our deals",
    "notice": "We use cookies to improve your experience.|This site uses cookies.|By continuing to use this website you accept our cookie policy.|Este sitio utiliza cookies.|Ce site utilise des cookies.|Diese Website verwendet Cookies.|You have read your last free article this month.|Your browser is out of date. Please update it.|We value your privacy.|Accept cookies to continue.|Please log in or register to continue reading.|We and our partners store information on your device.",
    "signup": "Subscribe to our newsletter|Sign up for updates|Get the news by e-mail|Join our mailing list|Enter your email address|Never miss a story|Suscríbete|Inscrivez-vous|Newsletter abonnieren|Stay in touch",
    "share": "Share|Tweet|Facebook|Twitter|Email this|Print|Share on Facebook|Pin it|WhatsApp|LinkedIn|Follow us|Compartir|Partager|Teilen|Copy link|Like",
    "script": "Please enable JavaScript to view this page.|JavaScript is disabled in your browser.|You need JavaScript to run this app.|Enable JavaScript to see the comments.",
    "comments": "Comments|Leave a comment|Comments (3)|12 comments|Discussion|Reader comments|Join the conversation|Responses|Comentarios|Commentaires|Kommentare|What do you think?|Replies|Leave a reply|Reader letters",
    "foot": "All rights reserved.|Copyright 2023|© 2024|Privacy policy|Terms of use|Contact us|Todos los derechos reservados.|Tous droits réservés.|Alle Rechte vorbehalten.|Powered by WordPress|Back to top|Site by|About this site|Company number 1234567|Registered office",
    "pager": "Previous|Next|Older posts|Newer posts|Next page|1|2|3|Previous article|Next article|Siguiente|Suivant|Weiter|Page 1 of 4",
    "search": "Search|Search this site|Go|Buscar|Rechercher|Suche|Find|Keywords",
    "head": "Daily|Times|Journal|The|Online|Gazette|Review|News|Magazine|Blog|Your source for|Independent since 1998",
}
SAYS = {k: v.split("|") for k, v in SAYS.items()}
CUES = [w.lower() for v in [LINKS, *SAYS.values()] for x in v for w in x.split() if w.isalpha()]


def known(html: str) -> tuple[Page, np.ndarray]:
    """A practice page without its marks, and which of its leaves had one."""
    page = parsed(html)
    labels = np.array([MAIN in x.text for x in page.leaves], np.float32)
    leaves = [x._replace(text=x.text.replace(MAIN, "").strip() or "-") for x in page.leaves]
    return page._replace(leaves=leaves, title=page.title.replace(MAIN, "")), labels


class Site:
    """A page's make: its tags, how it names things, and how it writes paragraphs and headings."""

    def __init__(self, rng: random.Random) -> None:
        self.rng = rng
        self.tags = rng.choice(["semantic", "semantic", "div", "div", "table"])
        self.named = rng.choice(["said", "said", "odd", "none", "none"])
        self.para = rng.choice(["p", "p", "open", "div", "br", "span"] if self.tags != "table" else ["p", "open", "br", "br", "font", "div"])
        self.plain = rng.choice([0.1, 0.5, 0.9, 0.97])  # how many of its words are common ones
        self.heading = rng.choice(["h1", "h1", "h1", "h2", "div", "b"])
        self.odd = {k: "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(1, 5))) + rng.choice(["", str(rng.randint(1, 99))]) for k in [*NAMES, "p", "h"]}

    def word(self) -> str:
        rng = self.rng
        if rng.random() < 0.02:
            return rng.choice([str(rng.randint(1, 99)), str(rng.randint(1100, 2030)), f"{rng.randint(1, 900)},{rng.randint(0, 9)}", f"{rng.randint(1, 99)}%"])
        if rng.random() < self.plain:
            return rng.choice(PLAIN)
        return "".join(rng.choice(["", *"bcdfglmnprstvz", "st", "tr", "ch"]) + rng.choice(["a", "e", "i", "o", "u", "ou", "ie", "é", "ü", "ñá"]) for _ in range(rng.randint(1, 4))) + rng.choice(["", *"nrslt"])

    def words(self, lo: int, hi: int, stop: bool = True) -> str:
        rng = self.rng
        out = [self.word() for _ in range(rng.randint(lo, hi))]
        if rng.random() < 0.1:  # formulas, prices, code: odd signs are no sign of what surrounds an article
            out = [w + rng.choice(["", "", *"*#$%|&!", "()", "=1", "---"]) for w in out]
        for i in range(rng.randint(6, 14), len(out) - 1, rng.randint(7, 15)):
            out[i] += rng.choice(".,.;")
        text = " ".join(out).replace("&", "&amp;").replace("<", "&lt;")
        return text[:1].upper() + text[1:] + (rng.choice([".", ".", ".", "!", "?", "", "..."]) if stop else "")

    def box(self, kind: str, inner: str, tag: str | None = None) -> str:
        rng = self.rng
        tag = tag or (SEMANTIC.get(kind) if self.tags == "semantic" and rng.random() < 0.85 else None) or rng.choice(["div", "div", "div", "section"] if self.tags == "div" else ["div", "section"] if self.tags == "semantic" else ["div", "td", "td", "center", "font"])
        name = ""
        if self.named == "said" and kind in NAMES and rng.random() < 0.9:
            name = rng.choice(NAMES[kind].split()) + rng.choice(["", "", " box", "-wrap", " wide", "1"])
        elif self.named == "odd" and kind in self.odd:
            name = self.odd[kind]
        attr = f' {rng.choice(["class", "class", "id"])}="{name}"' if name else ""
        a, b = f"<{tag}{attr}>", f"</{tag}>"
        if tag == "td":
            return f"<table><tr>{a}{inner}{b}</tr></table>"
        return a + inner + b

    # --- the article ---

    def prose(self, lo: int, hi: int) -> str:
        rng, text = self.rng, self.words(lo, hi)
        if rng.random() < 0.04:  # a stutter is no sign of it either
            text = " ".join([w for w in text.split(" ")[: rng.randint(1, 8)] for _ in range(rng.randint(5, 40))])
        elif rng.random() < 0.4:  # an article has the words of menus and notices too
            own = text.split(" ")
            for _ in range(rng.randint(1, 1 + len(own) // 5)):
                own.insert(rng.randint(0, len(own) - 1), rng.choice(CUES))
            text = " ".join(own)
        if rng.random() < 0.1:
            text = rng.choice(['"{}"', "«{}»", '"{}", said ' + self.word(), "{}:", "- {}", "{} (" + self.word() + ")", self.word() + "'s {}"]).format(text.rstrip("."))
        if rng.random() < 0.2 and " " in text:
            a, b, *rest = [*text.split(" ", 2), ""]
            tag = rng.choice(["b", "em", "strong", "i", "a href=/x", "span", "code"])
            text = f"{a} <{tag}>{b}</{tag.split()[0]}> {rest[0]}" if rng.random() < 0.7 else f"<{tag}>{text}"
        if rng.random() < 0.08:
            text = text.replace(" ", "<br>", 1)
        return MAIN + text

    def paragraphs(self, some: list[str]) -> str:
        rng, kind = self.rng, self.para
        if kind == "br":
            gap = rng.choice(["<br><br>", "<br /><br />", "<br>\n<br>"])
            return f"<div>{gap.join(some)}</div>" if rng.random() < 0.5 else gap.join(some) + gap
        if kind == "open":
            return "".join(f"<p>{x}" + rng.choice(["", "", "\n", "<br>"]) for x in some)
        name = f' class="{self.odd["p"]}"' if self.named == "odd" and rng.random() < 0.5 else ""
        a, b = {"p": (f"<p{name}>", "</p>"), "div": (f"<div{name}>", "</div>"), "span": (f"<div><span{name}>", "</span></div>"), "font": ("<p><font size=2>", "</font></p>")}[kind]
        return "".join(a + x + b for x in some)

    def headline(self, title: str) -> str:
        t = MAIN + title
        name = f' class="{rng_name}"' if (rng_name := self.odd["h"] if self.named == "odd" else self.rng.choice(["", "title", "headline"]) if self.named == "said" else "") else ""
        return {"h1": f"<h1{name}>{t}</h1>", "h2": f"<h2{name}>{t}</h2>", "div": f"<div{name}>{t}</div>", "b": f"<p><font size=5><b>{t}</b></font></p>"}[self.heading]

    def article(self, title: str) -> str:
        rng, out = self.rng, []
        if rng.random() < 0.88:
            out.append(self.headline(title if rng.random() < 0.75 else self.words(2, 12, False)))
            if rng.random() < 0.25:
                out.append(self.extra(rng.choice(["ad", "share", "share", "signup", "notice"])))
        for _ in range(rng.choice([1, 2, 3, 4, 6, 8])):
            kind = rng.random()
            if kind < 0.74:
                out.append(self.paragraphs([self.prose(*rng.choice([(1, 4), (5, 30), (8, 20), (12, 40), (20, 90), (60, 160)])) for _ in range(rng.randint(1, 4))]))
            elif kind < 0.8:
                out.append(f"<h{(k := rng.choice('234'))}>{self.prose(1, 8)}</h{k}>")
            elif kind < 0.86:
                if rng.random() < 0.4:
                    out.append(f"<p>{MAIN}{self.words(1, 6, False)}:</p>")
                end, kind = rng.choice(["</li>", "</li>", ""]), rng.choice(["ul", "ul", "ol"])
                out.append(f"<{kind}>" + "".join(f"<li>{self.prose(*rng.choice([(1, 5), (2, 18)]))}{end}" for _ in range(rng.randint(2, 5))) + f"</{kind}>")
            elif kind < 0.9:
                out.append(f"<blockquote>{self.paragraphs([self.prose(6, 40)])}</blockquote>")
            elif kind < 0.93:
                head = f"<tr><th>{self.prose(1, 2)}</th><th>{self.prose(1, 2)}</th></tr>" * rng.randint(0, 1)
                out.append(f"<table>{head}" + "".join(f"<tr><td>{self.prose(1, 4)}</td><td>{self.prose(1, 4)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>")
            elif kind < 0.95:
                out.append(rng.choice(["<p>{}</p>", "<noscript><p>{}</p></noscript>", "<object><p>{}</p></object>"]).format(self.prose(6, 40)))
            else:
                out.append(self.extra(rng.choice(["ad", "side", "share", "signup"])))
        inner = "".join(out)
        if self.tags == "semantic":
            inner = rng.choice(["<article>{}</article>", "<article>{}</article>", "<main><article>{}</article></main>", "<main>{}</main>"]).format(inner)
        elif rng.random() < 0.6:
            inner = self.box("body", inner)
        for _ in range(rng.choice([0, 0, 0, 1, 2, 4])):
            inner = self.box("wrap", inner, "div")
        return inner

    # --- what surrounds it ---

    def links(self, lo: int, hi: int, names: list[str] | None = None) -> str:
        rng = self.rng
        said = [rng.choice(names or LINKS) if names or rng.random() < 0.5 else self.words(1, 4, False) for _ in range(rng.randint(lo, hi))]
        a = [f'<a href="/{i}">{x}</a>' for i, x in enumerate(said)]
        style = rng.random()
        if style < 0.55:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in a) + "</ul>"
        if style < 0.75:
            return rng.choice([" | ", " · ", " - ", " ", "<br>"]).join(a)
        if style < 0.9:
            return "".join(f"<div>{x}</div>" for x in a)
        return "<table><tr>" + "".join(f"<td>{x}</td>" for x in a) + "</tr></table>"

    def says(self, kind: str) -> str:
        return self.rng.choice(SAYS[kind])

    def extra(self, kind: str) -> str:
        rng = self.rng
        clear = self.named == "said" or self.tags == "semantic"  # the markup says what it is: the words need not
        if kind == "menu":
            return self.box(kind, self.links(2, 9))
        if kind == "crumbs":
            return self.box(kind, rng.choice([" &gt; ", " &raquo; ", " / "]).join([f'<a href="/">{rng.choice(LINKS)}</a>' for _ in range(rng.randint(1, 3))] + [self.words(1, 5, False)] * rng.randint(0, 1)))
        if kind == "head":
            name = f"{self.says('head')} {self.words(1, 2, False)}" if rng.random() < 0.6 else self.words(1, 4, False)
            name = rng.choice(["<div>{}</div>", "<p>{}</p>", "<h1>{}</h1>", "<h2>{}</h2>", '<a href="/">{}</a>']).format(name)
            return self.box(kind, name + (f"<p>{self.words(2, 8, False)}</p>" if rng.random() < 0.3 else ""))
        if kind == "foot":
            year = rng.choice(["Copyright", "©", "&copy;", "Copyright ©"]) + f" {rng.randint(1995, 2026)} {self.words(1, 3, False)}."
            parts = [year] * rng.randint(0, 1) + [self.says("foot") for _ in range(rng.randint(1, 3))] + [f"{self.word()}.example"] * rng.randint(0, 1)
            body = rng.choice([f"&copy; {self.word()} &middot; {self.words(2, 14)}", " ".join(parts), f"<p>{'</p><p>'.join(parts)}</p>", self.links(2, 5, LINKS) + parts[0]])
            return self.box(kind, f"<p>{self.words(4, 30)}</p>" if self.named == "said" and self.tags == "semantic" and rng.random() < 0.3 else body)
        if kind == "side":
            h = rng.choice("234")
            body = rng.choice([self.links(2, 6), "".join(f'<p><a href="/{i}">{self.words(3, 10, False)}</a></p>' for i in range(rng.randint(1, 4))), f"<p>{self.words(4, 30)}</p>" if clear else self.links(2, 5), "".join(f'<div><a href="/{i}">{self.words(2, 8, False)}</a><p>{self.words(4, 14)}</p></div>' for i in range(rng.randint(2, 4)))])
            return self.box(kind, rng.choice([f"<h{h}>{self.says('side')}</h{h}>", f"<b>{self.says('side')}</b>", f"<div>{self.says('side')}</div>"]) + body)
        if kind == "ad":
            if self.named == "said" and rng.random() < 0.6:
                return f'<div class="{rng.choice(NAMES["ad"].split())}">' + rng.choice([self.words(3, 20), self.words(3, 20), f'<a href="/b">{self.words(2, 9)}</a>']) + "</div>"
            return self.box(kind, rng.choice([f"{self.says('ad')}: {self.words(2, 12)}", f"<p>{self.says('ad')}</p><p>{self.words(3, 15)} {self.says('ad')}</p>", f'<a href="/b">{self.says("ad")} - {self.words(2, 8)}</a>', self.says("ad")]))
        if kind == "notice":
            more = f" {self.words(3, 15)}" if rng.random() < 0.4 else ""
            return self.box(kind, rng.choice([f"<p>{self.says('notice')}{more}</p><button>{rng.choice(['OK', 'Accept', 'Close', 'Aceptar', 'Got it'])}</button>", f'{self.says("notice")}{more} <a href="/p">{rng.choice(["OK", "Learn more", "Accept"])}</a>']))
        if kind == "script":
            return f"<noscript>{self.says('script')}</noscript>" if rng.random() < 0.7 else self.box(kind, self.says("script"))
        if kind == "signup":
            return self.box(kind, f"<h3>{self.says('signup')}</h3>" * rng.randint(0, 1) + f'<p>{self.says("signup")}</p><input name="email"><button>{rng.choice(["Subscribe", "Sign up", "OK", "Send"])}</button>')
        if kind == "search":
            option = "<select><option>All</option><option>News</option></select>" if rng.random() < 0.3 else ""
            return f'<form action="/s"><label>{self.says("search")}</label><input name="q">{option}<button>{self.says("search")}</button></form>'
        if kind == "share":
            return self.box(kind, self.links(2, 5, SAYS["share"]))
        if kind == "pager":
            return self.box(kind, self.links(1, 4, SAYS["pager"]))
        said = []
        for _ in range(rng.randint(1, 5)):
            who, text = self.words(1, 2, False), self.words(3, 45)
            when = rng.choice(["2 hours ago", "May 3, 2021", "yesterday at 10:15", "12.03.2020", "3 days ago", ""])
            reply = rng.choice(["", '<a href="#r">Reply</a>', "<span>Reply</span> <span>Like</span>", '<div><a href="#r">Reply</a> <a href="#f">Report</a></div>'])
            head = rng.choice([f"<b>{who}</b> {when}", f"<div>{who} says:</div>", f"<span>{who}</span> <time>{when}</time>", f"{who} wrote: ", f"<cite>{who}</cite> <em>{when}</em>"])
            said.append(rng.choice([f"{head}<p>{text}</p>{reply}", f"<p>{head} {text} {reply}</p>", f"<div>{head}</div><div>{text}</div>{reply}", f"<p>{text}</p>{reply}" if clear else f"<p>{head}</p><p>{text}</p>"]))
        item = rng.choice(["li", "div", 'article class="comment"', "div"])
        label = f"<h3>{self.says('comments')}</h3>" if rng.random() < 0.85 or not clear else ""
        body = "".join(f"<{item}>{x}</{item.split()[0]}>" for x in said)
        return self.box("comments", label + (f"<ol>{body}</ol>" if item == "li" else body))


def practice_pages(n: int, seed: int) -> list[str]:
    rng, pages = random.Random(seed), []
    before = {"script": 0.1, "notice": 0.25, "head": 0.4, "search": 0.2, "menu": 0.75, "crumbs": 0.2, "ad": 0.35, "side": 0.15, "signup": 0.05}
    after = {"share": 0.2, "comments": 0.4, "side": 0.3, "ad": 0.2, "signup": 0.15, "pager": 0.15, "menu": 0.12, "notice": 0.1, "foot": 0.75}
    for _ in range(n):
        s = Site(rng)
        title = s.words(2, 10, False)
        top = [s.extra(k) for k in before if rng.random() < before[k]]
        if rng.random() < 0.4:
            rng.shuffle(top)
        end = [s.extra(k) for k in after if rng.random() < after[k]]
        if rng.random() < 0.2:
            rng.shuffle(end)
        main = s.article(title) if rng.random() < 0.97 else ""
        if s.tags == "table" and rng.random() < 0.7:  # columns of one table
            left, right = "".join(top[1:]), "".join(end[:-1]) if rng.random() < 0.3 else ""
            cells = [f"<td>{x}</td>" for x in (left, main, right) if x]
            body = "".join(top[:1]) + f"<table><tr>{''.join(cells)}</tr></table>" + "".join(end[-1:] if right else end)
        else:
            body = "".join(top) + main + "".join(end)
        if rng.random() < 0.25:
            body = s.box("wrap", body, rng.choice(["div", "div", "section", "center"]))
        if rng.random() < 0.1:  # some servers put a whole page into one form
            body = f'<form id="{rng.choice(["form1", "main", "aspnet", s.odd["body"]])}">{body}</form>'
        full = rng.choice([title, title, f"{title} - {s.words(1, 2, False)}", f"{title} | {rng.choice(LINKS)}", s.words(1, 3, False)])
        pages.append(f"<!DOCTYPE html><html><head><title>{full}</title><style>p{{}}</style></head><body>{body}</body></html>")
    return pages
