"""The main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A leaf block is a run of text without a block boundary in it. Its features are the tags, class, id and role words of its
ancestors (all of them, and those of the nearest ancestor that says anything), its tag, how much of it is links, its
length, its last character, the words of a short block, and where on the page it stands. The field has a weight for each
feature and part of a page, and one for each pair of parts in a row; a page's parts are the most probable sequence by
Viterbi. Blocks of the part ``article`` are the main text, in page order, joined by a line feed.

Training pages are HTML in which ``data-part`` of the nearest ancestor names the part of a block. The tables of this
project hold no such pages, so ``labelled_pages`` writes them: at most ``LABELLED`` pages over several ways to mark up the
same parts, filled with meaningless sentences. The fit is a bounded job on the driver; the model, a few thousand weights,
goes to the tasks, and each page is parsed and decoded on its own in the task that reads it, in time linear in its length.

White space is what ``str.split`` takes as such, a line break counts as white space, character references are decoded.
Scripts, styles, titles, templates and frames hold no text. Null and empty pages, and pages without an article, give an
empty text. Unclosed and misnested tags are closed as browsers do for paragraphs, list items, cells and links; a file that
ends early keeps what it has. Every other column is passed through; rows that repeat, or repeat a page_id, each give a row.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Pages of the training set.
LABELLED = 600
#: Parts of a page; the first is the main text.
PARTS = ("article", "menu", "header", "footer", "sidebar", "notice", "advert", "form", "comments")
#: Blocks of at most so many words have a feature for each word.
SHORT = 25

#: Elements nested deeper count as content of the one at this depth, as in browsers.
DEPTH = 512

_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html label legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead tr ul".split()
)
_UNREAD = frozenset("script style template title iframe noframes noembed object svg math canvas audio video".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that say by themselves what a part is.
_TELLING = frozenset("article main nav header footer aside form section search dialog button label select option textarea fieldset noscript figure".split())
#: An opening tag closes the open elements of these tags, up to the first of the others.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "a": ({"a"}, _BLOCK),
}
_CELLS = frozenset(("td", "th", "table", "caption"))
#: Class and id words of mere layout: they say nothing about a part.
_FRAMES = tuple("wrap wrapper container inner outer col row box block clearfix grid page site holder area panel module".split())
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass(slots=True)
class _Element:
    """An open element; of a block also its part, the features that it and its ancestors give, and those of the nearest that says anything."""

    tag: str
    part: str | None = None
    said: frozenset[str] = frozenset()
    near: frozenset[str] = frozenset(("n:nothing",))


_ROOT = _Element("none")


@dataclass(slots=True)
class Block:
    """A leaf block: its text, the characters of it in links, and the element that it stands in."""

    text: str
    linked: int
    inside: _Element

    @property
    def part(self) -> str | None:
        return self.inside.part


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[_Element] = []
        self.unread: list[str] = []
        self.links = 0
        self.found: list[Block] = []
        self.tags: set[str] = set()
        self._clear()

    def _clear(self) -> None:
        self.pieces: list[str] = []
        self.linked: list[str] = []

    def _flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            self.found.append(Block(text, sum(len(" ".join(x.split())) for x in self.linked), self._inside()))
        self._clear()

    def _inside(self) -> _Element:
        return next((e for e in reversed(self.open) if e.tag in _BLOCK), _ROOT)

    def _pop_to(self, at: int) -> None:
        self.links -= sum(e.tag == "a" for e in self.open[at:])
        del self.open[at:]

    def _close(self, tags: Iterable[str], stop: Iterable[str]) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag in tags:
                self._pop_to(i)
                return
            if self.open[i].tag in stop:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _UNREAD:
            self.unread.append(tag)
        if self.unread:
            return
        if tag == "br":
            self.pieces.append(" ")
        if tag in _BLOCK:
            self._flush()
            self.tags.add(tag)
            if tag not in ("button", "label", "option", "select", "textarea", "optgroup", "legend"):
                self._close({"p"}, _CELLS | {"button"})
        if tag in _CLOSES:
            self._close(*_CLOSES[tag])
        if tag in _VOID or len(self.open) >= DEPTH:
            return
        self.links += tag == "a"
        if tag not in _BLOCK:
            self.open.append(_Element(tag))
            return
        above, own, part = self._inside(), [], None
        if attrs:
            told = dict(attrs)
            part = told.get("data-part")
            own = _NAMES.findall(" ".join(filter(None, (told.get(k) for k in ("class", "id", "role", "itemprop", "aria-label")))))
            own = [w for w in map(str.lower, own) if w not in _FRAMES]
        said, near = above.said, above.near
        if own or tag in _TELLING:
            near = frozenset((f"n:{tag}" if tag in _TELLING else "n:names", *(f"nc:{w}" for w in own)))
            said = said.union((f"a:{tag}",) if tag in _TELLING else (), (f"c:{w}" for w in own))
        self.open.append(_Element(tag, part or above.part, said, near))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in _UNREAD:
            self.handle_starttag(tag, attrs)  # outside of XHTML the slash means nothing

    def handle_endtag(self, tag: str) -> None:
        if self.unread:
            if tag in self.unread:
                while self.unread.pop() != tag:
                    pass
            return
        if tag in _BLOCK:
            self._flush()
            self._close({tag}, () if tag in _CELLS else _CELLS)
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag == tag:
                del self.open[i]
                self.links -= tag == "a"
                return
            if self.open[i].tag in _BLOCK:
                return

    def handle_data(self, data: str) -> None:
        if not self.unread:
            self.pieces.append(data)
            if self.links:
                self.linked.append(data)


def leaf_blocks(html: str | None) -> tuple[list[Block], set[str]]:
    """The leaf blocks of a page in order, and the block tags that it uses."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser._flush()
    return parser.found, parser.tags


#: Words are looked at only where no tag says what the nearest part is: an article may well speak of cookies or rights.
_TOLD = frozenset(f"n:{t}" for t in _TELLING)
_LENGTHS = np.array([1, 2, 4, 8, 16, 32, 64, 128])


def features(blocks: Sequence[Block], tags: set[str]) -> list[list[str]]:
    """The features of each block of a page."""
    out = []
    whole = [t for t in ("article", "main") if t in tags]
    for i, b in enumerate(blocks):
        said = {"bias", f"t:{b.inside.tag}", *b.inside.said, *b.inside.near}
        said.update(f"{n}|{'a:article' in said}" for n in b.inside.near if n.startswith("n:"))
        said.update(f"out:{t}" for t in whole if f"a:{t}" not in said)
        words = b.text.split()
        share = b.linked / len(b.text)
        said.add(f"l:{0 if not b.linked else 1 if share < 0.3 else 2 if share < 0.8 else 3}")
        said.add(f"w:{int(np.searchsorted(_LENGTHS, len(words), 'right'))}")
        said.add(f"e:{b.text[-1] in '.!?…:;。»”\"'}")
        said.add(f"at:{4 * i // len(blocks)}")
        if i == 0:
            said.add("first")
        if i == len(blocks) - 1:
            said.add("last")
        if len(words) <= SHORT and not said & _TOLD:
            said.update(f"x:{w}" for w in {w.strip(".,:;!?()[]\"'").lower() for w in words} if w)
        out.append(sorted(said))
    return out


@dataclass
class Model:
    """Weights of the field: ``index`` numbers the features, ``emit`` has a row for each, ``step`` is from part to part."""

    index: dict[str, int]
    emit: np.ndarray
    start: np.ndarray
    step: np.ndarray

    def scores(self, said: Sequence[Sequence[str]]) -> np.ndarray:
        known = [[self.index[f] for f in row if f in self.index] for row in said]
        return np.array([self.emit[row].sum(axis=0) for row in known]).reshape(len(known), len(PARTS))

    def decode(self, said: Sequence[Sequence[str]]) -> list[int]:
        """The most probable parts of a page's blocks, by Viterbi."""
        scores = self.scores(said)
        if not len(scores):
            return []
        best, back = self.start + scores[0], []
        for row in scores[1:]:
            paths = best[:, None] + self.step
            back.append(paths.argmax(axis=0))
            best = paths.max(axis=0) + row
        out = [int(best.argmax())]
        for pointers in reversed(back):
            out.append(int(pointers[out[-1]]))
        return out[::-1]


def main_text(html: str | None, model: Model) -> str:
    """The main text of one page."""
    blocks, tags = leaf_blocks(html)
    return "\n".join(b.text for b, part in zip(blocks, model.decode(features(blocks, tags)), strict=True) if part == 0)


def fit(pages: Sequence[str], *, rounds: int = 80, penalty: float = 0.1, least: int = 3, rate: float = 0.25) -> Model:
    """Maximise the penalised conditional likelihood of labelled pages, by adaptive gradient steps over all of them.

    Features of fewer than ``least`` pages are left out, and so are words that blocks of the main text use as well; blocks
    without a label are taken as menus.
    """
    read = [(b, features(b, t)) for b, t in map(leaf_blocks, pages) if b]
    if not read:
        raise ValueError("no labelled page has a block")
    seen: dict[str, int] = {}
    for _, said in read:
        for f in set().union(*said):
            seen[f] = seen.get(f, 0) + 1
    uses: dict[str, list[int]] = {}
    for blocks, said in read:
        for b, row in zip(blocks, said, strict=True):
            for f in row:
                uses.setdefault(f, [0, 0])[b.part == PARTS[0]] += 1
    prose = {f for f, (others, own) in uses.items() if f.startswith("x:") and own > 0.3 * others}
    index = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= least and f not in prose))}
    k, n, width = len(PARTS), len(read), max(len(b) for b, _ in read)
    gold = np.full((n, width), -1)
    ids, rows = [], []
    for p, (blocks, said) in enumerate(read):
        gold[p, : len(blocks)] = [PARTS.index(b.part or "menu") for b in blocks]
        for t, row in enumerate(said):
            known = [index[f] for f in row if f in index]
            ids += known
            rows += [p * width + t] * len(known)
    ids_, rows_ = np.array(ids), np.array(rows)
    order = np.argsort(ids_, kind="stable")
    by_feature, feature_rows = ids_[order], rows_[order]
    feature_heads = np.searchsorted(by_feature, np.arange(len(index)))
    row_heads = np.flatnonzero(np.diff(rows_, prepend=-1))
    live = gold >= 0
    there = np.eye(k)[np.where(live, gold, 0)] * live[..., None]
    moves = there[:, :-1, :, None] * there[:, 1:, None, :]
    weights = [np.zeros((len(index), k)), np.zeros(k), np.zeros((k, k))]
    want = [np.add.reduceat(there.reshape(-1, k)[feature_rows], feature_heads), there[:, 0].sum(0), moves.sum((0, 1))]
    speed, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for r in range(1, rounds + 1):
        emit, start, step = weights
        score = np.zeros((n * width, k))
        score[rows_[row_heads]] = np.add.reduceat(emit[ids_], row_heads)
        score = score.reshape(n, width, k)
        score = np.exp(score - score.max(axis=2, keepdims=True))
        move = np.exp(step - step.max())
        ahead, behind, scale = np.zeros_like(score), np.ones_like(score), np.ones((n, width, 1))
        for t in range(width):  # sums over all paths to and from each block, scaled so that they stay in range
            now = (ahead[:, t - 1] @ move if t else np.exp(start - start.max())) * score[:, t]
            scale[:, t] = np.where(live[:, t, None], now.sum(axis=1, keepdims=True), 1)
            ahead[:, t] = np.where(live[:, t, None], now / scale[:, t], 0)
        later = np.zeros((n, width, k))
        for t in range(width - 1, 0, -1):
            later[:, t] = np.where(live[:, t, None], score[:, t] * behind[:, t] / scale[:, t], 0)
            behind[:, t - 1] = np.where(live[:, t, None], later[:, t] @ move.T, 1)
        of_block = ahead * behind * live[..., None]
        of_pair = move * (ahead[:, :-1].reshape(-1, k).T @ later[:, 1:].reshape(-1, k))
        got = [np.add.reduceat(of_block.reshape(-1, k)[feature_rows], feature_heads), of_block[:, 0].sum(0), of_pair]
        for i, w in enumerate(weights):
            slope = want[i] - got[i] - penalty * w
            speed[i] = 0.9 * speed[i] + 0.1 * slope
            square[i] = 0.99 * square[i] + 0.01 * slope * slope
            w += rate * (speed[i] / (1 - 0.9**r)) / (np.sqrt(square[i] / (1 - 0.99**r)) + 1e-6)
    return Model(index, *weights)


# -- training pages -----------------------------------------------------------------------------------------------------

#: Class, id and role words that pages use for their parts.
NAMES = {
    "article": "article post entry content main story article-body post-content entry-content page-content text body-text blog-post hentry story-body prose markdown-body",
    "menu": "nav navigation navbar menu main-menu top-nav breadcrumb breadcrumbs crumbs tabs pagination pager share-links social-links toc skip-links sub-nav",
    "header": "header masthead top-bar site-header branding logo site-title tagline page-header head-line-bar site-branding",
    "footer": "footer site-footer bottom colophon copyright legal foot page-footer footer-links imprint contentinfo",
    "sidebar": "sidebar side rail widget widgets secondary related related-posts recommended popular trending recent-posts tag-cloud side-column more-stories complementary",
    "notice": "cookie cookies cookie-banner consent gdpr notice alert popup modal overlay privacy-notice paywall announcement cookie-notice site-message toast",
    "advert": "ad ads advert advertisement adsense sponsor sponsored promo promotion ad-box ad-slot banner-ad ad-unit outbrain commercial advertorial",
    "form": "form search search-form login sign-in sign-up newsletter subscribe contact-form register form-row searchbox",
    "comments": "comment comments comment-list commentlist respond reply replies disqus discussion responses thread comment-body reader-comments user-comments reviews",
}
#: Words that short blocks of a part are made of, besides others.
PHRASES = {
    "menu": ["Home", "About", "Contact", "News", "Archive", "Next", "Previous", "Share", "Top", "More", "Accueil", "Startseite", "Inicio", "Kontakt"],
    "header": ["Welcome to", "The daily", "Skip to content", "Menu", "Search", "Log in"],
    "footer": ["©", "© 2024", "Copyright", "All rights reserved.", "Privacy policy", "Terms of use", "Imprint", "Impressum", "Mentions légales", "Powered by"],
    "sidebar": ["Related", "Most read", "Popular posts", "Recent posts", "Tags", "Categories", "You may also like", "See also"],
    "notice": ["We use cookies", "This site uses cookies.", "Accept", "Accept all", "By continuing you agree", "Cookies", "Subscribe to read on", "Wir verwenden Cookies", "Ce site utilise des cookies"],
    "advert": ["Advertisement", "Sponsored", "Ad", "Promoted", "Anzeige", "Publicité", "Buy now", "Learn more"],
    "form": ["Search", "Your email", "Subscribe", "Sign up", "Submit", "Name", "Password", "Log in", "Send"],
    "comments": ["Comments", "Leave a comment", "Reply", "says:", "Posted by", "3 comments", "Kommentare", "Commentaires", "wrote"],
}
_TAGS = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "notice": "div", "advert": "div", "form": "form", "comments": "section", "article": "article"}
_SOUNDS = "an be ca de el fo gi ha in jo ka le mi no or pa qui re sti to un ve wo xa yl zu é ü ción ß ø ch sh th ing ed ly".split()


class _Writer:
    """One page; ``way`` is how its parts are marked: by tag, by class or id, both, or not at all."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.way = self.r.choice(["tag", "tag", "name", "name", "both", "bare"])

    def sentence(self, words: int) -> str:
        said = " ".join("".join(self.r.choice(_SOUNDS) for _ in range(self.r.randint(1, 4))) for _ in range(words))
        return said[:1].upper() + said[1:] + self.r.choice([".", ".", ".", "?", "!", "", " ###", ","])

    def prose(self) -> str:
        if self.way != "bare" and self.r.random() < 0.06:  # articles speak of rights, cookies and comments too
            return self.phrase(self.r.choice(list(PHRASES)))
        words = self.r.choice([1, 2, 3, 5, 9, 14, 20, 30, 45, 60, 90, 140, 220])
        text = self.sentence(words) if words < 12 else " ".join(self.sentence(self.r.randint(4, 16)) for _ in range(max(1, words // 10)))
        if self.r.random() < 0.15:
            text += f' <a href="/x">{self.sentence(2)}</a> {self.sentence(3)}'
        return f"<b>{text}</b>" if self.r.random() < 0.1 else text

    def part(self, part: str, inner: str, tag: str | None = None) -> str:
        tag = tag or _TAGS[part]
        name = self.r.choice(NAMES[part].split())
        if self.r.random() < 0.3:
            name = name.replace("-", self.r.choice(["_", "-"]))
        mark = self.r.choice([f' class="{name}"', f' id="{name}"', f' class="{self.r.choice(_FRAMES)} {name}"'])
        if self.way == "bare" and part not in ("advert", "comments", "notice", "form", "sidebar"):  # those could not be told from prose
            tag, mark = "div", ""
        elif self.way == "name" and part != "form":
            tag = "div" if self.r.random() < 0.9 else "section"
        elif self.way == "tag" and tag not in ("div", "section"):
            mark = "" if self.r.random() < 0.8 else mark
        body = inner if self.r.random() < 0.7 else f'<div class="{self.r.choice(_FRAMES)}">{inner}</div>'
        return f'<{tag}{mark} data-part="{part}">{body}</{tag}>'

    def links(self, part: str, least: int = 2, most: int = 7) -> str:
        said = [self.r.choice(PHRASES[part]) if self.r.random() < 0.4 else self.sentence(self.r.randint(1, 4)) for _ in range(self.r.randint(least, most))]
        kind = self.r.choice(["ul", "ul", "span", "p"])
        if kind == "ul":
            return "<ul>" + "".join(f'<li><a href="/{i}">{x}</a>' + self.r.choice(["</li>", "</li>", ""]) for i, x in enumerate(said)) + "</ul>"
        return "".join(f'<{kind}><a href="/{i}">{x}</a></{kind}>{self.r.choice([" | ", " ", ""])}' for i, x in enumerate(said))

    def phrase(self, part: str) -> str:
        said = self.r.choice(PHRASES[part])
        return said if self.r.random() < 0.5 else f"{said} {self.sentence(self.r.randint(1, 12))}"

    def menu(self) -> str:
        return self.part("menu", self.links("menu"))

    def header(self) -> str:
        return self.part("header", self.r.choice([f"<h1>{self.sentence(2)}</h1>", f"<div>{self.sentence(3)}</div><p>{self.phrase('header')}</p>", f"<p>{self.phrase('header')}</p>" + (self.menu() if self.r.random() < 0.5 else "")]))

    def footer(self) -> str:
        return self.part("footer", self.r.choice([f"{self.phrase('footer')} &middot; {self.prose()}", f"<p>{self.phrase('footer')}</p>{self.links('footer')}", f"&copy; {self.sentence(1)} {self.prose()}", f"<p>{self.prose()}</p><p>{self.phrase('footer')}</p>"]))

    def sidebar(self) -> str:
        return self.part("sidebar", f"<h{(n := self.r.randint(2, 4))}>{self.phrase('sidebar')}</h{n}>" + (self.links("sidebar") if self.r.random() < 0.7 else f"<p>{self.prose()}</p><p>{self.prose()}</p>"))

    def notice(self) -> str:
        body = f"<p>{self.phrase('notice')} {self.prose() if self.r.random() < 0.5 else ''}</p>"
        return self.part("notice", body + self.r.choice(["", "<button>Accept</button>", "<button>OK</button>", '<a href="/p">Privacy</a>']), self.r.choice(["div", "div", "dialog", "section", "aside", "noscript"]))

    def advert(self) -> str:
        return self.part("advert", self.r.choice([self.prose(), f"<p>{self.prose()}</p>", f"<span>{self.r.choice(PHRASES['advert'])}</span> {self.prose()}", f"<p>{self.r.choice(PHRASES['advert'])}</p><p>{self.prose()}</p>"]), self.r.choice(["div", "div", "div", "aside", "section"]))

    def form(self) -> str:
        rows = "".join(f"<label>{self.r.choice(PHRASES['form'])}</label><input name=q>" for _ in range(self.r.randint(0, 3)))
        extra = self.r.choice(["", "<select><option>One<option>Two</select>", f"<textarea>{self.sentence(3)}</textarea>", f"<p>{self.prose()}</p>"])
        return self.part("form", f"{rows}{extra}<button>{self.r.choice(PHRASES['form'])}</button>")

    def comments(self) -> str:
        one = self.r.choice(["li", "div", "article"])
        name = self.r.choice(["comment", "comment-body", "reply", "comment even"])
        said = [f'<{one} class="{name}"><p>{self.sentence(2)} {self.r.choice(["says:", "wrote", "Posted by", ""])}</p><p>{self.prose()}</p>{self.r.choice(["<a>Reply</a>", ""])}</{one}>' for _ in range(self.r.randint(1, 6))]
        title = f"<h3>{self.phrase('comments')}</h3>" if self.r.random() < 0.7 else ""
        return self.part("comments", title + ("<ol>" + "".join(said) + "</ol>" if one == "li" else "".join(said)), self.r.choice(["section", "div", "div"]))

    def body(self) -> str:
        """Blocks of the article itself; what stands between them is of other parts."""
        out = [f"<h{(n := self.r.choice([1, 1, 2]))}>{self.sentence(self.r.randint(1, 12))}</h{n}>"] if self.r.random() < 0.85 else []
        if out and self.r.random() < 0.15:
            out = [f"<header>{out[0]}<p>{self.sentence(4)}</p></header>"]
        for _ in range(self.r.choice([1, 1, 2, 3, 5, 8, 12])):
            kind = self.r.random()
            if kind < 0.68:
                out.append(f"<p>{self.prose()}" + self.r.choice(["</p>", "</p>", "", "<br>"]))
            elif kind < 0.76:
                out.append(f"<h{(n := self.r.choice([2, 3]))}>{self.sentence(self.r.randint(1, 6))}</h{n}>")
            elif kind < 0.84:
                out.append("<ul>" + "".join(f"<li>{self.prose()}</li>" for _ in range(self.r.randint(2, 5))) + "</ul>")
            elif kind < 0.88:
                out.append(f"<blockquote>{self.prose()}</blockquote>")
            elif kind < 0.91:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.sentence(2)}</td>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>")
            elif kind < 0.94:
                out.append(f"<figure><img src=i><figcaption>{self.sentence(8)}</figcaption></figure>")
            elif kind < 0.97:
                out.append(f"<pre>{self.sentence(12)}</pre>")
            else:
                out.append(f"<div>{self.prose()}</div>")
        for other, chance in ((self.advert, 0.3), (self.sidebar, 0.1), (self.form, 0.08), (self.comments, 0.1), (self.notice, 0.05), (self.menu, 0.06)):
            if self.r.random() < chance and self.way != "bare":
                out.insert(self.r.randint(1, len(out)) if other != self.comments else len(out), other())
        return "".join(out)

    def page(self) -> str:
        chance = self.r.random
        before = [f() for f, p in ((self.notice, 0.2), (self.header, 0.5), (self.menu, 0.85), (self.form, 0.2), (self.advert, 0.4), (self.sidebar, 0.15)) if chance() < p]
        after = [f() for f, p in ((self.advert, 0.2), (self.comments, 0.35), (self.form, 0.15), (self.sidebar, 0.4), (self.menu, 0.2), (self.footer, 0.85), (self.notice, 0.2)) if chance() < p]
        if chance() < 0.1:  # nothing but an article
            before, after = [], []
        if chance() < 0.3:
            self.r.shuffle(before)
        main = self.part("article", self.body()) if chance() < 0.94 else ""
        if chance() < 0.25:
            main = self.r.choice(["<main>{}</main>", '<div class="main">{}</div>', '<div id="content">{}</div>', '<section>{}</section>']).format(main + (after.pop(0) if after and chance() < 0.5 else ""))
        if chance() < 0.08:  # a file that ends early
            main, after = main[: self.r.randint(len(main) // 2, len(main))].rpartition("<")[0] or main, []
        inner = "".join(before) + main + "".join(after)
        if chance() < 0.3:
            inner = f'<div class="{self.r.choice(_FRAMES)}">{inner}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.sentence(4)}</title></head><body>{inner}</body></html>"


def labelled_pages(n: int = LABELLED, seed: int = 0) -> list[str]:
    """Pages whose blocks are labelled by ``data-part``; the same for the same seed."""
    return [_Writer(seed * 1_000_003 + i).page() for i in range(n)]


# -- over tables --------------------------------------------------------------------------------------------------------


def extract(pages: DataFrame, model: Model | None = None, *, html: str = "html", names: tuple[str, str] = ("text", "n_chars")) -> DataFrame:
    """``pages`` with the main text of each page and its number of characters; columns of these names are replaced."""
    model = model or fit(labelled_pages())
    kept = [f for f in pages.schema.fields if f.name not in names]
    at = [f.name for f in kept].index(html)
    schema = T.StructType([*kept, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.LongType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), model) for x in batch.column(at)]
            columns = [*batch.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return pages.select(*(pages[f.name] for f in kept)).mapInArrow(read, schema)
