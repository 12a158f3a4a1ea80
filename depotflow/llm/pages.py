"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read into blocks: the text between two block-level tags, with the tags, classes, ids and
roles above it. Scripts, styles, markup comments, controls and the head hold no text. Features of
a block are its ancestors, their classes by distance, and its text (length, links, punctuation, place);
neighbouring labels are tied by transition weights. Classes of the page as a whole (``html``, ``body``, ``article``,
``main``) tell of the layout, not of a block, and are no features. Training maximises the likelihood of labelled
pages, a bounded sample; pages label themselves where they mark their article
(``article`` or ``main``), and fixed pages show other layouts. Viterbi finds the best
labels of a page; its main blocks are joined by line breaks.
"""

from __future__ import annotations

import html
import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages that training reads at most, about; they are taken by a hash of the id.
SAMPLE_PAGES = 600
ROUNDS = 120
RIDGE = 0.002

# What HTML says about its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template textarea title head svg math iframe object "
                   "select option datalist button audio video canvas dialog".split())
RAW = frozenset("script style textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main "
    "menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {  # an opening tag ends these open elements, up to the ones after the slash
    "p": ("p", ""), "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"),
    "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
}
ENDS_P = BLOCK - frozenset("dd dt li td th tr tbody thead tfoot body html caption legend".split())
CHROME = frozenset("nav footer aside form menu search".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog".split())
OUTER = frozenset("html body article main".split())
# Words of class names that page furniture goes by, and what turns such a word into a setting.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies "
    "consent discussion disqus feedback foot footer header login menu modal nav navbar navigation newsletter notice "
    "notices pager pagination popup promo promos promotion reactions related remark remarks replies respond reviews share sharing side "
    "sidebar social sponsor sponsored sponsors subscribe tags talkback thread toolbar widget widgets".split())
SETTINGS = frozenset("has with without no is show hide".split())  # as a first part
STATES = frozenset("open closed fixed sticky enabled disabled on off".split())  # as a last part

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>"""
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.DOTALL)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""",
                       re.IGNORECASE)
END_OF_RAW = {name: re.compile(rf"</{name}[\s/>]", re.IGNORECASE) for name in RAW}
SPACES = re.compile(r"\s+")
PARTS = re.compile(r"[-_]+")
FARTHEST = 3  # elements above a block, beyond which the distance is not told apart


class Element(NamedTuple):
    tag: str
    names: tuple[str, ...]  # classes and ids
    hints: tuple[str, ...]  # words among them that page furniture goes by
    apart: bool  # tag, role or style of page furniture


@dataclass
class Block:
    text: str
    path: tuple[Element, ...]
    links: int  # characters inside links


def hints(names: tuple[str, ...]) -> tuple[str, ...]:
    """Words of page furniture in class names, but for names of settings and states."""
    out = []
    for name in names:
        parts = PARTS.split(name)
        if len(parts) == 1 or not (parts[0] in SETTINGS or parts[-1] in STATES):
            out += [part for part in parts if part in HINTS]
    return tuple(out)


def element(tag: str, attributes: str) -> Element:
    """What an element says of the blocks below it."""
    names, apart = [], tag in CHROME
    for name, value in ATTRIBUTE.findall(attributes) if "=" in attributes or "hidden" in attributes else ():
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            names += value.lower().split() if tag not in OUTER else []
        elif name == "role":
            apart = apart or value.lower() in CHROME_ROLES
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            apart = True
        elif name == "style":
            apart = apart or "display:none" in value.replace(" ", "").lower()
    return Element(tag, tuple(names), hints(tuple(names)), apart)


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in page order."""
    out: list[Block] = []
    stack: list[Element] = []
    pieces: list[str] = []
    links = unseen = in_link = 0
    path: tuple | None = None

    def flush() -> None:
        nonlocal links, path
        text = SPACES.sub(" ", "".join(pieces)).strip()
        if text:
            out.append(Block(text, path or (), links))
        pieces.clear()
        links, path = 0, None

    def add(raw: str) -> None:
        nonlocal links, path
        if unseen or not raw:
            return
        text = html.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if not text.isspace():
            path = path or tuple(stack)
            links += len(text) if in_link else 0

    def pop_to(at: int) -> None:
        nonlocal unseen, in_link
        for gone in stack[at:]:
            unseen -= gone.tag in UNSEEN
            in_link -= gone.tag == "a"
        del stack[at:]

    at = 0
    while True:
        match = TAG.search(page, at)
        if not match:
            add(page[at:])
            break
        add(page[at:match.start()])
        at = match.end()
        name = match[2] or match[5]
        if not name:
            continue
        tag, closing, attributes = name.lower(), match[1] or match[4], match[3] or match[6] or ""
        if tag in BLOCK:
            flush()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    pop_to(i)
                    break
                if stack[i].tag in BLOCK and tag not in BLOCK:
                    break
            continue
        if tag == "br":
            add(" ")
        if tag in VOID:
            continue
        ends, stop = CLOSES.get(tag, ("p", "") if tag in ENDS_P else ("", ""))
        if ends:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in ends.split():
                    pop_to(i)
                elif stack[i].tag in stop.split() or (ends == "p" and stack[i].tag in BLOCK):
                    break
        if attributes.endswith("/") and tag in ("svg", "math"):
            continue
        if tag in RAW:
            end = END_OF_RAW[tag].search(page, at)
            at = end.start() if end else len(page)
        opened = element(tag, attributes) if attributes else Element(tag, (), (), tag in CHROME)
        if tag == "header" and not any(e.tag in ("article", "main") for e in stack):
            opened = opened._replace(apart=True)
        stack.append(opened)
        unseen += tag in UNSEEN
        in_link += tag == "a"
    flush()
    return out


def self_label(block: Block) -> bool:
    """Whether a page that marks its article says that a block belongs to it."""
    return (any(e.tag in ("article", "main") for e in block.path)
            and not any(e.apart or e.hints for e in block.path))


def features(page: list[Block]) -> list[list[str]]:
    out, n = [], len(page)
    for i, block in enumerate(page):
        text = block.text
        tags = [e.tag for e in block.path]
        nearest = next((t for t in reversed(tags) if t in BLOCK), "none")
        words = text.count(" ") + 1
        own = {"1", f"near {nearest}", f"words {min(9, int(math.log2(words)))}",
               f"links {min(4, 5 * block.links // (len(text) + 1))}",
               f"inside {'article' in tags or 'main' in tags}",
               f"end {text[-1] if text[-1] in '.!?:;' else 'other'}",
               f"from {min(3, 4 * i // n)}", f"first {i == 0}", f"last {i == n - 1}"}
        for distance, above in enumerate(reversed(block.path)):
            far = min(distance, FARTHEST)
            own.add(f"in {above.tag}")
            own.update(f"class {name} {far}" for name in above.names)
            own.update(f"hint {word}" for word in above.hints)
            if above.hints:
                own.add(f"hint at {far}")
            if above.apart:
                own.add(f"apart at {far}")
        if text[0] in "©" or "©" in text[:40]:
            own.add("copyright")
        out.append(sorted(own))
    return out


# Fixed pages of other layouts; a block that begins with "+" is main text.
EXAMPLES = (
    '<body><header><a href="/">Site</a></header><main><article><h1>+A long title of a story</h1><p>+First '
    'words of a story that goes on for a while.</p><ul><li>+one point of it</li></ul><section '
    'class="comments"><h3>Comments</h3><p>I do not agree with this at all.</p></section></article></main>'
    '<aside class="sidebar"><p>Related things</p></aside><footer>© us</footer></body>',
    '<body><div id="menu"><a href="/a">a</a></div><div class="notice">We use cookies.</div><div '
    'class="content"><h2>+On things</h2><p>+Much has been said of things, and more will be.</p><div class='
    '"ad">Buy this now.</div><p>+So it goes on, at some length, to its end.</p></div><form><label>Your '
    'mail</label></form><div id="comments"><p>A remark of a reader that is long.</p></div><div '
    'class="footer">Imprint</div></body>',
    '<body><p>+A page of plain words without any frame around them.</p><p>+And a second one.</p></body>',
    '<body><nav><a href="/">Home</a></nav><article><header><h1>+Title of it</h1></header><p>+Some text that '
    'has a <a href="/x">link</a> in it.</p><aside>Read also: others</aside><table><tr><td>+cell</td></tr>'
    '</table><blockquote>+A quoted line.</blockquote><form><p>Leave a reply</p></form></article></body>',
)


@dataclass
class Field:
    """A linear-chain CRF with two labels: weights of features, first labels and transitions."""

    names: dict[str, int]
    weights: np.ndarray  # features x 2
    start: np.ndarray
    step: np.ndarray  # 2 x 2

    def label(self, page: list[Block]) -> list[bool]:
        """The most likely labels of the blocks (Viterbi)."""
        if not page:
            return []
        back, known = [], self.names
        best = None
        for own in features(page):
            here = self.weights[[known[f] for f in own if f in known]].sum(axis=0)
            if best is None:
                best = self.start + here
                continue
            score = best[:, None] + self.step
            back.append(score.argmax(axis=0))
            best = score.max(axis=0) + here
        label = int(best.argmax())
        out = [label]
        for choice in reversed(back):
            label = int(choice[label])
            out.append(label)
        return [bool(x) for x in reversed(out)]

    def text(self, page: str | None) -> str:
        found = blocks(page or "")
        return "\n".join(b.text for b, main in zip(found, self.label(found), strict=True) if main)


def fit(pages: list[tuple[list[Block], list[bool]]], rounds: int = ROUNDS, ridge: float = RIDGE) -> Field:
    """Maximise the penalised likelihood by gradient steps (Adam) over all pages at once."""
    pages = [p for p in pages if p[0]]
    names: dict[str, int] = {}
    index, owner, length, gold = [], [], [], []
    n = 0
    for found, labels in pages:
        for own in features(found):
            for f in own:
                index.append(names.setdefault(f, len(names)))
                owner.append(n)
            n += 1
        length.append(len(found))
        gold += labels
    index, owner, length = np.array(index), np.array(owner), np.array(length)
    gold = np.array(gold, int)
    first = np.cumsum(length) - length
    order = np.argsort(-length, kind="stable")  # at step t the first pages of this order have a block
    first, length = first[order], length[order]
    alive = [int((length > t).sum()) for t in range(length.max())]
    truth = np.zeros((n, 2))
    truth[np.arange(n), gold] = 1
    follows = np.setdiff1d(np.arange(n), first)
    steps_seen = np.zeros((2, 2))
    np.add.at(steps_seen, (gold[follows - 1], gold[follows]), 1)
    size = len(names)
    theta = np.zeros(2 * size + 6)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for i in range(1, rounds + 1):
        weights, start, step = theta[:2 * size].reshape(size, 2), theta[-6:-4], theta[-4:].reshape(2, 2)
        local = np.stack([np.bincount(owner, weights[index, k], n) for k in (0, 1)], axis=1)
        ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
        ahead[first] = start + local[first]
        for t in range(1, len(alive)):
            at = first[:alive[t]] + t
            ahead[at] = np.logaddexp.reduce(ahead[at - 1][:, :, None] + step, axis=1) + local[at]
        for t in range(len(alive) - 1, 0, -1):
            at = first[:alive[t]] + t
            behind[at - 1] = np.logaddexp.reduce(step + (local[at] + behind[at])[:, None, :], axis=2)
        total = np.repeat(np.logaddexp.reduce(ahead[first + length - 1], axis=1), length)
        of_row = np.empty(n)
        of_row[np.concatenate([np.arange(f, f + k) for f, k in zip(first, length, strict=True)])] = total
        share = np.exp(ahead + behind - of_row[:, None])
        pair = np.exp(ahead[follows - 1][:, :, None] + step
                      + (local[follows] + behind[follows])[:, None, :] - of_row[follows][:, None, None])
        error = truth - share
        slope = np.concatenate([
            np.stack([np.bincount(index, error[owner, k], size) for k in (0, 1)], axis=1).ravel(),
            error[first].sum(axis=0), (steps_seen - pair.sum(axis=0)).ravel()]) / len(pages) - ridge * theta
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope ** 2
        theta = theta + 0.1 * (mean / (1 - 0.9 ** i)) / (np.sqrt(square / (1 - 0.99 ** i)) + 1e-8)
    return Field(names, theta[:2 * size].reshape(size, 2), theta[-6:-4], theta[-4:].reshape(2, 2))


def layouts() -> Iterator[str]:
    """For each word of page furniture, pages that use it: as a part of the page, of the article, and as a setting.

    Texts of all lengths and ends stand in and out of articles alike, so that they tell less than the elements do.
    """
    turn = itertools.count()

    def text() -> str:
        i = next(turn)
        return " ".join(["word"] * (1, 7, 2, 15, 4, 33, 70)[i % 7]) + ("", ".", "?", "", ":")[i % 5]

    for i, word in enumerate(sorted(HINTS)):
        before, after = ("", f"-{i}") if i % 2 else ("page-", "")
        yield (f'<body class="{word}"><div class="page"><div class="{before}{word}{after}"><p>{text()}</p>'
               f'</div><div class="post"><h1>+{text()}</h1><p>+{text()}</p><ul><li>+{text()}</li></ul>'
               f'<p>+{text()}</p></div></div></body>')
        opened, closed = (("<article><div>", "</div></article>"), ("<main><div>", "</div></main>"), ("<div>", "</div>"),
                          ("<main><article>", "</article></main>"))[i % 4]
        apart = ("aside", "footer", "nav", "form", "menu")[i % 5]
        yield (f'<body>{opened}<h1>+{text()}</h1><p>+{text()}</p><ul><li>+{text()}</li></ul><div id="'
               f'{word}"><div><p>{text()}</p></div><p>{text()}</p></div>'
               f'<p>+{text()}</p>{closed}<div class="{before}{word}{after}">{text()}</div></body>')
        yield (f'<body>{opened}<h1>+{text()}</h1><p>+{text()}</p><div class="{before}{word}{after}"><p>{text()}</p>'
               f'<p>{text()}</p></div>{closed}</body>')
        yield (f'<body>{opened}<h2>+{text()}</h2><div class="{before}{word}{after}">{text()}</div><p>+{text()}</p><{apart}>'
               f'{text()}</{apart}>{closed}</body>')
        yield (f'<body><div class="has-{word}"><main><div class="{word}-open"><h2>+{text()}</h2><p>+{text()}'
               f'</p></div></main></div><aside><ul><li>{text()}</li></ul></aside></body>')
        yield (f'<body><h2>+{text()}</h2><p>+{text()}</p><p>+{text()}</p>' + (i % 2) * f'<p id="{word}">{text()}</p>'
               + '</body>')


def example_pages() -> Iterator[tuple[list[Block], list[bool]]]:
    for page in (*EXAMPLES * 5, *list(layouts()) * 2):
        found = blocks(page)
        labels = [b.text.startswith("+") for b in found]
        for b in found:
            b.text = b.text.lstrip("+")
        yield found, labels


def with_furniture(found: list[Block], word: str) -> list[Block]:
    """A page with some of its main blocks again, below the last one, in an element that goes by ``word``."""
    main = [i for i, b in enumerate(found) if self_label(b)]
    if not main:
        return found
    stand = Element("div", (word,), (word,), False)
    copies = [Block(found[i].text, (*found[i].path[:-1], stand, found[i].path[-1]), found[i].links)
              for i in main[::max(1, len(main) // 3)]]
    return found[:main[-1] + 1] + copies + found[main[-1] + 1:]


def without_marks(found: list[Block]) -> list[Block]:
    """A page whose article is in plain elements."""
    return [Block(b.text, tuple(Element("div", (), (), e.apart) if e.tag in ("article", "main") else e for e in b.path),
                  b.links) for b in found]


def train(pages: DataFrame, id_column: str = "page_id", html_column: str = "html",
          sample_pages: int = SAMPLE_PAGES) -> Field:
    """Fit on the fixed pages and about ``sample_pages`` pages that mark their article. Every other one has
    page furniture added inside the article, and of every four two have the marks taken away."""
    marked = pages.select(F.col(id_column).alias("id"), F.col(html_column).alias("html")).where(
        F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    total = marked.count()
    if total > sample_pages:
        share = int(sample_pages / total * 2**32)
        marked = marked.where(F.pmod(F.xxhash64("id"), F.lit(2**32)) < share)
    examples, words = list(example_pages()), itertools.cycle(sorted(HINTS))
    for i, row in enumerate(marked.sort("id").select("html").collect()):  # the bounded sample
        found = blocks(row.html)
        found = with_furniture(found, next(words)) if i % 2 else found
        labels = [self_label(b) for b in found]
        examples.append((without_marks(found) if i % 4 > 1 else found, labels))
    return fit(examples)


def extract(pages: DataFrame, model: Field, id_column: str = "page_id", url_column: str = "url",
            html_column: str = "html") -> DataFrame:
    """Return ``page_id``, ``url``, ``text`` and ``n_chars``, one row per row of ``pages``.

    A null or empty page gives an empty text. Rows may repeat; further columns are left out.
    """
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"),
                        F.col(html_column).alias("html"))
    schema = rows.drop("html").schema.add("text", "string").add("n_chars", "long")
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        field = shared.value
        for batch in batches:
            texts = [field.text(page) for page in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(work, schema)
