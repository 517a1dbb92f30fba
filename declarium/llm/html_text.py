"""Main text of web pages: a recurrent labeller of text blocks.

A page is read into its sequence of text blocks, each with the path of elements around it. A
bidirectional LSTM in numpy reads the hashed path and words of all blocks of the page in both
directions and decides for every block whether it belongs to the article.

There are no labelled pages. The labeller learns from a bounded sample of the pages themselves:
as they are, where elements that say what they hold label the blocks, and laid out anew under
many other names and elements, so that it also learns from neighbours, words and shape.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from declarium.llm.common import map_arrow, slices

# Pages to learn from, at most: those with the smallest hashes of their ids, among pages of no more
# than so many bytes. Fitted with a fixed seed, so reruns give the same labeller.
SAMPLE = 240
SAMPLE_BYTES = 100_000
LAYOUTS = 5
HIDDEN = 16
PATH_SIZE, WORD_SIZE, SHAPE_SIZE = 256, 64, 5
EPOCHS, BATCH, RATE = 8, 48, 0.02
SEED = 7
# What a worker holds: bytes of pages read together (or one longer page), blocks whose features are
# made at once, and places of one run of the labeller, padding included (or one longer page).
PAGE_BYTES = 1 << 20
BLOCKS_AT_ONCE = 2_048
PLACES = 16_384

# Elements and names that tell what they hold.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
    "ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
# Never shown, or controls of forms: their content is no text of the page.
SKIPPED = frozenset(
    "script style noscript template iframe object svg math head title textarea select option "
    "button canvas audio video datalist".split()
)
RAW = frozenset("script style title textarea iframe noscript template svg math".split())
# Code up to the page's end, if it is not ended before; other elements begin only if they end.
CODE = frozenset("script style".split())
# Elements that none of the skipped ones holds, and such as only some of them may hold.
OUTSIDE = "article main section nav header footer aside body h1 h2 h3 h4 h5 h6"
LINES = "p ul ol dl table blockquote pre form"
HOLDS_NO = {
    "button": f"{OUTSIDE} {LINES}", "datalist": f"{OUTSIDE} {LINES} div",
    "select": f"{OUTSIDE} {LINES} div", "svg": f"{OUTSIDE} {LINES} div", "math": f"{OUTSIDE} {LINES} div",
    **{tag: OUTSIDE for tag in ("object", "canvas", "audio", "video")},
}
# What may stand in a head; all else, and text, ends it.
IN_HEAD = frozenset("base link meta title style script noscript template head".split())
# What an opening element ends.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
SCOPES = frozenset("table ul ol dl article section div body main aside nav td th".split())
MAIN_NAMES = (
    "content post entry story article-body main-content text body-text page-content prose "
    "post-content entry-content article-content article post-body story-body main"
)
NEUTRAL_NAMES = "container wrapper row col page site inner layout grid column wrap holder"
OTHER_NAMES = {
    "nav": "menu navbar navigation breadcrumb breadcrumbs topnav links toc pagination tabs",
    "header": "header masthead banner site-header topbar logo branding",
    "footer": "footer site-footer copyright colophon legal bottom",
    "aside": "sidebar side related recommended widget trending popular author-box tags",
    "div": "ad ads advert advertisement sponsor sponsored promo cookie cookie-banner notice alert "
    "popup modal consent share social newsletter subscribe signup login comments comment "
    "comment-list disqus respond replies",
    "form": "search-form signup-form login-form contact",
}

TAG = re.compile(
    r"<!--.*?(?:--\s*>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>",
    re.S,
)
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
# A slash at the end of an unquoted value belongs to the value.
UNQUOTED_END = re.compile(r"=\s*[^\s\"'][^\s\"']*$")
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int  # characters in links


def closes_itself(attributes: str) -> bool:
    """Whether a tag with these attributes ends with a slash of its own."""
    if not attributes.endswith("/"):
        return False
    return UNQUOTED_END.search(QUOTED.sub('""', attributes)) is None


class Ends:
    """Where the skipped elements of a page end. An end that was not found is not looked for again."""

    def __init__(self, page: str):
        self.page = page
        self.missing: set[str] = set()

    def find(self, tag: str, at: int) -> tuple[int, int] | None:
        """Begin and end of what ends an element: its end tag, or, with both the same, a block that
        the element cannot hold. Drawings hold blocks within foreignObject."""
        if tag in self.missing:
            return None
        found = END_OF[tag].search(self.page, at)
        if found is None:
            self.missing.add(tag)
            return None
        if found[1]:
            return found.start(), found.end()
        if tag == "svg" and FOREIGN.search(self.page, at, found.start()):
            end = CLOSE_SVG.search(self.page, found.start())
            if end:
                return end.start(), end.end()
        return found.start(), found.start()


END_OF = {
    tag: re.compile(
        rf"(</{tag}\s*/?>)" + (rf"|<(?:{'|'.join(HOLDS_NO[tag].split())})(?=[\s/>])" if tag in HOLDS_NO else ""),
        re.I,
    )
    for tag in SKIPPED - {"head", "option"}
}
FOREIGN = re.compile(r"<foreignobject[\s>]", re.I)
CLOSE_SVG = re.compile(r"</svg\s*/?>", re.I)


def read_blocks(page: str) -> list[Block]:
    """The text blocks of a page in order: what stands between two edges of block elements.

    Forgiving: elements end where their parent does, a head where its page's body must have
    begun, unknown ends are passed over, and what cannot be a tag is text. Elements whose content is
    skipped do not begin without an end of their own before a block that they cannot hold; drawings
    end at such a block, and only code goes on to the page's end. Character references are decoded,
    white space becomes one blank.
    """
    blocks: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    linked = skipped = links = at = 0
    ends = Ends(page)

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            path = tuple(name for _, names in stack for name in names)
            blocks.append(Block(path, text, min(linked, len(text))))
        pieces.clear()
        linked = 0

    def end_head() -> None:
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] == "head":
                pop_to(depth)
                break

    def add(text: str) -> None:
        nonlocal linked
        if skipped and stack[-1][0] == "head" and text.strip():
            end_head()
        if text and not skipped:
            pieces.append(text)
            if links:
                linked += len(text)

    def pop_to(depth: int) -> None:
        nonlocal skipped, links
        if any(tag in BLOCKS for tag, _ in stack[depth:]):
            flush()
        for tag, _ in stack[depth:]:
            skipped -= tag in SKIPPED
            links -= tag == "a"
        del stack[depth:]

    while (found := TAG.search(page, at)) is not None:
        add(page[at : found.start()])
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if found[1]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    pop_to(depth)
                    break
            if tag in BLOCKS:
                flush()
            continue
        if skipped and tag not in IN_HEAD:
            end_head()
        if tag in VOID:
            flush() if tag == "hr" else add(" ")
            continue
        if tag in ("svg", "math") and closes_itself(found[3]):
            continue
        if stack and stack[-1][0] == "option" and tag not in ("option", "optgroup"):
            pop_to(len(stack) - 1)
        if tag in RAW:
            end = ends.find(tag, at)
            if end or tag in CODE:
                at = end[1] if end else len(page)
            else:
                add(" ")
            continue
        if tag in HOLDS_NO:
            end = ends.find(tag, at)
            if end is None or end[0] == end[1]:  # never ended
                add(" ")
                continue
        if tag in BLOCKS:
            flush()
            ended = ENDS.get(tag, set()) | {"p"}
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in ended:
                    pop_to(depth)
                    if stack and tag in ENDS and stack[-1][0] in ended:
                        continue
                    break
                if stack[depth][0] in SCOPES - ended:
                    break
        names = [tag]
        if found[3]:
            for match in NAMED.finditer(found[3]):
                value = match[1] or match[2] or match[3] or ""
                names += ["." + name for name in value.lower().split()]
        stack.append((tag, tuple(names)))
        skipped += tag in SKIPPED
        links += tag == "a"
    add(page[at:])
    flush()
    return blocks


# -- features ---------------------------------------------------------------------------------


class Buckets(dict):
    """Hash buckets of tokens, remembered."""

    def __init__(self, size: int):
        self.size = size

    def __missing__(self, token: str) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[token] = zlib.crc32(token.encode()) % self.size
        return value


class Features:
    def __init__(self):
        self.names, self.words = Buckets(PATH_SIZE), Buckets(WORD_SIZE)
        self.paths: dict[tuple[str, ...], list[int]] = {}

    def path(self, path: tuple[str, ...]) -> list[int]:
        """Buckets of the elements and names around a block, and of the parts of the names."""
        if path not in self.paths:
            if len(self.paths) > 50_000:
                self.paths.clear()
            parts = {p for n in path if n[0] == "." for p in re.split(r"[-_.]", n) if p}
            self.paths[path] = [self.names[n] for n in {*path, *("part " + p for p in parts)}]
        return self.paths[path]

    def of(self, blocks: list[Block]) -> np.ndarray:
        out = np.zeros((len(blocks), PATH_SIZE + WORD_SIZE + SHAPE_SIZE), np.float32)
        for row, block in zip(out, blocks):
            row[self.path(block.path)] = 1
            words = block.text.lower().split(" ")
            found = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
            counts = np.bincount(found, minlength=WORD_SIZE)
            row[PATH_SIZE : PATH_SIZE + WORD_SIZE] = np.sqrt(counts / len(words))
            size = len(block.text)
            stops = block.text.count(".") + block.text.count("!") + block.text.count("?")
            row[-SHAPE_SIZE:] = (
                math.log1p(size) / 8, math.log1p(len(words)) / 6, block.linked / size,
                min(1.0, 8 * stops / len(words)), "©" in block.text,
            )
        return out


# -- the labeller -----------------------------------------------------------------------------


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def run_forward(
    x: np.ndarray, mask: np.ndarray, inner: np.ndarray, keep: bool = True
) -> tuple[np.ndarray, list]:
    """One direction over (time, pages, 4 HIDDEN) inputs; states of pages past their end stay.

    The second result is what the way back needs; labelling alone does without.
    """
    steps, pages, _ = x.shape
    h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    out, trace = np.zeros((steps, pages, HIDDEN), np.float32), []
    for t in range(steps):
        z = x[t] + h @ inner
        gates, new = sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
        i, f, o = np.split(gates, 3, axis=1)
        m = mask[t][:, None]
        c_new = f * c + i * new
        squashed = np.tanh(c_new)
        if keep:
            trace.append((h, c, i, f, o, new, squashed, m))
        h, c = m * (o * squashed) + (1 - m) * h, m * c_new + (1 - m) * c
        out[t] = h
    return out, trace


def run_backward(grad: np.ndarray, trace: list, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    steps, pages, _ = grad.shape
    dx, dinner = np.zeros((steps, pages, 4 * HIDDEN), np.float32), np.zeros_like(inner)
    dh, dc = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, new, squashed, m = trace[t]
        dh = dh + grad[t]
        inside, through = dh * m, dh * (1 - m)
        dc_new = dc * m + inside * o * (1 - squashed**2)
        dz = np.concatenate(
            [dc_new * new * i * (1 - i), dc_new * c * f * (1 - f),
             inside * squashed * o * (1 - o), dc_new * i * (1 - new**2)], axis=1,
        )
        dx[t] = dz
        dinner += h.T @ dz
        dh, dc = dz @ inner.T + through, dc * (1 - m) + dc_new * f
    return dx, dinner


class Labeller:
    """Weights: inputs and inner ones of both directions, then the output."""

    def __init__(self, seed: int = SEED):
        random = np.random.default_rng(seed)
        width = PATH_SIZE + WORD_SIZE + SHAPE_SIZE

        def some(rows: int, columns: int) -> np.ndarray:
            return (random.standard_normal((rows, columns)) / rows**0.5).astype(np.float32)

        self.weights = [
            some(width, 4 * HIDDEN), np.zeros(4 * HIDDEN, np.float32), some(HIDDEN, 4 * HIDDEN),
            some(width, 4 * HIDDEN), np.zeros(4 * HIDDEN, np.float32), some(HIDDEN, 4 * HIDDEN),
            some(2 * HIDDEN, 1), np.zeros(1, np.float32),
        ]

    def _run(self, pages: list[np.ndarray]):
        win, bin_, inner, wrev, brev, irev, wout, bout = self.weights
        steps = max(map(len, pages))
        x = np.zeros((steps, len(pages), pages[0].shape[1]), np.float32)
        mask = np.zeros((steps, len(pages)), np.float32)
        for p, rows in enumerate(pages):
            x[: len(rows), p], mask[: len(rows), p] = rows, 1
        ahead, trace = run_forward(x @ win + bin_, mask, inner)
        back, trace_back = run_forward((x @ wrev + brev)[::-1], mask[::-1], irev)
        states = np.concatenate([ahead, back[::-1]], axis=2)
        return x, mask, states, trace, trace_back, sigmoid((states @ wout + bout)[..., 0])

    def project(self, rows: np.ndarray) -> np.ndarray:
        """What the blocks of a page put into both directions, side by side."""
        win, bin_, _, wrev, brev, _, _, _ = self.weights
        return np.concatenate([rows @ win + bin_, rows @ wrev + brev], axis=1)

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For every page of features, the chance of each block to be main text."""
        return self.label_projected([self.project(rows) for rows in pages])

    def label_projected(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """As ``label``; like-sized pages together, so that little is padded, and PLACES at once."""
        _, _, inner, _, _, irev, wout, bout = self.weights
        out: list[np.ndarray] = [np.empty(0)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if len(p)), key=lambda i: -len(pages[i]))
        low = 0
        while low < len(order):
            steps = len(pages[order[low]])
            at = order[low : low + max(1, PLACES // steps)]
            low += len(at)
            x = np.zeros((steps, len(at), 8 * HIDDEN), np.float32)
            mask = np.zeros((steps, len(at)), np.float32)
            for column, i in enumerate(at):
                x[: len(pages[i]), column], mask[: len(pages[i]), column] = pages[i], 1
            ahead, _ = run_forward(x[..., : 4 * HIDDEN], mask, inner, keep=False)
            back, _ = run_forward(x[::-1, :, 4 * HIDDEN :], mask[::-1], irev, keep=False)
            score = ahead @ wout[:HIDDEN] + back[::-1] @ wout[HIDDEN:] + bout
            chances = sigmoid(score[..., 0])
            for column, i in enumerate(at):
                out[i] = chances[: len(pages[i]), column]
        return out

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], seed: int = SEED) -> None:
        random = np.random.default_rng(seed)
        first = [np.zeros_like(w) for w in self.weights]
        second = [np.zeros_like(w) for w in self.weights]
        turn = 0
        for _ in range(EPOCHS):
            # like-sized pages together, batches in random order
            order = np.array(sorted(range(len(pages)), key=lambda i: (len(pages[i]), i)))
            batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
            for at in random.permutation(len(batches)):
                own = batches[at]
                grads = self._gradients([pages[i] for i in own], [labels[i] for i in own])
                turn += 1
                for w, g, a, b in zip(self.weights, grads, first, second):
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    w -= RATE * (a / (1 - 0.9**turn)) / (np.sqrt(b / (1 - 0.99**turn)) + 1e-7)

    def _gradients(self, pages: list[np.ndarray], labels: list[np.ndarray]) -> list[np.ndarray]:
        _, _, inner, _, _, irev, wout, _ = self.weights
        x, mask, states, trace, trace_back, chances = self._run(pages)
        target = np.zeros_like(chances)
        for p, own in enumerate(labels):
            target[: len(own), p] = own
        error = ((chances - target) * mask / mask.sum()).astype(np.float32)[..., None]
        dstates = error @ wout.T
        dx, dinner = run_backward(dstates[..., :HIDDEN], trace, inner)
        dback, direv = run_backward(dstates[::-1, :, HIDDEN:], trace_back, irev)
        flat, dback = x.reshape(-1, x.shape[2]), dback[::-1]
        return [
            flat.T @ dx.reshape(len(flat), -1), dx.sum((0, 1)), dinner,
            flat.T @ dback.reshape(len(flat), -1), dback.sum((0, 1)), direv,
            states.reshape(len(flat), -1).T @ error.reshape(len(flat), 1), error.sum((0, 1)),
        ]


# -- learning ---------------------------------------------------------------------------------


def telling(block: Block) -> int | None:
    """1 for main text, 0 for other, None where the elements around a block do not tell."""
    other = set(OTHER_NAMES) - {"div"}
    names = {"." + n for group in OTHER_NAMES.values() for n in group.split()}
    if any(n in other or n in names for n in block.path):
        return 0
    main = {"article", "main"} | {"." + n for n in MAIN_NAMES.split()}
    return 1 if any(n in main for n in block.path) else None


def new_layout(
    main: list[str], other: list[str], random: np.random.Generator
) -> tuple[str, list[int]]:
    """A page of the given texts under names and elements of random choice, and its labels."""

    def some(names: str) -> str:
        return str(random.choice(names.split()))

    def wrap(tag: str, name: str | None, inside: str) -> str:
        kind = random.choice(["class", "id"])
        return f"<{tag}{f' {kind}="{name}"' if name else ''}>{inside}</{tag}>"

    def boilerplate() -> tuple[str, int]:
        tag = str(random.choice(list(OTHER_NAMES)))
        name = some(OTHER_NAMES[tag])
        named = tag != "div" and random.random() < 0.5
        outer = tag if named or tag == "form" else str(random.choice(["div", "section"]))
        count = int(random.integers(1, 5))
        texts = [str(random.choice(other or ["-"])) for _ in range(count)]
        if "comment" in name or name in ("replies", "disqus", "respond"):
            texts = [str(random.choice(main or ["-"])) for _ in range(count)]
            inside = "".join(f"<p>{html.escape(t)}</p>" for t in texts)
        elif tag in ("nav", "aside") or random.random() < 0.3:
            inside = "".join(f'<li><a href="#">{html.escape(t)}</a></li>' for t in texts)
            inside = f"<ul>{inside}</ul>"
        else:
            kind = random.choice(["div", "p", "h3"])
            inside = "".join(f"<{kind}>{html.escape(t)}</{kind}>" for t in texts)
        return wrap(outer, None if named and random.random() < 0.5 else name, inside), count

    def several(most: int) -> tuple[str, list[int]]:
        made = [boilerplate() for _ in range(int(random.integers(0, most + 1)))]
        return "".join(m for m, _ in made), [0] * sum(n for _, n in made)

    def neutral(inside: str) -> str:
        for _ in range(int(random.integers(0, 3))):
            inside = wrap("div", some(NEUTRAL_NAMES), inside)
        return inside

    def part(text: str) -> str:
        text, kind = html.escape(text), random.random()
        if kind < 0.1:
            return f"<ul><li>{text}</li></ul>"
        if kind < 0.2:
            return f"<h2>{text}</h2>" if len(text) < 200 else f"<blockquote>{text}</blockquote>"
        return f"<p>{text}</p>" if kind < 0.9 else f"<div>{text}</div>"

    before, zeros_before = several(4)
    after, zeros_after = several(4)
    body = [part(t) for t in main]
    if main and random.random() < 0.7:
        body[0] = f"<h1>{html.escape(main[0])}</h1>"
    labels = [1] * len(main)
    if len(main) > 2 and random.random() < 0.4:
        within, count = boilerplate()
        place = int(random.integers(1, len(main)))
        body.insert(place, within)
        labels[place:place] = [0] * count
    tag = str(random.choice(["article", "main", "div", "div", "div", "section"]))
    name = some(MAIN_NAMES) if tag in ("div", "section") or random.random() < 0.4 else None
    page = f"<body>{before}{neutral(wrap(tag, name, ''.join(body)))}{after}</body>"
    return page, zeros_before + labels + zeros_after


def sampled_pages(pages: DataFrame, sample: int, seed: int) -> list[str]:
    """At most ``sample`` pages of at most SAMPLE_BYTES: those with the smallest hashes of their ids.

    The ids are ranked without their pages; then those pages alone are read, so the driver gets
    sample * SAMPLE_BYTES bytes at most, whatever the table holds. Of pages with one id, the first
    in order of their text is taken.
    """
    fit = pages.where(F.octet_length("html").between(1, SAMPLE_BYTES))
    fit = fit.select(F.xxhash64("page_id", F.lit(seed)).alias("h"), "page_id", "html")
    ranked = fit.select("h", "page_id").distinct().orderBy("h", "page_id").limit(sample)
    same = F.col("h").eqNullSafe(F.col("a")) & F.col("page_id").eqNullSafe(F.col("b"))
    wanted = F.broadcast(ranked.toDF("a", "b"))  # ``sample`` ids
    chosen = fit.join(wanted, same, "left_semi").groupBy("h", "page_id").agg(F.min("html").alias("html"))
    return [row.html for row in chosen.orderBy("h", "page_id").collect()]


def learn_labeller(pages: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> Labeller:
    """Fitted on at most ``sample`` pages and LAYOUTS new layouts of the texts of each."""
    random = np.random.default_rng(seed)
    read = [read_blocks(page) for page in sampled_pages(pages, sample, seed)]
    told = [[telling(b) for b in blocks] for blocks in read]
    other = [b.text for blocks, t in zip(read, told) for b, x in zip(blocks, t) if x == 0]
    features, known, labels = Features(), [], []
    for blocks, own in zip(read, told):
        if blocks and all(x is not None for x in own):
            known.append(features.of(blocks))
            labels.append(np.array(own, np.float32))
        main = [b.text for b, x in zip(blocks, own) if x == 1]
        for _ in range(LAYOUTS if main else 0):
            page, expected = new_layout(main, other, random)
            made = read_blocks(page)
            if len(made) == len(expected):
                known.append(features.of(made))
                labels.append(np.array(expected, np.float32))
    labeller = Labeller(seed)
    if known:
        labeller.fit(known, labels, seed)
    return labeller


def main_text(
    pages: DataFrame,
    labeller: Labeller,
    id_column: str = "page_id",
    html_column: str = "html",
) -> DataFrame:
    """id, url, text and n_chars of every page.

    The chosen blocks in page order, two line breaks in between. Null and empty pages, and pages
    without main text, give an empty text. Equal rows give a row each; ids and urls may be null.
    A worker holds about PAGE_BYTES of pages, or one longer page, and half a KB for each of its blocks.
    """
    shared = pages.sparkSession.sparkContext.broadcast(labeller)  # some hundred KB of weights
    held: list[Features] = []

    def projected(blocks: list[Block]) -> np.ndarray:
        parts = [
            shared.value.project(held[0].of(blocks[low : low + BLOCKS_AT_ONCE]))
            for low in range(0, len(blocks), BLOCKS_AT_ONCE)
        ]
        return np.concatenate(parts) if parts else np.empty((0, 8 * HIDDEN), np.float32)

    def extract(batch: pa.RecordBatch) -> dict:
        if not held:
            held.append(Features())
        texts: list[str] = []
        for part in slices(batch, 2, PAGE_BYTES):
            read = [read_blocks(page or "") for page in part.column(2).to_pylist()]
            chances = shared.value.label_projected([projected(blocks) for blocks in read])
            for blocks, own in zip(read, chances):
                texts.append("\n\n".join(b.text for b, x in zip(blocks, own) if x >= 0.5))
        return {
            id_column: batch.column(0),
            "url": batch.column(1),
            "text": pa.array(texts, pa.string()),
            "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        }

    kind = pages.schema[id_column].dataType.simpleString()
    return map_arrow(
        pages.select(id_column, "url", html_column),
        extract,
        f"{id_column} {kind}, url string, text string, n_chars long",
    )


def extract_pages(pages: DataFrame) -> DataFrame:
    """Learn the labeller from a sample and label every page."""
    return main_text(pages, learn_labeller(pages))
