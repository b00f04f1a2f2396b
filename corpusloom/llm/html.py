"""Main text of web pages: a linear-chain conditional random field over leaf blocks."""

from __future__ import annotations

import html as entities
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.html_pages import MARK, labelled_pages

# Pages the field is trained on, and the passes of its training.
TRAINING_PAGES = 1000
TRAINING_STEPS = 250

# Element kinds of HTML.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section select summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Their contents are no markup and no text of the page; without an end tag they reach to its end.
RAW_TAGS = frozenset("script style title textarea iframe noembed noframes".split())
# A start tag of the key ends open elements of these kinds, up to the nearest of the stops.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
MAIN_TAGS = frozenset({"article", "main"})
# Elements that set a part of a page apart, not a part of its text.
CONTAINERS = frozenset("address article aside body center div fieldset footer form header main nav section td".split())
# A block of so many words, few of them linked, is prose; a feature seen on fewer training pages has no weight.
PROSE_WORDS = 8
LEAST_PAGES = 3

_TOKEN = regex.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    regex.DOTALL,
)
_TEMPLATE_END = regex.compile(r"</template\b[^>]*>?", regex.IGNORECASE)
_NAMED = regex.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", regex.IGNORECASE)
_HIDDEN = regex.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", regex.IGNORECASE)
_NAME_WORD = regex.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Words of boilerplate that the text features look for.
CUES = frozenset(
    "cookie cookies privacy subscribe newsletter login sign comment comments reply share tweet copyright rights reserved "
    "advertisement sponsored menu search related terms policy contact accept © "
    "datenschutz impressum kommentare antworten anmelden abonnieren teilen rechte vorbehalten verwandte anzeige "
    "confidentialité mentions commentaires répondre abonner partager droits réservés publicité "
    "privacidad comentarios responder suscríbete compartir derechos reservados publicidad aviso".split()
)


@dataclass(slots=True)
class Element:
    tag: str
    names: tuple[str, ...]


@dataclass(slots=True)
class Block:
    """A leaf block: its text, the elements above it, and its characters inside links."""

    text: str
    path: tuple[Element, ...]
    linked: int


@dataclass(slots=True)
class _Reader:
    stack: list[Element] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    links: int = 0
    blocks: list[Block] = field(default_factory=list)

    def end_block(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(Block(text, tuple(self.stack), self.linked))
            self.parts, self.linked = [], 0

    def text(self, raw: str) -> None:
        plain = entities.unescape(raw) if "&" in raw else raw
        self.parts.append(plain)
        if self.links:
            self.linked += len(plain.strip())

    def pop_to(self, size: int) -> None:
        for element in self.stack[size:]:
            self.links -= element.tag == "a"
        del self.stack[size:]

    def start(self, tag: str, attrs: str) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in BLOCK_TAGS:
            self.end_block()
            self._close_open(tag)
        if tag in VOID_TAGS:
            return
        names = tuple(
            word.lower() for m in _NAMED.finditer(attrs) for word in _NAME_WORD.findall(m[2] or m[3] or m[4] or "")
        ) if attrs else ()
        if attrs and _HIDDEN.search(attrs):
            names += ("hidden",)
        self.stack.append(Element(tag, names))
        self.links += tag == "a"

    def _close_open(self, tag: str) -> None:
        """Elements whose end tag the new block leaves out."""
        kinds, stops = CLOSES.get(tag, ((), ()))
        for i in range(len(self.stack) - 1, -1, -1):
            open_tag = self.stack[i].tag
            if open_tag == "p" or open_tag in kinds:
                self.pop_to(i)
            elif open_tag in stops or (open_tag in BLOCK_TAGS and not kinds):
                break

    def end(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.end_block()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag == tag:
                self.pop_to(i)
                break
            # An inline end tag does not reach over a block.
            if tag not in BLOCK_TAGS and self.stack[i].tag in BLOCK_TAGS:
                break


def leaf_blocks(page: str) -> list[Block]:
    """Text between block-level tags, character references decoded and white space collapsed."""
    reader, at, open_template = _Reader(), 0, False
    # Each search begins where the last token or skipped element ended: no token begins inside a script.
    while match := _TOKEN.search(page, at):
        if match.start() > at:
            reader.text(page[at : match.start()])
        at = match.end()
        tag = match["tag"] or match["tag2"]
        if tag is None:
            continue
        tag = tag.lower()
        if match["end"] or match["end2"]:
            reader.end(tag)
        elif tag == "template" and (closing := None if open_template else _TEMPLATE_END.search(page, at)):
            # Never shown; an unclosed one is read on.
            at = closing.end()
        elif tag in RAW_TAGS:
            if tag in ("title", "textarea"):
                reader.end_block()
            if not (match["attrs"] or "").rstrip().endswith("/") or tag in ("script", "style", "title", "textarea"):
                closing = regex.compile(rf"</{tag}\b[^>]*>?", regex.IGNORECASE).search(page, at)
                at = closing.end() if closing else len(page)
        else:
            open_template = open_template or tag == "template"
            reader.start(tag, match["attrs"] or match["attrs2"] or "")
    if at < len(page):
        reader.text(page[at:])
    reader.end_block()
    return reader.blocks


def page_features(blocks: Sequence[Block]) -> list[list[str]]:
    """Names of the features of each block: ancestors, their class and id words, the parts of the page it is in, and the text."""
    has_main = any(e.tag in MAIN_TAGS for b in blocks for e in b.path)
    parts, out, headed = _Parts(blocks), [], False
    paths: dict[int, list[str]] = {}
    for i, block in enumerate(blocks):
        above = paths.get(id(block.path[-1])) if block.path else []
        if above is None:
            above = _path_features(block.path, has_main) + parts.features(block.path)
            paths[id(block.path[-1])] = above
        tag = next((e.tag for e in reversed(block.path) if e.tag in BLOCK_TAGS), "")
        out.append([*above, *_text_features(block), "headed" if headed else "unheaded"])
        headed = headed or tag == "h1"
        if i == 0:
            out[-1].append("first")
    if out:
        out[-1].append("last")
    return out


class _Parts:
    """Prose, characters and linked characters of the containers of a page."""

    def __init__(self, blocks: Sequence[Block]):
        self.sums: dict[int, list[int]] = {}
        self.prose = 0
        for block in blocks:
            size = len(block.text.split())
            prose = size if size >= PROSE_WORDS and block.linked < 0.3 * len(block.text) else 0
            self.prose += prose
            for e in block.path:
                if e.tag in CONTAINERS:
                    held = self.sums.setdefault(id(e), [0, 0, 0])
                    held[0] += prose
                    held[1] += len(block.text)
                    held[2] += block.linked

    def features(self, path: tuple[Element, ...]) -> list[str]:
        """What share of the page's prose the two nearest containers hold, and how much of the nearest is links."""
        held = [self.sums[id(e)] for e in path if e.tag in CONTAINERS][-2:]
        names = [
            f"{name}={sum(prose > limit * self.prose for limit in (0.0, 0.1, 0.3, 0.6))}"
            for name, (prose, _, _) in zip(("near", "far"), reversed(held))
        ]
        if held:
            names.append(f"near linked={sum(held[-1][2] > limit * held[-1][1] for limit in (0.1, 0.4, 0.8))}")
        return names


def _path_features(path: tuple[Element, ...], has_main: bool) -> list[str]:
    tags = [e.tag for e in path if e.tag in BLOCK_TAGS or e.tag in ("a", "button", "label", "noscript")]
    names = {word for e in path for word in e.names}
    features = [f"above={t}" for t in set(tags)] + [f"name={n}" for n in names]
    # The header of an article is not that of a page.
    within = next((i for i, t in enumerate(tags) if t in MAIN_TAGS), len(tags))
    if "header" in tags:
        features.append("header within" if "header" in tags[within:] else f"header own={tags[-1]}")
    if tags:
        features.append(f"own={tags[-1]}")
    if has_main:
        features.append("inside" if any(t in MAIN_TAGS for t in tags) else "outside")
    else:
        features.append("no main")
    if not names:
        features.append("unnamed")
    return features


def _text_features(block: Block) -> list[str]:
    words = block.text.split()
    size = len(words)
    share = block.linked / max(1, len(block.text))
    features = [
        f"words={sum(size > limit for limit in (1, 3, 6, 12, 25, 50))}",
        f"linked={sum(share > limit for limit in (0.0, 0.3, 0.8))}",
        "stop" if block.text[-1] in ".!?…:\"»”" else "no stop",
    ]
    if size <= 40:
        features += [f"cue={w}" for w in {w.strip(".,:!?()").lower() for w in words} & CUES]
    return features


@dataclass(frozen=True)
class Field:
    """Weights of the field: ``score`` of a feature for main text, ``step[a, b]`` from label a to b."""

    score: dict[str, float]
    step: tuple[tuple[float, float], tuple[float, float]]

    def labels(self, features: list[list[str]]) -> list[bool]:
        """Best labelling of a page by the Viterbi recursion."""
        if not features:
            return []
        get = self.score.get
        (s00, s01), (s10, s11) = self.step
        zero, one, back = 0.0, sum(get(f, 0.0) for f in features[0]), []
        for names in features[1:]:
            gain = sum(get(f, 0.0) for f in names)
            from_one_0, from_one_1 = one + s10 > zero + s00, one + s11 >= zero + s01
            back.append((from_one_0, from_one_1))
            zero, one = (
                one + s10 if from_one_0 else zero + s00,
                gain + (one + s11 if from_one_1 else zero + s01),
            )
        label, out = one >= zero, []
        for pair in reversed(back):
            out.append(label)
            label = pair[label]
        return [label, *reversed(out)]


def fit(pages: Sequence[tuple[list[list[str]], list[bool]]], steps: int = TRAINING_STEPS, penalty: float = 0.0005) -> Field:
    """Maximum likelihood with an L2 penalty, by forward-backward sums over all pages at once."""
    held = Counter(f for features, _ in pages for f in {f for block in features for f in block})
    names = sorted(f for f, n in held.items() if n >= min(LEAST_PAGES, len(pages)))
    at = {name: i for i, name in enumerate(names)}
    sizes = [len(labels) for _, labels in pages]
    longest = max(sizes)
    # One row per real block; labels and sums are padded to the longest page.
    x = np.zeros((sum(sizes), len(names)))
    y = np.zeros((len(pages), longest), np.int64)
    real = np.zeros((len(pages), longest), bool)
    for row, block in enumerate(block for features, _ in pages for block in features):
        x[row, [at[f] for f in block if f in at]] = 1.0
    for p, (_, labels) in enumerate(pages):
        y[p, : len(labels)], real[p, : len(labels)] = labels, True
    weights, step = np.zeros(len(names)), np.zeros((2, 2))
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(step), np.zeros_like(step)]
    pairs = real[:, 1:]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:, :-1][pairs], y[:, 1:][pairs]), 1)
    for n in range(1, steps + 1):
        gain = np.zeros(real.shape)
        gain[real] = x @ weights
        one, between = _marginals(gain, step, real)
        grad = (one - y)[real] @ x / len(pages) + penalty * weights
        grad_step = (between - seen) / len(pages) + penalty * step
        for value, g, m, v in ((weights, grad, *moments[:2]), (step, grad_step, *moments[2:])):
            # Adam with its usual decay rates.
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            value -= 0.1 * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.999**n)) + 1e-8)
    return Field(dict(zip(names, weights.tolist())), tuple(map(tuple, step.tolist())))


def _marginals(gain: np.ndarray, step: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of label 1 for every block, and expected transitions over all pages."""
    pages, longest = gain.shape
    unary = np.stack([np.zeros_like(gain), gain], axis=2)
    forward, backward = np.zeros_like(unary), np.zeros_like(unary)
    forward[:, 0] = unary[:, 0]
    for i in range(1, longest):
        new = np.logaddexp(forward[:, i - 1, :1] + step[0], forward[:, i - 1, 1:] + step[1]) + unary[:, i]
        forward[:, i] = np.where(real[:, i, None], new, forward[:, i - 1])
    for i in range(longest - 2, -1, -1):
        ahead = unary[:, i + 1] + backward[:, i + 1]
        new = np.logaddexp(ahead[:, :1] + step[:, 0], ahead[:, 1:] + step[:, 1])
        backward[:, i] = np.where(real[:, i + 1, None], new, backward[:, i + 1])
    total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
    one = np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None])
    joint = (
        forward[:, :-1, :, None] + step + (unary + backward)[:, 1:, None, :] - total[:, None, None, None]
    )
    return one, (np.exp(joint) * real[:, 1:, None, None]).sum(axis=(0, 1))


def training_set(pages: Sequence[str]) -> list[tuple[list[list[str]], list[bool]]]:
    """Features and labels of pages whose main leaf blocks begin with ``MARK``."""
    out = []
    for page in pages:
        blocks = leaf_blocks(page)
        labels = [MARK in b.text for b in blocks]
        for b in blocks:
            b.text = b.text.replace(MARK, "")
        if blocks:
            out.append((page_features(blocks), labels))
    return out


@lru_cache(maxsize=2)
def trained_field(pages: int = TRAINING_PAGES) -> Field:
    """The field fitted to ``pages`` generated labelled pages."""
    return fit(training_set(labelled_pages(pages)))


def main_text(page: str, model: Field) -> str:
    """Main blocks of a page in order, joined by an empty line."""
    blocks = leaf_blocks(page)
    return "\n\n".join(b.text for b, keep in zip(blocks, model.labels(page_features(blocks))) if keep)


def extract_main_text(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    model: Field | None = None,
) -> DataFrame:
    """``(<id_col>, <url_col>, text, n_chars)``, one row per page.

    ``text`` joins the leaf blocks that the field labels as main text, whole and
    in page order; ``n_chars`` counts its code points. Without a model one is
    trained on the driver on a fixed number of labelled pages. Null and empty
    pages, and pages without main text, give an empty text; ids and urls pass
    through, nulls and repeated rows included; other columns are not read.
    """
    model = model or trained_field()
    shared = pages.sparkSession.sparkContext.broadcast(model)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    schema = T.StructType(
        [
            T.StructField("id", pages.schema[id_col].dataType),
            T.StructField("url", pages.schema[url_col].dataType),
            T.StructField("text", T.StringType()),
            T.StructField("n_chars", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One page at a time: memory holds the batch and one page's blocks.
            texts = [main_text(h.as_py() or "", shared.value) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["id", "url", "text", "n_chars"],
            )

    found = rows.mapInArrow(run, schema)
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
