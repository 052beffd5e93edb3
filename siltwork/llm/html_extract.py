"""Main-text extraction by a tree-structured graphical model over the page's elements.

Each element is boilerplate, content or a wrapper around both. Features of an element give
its own potentials, parent and child share a potential, and one pass of messages up and one
down the tree (sum-product) gives exact marginals. Counts over labelled pages train both.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.llm.html_training import labelled_pages

BOILERPLATE, CONTENT, WRAPPER = range(3)
STATES = (BOILERPLATE, CONTENT, WRAPPER)
TRAINING_PAGES = 1500
MOST_FEATURES = 2000
SMOOTHING = 0.02

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>|</?[A-Za-z][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
_NAME = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Read to the end tag, never shown: scripts and styles to the page's end if there is none, the others then as elements.
RAW = frozenset("script style noscript template iframe textarea title select datalist".split())
ENDLESS = frozenset({"script", "style"})
#: Elements that begin and end a block of text; all others, unknown ones too, stand within a line.
BLOCK = frozenset(
    "address article aside blockquote body br caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p plaintext pre search section summary table tbody td tfoot th thead title tr ul xmp".split()
)
#: Drawings and formulas close their elements by a slash.
FOREIGN = frozenset({"svg", "math"})
#: An opening tag ends the nearest open element of its group, unless a stop stands between.
ENDS = {
    **{t: (frozenset({"p"}), frozenset({"button"})) for t in "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()},
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}


@dataclass
class Tree:
    """Elements in page order, so a parent comes before its children."""

    tags: list[str]
    names: list[tuple[str, ...]]
    marks: list[str | None]
    parents: list[int]
    texts: list[tuple[int, str, bool]]  # (element, text, whether a block begins before it)


class Open:
    """The open elements, and at which depth each tag stands, so that no search walks the stack."""

    def __init__(self) -> None:
        self.stack: list[tuple[int, str]] = [(0, "#root")]
        self.depths: dict[str, list[int]] = {}

    def push(self, element: int, tag: str) -> None:
        self.depths.setdefault(tag, []).append(len(self.stack))
        self.stack.append((element, tag))

    def deepest(self, tags: Iterable[str]) -> int:
        """Depth of the innermost open element of some tags, or 0."""
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=0)

    def close(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.depths[self.stack.pop()[1]].pop()


def parse(page: str) -> Tree:
    tree = Tree(["#root"], [()], [None], [-1], [])
    open_, at, fresh = Open(), 0, True
    unclosed: set[str] = set()
    while True:
        found = _TOKEN.search(page, at)
        end = found.start() if found else len(page)
        if end > at:
            tree.texts.append((open_.stack[-1][0], html.unescape(page[at:end]), fresh))
            fresh = False
        if not found:
            return tree
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if tag in BLOCK:
            fresh = True
        if found[1]:
            if depth := open_.deepest((tag,)):
                open_.close(depth)
            continue
        if tag in ENDS:
            group, stops = ENDS[tag]
            depth = open_.deepest(group)
            if depth > open_.deepest(stops):
                open_.close(depth)
        names, mark = (), None
        if "=" in found[3]:
            for key, *values in _ATTRIBUTE.findall(found[3]):
                key, value = key.lower(), "".join(values)
                if key in ("class", "id", "role"):
                    names += tuple(_NAME.findall(value.lower()))
                elif key == "data-state":
                    mark = value
        tree.tags.append(tag)
        tree.names.append(names)
        tree.marks.append(mark)
        tree.parents.append(open_.stack[-1][0])
        if tag in RAW and tag not in unclosed:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            if close or tag in ENDLESS:
                at = close.end() if close else len(page)
                continue
            unclosed.add(tag)  # no end tag from here on, so none is looked for again
        drawn = tag in FOREIGN or open_.deepest(FOREIGN)
        if tag not in VOID and not (drawn and found[3].rstrip().endswith("/")):
            open_.push(len(tree.tags) - 1, tag)


def features(tree: Tree) -> list[list[str]]:
    """Of each element: tag, words of class, id and role, share of linked text, text inside."""
    n = len(tree.tags)
    own, inside, linked = [0] * n, [0] * n, [0] * n
    for element, text, _ in tree.texts:
        own[element] += len(text.strip())
    for i in range(n - 1, -1, -1):
        inside[i] += own[i]
        if tree.tags[i] == "a":
            linked[i] = inside[i]
        if i:
            inside[tree.parents[i]] += inside[i]
            linked[tree.parents[i]] += linked[i]
    out = []
    for i in range(n):
        size = inside[i]
        share = 0 if not linked[i] else 1 + (linked[i] * 3 >= size) + (linked[i] * 10 >= 8 * size)
        scale = 0 if not size else 1 + (size >= 30) + (size >= 120) + (size >= 500)
        out.append([f"tag {tree.tags[i]}", f"links {share}", f"size {scale}", *[f"name {w}" for w in dict.fromkeys(tree.names[i])]])
    return out


def states(tree: Tree) -> list[int]:
    """The states of a labelled page: marks hold for all below; what holds a main text wraps it."""
    n = len(tree.tags)
    state, wraps = [BOILERPLATE] * n, [False] * n
    for i in range(n):
        mark = tree.marks[i]
        inherited = state[tree.parents[i]] if i else BOILERPLATE
        state[i] = int(mark) if mark is not None else inherited
    for i in range(n - 1, 0, -1):
        if (state[i] == CONTENT or wraps[i]) and state[tree.parents[i]] == BOILERPLATE:
            wraps[tree.parents[i]] = True
    return [WRAPPER if w else s for s, w in zip(state, wraps)]


@dataclass
class Model:
    """Log potentials; the number of features is bounded."""

    unary: dict[str, tuple[float, float, float]]
    pairs: tuple[list[list[float]], list[list[float]]]  # of a block and of an inline child

    def marginals(self, tree: Tree) -> list[list[float]]:
        """Of each element the probability of each state, by sum-product over the tree."""
        n, unary = len(tree.tags), self.unary
        pairs = [self.pairs[t not in BLOCK] for t in tree.tags]
        local = []
        for names in features(tree):
            a = b = c = 0.0
            for f in names:
                if (w := unary.get(f)) is not None:
                    a, b, c = a + w[0], b + w[1], c + w[2]
            top = max(a, b, c)
            local.append([math.exp(max(a - top, -60.0)), math.exp(max(b - top, -60.0)), math.exp(max(c - top, -60.0))])
        up = [None] * n
        for i in range(n - 1, 0, -1):  # a child's message: what it and all below say of the parent
            x, y, z = local[i]
            total = x + y + z
            x, y, z = x / total, y / total, z / total
            local[i] = [x, y, z]
            message = [p[0] * x + p[1] * y + p[2] * z for p in pairs[i]]
            total = sum(message)
            message = up[i] = [max(m / total, 1e-30) for m in message]
            above = local[tree.parents[i]]
            above[0] *= message[0]
            above[1] *= message[1]
            above[2] *= message[2]
            top = max(above)
            if top < 1e-100:
                above[:] = [v / top for v in above]
        total = sum(local[0])
        out = [[v / total for v in local[0]]] + [None] * (n - 1)
        for i in range(1, n):  # the parent's belief without what the child said of it
            belief, message = out[tree.parents[i]], up[i]
            rest = [belief[s] / message[s] for s in STATES]
            down = [local[i][s] * sum(rest[r] * pairs[i][r][s] for r in STATES) for s in STATES]
            total = sum(down) or 1.0
            out[i] = [v / total for v in down]
        return out

    def extract(self, page: str) -> str:
        tree = parse(page)
        if not tree.texts:
            return ""
        belief = self.marginals(tree)
        keep = [b[CONTENT] > 0.5 for b in belief]
        return " ".join("".join([f" {t}" if fresh else t for element, t, fresh in _with_breaks(tree, keep)]).split())


def _with_breaks(tree: Tree, keep: list[bool]) -> Iterator[tuple[int, str, bool]]:
    """Kept texts; a text after one that was dropped begins a block."""
    dropped = False
    for element, text, fresh in tree.texts:
        if keep[element]:
            yield element, text, fresh or dropped
            dropped = False
        else:
            dropped = True


def fit(labelled: DataFrame, page: str = "html") -> Model:
    """Counts features and parent-child states of labelled pages; null pages say nothing.

    The most frequent features, at most ``MOST_FEATURES``, reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for value in batch.column("page"):
                tree = parse(value.as_py() or "")
                state = states(tree)
                for i, names in enumerate(features(tree)):
                    seen.update((f, state[i]) for f in names)
                    seen["state", state[i]] += 1
                    if i:
                        seen[f"pair {tree.tags[i] not in BLOCK} {state[tree.parents[i]]}", state[i]] += 1
        yield pa.RecordBatch.from_pydict({"feature": [f for f, _ in seen], "state": [s for _, s in seen], "n": list(seen.values())}, schema=pa.schema([("feature", pa.string()), ("state", pa.int32()), ("n", pa.int64())]))

    counts = labelled.select(F.col(f"`{page}`").alias("page")).mapInArrow(count, "feature string, state int, n long")
    wide = counts.groupBy("feature").agg(*[F.sum(F.when(F.col("state") == s, F.col("n")).otherwise(0)).alias(f"n{s}") for s in STATES])
    top = {r["feature"]: (r["n0"], r["n1"], r["n2"]) for r in wide.orderBy(F.desc(F.col("n0") + F.col("n1") + F.col("n2")), "feature").limit(MOST_FEATURES).collect()}
    totals = top.pop("state", (0, 0, 0))
    pairs = ([], [])
    for inline in (False, True):
        for r in STATES:
            row = [n + SMOOTHING for n in top.pop(f"pair {inline} {r}", (0, 0, 0))]
            pairs[inline].append([v / sum(row) for v in row])
    unary = {f: tuple(math.log((n[s] + SMOOTHING) / (totals[s] + 2 * SMOOTHING)) for s in STATES) for f, n in top.items()}
    return Model(unary, pairs)


def fit_default(spark: SparkSession, pages: int = TRAINING_PAGES) -> Model:
    """Trains on the rule-made labelled pages."""
    return fit(spark.createDataFrame([(p,) for p in labelled_pages(pages)], "html string").repartition(4))


def extract(pages: DataFrame, model: Model, page: str = "html", out: str = "text") -> DataFrame:
    """Adds the main text of each whole page; null and empty pages and pages without one give "".

    Rows and other columns stay; a column named like ``out`` is replaced.
    """
    kept = [c for c in pages.columns if c not in (out, page)]
    schema = pages.select(*[F.col(f"`{c}`") for c in kept], F.lit(None).cast("string").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.extract(p.as_py() or "") for p in batch.column("__page")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(texts, pa.string())], names=[*kept, out])

    return pages.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{page}`").cast("string").alias("__page")).mapInArrow(run, schema)


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages, fit_default(spark)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
