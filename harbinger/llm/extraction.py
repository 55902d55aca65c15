"""Main text of web pages as the maximum-scoring subsequence of tokens.

A page is a sequence of words and tags.  Words score positive and tags negative, each by
weights learned from pages that mark their main text themselves; words in elements that
the labelled pages show outside the main text score negative too.  One linear scan finds
the contiguous stretch with the largest sum.  Its words, less those of unwanted elements
nested in it, are the text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harbinger.llm.common import small_batches, with_fields

# Kinds of elements in HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|iframe|object|svg|math|textarea|title|select|canvas|audio|video"
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary "
    "table tbody tfoot thead tr ul".split()
)
SPACES = {"br", "td", "th", "option"}
# Bare elements that occur anywhere, so where they stand says nothing about their words.
GENERIC = set(
    "html body div span section p a b i em strong u s small mark q cite code sub sup abbr time font center ul ol li dl "
    "dt dd table tbody thead tfoot tr td th h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption".split()
)
CLOSES_P = BLOCKS - {"html", "head", "body"}

# Elements and class words that name what is never main text.
UNWANTED_TAGS = set("nav footer aside form button input label dialog menu head".split())
UNWANTED_WORDS = set(
    "ad ads adv advert advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies disqus disclaimer footer gdpr login masthead menu modal nav navbar navigation newsletter "
    "notice pager pagination popup promo promoted promotion recommended related replies respond share sharing sidebar "
    "signup site-footer site-header social sponsor sponsored subscribe subscription tags toolbar widget widgets".split()
)
UNWANTED_ROLES = set("navigation banner contentinfo complementary search dialog alert form".split())

TOKEN = re.compile(
    rf"<!--(?:.*?-->|.*\Z)|<({RAW})\b[^>]*>(?:.*?</\1\s*>|.*\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|<(?=/?[a-zA-Z])[^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


@dataclass
class Weights:
    """Log-odds of inside over outside for elements (by the words in them) and for tags."""

    elements: dict[str, float]
    tags: dict[str, float]


def features(tag: str, attributes: str) -> tuple[str, ...]:
    """What an element is known by: its tag alone if bare, else its tag with each class, id and role."""
    named = [
        f"{tag}{'.#@'[('class', 'id', 'role').index(kind.lower())]}{word}"
        for kind, a, b, c in ATTRIBUTE.findall(attributes)
        for word in (a or b or c).lower().split()
    ]
    return tuple(named) or (tag,)


def unwanted(tag: str, names: tuple[str, ...], in_main: bool) -> bool:
    """Named as no main text; a header counts as the page's unless it stands in the article."""
    if tag in UNWANTED_TAGS or tag == "header" and not in_main:
        return True
    for name in names:
        kind, word = name[len(tag) : len(tag) + 1], name[len(tag) + 1 :]
        if kind == "@" and word in UNWANTED_ROLES and not in_main:
            return True
        if kind in (".", "#") and not UNWANTED_WORDS.isdisjoint({word, *re.split(r"[-_]+", word)}):
            return True
    return False


@dataclass
class Token:
    words: list[str]  # empty for a tag
    names: tuple[str, ...]  # of the tag, or of all elements around the words
    noise: bool
    main: bool
    breaks: int  # 2 starts a block, 1 is a blank
    blank: bool  # a blank follows the last word


def tokens(page: str) -> Iterator[Token]:
    """Words with what surrounds them, and tags.  Open elements end with their parents; a block ends an
    open paragraph."""
    stack: list[tuple[str, tuple[str, ...], bool, bool]] = []
    end = 0

    def words(text: str) -> Token | None:
        split = html.unescape(text)
        if not split:
            return None
        names = tuple(dict.fromkeys(n for _, own, _, _ in stack for n in own))
        top = stack[-1] if stack else ("", (), False, False)
        return Token(split.split(), names, top[2], top[3], 0 if not split[0].isspace() else 1, split[-1].isspace())

    for m in TOKEN.finditer(page):
        if m.start() > end and (token := words(page[end : m.start()])):
            yield token
        end = m.end()
        if m[3] is None:
            continue
        tag = m[3].lower()
        breaks = 2 if tag in BLOCKS else 1 if tag in SPACES else 0
        top = stack[-1] if stack else ("", (), False, False)
        if m[2]:
            place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            names = stack[place][1] if place is not None else (tag,)
            if place is not None:
                del stack[place:]
            yield Token([], names, top[2], top[3], breaks, False)
            continue
        if tag in CLOSES_P:
            place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p"), None)
            if place is not None and not any(stack[i][0] in BLOCKS for i in range(place + 1, len(stack))):
                del stack[place:]
                top = stack[-1] if stack else ("", (), False, False)
        names = features(tag, m[4] or "")
        main = top[3] or tag in ("article", "main") or f"{tag}@main" in names or f"{tag}@article" in names
        noise = top[2] or unwanted(tag, names, main)
        if tag not in VOID:
            stack.append((tag, names, noise, main))
        yield Token([], names, noise, main, breaks, False)
    if end < len(page) and (token := words(page[end:])):
        yield token


def tallies(page: str) -> Counter[tuple[str, str, bool]]:
    """``(kind, feature, inside)`` counts of a page that marks its main text; of another, nothing."""
    out: Counter[tuple[str, str, bool]] = Counter()
    marked = False
    for t in tokens(page):
        inside = t.main and not t.noise
        marked |= t.main
        for n in t.names:
            out["words" if t.words else "tag", n, inside] += len(t.words) or 1
    return out if marked else Counter()


def learn(pages: DataFrame, page: str = "html", most: int = 5000) -> Weights:
    """Weights from all pages that mark their main text (an article or main element, or such a role).

    Counts cover every page; the ``most`` most frequent features are kept.  Without
    labelled pages the weights are empty and only the fixed lists speak.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held: Counter[tuple[str, str, bool]] = Counter()
            for value in batch.iloc[:, 0]:
                if value:
                    held.update(tallies(value))
            yield pd.DataFrame(
                [(k, f, n * i, n * (not i)) for (k, f, i), n in held.items()], columns=["kind", "feature", "inside", "outside"]
            )

    found = pages.select(page).mapInPandas(counted, "kind string, feature string, inside long, outside long")
    sums = found.groupBy("kind", "feature").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o"))
    rows = sums.orderBy((F.col("i") + F.col("o")).desc(), "kind", "feature").limit(most).collect()
    whole = {k: (1 + sum(r.i for r in rows if r.kind == k), 1 + sum(r.o for r in rows if r.kind == k)) for k in ("words", "tag")}
    odds = {
        k: {r.feature: log((r.i + 1) / (r.o + 1)) - log(whole[k][0] / whole[k][1]) for r in rows if r.kind == k} for k in whole
    }
    return Weights(odds["words"], odds["tag"])


def main_text(page: str | None, weights: Weights, tag: float = 0.05, outside: float = -3.0, unwanted_word: float = 0.25,
              steep: float = 0.1, dearest: float = 1.0) -> str:
    """The words of the best stretch, a line per block.

    A wanted word scores 1, any other word ``-unwanted_word``; a tag scores ``-tag``, and
    outside a marked main text further less by ``steep`` times its log-odds of standing
    outside, up to ``dearest``.  Where a page marks its main text, words outside are not wanted.
    """
    sequence = list(tokens(page or ""))
    marked = any(t.words and t.main and not t.noise for t in sequence)
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    good = []
    for i, t in enumerate(sequence):
        odds = min((weights.elements.get(n, 0.0) for n in t.names if n not in GENERIC), default=0.0)
        wanted = bool(t.words) and not t.noise and (t.main if marked else odds > outside)
        good.append(wanted)
        if t.words:
            gain = len(t.words) * (1.0 if wanted else -unwanted_word)
        elif t.main:
            gain = -tag
        else:
            away = -min((weights.tags.get(n, 0.0) for n in t.names), default=0.0)
            gain = -tag - min(dearest, steep * max(0.0, away))
        if total <= 0:
            total, start = 0.0, i
        total += gain
        if total > best:
            best, best_at = total, (start, i + 1)
    blocks: list[list[str]] = [[]]
    blank = True
    for i in range(*best_at):
        t = sequence[i]
        if t.breaks == 2:
            blocks.append([])
            blank = True
        elif t.breaks == 1:
            blank = True
        if t.words and good[i]:
            if blocks[-1] and not blank:
                blocks[-1][-1] += t.words[0]
                blocks[-1] += t.words[1:]
            else:
                blocks[-1] += t.words
            blank = t.blank
        elif t.words or not good[i] and t.noise and t.breaks:
            blank = True
    return "\n".join(" ".join(b) for b in blocks if b)


def extract(pages: DataFrame, weights: Weights, page: str = "html") -> DataFrame:
    """Input columns and ``text string`` (empty if none), ``n_chars long``; one row in, one row out.

    Null and empty pages have no text.  Pages are read whole.  Repeated rows come out
    alike; an input column of an output's name gives way to it.
    """
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("text string, n_chars long")
    def extracted(column: pd.Series) -> pd.DataFrame:
        texts = [main_text(v, shared.value) for v in column]
        return pd.DataFrame({"text": texts, "n_chars": [len(t) for t in texts]})

    return with_fields(pages, extracted(F.col(page)), ["text", "n_chars"])
