"""Language identification by cross-parsing.

A language's labelled text is held as a suffix automaton, which recognises exactly the
substrings of that text.  A new text is cut greedily into longest matches; the fewer
phrases a language needs per symbol, the closer the text is to it (Ziv-Merhav
cross-parsing).  Texts are parsed in lanes side by side, one numpy step per symbol.
"""

from __future__ import annotations

import sys
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harbinger.llm.common import small_batches, with_fields

UNKNOWN = "und"
PLANE = 0x10000


@dataclass
class Automaton:
    """``codes`` maps code points to symbols.  Transitions lie in one row, each state's at its own offset
    in gaps of the others': slot ``base[state] + symbol`` holds ``target`` if its ``owner`` is the state.
    ``start`` holds those of the first state by symbol, 0 where there is none."""

    codes: np.ndarray
    base: np.ndarray
    owner: np.ndarray
    target: np.ndarray
    start: np.ndarray


def symbols_of(text: str) -> np.ndarray:
    """Code points of the lowered text, every run of other characters as one blank; none without a letter.

    Combining marks go with letters, but are none.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if not LETTER[points].any():
        return points[:0]
    points = np.where(LETTER[points] | MARK[points], points, 32)
    blank = points == 32
    return points[~(blank & np.concatenate(([False], blank[:-1])))] if len(points) else points


LETTER = np.array([chr(i).isalpha() for i in range(sys.maxunicode + 1)])
MARK = np.zeros(len(LETTER), dtype=bool)
MARK[0x300:0x370] = True


def suffix_automaton(sequence: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton (state 1 is the start, 0 is no state)."""
    moves: list[dict[int, int]] = [{}, {}]
    link, length, last = [0, 0], [0, 0], 1
    for c in sequence:
        moves.append({})
        link.append(1)
        length.append(length[last] + 1)
        new, p = len(moves) - 1, last
        while p and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                twin = len(moves) - 1
                while p and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves


def laid_out(moves: list[dict[int, int]], alphabet: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``base``, ``owner`` and ``target``: states of many transitions choose their offset first, those of
    one fill the gaps, so there is hardly a slot more than transitions."""
    room = alphabet * (len(moves) + 2)
    used, base, owner, target = bytearray(room), [0] * len(moves), {}, {}
    filling = False
    low = alphabet  # the gap to begin at; below it states of several transitions hardly fit
    for state in sorted((s for s, out in enumerate(moves) if out), key=lambda s: -len(moves[s])):
        first, *others = sorted(moves[state])
        if not others and low > alphabet and not filling:
            low, filling = alphabet, True
        at, tried = used.find(0, low), 0
        low = at
        while any(used[at - first + x] for x in others):
            at, tried = used.find(0, at + 1), tried + 1
        if tried > 200:
            low += 1
        base[state] = at - first
        for symbol, to in moves[state].items():
            slot = base[state] + symbol
            used[slot], owner[slot], target[slot] = 1, state, to
    size = max(base) + alphabet
    flat = [np.zeros(size, dtype=np.int32) for _ in range(2)]
    for held, row in zip((owner, target), flat, strict=True):
        row[list(held.keys())] = list(held.values())
    return np.array(base, dtype=np.int32), flat[0], flat[1]


def learn_automaton(text: str, alphabet: int) -> Automaton:
    """The most frequent code points get symbols of their own, all further ones share one, and
    those the language never shows share another, which nothing accepts."""
    points = symbols_of(text)
    common = [p for p, _ in sorted(Counter(points.tolist()).items(), key=lambda x: (-x[1], x[0]))]
    codes = np.full(PLANE + 1, alphabet - 1, dtype=np.uint8)
    for i, p in enumerate(common):
        codes[min(p, PLANE)] = min(i, alphabet - 2)
    moves = suffix_automaton(codes[np.minimum(points, PLANE)].tolist())
    start = np.array([moves[1].get(symbol, 0) for symbol in range(alphabet)], dtype=np.int32)
    return Automaton(codes, *laid_out(moves, alphabet), start)


def phrases(lanes: np.ndarray, sizes: np.ndarray, model: Automaton) -> np.ndarray:
    """Phrases that each lane needs; ``lanes[i]`` holds the i-th symbol of every lane, longest lane
    first.  A symbol that the language never shows is a phrase by itself."""
    base, owner, target, start = model.base, model.owner, model.target, model.start
    state = np.ones(lanes.shape[1], dtype=np.int64)
    count = np.zeros(lanes.shape[1], dtype=np.int64)
    open_lanes = np.searchsorted(-sizes, -np.arange(lanes.shape[0]), side="left")
    for i, n in enumerate(open_lanes):
        symbol = model.codes[lanes[i, :n]]
        slot = base[state[:n]] + symbol
        on = np.where(owner[slot] == state[:n], target[slot], 0)
        cut = on == 0
        if cut.any():
            count[:n] += cut & (state[:n] != 1)
            fresh = start[symbol]
            count[:n] += cut & (fresh == 0)
            on = np.where(cut, np.where(fresh == 0, 1, fresh), on)
        state[:n] = on
    return count + (state != 1)


def parse(texts: list[str | None], models: list[Automaton], lane: int = 512, width: int = 4096) -> np.ndarray:
    """Phrases per symbol of each text under each model; NaN where a text has no letter.

    Texts are cut into lanes of ``lane`` symbols, all of which are parsed; a cut costs
    every language at most one phrase.
    """
    pieces, owner, symbols = [], [], np.zeros(len(texts))
    out = np.zeros((len(texts), len(models)))

    def flush() -> None:
        if not pieces:
            return
        order = sorted(range(len(pieces)), key=lambda i: -len(pieces[i]))
        sizes = np.array([len(pieces[i]) for i in order])
        block = np.zeros((sizes[0], len(order)), dtype=np.uint32)
        for column, i in enumerate(order):
            block[: sizes[column], column] = pieces[i]
        own = np.array([owner[i] for i in order])
        for k, model in enumerate(models):
            np.add.at(out[:, k], own, phrases(block, sizes, model))
        pieces.clear()
        owner.clear()

    for i, text in enumerate(texts):
        points = symbols_of(text or "")
        if not (points != 32).any():
            continue
        symbols[i] = len(points)
        points = np.minimum(points, PLANE)
        for k in range(0, len(points), lane):
            pieces.append(points[k : k + lane])
            owner.append(i)
            if len(pieces) == width:
                flush()
    flush()
    with np.errstate(divide="ignore", invalid="ignore"):
        return out / np.where(symbols, symbols, np.nan)[:, None]


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", pieces: int = 150,
          piece: int = 300, alphabet: int = 64) -> dict[str, Automaton]:
    """One automaton per label from a bounded sample of the labelled rows.

    Different texts are counted per label, and those with the smallest hashes are taken:
    ``pieces`` texts per label (all where there are fewer), however often each is
    repeated, of each a stretch of ``piece`` characters at a hashed place.  A label's
    table is bounded by its stretches, whatever the number of labels.  Null texts and
    labels teach nothing.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h")
    )
    totals = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count_distinct("h").alias("n")).toLocalIterator()}
    if not totals:
        return {}
    share = F.create_map(*[F.lit(x) for name, n in sorted(totals.items()) for x in (name, 2.0 * pieces / n)])
    place = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - piece + 1, F.lit(1)).cast("long"))
    sample = (
        rows.where(F.pmod("h", F.lit(1_000_000)) < 1_000_000 * share[F.col("lang")] + 1)
        .select("lang", "h", F.substring(F.col("text"), place.cast("int") + 1, F.lit(piece)).alias("text"))
        .dropDuplicates(["lang", "h"])
    )
    taken: dict[str, list[tuple[int, str]]] = {}
    for row in sample.toLocalIterator():
        taken.setdefault(row.lang, []).append((row.h % 1_000_000, row.text))
    models = {}
    for name in sorted(taken):
        picked = [x for _, x in sorted(taken[name])[:pieces]]
        models[name] = learn_automaton(" ".join(picked), alphabet)
    return models


def identify(texts: DataFrame, models: dict[str, Automaton], text: str = "text") -> DataFrame:
    """Input columns and ``lang_pred string, score double``; one row in, one row out.

    The language with the fewest phrases per symbol wins, ties by name.  ``score`` is
    one less its phrases over the second's (1 where only one language was learned).
    Null and empty texts, and those without any letter, get ``und`` and 0, as does
    everything when nothing was learned.  Whole texts are parsed; repeated rows come out
    alike; an input column of an output's name gives way to it.
    """
    small_batches(texts.sparkSession)
    names = sorted(models)
    shared = texts.sparkSession.sparkContext.broadcast([models[n] for n in names])

    @F.pandas_udf("lang_pred string, score double")
    def parsed(column: pd.Series) -> pd.DataFrame:
        values = [None if v is None else str(v) for v in column]
        out = np.full(len(values), UNKNOWN, dtype=object)
        score = np.zeros(len(values))
        if names:
            rate = parse(values, shared.value)
            known = ~np.isnan(rate[:, 0])
            best = np.argmin(np.where(np.isnan(rate), np.inf, rate), axis=1)
            out[known] = np.array(names, dtype=object)[best[known]]
            if len(names) > 1:
                two = np.sort(rate[known], axis=1)[:, :2]
                score[known] = 1 - two[:, 0] / two[:, 1]
            else:
                score[known] = 1.0
        return pd.DataFrame({"lang_pred": out, "score": score})

    return with_fields(texts, parsed(F.col(text)), ["lang_pred", "score"])
