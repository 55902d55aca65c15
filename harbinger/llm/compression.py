"""Quality rules by compression: repetitive or incompressible text falls outside a band.

A document's Zstandard ratio (compressed bytes over bytes) is low when it repeats itself
and high when it is noise.  Short texts compress badly whatever they say, so the limits
depend on the length.  The same holds for fixed chunks: a document with good prose on
average may still carry a quarter of filler, so the share of chunks outside their band
is limited as well.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harbinger.llm.common import small_batches, with_fields

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Bands:
    """Limits of the ratio by length in bytes: ``(from this length, lowest, highest)``.

    Prose of several languages lies between 0.40 (long) and 0.75 (256 bytes); looped
    phrases fall under 0.25 from a kilobyte on, base64 stays over 0.75.
    """

    level: int = 3
    limits: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, 9.0),
        (128, 0.35, 1.2),
        (256, 0.30, 0.85),
        (1024, 0.22, 0.75),
        (4096, 0.18, 0.72),
    )
    chunk: int = 1024
    chunk_limits: tuple[float, float] = (0.22, 0.75)
    chunk_share: float = 0.25

    def band(self, size: int) -> tuple[float, float]:
        return self.limits[bisect_right([x[0] for x in self.limits], size) - 1][1:]


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, characters in words, symbols, repeated lines, words in repeated triples."""
    text = text or ""
    words = [w for w in text.translate(SPACED).split(" ") if w]
    in_words = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            again += line in seen
            seen.add(line)
    triples = list(zip(words, words[1:], words[2:], strict=False))
    times = Counter(triples)
    covered, end = 0, 0
    if len(times) < len(triples):
        for i, triple in enumerate(triples):
            if times[triple] > 1:
                covered += i + 3 - max(i, end)
                end = i + 3
    return len(words), in_words, symbols, again, covered


SPACED = {ord(c): " " for c in BLANKS}


def ratios(data: bytes, squeeze: zstandard.ZstdCompressor, bands: Bands) -> tuple[float, float]:
    """Ratio of the whole, and the share of chunks outside their band.

    A last chunk under half a chunk joins the one before it; a text of one chunk has no
    share, its whole ratio says the same.
    """
    if not data:
        return 1.0, 0.0
    whole = len(squeeze.compress(data)) / len(data)
    n = max(1, (len(data) + bands.chunk // 2) // bands.chunk)
    if n == 1:
        return whole, 0.0
    outside = 0
    for i in range(n):
        part = data[i * bands.chunk : (i + 1) * bands.chunk if i < n - 1 else len(data)]
        ratio = len(squeeze.compress(part)) / len(part)
        outside += not bands.chunk_limits[0] <= ratio <= bands.chunk_limits[1]
    return whole, outside / n


FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "ratio double, bad_chunks double, base_failed boolean, kept boolean"
)


def judge(texts: DataFrame, text: str = "text", bands: Bands = Bands(), min_words: int = 50,
          repeat_percent: int = 50) -> DataFrame:
    """Input columns and ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ratio,
    bad_chunks, base_failed, kept``; one row in, one row out.

    Null text counts as empty: no words, ratio 1, base failed.  Repeated rows are judged
    alike.  An input column of an output's name gives way to it.  One row at a time is in
    memory beside its Arrow batch, and no data is shuffled.
    """
    small_batches(texts.sparkSession)

    @F.pandas_udf(FIELDS)
    def measured(column: pd.Series) -> pd.DataFrame:
        squeeze = zstandard.ZstdCompressor(level=bands.level)
        rows = []
        for value in column:
            n, chars, symbols, again, covered = counts(value)
            data = (value or "").encode("utf-8", "surrogatepass")
            whole, bad = ratios(data, squeeze, bands)
            low, high = bands.band(len(data))
            failed = n < min_words or 100 * covered > repeat_percent * n
            good = low <= whole <= high and bad <= bands.chunk_share
            rows.append((n, chars, symbols, again, covered, whole, bad, failed, good and not failed))
        return pd.DataFrame(rows, columns=[f.split()[0] for f in FIELDS.split(", ")])

    return with_fields(texts, measured(F.col(text)), [f.split()[0] for f in FIELDS.split(", ")])
