"""Language-model scores from a probabilistic suffix tree held as Spark tables.

The tree holds contexts of up to ``depth`` words.  For each length, a first pass finds which grams are seen twice, by
a few bits of each; a second one counts those, and grams seen ``least`` times or more stay.  A context is
kept where its next-word counts differ from those of its suffix by enough nats (a likelihood-ratio
test).  Its distribution is smoothed by absolute discounting towards its suffix's, down to the
empty context, whose add-one distribution covers all words and one unknown.  A word is scored in
the longest kept suffix of the words before it.

Both limits are the same at every size, so the tree grows with the text.  It is one table of
grams and values: what a gram adds as the end of a context with its next word, and what it leaves
to its suffix as a context of the word after it.  The score of a text is the sum of the values of
its grams.  The ``held`` most frequent grams go to the tasks and are added up there; the others
meet their values where both are dealt by their keys.  Bitmaps of fixed width tell the tasks which grams
need not travel; they let through too many, never too few.

What tasks send is packed: a row holds a stretch of grams, some tens of thousands at most, so that neither Spark
nor a Python worker holds an object or a row for each gram of a text.

Words and grams are known by 64-bit hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from harbinger.session import shared_folder

END = xxhash.xxh64_intdigest(b"")  # no word is empty


@dataclass
class Tree:
    """``values``: ``key, n, base, value``; ``base`` (words only) is log10(n + 1)."""

    depth: int
    tokens: int
    distinct: int
    values: DataFrame

    @property
    def scale(self) -> float:
        return float(np.log10(self.tokens + self.distinct + 1))


def mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


SLICE = 16  # texts
LONGEST = 32  # bytes of a word hashed by table; longer ones are hashed one by one
TABLE = mixed(np.arange(1, LONGEST * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
IN_WORD = np.ones(256, dtype=bool)
IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts in a row, and the first token's place of each, with the end.

    Words are ``[^\\x20\\x09-\\x0D]+``, A-Z lowered.  The hash of a word is the sum of a random number for each
    byte at its place.
    """
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    ends = np.frombuffer(column.buffers()[1], kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends -= ends[0]
    inside = IN_WORD[data]
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1]
    begin = ends[:-1][ends[:-1] < len(data)]
    fresh[begin] = inside[begin]
    at = np.flatnonzero(fresh)
    words = np.diff(np.searchsorted(at, ends))
    starts = np.concatenate(([0], np.cumsum(words + 1)))
    out = np.full(starts[-1], END, dtype=np.uint64)
    if len(at):
        chars = LOWER[data[inside]]
        first = np.flatnonzero(fresh[inside])
        length = np.diff(np.append(first, len(chars)))
        place = np.minimum(np.arange(len(chars)) - np.repeat(first, length), LONGEST - 1)
        hashes = np.add.reduceat(TABLE[place << 8 | chars], first)
        for i in np.flatnonzero(length > LONGEST):
            hashes[i] = xxhash.xxh64_intdigest(chars[first[i] : first[i] + length[i]].tobytes())
        out[np.arange(len(at)) + np.repeat(np.arange(len(words)), words)] = hashes
    return out, starts


def extended(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of grams from those of their contexts and last words."""
    return mixed(context * np.uint64(0x9E3779B97F4A7C15) + word)


def grams_of(tokens: np.ndarray, starts: np.ndarray, most: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For lengths 1 to ``most``, the gram that ends at each token; and each token's place in its text.
    A gram keeps to its text where the place is at least its length less one."""
    out = [tokens]
    for _ in range(1, most):
        out.append(np.concatenate((tokens[:1], extended(out[-1][:-1], tokens[1:]))))
    return out, np.arange(len(tokens)) - np.repeat(starts[:-1], np.diff(starts))


def slices(column: pa.Array, rows: int = SLICE) -> Iterator[pa.Array]:
    """The texts, a few at a time, so that their words need little memory."""
    for i in range(0, len(column), rows):
        yield column.slice(i, rows)


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """What a query has shuffled is removed at its end, as its rows are kept elsewhere by then."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Texts go to Python about 2 MB at a time."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "2m")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def sent_out(spark: SparkSession, value: list) -> Iterator[Broadcast]:
    """Broadcast for the jobs run inside; its copies on the executors' disks go at the end."""
    shared = spark.sparkContext.broadcast(value)
    try:
        yield shared
    finally:
        shared.destroy()


class Scratch:
    """Tables of one run in a folder of their own within the shared folder; each goes once it has been used."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/suffix-tree-{uuid.uuid4().hex}"
        self.schemas: dict[str, StructType] = {}

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        with freed(self.spark):
            df.write.parquet(f"{self.folder}/{name}")
        self.schemas[name] = df.schema
        return self.table(name)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


WIDTH, PART = 27, 19  # bits of a place in a bitmap, and inside one of its blocks


def places_of(keys: DataFrame) -> DataFrame:
    """``deal, places``: what ``bitmap`` takes, with two bits for each key."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in gathered((b.column(0).to_numpy().view(np.uint64) for b in batches), len):
            key = np.concatenate(some)
            place = np.sort(np.concatenate((key, second(key))) & np.uint64(2**WIDTH - 1))
            block = (place >> np.uint64(PART)).astype(np.int64)
            first = firsts(block)
            yield packed(block[first], first, len(place), places=(place & np.uint64(2**PART - 1)).astype(np.uint32))

    return keys.mapInArrow(sent, "deal long, places binary")


def bitmap(places: DataFrame, scratch: Scratch) -> np.ndarray:
    """Bits set at packed ``places`` of the blocks ``deal``: 16 MB whatever the number of keys."""

    def lanes(group: pa.Table) -> pa.Table:
        bits = np.zeros(2**PART, dtype=bool)
        for piece in group["places"]:
            bits[np.frombuffer(piece.as_buffer(), np.uint32)] = True
        bits = np.packbits(bits, bitorder="little")
        return pa.table({"block": group["deal"][:1], "bits": pa.array([bits.tobytes()], pa.binary())})

    out = np.zeros((2 ** (WIDTH - PART), 2 ** (PART - 6)), dtype=np.uint64)
    name = f"bits-{uuid.uuid4().hex}"
    for r in scratch.stage(places.groupBy("deal").applyInArrow(lanes, "block long, bits binary"), name).toLocalIterator():
        out[r.block] = np.frombuffer(r.bits, dtype=np.uint64)
    scratch.drop(name)
    return out.reshape(-1)


def second(keys: np.ndarray) -> np.ndarray:
    return keys >> np.uint64(WIDTH)


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    lane = (keys >> np.uint64(6)) & np.uint64(len(bits) - 1)
    return (bits[lane] >> (keys & np.uint64(63))) & np.uint64(1) == 1


def gathered(parts: Iterator, size: Callable, most: int = 500_000) -> Iterator[list]:
    """The parts in lists of little more than ``most`` in all."""
    waiting, total = [], 0
    for part in parts:
        waiting.append(part)
        total += size(part)
        if total >= most:
            yield waiting
            waiting, total = [], 0
    if waiting:
        yield waiting


def firsts(ordered: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))[: len(ordered)])


def dealt(keys: np.ndarray, deals: int) -> np.ndarray:
    """Equal stretches of all keys, in their order."""
    return (keys >> np.uint64(32)) * np.uint64(deals) >> np.uint64(32)


def packed(deal: np.ndarray, first: np.ndarray, size: int, **columns: np.ndarray) -> pa.RecordBatch:
    """A row for each run of entries that go the same way: ``deal``, and the bytes of each column's entries."""
    arrays = [pa.array(deal.astype(np.int64))]
    for c in columns.values():
        ends = np.append(first, size) * c.itemsize
        buffers = [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(c))]
        arrays.append(pa.Array.from_buffers(pa.binary(), len(first), buffers))
    return pa.RecordBatch.from_arrays(arrays, ["deal", *columns])


def entries(group: pa.Table, column: str, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in group[column]])


def seen_grams(batches: Iterator[pa.RecordBatch], length: int, bits: list[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
    """``key, context, suffix`` of the grams of a length, a few texts at a time.  ``bits`` say for grams of 2, 3, ...
    words which may be repeated; a gram with a part that is not is left out."""
    for batch in batches:
        for texts in slices(batch.column(0)):
            grams, place = grams_of(*tokens_of(texts), length)
            good = np.ones(len(place), dtype=bool)
            for k in range(1, length):
                good = good & np.roll(good, 1) & (place >= k)
                if k <= len(bits):
                    good[good] = passes(bits[k - 1], grams[k][good])
            if length == 1:
                yield (grams[0],)
            else:
                yield grams[-1][good], np.roll(grams[-2], 1)[good], grams[-2][good]


def repeated(train: DataFrame, text: str, size: int, length: int, below: Broadcast, held: int = 2_000_000) -> DataFrame:
    """``deal, places`` for ``bitmap``: the last 27 bits of all grams of ``length`` words seen twice or more, and of few others.

    Tasks send 32 bits a gram, dealt by further bits, so that a group holds about ``held`` of them.
    ``size``: bytes of all texts.  ``below``: bitmaps of the repeated grams of 2 to ``length - 1`` words.
    """
    deals = np.uint64(max(1, min(2**18, size // 4 // (256 * held))))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in gathered((g[0] for g in seen_grams(batches, length, below.value)), len):
            key = np.concatenate(some)
            group = (key >> np.uint64(19) & np.uint64(255)) * deals + (key >> np.uint64(27) & np.uint64(2**18 - 1)) % deals
            entry = (key & np.uint64(2**19 - 1) | key >> np.uint64(45) << np.uint64(19)) & np.uint64(2**32 - 1)
            both = np.sort(group << np.uint64(32) | entry)
            both = both[np.concatenate(([True, True], both[2:] != both[:-2]))[: len(both)]]  # twice is enough
            group = both >> np.uint64(32)
            first = firsts(group)
            yield packed(group[first], first, len(both), entries=both.astype(np.uint32))

    def twice(group: pa.Table) -> pa.Table:
        entry = np.sort(entries(group, "entries", np.uint32))
        low = entry[1:][entry[1:] == entry[:-1]] & np.uint32(2**PART - 1)
        block = group["deal"][0].as_py() // int(deals)
        return pa.table({"deal": pa.array([block], pa.int64()), "places": pa.array([low.tobytes()], pa.binary())})

    return train.select(text).mapInArrow(sent, "deal long, entries binary").groupBy("deal").applyInArrow(
        twice, "deal long, places binary"
    )


def gram_counts(train: DataFrame, text: str, size: int, length: int, bits: Broadcast, least: int = 1,
                held: int = 500_000) -> DataFrame:
    """``key, context, suffix, n`` of the grams of a length that ``bits`` let through and that are seen ``least`` times.
    The context is the gram without its last word, the suffix that without its first.

    Tasks send packed entries, dealt by the keys' bits, so that a group holds about ``held`` of them.
    """
    deals = max(16, min(2**18, size // (4 * held)))
    names = ("key", "context", "suffix")[: 3 if length > 1 else 1]

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in gathered(seen_grams(batches, length, bits.value), lambda g: len(g[0])):
            columns = [np.concatenate(c) for c in zip(*some)]
            some.clear()
            order = np.argsort(columns[0])
            columns[0] = columns[0][order]
            first = firsts(columns[0])
            n = np.diff(np.append(first, len(order))).astype(np.uint32)
            columns = [columns[0][first], *[c[order[first]] for c in columns[1:]]]
            deal = dealt(columns[0], deals)
            first = firsts(deal)
            yield packed(deal[first], first, len(deal), n=n, **dict(zip(names, columns)))

    def summed(group: pa.Table) -> pa.Table:
        key = entries(group, "key", np.uint64)
        order = np.argsort(key)
        key = key[order]
        first = firsts(key)
        n = np.add.reduceat(entries(group, "n", np.uint32)[order].astype(np.int64), first) if len(key) else np.zeros(0, dtype=np.int64)
        kept = n >= least
        out = {"key": key[first][kept].view(np.int64), "n": n[kept]}
        for x in names[1:]:
            out[x] = entries(group, x, np.int64)[order[first[kept]]]
        return pa.table(out)

    sides = "".join(f", {x} binary" for x in names)
    return train.select(text).mapInArrow(sent, f"deal long, n binary{sides}").groupBy("deal").applyInArrow(
        summed, "key long, n long" + "".join(f", {x} long" for x in names[1:])
    )


def renamed(df: DataFrame, **names: str) -> DataFrame:
    return df.select(*[F.col(old).alias(new) for new, old in names.items()])


def learn(train: DataFrame, text: str = "text", depth: int = 2, least: int = 2, nats: float = 4.0,
          discount: float = 0.75) -> Tree:
    """The tree.  All texts are counted.  Null texts are empty ones: their end counts.  Repeated rows count
    as often as they stand.  Without texts every word is the unknown one.  ``least`` is 2 or more."""
    scratch = Scratch(train.sparkSession)
    least = max(2, least)
    with small_batches(train.sparkSession):
        size = train.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text}`"))), F.lit(0)).alias("n")).first().n
        bits: list[np.ndarray] = []
        with sent_out(train.sparkSession, bits) as shared:
            words = scratch.stage(gram_counts(train, text, size, 1, shared), "words")
        for length in range(2, depth + 2):
            with sent_out(train.sparkSession, bits) as shared:
                bits.append(bitmap(repeated(train, text, size, length, shared), scratch))
            with sent_out(train.sparkSession, bits) as shared:
                scratch.stage(gram_counts(train, text, size, length, shared, least), f"grams-{length}")
    row = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = int(row.n), int(row.v)
    share = (F.col("n") + 1) / F.lit(float(tokens + distinct + 1))
    levels = [words.withColumn("rate", share)]
    for length in range(2, depth + 2):
        below = levels[-1].where(F.col("n") >= least)
        level = (
            scratch.table(f"grams-{length}")
            .join(renamed(below, context="key", whole="n"), "context")
            .join(renamed(below, suffix="key", there="rate"), "suffix")
            .withColumn("rate", F.col("n") / F.col("whole"))
        )
        levels.append(scratch.stage(level, f"level-{length}"))
        scratch.drop(f"grams-{length}")
    kept = kept_contexts(levels, nats, discount, scratch)
    return Tree(depth, tokens, distinct, valued(levels, kept, discount, scratch))


def kept_contexts(levels: list[DataFrame], nats: float, discount: float, scratch: Scratch) -> list[DataFrame]:
    """``context, rest`` of the kept contexts of each length: ``rest`` is the mass left to the suffix.  A kept
    context keeps its suffixes, so that the states form a tree."""
    kept: list[DataFrame] = []
    for k in range(len(levels) - 1, 0, -1):
        sums = levels[k].groupBy("context").agg(
            F.sum(F.col("n") * F.log(F.col("rate") / F.col("there"))).alias("gain"),
            F.sum("n").alias("seen"), F.sum("there").alias("there"), F.max("whole").alias("whole"),
            F.sum(F.greatest(F.col("n") - discount, F.lit(0.0))).alias("mass"),
        )
        rare = F.col("whole") - F.col("seen")
        other = F.greatest(F.col("whole") * (1 - F.col("there")), F.lit(1e-9))
        gain = F.col("gain") + F.when(rare > 0, rare * F.log(rare / other)).otherwise(0.0)
        sums = sums.select("context", gain.alias("gain"), (1 - F.col("mass") / F.col("whole")).alias("rest"))
        wanted = F.col("gain") >= nats
        if kept:
            longer = kept[-1].join(renamed(levels[k], context="key", suffix="suffix"), "context")
            needed = longer.select(F.col("suffix").alias("context"), F.lit(True).alias("needed")).distinct()
            sums, wanted = sums.join(needed, "context", "left"), wanted | F.col("needed")
        kept.append(scratch.stage(sums.where(wanted).select("context", "rest"), f"kept-{k + 1}"))
    return kept[::-1]


def valued(levels: list[DataFrame], kept: list[DataFrame], discount: float, scratch: Scratch) -> DataFrame:
    """``key, n, base, value`` of all words and of those longer grams that change a score."""
    parts = []
    below = levels[0].select("key", "n", F.log10(F.col("n") + 1.0).alias("base"), F.col("rate").alias("p"),
                             F.log10(F.col("n") + 1.0).alias("gain"))
    for k in range(len(levels)):
        if k:
            rows = levels[k].join(kept[k - 1], "context", "left").join(renamed(below, suffix="key", low="p"), "suffix")
            left = F.col("rest") * F.col("low")
            p = F.greatest(F.col("n") - discount, F.lit(0.0)) / F.col("whole") + left
            below = rows.select(
                "key", "n", F.lit(None).cast("double").alias("base"), F.coalesce(p, "low").alias("p"),
                F.coalesce(F.log10(p / left), F.lit(0.0)).alias("gain"),
            )
            if k < len(kept):  # read again for longer grams
                below = scratch.stage(below, f"rates-{k + 1}")
                scratch.drop("words" if k == 1 else f"rates-{k}", f"level-{k + 1}")
        value: Column = F.col("gain")
        rows = below
        if k < len(kept):
            rows = below.join(renamed(kept[k], key="context", rest="rest"), "key", "left")
            value = value + F.coalesce(F.log10("rest"), F.lit(0.0))
        rows = rows.select("key", "n", "base", value.alias("value"))
        parts.append(scratch.stage(rows.where("value <> 0") if k else rows, f"values-{k + 1}"))
    lengths = range(2, len(levels) + 1)
    scratch.drop("words", *[f"{name}-{k}" for k in lengths for name in ("level", "rates", "kept")])
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def split_by_count(values: DataFrame, held: int) -> tuple[DataFrame, DataFrame, int]:
    """At most ``held`` grams, the most frequent, the others, and how many these are; cut at eighths of powers of two."""
    counts = values.groupBy(F.floor(F.log2("n") * 8).alias("b")).agg(F.count("*").alias("rows"), F.min("n").alias("least"))
    cut, total, others = None, 0, 0
    for r in sorted(counts.collect(), key=lambda r: -r.b):
        if others or total + r.rows > held:
            others += r.rows
        else:
            cut, total = r.least, total + r.rows
    if cut is None:
        return values.where("false"), values, others
    return values.where(F.col("n") >= cut), values.where(F.col("n") < cut), others


class Head:
    """``base`` and ``value`` of some grams, looked up by the first bits of their keys."""

    def __init__(self, table: pa.Table):
        key = table["key"].to_numpy().view(np.uint64)
        order = np.argsort(key)
        key = key[order]
        wide = len(key).bit_length() + 2
        self.shift = np.uint64(64 - wide)
        self.begin = np.searchsorted(key >> self.shift, np.arange(2**wide, dtype=np.uint64)).astype(np.int32)
        self.steps = int(np.diff(np.append(self.begin, len(key))).max(initial=0))
        self.key = np.append(key, key[:1] if len(key) else np.uint64(0))  # one past the end
        self.base, self.value = (
            np.append(table[c].to_numpy(zero_copy_only=False).astype(float)[order], 0.0) for c in ("base", "value")
        )

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places, and whether the keys stand there."""
        at = self.begin[keys >> self.shift]
        last = len(self.key) - 1
        found = (self.key[at] == keys) & (at < last)
        other = np.flatnonzero(~found & (at < last))
        for _ in range(self.steps - 1):
            at[other] += 1
            hit = (self.key[at[other]] == keys[other]) & (at[other] < last)
            found[other[hit]] = True
            other = other[~hit & (self.key[at[other]] < keys[other]) & (at[other] < last)]
        return at, found


def sums_of(texts: pa.Array, head: Head, rest: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """``n_tokens``, ``n_known``, ``base`` and ``value`` of each text over the grams in ``head``; and each other gram
    that ``rest`` lets through, with its text's place."""
    tokens, starts = tokens_of(texts)
    grams, place = grams_of(tokens, starts, depth + 1)
    of = np.repeat(np.arange(len(texts)), np.diff(starts))
    total = np.zeros(len(tokens))
    others = []
    for k, gram in enumerate(grams):
        inside = place >= k
        at, found = head.find(gram)
        found &= inside
        total += np.where(found, head.value[at], 0.0)
        if k == 0:
            known, base = found, np.where(found, head.base[at], 0.0)
        away = np.flatnonzero(inside & ~found)
        away = away[passes(rest, gram[away])]
        away = away[passes(rest, second(gram[away]))]
        others.append((gram[away], of[away]))
    known, base, total = (np.add.reduceat(x, starts[:-1]) for x in (known.astype(np.int64), base, total))
    return np.diff(starts), known, base, total, *[np.concatenate(x) for x in zip(*others)]


def summed_up(texts: DataFrame, tail: DataFrame, shared: Broadcast, depth: int, deals: int) -> DataFrame:
    """``line, n_tokens, known, base, value`` of rows ``row, line, text``: sums over all grams of a text.

    ``shared``: the ``Head``, and a bitmap of the grams of ``tail``.
    Tasks add up the grams in the head and ask for the others.  Asked grams and ``tail`` are dealt by their
    keys; what is found there goes back to the texts, dealt by their rows.
    """
    own = StructType().add("line", texts.schema["line"].dataType).add("row", "long").add("n_tokens", "long").add("known", "long").add("base", "double").add("value", "double")
    asked = StructType([*own.fields]).add("deal", "long").add("origin", "long").add("tops", "binary").add("mids", "binary").add(
        "lows", "binary").add("places", "binary")
    found = StructType([*own.fields]).add("home", "long").add("deal", "long").add("rows", "binary").add("knowns", "binary").add(
        "bases", "binary").add("values", "binary")

    def padded(columns: dict[str, pa.Array], schema: pa.Schema, line: pa.DataType, rows: int) -> pa.Table:
        schema = schema.set(0, pa.field("line", line))
        return pa.table([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema)

    def home(rows: np.ndarray) -> np.ndarray:
        return dealt(mixed(rows.view(np.uint64)), deals).astype(np.int64)

    def parts(batches: Iterator[pa.RecordBatch], head: Head, rest: np.ndarray) -> Iterator:
        for batch in batches:
            row, line, text = batch.columns
            for i, some in enumerate(slices(text)):
                ids = row.slice(i * SLICE, SLICE).to_numpy()
                *sums, key, of = sums_of(some, head, rest, depth)
                yield line.slice(i * SLICE, SLICE), ids, sums, key, ids[of]

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(asked)
        # 62,500 rows at most, so that two bytes tell them apart
        for some in gathered(parts(batches, *shared.value), lambda p: len(p[3]) + 16 * len(p[1])):
            row = np.concatenate([p[1] for p in some])
            sums = [pa.array(np.concatenate(c)) for c in zip(*[p[2] for p in some])]
            columns = dict(zip(("n_tokens", "known", "base", "value"), sums))
            own_deal = pa.array(-1 - home(row))
            lines = pa.concat_arrays([p[0] for p in some])
            columns |= {"line": lines, "row": pa.array(row), "deal": own_deal}
            yield from padded(columns, schema, lines.type, len(row)).to_batches()
            key = np.concatenate([p[3] for p in some])
            place = np.concatenate([p[4] for p in some]) - row[0]
            order = np.argsort(key)
            key, place = key[order], place[order].astype(np.uint16)
            deal = dealt(key, deals)
            first = firsts(deal)
            # sorted keys in parts, as the first ones shrink when written
            tops, mids = (key >> np.uint64(48)).astype(np.uint16), (key >> np.uint64(32)).astype(np.uint16)
            blocks = packed(deal[first], first, len(key), tops=tops, mids=mids, lows=key.astype(np.uint32), places=place)
            columns = dict(zip(blocks.schema.names, blocks.columns)) | {"origin": pa.array(np.full(len(first), row[0]))}
            yield from padded(columns, schema, lines.type, len(first)).to_batches()

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in gathered(iter(batches), len):
            block = pa.Table.from_batches(some)
            key = block["key"].to_numpy().view(np.uint64)
            order = np.argsort(key)
            key = key[order]
            deal = dealt(key, deals)
            first = firsts(deal)
            base, value = (block[c].to_numpy()[order] for c in ("base", "value"))
            yield packed(deal[first], first, len(key), keys=key, bases=base, values=value)

    def answered(asks: pa.Table, values: pa.Table) -> pa.Table:
        schema, line = to_arrow_schema(found), asks["line"].type
        if not len(asks):
            return schema.empty_table()
        if asks["deal"][0].as_py() < 0:
            columns = {c: asks[c] for c in own.names} | {"home": pa.array(-1 - asks["deal"].to_numpy())}
            return padded(columns, schema, line, len(asks))
        if not len(values):
            return schema.empty_table()
        known = entries(values, "keys", np.uint64)
        order = np.argsort(known)
        known = known[order]
        base, value = (entries(values, c, float)[order] for c in ("bases", "values"))
        found_at, found_row = [], []
        for ask in asks.select(["origin", "tops", "mids", "lows", "places"]).to_batches(max_chunksize=1):
            origin, *columns = (c[0] for c in ask.columns)
            top, mid, low, place = (np.frombuffer(c.as_buffer(), t) for c, t in zip(columns, ("u2", "u2", "u4", "u2")))
            key = top.astype(np.uint64) << np.uint64(48) | mid.astype(np.uint64) << np.uint64(32) | low
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            hit = known[at] == key
            found_at.append(at[hit].astype(np.int32))
            found_row.append(origin.as_py() + place[hit].astype(np.int64))
        at, row = np.concatenate(found_at), np.concatenate(found_row)
        mark = mixed(row.view(np.uint64))
        order = np.argsort(mark, kind="stable")
        at, mark, row = at[order], mark[order], row[order]
        first = firsts(mark)
        if not len(first):
            return schema.empty_table()
        word = ~np.isnan(base[at])
        sums = [np.add.reduceat(x, first) for x in (word.astype(np.int64), np.where(word, base[at], 0.0), value[at])]
        to = dealt(mark[first], deals)
        start = firsts(to)
        blocks = packed(to[start], start, len(to), rows=row[first], knowns=sums[0], bases=sums[1], values=sums[2])
        columns = dict(zip(blocks.schema.names, blocks.columns))
        columns |= {"home": columns["deal"], "deal": pa.array(np.full(len(start), asks["deal"][0].as_py()))}
        return padded(columns, schema, line, len(start))

    def gathered_home(group: pa.Table) -> pa.Table:
        mine = group.filter(pc.is_valid(group["row"]))
        blocks = group.filter(pc.is_valid(group["deal"])).sort_by("deal")
        out = {c: mine[c].to_numpy() for c in ("known", "base", "value")}
        if len(blocks):
            row = mine["row"].to_numpy()
            order = np.argsort(row)
            at = order[np.searchsorted(row, entries(blocks, "rows", np.int64), sorter=order)]
            for c, kind in (("known", np.int64), ("base", float), ("value", float)):
                out[c] = out[c] + np.bincount(at, entries(blocks, f"{c}s", kind), len(row)).astype(kind)
        return pa.table({"line": mine["line"], "n_tokens": mine["n_tokens"], **{c: pa.array(x) for c, x in out.items()}})

    asks = texts.mapInArrow(asking, asked).groupBy("deal")
    values = tail.select("key", "base", "value").mapInArrow(sent, "deal long, keys binary, bases binary, values binary").groupBy("deal")
    result = StructType([f for f in own.fields if f.name != "row"])
    return asks.cogroup(values).applyInArrow(answered, found).groupBy("home").applyInArrow(gathered_home, result)


def score(texts: DataFrame, tree: Tree, text: str = "text", held: int = 500_000) -> DataFrame:
    """Input columns but the text, and ``n_tokens, n_known, base_score, score``; one row per row.

    Whole texts are scored.  A null or empty text is its end token.  Repeated rows come
    out alike; an empty table gives no rows; input columns named as an output give way.
    ``held`` bounds what goes to the tasks and changes no score beyond the rounding of sums.
    """
    spark = texts.sparkSession
    scratch = Scratch(spark)
    outputs = ("n_tokens", "n_known", "base_score", "score")
    carried = [c for c in texts.columns if c != text and c.lower() not in outputs]
    head, tail, others = split_by_count(tree.values, held)
    size = texts.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text}`"))), F.lit(0)).alias("n")).first().n
    deals = max(16, min(2**18, max(size // 12_000_000, others // 300_000)))
    line = F.struct(*[F.col(f"`{c}`") for c in carried]) if carried else F.lit("")
    rows = texts.select(F.monotonically_increasing_id().alias("row"), line.alias("line"), F.col(f"`{text}`").alias("text"))
    with small_batches(spark):
        found = Head(head.select("key", "base", "value").toArrow())
        with sent_out(spark, [found, bitmap(places_of(tail.select("key")), scratch)]) as shared:
            scored = scratch.stage(summed_up(rows, tail, shared, tree.depth, deals), "scored")
    whole = lambda c: F.col(c) - F.col("n_tokens") * F.lit(tree.scale)
    return scored.select(
        *[F.col("line").getField(c).alias(c) for c in carried],
        "n_tokens", F.col("known").alias("n_known"), whole("base").alias("base_score"), whole("value").alias("score"),
    )
