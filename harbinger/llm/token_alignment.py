"""Alignment of two tokenizers' tokens over the same bytes.

Both tokenizations of a text cover the same bytes.  Offsets where a token of either side ends
are shared cuts; they are found by divide and conquer: near the middle of an interval a cut is
looked for by bisection in the other side's ends, wider and wider around the middle, and both
halves are taken on; an interval without a cut inside is a group.  All texts of a slice lie
one after the other as a single interval (their ends are cuts as well), and all intervals
of a depth are treated together.

Two tokens that end together are a link.  The bytes of one then end with the bytes of the
other, so the pairs that can ever be linked follow from the two vocabularies; their number
is at most the bytes of all tokens (times the few tokens that share their bytes).  That
list is sent to the tasks, and corpus-wide counts are one number per pair.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harbinger.llm.common import written

TOKENIZERS = "/opt/tokenizers"
SLICE = 1 << 20  # bytes of text that are tokenized at a time (whole texts, one at least)
SPACE = "▁"
# Fixed value: how byte-level vocabularies of this family cut a text before merging.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# texts of characters whose classes have long been settled, so that both libraries cut them alike
COMMON = re.compile("[\t\n\r -~\xa0-\u024f\u2010-\u2027\u2030-\u205e\u20ac]*")


def byte_of() -> dict[str, int]:
    """The public byte-level alphabet: printable characters stand for themselves, the others
    for code points from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("\xa1"), ord("\xac") + 1), *range(ord("\xae"), 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary_a(source: str) -> list[bytes]:
    alphabet = byte_of()
    entries = json.loads(source)["model"]["vocab"]
    out = [b""] * (max(entries.values()) + 1)
    for entry, i in entries.items():
        out[i] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
    return out


def vocabulary_b(model) -> list[bytes]:
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [
        bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(SPACE, " ").encode("utf-8", "surrogatepass")
        for i, p in enumerate(pieces)
    ]


def same_ranks(source: str, tokens: list[bytes]):
    """The same byte pair encoding in a faster library, where the file's merges are in the order of their ids."""
    import tiktoken

    model = json.loads(source)["model"]
    special = {t["content"] for t in json.loads(source)["added_tokens"]}
    merged = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in model["merges"]]
    ids = [i for entry, i in model["vocab"].items() if entry not in special]
    if merged != sorted(merged) or len(set(merged)) + 256 != len(ids) or len({tokens[i] for i in ids}) != len(ids):
        return None
    return tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks={tokens[i]: i for i in ids}, special_tokens={})


def possible_links(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Sorted keys ``a << 32 | b`` of the tokens of which one ends with the other."""
    ids_a, ids_b = {}, {}
    for where, tokens in ((ids_a, a), (ids_b, b)):
        for i, t in enumerate(tokens):
            where.setdefault(t, []).append(i)
    pairs = {(i, j) for i, t in enumerate(a) for n in range(len(t)) for j in ids_b.get(t[n:], ())}
    pairs |= {(i, j) for j, t in enumerate(b) for n in range(len(t)) for i in ids_a.get(t[n:], ())}
    return np.array(sorted(i << 32 | j for i, j in pairs), "i8")


class Aligner:
    """Both tokenizers with what follows from their vocabularies."""

    def __init__(self, a: str, b: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(a)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        self.bytes_a, self.bytes_b = vocabulary_a(a), vocabulary_b(self.b)
        self.fast = same_ranks(a, self.bytes_a)
        self.size_a, self.size_b = (np.array([len(t) for t in v], "i8") for v in (self.bytes_a, self.bytes_b))
        # a token's number with what follows it: in a group, or at the end of a group's side
        marks = [(self.size_a, b","), (self.size_a, b"|"), (self.size_b, b","), (self.size_b, b";")]
        self.written = np.array([str(i).encode() + m for sizes, m in marks for i in range(len(sizes))], object)

    def tokens(self, texts: list[str | None]) -> tuple[list, list]:
        """Ids per text on both sides; both empty where a side's bytes are not the text's."""
        there = [t for t in texts if t]
        found_a = iter([
            self.fast.encode_ordinary(" " + t) if self.fast and COMMON.fullmatch(t) else self.a.encode(" " + t, add_special_tokens=False).ids
            for t in there
        ])
        found_b = iter(self.b.encode(there, num_threads=1))
        ids_a, ids_b = [], []
        for t in texts:
            one, other = (next(found_a), next(found_b)) if t else ([], [])
            whole = b" " + t.encode("utf-8", "surrogatepass") if t else b""
            same = b"".join([self.bytes_a[i] for i in one]) == whole == b"".join([self.bytes_b[i] for i in other])
            ids_a.append(one if same else [])
            ids_b.append(other if same else [])
        return ids_a, ids_b


@lru_cache(maxsize=1)
def _aligner(a: str, b: bytes) -> Aligner:
    return Aligner(a, b)


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """Positions in ``ends_a`` of the offsets that both sides hold, found by halving.

    Both are strictly rising and end together.  A cut is looked for at the middle of each
    interval, then within 4, 16, 64 ... places of it; the nearest one splits the interval.
    """
    if not len(ends_a):
        return np.array([], "i8")
    cuts = [np.array([len(ends_a) - 1])]
    lo, hi, reach = np.array([0]), np.array([len(ends_a) - 1]), np.array([0])  # cuts after lo .. hi - 1 are inside
    while len(lo) and lo[0] < hi[0]:
        mid = (lo + hi - 1) // 2
        first, last = np.maximum(lo, mid - reach), np.minimum(hi - 1, mid + reach)
        many = last - first + 1
        begin = np.cumsum(many) - many
        probe = np.repeat(first - begin, many) + np.arange(many.sum())
        hit = ends_b[np.searchsorted(ends_b, ends_a[probe])] == ends_a[probe]
        away = np.where(hit, np.abs(probe - np.repeat(mid, many)), len(ends_a)) * 2 + (probe > np.repeat(mid, many))
        nearest = np.minimum.reduceat(away, begin)
        found = nearest < 2 * len(ends_a)
        cut = mid + np.where(nearest % 2, 1, -1) * (nearest // 2)
        cuts.append(cut[found])
        wider = ~found & ((first > lo) | (last < hi - 1))
        left = np.stack([lo[found], cut[found]])
        right = np.stack([cut[found] + 1, hi[found]])
        lo, hi, reach = (
            np.concatenate(x) for x in zip(
                (left[0], left[1], np.zeros(len(left[0]), int)), (right[0], right[1], np.zeros(len(right[0]), int)),
                (lo[wider], hi[wider], np.maximum(4, reach[wider] * 4)),
            )
        )
        some = lo < hi
        lo, hi, reach = lo[some], hi[some], reach[some]
    return np.sort(np.concatenate(cuts))


def slices(column: pa.Array):
    """Stretches of texts of at most SLICE bytes, one text at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype("i8"))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE, side="right")))
        yield column.slice(start, stop - start).to_pylist()
        start = stop


def aligned(aligner: Aligner, texts: list[str | None]) -> dict[str, np.ndarray]:
    """Flat arrays for a slice: ids ``a``, ``b``, tokens per text ``n_a``, ``n_b``, and the positions of
    each group's last tokens, ``cut_a`` and ``cut_b``, with the number of groups per text."""
    ids_a, ids_b = aligner.tokens(texts)
    n_a, n_b = (np.array([len(x) for x in ids], "i8") for ids in (ids_a, ids_b))
    a, b = (np.fromiter(chain.from_iterable(ids), "i8", n.sum()) for ids, n in ((ids_a, n_a), (ids_b, n_b)))
    ends_a, ends_b = np.cumsum(aligner.size_a[a]), np.cumsum(aligner.size_b[b])
    cut_a = shared_cuts(ends_a, ends_b)
    groups = np.diff(np.searchsorted(cut_a, np.concatenate([[0], np.cumsum(n_a)])))
    return {"a": a, "b": b, "n_a": n_a, "n_b": n_b, "cut_a": cut_a, "cut_b": np.searchsorted(ends_b, ends_a[cut_a]), "groups": groups}


def digests(aligner: Aligner, found: dict[str, np.ndarray]) -> list[str]:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3`` per text, empty without tokens."""
    a, b, cut_a, cut_b = (found[c] for c in ("a", "b", "cut_a", "cut_b"))
    order = np.empty(len(a) + len(b), "i8")
    code_a, code_b = a.copy(), b + 2 * len(aligner.size_a)
    code_a[cut_a] += len(aligner.size_a)
    code_b[cut_b] += len(aligner.size_b)
    group_a = np.searchsorted(cut_a, np.arange(len(a)))
    group_b = np.searchsorted(cut_b, np.arange(len(b)))
    order[np.arange(len(a)) + np.concatenate([[0], cut_b + 1])[group_a]] = code_a
    order[np.arange(len(b)) + cut_a[group_b] + 1] = code_b
    words, out, at = aligner.written[order], [], 0
    for n in found["n_a"] + found["n_b"]:
        text = b"".join(words[at : at + n].tolist())
        out.append(hashlib.sha256(text[:-1]).hexdigest() if n else "")
        at += n
    return out


def sources(spark, folder: str):
    """Both files, sent to the tasks (a few megabytes): executors need not see the folder."""
    with open(f"{folder}/byte_bpe_50k.json", encoding="utf-8") as a, open(f"{folder}/piece_bpe_32k.model", "rb") as b:
        return spark.sparkContext.broadcast((a.read(), b.read()))


def groups(docs: DataFrame, folder: str = TOKENIZERS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, groups``: the groups of each text in order, an array of ``end`` (byte offset in
    space + text), ``a`` and ``b`` (token ids).  Texts without tokens have an empty array: null and empty
    ones, and those that a tokenizer does not give back byte for byte."""
    files = sources(docs.sparkSession, folder)
    kind = docs.schema[key].dataType.simpleString()

    def work(batches):
        aligner = _aligner(*files.value)
        for batch in batches:
            at = 0
            for texts in slices(batch.column("text")):
                f = aligned(aligner, texts)
                sides = []
                for ids, cut in ((f["a"], f["cut_a"]), (f["b"], f["cut_b"])):
                    offsets = np.concatenate([[0], cut + 1]).astype("i4")
                    sides.append(pa.ListArray.from_arrays(offsets, pa.array(ids.astype("i4"))))
                ends = np.cumsum(aligner.size_a[f["a"]])[f["cut_a"]]
                last = np.concatenate([[0], np.cumsum(f["groups"])]).astype("i4")
                base = np.concatenate([[0], ends])[last[:-1]]
                ends = ends - np.repeat(base, f["groups"])
                items = pa.StructArray.from_arrays([pa.array(ends), *sides], names=["end", "a", "b"])
                yield pa.record_batch(
                    [batch.column("key").slice(at, len(texts)), pa.ListArray.from_arrays(last, items)], names=["doc_id", "groups"]
                )
                at += len(texts)

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(work, f"doc_id {kind}, groups ARRAY<STRUCT<end: LONG, a: ARRAY<INT>, b: ARRAY<INT>>>")


def align(docs: DataFrame, folder: str = TOKENIZERS, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` per row, and the links of
    the corpus ``a, b, count, best``.

    Texts are tokenized once: links go to the shared folder as numbers of their pairs and are
    read twice, to be counted and to be summed up.  ``best`` says that no other link of ``b`` has
    a higher count.  Rows without tokens (see ``groups``) have zeros and an empty digest.  Repeated
    rows count as often as they occur; other columns are not read.
    """
    spark = docs.sparkSession
    files = sources(spark, folder)
    aligner = _aligner(*files.value)
    keys = possible_links(aligner.bytes_a, aligner.bytes_b)
    pairs = spark.sparkContext.broadcast(keys)
    kind = docs.schema[key].dataType.simpleString()

    def work(batches):
        aligner = _aligner(*files.value)
        for batch in batches:
            at = 0
            for texts in slices(batch.column("text")):
                f = aligned(aligner, texts)
                links = np.searchsorted(pairs.value, f["a"][f["cut_a"]] << 32 | f["b"][f["cut_b"]]).astype("i4")
                ends = np.concatenate([[0], np.cumsum(f["groups"])]).astype("i4")
                yield pa.record_batch(
                    [batch.column("key").slice(at, len(texts)), pa.array(f["n_a"]), pa.array(f["n_b"]), pa.array(f["groups"]),
                     pa.array(digests(aligner, f), pa.string()), pa.ListArray.from_arrays(ends, pa.array(links))],
                    names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"],
                )
                at += len(texts)

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    shape = f"doc_id {kind}, n_a LONG, n_b LONG, n_groups LONG, groups_sha256 STRING, links ARRAY<INT>"
    found = written(rows.mapInArrow(work, shape), "alignment")

    def count(batches):
        total = np.zeros(len(pairs.value), "i8")
        for batch in batches:
            total += np.bincount(batch.column("links").flatten().to_numpy(), minlength=len(total))
        yield pa.record_batch([pa.array(np.flatnonzero(total).astype("i4")), pa.array(total[total > 0])], names=["link", "n"])

    counted = found.select("links").mapInArrow(count, "link INT, n LONG").groupBy("link").agg(F.sum("n").alias("n"))
    held = counted.toPandas()  # at most one row per possible link
    counts = np.zeros(len(keys), "i8")
    counts[held["link"].to_numpy()] = held["n"].to_numpy()
    highest = np.zeros(len(aligner.bytes_b), "i8")
    np.maximum.at(highest, keys & 0xFFFFFFFF, counts)
    best = (counts > 0) & (counts == highest[keys & 0xFFFFFFFF])
    sent = spark.sparkContext.broadcast((counts, best))

    def add_up(batches):
        counts, best = sent.value
        for batch in batches:
            lists = batch.column("links")
            links, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            ends = ends - ends[0] if len(ends) else ends
            sums = [np.concatenate([[0], np.cumsum(x[links])]) for x in (counts, best.astype("i8"))]
            total, good = (np.diff(s[ends]) for s in sums)
            rest = [batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")]
            yield pa.record_batch(
                [*rest, pa.array(np.diff(ends).astype("i8")), pa.array(good), pa.array(total), batch.column("groups_sha256")],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
            )

    shape = f"doc_id {kind}, n_a LONG, n_b LONG, n_groups LONG, n_links LONG, n_best LONG, count_sum LONG, groups_sha256 STRING"
    some = np.flatnonzero(counts)
    table = pa.table({"a": keys[some] >> 32, "b": keys[some] & 0xFFFFFFFF, "count": counts[some], "best": best[some]})
    return found.mapInArrow(add_up, shape), spark.createDataFrame(table)
