"""Neighbour graph, token alignment and vector codes beside brute-force versions, and on odd rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from harbinger.llm import neighbour_graph, token_alignment, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"
CLASH = ("v", "node", "q", "s", "score", "rank", "a", "b", "code", "error", "part", "block", "links", "n_a", "key")


def vectors(spark, rows, extra=True):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("mine") for c in CLASH}) if extra else df


def clustered(n, dims=16, seed=3):
    """A third of the rows is one vector, a third lies close together, the rest is spread."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims)).astype("f4")
    x[: n // 3] = x[0]
    x[n // 3 : 2 * n // 3] = x[1] + 0.05 * x[n // 3 : 2 * n // 3]
    return [(i, [float(c) for c in v], i % 3 if i % 7 else None) for i, v in enumerate(x)]


ODD = [
    (1, None, 1), (2, [], 1), (3, [0.0] * 8, 2), (4, [None] + [1.0] * 7, 2), (5, [float("nan")] * 8, 3),
    (6, [float("inf")] * 8, 3), (50, [1.0] * 8, 1), (51, [2.0] * 8, None), (51, [2.0] * 8, None),
    (None, [1.0] * 8, 4), (100, [1.0, -1.0] * 4, 1), (150, [1.0, 2.0], 1), (151, [3e38, 1e-30], 1),
]


def exact_nearest(rows, k=5):
    """The ``k`` nearest by all cosines in double precision."""
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], "f8")
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        s = x @ x[i]
        s[i] = -2
        best = np.lexsort((ids, -np.round(s, 12)))[:k]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in best]
    return out


def search(df, **options):
    found = {}
    for r in neighbour_graph.nearest(df, F.expr("vec_id % 50 = 0"), **options).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(found[r["query_id"]])
    return found


def test_nearest_finds_all_among_few(spark):
    rows = clustered(700)
    got, want = search(vectors(spark, rows)), exact_nearest(rows)
    assert set(got) == set(want)
    for q in want:
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-12)
        assert q not in [v for v, _ in got[q]]
        if q < 700 // 3:  # copies: ties go to the smaller id
            assert [v for v, _ in got[q]] == [v for v in range(6) if v != q][:5]


def test_nearest_recall_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbour_graph, "BLOCK", 128)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 24)).astype("f4")
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]
    got, want = search(vectors(spark, rows, False), width=16, beam=96), exact_nearest(rows)
    hits = [len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 5 for q in want]
    assert np.mean(hits) >= 0.9


def test_nearest_odd_rows(spark):
    got = search(vectors(spark, ODD))
    # equal directions tie, whatever their length; only vectors of one length meet
    assert [v for v, _ in got[50]] == [51, 100] and got[50][0][1] == 1.0
    assert [v for v, _ in got[100]] == [50, 51] or [round(s, 12) for _, s in got[100]] == [0.0, 0.0]
    assert [v for v, _ in got[150]] == [151] and 0 < got[150][0][1] < 1
    assert set(got) == {50, 100, 150}
    assert search(vectors(spark, [])) == {}
    assert search(vectors(spark, [(50, [1.0, 2.0], 0)])) == {}


def plain_rounds(rows, parts=8, entries=16, rounds=6):
    """Every part against every entry, in Python integers."""
    rows = sorted(rows, key=lambda r: r[0])
    v = np.floor(np.array([r[1] for r in rows], "f8") * 4096).astype("i8").reshape(len(rows), parts, -1)
    books = v[:entries].transpose(1, 0, 2).copy()

    def near(p):
        gap = ((v[:, p, None, :] - books[p][None]) ** 2).sum(axis=2)
        return gap.argmin(axis=1), gap.min(axis=1)

    for _ in range(rounds):
        for p in range(parts):
            entry = near(p)[0]
            for e in set(entry.tolist()):
                mine = v[entry == e, p]
                books[p, e] = [int(s) // len(mine) for s in mine.sum(axis=0)]
    entry, gap = zip(*[near(p) for p in range(parts)])
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    codes = [bytes(c).hex() for c in np.stack(entry, 1).astype("u1")]
    return {r[0]: (c, int(g)) for r, c, g in zip(rows, codes, np.sum(gap, axis=0))}, digest


@pytest.mark.parametrize("n,dims", [(1, 8), (9, 16), (300, 16), (5000, 64)])
def test_codes_equal_plain_rounds(spark, n, dims):
    rows = clustered(n, dims) if n > 3 else [(7, [0.5] * dims, None)]
    got = vector_codes.compress(vectors(spark, rows)).collect()
    want, digest = plain_rounds(rows)
    assert {r["vec_id"]: (r["code"], r["error"]) for r in got} == want and len(got) == n
    assert {r["codebooks_sha256"] for r in got} == {digest}
    totals = Counter()
    for i, _, label in rows:
        totals[label] += want[i][1]
    labels = {r[0]: r[2] for r in rows}
    assert all(r["label_error"] == totals[labels[r["vec_id"]]] for r in got)


def test_codes_in_several_blocks(spark, monkeypatch):
    rows = clustered(900, 8)
    want, digest = plain_rounds(rows)
    ints = vector_codes.integers(vectors(spark, rows)).repartition(5)
    blocks = vector_codes.to_blocks(ints, 8, 8).cache()
    start = [r["v"] for r in ints.orderBy("vec_id").limit(16).collect()]
    books = np.array(start, "i8").reshape(16, 8, 1).transpose(1, 0, 2).copy()
    for _ in range(6):
        books = vector_codes.next_books(blocks, books)
    assert {r["vec_id"]: (r["code"], r["error"]) for r in vector_codes.assigned(blocks, books).collect()} == want


def test_trees_assign_whole_nodes():
    """Two far clusters: inner nodes are given away by their sums, no leaf is looked into."""
    points = np.concatenate([np.random.default_rng(0).integers(c, c + 50, (512, 1, 4)) for c in (0, 10_000)])
    tree = vector_codes.point_trees(points)
    books = np.array([[[0] * 4, [10_000] * 4]])
    steps = list(vector_codes.walk(tree, books, points))
    assert all(single is None for *_, single in steps)
    counts = Counter()
    for p, at, entry, _ in steps:
        for node, e in zip(at, entry):
            counts[int(e)] += int(tree["count"][p][node])
    assert counts == {0: 512, 1: 512} and sum(len(at) for _, at, *_ in steps) == 2


def test_codes_odd_rows(spark):
    got = vector_codes.compress(vectors(spark, ODD[:-1])).collect()
    by = Counter((r["vec_id"], r["code"] is None) for r in got)
    # broken vectors go; an empty vector and one of two components can't be cut in eight and have no code
    assert by == {(2, True): 1, (3, False): 1, (50, False): 1, (51, False): 2, (None, False): 1, (100, False): 1, (150, True): 1}
    one = {r["label_error"] for r in got if r["vec_id"] == 51}
    assert one == {0}
    assert vector_codes.compress(vectors(spark, [])).count() == 0
    assert vector_codes.compress(vectors(spark, [(1, None, 1)])).count() == 0
    with pytest.raises(ValueError):
        vector_codes.compress(vectors(spark, [(1, [2e4] * 8, 1)]))


TEXTS = [
    None, "", " ", "   two   blanks \n\n tabs\t", "Hello, world! don't", "naïve café 語 한국 🙂👩‍👩‍👧", "<|endoftext|> and <s> </s> <0x41>",
    "a▁b", "x" * 3000, "the same row", "the same row", "\x00\x01", " ".join(f"word{i}" for i in range(30_000)),
]


def plain_alignment(texts):
    """Groups by the set of common ends."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    alphabet, rows, counts = token_alignment.byte_of(), [], Counter()
    for text in texts:
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        bytes_a = [bytes(alphabet[c] for c in one.id_to_token(i)) for i in a]
        bytes_b = [
            bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b
        ]
        if not text or not b"".join(bytes_a) == (" " + text).encode() == b"".join(bytes_b):
            rows.append(([], [], []))
            continue
        ends = []
        for side in (bytes_a, bytes_b):
            at, found = 0, {}
            for n, t in enumerate(side):
                at += len(t)
                found[at] = n + 1
            ends.append(found)
        cuts = [(0, 0)] + [(ends[0][e], ends[1][e]) for e in sorted(set(ends[0]) & set(ends[1]))]
        parts = [(a[i:k], b[j:m]) for (i, j), (k, m) in zip(cuts, cuts[1:])]
        links = [(x[-1], y[-1]) for x, y in parts]
        counts.update(links)
        rows.append((a, b, parts))
    highest = Counter()
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    out = []
    for a, b, parts in rows:
        links = [(x[-1], y[-1]) for x, y in parts]
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in parts)
        out.append((len(a), len(b), len(parts), len(links), sum(counts[k] == highest[k[1]] for k in links),
                    sum(counts[k] for k in links), hashlib.sha256(said.encode()).hexdigest() if parts else ""))
    return out, [p for *_, p in rows], counts


def test_alignment_equals_common_ends(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    df = df.withColumns({c: F.lit("mine") for c in CLASH})
    rows, links = token_alignment.align(df)
    want, parts, counts = plain_alignment(TEXTS)
    got = {r[0]: tuple(r)[1:] for r in rows.collect()}
    assert [got[i] for i in range(len(TEXTS))] == want
    assert {(r["a"], r["b"]): r["count"] for r in links.collect()} == counts
    groups = {r["doc_id"]: [(g["a"], g["b"]) for g in r["groups"]] for r in token_alignment.groups(df).collect()}
    assert [groups[i] for i in range(len(TEXTS))] == parts
    ends = {r["doc_id"]: [g["end"] for g in r["groups"]] for r in token_alignment.groups(df).collect()}
    assert ends[4][-1] == len(TEXTS[4]) + 1 and ends[0] == [] and want[7][0] == 0


def test_alignment_of_nothing(spark):
    rows, links = token_alignment.align(spark.createDataFrame([], "doc_id long, text string"))
    assert rows.count() == 0 and links.count() == 0
    rows, _ = token_alignment.align(spark.createDataFrame([(None, "no id"), (1, None)], "doc_id long, text string"))
    assert {r["doc_id"]: r["n_groups"] > 0 for r in rows.collect()} == {None: True, 1: False}


def test_shared_cuts_by_halving():
    draw = random.Random(5)
    for _ in range(300):
        last = draw.randint(1, 400)
        a, b = (np.array(sorted({*draw.sample(range(1, last + 1), draw.randint(0, last)), last})) for _ in range(2))
        want = np.flatnonzero(np.isin(a, b))
        assert token_alignment.shared_cuts(a, b).tolist() == want.tolist()
