"""Edge cases and brute-force versions of the training-data operators."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from harbinger.llm import (
    compression,
    decontaminate,
    extraction,
    forest_join,
    language,
    licenses,
    mixing,
    pseudonyms,
    suffix_lm,
    toxicity,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
ODD = [None, "", "  \n\t ", "one", "a b c d", "a b c d", "!!! ???", "é ñ ß 語 한국", LONG, "x" * 50_000, "퟿\x00\x0b"]


def table(spark, texts, ids=None, extra=False):
    ids = list(range(len(texts))) if ids is None else ids
    df = spark.createDataFrame([(i, t, "en", f"s{n % 3}" if n % 4 else None, 0) for n, (i, t) in enumerate(zip(ids, texts))], SCHEMA)
    if extra:  # names that outputs and inner columns have as well
        for c in ("score", "kept", "class_id", "key", "set", "size", "n", "_result", "h", "word", "sentence_ids", "n_words"):
            df = df.withColumn(c, F.lit("mine"))
    return df


def odd(spark):
    rows = table(spark, [*ODD, "repeated row here", "no id"], [*range(len(ODD)), 77, None], True)
    return rows.unionByName(rows.where("doc_id = 77"))


def models(spark):
    docs = table(spark, ["the cat sat on the mat and the dog", "le chat est sur le tapis et le chien"] * 3)
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("fr"))
    return language.learn(docs)


OPERATORS = {
    "forest_join": lambda s, d: forest_join.join(d),
    "suffix_lm": lambda s, d: suffix_lm.score(d, suffix_lm.learn(d)),
    "licenses": lambda s, d: licenses.scan(d),
    "extraction": lambda s, d: extraction.extract(d, extraction.learn(d, "text"), "text"),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.Model(-5.0, {"one": 9.0})),
    "language": lambda s, d: language.identify(d, models(s)),
    "mixing": lambda s, d: mixing.mix(d),
    "pseudonyms": lambda s, d: pseudonyms.pseudonymise(d, "k"),
    "compression": lambda s, d: compression.judge(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_keep_their_number(spark, name):
    docs = odd(spark)
    out = OPERATORS[name](spark, docs).toPandas()
    assert len(out) == len(ODD) + 3
    again = [tuple(map(str, r)) for r in out[out["doc_id"] == 77].itertuples(index=False)]
    assert len(again) == 2 and (name == "mixing" or again[0] == again[1])


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, table(spark, ["x"]).where("false")).count() == 0


def test_decontamination_edges(spark):
    item = " ".join(f"q{i}" for i in range(30))
    edited = item.replace("q15", "other")
    docs = odd(spark).select("doc_id", "text").unionByName(
        table(spark, ["lead in " + item.upper() + "! out", edited, item.replace("q9", "z").replace("q20", "z"), item], [100, 101, 102, None]).select("doc_id", "text")
    )
    items = table(spark, [item, None, "", "a b c d"], [1, 2, 3, 4]).select(F.col("doc_id").alias("item_id"), "text", F.lit(1).alias("key"))
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find(docs, items).collect()}
    assert set(got) == {(100, 1), (None, 1), (4, 4), (5, 4)} | ({(101, 1)} if (101, 1) in got else set())
    assert got[100, 1].similarity == 1 and got[100, 1]["at"] == 2
    assert decontaminate.find(docs.where("false"), items).count() == 0
    assert decontaminate.find(docs, items.where("false")).count() == 0


def test_every_fingerprint_within_the_radius_shares_a_listed_block():
    rng = random.Random(1)
    for _ in range(2000):
        bits = rng.sample(range(64), decontaminate.RADIUS)
        counts = [sum(a <= b < a + w for b in bits) for a, w in decontaminate.block_edges()]
        assert min(counts) <= decontaminate.NEAR


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(forest_join, "PREFIX_BLOCK", 7)  # blocks must not change anything
    monkeypatch.setattr(forest_join, "BLOCK_ROWS", 5)
    rng = random.Random(4)
    texts = []
    for g in range(6):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(150)]
        for _ in range(25 if g == 0 else 6):
            t = list(base)
            for _ in range(rng.randrange(5)):
                t[rng.randrange(len(t))] = f"new{rng.random()}"
            texts.append(" ".join(t))
    texts += [texts[0], texts[0], "short", "short", "", None, "alone " * 3]
    got = {r.doc_id: r for r in forest_join.join(table(spark, texts)).collect()}
    sets = [shingles(t) for t in texts]
    near = {i: set() for i in range(len(texts))}
    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            near[a].add(b)
            near[b].add(a)
    for i in near:
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        assert (got[i].class_id, got[i].n_links) == (min(seen), len(near[i])), i


def brute_tree(texts, depth, least, nats, discount):
    """log10 of a word's probability after the words before it, by a suffix tree of dicts."""
    counts = Counter(tuple(t[i : i + k]) for t in texts for k in range(1, depth + 2) for i in range(len(t) - k + 1))
    total = sum(n for g, n in counts.items() if len(g) == 1)
    scale = total + sum(len(g) == 1 for g in counts) + 1
    frequent = {g: n for g, n in counts.items() if n >= least}
    rate = lambda g: (counts[g] + 1) / scale if len(g) == 1 else counts[g] / counts[g[:-1]]
    after = {}
    for g in frequent:
        if len(g) > 1:
            after.setdefault(g[:-1], []).append(g)
    kept = set()
    for c, grams in after.items():
        rare = counts[c] - sum(counts[g] for g in grams)
        other = max(counts[c] * (1 - sum(rate(g[1:]) for g in grams)), 1e-9)
        gain = sum(counts[g] * math.log(rate(g) / rate(g[1:])) for g in grams) + (rare * math.log(rare / other) if rare else 0)
        if gain >= nats:
            kept |= {c[i:] for i in range(len(c))}

    def p(context, word):
        if not context:
            return (counts[(word,)] + 1) / scale
        low = p(context[1:], word)
        if context not in kept:
            return low
        mass = sum(counts[g] - discount for g in after[context])
        return max(frequent.get((*context, word), 0) - discount, 0) / counts[context] + (1 - mass / counts[context]) * low

    return p, kept, counts


def lm_texts(seed, n):
    rng = random.Random(seed)
    return [" ".join(rng.choice(["a b c", "a b d", "x y", "b a", f"r{rng.randrange(40)}", "A  q"]) for _ in range(rng.randrange(50))) for _ in range(n)]


@pytest.mark.parametrize("held", [0, 12, 10**6])
@pytest.mark.parametrize("depth, nats", [(2, 1.0), (3, 4.0), (1, 0.0)])
def test_suffix_tree_by_brute_force(spark, held, depth, nats):
    texts = [*lm_texts(3, 60), None, "", "never seen words"]
    split = [[*(t or "").lower().split(), None] for t in texts]
    p, kept, _ = brute_tree(split[:50], depth, 2, nats, 0.75)
    assert any(len(c) == depth for c in kept)
    docs = table(spark, texts)
    tree = suffix_lm.learn(docs.where("doc_id < 50"), depth=depth, nats=nats)
    got = {r.doc_id: r.score for r in suffix_lm.score(docs, tree, held=held).collect()}
    for i, t in enumerate(split):
        want = sum(math.log10(p(tuple(t[max(0, j - depth) : j]), w)) for j, w in enumerate(t))
        assert math.isclose(got[i], want, rel_tol=1e-9, abs_tol=1e-9)


def test_suffix_states_are_distributions():
    split = [[*t.lower().split(), None] for t in lm_texts(5, 40)]
    p, kept, counts = brute_tree(split, 2, 2, 1.0, 0.75)
    for context in kept:
        unknown = p(context, "never seen")
        assert math.isclose(sum(p(context, g[0]) for g in counts if len(g) == 1) + unknown, 1.0, rel_tol=1e-9)


def test_tree_grows_with_the_text(spark):
    sizes = [suffix_lm.learn(table(spark, lm_texts(9, n))).values.count() for n in (40, 400)]
    assert sizes[1] > sizes[0]


def test_base_scores_by_brute_force(spark):
    texts = ["The cat  sat", "the dog", None, "", "rare words only", "the cat the cat"]
    docs = table(spark, texts)
    train = docs.where("doc_id <> 4")
    got = {r.doc_id: r for r in suffix_lm.score(docs, suffix_lm.learn(train)).collect()}
    words = lambda t: [*(t or "").lower().split(), None]
    c = Counter(w for i, t in enumerate(texts) if i != 4 for w in words(t))
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        assert math.isclose(got[i].base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t)))
        assert (got[i].n_tokens, got[i].n_known) == (len(words(t)), sum(c[w] > 0 for w in words(t)))


def test_licences(spark):
    assert all(re.search(licenses.CUE, s) for s in licenses.known_sentences())
    mit = "\n".join(v[0] + "." for k, v in licenses.SENTENCES.items() if k in ("mit-permission", "mit-notice"))
    wrapped = mit.replace(" free of charge, to", "\n   free of charge, to")
    rows = licenses.scan(table(spark, [wrapped, "Text.\nLicensed under CC BY-NC 4.0.", "A licence of our own.", "Licensed under CC BY 4.0"])).orderBy("doc_id").collect()
    assert [r.licenses for r in rows] == [["MIT"], ["CC-BY-NC-4.0"], [], ["CC-BY-4.0"]]
    assert [r.n_unknown for r in rows] == [0, 0, 1, 0]


def test_extraction():
    page = (
        "<html><body><header>Site</header><nav><a>Home</a></nav><div class='content'><h1>Head&nbsp;&amp; line</h1><p>One <b>two</b>three"
        "<p>four <script>no('</p>')</script>five<br>six</p><div class='ad'>Buy</div></div><div id='comments'><p>Nice one indeed</p></div>"
        "<form><label>Mail</label></form><footer>&copy; us</footer></body></html>"
    )
    assert extraction.main_text(page, extraction.Weights({}, {})) == "Head & line\nOne twothree\nfour five six"
    assert extraction.main_text("<p>a<!-- x", extraction.Weights({}, {})) == "a"


def test_toxicity_finds_documents_and_sentences(spark):
    rng = random.Random(2)
    clean = lambda: " ".join(rng.choice("river house green walk stone paper".split()) for _ in range(6)) + "."
    texts, labels = [], []
    for i in range(240):
        bad = i % 3 == 0
        s = [clean() for _ in range(8)]
        if bad:
            s[rng.randrange(8)] = "you are a " + rng.choice(["blarg", "snork"]) + "."
        texts.append(" ".join(s))
        labels.append((i, int(bad)))
    docs = table(spark, texts)
    marks = spark.createDataFrame([*labels, (None, 1), (5000, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs.where("doc_id < 160"), marks.where("doc_id < 160"))
    for r in toxicity.score(docs.where("doc_id >= 160"), model).collect():
        assert (r.score >= 0.7) == (r.doc_id % 3 == 0)
        assert all(re.search("blarg|snork", r.text[o.start : o.end]) for o in r.offending)
    unseen = toxicity.score(table(spark, ["you are a snorkle. river house.", "you are a walker. green blank."]), model)
    compound, other = [r.score for r in unseen.orderBy("doc_id").collect()]
    assert compound >= 0.7 and compound > other
    assert toxicity.learn(docs, marks.where("toxic = 1")).weights == {}


def test_phrases_by_brute_force():
    train, text = "abracadabra banana", "abrabanana cadabrax zz"
    model = language.learn_automaton(train, 64)
    seen = "".join(map(chr, language.symbols_of(train)))
    rest, n = "".join(map(chr, language.symbols_of(text))), 0
    while rest:
        k = next((k for k in range(len(rest), 0, -1) if rest[:k] in seen), 1)
        rest, n = rest[k:], n + 1
    assert round(language.parse([text], [model])[0, 0] * len(language.symbols_of(text))) == n
    lanes = language.parse(["ab cd " * 300], [model], lane=64, width=3)
    assert lanes.shape == (1, 1) and np.isfinite(lanes).all()


def test_languages(spark):
    got = {r.doc_id: r.lang_pred for r in language.identify(table(spark, ["the cat and the dog sat", "le chien et le chat", "12 !?", None]), models(spark)).collect()}
    assert got == {0: "en", 1: "fr", 2: "und", 3: "und"}
    # no letters: emoji, flags, combining marks alone; letters beyond the first plane are letters
    odd = ["\U0001f600 \U0001f468\u200d\U0001f469", "\U0001f1eb\U0001f1f7", "\u0301\u0302 12", "\U00010400\U00010401", "\U00020000"]
    found = [r.lang_pred for r in language.identify(table(spark, odd), models(spark)).orderBy("doc_id").collect()]
    assert found[:3] == ["und"] * 3 and "und" not in found[3:]


def test_mix_keeps_to_targets_and_runs_again(spark):
    rng = random.Random(5)
    docs = table(spark, ["w " * rng.randrange(40) for _ in range(300)])
    one = mixing.mix(docs, block=7).toPandas()
    assert (one.taken <= 2 * one["size"]).all()
    for _, g in one.groupby("source", dropna=False):
        assert g.taken.sum() == round(g.target.iloc[0]) <= 2 * g["size"].sum()
    two = mixing.mix(docs.repartition(5), block=7).toPandas()
    assert one.sort_values("doc_id").taken.tolist() == two.sort_values("doc_id").taken.tolist()
    plan = mixing.targets(one.pipe(spark.createDataFrame).groupBy("source").agg(F.sum("size").alias("source_size")))
    slots = mixing.schedule(plan, 7).orderBy("slot").toPandas()
    share = plan.toPandas().set_index("position").words / plan.toPandas().words.sum()
    half = slots.head(len(slots) // 2).position.value_counts(normalize=True)
    assert (half - share).abs().max() < 0.02  # every stretch of the mix is close to the weights


def test_feistel_is_a_permutation_and_formats_hold(spark):
    f = pseudonyms.Feistel(b"k")
    assert sorted(f.permute(i, 777, b"t") for i in range(777)) == list(range(777))
    text = "a.b.99@x.org 4111 1111 1111 1111 +1 (564) 555-4526 2024-02-29 31/12/1999 12/31/1999 10.20.30.40 123-45-6789 GB82 WEST 1234 5698 7654 32"
    a, b, c = (r.text for r in pseudonyms.pseudonymise(table(spark, [text, text + " end", "4111 1111 1111 1112 99/99/2000 300.1.1.1"]), "k").orderBy("doc_id").collect())
    shape = lambda s: re.sub("[0-9]", "9", re.sub("[A-Z]", "A", re.sub("[a-z]", "a", s)))
    assert a != text and b == a + " end" and c == "4111 1111 1111 1112 99/99/2000 300.1.1.1"
    parts = lambda s: s.replace(" ", "|")
    assert shape(re.sub(r"\d+\.\d+\.\d+\.\d+", "IP", parts(a))) == shape(re.sub(r"\d+\.\d+\.\d+\.\d+", "IP", parts(text)))
    number = re.search(r"\d{4} \d{4} \d{4} \d{4}", a)[0].replace(" ", "")
    assert pseudonyms.luhn_digit(number[:-1]) == number[-1]


def test_counts_by_brute_force():
    rng = random.Random(6)
    for _ in range(200):
        text = "".join(rng.choice(["a", "b", " ", "\n", "#", "é", " ", "\t"]) for _ in range(rng.randrange(80)))
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        t = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        cover = {j for i, x in enumerate(t) if t.count(x) > 1 for j in range(i, i + 3)}
        lines = text.split("\n")
        again = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
        assert compression.counts(text) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(cover))


def test_compression_bands(spark):
    rng = random.Random(7)
    prose = " ".join("".join(rng.choice("aeionrst") for _ in range(rng.randrange(2, 9))) for _ in range(400))
    noise = " ".join("".join(chr(rng.randrange(33, 126)) for _ in range(60)) for _ in range(60))
    loop = " ".join(f"{x} {y} the same again" for x, y in itertools.product("ab", range(3))) * 20
    got = [r.kept for r in compression.judge(table(spark, [prose, noise, loop, None])).orderBy("doc_id").collect()]
    assert got == [True, False, False, False]


def test_pipeline_stages(spark, tmp_path):
    item = " ".join(f"q{i}" for i in range(30))
    prose = [" ".join(f"d{i}w{j}" for j in range(60)) for i in range(6)]
    texts = [*prose, prose[0], prose[1] + " x", "before " + item + " after", "!!!", "write to me@x.org now please"]
    docs = table(spark, texts)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id for r in docs.collect()}
        docs = stage(spark, docs, str(tmp_path))
        gone = before - {r.doc_id for r in docs.collect()}
        assert gone == {"language": {9}, "near_duplicates": {6, 7}, "benchmark_leaks": {8}}.get(name, set()), name
        if name != "mix":
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "pseudonyms":
            assert "me@x.org" not in docs.where("doc_id = 10").first().text
    assert docs.agg(F.sum("taken")).first()[0] > 0


def test_shorter_and_later_readings_of_personal_data(spark):
    # Each part in braces has to go, what is around it has to stay.
    cases = [
        "{4111 1111 1111 1111} 12/26", "order 12 {4111 1111 1111 1111}", "{4111111111111111} 123", "{4111-1111-1111-1111} 9",
        "{AT61 1904 3002 3457 3201} EUR", "{AT611904300234573201} 2024", "{GB82 WEST 1234 5698 7654 32} IN FULL",
        "token={eyJhbGciOiJIUzI1NiJ9}.{eyJzdWIiOiIxMjM0NTY3ODkwIn0}.{dozjgNryP4J3jVmNHl0w5N}. Next",
        "call +33 1 {23 45 67 89}.", "call +49 170 {1234567}!", "call +41 79 {123 45 67}", "+1 {212 555 0142} 2024", "order 12 {212 555 0142}", "+1-({212})-{555-0142}",
        "token = tokenizer.decode(ids)", "4111 1111 1111 1112 12/26", "AT62 1904 3002 3457 3202 EUR",
    ]
    docs = table(spark, [re.sub("[{}]", "", c) for c in cases])
    for c, r in zip(cases, pseudonyms.pseudonymise(docs, "k").orderBy("doc_id").collect(), strict=True):
        stays = re.fullmatch("(.+)".join(re.escape(x) for x in re.split(r"\{.*?\}", c)), r.text)
        assert stays and r.n_replaced == ("{" in c), (c, r.text)
        for part in re.findall(r"\{(.*?)\}", c):
            assert part not in r.text, (c, r.text)
    alone, beside = (r.text for r in pseudonyms.pseudonymise(table(spark, ["4111 1111 1111 1111", "4111 1111 1111 1111 12/26"]), "k").orderBy("doc_id").collect())
    assert beside == alone + " 12/26"


def test_long_values_change_in_every_part():
    f, rng = pseudonyms.Feistel(b"k"), random.Random(8)
    for n in (60, 160, 256, 1000, 12_000):
        for chars, rule in (("0123456789abcdef", pseudonyms.secret), ("abcXYZ0189+/", pseudonyms.secret), ("abcdefgh.1", pseudonyms.email)):
            value = "a" + "".join(rng.choice(chars) for _ in range(n - 2)) + "a"
            whole, other = ("token=" + value, "token=" + value[:-1] + "b") if rule is pseudonyms.secret else (value + "@x.org", value[:-1] + "b@x.org")
            one, two = rule(whole, f), rule(other, f)
            assert len(one) == len(whole) and one == rule(whole, f)
            start = whole.index(value)
            for at in range(start, start + n - 14, 14):  # also where just the last character differs
                assert whole[at : at + 14] != one[at : at + 14] != two[at : at + 14], (n, at)


def test_languages_of_copies_are_learned(spark):
    rng = random.Random(9)
    tongue = lambda chars: " ".join("".join(rng.choice(chars) for _ in range(5)) for _ in range(60))
    names = {"aa": "abcde", "bb": "fghij", "cc": "klmno"}
    rows = [(n, tongue(c)) for n, c in names.items() for _ in range(2)]
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(20_000))))
    learned = language.learn(docs.drop("copy"))
    assert sorted(learned) == sorted(names)
    asked = table(spark, [tongue(c) for c in names.values()])
    assert [r.lang_pred for r in language.identify(asked, learned).orderBy("doc_id").collect()] == sorted(names)


def test_many_labels_keep_their_whole_stretches(spark):
    rng = random.Random(10)
    docs = [(f"l{k:02d}", " ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(200))[:300]) for k in range(40) for _ in range(20)]
    learned = language.learn(spark.createDataFrame(docs, "lang string, text string"))
    whole = {k: language.parse([t for n, t in docs if n == k], [learned[k]]).ravel() for k in ("l00", "l39")}
    for k, rate in whole.items():  # a learned text is one phrase
        assert (rate * 300 < 2.5).all(), (k, rate)
    assert max(len(m.owner) for m in learned.values()) < 4 * 20 * 301


def test_items_shorter_than_a_shingle(spark):
    rng = random.Random(11)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (1, 2, 3, 4, 5, 6, 9, 14, 20, 30)] + ["前文。日本の首都は、どこ?後文 と 続く 文"]
    asked = ["a", "c b", "e f g", "h a b", "a b c d", texts[7][4:11], "日本の首都は、どこ?", "zz", "g"]
    split = lambda t: re.findall(r"\w+", t)
    want = {}
    for i, d in enumerate(map(split, texts)):
        for j, q in enumerate(map(split, asked)):
            places = [p for p in range(len(d) - len(q) + 1) if d[p : p + len(q)] == q]
            if places:
                want[i, j] = (1.0, places[0], len(q))
    items = spark.createDataFrame(list(enumerate(asked)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r["at"], r.n_words) for r in decontaminate.find(table(spark, texts), items).collect()}
    assert got == want and {n for *_, n in want.values()} >= {1, 2, 4}
