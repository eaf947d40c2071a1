import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import _kernel as K
from strandline.llm import decontaminate, kneser_ney, licences, mixing, ngram_join, packing, sharding, suffix_dedup, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "der the of and réeux vequ stone river cloud paper window garden music seven mountain horse glass winter".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def docs(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in zip(ids, texts)], DOCS)


def corpus(seed=1, n=40):
    rng = random.Random(seed)
    base = [prose(rng, rng.choice([3, 30, 120])) for _ in range(n)]
    near = []
    for t in base[:15]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    shared = prose(rng, 60)
    return base + near + base[:5] + base[:5] + [f"{prose(rng, 20)} {shared} {prose(rng, 20)}" for _ in range(6)] + [None, "", " \n\t ", "one", "one two", "One  TWO", "x" * 50_000, "a b " * 9000]


ODD = [None, "", "   ", "same words here", "same words here", "same words here", "long " * 30_000]


# ---- kernel

def test_words_and_shingles_against_regular_expressions():
    texts = ["Ab  c\x0bd", "", None, "é  ñ x", "  lead", "trail \n", "one"]
    for gaps, pattern in ((K.SPACES, rb"[^\x20\x09-\x0D]+"), (K.PUNCT, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        for lo, hi, data, offs in K.slices(pa.array(texts), 4):
            low = K.LOWER[data]
            s, e, r = K.words(low, offs, gaps)
            got = [[low[a:b].tobytes() for a, b, x in zip(s, e, r) if x == i] for i in range(hi - lo)]
            assert got == [re.findall(pattern, "".join(c.lower() if c.isascii() else c for c in t or "").encode()) for t in texts[lo:hi]]
    data, offs = K.raw_text(pa.array(["a b c d", "a b", "", "a b c d a b c"]))
    _, h, edge = K.shingle_sets(data, offs, 3)
    assert np.diff(edge).tolist() == [2, 1, 0, 4]
    sliced = pa.array(["skip", "a b c d", "zz"]).slice(1, 1)
    d2, o2 = K.raw_text(sliced)
    first = next(K.slices(sliced))
    assert K.shingle_sets(first[2], first[3], 3)[1].tolist() == h[:2].tolist()


# ---- 1

def brute_components(texts, k, percent):
    sets = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "").encode())
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    comp = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                old, new = max(comp[a], comp[b]), min(comp[a], comp[b])
                comp = [new if c == old else c for c in comp]
    return [len(s) for s in sets], comp


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_jaccard_classes_against_all_pairs(spark, k, percent):
    texts = corpus()
    rng = random.Random(9)
    core = prose(rng, 60).split()
    for _ in range(40):  # a chain-like group of near copies
        w = list(core)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(1000)}"
        texts.append(" ".join(w))
    sizes, comp = brute_components(texts, k, percent)
    got = {r.doc_id: r for r in ngram_join.jaccard_classes(docs(spark, texts), k, percent).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == comp


@pytest.mark.parametrize("percent", [40, 50])
def test_short_texts_at_low_thresholds_lose_no_link(spark, percent):
    """A level may not ask for more shared tokens than a qualifying pair has."""
    rng = random.Random(percent)
    texts = ["a", "a b", *(" ".join(rng.sample("abcdefghijklmnopqrstuvwxyz", rng.randrange(1, 13))) for _ in range(60))]
    _, comp = brute_components(texts, 1, percent)
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_classes(docs(spark, texts), 1, percent).collect()}
    assert [got[i] for i in range(len(texts))] == comp
    two = ngram_join.jaccard_classes(docs(spark, ["a", "a b"]), 1, 50).collect()
    assert {r.component_id for r in two} == {0}


@pytest.mark.parametrize("k,percent", [(3, 90), (1, 50)])
def test_jaccard_links_are_all_there_and_counted(spark, k, percent):
    """Every link between different sets, those within one component too, and the links of each row with its copies."""
    rng = random.Random(12)
    core = prose(rng, 60).split()
    texts = [" ".join(core)] * 3
    for _ in range(40):
        w = list(core)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(1000)}"
        texts.append(" ".join(w))
    texts += [" ".join(rng.sample("abcdefghijkl", rng.randrange(1, 9))) for _ in range(30)] + [None, "", " "]
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    near = lambda a, b: a & b and 100 * len(a & b) >= percent * len(a | b)
    rows, links = ngram_join.jaccard_links(docs(spark, texts), k, percent)
    got = {r.doc_id: r for r in rows.collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == list(map(len, sets))
    assert [got[i].n_links for i in range(len(texts))] == [sum(bool(near(a, b)) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]
    of = {s: min(i for i, x in enumerate(sets) if x == s) for s in sets if s}
    assert all(got[i].class_id.d == of[s] if s else got[i].class_id is None for i, s in enumerate(sets))
    found = sorted((r.a.d, r.b.d) for r in links.collect())
    assert found == sorted((min(i, j), max(i, j)) for s, i in of.items() for t, j in of.items() if i < j and near(s, t))


def test_jaccard_odd_rows(spark):
    d = docs(spark, [*ODD, "same words here", "other text"], [0, 1, 2, 3, 4, 5, 6, None, 3]).withColumnRenamed("n_chars", "component_id")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_classes(d, 3, 90).collect()), key=str)
    assert (None, 1, None) in got and (0, 0, 0) in got and (4, 1, 3) in got and (5, 1, 3) in got and len(got) == 9
    assert ngram_join.jaccard_classes(d.where("false"), 3, 90).count() == 0
    assert sorted(r.doc_id for r in ngram_join.one_of_each(docs(spark, ODD)).collect()) == [0, 1, 2, 3, 6]


# ---- 2

def test_kneser_ney_against_a_plain_model(spark):
    rng = random.Random(4)
    texts = [prose(rng, 12) for _ in range(12)]
    d = docs(spark, texts)
    counts = collections.Counter()
    for t in texts[:8]:
        raw = np.frombuffer(t.encode(), np.uint8)
        counts.update(kneser_ney.grams(raw, np.array([0, len(raw)]))[1].tolist())
    order = {4: counts}
    for n in (3, 2, 1):
        order[n] = collections.Counter(k & ((1 << 6 * n) - 1) for k in order[n + 1])

    def discounts(c):
        n = collections.Counter(c.values())
        if not n[1] or not n[2]:
            return 0.5, 0.75, 0.9
        y = n[1] / (n[1] + 2 * n[2])
        low = (1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 1.5)
        return tuple(min(max(x, 0.05), i + 0.95) for i, x in enumerate(low))

    by_ctx = {n: collections.defaultdict(list) for n in order}
    cuts = {n: discounts(order[n]) for n in order}
    for n in order:
        for k, c in order[n].items():
            by_ctx[n][k >> 6].append(c)

    def p(key, n):
        if n == 0:
            return 1 / 64
        lower = p(key & ((1 << 6 * (n - 1)) - 1), n - 1)
        seen = by_ctx[n].get(key >> 6)
        if not seen:
            return lower
        cut = lambda c: cuts[n][min(c, 3) - 1]
        c = order[n].get(key, 0)
        return ((c - cut(c) if c else 0) + sum(map(cut, seen)) * lower) / sum(seen)

    labels = spark.createDataFrame([(i, int(i < 8)) for i in range(12)], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in kneser_ney.classify(d, labels).collect()}
    for i, t in enumerate(texts):
        raw = np.frombuffer(t.encode(), np.uint8)
        keys = kneser_ney.grams(raw, np.array([0, len(raw)]))[1].tolist()
        want = np.exp(-np.mean([np.log(p(k, 4)) for k in keys]))
        assert got[i].perplexity == pytest.approx(want, rel=1e-6) and got[i].n_symbols == len(raw)


def test_kneser_ney_over_bytes_tells_scripts_and_capitals_apart(spark):
    """The query's model: every byte a symbol of its own. Texts that 64 classes could not tell apart score differently, and as a plain model says."""
    texts = ["привет мир и снова привет", "Tag und Nacht im Jahr", "0.75 и 1984", "Tag und Nacht"] * 3 + ["аривет лир и онова чривет", "TaG UND NACHT im JAhR", "日本語の文", "привет"]
    raws = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    byte, one = kneser_ney.BYTES, np.array([0, 1])
    assert sorted(byte.of.tolist()) == list(range(256)) and len({kneser_ney.grams(np.array([b], np.uint8), one, byte)[1][0] for b in range(256)}) == 256
    keys = [kneser_ney.grams(r, np.array([0, len(r)]), byte)[1].tolist() for r in raws]
    order = {4: collections.Counter(k for ks in keys[:12] for k in ks)}
    for n in (3, 2, 1):
        order[n] = collections.Counter(k & ((1 << 8 * n) - 1) for k in order[n + 1])
    cuts = {}
    for n, c in order.items():
        m = collections.Counter(c.values())
        y = m[1] / (m[1] + 2 * m[2]) if m[1] else 0
        low = (1 - 2 * y * m[2] / m[1], 2 - 3 * y * m[3] / m[2], 3 - 4 * y * m[4] / m[3] if m[3] else 1.5) if m[1] and m[2] else None
        cuts[n] = tuple(min(max(x, 0.05), i + 0.95) for i, x in enumerate(low)) if low else (0.5, 0.75, 0.9)

    def p(key, n):
        if n == 0:
            return 1 / 256
        lower, cut = p(key & ((1 << 8 * (n - 1)) - 1), n - 1), lambda c: cuts[n][min(c, 3) - 1]
        seen = [c for k, c in order[n].items() if k >> 8 == key >> 8]
        c = order[n].get(key, 0)
        return ((c - cut(c) if c else 0) + sum(map(cut, seen)) * lower) / sum(seen) if seen else lower

    labels = spark.createDataFrame([(i, int(i < 12)) for i in range(len(texts))], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in kneser_ney.classify(docs(spark, texts), labels, symbols=byte).collect()}
    for i, ks in enumerate(keys):
        assert got[i].n_symbols == len(raws[i]) and got[i].perplexity == pytest.approx(np.exp(-np.mean([np.log(p(k, 4)) for k in ks])), rel=1e-6)
    assert got[13].perplexity > 2 * got[1].perplexity and got[12].perplexity > 2 * got[0].perplexity


def test_kneser_ney_keeps_clean_text_and_odd_rows(spark):
    rng = random.Random(2)
    texts = [prose(rng, 60) for _ in range(60)] + ["!!%% ZZQ " * 40, None, "", "e" * 70_000, "the same", "the same"]
    d = docs(spark, texts, list(range(63)) + [None, 64, 64]).withColumnRenamed("n_chars", "keep")
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id bigint, quality int")
    rows = kneser_ney.classify(d, labels).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts) and not got[60].keep and got[61].perplexity is None and not got[62].keep
    assert sum(got[i].keep for i in range(60)) >= 55
    assert not any(r.keep for r in kneser_ney.classify(d, labels.where("false")).collect())
    assert kneser_ney.classify(d.where("false"), labels).count() == 0


def test_kneser_ney_postings_give_every_gram_of_every_text_back():
    rng = random.Random(5)
    texts = ["", "é", *(prose(rng, n) for n in (1, 40, 200)), "", "a" * 40_000, "ab" * 300, "\U0001f600 ABC"]
    raws = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    offs = np.cumsum([0, *map(len, raws)])
    for symbols in (kneser_ney.CLASSES, kneser_ney.BYTES):
        want, got = collections.Counter(), collections.Counter()
        for i, raw in enumerate(raws):
            want.update((i, k) for k in kneser_ney.grams(raw, np.array([0, len(raw)]), symbols)[1].tolist())
        for shard, *streams in kneser_ney.postings(np.concatenate(raws), offs, symbols):
            keys, at, rows, counts = kneser_ney.unposted(*streams)
            assert len(set(keys.tolist())) == len(keys) and {k >> 3 * symbols.bits & 3 for k in keys.tolist()} == {shard}
            got.update(dict(zip(zip(rows.tolist(), keys[at].tolist()), counts.tolist())))
        assert got == want


def test_kneser_ney_shuffles_less_than_the_texts(spark):
    """Texts used to send each of their n-grams by themselves."""
    rng = random.Random(6)
    d = docs(spark, [" ".join("".join(rng.choice(["th", "er", "on", "in", "a", "ble", "s", "e"]) for _ in range(rng.randrange(1, 5))) for _ in range(400)) for _ in range(1500)])
    size = d.selectExpr("sum(octet_length(text))").first()[0]
    written = lambda: sum(e.totalShuffleWrite() for e in map(seen.apply, range(seen.size())))
    seen = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    before = written()
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id bigint, quality int")
    assert kneser_ney.classify(d, labels, symbols=kneser_ney.BYTES).count() == 1500
    seen = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    assert written() - before < 0.6 * size, ((written() - before) / size)


def test_varints():
    x = np.array([0, 127, 128, 16383, 16384, 2**21, 2**24 - 1, 5])
    assert kneser_ney.unvarints(kneser_ney.varints(x)[0])[0].tolist() == x.tolist()


def test_varints_of_five_bytes():
    x = np.array([2**28 - 1, 2**28, 2**32 - 1, 0, 7])
    assert kneser_ney.unvarints(kneser_ney.varints(x)[0])[0].tolist() == x.tolist()


# ---- 3

def test_raking_meets_its_marginals(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.choice([5, 50])), rng.choice(["en", "de", None]), f"s{rng.randrange(4)}", 0) for i in range(400)]
    d = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    from strandline.llm._spark import Scratch

    cells = mixing.levels(d).groupBy("m_source", "m_lang", "m_topic").agg(F.sum("m_tokens").alias("w"))
    fitted = mixing.rake(cells, mixing.TEMPERS, 30, Scratch(spark))
    for dim, power in mixing.TEMPERS.items():
        got = fitted.groupBy(f"m_{dim}").agg(F.sum("fit").alias("fit"), F.sum("w").alias("w")).collect()
        total, norm = sum(r.w for r in got), sum(r.w**power for r in got)
        assert all(r.fit == pytest.approx(total * r.w**power / norm, rel=1e-3) for r in got)


def test_the_sample_itself_meets_the_marginals(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    source = lambda: "hot" if rng.random() < 0.8 else f"s{rng.randrange(3)}"
    d = spark.createDataFrame([(i, prose(rng, rng.choice([20, 40])), rng.choice(["en", "en", "en", "de"]), source(), 0) for i in range(20_000)], DOCS)
    w = {r[0]: r[1] for r in mixing.levels(d).groupBy("m_source").agg(F.sum("m_tokens")).collect()}

    def shares(out):
        got = {r[0]: r[1] for r in out.groupBy("m_source").agg(F.sum("m_tokens")).collect()}
        return {k: v / sum(got.values()) for k, v in got.items()}

    norm = sum(v**0.5 for v in w.values())
    assert shares(mixing.mix(d, exact=True)) == pytest.approx({k: v**0.5 / norm for k, v in w.items()}, abs=0.025)
    assert mixing.mix(d, exact=True).where("importance > 1").count() == 0
    want = {"hot": 0.1, "s0": 0.3, "s1": 0.6}
    table = spark.createDataFrame([("source", k, v) for k, v in want.items()], "dim string, level string, share double")
    assert shares(mixing.mix(d, targets=table, exact=True)) == pytest.approx(want, abs=0.04)
    with pytest.raises(ValueError, match="s9"):
        mixing.mix(d, targets=spark.createDataFrame([("source", "s9", 0.5), ("source", "hot", 0.5)], "dim string, level string, share double"))


def test_a_rare_source_costs_the_sample_nothing_but_itself(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.choice([20, 40])), rng.choice(["en", "en", "de"]), f"s{min(rng.randrange(12), 5)}", 0) for i in range(4000)]
    tokens = lambda out: out.agg({"m_tokens": "sum"}).first()[0]
    plain = tokens(mixing.mix(spark.createDataFrame(rows, DOCS), exact=True))
    odd = [(4000, rows[0][1], "en", "its own", 0), (4001, "", "la", "s1", 0)]
    with_odd = mixing.mix(spark.createDataFrame(rows + odd, DOCS), exact=True)
    assert tokens(with_odd) == pytest.approx(plain, rel=0.01)
    assert plain == pytest.approx(0.5 * tokens(mixing.levels(spark.createDataFrame(rows, DOCS))), rel=0.06)
    assert with_odd.where("m_source = 'its own'").select("probability").first()[0] == pytest.approx(1, abs=1e-6)


@pytest.mark.parametrize("in_one", [10_000, 3])
def test_bounded_raking_keeps_cells_within_their_weight(spark, in_one):
    from pyspark.sql import functions as F

    from strandline.llm._spark import Scratch

    rng = random.Random(8)
    weights = {(s, l, t): rng.choice([1, 30, 400]) for s in ("a", "b", "c", "rare") for l in ("en", "de") for t in ("prose", "table")}
    weights.update({("rare", "en", "prose"): 2, ("rare", "de", "prose"): 1, ("rare", "en", "table"): 1, ("rare", "de", "table"): 1})
    weights.update({(s, l, t): weights[s, l, t] + 100 for s, l, t in weights if s != "rare"})
    cells = spark.createDataFrame([(*k, w) for k, w in weights.items()], "m_source string, m_lang string, m_topic string, w long")
    grand = sum(weights.values())
    fitted = mixing.rake(cells, mixing.TEMPERS, 40, Scratch(spark), in_one=in_one, rate=0.5)
    got = fitted.collect()
    assert all(0 <= r.fit <= r.w * (1 + 1e-9) for r in got) and sum(r.fit for r in got) == pytest.approx(grand / 2, rel=1e-3)
    rare = [r for r in got if r.m_source == "rare"]
    assert all(r.fit == pytest.approx(r.w, rel=1e-2) for r in rare)  # its share of the target is above all that it has
    share = {d: {r[0]: r[1] for r in fitted.groupBy(f"m_{d}").agg(F.sum("fit")).collect()} for d in ("source", "lang", "topic")}
    for d, i in (("lang", 1), ("topic", 2)):
        p = {k: sum(w for key, w in weights.items() if key[i] == k) ** mixing.TEMPERS[d] for k in share[d]}
        assert share[d] == pytest.approx({k: grand / 2 * v / sum(p.values()) for k, v in p.items()}, rel=5e-3)


def test_mixing_odd_rows(spark):
    d = docs(spark, ODD + ["x"], [0, 1, None, 3, 3, 5, 6, 7])
    out = mixing.mix(d, rate=1e9).collect()
    assert len(out) == 8 and all(r.probability == 1 for r in out)
    assert mixing.mix(d, rate=0.0).count() == 0 and mixing.mix(d.where("false")).count() == 0
    a, b = (sorted(str(r.doc_id) for r in mixing.mix(x).collect()) for x in (d, d.repartition(3)))
    assert a == b


# ---- 5

def brute_removed(texts, span):
    seen = collections.Counter(b[p : p + span] for b in texts for p in range(len(b) - span + 1))
    out = []
    for b in texts:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - span + 1):
            if seen[b[p : p + span]] > 1:
                gone[p : p + span] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [2, 2000])
def test_repeated_bytes_against_all_windows(spark, hot):
    texts = [t for t in corpus(3) if t is None or len(t) < 20_000] + ["z" * 900, "ab" * 500, "é" * 300]
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.repeated_bytes(docs(spark, texts), span=100, hot=hot).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removed([(t or "").encode() for t in texts], 100)


def test_repeated_bytes_odd_rows(spark):
    long = "".join(random.Random(1).choice("abcdefgh ") for _ in range(600))
    d = docs(spark, [None, "", "short", long, long, long + "x"], [0, None, 2, 3, 3, None]).withColumnRenamed("n_chars", "fp")
    rows = suffix_dedup.repeated_bytes(d).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans) for r in rows) == [("0", 0, 0, 0), ("2", 5, 0, 0), ("3", 600, 600, 1), ("3", 600, 600, 1), ("None", 0, 0, 0), ("None", 601, 600, 1)]
    assert suffix_dedup.repeated_bytes(d.where("false")).count() == 0


def test_two_stage_sort_is_a_suffix_array():
    rng = np.random.default_rng(7)
    for letters in (1, 2, 3, 26):
        for n in (1, 2, 50, 400):
            x = rng.integers(97, 97 + letters, n).astype(np.uint8)
            for span in (8, 24, 100):
                sa, equal = suffix_dedup.two_stage(x, span)
                raw = x.tobytes()
                cut = [raw[i : i + span] for i in sa]
                assert sorted(sa.tolist()) == list(range(n)) and all(a <= b for a, b in zip(cut, cut[1:]))


# ---- 6

def test_toxicity_learns_gapped_insults(spark):
    rng = random.Random(6)
    texts, toxic = [], []
    for i in range(400):
        w = prose(rng, 40).split()
        if i % 4 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "moron", "worthless"]))
        texts.append(" ".join(w))
        toxic.append(int(i % 4 == 0))
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id bigint, toxic int")
    d = docs(spark, texts)
    model = toxicity.fit(d, labels)
    p = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}
    assert np.mean([(p[i] >= 0.5) == bool(t) for i, t in enumerate(toxic)]) > 0.97
    hidden = docs(spark, ["stone river id-iot wor.thless cloud", "i d i o t and m.o.r.o.n", "stone river cloud paper", None, "", "river " * 20_000], [1, 2, 3, 4, None, 6])
    s = {r.doc_id: r.score for r in toxicity.score(hidden, model).collect()}
    assert s[1] > 0.5 and s[2] > 0.5 and s[3] < 0.5 and s[4] < 0.5 and s[None] == s[4] and s[6] < 0.5
    kept = toxicity.keep_clean(hidden.withColumnRenamed("n_chars", "score"), model)
    assert kept.columns == ["doc_id", "text", "lang", "source", "score"] and {r.doc_id for r in kept.collect()} == {3, 4, None, 6}
    assert toxicity.score(d.where("false"), model).count() == 0
    none = toxicity.fit(d, labels.where("toxic = 0"))
    assert max(r.score for r in toxicity.score(d, none).collect()) < 0.5


def test_every_insult_family_counts(spark):
    rng = random.Random(12)
    letters = ["bcdfghklmnprst", "vwxzqjkbdgt", "бгджзклмнпрст", "βγδζθκλμπστ"]
    vowels = ["aeiou", "aeiou", "аеиоу", "αειου"]
    insults = ["".join(rng.choice(letters[i % 4]) + rng.choice(vowels[i % 4]) for _ in range(4)) for i in range(40)]
    texts, toxic = [], []
    for i in range(1600):
        w = prose(rng, 30).split()
        if i % 4 == 0:
            for k in range(3):
                w.insert(rng.randrange(len(w)), insults[(i // 4 + 13 * k) % 40])
        texts.append(" ".join(w))
        toxic.append(int(i % 4 == 0))
    model = toxicity.fit(docs(spark, texts), spark.createDataFrame(list(enumerate(toxic)), "doc_id bigint, toxic int"))
    plain = prose(rng, 30)
    s = {r.doc_id: r.score for r in toxicity.score(docs(spark, [f"{plain} {x} {plain} {x} end" for x in insults] + [plain]), model).collect()}
    # a family that many clean words resemble has a lower margin, but a positive one
    assert model.toxic == 40 and (model.margins(toxicity.as_codes([x.encode() for x in insults])) > 1).all()
    assert sum(s[i] > 0.5 for i in range(40)) >= 34 and s[40] < 0.5


def test_spelled_out_runs_are_read_to_their_end():
    text = " ".join("youareacompletewasteofspaceyouidiot") + " or " + " ".join("дурак")
    raw = np.frombuffer(text.encode(), np.uint8)
    data, _, s, n, _ = toxicity.units(raw, np.array([0, len(raw)]))
    got = {data[x : x + y].tobytes().decode("utf-8", "replace") for x, y in zip(s.tolist(), n.tolist())}
    assert any("idiot" in x for x in got) and any("i d i o t" in x for x in got) and "дурак" in got


def test_insults_late_in_spelled_out_runs_count(spark):
    rng = random.Random(6)
    texts = [prose(rng, 40) for _ in range(400)]
    toxic = [int(i % 4 == 0) for i in range(400)]
    for i in range(0, 400, 4):
        w = texts[i].split()
        for _ in range(3):
            w.insert(rng.randrange(len(w)), rng.choice(["idiot", "moron", "worthless"]))
        texts[i] = " ".join(w)
    model = toxicity.fit(docs(spark, texts), spark.createDataFrame(list(enumerate(toxic)), "doc_id bigint, toxic int"))
    runs = ["youareacompletewasteofspaceyouidiot", "thisisaverylonglinethatendswithyoumoron", "theriverflowsbyanoldstonemillintothesea"]
    s = {r.doc_id: r.score for r in toxicity.score(docs(spark, [" ".join(x) for x in runs]), model).collect()}
    assert s[0] > 0.5 and s[1] > 0.5 and s[2] < 0.5


def test_string_kernel_against_enumeration():
    from itertools import combinations

    def plain(s, t):
        total = 0.0
        for a in combinations(range(len(s)), toxicity.P):
            for b in combinations(range(len(t)), toxicity.P):
                if [s[i] for i in a] == [t[j] for j in b]:
                    total += toxicity.DECAY ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
        return total

    pairs = [(b"idiot", b"id.iot"), (b"abcabc", b"abc"), (b"xyz", b"abc"), (b"aaaa", b"aaa")]
    got = toxicity._raw_kernel(toxicity.as_codes([a for a, _ in pairs]), toxicity.as_codes([b for _, b in pairs]))
    assert got == pytest.approx([plain(a, b) for a, b in pairs], rel=1e-4)


# ---- 7

def test_licences(spark):
    texts = [
        "Intro words. Licensed under CC BY-NC 4.0. All rights reserved.", "the GNU General, Public! License", "cc\nby cc by", "Licensed under the Apache License, Version 2.0", None, "", "of the and to " * 5000,
        'Permission is hereby granted, free of charge, to any person who obtains a copy: obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    ]
    got = {r.doc_id: r for r in licences.scan_licences(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower().encode())
        places = [(p, label) for phrase, label in licences.PHRASES for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.encode().split()]
        assert (got[i].n_words, got[i].n_base) == (len(w), len(places))
        assert (got[i].first_word, got[i].last_word) == ((min(p for p, _ in places), max(p for p, _ in places)) if places else (None, None))
        assert got[i].base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, got[i].base_labels.split(","))) <= set(filter(None, got[i].labels.split(","))) and 0 <= got[i].score <= 1
    assert "cc-by-nc" in got[0].labels and got[3].labels == "apache-2.0" and got[3].score == 1 and got[6].labels == "" and "mit" in got[7].labels
    assert licences.scan_licences(docs(spark, texts).where("false")).count() == 0


def test_automaton_gives_longest_matches():
    rng = random.Random(8)
    seqs = [[rng.randrange(3) for _ in range(rng.randrange(1, 25))] for _ in range(4)]
    auto = licences.Automaton(seqs)
    subs = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for _ in range(50):
        t = [rng.randrange(4) for _ in range(30)]
        stat = [max((n for n in range(1, i + 2) if tuple(t[i - n + 1 : i + 1]) in subs), default=0) for i in range(30)]
        want = [(i, n) for i, n in enumerate(stat) if n and (i == 29 or stat[i + 1] <= n)]
        found = auto.matches(t)
        assert [(e, n) for e, n, _ in found] == want
        for e, n, v in found:
            assert auto.ends[v] == sorted((k, p) for k, s in enumerate(seqs) for p in range(n - 1, len(s)) if s[p - n + 1 : p + 1] == t[e - n + 1 : e + 1])


# ---- 8

def test_decontamination(spark):
    q = "If Alice walks 12 km in 3 hours and then rests, how far from the old mill does Alice stand when the bell rings twice"
    bench = spark.createDataFrame([(1, q), (2, None), (3, "short one"), (4, "the river of stone and paper runs under seven windows toward the winter garden gate")], "item_id bigint, text string")
    texts = [
        f"Some prose before. {q} And after.", q.replace("Alice", "Bob").replace("12", "40").replace("3 hours", "8 hours"), "If Alice walks home she rests", None, "",
        "word " * 20_000, "if 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16", q, q,
    ]
    d = docs(spark, texts, [10, 11, 12, 13, 14, 15, 16, 17, 17]).withColumnRenamed("n_chars", "item")
    got = {(r.doc_id, r.item_id): r.renamed for r in decontaminate.leaks(d, bench).collect()}
    assert got == {(10, 1): False, (11, 1): True, (17, 1): False}
    twice = "the farmer called Dora carries old wood to the mill and then Dora walks slowly home across the frozen river to sleep"
    own = spark.createDataFrame([(1, twice)], "item_id bigint, text string")
    renamed = [twice, twice.replace("Dora", "Emma"), twice.replace("then Dora", "then Emma")]
    n = {r.doc_id: r.n_windows for r in decontaminate.leaks(docs(spark, renamed), own).collect()}
    assert n[0] == n[1] > n.get(2, 0)  # two names for one slot: the windows of one of them do not count
    assert sorted(r.doc_id for r in decontaminate.remove_leaks(d, bench).collect()) == [12, 13, 14, 15, 16]
    assert decontaminate.leaks(d, bench.where("false")).count() == 0 and decontaminate.leaks(d.where("false"), bench).count() == 0


def test_decontamination_without_regard_to_case_and_sentence_opening(spark):
    # names in and at the start of sentences, and capitals beyond ASCII
    q = "Anna has 12 apples and a basket made of straw. Anna gives 3 of them to the old miller Édouard from Łódź. Anna then asks how many apples are left in the basket"
    bench = spark.createDataFrame([(1, q)], "item_id bigint, text string")
    other = "Olga has seen rivers and a bridge made of stone. Olga walks over it to the old town. Olga then asks who built the bridge"
    texts = [q.upper(), q.lower(), q.replace("Anna", "Maria"), q.replace("Anna", "Maria").replace("12", "40"), other, other.upper()]
    got = {r.doc_id: r.renamed for r in decontaminate.leaks(docs(spark, texts), bench).collect()}
    assert got == {0: False, 1: False, 2: True, 3: True}
    shouted = spark.createDataFrame([(1, q.upper())], "item_id bigint, text string")
    assert {r.doc_id for r in decontaminate.leaks(docs(spark, texts), shouted).collect()} >= {0, 1}


def test_fold():
    text = "Aé ÉÑ Łódź ΩΣ Ж Ṽ ẞ 東 😀 İ"
    low = decontaminate.fold(np.frombuffer(text.encode(), np.uint8)).tobytes().decode()
    assert low == "".join(c.lower() if len(c.lower().encode()) == len(c.encode()) else c for c in text)


def test_template():
    data = np.frombuffer("The 12 Km of Bob Smith, he saw. Bob 3".encode(), np.uint8)
    _, token, s, e = decontaminate.template(data, np.array([0, len(data)]))
    kinds = [{int(decontaminate.NUM): "#", int(decontaminate.NAME): "@", int(decontaminate.UNIT): "u"}.get(int(t), data[a:b].tobytes().decode().lower()) for t, a, b in zip(token, s, e)]
    assert kinds == ["the", "#", "u", "of", "@", "he", "saw", "bob", "#"]


# ---- 9

def test_packing_round_trip(spark):
    texts = corpus(5)
    rows = packing.pack(docs(spark, texts, [*range(len(texts) - 1), None]), length=256, group_ids=5000).collect()
    encode = packing.encoder(packing.VOCABULARY).encode_ordinary
    assert packing.unpack(rows) == {(i if i < len(texts) - 1 else None): encode(t or "") + [packing.END] for i, t in enumerate(texts)}
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u2")
        assert len(ids) == 256 and r.n_ids == r.cu_seqlens[-1] <= 256 and (ids[r.n_ids :] == packing.END).all()
        pos = packing.position_ids(r.cu_seqlens, 256)
        assert np.flatnonzero(pos == 0).tolist() == r.resets
    assert packing.pack(docs(spark, texts).where("false")).count() == 0


def test_best_fit_decreasing_against_a_scan():
    rng = random.Random(1)
    for _ in range(30):
        sizes = [rng.randrange(1, 33) for _ in range(60)]
        rows = packing.best_fit(sizes, 32)
        free, want = [], []
        for i in sorted(range(60), key=lambda i: (-sizes[i], i)):
            fit = [(f, k) for k, f in enumerate(free) if f >= sizes[i]]
            if fit:
                least = min(f for f, _ in fit)
                k = [k for f, k in fit if f == least]
                free[k[0]] -= sizes[i]
            else:
                free.append(32 - sizes[i])
            want.append(len(free))
        assert sorted(x for r in rows for x in r) == list(range(60)) and all(sum(sizes[i] for i in r) <= 32 for r in rows) and len(rows) == len(free)


# ---- 10

def test_sharding(spark):
    import zlib

    texts = corpus(2)
    ids = [*range(len(texts) - 3), None, 3, 3]
    rows = sharding.assign(docs(spark, texts, ids).withColumnRenamed("n_chars", "shard")).collect()
    assert len(rows) == len(texts)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in zip(ids, texts))
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    load = [sum(r.size for r in rows if r.shard == s) for s in range(8)]
    assert max(load) - min(load) <= max(r.size for r in rows)
    again = sharding.assign(docs(spark, texts, ids).repartition(5)).collect()
    assert {(r.doc_id, r.text_crc32, r.shard, r.slot) for r in rows} == {(r.doc_id, r.text_crc32, r.shard, r.slot) for r in again}
    assert sharding.assign(docs(spark, texts).where("false")).count() == 0


def test_slot_maps(spark, tmp_path):
    rng = random.Random(1)
    sizes = {s: rng.randrange(1, 1000) for s in range(2000)}
    one = sharding.plan(sizes, 8)
    grown = sharding.rebalance(one, sizes, 9)
    moved = [s for s in sizes if one[s] != grown[s]]
    load = collections.Counter()
    for s, x in grown.items():
        load[x] += sizes[s]
    assert max(load.values()) < 1.05 * min(load.values()) and sum(sizes[s] for s in moved) < 0.15 * sum(sizes.values()) and all(grown[s] == 8 for s in moved)
    assert set(sharding.rebalance(one, sizes, 7).values()) == set(range(7)) and sharding.rebalance(one, sizes, 8) == one
    for v, m in ((1, one), (2, grown)):
        sharding.store(sharding.as_map(spark, m, sizes, v), f"{tmp_path}/maps")
    assert {r.slot: r.shard for r in sharding.load(spark, f"{tmp_path}/maps").collect()} == grown
    assert {r.slot: r.shard for r in sharding.load(spark, f"{tmp_path}/maps", 1).collect()} == one
