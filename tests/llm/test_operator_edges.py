"""Large-input paths against the small ones, brute-force versions, and odd tables."""

import functools
import os
import random
import re
import types

import numpy as np
import pytest

from strandline.llm import _spark, decontaminate, hilbert_ann, kneser_ney, licences, mixing, ngram_join, packing, suffix_dedup, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "der the of and réeux vequ stone river cloud paper window garden music seven mountain horse glass winter".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def docs(spark, texts, ids=None, columns=None):
    ids = list(range(len(texts))) if ids is None else ids
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in zip(ids, texts)], DOCS)
    return d.withColumnsRenamed(columns or {})


# ---- shared helpers

def test_components_of_paths_stars_and_struct_ids(spark, monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(_spark, "FOREST", 50)
    edges = [(i, i + 1) for i in range(0, 700)] + [(2000, i) for i in range(2001, 2300)] + [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(250)]
    rng.shuffle(edges)
    edges += [(5000, 5000)]
    comp = {}
    find = lambda x: x if comp.setdefault(x, x) == x else find(comp[x])
    import sys

    sys.setrecursionlimit(10_000)
    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            comp[max(a, b)] = min(a, b)
    want = {x: find(x) for x in comp}
    e = spark.createDataFrame(edges, "a bigint, b bigint").repartition(7)
    assert {r.node: r.component for r in _spark.components(e, _spark.Scratch(spark)).collect()} == want
    s = e.selectExpr("struct(a d, a * 7 f) a", "struct(b d, b * 7 f) b")
    got = {r.node.d: r.component for r in _spark.components(s, _spark.Scratch(spark)).collect()}
    assert {k: v.d for k, v in got.items()} == want and all(v.f == 7 * v.d for v in got.values())
    assert _spark.components(e.where("false"), _spark.Scratch(spark)).count() == 0


@pytest.mark.parametrize("most", [0, 100])
def test_rows_without_ids(spark, most):
    d = docs(spark, ["t"] * 60, [None if i % 10 == 0 else i % 45 for i in range(60)])
    gone = spark.createDataFrame([(i,) for i in (1, 2, 33, None, 99, 1)], "doc_id bigint")
    out = _spark.without(d, gone, _spark.Scratch(spark), most)
    assert out.columns == d.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r.doc_id) for r in d.collect() if r.doc_id not in (1, 2, 33))


def test_a_cluster_must_name_its_shared_folder():
    def session(master, folder):
        conf = types.SimpleNamespace(get=lambda *_: folder)
        return types.SimpleNamespace(sparkContext=types.SimpleNamespace(getConf=lambda: conf, master=master), conf=conf)

    assert _spark.shared_dir(session("spark://host", "hdfs://x")) == "hdfs://x" and _spark.shared_dir(session("local[4]", None))
    with pytest.raises(ValueError, match="checkpoint"):
        _spark.shared_dir(session("spark://host", None))


def test_scratch_drops_its_own_tables(spark):
    scratch = _spark.Scratch(spark)
    a, b = scratch.put(spark.range(3)), scratch.put(spark.range(4))
    scratch.drop(a, spark.range(2))
    assert b.count() == 4
    with pytest.raises(Exception):
        spark.read.parquet(a._scratch_path)
    scratch.clear()


# ---- 2

def test_perplexity_by_join_is_that_by_broadcast(spark):
    rng = random.Random(4)
    d = docs(spark, [prose(rng, 30) for _ in range(40)])
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(40)] + [(None, 1)], "doc_id bigint, quality int")
    one, two = (sorted((r.doc_id, r.perplexity, r.limit, r.keep) for r in kneser_ney.classify(d, labels, folds=5, broadcast_ids=n).collect()) for n in (10**6, 0))
    assert one == two


def test_the_limit_is_that_of_held_out_texts(spark):
    import zlib

    rng = random.Random(8)
    d = docs(spark, [prose(rng, 30) for _ in range(60)] + [None], columns={"n_chars": "limit", "source": "held"})
    labels = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in kneser_ney.classify(d, labels, quantile=1.0, folds=5).collect()}
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and {r.limit for r in got.values()} == {max(got[i].perplexity for i in held)}
    # texts that the model has seen are less surprising
    assert np.mean([got[i].perplexity for i in held]) > np.mean([got[i].perplexity for i in range(60) if i not in held])
    nothing = kneser_ney.classify(d, labels.where("false")).collect()
    assert all(r.n_symbols is not None and not r.keep for r in nothing) and {r.n_symbols for r in nothing if r.doc_id == 60} == {0}


# ---- 3

def test_many_cells_are_raked_like_few(spark):
    rng = random.Random(3)
    d = spark.createDataFrame([(i, prose(rng, rng.choice([5, 50])), rng.choice(["en", "de", None]), f"s{rng.randrange(9)}", 0) for i in range(300)], DOCS)
    from pyspark.sql import functions as F

    cells = mixing.levels(d).groupBy(*mixing.KEYS).agg(F.sum("m_tokens").alias("w"))
    few, many = ({(r.m_source, r.m_lang, r.m_topic): r.fit for r in mixing.rake(cells, mixing.TEMPERS, 5, _spark.Scratch(spark), in_one=n).collect()} for n in (10**6, 0))
    assert few == pytest.approx(many) and len(few) > 9


def test_mixing_keeps_columns_of_its_own_names(spark):
    d = docs(spark, ["x y"] * 50, columns={"n_chars": "probability"}).selectExpr("*", "doc_id * 3 IMPORTANCE", "'mine' m_topic", "1 fit", "2 w")
    out = mixing.mix(d, rate=1e9)
    rows = out.collect()
    assert out.columns[: len(d.columns)] == d.columns and len(rows) == 50
    assert all(r["probability"] == 0 and r["IMPORTANCE"] == 3 * r.doc_id and r["m_topic"] == "mine" and r["probability_"] == 1 and r["m_topic_"] == "prose" for r in rows)
    same = mixing.mix(docs(spark, ["a"] * 30, [5] * 30)).collect()
    assert len(same) in (0, 30)


# ---- 4

def test_neighbours_in_small_blocks_and_pages(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((900, 12)) + 4 * rng.standard_normal((6, 12))[np.arange(900) % 6]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    want = sorted(map(tuple, hilbert_ann.nearest(df, k=5).collect()))
    monkeypatch.setattr(hilbert_ann, "ROWS", 64)
    monkeypatch.setattr(hilbert_ann, "QUERIES", 16)
    monkeypatch.setattr(hilbert_ann, "_may_meet", functools.partial(hilbert_ann._may_meet, page=3))
    assert sorted(map(tuple, hilbert_ann.nearest(df, k=5, window=8).collect())) == want


def test_windows_alone_find_nine_of_ten_neighbours_in_clusters(spark):
    rng = np.random.default_rng(5)
    x = (0.15 * rng.standard_normal((4000, 32)) + rng.standard_normal((80, 32))[rng.integers(0, 80, 4000)]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    want = {(r.query_id, r.vec_id) for r in hilbert_ann.nearest(df).collect()}
    near = {(r.query_id, r.vec_id) for r in hilbert_ann.nearest(df, exact=False, orderings=6).collect()}
    assert len(near & want) >= 0.9 * len(want)


# ---- 5

def test_the_direct_sort_is_exact_among_long_ties():
    rng = np.random.default_rng(2)
    a = rng.integers(97, 100, 300)
    text = np.concatenate((a, a[:250], [122], a, a[:299], [121], np.full(300, 97), a)).astype(np.uint8)
    for span in (8, 13, 64, 200):
        sa, equal = suffix_dedup.two_stage(text, span)
        raw = text.tobytes()
        cut = [raw[i : i + span].ljust(span, b"\0") for i in sa]
        assert sorted(sa.tolist()) == list(range(len(raw))) and cut == sorted(cut)
        assert equal[1:].tolist() == [x == y for x, y in zip(cut, cut[1:])]


# ---- 6

def test_kernels_and_gate_against_plain_versions():
    rng = random.Random(1)
    word = lambda n: bytes(rng.choice(b"abcdeio.-") for _ in range(n))
    units = [word(rng.randrange(3, 25)) for _ in range(300)]
    model = toxicity.Model([b"idiocade", b"bad", b"c.oia-dbeeoaiidcbaeo", b"plain"], 3)
    c = toxicity.as_codes(units)
    want = np.stack([toxicity._raw_kernel(c, m[None, : int((m > 0).sum())]) for m in model.marks], 1)
    assert toxicity._all_kernels(c, model.marks) == pytest.approx(want, rel=1e-4)

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    marks = [bytes(m[m > 0]) for m in model.marks[:3]]
    assert model.may_be(c).tolist() == [any(common(u, m) >= np.ceil(model.share * len(m)) for m in marks) for u in units]


def test_one_changed_byte_of_a_four_byte_insult_gets_a_kernel():
    model = toxicity.Model([b"fool", b"river"], 1)
    assert model.may_be(toxicity.as_codes([b"fool", b"f0ol", b"foql", b"fo.ol", b"river", b"xxol"])).tolist() == [True, True, True, True, False, False]
    model.alpha, model.bias = np.array([2.0, -1.0], np.float32), -0.5
    assert (model.margins(toxicity.as_codes([b"f0ol", b"foql"])) > -1).all()


def test_kernels_in_tasks_are_those_of_the_driver(spark, monkeypatch):
    rng = random.Random(4)
    words = [bytes(rng.choice(b"abcdefg") for _ in range(rng.randrange(3, 20))) for _ in range(2500)]
    model = toxicity.Model([b"abcd", b"gfedcba", b"cafe"], 2)
    got = toxicity._kernels_in_tasks(spark, model, words)
    assert len(words) > toxicity.ON_DRIVER and np.allclose(got, model.kernels(toxicity.as_codes(words)), rtol=1e-4)


def test_remembered_margins_are_the_same(monkeypatch):
    rng = random.Random(2)
    model = toxicity.Model([b"idiot", b"moron", b"river"], 2)
    model.alpha, model.bias = np.array([3.0, 2.0, -1.0], np.float32), -0.5
    seen = toxicity.Seen()
    for limit in (10**6, 100):
        monkeypatch.setattr(toxicity, "REMEMBERED", limit)
        for _ in range(6):
            text = (prose(rng, 200) + " id-iot m o r o n idiots").encode()
            data, offs = np.frombuffer(text, np.uint8), np.array([0, 40, len(text)])
            assert (model.features(data, offs, seen) == model.features(data, offs)).all()
        assert len(seen.hashes) == len(seen.found) and (np.diff(seen.hashes.view(np.int64)) != 0).all()


def test_weighted_curve_counts_repeated_rows():
    rng = np.random.default_rng(1)
    x, w = rng.standard_normal((50, 3)), rng.integers(1, 6, 50)
    y = (x[:, 0] + rng.standard_normal(50) > 0).astype(float)
    assert toxicity._curve(x, y, w.astype(float)) == pytest.approx(toxicity._curve(np.repeat(x, w, 0), np.repeat(y, w), np.ones(w.sum())), abs=1e-6)


# ---- 7

def test_whole_licences_and_odd_rows(spark):
    whole = [t for label, t in licences.TEMPLATES if label in ("mit", "bsd", "isc", "zlib", "unlicense") and len(t) > 500]
    changed = whole[0].replace("sublicense, and/or sell", "sell").replace("MERCHANTABILITY", "SALE")
    texts = [*(f"Intro here.\n{t.upper()}\nThe end." for t in whole), changed, None, None, "same all rights reserved", "same all rights reserved"]
    ids = [*range(len(whole)), 50, None, None, 7, 7]
    rows = licences.scan_licences(docs(spark, texts, ids, {"n_chars": "n_words", "source": "labels"})).collect()
    assert len(rows) == len(texts)
    by = {r.doc_id: r for r in rows}
    assert all(r.score == 1 and any(s.cover == 1 for s in r.spans) for i, r in by.items() if i is not None and i < len(whole))
    assert 0.8 < by[50].score < 1 and "mit" in by[50].labels
    assert sum(r.doc_id is None and r.n_words == 0 and r.labels == "" for r in rows) == 2
    assert [(r.n_base, r.first_word, r.labels) for r in rows if r.doc_id == 7] == [(1, 1, "reserved")] * 2


def test_chains_against_all_chains(spark):
    rng = random.Random(9)
    for _ in range(40):
        seq = [rng.randrange(4) for _ in range(10)]
        scanner = licences.Scanner([("t", " ".join(f"w{c}" for c in seq))], [], least=2, gap=2)
        text = [rng.choice([*range(4), 9]) for _ in range(14)]
        data = np.frombuffer(" ".join(f"w{c}" for c in text).encode(), np.uint8)
        _, _, chains = scanner.scan(data, np.array([0, len(data)]))
        hits = []  # matches in the text and in the template that neither the next nor an earlier word extends
        stat = [max((n for n in range(i + 2) if any(seq[p : p + n] == text[i - n + 1 : i + 1] for p in range(len(seq) - n + 1))), default=0) for i in range(len(text))]
        for i, n in enumerate(stat):
            if n >= 2 and (i + 1 == len(text) or stat[i + 1] <= n):
                hits += [(i - n + 1, p, n) for p in range(len(seq) - n + 1) if seq[p : p + n] == text[i - n + 1 : i + 1]]

        def best(h):
            after = [g for g in hits if h[0] + h[2] <= g[0] <= h[0] + h[2] + 2 and h[1] + h[2] <= g[1] <= h[1] + h[2] + 2]
            return h[2] + max((best(g) for g in after), default=0)

        want = max((best(h) for h in hits), default=0)
        assert max((share for c in chains.values() for *_, share in c), default=0) == pytest.approx(want / len(seq))


# ---- 8

def plain_templates(text):
    """Template words of the three readings and the plain words, by regular expressions."""
    out, words, opens = {0: [], 1: [], 2: []}, [], True
    was_number = False
    for m in re.finditer(r"[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text or ""):
        raw = m[0]
        if raw.isspace():
            opens = opens or "\n" in raw
            continue
        inner = re.search(r"[0-9A-Za-z\x80-\U0010ffff](?:.*[0-9A-Za-z\x80-\U0010ffff])?", raw, re.S)
        if inner:
            w = inner[0]
            low = "".join(c.lower() if len(c.lower().encode()) == len(c.encode()) else c for c in w)
            number = any("0" <= c <= "9" for c in w)
            unit = low in decontaminate.UNITS and was_number
            capital = not number and not unit and low[0] != w[0]
            words.append(low)
            for how, tokens in out.items():
                kind = "#" if number else "~" if unit else "@" if capital and (how == 1 or how == 0 and not opens) else None
                if kind and tokens and tokens[-1][0] == kind:
                    tokens[-1][2] = (tokens[-1][2][0], m.start() + inner.end())
                else:
                    tokens.append([kind or "w", low, (m.start() + inner.start(), m.start() + inner.end())])
            was_number, opens = number, False
        opens = raw[-1] in "!.:;?\n"
    return {how: [(k if k != "w" else w, (text[a:b].lower() if k != "w" else None)) for k, w, (a, b) in tokens] for how, tokens in out.items()}, words


def plain_windows(tokens, n=8):
    spots = range(len(tokens) - n + 1)
    return {p: tokens[p : p + n] for p in spots if sum(s is None for _, s in tokens[p : p + n]) * 2 >= n}


def plain_leaks(texts, items, need=6, least=5):
    out = set()
    for j, item in items.items():
        forms, words = plain_templates(item)
        own = {how: plain_windows(t) for how, t in forms.items()}
        for i, text in texts.items():
            theirs, said = plain_templates(text)
            if any(own.values()):
                for how, mine in own.items():
                    by_shift = {}
                    for p, w in plain_windows(theirs[how]).items():
                        for q, v in mine.items():
                            if [x for x, _ in w] == [x for x, _ in v]:
                                by_shift.setdefault(p - q, []).append((q, [(a, b) for (_, a), (_, b) in zip(v, w) if a is not None]))
                    good = set()
                    for found in by_shift.values():
                        votes = {}
                        for _, pairs in found:
                            for a, b in pairs:
                                votes.setdefault(a, {}).setdefault(b, 0)
                                votes[a][b] += 1
                        top = {a: max((n, b) for b, n in v.items())[1] for a, v in votes.items()}
                        good |= {q for q, pairs in found if all(top[a] == b for a, b in pairs)}
                    if mine and len(good) >= min(need, len(mine)):
                        out.add((i, j))
            elif len(words) >= least:
                n = min(8, len(words))
                mine = {q: words[q : q + n] for q in range(len(words) - n + 1)}
                hit = {q for q, v in mine.items() for p in range(len(said) - n + 1) if said[p : p + n] == v}
                if len(hit) >= min(need, len(mine)):
                    out.add((i, j))
            elif words and said == words:
                out.add((i, j))
    return out


def test_leaks_against_plain_loops(spark):
    rng = random.Random(11)
    names, units = ["Anna", "Bob", "Łucja", "Zoe"], ["km", "kg", "hours"]

    def sentence(n):
        w = []
        for _ in range(n):
            w += rng.choice([[rng.choice(WORDS)]] * 5 + [[rng.choice(names)], [str(rng.randrange(99)), rng.choice(units)]])
        return " ".join(w).capitalize() + rng.choice([".", "!", "?\n", ","])

    items = {k: " ".join(sentence(rng.randrange(6, 14)) for _ in range(rng.randrange(1, 4))) for k in range(12)}
    items |= {20: "seven stone river paper cloud music of", 21: "12 km, 13 kg and 14 hours or 15 km, 16 kg, 17 hours, 18 km", 22: "glass winter", 23: None, 24: "?!", 25: "Bob Zoe Anna Bob 12 13 14"}
    texts = {}
    for i in range(90):
        parts = [sentence(rng.randrange(4, 10)) for _ in range(rng.randrange(1, 4))]
        if i % 2:
            t = items[rng.choice([*range(12), 20, 21, 22, 25])]
            how = rng.randrange(5)
            t = [t, t.upper(), t.replace("Anna", "Ida").replace("Bob", "Max"), re.sub(r"\d+", lambda m: str(int(m[0]) + 100), t), " ".join(t.split()[: max(3, len(t.split()) * 2 // 3)])][how]
            parts.insert(rng.randrange(len(parts) + 1), t)
        texts[i] = " ".join(parts)
    texts |= {100: "Glass,  WINTER", 101: "glass winter horse", 102: None, 103: "", 104: "Seven stone river paper cloud music of", 105: items[21]}
    bench = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs(spark, list(texts.values()), list(texts)), bench).collect()}
    want = plain_leaks(texts, items)
    assert got == want and {(100, 22), (104, 20), (105, 21)} <= got and not any(i in (101, 102, 103) for i, _ in got) and len({j for _, j in got}) > 10


# ---- 9

def test_packing_other_vocabularies_and_columns(spark, tmp_path):
    rng = random.Random(1)
    texts = [prose(rng, n) for n in (3, 400, 30, 30)] + [None, ""]
    d = docs(spark, texts, [1, 2, 3, 3, None, 5], {"n_chars": "ids", "source": "cu_seqlens"})
    import public_tokenizers

    rows = packing.pack(d, length=128, vocabulary=public_tokenizers.path(packing.VOCABULARY), end=70_000)
    assert {r.id_bytes for r in rows.collect()} == {4}
    encode = packing.encoder(packing.VOCABULARY).encode_ordinary
    back = packing.unpack(rows.collect())
    assert back[2] == encode(texts[1]) + [70_000] and back[5] == back[None] == [70_000]
    with pytest.raises(ValueError):
        packing.write_matrices(rows, "hdfs://somewhere/x")
    made = packing.write_matrices(rows.repartition(2), f"{tmp_path}/m").collect()
    total = 0
    for m in made:
        ids, cu, resets, bounds = (np.load(f"{tmp_path}/m/{x}-{m.part:05d}.npy", mmap_mode="r") for x in ("ids", "cu_seqlens", "resets", "bounds"))
        assert ids.shape == (m.n_rows, 128) and ids.dtype == np.uint32 and len(bounds) == m.n_rows + 1 and tuple(bounds[-1]) == (len(cu), len(resets))
        for i in range(m.n_rows):
            lengths = cu[bounds[i][0] : bounds[i + 1][0]]
            total += int(lengths[-1])
            assert (np.flatnonzero(packing.position_ids(lengths, 128) == 0) == resets[bounds[i][1] : bounds[i + 1][1]]).all()
    assert total == sum(m.n_ids for m in made) == sum(r.n_ids for r in rows.collect())
    assert not [p for p in (tmp_path / "m").iterdir() if p.name.startswith(".")]


# ---- columns of the operators' own names

def test_clashing_columns_everywhere(spark):
    rng = random.Random(2)
    texts = [prose(rng, 40) for _ in range(6)]
    texts += texts[:2]
    d = docs(spark, texts).selectExpr("*", "1 id", "2 fp", "3 h", "4 n", "5 a", "6 b", "7 component_id", "8 score", "9 item_id", "10 shingles")
    assert {r.doc_id: r.component_id for r in ngram_join.jaccard_classes(d).collect()} == {**{i: i for i in range(6)}, 6: 0, 7: 1}
    assert sorted(r.doc_id for r in ngram_join.one_of_each(d).collect()) == list(range(6)) and ngram_join.one_of_each(d).columns == d.columns
    assert sum(r.n_removed for r in suffix_dedup.repeated_bytes(d, span=100).collect()) == 2 * sum(len(t.encode()) for t in texts[:2])
    with pytest.raises(ValueError):
        suffix_dedup.repeated_bytes(d, span=20)
    bench = spark.createDataFrame([(1, texts[0], 5)], "item_id bigint, text string, doc_id int")
    assert sorted(r.doc_id for r in decontaminate.leaks(d, bench).collect()) == [0, 6]
    left = decontaminate.remove_leaks(d, bench)
    assert left.columns == d.columns and left.count() == 6


# ---- the registered queries against their SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")
@pytest.mark.parametrize("name", ["op1_ngram_jaccard_join", "op4_hilbert_neighbours", "op5_suffix_array_dedup"])
def test_query_matches_sql(spark, name):
    import __spark_entry__ as e
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = e.queries()[name](spark, SF)
    rel = con.sql(e.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert sorted(map(tuple, df.collect())) == sorted(rel.select(", ".join(df.columns)).fetchall())
