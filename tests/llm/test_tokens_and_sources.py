"""BPE ids against the tokenizer library, and the audit of sources against plain integers and SQL."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from strandline.llm import bpe, source_audit

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, `ids` string, term string"


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(bpe._path(bpe.VOCABULARY))


ODD = ["", " ", "<|endoftext|>", "a<|endoftext|>B <|startoftext|><|endof", "ΟΔΟΣ ΣΑΣ's", "é é", "İI", "it's 'S 'LL we'dn't", "12 345", "\x1c\x85 x y", "日本語テキスト 한국어", "😀😀!!??", "\U000187f9a ՘b", "ﬁ ǅ", "aaaaaaaaab", "!" * 300]


def test_ids_are_those_of_the_library(library):
    coder, rnd = bpe.tokenizer(bpe.VOCABULARY), random.Random(7)
    alphabet = "aabbtheingo'sré ΣσςǺ!!..--0123 \t\n中文한국"
    texts = ODD + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(chr(rnd.choice([rnd.randrange(0x20, 0xD800), rnd.randrange(0xE000, 0x20000)])) for _ in range(20)) for _ in range(1000)]
    texts += ["aaaab" * 40_000, "the" * 30_000 + "!"]
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert [coder.encode(t) for t in texts] == want
    back = coder.decode(np.array([i for ids in want for i in ids]), np.cumsum([len(ids) for ids in want]), step=1000)
    assert [b.decode() for b in back] == [library.decode(ids, skip_special_tokens=False) for ids in want]


def test_full_tables_of_words_and_pairs_start_anew(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 5)
    coder = bpe.Tokenizer(bpe._path(bpe.VOCABULARY))
    text = "many different words, and once more many different words in 20 places"
    assert coder.encode(text) == library.encode(text, add_special_tokens=False).ids and len(coder.known) <= 5 and len(coder.pairs) <= 5


def test_a_bridging_merge_that_is_due_first_parts_two_tokens(library):
    """Pairs of tokens stand side by side exactly where the library gives the same two for their text."""
    coder, rnd = bpe.tokenizer(bpe.VOCABULARY), random.Random(3)
    inner = [i for i, s in coder.strings.items() if max(map(ord, s)) < 128 and s.isalpha()]
    final = [i for i, s in coder.strings.items() if ord(s[-1]) >= 256 and chr(ord(s[-1]) - 256).isalpha() and s[:-1].isalpha() and s.isascii() is False and max(map(ord, s[:-1])) < 128 and ord(s[-1]) < 384]
    seen = Counter()
    for _ in range(3000):
        a, b = rnd.choice(inner), rnd.choice(final)
        text = coder.strings[a] + coder.strings[b][:-1] + chr(ord(coder.strings[b][-1]) - 256)
        if text != text.lower():
            continue
        same = library.encode(text, add_special_tokens=False).ids == [a, b]
        assert coder._tolerated(a, b) == same
        seen[same] += 1
    assert min(seen[True], seen[False]) > 20


def test_bpe_rows(spark, library):
    rows = [(i, t, "en", "s", "x", "y") for i, t in enumerate(ODD)] + [(1, None, None, None, None, None), (None, "no id", "en", "s", None, None), (2, ODD[2], "en", "s", "x", "y")]
    got = bpe.decode(bpe.encode(spark.createDataFrame(rows, DOCS))).collect()
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], ids, library.decode(ids, skip_special_tokens=False)))
    assert sorted(map(repr, ((r.doc_id, r.ids, r.text) for r in got))) == sorted(map(repr, want))
    none = spark.createDataFrame([], DOCS)
    assert bpe.decode(bpe.encode(none)).collect() == []


def test_bpe_query_over_the_whole_table(spark, library):
    got = {r.doc_id: r for r in bpe.query(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        assert got[d.doc_id][1:] == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_slices_of_equal_hashes_are_told_apart():
    raw = "a bb a ccc bb déjà A".encode()
    letters, begin, end = source_audit.cut(raw)
    for digest in (None, len, lambda s: 0):
        word, first = source_audit.group(letters, begin, end, digest)
        assert [bytes(letters[begin[i] : end[i]]) for i in first[word]] == [bytes(letters[a:b]) for a, b in zip(begin, end)]
        assert len(first) == 4 and len(set(word.tolist())) == 4


def audit_by_hand(rows, least=3, top=200):
    import re

    docs, n, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in re.findall("[A-Za-z\u0080-\U0010ffff]+", text or "")]
        groups.add((lang, source))
        n[lang, source].update(words)
        docs[lang].update(set(words))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(w for w, c in docs[lang].items() if c >= least)
        mine = sorted(g for g in groups if g[0] == lang)
        total = Counter()
        for g in mine:
            total.update({w: n[g][w] for w in kept})

        def p(counts):
            among = sum(counts[w] for w in kept) + len(kept)
            return {w: 1 + 10**9 * (counts[w] + 1) // among for w in kept}

        whole = p(total)
        for g in mine:
            own = p(n[g])
            pairs = []
            for h in mine:
                if h != g:
                    q = p(n[h])
                    pairs.append((-sum((own[w] - q[w]) ** 2 // q[w] for w in kept), h[1].encode()))
            terms = [(-((own[w] - whole[w]) ** 2 // whole[w]), w.encode()) for w in kept if n[g][w] and own[w] > whole[w]]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(*g, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(sorted(found)) if part == "pair" or i < top}
    return out


def sources(n_sources=7):
    rnd, words = random.Random(5), ["The", "the", "Été", "été", "ab", "ba", "éa", "x", "rare", "日本", "Ünique"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    rows = [(i, " ".join(rnd.choice(words[: 5 + i % len(words)]) for _ in range(rnd.randint(0, 30))), rnd.choice(["en", "de", None]), f"s{rnd.randint(0, n_sources)}" if i % 9 else None) for i in range(300)]
    return rows + [(0, rows[0][1], "en", "s0"), (None, None, "empty", "a"), (1, "1 2 3", "empty", "b"), (2, "once twice", "one", "alone"), (3, "", "empty", None), (4, "é" * 70_000 + " the the", "en", "long")]


@pytest.mark.parametrize("block, rows, digest", [(256, 1 << 14, None), (2, 40, None), (3, 1000, len)])
def test_audit_by_hand(spark, monkeypatch, block, rows, digest):
    monkeypatch.setattr(source_audit, "BLOCK", block)
    given = sources()
    docs = spark.createDataFrame([(*r, "x", "y") for r in given], DOCS).repartition(3)
    got = source_audit.audit(docs, rows=rows, digest=digest).collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == audit_by_hand(given)


def test_many_terms_rank_to_the_limit(spark):
    text = " ".join("w" + chr(97 + i % 26) + chr(97 + i // 26) for i in range(300))
    given = [(i, text, "en", "a") for i in range(3)] + [(9, "other " * 50, "en", "b")] * 3
    got = source_audit.audit(spark.createDataFrame([(*r, None, None) for r in given], DOCS), rows=64).collect()
    assert set(map(tuple, got)) == audit_by_hand(given) and sum(r.part == "term" and r.source == "a" for r in got) == 200


def test_audit_of_nothing(spark):
    assert source_audit.audit(spark.createDataFrame([], DOCS)).collect() == []
    got = source_audit.audit(spark.createDataFrame([(1, None, None, None, None, None), (2, None, None, "b", None, None)], DOCS)).collect()
    assert sorted(map(tuple, got)) == [("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)]


def test_audit_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    df = source_audit.query(spark, SF)
    assert sorted(map(tuple, df.collect())) == sorted(con.sql(source_audit.ORACLE_SQL).select(*df.columns).fetchall())


def test_weights_are_exact():
    rnd = random.Random(2)
    for _ in range(2000):
        among = rnd.randint(1, 10**14)
        count = rnd.randint(0, min(among, 10**13) - 1)
        assert source_audit.weights(np.array([count]), np.array([among]))[0] == 1 + 10**9 * (count + 1) // among
