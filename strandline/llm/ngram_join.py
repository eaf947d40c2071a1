"""N-gram Jaccard join with adaptive multi-match prefixes.

``jaccard_classes`` links two documents when 100 * |A & B| >= percent * |A | B| for their sets of
k-word shingles, and returns the connected components of the links. The work is:

1. One pass over the texts counts shingles into a sketch of fixed width, which gives every shingle
   the same place in one global order everywhere: estimated rarity first, then hash. The order
   changes costs only, never results.
2. A second pass gives each document a 128-bit fingerprint of its whole set and its longest prefix
   in that order. Documents with equal sets collapse to one class before anything is paired.
3. Prefix shingles that occur in one class only are dropped. For the others the posting lengths are
   exact counts, and each class picks the level l in 1..``levels`` of least estimated cost: the
   l-prefix holds n - ceil(t n) + l shingles, and a pair must share at least min(l_a, l_b) of them
   before it is verified. (Two sets that qualify share at least l shingles of their l-prefixes, for
   every l that both have.) The shingles that a prefix shares with no other class bound its overlap
   with any partner and so the partner's size; entries without a partner in reach are dropped.
4. Every posting list first proposes one centre to its members; verified links merge. Only
   members of different components are then paired, so a large group of near copies costs a number
   of rows in proportion to its size, and no link between different components is lost.
   ``jaccard_links`` leaves this step out: there any two classes are paired, and it returns every link.
5. Verification reads the whole shingle sets. A Bloom filter of fixed size lets the third text pass
   skip documents without candidates; a join then removes its false positives.

Nulls and texts without words have the empty set (n_shingles 0) and no links; a null id is kept in
the result as its own component (null) and takes part in no link. Repeated ids are seen as one
document per row: rows with the same id fall in one component. Other columns of ``docs`` are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import _kernel as K
from strandline.llm._spark import Scratch, bit_table, components, lean, without

SKETCH_BITS = 20
_BLOCK_BITS = 14
BLOOM_BITS = 26
HEAD = 32
#: Postings of more entries than this are long: their pairs are counted by lists, not one by one.
LONG = 16
#: A class of equal sets: its smallest doc_id, and the fingerprint, since rows may repeat a doc_id with other texts.
CLASS = "struct<d:bigint,f:bigint>"
_SALTS = (np.uint64(0x51ED270B), np.uint64(0xA3C59AC3D1B54A32))


def _sketch(docs: DataFrame, k: int) -> np.ndarray:
    """Counts of distinct (document, shingle) by the top bits of the hash: 2**SKETCH_BITS cells, 4 MB, at any input size."""
    blocks = 1 << (SKETCH_BITS - _BLOCK_BITS)

    def count(batches):
        cells = np.zeros(1 << SKETCH_BITS, np.uint32)
        for b in batches:
            for _, _, data, offs in K.slices(b.column(0)):
                _, h, _ = K.shingle_sets(data, offs, k)
                cells += np.bincount((h >> np.uint64(64 - SKETCH_BITS)).view(np.int64), minlength=len(cells)).astype(np.uint32)
        for i, part in enumerate(cells.reshape(blocks, -1)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([_pack(part)], pa.binary())], ["block", "cells"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part = _unpack(raw)
                sums[i] = sums[i] + part if i in sums else part
        for i, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["block", "cells"])

    kind = "block int, cells binary"
    out = np.zeros((blocks, 1 << _BLOCK_BITS), np.uint64)
    merged = docs.select("text").mapInArrow(lean(count), kind).repartition(16, "block").mapInArrow(lean(add), kind)
    for row in merged.collect():  # 64 blocks of fixed size
        out[row["block"]] = np.frombuffer(bytes(row["cells"]), np.uint64)
    return np.minimum(out.ravel(), 2**32 - 1).astype(np.uint32)


def _pack(part: np.ndarray) -> bytes:
    """A block in the narrowest type that holds it, after one byte that names the width."""
    for width, kind in ((1, np.uint8), (2, np.uint16)):
        if part.max() <= np.iinfo(kind).max:
            return bytes([width]) + part.astype(kind).tobytes()
    return b"\x04" + part.astype(np.uint32).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    kind = {1: np.uint8, 2: np.uint16, 4: np.uint32}[raw[0]]
    return np.frombuffer(raw, kind, offset=1).astype(np.uint64)


def _fingerprint(h: np.ndarray, edge: np.ndarray, salt) -> np.ndarray:
    sums = np.concatenate(([np.uint64(0)], np.cumsum(K.mix(h ^ salt))))
    return K.signed(sums[edge[1:]] - sums[edge[:-1]])


def prefix_base(n, percent: int):
    """Length of the 1-prefix: n - ceil(percent n / 100) + 1."""
    return n - (percent * n + 99) // 100 + 1


def _prefixes(docs: DataFrame, k: int, percent: int, levels: int, cells) -> DataFrame:
    """doc_id, n, two fingerprints and the prefix of the highest level, rarest first."""

    def scan(batches):
        order = cells.value
        for b in batches:
            ids = b.column(0)
            for lo, hi, data, offs in K.slices(b.column(1)):
                r, h, edge = K.shingle_sets(data, offs, k)
                n = np.diff(edge)
                f1, f2 = (_fingerprint(h, edge, salt) for salt in _SALTS)
                rank = np.minimum(order[(h >> np.uint64(64 - SKETCH_BITS)).view(np.int64)], 2**31)
                size = np.where(n > 0, np.minimum(n, prefix_base(n, percent) + levels - 1), 0)
                take = np.empty(int(size.sum()), np.uint64)
                at = np.concatenate(([0], np.cumsum(size)))
                for i in np.flatnonzero(n):
                    s, e = edge[i], edge[i + 1]
                    # rank decides, then the hash, which is the order they stand in
                    take[at[i] : at[i + 1]] = h[s:e][np.argsort(rank[s:e], kind="stable")[: size[i]]]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(f1), pa.array(f2), K.list_array(K.signed(take), at, pa.int64())], ["doc_id", "n", "f1", "f2", "prefix"])

    return docs.mapInArrow(lean(scan), "doc_id long, n long, f1 long, f2 long, prefix array<long>")


def _sets(docs: DataFrame, k: int, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, shingles): sorted shingle hashes of the documents in ``wanted`` (id), written."""
    bits = 1 << BLOOM_BITS

    def cells(ids: np.ndarray) -> np.ndarray:
        h = K.mix(ids.astype(np.int64).view(np.uint64))
        return np.stack([(h >> np.uint64(s)).astype(np.int64) & (bits - 1) for s in (0, 19, 38)])

    # 8 MB at any input size
    shared = docs.sparkSession.sparkContext.broadcast(bit_table(wanted.select("id.d").distinct(), "d", BLOOM_BITS, cells))

    def scan(batches):
        bloom = shared.value
        for b in batches:
            ids = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            hit = np.ones(len(ids), bool)
            for at in cells(ids):
                hit &= (bloom[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
            if b.column(0).null_count:
                hit &= b.column(0).is_valid().to_numpy(zero_copy_only=False)
            if not hit.any():
                continue
            b = b.filter(pa.array(hit))
            for lo, hi, data, offs in K.slices(b.column(1)):
                _, h, edge = K.shingle_sets(data, offs, k)
                ids = pa.StructArray.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(_fingerprint(h, edge, _SALTS[0]))], ["d", "f"])
                yield pa.RecordBatch.from_arrays([ids, K.list_array(K.signed(h), edge, pa.int64())], ["id", "shingles"])

    return scratch.put(docs.mapInArrow(lean(scan), f"id {CLASS}, shingles array<long>").join(wanted, "id", "left_semi").dropDuplicates(["id"]), [shared])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose whole sets qualify. The sets of a pair meet in one row; nothing is gathered by key."""

    def test(batches):
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            va, oa = b.column(2).values.to_numpy(), b.column(2).offsets.to_numpy()
            vb, ob = b.column(3).values.to_numpy(), b.column(3).offsets.to_numpy()
            for i in range(b.num_rows):
                x, y = va[oa[i] : oa[i + 1]].view(np.uint64), vb[ob[i] : ob[i + 1]].view(np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum()) if len(y) else 0
                keep[i] = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), b.column(1).filter(pa.array(keep))], ["a", "b"])

    left = sets.selectExpr("id a", "shingles sa")
    right = sets.selectExpr("id b", "shingles sb")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(lean(test), f"a {CLASS}, b {CLASS}")


def _fits(percent: int) -> str:
    """Whether two classes' sizes and bounds, ({0}, {2}) and ({1}, {3}), leave room for a link."""
    return "100 * least({0}, {1}) >= " + str(percent) + " * greatest({0}, {1}) and {0} <= {3} and {1} <= {2}"


def _index(docs: DataFrame, k: int, percent: int, levels: int, scratch: Scratch) -> tuple[DataFrame, ...]:
    """Rows with their fingerprints, rows with their class, and the postings of the prefixes at each class's level."""
    cells = docs.sparkSession.sparkContext.broadcast(_sketch(docs, k))
    found = scratch.put(_prefixes(docs, k, percent, levels, cells), [cells])
    some = found.where("n > 0 and doc_id is not null")
    # documents of one set are one class, and rows of one id stay together whatever their texts are
    classes = some.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("d"), F.min_by("prefix", "doc_id").alias("prefix"))
    classes = scratch.put(classes.selectExpr("n", "f1", "f2", "struct(d, f1 f) id", "prefix"))
    member = some.select("doc_id", "n", "f1", "f2").join(classes.select("n", "f1", "f2", "id"), ["n", "f1", "f2"]).select("doc_id", "n", "f1", "f2", "id")

    posts = classes.select("id", "n", F.posexplode("prefix").alias("pos", "token"))
    shared = posts.groupBy("token").agg(F.count("*").alias("cnt"), F.min("n").alias("least_n")).where("cnt > 1")
    posts = scratch.put(posts.join(shared, "token"))
    base = f"(n - (({percent} * n + 99) div 100) + 1)"
    # cost of level l: postings read, plus set comparisons of the pairs that may share l of them
    # a qualifying pair may share no more tokens than percent of the smaller set: no level may ask for more
    cost = [F.expr(f"if({lev} > greatest(1, ({percent} * n + 99) div 100), 1e300D, sum(if(pos < {base} + {lev - 1}, cnt - 1, 0)) * (1 + n / {64 * lev * lev}D))").alias(f"c{lev}") for lev in range(1, levels + 1)]
    level = posts.groupBy("id", "n").agg(F.count("*").alias("met"), *cost)
    best = F.expr(f"array_position(array({', '.join(f'c{i}' for i in range(1, levels + 1))}), least({', '.join(f'c{i}' for i in range(1, levels + 1))}, 1e300D))").cast("int")
    # prefix shingles that no other class has bound the overlap, and so the size of a partner
    alone = f"(least(n, {base} + {levels - 1}) - met)"
    level = level.select("id", best.alias("lev"), F.expr(f"(n - {alone}) * {100 + percent} div {percent} - n").alias("most_n"))
    index = scratch.put(posts.join(level, "id").where(f"pos < {base} + lev - 1 and most_n >= least_n").select("token", "id", "n", "lev", "most_n", "pos"))
    scratch.drop(posts)
    return found, member, index


def _apart(index: DataFrame, comp: DataFrame | None, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of classes of different components ``comp`` (of any two classes, if None) that share enough of their
    prefixes, and the table that they are read from."""
    if comp is None:
        tagged = index.selectExpr("token", "id", "n", "lev", "most_n", "pos", "id comp")
    else:
        tagged = index.join(comp.selectExpr("node id", "component"), "id", "left").selectExpr("token", "id", "n", "lev", "most_n", "pos", "coalesce(component, id) comp")
    # postings that lie in one component are settled
    apart = tagged.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("k")).where("lo <> hi").selectExpr("token", f"k > {LONG} long")
    tagged = scratch.put(tagged.join(apart, "token"))
    cols = ("id", "n", "lev", "most_n", "comp")
    sides = lambda t, *more: [t.selectExpr("token", *(f"{c} {c}{x}" for c in (*cols, *more))) for x in "ab"]
    apt = "ida < idb and compa <> compb and " + _fits(percent).format("na", "nb", "most_na", "most_nb")
    left, right = sides(tagged.where("not long"))
    few = left.join(right, "token").where(apt).selectExpr("ida a", "idb b", "1 m", "least(leva, levb) need")
    # entries of long postings carry the first HEAD of their class's such entries in the global order: a pair whose
    # lists are both whole leaves the join once, at its first common one, and not at all if those are all that it
    # can share and are too few
    heads = tagged.groupBy("id").agg(F.sort_array(F.collect_list(F.expr("if(long, struct(pos, token), null)"))).alias("z"), F.bool_or(F.expr("not long")).alias("others"))
    heads = heads.where("size(z) > 0").selectExpr("id", f"transform(slice(z, 1, {HEAD}), x -> x.token) head", f"size(z) <= {HEAD} whole", "others")
    left, right = sides(tagged.where("long").join(heads, "id"), "head", "whole", "others")
    both = "array_intersect(heada, headb)"
    once = f"if(wholea and wholeb, {both}[0] = token and (size({both}) >= least(leva, levb) or (othersa and othersb)), true)"
    many = left.join(right, "token").where(f"{apt} and {once}").selectExpr("ida a", "idb b", f"if(wholea and wholeb, size({both}), 1) m", "least(leva, levb) need")
    return few.union(many).groupBy("a", "b").agg(F.sum("m").alias("m"), F.first("need").alias("need")).where("m >= need").select("a", "b"), tagged


def jaccard_links(docs: DataFrame, k: int = 5, percent: int = 80, levels: int = 4) -> tuple[DataFrame, DataFrame]:
    """The whole join: (rows, links).

    ``rows``: doc_id, n_shingles, class_id and n_links of every row of ``docs``; rows of equal sets are one class (class_id null: no
    class and no links), and n_links counts the other rows that a row links with, those of its class among them. ``links``: every pair
    (a, b), a < b, of classes that meets the threshold, each verified on the whole sets. Copies are not expanded, but each pair of
    different sets that links is a row, so this is as large as the links are many.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    found, member, index = _index(docs, k, percent, levels, scratch)
    pairs, tagged = _apart(index, None, percent, scratch)
    pairs = scratch.put(pairs)
    scratch.drop(index, tagged)
    wanted = pairs.selectExpr("a id").union(pairs.selectExpr("b id")).distinct()
    links = scratch.put(_verified(pairs, _sets(docs, k, wanted, scratch), percent))
    size = member.groupBy("n", "f1", "f2").agg(F.first("id").alias("id"), F.count("*").alias("size"))
    size = scratch.put(size)
    near = links.union(links.selectExpr("b a", "a b")).join(size.selectExpr("id b", "size"), "b").groupBy("a").agg(F.sum("size").alias("near"))
    size = size.join(near.withColumnRenamed("a", "id"), "id", "left").selectExpr("n", "f1", "f2", "id class_id", "size - 1 + coalesce(near, 0) n_links")
    own = found.where("n > 0 and doc_id is not null").join(size, ["n", "f1", "f2"]).select("doc_id", F.col("n").alias("n_shingles"), "class_id", "n_links")
    none = found.where("n = 0 or doc_id is null").selectExpr("doc_id", "n n_shingles", f"cast(null as {CLASS}) class_id", "0L n_links")
    return own.unionByName(none), links


def jaccard_classes(docs: DataFrame, k: int = 5, percent: int = 80, levels: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text). See the module's text."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    found, member, index = _index(docs, k, percent, levels, scratch)
    repeated = member.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("a", "b")
    # one centre for each posting list: the member with the fewest shingles of its own
    centre = index.groupBy("token").agg(F.min(F.struct(F.expr("n - most_n").alias("own"), "id", "n", "most_n", "lev")).alias("c"))
    stars = index.join(centre.selectExpr("token", "c.id c", "c.n cn", "c.most_n cm", "c.lev cl"), "token").where("id <> c and " + _fits(percent).format("n", "cn", "most_n", "cm"))
    stars = stars.groupBy(F.expr("least(id, c)").alias("a"), F.expr("greatest(id, c)").alias("b")).agg(F.count("*").alias("m"), F.min(F.expr("least(lev, cl)")).alias("need"))
    stars = scratch.put(stars.where("m >= need").select("a", "b"))
    wanted = stars.selectExpr("a id").union(stars.selectExpr("b id")).distinct()
    sets = _sets(docs, k, wanted, scratch)
    links = scratch.put(_verified(stars, sets, percent))
    scratch.drop(sets)
    comp = scratch.put(components(links, scratch))

    pairs, tagged = _apart(index, comp, percent, scratch)
    scratch.drop(index, comp)
    pairs = scratch.put(pairs.join(stars, ["a", "b"], "left_anti"))
    scratch.drop(tagged, stars)
    if not pairs.isEmpty():
        wanted = pairs.selectExpr("a id").union(pairs.selectExpr("b id")).distinct()
        links = links.union(_verified(pairs, _sets(docs, k, wanted, scratch), percent))
    comp = scratch.put(components(links.union(repeated), scratch))
    out = member.join(comp.selectExpr("node id", "component"), "id", "left")
    out = out.groupBy("doc_id").agg(F.min(F.expr("coalesce(component, id).d")).alias("component_id"))
    return found.join(out, "doc_id", "left").selectExpr("doc_id", "n n_shingles", "coalesce(component_id, doc_id) component_id")


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component; rows with a null id stay, rows of one id stay or go together."""
    gone = jaccard_classes(docs, k, percent).where("doc_id <> component_id").select("doc_id")
    return without(docs, gone, Scratch(docs.sparkSession))


def query(spark, sf_dir):
    from strandline.llm._spark import table

    return jaccard_classes(table(spark, sf_dir, "documents"), k=3, percent=90)


#: All pairs that share a shingle, and their closure.
ORACLE_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws FROM documents),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] END s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) n FROM sh GROUP BY 1),
p AS (SELECT a.doc_id a, b.doc_id b, count(*) m FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 90 * (x.n + y.n - m)),
pairs AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS node, a AS reach FROM pairs UNION SELECT r.node, pairs.b FROM r JOIN pairs ON r.reach = pairs.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, least(d.doc_id, min(reach)) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.node = d.doc_id GROUP BY d.doc_id"""
