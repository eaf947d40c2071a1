"""Mixing sources to target weights by iterative proportional fitting.

Token weights are summed by cell (source, language, topic). The target share of every source,
language and topic is a power of its share in the corpus (``tempers``; 1 keeps it, 0 makes all
equal), unless a table of targets is given: rows (dim, level, share), where dim is source, lang or
topic; levels of a dim that the table has are held to its shares (a level without one gets none), other
dims to their powers. Raking scales the cells to one marginal after another
for ``rounds`` rounds, and documents are sampled with probability min(1, rate * fitted / present
weight of their cell); ``importance`` corrects cells where that would exceed 1. With ``exact`` the
sample has the marginals without weights: the rate is lowered until every level of a dim can give its share, but for
the scarcest ones that together hold under ``RARE`` of the corpus. These give all that they have, and what they lack is dealt to
the other levels in proportion, so a rare level costs the sample no more than its own share. The raking is bounded: a cell that would give more
than it has gives all, and the other cells of its levels make up for it. The draw is a hash
of doc_id, so it does not depend on partitions and repeated ids share their fate.

Everything is DataFrame and SQL functions. Raking works on cells, never on documents: up to ``CELLS`` of
them in one partition, more by aggregates and joins on the levels, with the same results. A null source
or lang is the level "(none)", null texts weigh one token, a null doc_id is drawn like the id "null".
Repeated rows weigh and are drawn like others. An empty table gives no rows. All columns of the documents
stay as they are; of the added columns one whose name a document's column has gets underscores behind it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm._spark import Scratch, small, table

ROUNDS = 12
RATE = 0.5
TEMPERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}

#: Rounds of a plan; more of them in one plan take the driver's memory.
STEP = 2

#: Up to so many cells (some 100 bytes each) are raked in one partition, without a shuffle.
CELLS = 200_000

#: About four bytes a token; whole texts count.
TOKENS = "greatest(1L, cast((coalesce(octet_length(text), 0) + 3) div 4 as bigint))"

TOPIC = """case when text is null or text = '' then 'empty'
 when contains(text, ' | ') then 'table'
 when rlike(text, '(?i)licen[sc]e|rights reserved|copyright') then 'legal'
 when rlike(text, '[!#$%&*]{2}') then 'noise'
 else 'prose' end"""

KEYS = ("m_source", "m_lang", "m_topic")
ADDED = (*KEYS, "m_tokens", "probability", "importance")


def names(docs: DataFrame) -> dict[str, str]:
    """The added columns' names beside those of ``docs``, which Spark tells apart without regard to case."""
    taken, out = {c.lower() for c in docs.columns}, {}
    for name in ADDED:
        out[name] = name
        while out[name].lower() in taken:
            out[name] += "_"
        taken.add(out[name].lower())
    return out


def levels(docs: DataFrame) -> DataFrame:
    n = names(docs)
    return docs.withColumns({n["m_source"]: F.expr("coalesce(source, '(none)')"), n["m_lang"]: F.expr("coalesce(lang, '(none)')"), n["m_topic"]: F.expr(TOPIC), n["m_tokens"]: F.expr(TOKENS)})


def _given(cells: DataFrame, targets: DataFrame, dim: str, scratch: Scratch) -> DataFrame:
    """(m_dim, t_dim) from the table; a share that no document can fill is an error, not left out in silence."""
    want = targets.where(f"dim = '{dim}'").selectExpr(f"coalesce(level, '(none)') m_{dim}", "cast(share as double) share")
    want = scratch.put(want.groupBy(f"m_{dim}").agg(F.sum("share").alias("share")))
    absent = want.where("share > 0").join(cells, f"m_{dim}", "left_anti").limit(5).collect()
    total = want.agg(F.sum("share")).first()[0]
    if absent or want.where("share is null or share < 0").count() or not total:
        raise ValueError(f"infeasible targets for {dim}: {[r[0] for r in absent] or 'shares must be positive numbers'}")
    return want.selectExpr(f"m_{dim}", f"share / {float(total)!r}D t_{dim}")


def _scaled(cells: DataFrame, dim: str, total) -> DataFrame:
    """Cells whose fitted weights are scaled to the targets of a dim; ``total`` is the present weight of the cell's level."""
    return cells.withColumn("fit", F.coalesce(F.try_divide(F.expr(f"fit * t_{dim} * grand"), total), F.lit(0.0)))


#: Levels that together hold under so much of the corpus do not lower the rate of an exact sample.
RARE = 0.01

#: A cell counts as used up from this share of its weight on.
FULL = 1 - 1e-9


def _bearable(want: DataFrame, dim: str, grand: float) -> float | None:
    """The largest rate at which every level (m_dim, t_dim, w) can give its share, the scarcest and rarest aside. The window over all rows
    holds levels, not documents."""
    scarce = want.where(f"t_{dim} > 0").withColumn("a", F.expr(f"w / (t_{dim} * {grand!r}D)"))
    held = F.sum("w").over(Window.orderBy("a", f"m_{dim}").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return scarce.withColumn("held", held).where(f"held > {RARE * grand!r}D").agg(F.min("a")).first()[0]


def _reachable(want: DataFrame, dim: str, rate: float, grand: float, scratch: Scratch) -> DataFrame:
    """Target shares (m_dim, t_dim, w) of a sample of ``rate`` of the weight, none above what its level has: what levels
    lack is dealt to the others in proportion, until no other level lacks any."""
    want = scratch.put(want.withColumn("most", F.expr(f"w / {rate * grand!r}D")).withColumn("all_of_it", F.lit(False)))
    scale, more = 1.0, True
    while more:
        used, left = want.agg(F.sum(F.when(F.col("all_of_it"), F.col("most"))), F.sum(F.when(~F.col("all_of_it"), F.col(f"t_{dim}")))).first()
        scale = max(0.0, 1 - (used or 0.0)) / left if left else 0.0
        lacking = F.expr(f"not all_of_it and t_{dim} * {scale!r}D > most")
        more = not want.where(lacking).isEmpty()
        if more:
            old, want = want, scratch.put(want.withColumn("all_of_it", F.col("all_of_it") | lacking))
            scratch.drop(old)
    return want.selectExpr(f"m_{dim}", f"if(all_of_it, most, t_{dim} * {scale!r}D) t_{dim}")


def _bounded(cells: DataFrame, dim: str, total, full) -> DataFrame:
    """As ``_scaled`` in the sample's weights, which stay within the cells' own: a level that has too much shrinks in all its
    cells, and one that lacks some grows in those that are not used up. ``full`` is the weight of the used-up ones."""
    cells = cells.withColumns({"total": total, "full": full})
    want = f"t_{dim} * grand"
    grown = f"if(fit >= w * {FULL!r}D or total <= full, least(fit, w), least(w, fit * ({want} - full) / (total - full)))"
    return cells.withColumn("fit", F.expr(f"if(total >= {want}, coalesce(try_divide(fit * {want}, total), 0D), {grown})")).drop("total", "full")


def rake(cells: DataFrame, tempers: dict[str, float], rounds: int, scratch: Scratch, targets: DataFrame | None = None, in_one: int = CELLS, rate: float | None = None) -> DataFrame:
    """Cells (m_source, m_lang, m_topic, w) with their fitted weight ``fit``: of the whole, or with ``rate`` of a sample of that
    share of it or the largest below it that levels can bear, at most ``w``."""
    dims = list(tempers)
    # the cells are written first, so that texts are read once
    cells = scratch.put(cells.withColumn("fit", F.col("w").cast("double")))
    whole = cells.limit(in_one + 1).count() <= in_one
    cells = cells.coalesce(1) if whole else cells
    grand = cells.agg(F.sum("w").cast("double").alias("grand")).first()["grand"] or 0.0
    given = {r[0] for r in targets.select("dim").distinct().collect()} if targets is not None else set()
    if given - set(dims):
        raise ValueError(f"targets for {sorted(map(str, given - set(dims)))}, which are not among {dims}")
    base, wants = cells, {}
    for dim in dims:
        if dim in given:
            want = _given(base, targets, dim, scratch)
        else:
            want = scratch.put(base.groupBy(f"m_{dim}").agg(F.pow(F.sum("w").cast("double"), F.lit(float(tempers[dim]))).alias("p")))
            total = want.agg(F.sum("p")).first()[0] or 1.0
            want = want.selectExpr(f"m_{dim}", f"p / {float(total)!r}D t_{dim}")
        if rate:
            own = base.groupBy(f"m_{dim}").agg(F.sum("w").cast("double").alias("w"))
            want = scratch.put(own.join(want, f"m_{dim}", "left").fillna(0.0, [f"t_{dim}"]))
            rate = min(rate, _bearable(want, dim, float(grand)) or rate)
        wants[dim] = want
    if rate is not None:
        cells = cells.withColumn("fit", F.col("fit") * F.lit(float(rate)))
    for dim, want in wants.items():
        if rate:
            want = _reachable(want, dim, float(rate), float(grand), scratch)
        cells = cells.join(small(want), f"m_{dim}", "left").fillna(0.0, [f"t_{dim}"])
    cells = scratch.put(cells.withColumn("grand", F.lit(float(grand) * (1.0 if rate is None else float(rate)))))
    used_up = F.when(F.col("fit") >= F.col("w") * FULL, F.col("fit")).otherwise(0.0)
    for r in range(rounds):
        cells = cells.coalesce(1) if whole and r % STEP == 0 else cells
        for dim in dims:
            if whole:  # one partition needs no exchange for its windows
                level = Window.partitionBy(f"m_{dim}")
                total, full = F.sum("fit").over(level), F.sum(used_up).over(level)
            else:  # a level of any number of cells is summed before it is shuffled
                sums = scratch.put(cells.groupBy(f"m_{dim}").agg(F.sum("fit").alias("s"), F.sum(used_up).alias("u")))
                cells, total, full = cells.join(small(sums), f"m_{dim}"), F.col("s"), F.col("u")
            cells = (_scaled(cells, dim, total) if rate is None else _bounded(cells, dim, total, full)).drop("s", "u")
        if not whole or r % STEP == STEP - 1 or r + 1 == rounds:
            old, cells = cells, scratch.put(cells)
            scratch.drop(old)
    return cells


def mix(docs: DataFrame, tempers: dict[str, float] | None = None, rounds: int = ROUNDS, rate: float = RATE, targets: DataFrame | None = None, exact: bool = False) -> DataFrame:
    """Sampled rows of ``docs`` with m_source, m_lang, m_topic, m_tokens, probability and importance."""
    tempers, scratch, n = tempers or TEMPERS, Scratch(docs.sparkSession), names(docs)
    found = levels(docs)
    cells = found.groupBy(*(F.col(n[k]).alias(k) for k in KEYS)).agg(F.sum(n["m_tokens"]).alias("w"))
    fitted = rake(cells, tempers, rounds, scratch, targets, rate=min(1.0, rate) if exact else None)
    ratio = "fit / w" if exact else f"{float(rate)!r}D * fit / w"
    chance = {n["probability"]: f"round(least(1D, {ratio}), 9)", n["importance"]: f"round(greatest(1D, {ratio}), 6)"}
    fitted = small(fitted).select(*(F.col(k).alias(n[k]) for k in KEYS), *(F.expr(e).alias(c) for c, e in chance.items()))
    draw = "cast(conv(substr(md5(cast(concat('mix-', coalesce(cast(doc_id as string), 'null')) as binary)), 1, 8), 16, 10) as bigint) / 4294967296D"
    out = found.join(fitted, [n[k] for k in KEYS]).where(F.expr(draw) < F.col(n["probability"]))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), *(n[x] for x in ADDED))


def query(spark, sf_dir):
    out = mix(table(spark, sf_dir, "documents"))
    return out.selectExpr("doc_id", "m_source source", "m_lang lang", "m_topic topic", "m_tokens tokens", "probability", "importance")


def _oracle() -> str:
    parts = ["""f AS (SELECT doc_id, coalesce(source, '(none)') m_source, coalesce(lang, '(none)') m_lang,
 CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN contains(text, ' | ') THEN 'table'
 WHEN regexp_matches(text, '(?i)licen[sc]e|rights reserved|copyright') THEN 'legal'
 WHEN regexp_matches(text, '[!#$%&*]{2}') THEN 'noise' ELSE 'prose' END m_topic,
 greatest(1, (coalesce(strlen(text), 0) + 3) // 4)::BIGINT m_tokens FROM documents)""",
             "c AS (SELECT m_source, m_lang, m_topic, sum(m_tokens)::BIGINT w FROM f GROUP BY ALL)"]
    for dim, power in TEMPERS.items():
        parts.append(f"t_{dim} AS (SELECT m_{dim}, p / sum(p) OVER () t_{dim} FROM (SELECT m_{dim}, pow(sum(w)::DOUBLE, {power}) p FROM c GROUP BY 1))")
    parts.append("r0 AS MATERIALIZED (SELECT *, w::DOUBLE fit, (SELECT sum(w)::DOUBLE FROM c) grand FROM c JOIN t_source USING (m_source) JOIN t_lang USING (m_lang) JOIN t_topic USING (m_topic))")
    n = 0
    for _ in range(ROUNDS):
        for dim in TEMPERS:
            parts.append(f"r{n + 1} AS MATERIALIZED (SELECT * REPLACE (fit * t_{dim} * grand / sum(fit) OVER (PARTITION BY m_{dim}) AS fit) FROM r{n})")
            n += 1
    parts.append(f"z AS (SELECT m_source, m_lang, m_topic, round(least(1.0, {RATE} * fit / w), 9) probability, round(greatest(1.0, {RATE} * fit / w), 6) importance FROM r{n})")
    return "WITH " + ",\n".join(parts) + """
SELECT doc_id, m_source AS source, m_lang AS lang, m_topic AS topic, m_tokens AS tokens, probability, importance
FROM f JOIN z USING (m_source, m_lang, m_topic)
WHERE ('0x' || substr(md5('mix-' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296::DOUBLE < probability"""


ORACLE_SQL = _oracle()
