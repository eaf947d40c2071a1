"""The jobs as queries over the driver tables, with SQL of their output.

A query runs its job twice into one new folder of the cluster's shared one: the second run must change nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import panel_watch, passage_screen
from strandline.plans import registry
from strandline.shared import shared_folder


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def job1_panel_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "panel_watch")
    for _ in range(2):
        panel_watch.run(spark, f"{sf_dir}/events.parquet", f"{sf_dir}/nation.parquet", f"{folder}/out", f"{folder}/checkpoint")
    return panel_watch.read(spark, f"{folder}/out")


def job2_passage_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "passage_screen")
    for _ in range(2):
        passage_screen.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", folder)
    return passage_screen.read(spark, folder)


PANEL_SQL = registry.aligned_sql("""placed1 AS (SELECT contig AS chromosome, start, sequence, quality FROM aligned WHERE score >= 1),
cols AS (SELECT m.chromosome, m.position, m.ref_base, substr(p.sequence, (m.position - p.start)::INT + 1, 1) b, ascii(substr(p.quality, (m.position - p.start)::INT + 1, 1)) - 33 q
 FROM markers m JOIN placed1 p ON p.chromosome = m.chromosome AND m.position BETWEEN p.start AND p.start + length(p.sequence) - 1),
piles AS (SELECT chromosome, position, ref_base, count_if(b = 'A') AS a, count_if(b = 'C') AS c, count_if(b = 'G') AS g, count_if(b = 'T') AS t, count(*) AS depth, count_if(b = ref_base) AS ref_count, round(avg(q), 6) AS mean_quality FROM cols GROUP BY ALL),
alts AS (SELECT chromosome, position, arg_max(b, n * 1000 - ascii(b)) AS alt_base, max(n) AS alt_count FROM (SELECT chromosome, position, b, count(*) AS n FROM cols WHERE b <> ref_base AND b IN ('A', 'C', 'G', 'T') GROUP BY ALL) GROUP BY ALL),
rows1 AS (SELECT p.*, coalesce(x.alt_base, 'N') AS alt_base, coalesce(x.alt_count, 0) AS alt_count, coalesce(x.alt_count, 0) / depth::DOUBLE AS af FROM piles p LEFT JOIN alts x USING (chromosome, position))
SELECT position, ref_base, a AS "A", c AS "C", g AS "G", t AS "T", depth, ref_count, alt_base, alt_count, mean_quality, round(af, 6) AS allele_frequency,
 CASE WHEN depth >= 10 AND af >= 0.01 AND alt_base <> 'N' THEN CASE WHEN af < 0.25 THEN '0/0' WHEN af > 0.75 THEN '1/1' ELSE '0/1' END END AS genotype, depth >= 10 AND af >= 0.01 AND alt_base <> 'N' AS called, chromosome FROM rows1""")

_LOWER = f"translate(text, '{passage_screen.UPPER}', '{passage_screen.LOWER}')"

PASSAGE_SQL = f"""
WITH items AS (SELECT item_id, t, coalesce(sum(length(t)) OVER (ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
 FROM (SELECT item_id, translate(min(text), '{passage_screen.UPPER}', '{passage_screen.LOWER}') AS t FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL GROUP BY 1)),
places AS (SELECT item_id, i AS position, start + i AS gpos, substr(t, i::INT + 1, 24) AS kmer FROM (SELECT item_id, t, start, unnest(range(greatest(0, length(t) - 23))) AS i FROM items)),
idx AS MATERIALIZED (SELECT item_id, position, gpos, kmer FROM (SELECT *, count(*) OVER (PARTITION BY kmer) AS hits FROM places) WHERE hits <= 8),
texts AS (SELECT doc_id, {_LOWER} AS t FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
pieces AS (SELECT doc_id, i AS piece, substr(t, (i * 277)::INT + 1, 300) AS s FROM (SELECT doc_id, t, unnest(range(greatest(0, ceil((length(t) - 300) / 277))::BIGINT + 1)) AS i FROM texts)),
asked AS (SELECT doc_id, piece, o AS read_offset, substr(s, o::INT + 1, 24) AS kmer FROM (SELECT doc_id, piece, s, unnest(range(0, greatest(0, length(s) - 23), 6)) AS o FROM pieces)),
seeds AS MATERIALIZED (SELECT doc_id, piece, read_offset, item_id, position, gpos, row_number() OVER (PARTITION BY doc_id, piece ORDER BY read_offset, gpos) AS ord FROM asked JOIN idx USING (kmer)),
backed AS (SELECT a.doc_id, a.piece, a.ord, any_value(a.read_offset) AS read_offset, any_value(a.item_id) AS item_id, any_value(a.position) AS position, count(b.ord) AS support
 FROM seeds a LEFT JOIN seeds b ON a.doc_id = b.doc_id AND a.piece = b.piece AND b.ord < a.ord AND a.gpos > b.gpos AND a.read_offset > b.read_offset AND abs((a.gpos - b.gpos) - (a.read_offset - b.read_offset)) < 100 GROUP BY a.doc_id, a.piece, a.ord),
chained AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, piece ORDER BY support DESC, ord) AS r, count(*) OVER (PARTITION BY doc_id, piece) AS n_seeds FROM backed) WHERE r = 1 AND support >= 4),
per AS (SELECT doc_id, item_id, count(*) AS n_pieces, sum(n_seeds)::BIGINT AS n_seeds, round((max(support) * 96 + 240) / 10.0::DOUBLE, 6) AS best_score, min(piece * 277 + read_offset) AS text_at,
 arg_min(position, (piece * 277 + read_offset) * 100000 + position) AS item_at FROM chained GROUP BY ALL)
SELECT doc_id, source, item_id::BIGINT AS item_id, n_pieces, n_seeds, best_score, text_at, item_at, coalesce(nullif(lang, ''), 'none') AS part FROM per JOIN documents USING (doc_id)"""


def queries() -> dict:
    return {"job1_panel_watch": job1_panel_watch, "job2_passage_screen": job2_passage_screen}


def oracle_sql() -> dict[str, str]:
    return {"job1_panel_watch": PANEL_SQL, "job2_passage_screen": PASSAGE_SQL}
