"""Where texts hold passages of a reference set: the aligner's seeds and chains over documents, as a contamination screen.

    python -m jobs.passage_screen --config jobs/passage_screen.json --documents DOCUMENTS --passages BENCHMARK --out OUT

Reads are screened against contaminants by seeding and chaining; here the texts of ``documents`` are screened against the passages of a
table (item_id, text), such as benchmark items that must not be trained on. A document is cut into overlapping pieces,
each a read; passages are the contigs. Seeds of ``k`` characters, every ``stride`` of them, meet the index of all passages, and a piece keeps
the seed that most others support: later in both texts, within 100 characters of its diagonal. A piece counts from ``support`` such
seeds on, so small edits within a passage cost a few seeds and not the find.

``out`` has one row a document and passage: pieces, seeds, the best chain's score, and the first place of a counted seed
in the document and in the passage (characters, from 0), partitioned by the document's language. Letters A to Z match in
either case. Seeds that more than ``max_hits`` places of the passages share are boilerplate and stand for none.

Documents are read once and never shuffled whole: an index of checked size is broadcast, and only seeds that hit go
on; a larger index is joined by shuffle on the k-mers. A document is known by its doc_id, which must be unique, from 0 and below 2**43; null texts and
ids hold nothing. A null or empty language is its own partition. A run writes the whole output anew, so a rerun
gives the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs._cli import log, main
from strandline.operators import align as A
from strandline.schemas import SeedParams
from strandline.shared import small

PATHS = {"documents": "table of texts (doc_id, text, lang, source)", "passages": "table of passages (item_id, text)", "out": "folder of the finds"}

FINDS = "doc_id bigint, source string, item_id bigint, n_pieces bigint, n_seeds bigint, best_score double, text_at bigint, item_at bigint, part string"

#: A read's id is the document's, times this, and the piece's number.
PIECES = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Settings:
    k: int = 24
    stride: int = 6
    #: Characters of a piece; the next one begins k - 1 characters before it ends.
    piece: int = 300
    max_hits: int = 8
    #: Seeds that must support a piece's best one.
    support: int = 4


def pieces(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """read_id, sequence of every piece of every text. A text of up to ``piece`` characters is one piece."""
    step = settings.piece - settings.k + 1
    rows = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.translate("text", UPPER, LOWER).alias("t"))
    last = F.greatest(F.lit(0), F.ceil((F.length("t") - settings.piece) / step)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substr("t", i * step + 1, F.lit(settings.piece)))
    return rows.select("doc_id", F.posexplode(cut).alias("i", "sequence")).select((F.col("doc_id") * PIECES + F.col("i")).alias("read_id"), "sequence")


def contigs(passages: DataFrame) -> DataFrame:
    """Passages as contigs in the order of their ids; of rows with one id the first text stands for all."""
    texts = passages.where("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    return texts.select(F.col("item_id").cast("string").alias("name"), F.col("item_id").alias("ordinal"), F.translate("text", UPPER, LOWER).alias("sequence"))


def finds(chained: DataFrame, documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row a document and passage of the best seeds of pieces that enough others support."""
    step = settings.piece - settings.k + 1
    least = settings.k * (1 + 0.4 * settings.support)
    kept = chained.where(F.col("chain_score") >= least - 1e-9).withColumn("doc_id", F.expr(f"read_id div {PIECES}"))
    at = F.expr(f"read_id % {PIECES}") * step + F.col("read_offset")
    first = F.min(F.struct(at.alias("text_at"), F.col("position").alias("item_at")))
    per = kept.groupBy("doc_id", F.col("contig").cast("bigint").alias("item_id")).agg(
        F.count("*").alias("n_pieces"), F.sum("n_seeds").cast("bigint").alias("n_seeds"), F.max("chain_score").cast("double").alias("best_score"), first.alias("f"))
    about = documents.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "source")
    out = per.join(about, "doc_id")
    part = F.when(F.coalesce("lang", F.lit("")) == "", "none").otherwise(F.col("lang"))
    return out.select("doc_id", "source", "item_id", "n_pieces", "n_seeds", F.round("best_score", 6).alias("best_score"), "f.text_at", "f.item_at", part.alias("part"))


def run(spark: SparkSession, documents: str, passages: str, out: str, settings: Settings = Settings()) -> int:
    """Write the finds of all documents and return their number."""
    # a k-mer of every ``stride`` places may meet ``max_hits`` passages: no seed of a piece is left out
    params = SeedParams(k=settings.k, stride=settings.stride, max_hits=settings.max_hits, max_seeds=settings.piece * settings.max_hits, letters=None)
    docs = spark.read.parquet(documents)
    own = contigs(spark.read.parquet(passages))
    A.kmer_index(own, params).write.mode("overwrite").parquet(f"{out}/index")
    index = spark.read.parquet(f"{out}/index")
    log.info("read %s: %d passages, %d k-mers", passages, own.count(), index.count())
    hits = A.seeds(pieces(docs, settings), small(index), params)
    found = finds(A.chain(hits, params), docs, settings)
    found.write.mode("overwrite").partitionBy("part").parquet(f"{out}/finds")
    n = read(spark, out).count()
    log.info("read %s: %d documents; wrote %d finds to %s", documents, docs.count(), n, out)
    return n


def read(spark: SparkSession, out: str) -> DataFrame:
    """The finds as they stand."""
    return spark.read.schema(FINDS).parquet(f"{out}/finds")


if __name__ == "__main__":
    main(__doc__, PATHS, Settings, run)
