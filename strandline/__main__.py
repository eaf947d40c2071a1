"""Command line: ``python -m strandline align|multi|merge|panel|split|example ...``."""

from __future__ import annotations

import argparse
import os
import sys

from strandline.schemas import BandedParams, ChimeraParams, FilterParams, SeedParams, TrimParams


def _session(name: str):
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName(f"strandline {name}").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("strandline")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("align", help="FASTQ to SAM")
    a.add_argument("-c", "--config", help="key=value file; flags override it")
    a.add_argument("-r", "--reference")
    a.add_argument("-1", "--reads1")
    a.add_argument("-2", "--reads2")
    a.add_argument("-o", "--output")
    a.add_argument("-k", "--kmer-size", type=int)
    a.add_argument("--min-mapq", type=int)
    a.add_argument("--metrics", help="folder for run metrics as JSON")
    a.add_argument("--no-sort", action="store_true")
    a.add_argument("--ungapped", action="store_true")
    a.add_argument("--both-strands", action="store_true")
    m = sub.add_parser("multi", help="several FASTQ files to SAM, one folder each, over one index")
    m.add_argument("-r", "--reference", required=True)
    m.add_argument("-i", "--input", required=True, help="folder, glob or comma-separated list")
    m.add_argument("-o", "--output", required=True)
    m.add_argument("-k", "--kmer-size", type=int, default=19)
    m.add_argument("--ungapped", action="store_true")
    g = sub.add_parser("merge", help="several SAM folders to one")
    g.add_argument("-i", "--input", required=True, help="glob of folders")
    g.add_argument("-o", "--output", required=True)
    g.add_argument("-n", "--no-sort", action="store_true")
    b = sub.add_parser("panel", help="amplicon FASTQ to VCF")
    b.add_argument("-c", "--config", required=True, help="panel YAML")
    b.add_argument("-i", "--input", required=True)
    b.add_argument("-o", "--output", required=True)
    b.add_argument("-r", "--reference")
    b.add_argument("-s", "--stats")
    b.add_argument("--sample", default="sample_001")
    b.add_argument("--min-depth", type=int)
    b.add_argument("--min-frequency", type=float)
    b.add_argument("--barcodes", help="CSV of sample_id and barcode: demultiplex first")
    b.add_argument("--trim", action="store_true", help="cut the targets' primers")
    b.add_argument("--chimeras", action="store_true", help="drop chimeric clusters")
    c = sub.add_parser("split", help="FASTQ to chunks")
    c.add_argument("input")
    c.add_argument("output")
    c.add_argument("-n", type=int, default=8)
    c.add_argument("-z", action="store_true", help="gzip the chunks")
    d = sub.add_parser("example", help="write an example panel")
    d.add_argument("path")
    return p


def main(argv: list[str] | None = None) -> int:
    from dataclasses import replace

    from strandline.operators import align as A
    from strandline.plans import pipelines as P
    from strandline.shared import scratch_folder
    from strandline.sources import config as C
    from strandline.sources import fastq as Q
    from strandline.sources import sinks

    args = parser().parse_args(argv)
    if args.command == "example":
        C.write_example(args.path)
        return 0
    spark = _session(args.command)
    if args.command == "merge":
        sinks.merge_sam(spark, args.input, args.output, not args.no_sort)
    elif args.command == "multi":
        contigs, seeds = Q.read_fasta_tiles(spark, args.reference, scratch_folder(spark, "reference")), SeedParams(k=args.kmer_size)
        index = A.kmer_index(contigs, seeds).cache()
        for path in Q._paths(args.input):
            name = os.path.basename(path).split(".")[0]
            out = P.align_reads(Q.read_fastq(spark, path), contigs, seeds, None if args.ungapped else BandedParams(), index=index)
            sinks.write_sam(out.sam, contigs, f"{args.output}/{name}")
        index.unpersist()
    elif args.command == "split":
        sinks.write_chunks(Q.read_fastq(spark, args.input), args.n, args.output, "gzip" if args.z else None)
    elif args.command == "align":
        conf = C.load_pipeline(args.config) if args.config else {}
        get = lambda k: getattr(args, k, None) if getattr(args, k, None) is not None else conf.get(k)
        missing = [k for k in ("reference", "reads1", "output") if not get(k)]
        if missing:
            print(f"missing: {', '.join(missing)}", file=sys.stderr)
            return 2
        reads = Q.read_pairs(spark, get("reads1"), get("reads2")) if get("reads2") else Q.read_fastq(spark, get("reads1"))
        contigs = Q.read_fasta_tiles(spark, get("reference"), scratch_folder(spark, "reference"))
        keep = FilterParams(min_mapq=get("min_mapq")) if get("min_mapq") else None
        out = P.align_reads(reads, contigs, SeedParams(k=get("kmer_size") or 19), None if args.ungapped else BandedParams(), keep, both_strands=args.both_strands)
        sort = not args.no_sort and conf.get("sort", True)
        sinks.write_sam(out.sam.orderBy("rname", "pos", "qname") if sort else out.sam, contigs, get("output"))
        if get("metrics"):
            sinks.write_json(out.metrics, get("metrics"))
    else:
        panel = C.load_panel(args.config)
        if found := C.problems(panel):
            print("\n".join(found), file=sys.stderr)
            return 2
        call = panel.call
        call = replace(call, min_depth=args.min_depth) if args.min_depth is not None else call
        call = replace(call, min_allele_frequency=args.min_frequency) if args.min_frequency is not None else call
        contigs = Q.read_fasta_tiles(spark, args.reference or panel.reference, scratch_folder(spark, "reference"))
        codes = C.read_barcodes(spark, args.barcodes).select("sample_id", "barcode", "expected_position") if args.barcodes else None
        optional = {"barcodes": codes, "trim": TrimParams() if args.trim else None, "chimeras": ChimeraParams() if args.chimeras else None}
        out = P.call_panel(Q.read_fastq(spark, args.input), C.targets_frame(spark, panel), contigs, call, panel.max_distance, **optional)
        sinks.write_vcf(out.calls, [args.sample], args.output, args.reference or panel.reference)
        if args.stats:
            sinks.write_json(out.stats, args.stats)
    return 0


if __name__ == "__main__":
    sys.exit(main())
