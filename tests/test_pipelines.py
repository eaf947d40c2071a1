import random

from strandline.__main__ import main
from strandline.plans import pipelines as P
from strandline.schemas import CallParams, DemuxParams
from strandline.sources import sinks


def files(tmp_path):
    rng = random.Random(11)
    ref = "".join(rng.choice("ACGT") for _ in range(600))
    (tmp_path / "ref.fa").write_text(f">chr1 test\n{ref[:300]}\n{ref[300:]}\n")
    alt = ref[:250] + ("A" if ref[250] != "A" else "C") + ref[251:]
    reads = [(alt if i % 2 else ref)[200:400] for i in range(40)]
    (tmp_path / "r.fq").write_text("".join(f"@r{i}\n{s}\n+\n{'I' * 200}\n" for i, s in enumerate(reads)))
    (tmp_path / "panel.yaml").write_text(f"variant_calling:\n  min_depth: 10\ncollapse:\n  max_distance: 0\ntargets:\n  - amplicon_id: AMP\n    chromosome: chr1\n    start: 200\n    end: 400\n    primer_fwd: {ref[200:220]}\n    primer_rev: GGGGGGGGGGGGGGGGGGGG\n    expected_length: 200\n    snp_positions: [250]\n")
    return ref, alt


def test_command_line_panel_and_align(spark, tmp_path, capsys):
    ref, alt = files(tmp_path)
    assert main(["panel", "-c", f"{tmp_path}/panel.yaml", "-i", f"{tmp_path}/r.fq", "-o", f"{tmp_path}/vcf", "-r", f"{tmp_path}/ref.fa", "-s", f"{tmp_path}/stats"]) == 0
    line = [r.line for r in sinks.read_lines(spark, f"{tmp_path}/vcf").collect()][-1].split("\t")
    assert line[:5] == ["chr1", "251", "AMP", ref[250], alt[250]] and line[6] == "PASS" and line[9].startswith("0/1:40:20,20:0.500")
    assert spark.read.json(f"{tmp_path}/stats").first().reads_in == 40
    assert main(["align", "-r", f"{tmp_path}/ref.fa", "-1", f"{tmp_path}/r.fq", "-o", f"{tmp_path}/sam", "--metrics", f"{tmp_path}/m"]) == 0
    rows = [r.line.split("\t") for r in sinks.read_lines(spark, f"{tmp_path}/sam").collect() if not r.line.startswith("@")]
    assert len(rows) == 40 and {r[3] for r in rows} == {"201"} and spark.read.json(f"{tmp_path}/m").first().aligned_reads == 40
    assert main(["align", "-o", "x"]) == 2 and "missing" in capsys.readouterr().err
    assert main(["split", f"{tmp_path}/r.fq", f"{tmp_path}/chunks", "-n", "4"]) == 0
    assert main(["example", f"{tmp_path}/e.yaml"]) == 0


def test_optional_stages(spark, tmp_path):
    ref, alt = files(tmp_path)
    reads = spark.createDataFrame([(i, f"r{i}", "ATCGATCG" + (alt if i % 4 == 0 else ref)[200:400], "I" * 208) for i in range(20)] + [(99, "x", "T" * 100, "I" * 100)], "read_id bigint, name string, sequence string, quality string")
    contigs = spark.createDataFrame([("chr1", 0, ref)], "name string, ordinal int, sequence string")
    targets = spark.createDataFrame([("AMP", "chr1", 200, 400, ref[200:220], "GGGGGGGGGGGGGGGGGGGG", 200, [250], 0)], "amplicon_id string, chromosome string, start bigint, end bigint, primer_fwd string, primer_rev string, expected_length int, snp_positions array<bigint>, ord bigint")
    codes = spark.createDataFrame([("S1", "ATCGATCG", 0)], "sample_id string, barcode string, expected_position int")
    out = P.call_panel(reads, targets, contigs, CallParams(5, 0.01), 0, codes, DemuxParams())
    call = out.calls.first()
    assert (call.depth, call.alt_count, call.genotype, call.known) == (20, 5, "0/1", True)
    back = reads.where("read_id = 99").unionByName(reads.where("read_id < 3").selectExpr("read_id", "name", "reverse(translate(substring(sequence, 9, 100), 'ACGT', 'TGCA')) sequence", "substring(quality, 1, 100) quality"))
    assert P.align_reads(back, contigs).metrics.first().aligned_reads == 0
    both = P.align_reads(back, contigs, both_strands=True)
    assert both.metrics.first().aligned_reads == 3 and {r.start for r in both.alignments.collect()} == {200}
