import itertools
import random

from strandline.operators import align as A
from strandline.operators import amplicon as M
from strandline.schemas import ChimeraParams, DemuxParams, FilterParams, SeedParams

READS = "read_id bigint, name string, sequence string, quality string"


def reads(spark, seqs, quality="I"):
    return spark.createDataFrame([(i, f"r{i}", s, quality * len(s)) for i, s in enumerate(seqs)], READS)


def test_collapse_and_merge(spark):
    r = reads(spark, ["ACGTACGTACGTACGT"] * 10 + ["ACGTACGTACGTACGG"] * 5)
    exact = M.collapse_exact(r)
    assert sorted((x.consensus_sequence, x.read_count, x.avg_quality) for x in exact.collect()) == [("ACGTACGTACGTACGG", 5, 40.0), ("ACGTACGTACGTACGT", 10, 40.0)]
    merged = M.merge_similar(exact, 2).collect()
    assert [(x.consensus_sequence, x.read_count, x.read_ids) for x in merged] == [("ACGTACGTACGTACGT", 15, list(range(15)))]
    stats = M.collapse_stats(r, M.merge_similar(exact, 2)).first()
    assert (stats.reads_in, stats.clusters_out, stats.compression_ratio) == (15, 1, 15.0)


def test_merge_takes_the_greatest_quality(spark):
    r = spark.createDataFrame([(0, "a", "ACG", "!I!"), (1, "b", "ACG", "5!5"), (2, "c", "ACG", "~~")], READS)
    x = M.collapse_exact(r).first()
    assert x.consensus_quality == "5I5" and x.read_ids == [0, 1, 2]


def test_greedy_merge_against_a_sequential_one(spark):
    rng = random.Random(5)
    seqs = ["".join(rng.choice("AC") for _ in range(8)) for _ in range(120)] + ["A" * 5, "A" * 4 + "C"]
    counts = {s: seqs.count(s) for s in seqs}
    order = sorted(counts, key=lambda s: (-counts[s], s))
    want, gone = {}, set()
    for i, s in enumerate(order):
        if s in gone:
            continue
        want[s] = counts[s]
        for t in order[i + 1 :]:
            if t not in gone and t not in want and len(t) == len(s) and sum(x != y for x, y in zip(s, t)) <= 1:
                gone.add(t)
                want[s] += counts[t]
    got = {x.consensus_sequence: x.read_count for x in M.merge_similar(M.collapse_exact(reads(spark, seqs)), 1).collect()}
    assert got == want


def test_assign(spark):
    c = spark.createDataFrame([("ACGTACGT" + "N" * 16, 10), ("TGCATGCA" + "N" * 15, 8), ("N" * 20, 5), ("C" * 190, 3)], "consensus_sequence string, read_count bigint")
    t = spark.createDataFrame([("AMP_001", "chr1", 1000, 1200, "ACGTACGT", "GCTAGCTA", 200, [1050], 0), ("AMP_002", "chr2", 2000, 2200, "TGCATGCA", "ATCGATCG", 200, [2100], 1)], "amplicon_id string, chromosome string, start bigint, end bigint, primer_fwd string, primer_rev string, expected_length int, snp_positions array<bigint>, ord bigint")
    got = {x.consensus_sequence[:4] + str(len(x.consensus_sequence)): x.amplicon_id for x in M.assign(c, t).collect()}
    assert got == {"ACGT24": "AMP_001", "TGCA23": "AMP_002", "NNNN20": None, "CCCC190": "AMP_001"}
    assert M.assignment_rate(M.assign(c, t)).first().assignment_rate == 0.75


def test_demultiplex(spark):
    tail = "ACTGACTGACTGACTG"
    r = reads(spark, ["ATCGATCG" + tail, "ATCGTTCG" + tail, "GCTAGCTA" + tail, "TTTTTTTT" + "C" * 16])
    b = spark.createDataFrame([("Sample1", "ATCGATCG", 0), ("Sample2", "GCTAGCTA", 0)], "sample_id string, barcode string, expected_position int")
    got = {x.read_id: x for x in M.demultiplex(r, b).collect()}
    # these two codes are near their own reverse complements' codes: ATCGATCG reads CGATCGAT, and GCTAGCTA reads TAGCTAGC
    assert [got[i].sample_id for i in range(4)] == ["Sample1", "Sample1", "Sample2", None]
    assert [got[i].mismatches for i in range(3)] == [0, 1, 0] and got[0].trimmed == tail
    s = M.demux_stats(M.demultiplex(r, b)).first()
    assert (s.total, s.assigned, s.unassigned) == (4, 3, 1)
    low = M.demultiplex(reads(spark, ["ATCGATCG" + tail], "#"), b, DemuxParams()).first()
    assert low.status == "qc_failed" and low.sample_id is None
    assert {x.bin: x.n_reads for x in M.reads_per_bin(M.demultiplex(r, b)).collect()} == {"Sample1": 2, "Sample2": 1, "unassigned": 1}


def test_trim(spark):
    t = spark.createDataFrame([("A", "ACGTACGTAC", "GGGGGCCCCA", 0), ("B", "TTTTTGGGGGAA", "CCCCCCCCCCCC", 1)], "amplicon_id string, primer_fwd string, primer_rev string, ord bigint")
    r = reads(spark, ["ACGTACGTACTATATATATATATATATATATTGGGGCCCCC", "TATATATATA", "TTTTTGGGGGAATATATATATA"])
    got = {x.read_id: x for x in M.trim_primers(r, t).collect()}
    assert got[0].trimmed_sequence == "TA" * 10 + "T" and got[0].bases_trimmed == 20 and got[0].fwd_found and got[0].rev_found
    assert got[1].trimmed_sequence == "TATATATATA" and not got[1].fwd_found
    assert got[2].trimmed_sequence == "TATATATATA" and len(got[2].trimmed_quality) == 10  # the second target's primer has its own length
    s = M.trim_stats(M.trim_primers(r, t)).first()
    assert (s.total, s.fwd, s.rev, s.both, s.neither) == (3, 2, 1, 1, 1)


def test_chimeras(spark):
    a, b = "A" * 80, "T" * 80
    parents = spark.createDataFrame([(1, a, 500), (2, b, 400)], "ord int, sequence string, abundance bigint")
    q = spark.createDataFrame([(1, "A" * 40 + "T" * 40, 10), (2, "G" * 80, 10), (3, "A" * 28, 10), (4, "A" * 40 + "T" * 40, 300)], "id bigint, sequence string, abundance bigint")
    d = {x.id: x for x in M.chimera_de_novo(q, parents).collect()}
    assert d[1].is_chimera and d[1].distance == 0 and d[1].breakpoint == 40
    assert not d[2].is_chimera and not d[3].is_chimera and not d[4].is_chimera  # short; and not abundant enough parents
    r = {x.id: x.is_chimera for x in M.chimera_reference(q, parents).collect()}
    assert r == {1: True, 2: False, 3: False, 4: True}
    found = M.detect_chimeras(q, parents, parents)
    assert {x.id: (x.method, x.confidence) for x in found.collect()} == {1: ("de_novo", 0.95), 2: (None, 0.0), 3: (None, 0.0), 4: ("reference", 0.90)}
    assert sorted(x.id for x in M.filter_chimeras(q, found).collect()) == [2, 3]
    assert M.chimera_stats(found).first().found == 2
    short = spark.createDataFrame([(1, "A" * 20, 500), (2, "T" * 20, 400)], "ord int, sequence string, abundance bigint")
    assert not any(x.is_chimera for x in M.chimera_de_novo(q, short, ChimeraParams()).collect())


def test_joint(spark):
    v = spark.createDataFrame([("Sample1", "A", "chr1", 12345, "A", "G", 0.5, 100), ("Sample2", "A", "chr1", 12345, "A", "G", 0.95, 150), ("Sample2", "A", "chr2", 12345, "C", "T", 0.5, 20)], "sample_id string, amplicon_id string, chromosome string, position bigint, ref_allele string, alt_allele string, allele_frequency double, total_depth bigint")
    g = M.joint_genotypes(v, v.select("sample_id").distinct())
    assert {(x.chromosome, x.sample_id): x.genotype for x in g.collect()} == {("chr1", "Sample1"): "0/1", ("chr1", "Sample2"): "1/1", ("chr2", "Sample1"): "./.", ("chr2", "Sample2"): "0/1"}
    assert {x.chromosome: (x.ac, x.an, x.dp, x.af) for x in M.allele_counts(g).collect()} == {"chr1": (3, 4, 250, 0.75), "chr2": (1, 2, 20, 0.5)}


def test_pileup_counts_every_base(spark):
    al = spark.createDataFrame([("c", 0, "ACGT", "IIII", 3), ("c", 2, "TNAA", "5555", 2), ("c", 511, "GG", "II", 1)], "chromosome string, start bigint, sequence string, quality string, read_count int")
    mk = spark.createDataFrame([("c", 2, "G"), ("c", 3, "T"), ("c", 512, "A"), ("c", 90, "A")], "chromosome string, position bigint, ref_base string")
    got = {x.position: x for x in M.pileup(al, mk).collect()}
    assert sorted(got) == [2, 3, 512]
    assert (got[2].depth, got[2].ref_count, got[2].alt_base, got[2].alt_count, got[2].quality_sum) == (5, 3, "T", 2, 3 * 40 + 2 * 20)
    assert (got[3].depth, got[3].ref_count, got[3].alt_base, got[3].other_count) == (5, 3, "N", 2)
    assert (got[512].alt_base, got[512].alt_count) == ("G", 1)


def test_coverage(spark):
    cov = spark.createDataFrame([("a", 1500), ("b", 900)], "amplicon_id string, depth bigint")
    assert M.has_coverage(cov, 900).first().sufficient and not M.has_coverage(cov, 1000).first().sufficient
    assert not M.has_coverage(cov.where("false")).first().sufficient


def test_splits():
    for total, n in itertools.product((0, 7, 10_000), (1, 3, 7)):
        parts = M.even_split(total, n)
        assert sum(s for _, s in parts) == total and max(s for _, s in parts) - min(s for _, s in parts) <= 1
        weighted = M.weighted_split(total, list(range(1, n + 1)))
        assert sum(s for _, s in weighted) == total and [a for a, _ in weighted] == [sum(s for _, s in weighted[:i]) for i in range(n)]


def test_seeding_chain_and_alignment(spark):
    rng = random.Random(3)
    ref = ["".join(rng.choice("ACGT") for _ in range(400)) for _ in range(2)]
    contigs = spark.createDataFrame([(f"c{i}", i, s) for i, s in enumerate(ref)], "name string, ordinal int, sequence string")
    cut = [(0, 10), (1, 250), (0, 300)]
    seqs = [ref[c][p : p + 80] for c, p in cut]
    seqs[1] = seqs[1][:40] + ("A" if seqs[1][40] != "A" else "C") + seqs[1][41:]
    r = reads(spark, [*seqs, "N" * 80])
    found = A.seeds(r, A.kmer_index(contigs))
    chained = A.chain(found)
    got = {x.read_id: x for x in A.place_ungapped(r, chained, contigs).collect()}
    assert {i: (x.contig, x.start, x.mismatches) for i, x in got.items()} == {0: ("c0", 10, 0), 1: ("c1", 250, 1), 2: ("c0", 300, 0)}
    banded = {x.read_id: x for x in A.place_banded(r, chained, contigs).collect()}
    assert {i: (x.contig, x.start, x.score) for i, x in banded.items()} == {0: ("c0", 10, 80), 1: ("c1", 250, 79 - 4), 2: ("c0", 300, 80)}
    sam = {x.read_id: x for x in A.sam_rows(r, A.place_ungapped(r, chained, contigs)).collect()}
    assert sam[3].flag == 4 and sam[3].rname == "*" and sam[3].pos == 0 and sam[0].pos == 11 and sam[0].cigar == "80M"
    assert {x.read_id for x in A.contains_exactly(r, contigs).collect()} == {0, 2}
    assert A.subsequence(contigs, 390, 20).first().sequence == ref[0][390:] + ref[1][:10]
    at = A.locate(spark.createDataFrame([(0,), (399,), (400,), (800,)], "gpos bigint"), contigs, 64).collect()
    assert {x.gpos: (x.contig, x.offset) for x in at} == {0: ("c0", 0), 399: ("c0", 399), 400: ("c1", 0), 800: (None, None)}


def test_repetitive_kmers_leave_the_index(spark):
    contigs = spark.createDataFrame([("c", 0, "A" * 60)], "name string, ordinal int, sequence string")
    assert A.kmer_index(contigs, SeedParams()).count() == 0
    assert A.seeds(reads(spark, ["A" * 40]), A.kmer_index(contigs)).count() == 0


def test_filters_flags_and_pairs(spark):
    rows = spark.createDataFrame([(1, 0, 100, 60, 50, 0), (2, 1, 100, 10, 0, 256), (3, 2, 300, 60, 80, 1024)], "read_id bigint, ord int, gpos bigint, mapq int, score int, flag int")
    assert [x.read_id for x in A.filter_by_quality(rows, FilterParams(30, 1, True, True)).orderBy("read_id").collect()] == [1, 3]
    assert [x.read_id for x in A.compact(rows).collect()] == [1] and A.mapped(rows).count() == 2
    assert A.statistics(rows.where("false")).first().mean_mapq == 0.0 and A.run_metrics(rows.where("false")).first().alignment_rate == 0.0
    dup = spark.createDataFrame([(1, 0, 100, 60, 0), (1, 1, 100, 50, 0), (2, 0, 100, 40, 0)], "read_id bigint, ord int, gpos bigint, mapq int, flag int")
    assert {(x.read_id, x.ord): x.flag for x in A.mark_duplicates(dup).collect()} == {(1, 0): 0, (1, 1): 1024, (2, 0): 0}
    assert {(x.read_id, x.ord): x.flag for x in A.mark_duplicates(dup, "position").collect()} == {(1, 0): 0, (1, 1): 1024, (2, 0): 1024}
    mates = spark.createDataFrame([(0, 1, 100, 10, 0), (0, 2, 500, 10, 0), (1, 1, 100, 10, 0), (1, 2, 150, 10, 0), (2, 1, 100, 0, 0), (2, 2, 500, 10, 0), (3, 1, 5, 9, 0)], "pair_id bigint, mate int, gpos bigint, score int, flag int")
    assert {(x.pair_id, x.mate) for x in A.validate_pairs(mates).collect() if x.flag == 2} == {(0, 1), (0, 2)}
