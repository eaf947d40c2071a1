"""FASTA in byte ranges against a reader of whole files, at every place where a range can begin."""

import gzip
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.operators import align as A
from strandline.sources import fastq, sinks

LINE = st.one_of(st.text("ACGTNacgt", max_size=9), st.sampled_from(["", ">a", ">b more words", ">c\t", ">", "AC GT ", "\t"]))


def joined(text: bytes, cuts: list[int]):
    """Contigs of a file that is read in the given ranges: (name, bases) a header, with the bases put together by section and offset."""
    out = []
    edges = [0, *cuts, len(text)]
    for start, end in zip(edges, edges[1:]):
        seen = 0
        for section, name, at, bases in fastq.fasta_sections(io.BytesIO(text), start, end):
            if name is not None:
                out.append([name, b""])
                seen = section
            elif section == seen == 0 or section == seen:
                if out:
                    mine = sum(len(b) for s, n, o, b in [(section, name, at, bases)])
                    assert mine and (section == 0 or at == len(out[-1][1]))
                    out[-1][1] += bases
            else:
                raise AssertionError("a section without its header")
    return [tuple(x) for x in out]


def whole(text: bytes):
    out = []
    for line in text.split(b"\n"):
        if line.startswith(b">"):
            out.append([line[1:].rstrip(b" \t\r\v\f").decode().split(" ")[0], b""])
        elif out:
            out[-1][1] += b"".join(line.split())
    return [tuple(x) for x in out]


@settings(max_examples=200, deadline=None)
@given(st.lists(LINE, max_size=12), st.sampled_from(["\n", "\r\n"]), st.booleans(), st.lists(st.integers(0, 80), max_size=4))
def test_ranges_read_what_the_file_says(lines, end, closed, cuts):
    text = (end.join(lines) + (end if closed else "")).encode()
    assert joined(text, sorted({c for c in cuts if 0 < c < len(text)})) == whole(text)


def test_every_single_cut(monkeypatch):
    text = b"AC\n\n>one two\r\nACGT\nAC\n>\n>three\nGG GG\n\nTTTTTTTTTT\n>end"
    for block, piece in ((1 << 20, 1 << 16), (3, 2), (1, 1)):
        monkeypatch.setattr(fastq, "BLOCK", block)
        monkeypatch.setattr(fastq, "PIECE", piece)
        for cut in range(1, len(text)):
            assert joined(text, [cut]) == whole(text), (block, cut)
        assert joined(text, list(range(1, len(text)))) == whole(text)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    return {f"c{i}": "".join(rng.choice("ACGT") for _ in range(n)) for i, n in enumerate((3000, 1, 100, 777, 0, 64))}


def write(path, texts, width):
    with open(path, "w") as f:
        for name, s in texts.items():
            f.write(f">{name} described\n" + "".join(s[i : i + width] + "\n" for i in range(0, len(s), width)))


@pytest.mark.parametrize("width, split", [(60, 500), (10**6, 333), (7, 1 << 20)])
def test_tiles_from_files_are_those_of_whole_contigs(spark, tmp_path, texts, width, split):
    items = list(texts.items())
    write(tmp_path / "a.fa", dict(items[:3]), width)
    write(tmp_path / "b.fa", dict(items[3:]), width)
    got = fastq.read_fasta_tiles(spark, f"{tmp_path}/*.fa", str(tmp_path / "index"), tile=64, split=split)
    contigs = fastq.read_fasta(spark, f"{tmp_path}/*.fa")
    key = lambda df: sorted(map(tuple, df.select("name", "tile", "piece").collect()))
    assert key(A.tiles(got, 64)) == key(A.tiles(contigs, 64).where("piece <> ''"))
    starts = lambda df: [(r.name, r.length, r.start) for r in A.contig_starts(df).orderBy("ordinal", "name").collect()]
    assert [x for x in starts(contigs) if x[1]] == starts(got)
    assert sinks.sam_header(got) == [x for x in sinks.sam_header(contigs) if not x.endswith("LN:0")]
    for at, n in ((0, 10), (60, 10), (2990, 300), (0, 10_000), (5000, 5)):
        assert A.subsequence(got, at, n, 64).collect() == A.subsequence(contigs, at, n, 64).collect() == [("".join(texts.values())[at : at + n],)]
    widest = spark.read.parquet(str(tmp_path / "index/tiles")).agg(F.max(F.length("piece"))).first()[0]
    assert widest <= 128
    with pytest.raises(Exception, match="tiles of another size"):
        A.tiles(got, 65).collect()


def test_gzip_and_repeated_names(spark, tmp_path):
    with gzip.open(tmp_path / "a.fa.gz", "wt") as f:
        f.write(">x\nAAAA\n>y\nCC\nCC\n>x\nGGG\n")
    got = fastq.read_fasta_tiles(spark, f"{tmp_path}/a.fa.gz", str(tmp_path / "index"), tile=3)
    assert sorted((r.name, r.tile, r.piece, r.length) for r in got.collect()) == [("x", 0, "GGG", 3), ("y", 0, "CCCC", 4), ("y", 1, "C", 4)]
    assert [r.name for r in A.contig_starts(got).orderBy("ordinal").collect()] == ["x", "y"]
