"""FASTQ and FASTA as Spark data sources.

``register(spark)`` adds the formats ``fastq``, ``fasta`` and ``fasta_pieces`` (batch) and ``fastq_tail`` (streaming). A plain FASTQ file of more than
``split`` bytes is read in byte ranges, each from the first record that begins in it; gzip files, and modes that depend on what
stands before, are one partition a file. Rows go to Spark in Arrow batches. ``mode`` is ``fail`` (default), ``truncate`` (a
malformed record ends its file) or ``skip``. Files lie in a folder that all machines mount.
"""

from __future__ import annotations

import glob
import gzip
import itertools
import os
from collections.abc import Iterator

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from strandline.shared import scratch_folder, small


def _open(path: str):
    return gzip.open(path, "rt", newline="") if path.endswith(".gz") else open(path, newline="")


def _paths(pattern: str) -> list[str]:
    """Files of a path, folder or glob, by name; folders give their FASTQ-like files only."""
    found = []
    for part in pattern.split(","):
        if os.path.isdir(part):
            found += [os.path.join(part, f) for f in os.listdir(part) if f.split(".gz")[0].endswith((".fastq", ".fq", ".fasta", ".fa"))]
        else:
            found += glob.glob(part)
    return sorted(found)


class Malformed(ValueError):
    """A FASTQ record that breaks the format."""


def parse_fastq(lines: Iterator[str], mode: str = "fail") -> Iterator[tuple[str, str, str]]:
    """(name, sequence, quality) of four-line records."""
    lines = (x.rstrip("\r\n") for x in lines)
    while True:
        head = next(lines, None)
        if head is None:
            return
        if head == "":
            continue
        rest = [next(lines, None) for _ in range(3)]
        ok = head.startswith("@") and None not in rest and rest[1].startswith("+") and len(rest[0]) == len(rest[2])
        if ok:
            yield head[1:], rest[0], rest[2]
        elif mode == "truncate":
            return
        elif mode == "fail":
            raise Malformed(f"malformed FASTQ record at {head[:80]!r}")


#: Bytes of a plain file that one partition reads.
SPLIT = 128 << 20
#: Byte ranges of one read: of more bytes they are longer than ``split``, though not than ``SPLIT``, so tasks do not multiply.
PARTS = 1024
ROWS = 4096


#: Bytes that are read at once, bases of a row, and the longest header line that may cross the start of a range.
BLOCK, PIECE, HEADER = 1 << 20, 1 << 16, 1 << 16
_SPACE = b" \t\r\n\v\f"


def _blank(line: bytes) -> bool:
    return line in (b"\n", b"\r\n")


def _good(four: list[bytes]) -> bool:
    """Whether four lines are a record. No quality line passes for a header: two lines after it stand bases, not a plus."""
    return len(four) == 4 and four[0].startswith(b"@") and four[2].startswith(b"+") and len(four[1].rstrip(b"\r\n")) == len(four[3].rstrip(b"\r\n"))


def _first_record(f, at: int) -> int:
    """Offset of the first record that begins at ``at`` or after it; the end of the file if there is none."""
    if at:
        f.seek(at - 1)
        at = at - 1 + len(f.readline())
    f.seek(at)
    lines = [x for x in (f.readline() for _ in range(4)) if x]
    while lines and not _good(lines):
        at += len(lines.pop(0))
        if more := f.readline():
            lines.append(more)
    return at


def read_range(path: str, start: int, end: int) -> Iterator[tuple[str, str, str]]:
    """Records that begin in a byte range of a plain file. What stands between the last of them and the next range's first
    record must be blank, so the ranges of a file together read all of it or fail."""
    with open(path, "rb") as f:
        at = _first_record(f, start) if start else 0
        f.seek(at)
        while at < end:
            head = f.readline()
            if not head:
                return
            at += len(head)
            if _blank(head):
                continue
            four = [head, *(f.readline() for _ in range(3))]
            at += sum(map(len, four[1:]))
            if not _good(four):
                raise Malformed(f"malformed FASTQ record at {head[:80]!r}")
            name, seq, _, qual = (x.rstrip(b"\r\n").decode("utf-8", "replace") for x in four)
            yield name[1:], seq, qual
        while _blank(line := f.readline()):
            at += len(line)
        if line and _first_record(f, end) != at:
            raise Malformed(f"malformed FASTQ record at {line[:80]!r}")


class _File(InputPartition):
    def __init__(self, path: str, file: int = 0, part: int = 0, start: int = 0, end: int = -1):
        super().__init__(path)
        self.path, self.file, self.part, self.start, self.end = path, file, part, start, end


class FastqReader(DataSourceReader):
    """Rows carry the file's place in the list of files, the part of the file and the place in the part."""

    def __init__(self, options):
        self.path, self.mode = options["path"], options.get("mode", "fail")
        self.split = int(options.get("split", SPLIT))

    def partitions(self):
        out, sizes = [], {p: os.path.getsize(p) for p in _paths(self.path)}
        step = max(self.split, min(SPLIT, -(-sum(sizes.values()) // PARTS)))
        for i, (p, size) in enumerate(sizes.items()):
            if self.mode != "fail" or p.endswith(".gz") or size <= step:
                out.append(_File(p, i))
            else:
                out += [_File(p, i, k, at, min(at + step, size)) for k, at in enumerate(range(0, size, step))]
        return out

    def read(self, partition):
        with _open(partition.path) as f:
            records = parse_fastq(f, self.mode) if partition.end < 0 else read_range(partition.path, partition.start, partition.end)
            places = itertools.count()
            while part := list(itertools.islice(records, ROWS)):
                n = len(part)
                at = list(itertools.islice(places, n))
                cols = [pa.array([partition.file] * n, pa.int32()), pa.array([partition.part] * n, pa.int32()), pa.array(at, pa.int64()), *(pa.array(x, pa.string()) for x in zip(*part))]
                yield pa.RecordBatch.from_arrays(cols, ["file", "part", "place", "name", "sequence", "quality"])


def read_ended(path: str, start: int, end: int) -> Iterator[tuple[str, str, str]]:
    """Records of a plain file that end in the byte range (start, end]; what stands before the range tells where they begin.

    A record counts where its last line's end stands, so ranges that meet share none and lose none, and what is still being
    written counts in a later range. Lines that make no record are left out, one after another until four do.
    """
    with open(path, "rb") as f:
        back = HEADER
        while (at := max(0, start - back)) and (first := _first_record(f, at)) > start:
            back *= 4
        at = first if at else 0
        f.seek(at)
        lines: list[bytes] = []
        while at < end:
            while len(lines) < 4:
                line = f.readline()
                if not line.endswith(b"\n"):
                    return
                if not lines and _blank(line):
                    at += len(line)
                    continue
                lines.append(line)
            if not _good(lines):
                at += len(lines.pop(0))
                while lines and _blank(lines[0]):
                    at += len(lines.pop(0))
                continue
            at += sum(map(len, lines))
            if start < at <= end:
                head, seq, _, qual = (x.rstrip(b"\r\n").decode("utf-8", "replace") for x in lines)
                yield head[1:], seq, qual
            lines = []


class FastqStream(DataSourceStreamReader):
    """Follows growing plain FASTQ files. Offsets are file sizes, which the driver looks up; executors read the byte ranges between them.

    A batch takes at most ``maxBytesPerTrigger`` of each file from where the last one ended. The first batch after a restart takes what
    there is, since Spark does not say where that was; ranges of ``split`` bytes keep its tasks small all the same.
    """

    def __init__(self, options):
        self.path = options["path"]
        self.limit = int(options.get("maxBytesPerTrigger", 8 << 20))
        self.split = int(options.get("split", 32 << 20))
        self.until: dict | None = None

    def initialOffset(self):
        self.until = {}
        return {}

    def latestOffset(self):
        sizes = {p: os.path.getsize(p) for p in _paths(self.path) if not p.endswith(".gz")}
        if self.until is None:
            return sizes
        at = {p: int(self.until.get(p, 0)) for p in sizes}
        return self.until | {p: max(at[p], min(size, at[p] + self.limit)) for p, size in sizes.items()}

    def partitions(self, start, end):
        self.until = dict(end)
        out = []
        for p, stop in end.items():
            at = int(start.get(p, 0))
            out += [_File(p, start=lo, end=min(lo + self.split, int(stop))) for lo in range(at, int(stop), self.split)]
        return out

    def read(self, partition):
        records = read_ended(partition.path, partition.start, partition.end)
        while part := list(itertools.islice(records, ROWS)):
            cols = [*(pa.array(x, pa.string()) for x in zip(*part)), pa.array([partition.path] * len(part), pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["name", "sequence", "quality", "path"])

    def commit(self, end):
        pass


class FastqSource(DataSource):
    @classmethod
    def name(cls):
        return "fastq"

    def schema(self):
        return "file int, part int, place bigint, name string, sequence string, quality string"

    def reader(self, schema):
        return FastqReader(dict(self.options))


class FastqTail(DataSource):
    """Streaming source of growing FASTQ files."""

    @classmethod
    def name(cls):
        return "fastq_tail"

    def schema(self):
        return "name string, sequence string, quality string, path string"

    def streamReader(self, schema):
        return FastqStream(dict(self.options))


def parse_fasta(lines: Iterator[str]) -> Iterator[tuple[str, str]]:
    """(name, sequence); the name ends at the first space, blank lines are skipped."""
    name, parts = None, []
    for line in lines:
        line = line.rstrip("\r\n")
        if line.startswith(">"):
            if name is not None:
                yield name, "".join(parts)
            name, parts = line[1:].split(" ")[0], []
        elif line and name is not None:
            parts.append(line)
    if name is not None:
        yield name, "".join(parts)


class FastaReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        return [_File(p, i) for i, p in enumerate(_paths(self.path))]

    def read(self, partition):
        with _open(partition.path) as f:
            for i, (name, seq) in enumerate(parse_fasta(f)):
                yield name, (partition.file << 32) + i, seq


class FastaSource(DataSource):
    @classmethod
    def name(cls):
        return "fasta"

    def schema(self):
        return "name string, ordinal bigint, sequence string"

    def reader(self, schema):
        return FastaReader(dict(self.options))


def _in_header(f, start: int) -> bool:
    """Whether a byte range starts within a header line: the line's begin is looked for in the ``HEADER`` bytes before."""
    f.seek(max(0, start - HEADER))
    before = f.read(min(HEADER, start))
    at = before.rfind(b"\n")
    return before[at + 1 : at + 2] == b">" if at >= 0 or start <= HEADER else False


def fasta_sections(f, start: int = 0, end: int | None = None) -> Iterator[tuple[int, str | None, int, bytes]]:
    """(section, name, offset, bases) of a byte range of an open FASTA file, at most ``PIECE`` bases at once.

    Section 0 goes on with what stands before the range and has no name; each header line that begins in the range starts
    the next one, and a row without bases tells its name. A header that crosses the range's end is read to its own end; bases belong to the range that they
    stand in. White space is no base.
    """
    line_start = start == 0
    skipping = False
    if start:
        f.seek(start - 1)
        line_start = f.read(1) == b"\n"
        skipping = not line_start and _in_header(f, start)
        f.seek(start)
    section, offset, header, held, size = 0, 0, None, [], 0
    left = float("inf") if end is None else end - start
    while left > 0 or header is not None:
        data = f.read(int(min(BLOCK, left)) if left > 0 else HEADER)
        if not data:
            break
        left -= len(data)
        at = 0
        while at < len(data):
            if header is not None or skipping:  # the rest of a header
                stop = data.find(b"\n", at)
                part = data[at:] if stop < 0 else data[at:stop]
                if header is not None:
                    header += part
                if stop < 0:
                    break
                at, line_start, skipping = stop + 1, True, False
                if header is not None:
                    section, offset = section + 1, 0
                    yield section, header.rstrip(_SPACE).decode("utf-8", "replace").split(" ")[0], 0, b""
                    header = None
                    if left <= 0 and end is not None and f.tell() - len(data) + at >= end:
                        return
                continue
            if line_start and data[at : at + 1] == b">":
                header, at, line_start = b"", at + 1, False
                if held:
                    yield section, None, offset, b"".join(held)
                    offset, held, size = offset + size, [], 0
                continue
            stop = data.find(b"\n>", at)
            part = data[at:] if stop < 0 else data[at : stop + 1]
            at += len(part)
            line_start = part.endswith(b"\n")
            bases = part.translate(None, _SPACE)
            for lo in range(0, len(bases), PIECE):
                piece = bases[lo : lo + PIECE]
                if size + len(piece) > PIECE:
                    yield section, None, offset, b"".join(held)
                    offset, held, size = offset + size, [], 0
                held.append(piece)
                size += len(piece)
    if header is not None:  # the file ends with a header line
        yield section + 1, header.rstrip(_SPACE).decode("utf-8", "replace").split(" ")[0], 0, b""
    if held:
        yield section, None, offset, b"".join(held)


class FastaPieces(DataSourceReader):
    """Plain files in byte ranges, gzip files whole; no row holds more than ``PIECE`` bases."""

    def __init__(self, options):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))

    def partitions(self):
        out = []
        for i, p in enumerate(_paths(self.path)):
            size = os.path.getsize(p)
            step = max(1, size) if p.endswith(".gz") else self.split
            out += [_File(p, i, k, at, -1 if p.endswith(".gz") else min(at + step, size)) for k, at in enumerate(range(0, max(1, size), step))]
        return out

    def read(self, partition):
        gz = partition.path.endswith(".gz")
        with gzip.open(partition.path, "rb") if gz else open(partition.path, "rb") as f:
            rows = fasta_sections(f) if gz else fasta_sections(f, partition.start, partition.end)
            while part := list(itertools.islice(rows, 64)):
                n, (section, name, at, bases) = len(part), zip(*part)
                cols = [pa.array([partition.file] * n, pa.int32()), pa.array([partition.part] * n, pa.int32()), pa.array(section, pa.int32()), pa.array(name, pa.string()), pa.array(at, pa.int64()), pa.array([b.decode("ascii", "replace") for b in bases], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["file", "part", "section", "name", "at", "bases"])


class FastaPiecesSource(DataSource):
    @classmethod
    def name(cls):
        return "fasta_pieces"

    def schema(self):
        return "file int, part int, section int, name string, at bigint, bases string"

    def reader(self, schema):
        return FastaPieces(dict(self.options))


def read_fasta_tiles(spark: SparkSession, path: str, folder: str, tile: int | None = None, split: int = SPLIT) -> DataFrame:
    """The tiles of a reference (name, ordinal, length, tile, piece, tile_size) straight from its files, for every function that takes contigs.

    The files are read once, in byte ranges, and their pieces written to ``folder``; a table of the ranges' sections (a row a range and
    a row a header) gives each piece its contig and place. No row, here or later, holds more than two tiles' bases. Of a repeated name the last sequence
    stands at the first place, as in ``read_fasta``; a contig without bases has no tile.
    """
    from strandline.operators.align import TILE

    tile = tile or TILE
    register(spark)
    spark.read.format("fasta_pieces").option("split", split).load(path).write.parquet(f"{folder}/pieces")
    pieces = spark.read.parquet(f"{folder}/pieces")
    place = ["file", "part", "section"]
    sections = pieces.groupBy(*place).agg(F.max("name").alias("own"), F.sum(F.length("bases")).alias("n"))
    order = Window.partitionBy("file").orderBy("part", "section")
    until = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sections = sections.withColumn("header", F.last(F.when(F.col("own").isNotNull(), F.struct("file", "part", "section", F.col("own").alias("name"))), ignorenulls=True).over(until)).where("header is not null")
    sections = sections.withColumn("start", F.coalesce(F.sum("n").over(Window.partitionBy("header").orderBy("part", "section").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    contigs = sections.groupBy("header").agg(F.sum("n").alias("length"))
    contigs = contigs.groupBy(F.col("header.name").alias("contig")).agg(F.min("header").alias("first"), F.max_by("header", F.struct("header.file", "header.part", "header.section")).alias("header"), F.max_by("length", F.struct("header.file", "header.part", "header.section")).alias("length"))
    contigs = contigs.select("contig", "header", "length", (F.col("first.file").cast("bigint") * (1 << 44) + F.col("first.part").cast("bigint") * (1 << 27) + F.col("first.section")).alias("ordinal"))
    sections = sections.join(contigs, "header").select(*place, "contig", "ordinal", "length", "start")
    placed = pieces.where("bases <> ''").join(small(sections), place).withColumn("position", F.col("start") + F.col("at"))
    last = F.expr(f"(position + length(bases) - 1) div {tile}")
    cut = placed.withColumn("own_tile", F.explode(F.sequence(F.expr(f"position div {tile}"), last)))
    begin = F.greatest(F.col("position"), F.col("own_tile") * tile)
    part = F.substr("bases", (begin - F.col("position") + 1).cast("int"), ((F.col("own_tile") + 1) * tile - begin).cast("int"))
    cut = cut.select("contig", "ordinal", "length", "own_tile", begin.alias("begin"), part.alias("part"))
    # a tile's row holds the next tile's bases too
    cut = cut.select("*", F.explode(F.array("own_tile", F.col("own_tile") - 1)).alias("t")).where("t >= 0")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("begin", "part"))), lambda x: x["part"]), "")
    out = cut.groupBy(F.col("contig").alias("name"), "ordinal", "length", F.col("t").cast("int").alias("tile")).agg(joined.alias("piece"))
    out.withColumn("tile_size", F.lit(tile)).write.parquet(f"{folder}/tiles")
    return spark.read.parquet(f"{folder}/tiles")


def register(spark: SparkSession) -> None:
    for source in (FastqSource, FastqTail, FastaSource, FastaPiecesSource):
        spark.dataSource.register(source)


def read_fastq(spark: SparkSession, path: str, mode: str = "fail", split: int = SPLIT) -> DataFrame:
    """read_id, name, sequence, quality of a file, folder, glob or comma-separated list; .gz by suffix.

    Ids are the file's place in the list (times 2**40) and the ordinal in the file. Where a file is read in parts, their
    records are counted first, in a pass of its own.
    """
    register(spark)
    rows = spark.read.format("fastq").option("mode", mode).option("split", split).load(path)
    ordinal = F.col("place")
    if mode == "fail" and any(not p.endswith(".gz") and os.path.getsize(p) > split for p in _paths(path)):
        # written, so that files are counted once however often the rows are read
        counts = f"{scratch_folder(spark, 'counts')}/parts"
        rows.groupBy("file", "part").agg(F.count("*").alias("k")).write.parquet(counts)
        per = spark.read.parquet(counts)
        before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.join(small(per.select("file", "part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base"))), ["file", "part"])
        ordinal = F.col("base") + F.col("place")
    return rows.select((F.col("file").cast("bigint") * (1 << 40) + ordinal).alias("read_id"), "name", "sequence", "quality")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, ordinal, sequence; of a repeated name the last sequence stands at the first place."""
    register(spark)
    rows = spark.read.format("fasta").load(path)
    return rows.groupBy("name").agg(F.min("ordinal").alias("ordinal"), F.max_by("sequence", "ordinal").alias("sequence"))


def read_pairs(spark: SparkSession, first: str, second: str, mode: str = "fail") -> DataFrame:
    """Mates of two FASTQ inputs by ordinal: read_id, name, sequence, quality, pair_id, mate."""
    from strandline.operators.align import pair_reads

    return pair_reads(read_fastq(spark, first, mode), read_fastq(spark, second, mode))


def count_reads(spark: SparkSession, path: str) -> int:
    return read_fastq(spark, path, "truncate").count()
