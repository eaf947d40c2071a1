"""Sequence functions as column expressions; all stay in the JVM.

Arguments are columns or column names. NULL in gives NULL out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def reverse_complement(s) -> Column:
    """Upper-cased reverse complement; other letters stay."""
    return F.reverse(F.translate(F.upper(_c(s)), "ATCG", "TAGC"))


def reverse_complement_keep_case(s) -> Column:
    """Reverse complement; letters other than ACGTN stay in their own case."""
    return F.reverse(F.translate(_c(s), "ATCGatcgn", "TAGCTAGCN"))


def reverse_complement_strict(s) -> Column:
    """Reverse complement; anything but ACGT becomes N."""
    return F.reverse(F.translate(F.regexp_replace(F.upper(_c(s)), "[^ACGT]", "N"), "ATCG", "TAGC"))


def _differences(a: Column, b: Column) -> Column:
    """Differing places over the common prefix."""
    n = F.least(F.length(a), F.length(b))
    cut = lambda x: F.split(F.substr(x, F.lit(1), n), "")
    unequal = F.aggregate(F.zip_with(cut(a), cut(b), lambda x, y: (x != y).cast("int")), F.lit(0), lambda t, x: t + x)
    return F.when(n > 0, unequal).when(n == 0, 0)


def hamming(a, b) -> Column:
    """Differing places of strings of equal length; NULL for unequal lengths. Case counts."""
    a, b = _c(a), _c(b)
    return F.when(F.length(a) == F.length(b), _differences(a, b))


def hamming_ignore_case(a, b) -> Column:
    return hamming(F.upper(_c(a)), F.upper(_c(b)))


def prefix_distance(a, b) -> Column:
    """Differences over the common prefix plus the difference in length."""
    a, b = _c(a), _c(b)
    return _differences(a, b) + F.abs(F.length(a) - F.length(b))


def equal_ignore_case(a, b) -> Column:
    return F.upper(_c(a)) == F.upper(_c(b))


def match_fraction(a, b) -> Column:
    """Share of equal places over the common prefix; 0 if that is empty."""
    a, b = _c(a), _c(b)
    n = F.least(F.length(a), F.length(b))
    return F.when(n == 0, 0.0).otherwise(1 - _differences(a, b) / n)


def _wild_differences(a: Column, b: Column) -> Column:
    """Differing places over the common prefix, N matching anything."""
    n = F.least(F.length(a), F.length(b))
    cut = lambda x: F.split(F.substr(x, F.lit(1), n), "")
    far = F.zip_with(cut(a), cut(b), lambda x, y: ((x != y) & (x != "N") & (y != "N")).cast("int"))
    return F.when(n > 0, F.aggregate(far, F.lit(0), lambda t, x: t + x)).when(n == 0, 0)


def may_fit(text: Column, pattern: Column, mismatches: int) -> Column:
    """Whether one of ``mismatches`` + 1 pieces of the pattern stands in the text: without one, no place fits."""
    n = mismatches + 1
    at = lambda i: F.expr("int(0)") if i == 0 else (F.length(pattern) * i / n).cast("int")
    out = F.contains(text, F.substr(pattern, at(0) + 1, at(1) - at(0)))
    for i in range(1, n):
        out = out | F.contains(text, F.substr(pattern, at(i) + 1, at(i + 1) - at(i)))
    return out


def contains_within(text, pattern, mismatches: int = 2) -> Column:
    """Whether the pattern stands anywhere in the text with at most so many mismatches."""
    t, p = _c(text), _c(pattern)
    last = F.length(t) - F.length(p) + 1
    somewhere = F.exists(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: hamming(F.substr(t, i, F.length(p)), p) <= mismatches)
    return F.when(F.length(p) == 0, True).when(last < 1, False).when(~may_fit(t, p, mismatches), False).otherwise(somewhere)


def find_barcode(text, barcode, mismatches: int = 1, region: int = 50) -> Column:
    """struct(mm, pos): best place in the first ``region`` bases, earliest of equals; NULL beyond the mismatches. N is wild."""
    t, b = F.substr(_c(text), F.lit(1), F.lit(region)), _c(barcode)
    last = F.length(t) - F.length(b)
    tries = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.struct(_wild_differences(F.substr(t, i + 1, F.length(b)), b).alias("mm"), i.alias("pos")))
    wild = F.contains(t, F.lit("N")) | F.contains(b, F.lit("N"))
    best = F.when((last >= 0) & (F.length(b) > 0) & (wild | may_fit(t, b, mismatches)), F.array_min(tries))
    return F.when(best["mm"] <= mismatches, best)


def find_first(text, pattern, mismatches: int = 2, region: int = 50) -> Column:
    """First offset within ``region`` at which the pattern fits with at most so many mismatches, else -1."""
    t, p = _c(text), _c(pattern)
    last = F.least(F.lit(region - 1), F.length(t) - F.length(p))
    fits = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: hamming_ignore_case(F.substr(t, i + 1, F.length(p)), p) <= mismatches)
    return F.when((last < 0) | (F.size(fits) == 0), -1).otherwise(F.get(fits, F.lit(0)))


def find_primer(text, primer, mismatches: int = 2, min_overlap: int = 10, starts: int = 5) -> Column:
    """struct(mm, pos) of the best of the first offsets, N wild on both sides; the primer may pass the end if enough
    bases match. NULL if none fits."""
    t, p = _c(text), _c(primer)

    def at(i):
        part = F.substr(t, i + 1, F.length(p))
        n = F.least(F.length(part), F.length(p))
        mm = _wild_differences(part, p)
        return F.when((n - mm >= min_overlap) & (mm <= mismatches), F.struct(mm.alias("mm"), i.alias("pos")))

    tries = F.filter(F.transform(F.sequence(F.lit(0), F.lit(starts - 1)), at), lambda x: x.isNotNull())
    return F.when((F.length(p) >= min_overlap) & (F.size(tries) > 0), F.array_min(tries))


def fnv1a(s) -> Column:
    """64-bit FNV-1a of a string's ASCII codes, as a signed long."""
    # 0x100000001b3 = 2**40 + 0x1b3: shifts and a split product stay clear of overflow checks
    def step(h, c):
        x = h.bitwiseXOR(F.ascii(c).cast("long"))
        low, high = x.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(x, 32)
        small = low * 0x1B3
        carry = F.shiftrightunsigned(small, 32) + high * 0x1B3 + F.shiftleft(low, 8)
        return F.shiftleft(carry.bitwiseAND(0xFFFFFFFF), 32).bitwiseOR(small.bitwiseAND(0xFFFFFFFF))

    start = F.lit(0xCBF29CE484222325 - 2**64)
    return F.when(F.length(_c(s)) == 0, start).otherwise(F.aggregate(F.split(_c(s), ""), start, step))


def base_codes(s) -> Column:
    """A, C, G, T as 0 to 3, others as 4."""
    return F.translate(F.regexp_replace(_c(s), "[^ACGT]", "4"), "ACGT", "0123")


def bases_of_codes(s) -> Column:
    return F.translate(_c(s), "01234", "ACGTN")


def kmers(s, k: int = 19, stride: int = 6, letters: str | None = "ACGT") -> Column:
    """array<struct(offset, kmer)> of k-mers without letters other than the given ones; None allows any."""
    s = _c(s)
    last = F.length(s) - k
    all_of = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(stride)), lambda i: F.struct(i.cast("int").alias("offset"), F.substr(s, i + 1, F.lit(k)).alias("kmer")))
    fit = all_of if letters is None else F.filter(all_of, lambda x: x["kmer"].rlike(f"^[{letters}]+$"))
    return F.when(last < 0, F.slice(all_of, 1, 0)).otherwise(fit)


def base_count(s, base: str) -> Column:
    s = F.upper(_c(s))
    return F.length(s) - F.length(F.replace(s, F.lit(base), F.lit("")))


def mean_quality(q) -> Column:
    """Mean PHRED of a quality string; 0 if empty."""
    q = _c(q)
    total = F.aggregate(F.split(q, ""), F.lit(0), lambda t, c: t + F.ascii(c) - 33)
    return F.when(F.length(q) == 0, 0.0).otherwise(total / F.length(q))


def region_quality(q, start, length) -> Column:
    """Mean PHRED of a stretch, clamped to the string."""
    return mean_quality(F.substr(_c(q), start + 1 if isinstance(start, Column) else F.lit(start + 1), length if isinstance(length, Column) else F.lit(length)))


def merge_qualities(a, b) -> Column:
    """Greater quality at each place; the first string if lengths differ."""
    a, b = _c(a), _c(b)
    merged = F.array_join(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.greatest(x, y)), "")
    return F.when(F.length(a) == F.length(b), merged).otherwise(a)


def truncate(s, length: int = 512) -> Column:
    return F.substr(_c(s), F.lit(1), F.lit(length))
