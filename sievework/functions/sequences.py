"""Sequence functions as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The bases that each IUPAC letter stands for.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
#: The repeat residues that bind each base.
RESIDUES = {"A": "NI", "T": "NG", "C": "HD", "G": "NH"}


def complement(s: Column) -> Column:
    return F.translate(s, "ACGTacgt", "TGCATGCA")


def reverse_complement(s: Column) -> Column:
    return F.reverse(complement(s))


def gc_fraction(s: Column) -> Column:
    """Share of G and C; null for an empty sequence."""
    return F.length(F.regexp_replace(s, "[^GC]", "")) / F.nullif(F.length(s), F.lit(0))


def iupac_class(pattern: str) -> str:
    """The pattern as a regular expression."""
    return "".join(f"[{IUPAC[c]}]" for c in pattern)


def matches(s: Column, pattern: str) -> Column:
    return s.rlike(f"^{iupac_class(pattern)}$")


def expansions(pattern: str) -> list[str]:
    """All concrete sequences of a pattern."""
    out = [""]
    for c in pattern:
        out = [a + b for a in out for b in IUPAC[c]]
    return out


def self_complementarity(s: Column, stem: int = 4, backbone: Column | None = None) -> Column:
    """Stems of ``stem`` bases with half or more G and C whose like stands in the reverse complement past them, or in a backbone."""
    n = F.length(s)
    rc = reverse_complement(s)

    def hit(i):
        part = F.substring(s, i + 1, F.lit(stem))
        rich = F.length(F.regexp_replace(part, "[^GC]", "")) * 2 >= stem
        there = F.expr("false") if backbone is None else F.contains(backbone, part)
        return F.when(rich & (F.contains(F.substring(rc, F.lit(1), F.greatest(n - i - stem, F.lit(0))), part) | there), 1).otherwise(0)

    starts = F.when(n > stem, F.sequence(F.lit(0), n - stem - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(F.transform(starts, hit), F.lit(0), lambda a, b: a + b)


def as_twenty(guide: Column, context: Column) -> Column:
    """A 19-base guide with the first base of its context before it; null if that is N; others as they are."""
    first = F.substring(context, 1, 1)
    return F.when(F.length(guide) == 19, F.when(first != "N", F.concat(first, guide))).otherwise(guide)


def matrix_score(s: Column, matrix: dict[str, list[float]], low: float, high: float) -> Column:
    """Sum of matrix[base][position], scaled to 0..100 between low and high; null for another length or other letters."""
    n = len(next(iter(matrix.values())))
    rows = F.create_map(*[x for b, v in matrix.items() for x in (F.lit(b), F.array(*[F.lit(float(y)) for y in v]))])
    total = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0.0), lambda a, i: a + rows[F.substring(s, i + 1, F.lit(1))][i])
    scaled = F.least(F.greatest((total - low) / (high - low) * 100, F.lit(0.0)), F.lit(100.0))
    return F.when(s.rlike(f"^[ACGT]{{{n}}}$"), scaled)


def coefficient_score(s: Column, intercept: float, features: dict[tuple[str, int], float], gc_low: float, gc_high: float, centre: int = 10) -> Column:
    """Logistic score: intercept, weights of (letters, 0-based position) and of the GC count's distance below or above the centre."""
    total = F.lit(float(intercept))
    for (letters, at), weight in features.items():
        total = total + F.when(F.substring(s, at + 1, len(letters)) == letters, float(weight)).otherwise(0.0)
    gc = F.length(F.regexp_replace(F.substring(s, 1, 20), "[^GC]", ""))
    total = total + F.when(gc < centre, (centre - gc) * float(gc_low)).otherwise((gc - centre) * float(gc_high))
    return 1 / (1 + F.exp(-total))


def mismatch_positions(md: Column) -> Column:
    """0-based mismatch positions of an MD string such as 3A10T5."""
    runs = F.transform(F.regexp_extract_all(md, F.lit(r"(\d+)[ACGTN]"), F.lit(1)), lambda x: x.cast("int"))
    return F.transform(runs, lambda x, i: F.aggregate(F.slice(runs, F.lit(1), i + 1), F.lit(0), lambda a, b: a + b) + i)


def with_sites(df: DataFrame, sequence: str, enzymes: DataFrame, least: int = 0) -> DataFrame:
    """Each row with each enzyme of a short table (enzyme, motif, size) that cuts it, and how often."""
    rows = df.crossJoin(F.broadcast(enzymes.where(F.col("size") >= least)))
    n = F.size(F.regexp_extract_all(F.col(sequence), F.col("motif"), F.lit(0)))
    return rows.withColumn("sites", n).where("sites > 0")


def site_list(s: Column, enzymes: Sequence[tuple[str, str]]) -> Column:
    """``name:count`` of each enzyme (name, motif as a regular expression) of a short list that cuts, parted by ``;``."""
    count = lambda motif: F.size(F.regexp_extract_all(s, F.lit(motif), F.lit(0)))
    return F.concat_ws(";", *[F.when(count(m) > 0, F.concat(F.lit(f"{name}:"), count(m).cast("string"))) for name, m in sorted(enzymes)])


def residues(s: Column) -> Column:
    table = F.create_map(*[x for k, v in RESIDUES.items() for x in (F.lit(k), F.lit(v))])
    return F.array_join(F.transform(F.split(s, ""), lambda b: table[b]), " ")


def marked_mismatches(guide: Column, hit: Column) -> Column:
    """The hit with the bases that differ from the guide in lower case."""
    return F.array_join(F.zip_with(F.split(guide, ""), F.split(hit, ""), lambda a, b: F.when(a == b, b).otherwise(F.lower(b))), "")


def list_mean(packed: Column) -> Column:
    """Mean of ``{a,b,c}`` over the numbers in it; 0 without one."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(packed, r"[{}\s]", ""), ","), lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    return F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda a, b: a + b) / F.size(parts)).otherwise(0.0)


def ranges(text: Column) -> Column:
    """The numbers of ``a-b,c``, ascending and once each."""

    def numbers(p):
        ends = F.split(p, "-")
        return F.sequence(ends[0].cast("int"), F.element_at(ends, -1).cast("int"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(F.regexp_replace(text, r"\s", ""), ","), numbers))))


def region(text: Column) -> dict[str, Column]:
    """chromosome, start and end of ``chr:start-end``; thousands separators go; null unless start < end."""
    pattern = r"^([^:]+):(\d+)-(\d+)$"
    clean = F.regexp_replace(text, ",", "")
    a, b = (F.regexp_extract(clean, pattern, i).try_cast("long") for i in (2, 3))
    good = a < b
    return {"chromosome": F.when(good, F.regexp_extract(clean, pattern, 1)), "start": F.when(good, a), "end": F.when(good, b)}


def encoded(s: Column) -> Column:
    """2 bits a base as a long, for up to 31 bases of ACGT."""
    return F.conv(F.translate(s, "ACGT", "0123"), 4, 10).cast("long")


def decoded(code: Column, size: int) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), size, "0"), "0123", "ACGT")


def encoded_mismatches(a: Column, b: Column) -> Column:
    x = a.bitwiseXOR(b)
    return F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
