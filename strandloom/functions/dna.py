"""Scalar sequence functions as Spark column expressions. Those that go base by base run on Arrow batches, all others in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from strandloom.functions import kernels

IUPAC = "ACGTRYSWKMBDHVN"
IUPAC_COMPLEMENT = "TGCAYRSWMKVHDBN"
#: Bases that an ambiguity code stands for.
AMBIGUOUS = {"R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT", ".": "ACGT"}
#: The two library primers that the default screen looks for.
PRIMERS = ("AATGATACGGCGACCACCGAGATCTACA", "GATCGGAAGAGCGGTTCAGCAGGAATGC")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def complement(seq: Column | str) -> Column:
    return F.translate(col(seq), "ACGT", "TGCA")


def revcomp(seq: Column | str) -> Column:
    return complement(F.reverse(col(seq)))


def iupac_complement(seq: Column | str) -> Column:
    """Complement over the ambiguity alphabet; letter case stays."""
    return F.translate(col(seq), IUPAC + IUPAC.lower(), IUPAC_COMPLEMENT + IUPAC_COMPLEMENT.lower())


def iupac_revcomp(seq: Column | str) -> Column:
    return iupac_complement(F.reverse(col(seq)))


def canonical(seq: Column | str) -> Column:
    return F.least(col(seq), revcomp(seq))


def substr(seq: Column | str, start: Column | int, size: Column | int) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.substring(col(seq), as_col(start), as_col(size))


def base_count(seq: Column | str, base: str) -> Column:
    return F.length(col(seq)) - F.length(F.replace(col(seq), F.lit(base), F.lit("")))


def gc(seq: Column | str) -> Column:
    """Share of G and C; null for an empty sequence."""
    return F.when(F.length(col(seq)) > 0, (base_count(seq, "G") + base_count(seq, "C")).cast("double") / F.length(col(seq)))


def only_acgt(seq: Column | str) -> Column:
    return col(seq).rlike("^[ACGT]*$")


def trimers(seq: Column | str) -> Column:
    """Trimers that the dust score counts; the last one of a sequence isn't among them."""
    n = F.length(col(seq))
    return F.when(n > 3, F.transform(F.sequence(F.lit(1), n - 3), lambda i: substr(seq, i, 3))).otherwise(F.array().cast("array<string>"))


def dust(seq: Column | str) -> Column:
    """Sum of c (c - 1) / 2 over trimer counts c, over length - 2."""
    return kernels.dust(col(seq))


def _dust(seq: Column | str) -> Column:
    """``dust`` where a lambda asks for it."""
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("total"))

    def step(s: Column, t: Column) -> Column:
        run = F.when(s["last"] == t, s["run"] + 1).otherwise(0)
        return F.struct(t.alias("last"), run.alias("run"), (s["total"] + run).alias("total"))

    total = F.aggregate(F.array_sort(trimers(seq)), start, step)["total"]  # equal trimers come in runs
    return F.when(F.length(col(seq)) < 3, F.lit(0.0)).otherwise(total.cast("double") / (F.length(col(seq)) - 2))


def max_dust(seq: Column | str, window: int = 64) -> Column:
    n = F.length(col(seq))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), n - window + 1))
    return F.array_max(F.transform(starts, lambda i: _dust(substr(seq, i, window))))


def hamming(a: Column | str, b: Column | str, n: Column | int) -> Column:
    """Differences over the first n bases."""
    return kernels.hamming(col(a), col(b), (n if isinstance(n, Column) else F.lit(n)).cast("int"))


def diff_string(a: Column | str, b: Column | str) -> Column:
    """'.' where the sequences agree, the second's base where they don't."""
    return kernels.diff_string(col(a), col(b))


def longest_run(seq: Column | str) -> Column:
    """Length of the longest run of one base; 0 for an empty sequence."""
    return kernels.longest_run(col(seq))


def max_share(seq: Column | str) -> Column:
    """Share of the most frequent base; null for an empty sequence."""
    counts = [base_count(seq, b) for b in "ACGT"]
    return F.when(F.length(col(seq)) > 0, F.greatest(*counts).cast("double") / F.length(col(seq)))


def low_complexity(seq: Column | str, share: float = 0.9) -> Column:
    return max_share(seq) >= share


def has_primer(seq: Column | str, size: int = 14) -> Column:
    """The first bases occur in a primer. An empty sequence does."""
    head = F.left(col(seq), F.lit(size))
    return F.contains(F.lit(PRIMERS[0]), head) | F.contains(F.lit(PRIMERS[1]), head)


def phred(qual: Column | str, offset: int = 33) -> Column:
    """Quality characters to numbers."""
    return kernels.phred(col(qual), F.lit(offset))


def phred_string(scores: Column | str, offset: int = 33, most: int = 93) -> Column:
    return kernels.phred_string(col(scores), F.lit(offset), F.lit(most))


def phred64_to_33(qual: Column | str) -> Column:
    """Shifted by 31; a character outside 0..60 is an error."""
    scores = phred(qual, 64)
    bad = F.exists(scores, lambda q: (q < 0) | (q > 60))
    return F.when(bad, F.raise_error(F.lit("quality outside 0..60"))).otherwise(phred_string(scores))


def probability_to_phred(p: Column | str) -> Column:
    return F.round(-10 * F.log10(col(p))).cast("int")


def low_quality_bases(scores: Column | str, most: int = 3) -> Column:
    return kernels.at_most(col(scores), F.lit(most))


def soft_clip(scores: Column | str, trim: int) -> Column:
    """Length kept after clipping the 3' end: the largest running sum of trim - q, scanned leftwards, tells the cut; ties keep more. Only if the last base is below ``trim``."""
    return kernels.soft_clip(col(scores), F.lit(trim))


def cut_adapter(seq: Column | str, forward: str, reverse: str) -> tuple[Column, Column]:
    """Place (from 1, 0 if none) and length of the first hit of the forward adapter, else of the reverse one."""
    one, two = F.instr(col(seq), forward), F.instr(col(seq), reverse)
    at = F.when(one > 0, one).otherwise(two)
    return at, F.when(one > 0, F.lit(len(forward))).when(two > 0, F.lit(len(reverse))).otherwise(0)


def erase(seq: Column | str, at: Column, size: Column) -> Column:
    """The flanks of a slice, joined."""
    return F.when(at > 0, F.concat(substr(seq, F.lit(1), at - 1), substr(seq, at + size, F.length(col(seq))))).otherwise(col(seq))


def resolve_ambiguous(seq: Column | str, key: Column | str, seed: int = 0) -> Column:
    """Each ambiguity code becomes one of its bases, chosen by a hash of key, place and seed."""
    names = F.create_map(*[x for k, v in AMBIGUOUS.items() for x in (F.lit(k), F.lit(v))])

    def one(i: Column) -> Column:
        c = substr(seq, i, 1)
        among = names[c]
        return F.when(among.isNull(), c).otherwise(substr(among, (F.pmod(F.xxhash64(col(key), i, F.lit(seed)), F.length(among)) + 1).cast("int"), 1))

    return F.when(F.length(col(seq)) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(col(seq))), one), "")).otherwise("")


def mate_id(read_id: Column | str) -> Column:
    """The mate's name: a last A/B, 1/2 or f/r is swapped; '' for other names."""
    last = F.right(col(read_id), F.lit(1))
    other = F.translate(last, "AB12fr", "BA21rf")
    return F.when(last.rlike("^[AB12fr]$"), F.concat(F.left(col(read_id), F.length(col(read_id)) - 1), other)).otherwise("")


def base_name(read_id: Column | str) -> Column:
    """What stands before the last slash."""
    return F.when(F.instr(col(read_id), "/") > 0, F.regexp_extract(col(read_id), r"(?s)^(.*)/[^/]*$", 1)).otherwise(col(read_id))


def pair_index(read_id: Column | str) -> Column:
    """0 for names ending in A, 1 or f, else 1."""
    return F.when(F.right(col(read_id), F.lit(1)).isin("A", "1", "f"), 0).otherwise(1)


def flip(coord: Column | str) -> Column:
    """A closed interval seen from the other strand."""
    c = col(coord)
    return F.struct((c["len"] - c["end"] - 1).alias("start"), (c["len"] - c["start"] - 1).alias("end"), c["len"].alias("len"))


def is_extreme(coord: Column | str) -> Column:
    c = col(coord)
    return (c["start"] == 0) | (c["end"] == c["len"] - 1)


def is_contained(coord: Column | str) -> Column:
    c = col(coord)
    return (c["start"] == 0) & (c["end"] == c["len"] - 1)


def error_rate_within(rate: Column | str, most: float) -> Column:
    return col(rate) - 1e-6 <= most


def expand_cigar(cigar: Column | str) -> Column:
    """'3M1I' to 'MMMI'."""
    return kernels.expand_cigar(col(cigar))


def compact_cigar(flat: Column | str) -> Column:
    """'MMMI' to '3M1I'."""
    return kernels.compact_cigar(col(flat))


def log_poisson(k: Column | str, mean: Column | float) -> Column:
    """ln P(k) of a Poisson law with a whole k >= 0."""
    m = mean if isinstance(mean, Column) else F.lit(float(mean))
    log_factorial = F.aggregate(F.sequence(F.lit(1), F.greatest(col(k), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + F.ln(i.cast("double")))
    return col(k) * F.ln(m) - m - log_factorial


def log_binomial(k: Column | str, n: Column | str, p: float) -> Column:
    """ln P(k of n) of a binomial law."""
    fact = lambda x: F.aggregate(F.sequence(F.lit(1), F.greatest(x, F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + F.ln(i.cast("double")))
    return fact(col(n)) - fact(col(k)) - fact(col(n) - col(k)) + col(k) * F.ln(F.lit(p)) + (col(n) - col(k)) * F.ln(F.lit(1 - p))


def log_beta_binomial(k: Column | str, n: Column | str, alpha: int, beta: int) -> Column:
    """ln P(k of n) of a beta-binomial law with whole alpha and beta >= 1."""
    fact = lambda x: F.aggregate(F.sequence(F.lit(1), F.greatest(x, F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + F.ln(i.cast("double")))
    log_beta = lambda a, b: fact(a - 1) + fact(b - 1) - fact(a + b - 1)
    k, n, a, b = col(k), col(n), F.lit(alpha), F.lit(beta)
    return fact(n) - fact(k) - fact(n - k) + log_beta(k + a, n - k + b) - log_beta(a, b)


def seqrank(read_id: Column | str) -> Column:
    return F.regexp_extract(col(read_id), r"seqrank=(\d+)", 1)


def file_stem(name: str) -> str:
    """A file name without folders, .gz and its extension (driver side)."""
    stem = name.rsplit("/", 1)[-1].removesuffix(".gz")
    return stem.rsplit(".", 1)[0] if "." in stem else stem
