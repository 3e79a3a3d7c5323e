"""Driver queries: scalar functions, record formats and preprocessing."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from strandloom.functions import dna, kernels
from strandloom.operators import preprocess as P, reads as R, windows as W
from strandloom.plans.base import READS, ctes, documents, query, rc, table, tiles
from strandloom.sources import records
from strandloom.streaming import lookup

SCORED = f"scored AS (SELECT *, {R.SQL_SCORES} AS scores FROM reads)"


@query(ctes(READS) + f"SELECT id, {rc('seq')} AS rc, translate(seq, 'ACGT', 'TGCA') AS comp, reverse(seq) AS rev, left(seq, 12) AS pre, right(seq, 12) AS suf FROM reads")
def reverse_complement(spark, sf_dir):
    return tiles(spark, sf_dir).select("id", dna.revcomp("seq").alias("rc"), dna.complement("seq").alias("comp"), F.reverse("seq").alias("rev"), F.left("seq", F.lit(12)).alias("pre"), F.right("seq", F.lit(12)).alias("suf"))


@query(ctes(READS) + """SELECT id, translate(s, 'ACGTRYSWKMBDHVNacgtryswkmbdhvn', 'TGCAYRSWMKVHDBNtgcayrswmkvhdbn') AS comp,
  translate(reverse(s), 'ACGTRYSWKMBDHVNacgtryswkmbdhvn', 'TGCAYRSWMKVHDBNtgcayrswmkvhdbn') AS rc
FROM (SELECT id, replace(replace(replace(seq, 'AC', 'RN'), 'GT', 'ky'), 'TT', 'bV') AS s FROM reads)""")
def iupac_complement(spark, sf_dir):
    mixed = F.replace(F.replace(F.replace(F.col("seq"), F.lit("AC"), F.lit("RN")), F.lit("GT"), F.lit("ky")), F.lit("TT"), F.lit("bV"))
    return tiles(spark, sf_dir).select("id", dna.iupac_complement(mixed).alias("comp"), dna.iupac_revcomp(mixed).alias("rc"))


@query(ctes(READS) + """SELECT id, CAST(length(regexp_replace(seq, '[^GC]', '', 'g')) AS DOUBLE) / length(seq) AS gc,
  (length(regexp_replace(seq, '[^GC]', '', 'g')) * 10 BETWEEN 3 * length(seq) AND 7 * length(seq)) AS within FROM reads""")
def gc_content(spark, sf_dir):
    return tiles(spark, sf_dir).select("id", dna.gc("seq").alias("gc"), ((dna.base_count("seq", "G") + dna.base_count("seq", "C")) * 10).between(F.length("seq") * 3, F.length("seq") * 7).alias("within"))


DUST = """tri AS (SELECT id, substr(seq, CAST(i AS INTEGER), 3) AS t FROM (SELECT id, seq, unnest(range(1, length(seq) - 2)) AS i FROM reads WHERE length(seq) > 3)),
tc AS (SELECT id, sum(c * (c - 1) / 2.0) AS s FROM (SELECT id, t, CAST(count(*) AS DOUBLE) AS c FROM tri GROUP BY 1, 2) GROUP BY 1),
dust AS (SELECT r.id, CASE WHEN length(seq) < 3 THEN 0.0 ELSE coalesce(s, 0) / (length(seq) - 2) END AS score FROM reads r LEFT JOIN tc USING (id))"""


@query(ctes(READS, DUST) + "SELECT id, round(score, 6) AS score, score < 4 AS passed FROM dust")
def dust_filter(spark, sf_dir):
    score = dna.dust("seq")
    return tiles(spark, sf_dir).select("id", score.alias("raw")).select("id", F.round("raw", 6).alias("score"), (F.col("raw") < 4).alias("passed"))


@query(ctes(READS) + """SELECT id, CAST(coalesce(list_max(list_transform(regexp_extract_all(seq, 'A+|C+|G+|T+'), lambda x: length(x))), 0) AS INTEGER) AS longest,
  greatest(n('A'), n('C'), n('G'), n('T')) / CAST(length(seq) AS DOUBLE) >= 0.9 AS low FROM reads""".replace("n('A')", "length(seq) - length(replace(seq, 'A', ''))").replace("n('C')", "length(seq) - length(replace(seq, 'C', ''))").replace("n('G')", "length(seq) - length(replace(seq, 'G', ''))").replace("n('T')", "length(seq) - length(replace(seq, 'T', ''))"))
def low_complexity(spark, sf_dir):
    return tiles(spark, sf_dir).select("id", dna.longest_run("seq").alias("longest"), dna.low_complexity("seq").alias("low"))


@query(ctes(READS, SCORED) + """, s AS (SELECT id, scores, list_sum(list_transform(scores, lambda x: CASE WHEN x <= 3 THEN 1 ELSE 0 END)) AS low, array_to_string(list_transform(scores, lambda x: chr(CAST(x + 33 AS INTEGER))), '') AS qual FROM scored)
SELECT id, qual, CAST(low AS INTEGER) AS low, CAST(list_sum(scores) AS INTEGER) AS total, CAST(list_max(list_transform(string_split(qual, ''), lambda c: ascii(c) - 33)) AS INTEGER) AS most FROM s""")
def quality_scores(spark, sf_dir):
    def of(w: W.Windows) -> list:
        scores = kernels._scores(w.seq)
        qual = kernels._phred_string(scores, 33, 93)
        return [w.id, qual, kernels._at_most(scores, 3), kernels._total(scores), kernels._greatest(kernels._phred(qual, 33))]

    return W.told(documents(spark, sf_dir), "id string, qual string, low int, total int, most int", of)


@query(ctes(READS, SCORED) + """, e AS (SELECT id, seq, scores, unnest(range(1, length(seq) + 1)) AS i FROM scored),
c AS (SELECT id, i, list_sum(list_transform(scores[i:], lambda x: 20 - x)) AS total FROM e),
b AS (SELECT id, CASE WHEN max(total) > 0 THEN max(i - 1) FILTER (WHERE total = m) ELSE NULL END AS cut FROM (SELECT *, max(total) OVER (PARTITION BY id) AS m FROM c) GROUP BY id)
SELECT id, CAST(CASE WHEN scores[-1] < 20 THEN coalesce(cut, length(seq)) ELSE length(seq) END AS INTEGER) AS kept FROM scored JOIN b USING (id)""")
def soft_clip(spark, sf_dir):
    return W.told(documents(spark, sf_dir), "id string, kept int", lambda w: [w.id, kernels._soft_clip(kernels._scores(w.seq), 20)])


@query(ctes(READS) + f"SELECT id, contains('{dna.PRIMERS[0]}', left(seq, 14)) OR contains('{dna.PRIMERS[1]}', left(seq, 14)) AS primer, contains('{dna.PRIMERS[0]}', left(seq, 4)) OR contains('{dna.PRIMERS[1]}', left(seq, 4)) AS short_hit FROM reads")
def primer_screen(spark, sf_dir):
    return tiles(spark, sf_dir).select("id", dna.has_primer("seq").alias("primer"), dna.has_primer("seq", 4).alias("short_hit"))


@query(ctes(READS) + """, c AS (SELECT id, seq, CASE WHEN contains(seq, 'ACGTTA') THEN strpos(seq, 'ACGTTA') ELSE strpos(seq, 'GATTC') END AS place, CASE WHEN contains(seq, 'ACGTTA') THEN 6 WHEN contains(seq, 'GATTC') THEN 5 ELSE 0 END AS n FROM reads)
SELECT id, CAST(place AS INTEGER) AS place, CASE WHEN place > 0 THEN concat(left(seq, place - 1), substr(seq, place + n)) ELSE seq END AS seq FROM c""")
def adapter_trim(spark, sf_dir):
    at, size = dna.cut_adapter("seq", "ACGTTA", "GATTC")
    return tiles(spark, sf_dir).select("id", "seq", at.alias("place"), size.alias("n")).select("id", "place", dna.erase("seq", F.col("place"), F.col("n")).alias("seq"))


@query(ctes(READS) + """, h AS (SELECT a.id, a.seq AS s, b.seq AS t, least(length(a.seq), length(b.seq)) AS n FROM reads a JOIN reads b ON a.doc_id = b.doc_id AND b.pos = a.pos + 50)
SELECT id, CAST(list_sum(list_transform(range(1, n + 1), lambda i: CASE WHEN substr(s, CAST(i AS INTEGER), 1) <> substr(t, CAST(i AS INTEGER), 1) THEN 1 ELSE 0 END)) AS INTEGER) AS differences,
  array_to_string(list_transform(range(1, n + 1), lambda i: CASE WHEN substr(s, CAST(i AS INTEGER), 1) = substr(t, CAST(i AS INTEGER), 1) THEN '.' ELSE substr(t, CAST(i AS INTEGER), 1) END), '') AS marks FROM h""")
def hamming_difference(spark, sf_dir):
    def of(w: W.Windows) -> list:
        n = pc.min_element_wise(pc.utf8_length(w.seq), pc.utf8_length(w.next))
        return [w.id, kernels._hamming(w.seq, w.next, n), kernels._diff_string(w.seq, w.next)]

    return W.neighbours(documents(spark, sf_dir), 50, "id string, differences int, marks string", of)


@query("""WITH n AS (SELECT concat(source, '/', doc_id, '/', CASE doc_id % 7 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN '1' WHEN 3 THEN '2' WHEN 4 THEN 'f' WHEN 5 THEN 'r' ELSE 'x' END) AS id FROM documents)
SELECT id, CASE WHEN right(id, 1) IN ('A', 'B', '1', '2', 'f', 'r') THEN concat(left(id, length(id) - 1), translate(right(id, 1), 'AB12fr', 'BA21rf')) ELSE '' END AS mate,
  regexp_extract(id, '^(.*)/[^/]*$', 1) AS base, CASE WHEN right(id, 1) IN ('A', '1', 'f') THEN 0 ELSE 1 END AS side FROM n""")
def pair_names(spark, sf_dir):
    last = F.element_at(F.array(*map(F.lit, "AB12frx")), (F.col("doc_id") % 7 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string"), last).alias("id"))
    return rows.select("id", dna.mate_id("id").alias("mate"), dna.base_name("id").alias("base"), dna.pair_index("id").alias("side"))


@query(ctes(READS) + """, c AS (SELECT id, length(seq) AS n, CAST(pos % 37 AS BIGINT) AS s FROM reads)
SELECT id, CAST(greatest(n - 1 - 40 - s, -1) AS INTEGER) AS start, CAST(n - s - 1 AS INTEGER) AS stop, s = 0 OR least(s + 40, n) = n - 1 AS extreme, s = 0 AND least(s + 40, n) = n - 1 AS contained FROM c""".replace("greatest(n - 1 - 40 - s, -1)", "n - least(s + 40, n) - 1"))
def coordinates(spark, sf_dir):
    start = (F.col("pos") % 37).cast("int")
    coord = F.struct(start.alias("start"), F.least(start + 40, F.length("seq")).alias("end"), F.length("seq").alias("len"))
    rows = tiles(spark, sf_dir).select("id", coord.alias("c"), dna.flip(coord).alias("f"))
    return rows.select("id", F.col("f.start").alias("start"), F.col("f.end").alias("stop"), dna.is_extreme("c").alias("extreme"), dna.is_contained("c").alias("contained"))


@query(ctes(READS) + """, g AS (SELECT id, translate(seq, 'ACGT', 'MIDM') AS flat FROM reads)
SELECT id, flat, array_to_string(list_transform(regexp_extract_all(flat, 'M+|I+|D+'), lambda r: concat(length(r), left(r, 1))), '') AS cigar FROM g""")
def cigar_round_trip(spark, sf_dir):
    rows = tiles(spark, sf_dir).select("id", dna.compact_cigar(F.translate("seq", "ACGT", "MIDM")).alias("cigar"))
    return rows.select("id", dna.expand_cigar("cigar").alias("flat"), "cigar")


@query("""WITH k AS (SELECT CAST(k AS INTEGER) AS k FROM range(0, 41) t(k)), d AS (SELECT k, lgamma(k + 1) AS f, lgamma(41 - k) AS g FROM k)
SELECT k, round(k * ln(7.5) - 7.5 - f, 9) AS poisson, round(lgamma(41) - f - g + k * ln(0.3) + (40 - k) * ln(1 - 0.3), 9) AS binomial,
  round(lgamma(41) - f - g + lgamma(k + 2) + lgamma(40 - k + 5) - lgamma(47) - (lgamma(2) + lgamma(5) - lgamma(7)), 9) AS beta_binomial FROM d""")
def log_probabilities(spark, sf_dir):
    k = spark.range(41).select(F.col("id").cast("int").alias("k"), F.lit(40).alias("n"))
    return k.select("k", F.round(dna.log_poisson("k", 7.5), 9).alias("poisson"), F.round(dna.log_binomial("k", "n", 0.3), 9).alias("binomial"), F.round(dna.log_beta_binomial("k", "n", 2, 5), 9).alias("beta_binomial"))


@query(ctes(READS, SCORED) + """SELECT id, seq, array_to_string(list_transform(scores, lambda x: chr(CAST(x + 33 AS INTEGER))), '') AS qual FROM scored""")
def fastq_round_trip(spark, sf_dir):
    """Records rendered as FASTQ and parsed again."""
    def of(w: W.Windows) -> list:
        qual = kernels._phred_string(kernels._scores(w.seq), 33, 93)
        return list(records.fastq_records(records.fastq_texts(w.id, w.seq, qual)))

    return W.told(documents(spark, sf_dir), "id string, seq string, qual string", of)


@query(ctes(READS) + "SELECT id, seq, CAST(ceil(length(seq) / 40.0) AS INTEGER) AS n_lines FROM reads")
def fasta_round_trip(spark, sf_dir):
    """Records rendered as wrapped FASTA and parsed again."""
    text = tiles(spark, sf_dir).select(F.concat(F.lit(">"), "id", F.lit(" note\n"), records.wrapped(F.col("seq"), 40)).alias("value"))
    lines = F.size(F.split("value", "\n")) - 1
    return text.select(lines.alias("n_lines"), F.inline(records._split(F.col("value")))).select("id", "seq", "n_lines")


PREPROCESS = """, c AS (SELECT *, CASE WHEN contains(seq, 'ACGTTAC') THEN strpos(seq, 'ACGTTAC') ELSE strpos(seq, 'GATTCAA') END AS place FROM scored),
d AS (SELECT id, doc_id, pos, idx, left(CASE WHEN place > 0 THEN concat(left(seq, place - 1), substr(seq, place + 7)) ELSE seq END, 90) AS seq, (CASE WHEN place > 0 THEN list_concat(scores[:place - 1], scores[place + 7:]) ELSE scores END)[:90] AS scores FROM c),
low AS (SELECT *, coalesce(list_sum(list_transform(scores, lambda x: CASE WHEN x <= 3 THEN 1 ELSE 0 END)), 0) AS low FROM d),
t AS (SELECT id, unnest(range(1, length(seq) - 2)) AS i, seq FROM d WHERE length(seq) > 3),
du AS (SELECT id, sum(n * (n - 1) / 2.0) AS s FROM (SELECT id, substr(seq, CAST(i AS INTEGER), 3) AS w, CAST(count(*) AS DOUBLE) AS n FROM t GROUP BY 1, 2) GROUP BY 1),
f AS (SELECT low.*, CASE WHEN NOT regexp_full_match(seq, '[ACGT]*') THEN 'alphabet' WHEN low > 12 THEN 'quality'
  WHEN length(seq) >= 3 AND coalesce(s, 0) / (length(seq) - 2) >= 3 THEN 'dust'
  WHEN length(seq) = 0 OR NOT (CAST(length(regexp_replace(seq, '[^GC]', '', 'g')) AS DOUBLE) / length(seq) BETWEEN 0.25 AND 0.7) THEN 'gc'
  WHEN contains('%s', left(seq, 14)) OR contains('%s', left(seq, 14)) THEN 'primer' WHEN length(seq) < 31 THEN 'length' ELSE 'kept' END AS fate FROM low LEFT JOIN du USING (id))
""" % dna.PRIMERS
OPTIONS = P.Options(adapter=("ACGTTAC", "GATTCAA"), hard_clip=90, most_low_quality=12, dust=3.0, gc=(0.25, 0.7))


def _fates(w: W.Windows) -> tuple[pa.Array, pa.Array]:
    return P.fates(w.seq, kernels._scores(w.seq), OPTIONS)


def _processed(spark, sf_dir):
    return W.told(documents(spark, sf_dir), "id string, seq string, fate string", lambda w: [w.id, *_fates(w)])


@query(ctes(READS, SCORED) + PREPROCESS + "SELECT id, seq, fate FROM f")
def preprocess_reads(spark, sf_dir):
    return _processed(spark, sf_dir)


@query(ctes(READS, SCORED) + PREPROCESS + "SELECT fate, count(*) AS reads, CAST(sum(length(seq)) AS BIGINT) AS bases FROM f GROUP BY 1")
def preprocess_stats(spark, sf_dir):
    return P.counters(_processed(spark, sf_dir))


@query(ctes(READS, SCORED) + PREPROCESS + """, p AS (SELECT doc_id * 100000 + (pos // 100) AS pair_id, fate FROM f)
SELECT pair_id, count(*) AS mates, count(*) FILTER (WHERE fate = 'kept') AS kept,
  CASE WHEN count(*) = 2 AND count(*) FILTER (WHERE fate = 'kept') = 2 THEN 'paired' WHEN count(*) FILTER (WHERE fate = 'kept') >= 1 THEN 'orphan' ELSE 'dropped' END AS outcome FROM p GROUP BY 1""")
def pair_filter(spark, sf_dir):
    def of(w: W.Windows) -> list:
        pair_id = pc.add(pc.multiply(w.doc_id, 100_000), pa.array(w.pos // 100, pa.int64()))
        return P.pair_counts(pair_id, _fates(w)[1])

    return P.summed_pairs(W.told(documents(spark, sf_dir), "pair_id long, mates long, kept long", of))


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def event_windows(spark, sf_dir):
    rows = lookup.event_windows(table(spark, sf_dir, "events"))
    return rows.select("start", "event_type", "n", F.round("total", 4).alias("total"))
