"""Driver queries: overlaps, the overlap graph and its visitors, mate pairs and record lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import dna
from strandloom.operators import components as CC, graph as G, heads as H, kmers as K, matewalk as MW, overlap as O, pairlinks as PL, preprocess as P, qc, reads as R, walk as W
from strandloom.plans import assembly
from strandloom.plans.base import READS, ctes, documents, km, pairs, query, rc, tiles
from strandloom.sources import records
from strandloom.sources.durable import durable

LEAST = 45
UNIQUE = f"""uniq AS MATERIALIZED (SELECT min(idx) AS idx, arg_min(id, idx) AS id, arg_min(seq, idx) AS seq FROM (SELECT *, least(seq, {rc('seq')}) AS canon FROM reads) GROUP BY canon),
ori AS MATERIALIZED (SELECT idx * 2 AS node, seq FROM uniq UNION ALL SELECT idx * 2 + 1, {rc('seq')} FROM uniq)"""
OVERLAPS = f"""sd AS (SELECT node, seq, place, hash(substr(seq, place, {LEAST})) AS h FROM (SELECT node, seq, CAST(unnest(range(2, length(seq) - {LEAST} + 2)) AS INTEGER) AS place FROM ori WHERE length(seq) > {LEAST})),
hd AS (SELECT node, seq, hash(left(seq, {LEAST})) AS h FROM ori WHERE length(seq) >= {LEAST}),
ov AS MATERIALIZED (SELECT s.node AS a, o.node AS b, CAST(length(s.seq) - place + 1 AS INTEGER) AS size FROM sd s JOIN hd o ON s.h = o.h
  WHERE s.node // 2 <> o.node // 2 AND length(o.seq) > length(s.seq) - place + 1 AND substr(s.seq, place) = left(o.seq, length(s.seq) - place + 1))"""
OV = (READS, UNIQUE, OVERLAPS)
CAPPED = """bl AS (SELECT a, size, count(*) AS hits FROM ov GROUP BY 1, 2),
bw AS (SELECT a, size, sum(hits) OVER (PARTITION BY a ORDER BY size DESC) AS upto, max(size) OVER (PARTITION BY a) AS top, min(size) OVER (PARTITION BY a) AS bottom FROM bl),
li AS (SELECT bw.a, coalesce(max(size) FILTER (WHERE (upto >= 64 OR top - size >= 0.5 * length(seq)) AND size > bottom), 0) AS l FROM bw JOIN ori ON ori.node = bw.a GROUP BY 1),
cap AS (SELECT ov.* FROM ov JOIN li USING (a) WHERE size > l)"""
IRREDUCIBLE = """ar AS MATERIALIZED (SELECT cap.*, length(seq) - size AS off FROM cap JOIN ori ON node = a),
im AS (SELECT DISTINCT x.a, y.b, x.off + y.off AS off FROM ar x JOIN ar y ON x.b = y.a JOIN ar z ON z.a = x.a AND z.b = y.b AND z.off = x.off + y.off),
irr AS MATERIALIZED (SELECT ar.a, ar.b, ar.size FROM ar LEFT JOIN im ON im.a = ar.a AND im.b = ar.b AND im.off = ar.off WHERE im.a IS NULL),
arcs AS MATERIALIZED (SELECT a, b, max(size) AS size FROM (SELECT a, b, size FROM irr UNION SELECT xor(b, 1), xor(a, 1), size FROM irr) GROUP BY 1, 2)"""
GRAPH = (*OV, CAPPED, IRREDUCIBLE)
DEGREES = """deg AS (SELECT idx AS v, length(seq) AS len, coalesce(s, 0) AS s, coalesce(t, 0) AS t FROM uniq LEFT JOIN (SELECT a // 2 AS v, count(*) FILTER (WHERE a % 2 = 0) AS s, count(*) FILTER (WHERE a % 2 = 1) AS t FROM arcs GROUP BY 1) d ON d.v = idx)"""


def _unique(spark, sf_dir):
    return durable(H.unique_windows(documents(spark, sf_dir)), "unique")


def _irreducible(spark, sf_dir):
    """Unique reads and irreducible overlaps after the fan-out cap."""
    reads = _unique(spark, sf_dir)
    return reads, H.irreducible(H.capped(reads, LEAST))


def _graph(spark, sf_dir):
    """Vertices and arcs of the irreducible graph after the fan-out cap, closed under twins, one arc a pair."""
    reads, found = _irreducible(spark, sf_dir)
    arcs = G.single_edges(G.twinned(found))
    return reads.select(F.col("idx").alias("v"), "id", "seq", F.lit(1).cast("bigint").alias("cov"), F.length("seq").alias("origin")), durable(arcs, "arcs")


@query(ctes(*OV) + "SELECT * FROM ov")
def exact_overlaps(spark, sf_dir):
    return H.exact(_unique(spark, sf_dir), LEAST)


@query(ctes(*OV) + "SELECT a, b, max(size) AS size FROM ov GROUP BY 1, 2")
def maximal_overlaps(spark, sf_dir):
    return H.maximal(_unique(spark, sf_dir), LEAST)


@query(ctes(*OV, CAPPED) + "SELECT * FROM cap")
def overlap_fanout_cap(spark, sf_dir):
    return H.capped(_unique(spark, sf_dir), LEAST).select("a", "b", "size")


@query(ctes(*GRAPH) + "SELECT * FROM irr")
def irreducible_edges(spark, sf_dir):
    return _irreducible(spark, sf_dir)[1]


@query(ctes(*GRAPH) + "SELECT a, b, size FROM arcs WHERE a < xor(b, 1) OR (a = xor(b, 1) AND b <= xor(a, 1))")
def emitted_edges(spark, sf_dir):
    return O.emitted(_graph(spark, sf_dir)[1])


@query(ctes(READS, UNIQUE) + """, hd AS (SELECT node AS b, seq AS r, o * 15 AS o, substr(seq, CAST(o * 15 AS INTEGER) + 1, 15) AS w FROM (SELECT node, seq, unnest(range(0, length(seq) // 15)) AS o FROM ori WHERE length(seq) >= 45)),
ss AS (SELECT node AS a, seq AS l, i AS place, substr(seq, CAST(i AS INTEGER) + 1, 15) AS w FROM (SELECT node, seq, unnest(range(0, length(seq) - 14)) AS i FROM ori WHERE length(seq) >= 45)),
mt AS (SELECT DISTINCT a, b, l, r, place - o AS off FROM ss JOIN hd USING (w) WHERE a // 2 <> b // 2 AND place - o >= 1 AND length(l) - (place - o) >= 45 AND length(r) > length(l) - (place - o)),
df AS (SELECT a, b, length(l) - off AS size, list_sum(list_transform(range(1, length(l) - off + 1), lambda i: CASE WHEN substr(l, CAST(off + i AS INTEGER), 1) <> substr(r, CAST(i AS INTEGER), 1) THEN 1 ELSE 0 END)) AS differences FROM mt)
SELECT differences, count(*) AS overlaps, CAST(sum(size) AS BIGINT) AS bases FROM (SELECT size, CAST(differences AS INTEGER) AS differences FROM df WHERE CAST(differences AS DOUBLE) / size - 1e-6 <= 0.04) GROUP BY 1""")
def inexact_overlaps(spark, sf_dir):
    found = O.inexact(_unique(spark, sf_dir), 45, 0.04)
    return found.groupBy("differences").agg(F.count("*").alias("overlaps"), F.sum("size").alias("bases"))


@query(ctes(*GRAPH, DEGREES) + """SELECT count(*) AS vertices, CAST(sum(s + t) AS BIGINT) AS edges, count(*) FILTER (WHERE s = 0 AND t = 0) AS islands, count(*) FILTER (WHERE (s = 0) <> (t = 0)) AS tips,
  count(*) FILTER (WHERE (s > 1) <> (t > 1)) AS monobranch, count(*) FILTER (WHERE s > 1 AND t > 1) AS dibranch, count(*) FILTER (WHERE s = 1 OR t = 1) AS simple, count(*) FILTER (WHERE s = 1 AND t = 1) AS straight FROM deg""")
def graph_stats(spark, sf_dir):
    return G.stats(*_graph(spark, sf_dir))


@query(ctes(*GRAPH, DEGREES) + "SELECT v FROM deg WHERE (s = 0 OR t = 0) AND len < 100")
def trim_tips(spark, sf_dir):
    return G.short_ends(*_graph(spark, sf_dir), 100)


@query(ctes(*GRAPH, DEGREES) + """, gone AS (SELECT v FROM deg WHERE (s = 0 OR t = 0) AND len < 100)
SELECT a, b, size FROM arcs WHERE a // 2 NOT IN (SELECT v FROM gone) AND b // 2 NOT IN (SELECT v FROM gone)""")
def trimmed_edges(spark, sf_dir):
    return G.trim(*_graph(spark, sf_dir), 100)[1]


COMPONENTS = """tied AS (SELECT DISTINCT a // 2 AS x, b // 2 AS y FROM arcs WHERE a // 2 <> b // 2)"""


@query("WITH RECURSIVE " + ctes(*GRAPH, COMPONENTS)[5:] + """, cc(node, root) AS (SELECT x, x FROM tied UNION SELECT t.y, c.root FROM cc c JOIN tied t ON t.x = c.node WHERE c.root < t.y)
SELECT node, min(root) AS root FROM cc GROUP BY 1""")
def components(spark, sf_dir):
    arcs = _graph(spark, sf_dir)[1]
    return CC.components(arcs.select(G.vertex("a").alias("a"), G.vertex("b").alias("b")))


@query("WITH RECURSIVE " + ctes(*GRAPH, COMPONENTS)[5:] + """, bf(v, depth) AS (SELECT idx, 0 FROM uniq WHERE idx % 1000000 = 1 UNION SELECT y, depth + 1 FROM bf JOIN tied ON x = v WHERE depth < 5)
SELECT v, CAST(min(depth) AS INTEGER) AS depth FROM bf GROUP BY 1""")
def subgraph_bfs(spark, sf_dir):
    """Vertices within five edges of each document's first read."""
    vertices, arcs = _graph(spark, sf_dir)
    return G.neighbourhood(arcs, vertices.filter(F.col("v") % 1_000_000 == 1).select("v"), 5)


STEPS = """sim AS MATERIALIZED (SELECT a, b, size FROM arcs WHERE a // 2 <> b // 2 AND a IN (SELECT a FROM arcs GROUP BY 1 HAVING count(*) = 1) AND b IN (SELECT b FROM arcs GROUP BY 1 HAVING count(*) = 1)),
nodes AS (SELECT a AS node FROM sim UNION SELECT b FROM sim),
heads AS (SELECT node FROM nodes WHERE node NOT IN (SELECT b FROM sim)),
lin(head, node) AS (SELECT node, node FROM heads UNION ALL SELECT head, b FROM lin JOIN sim ON a = node),
ring AS MATERIALIZED (SELECT node FROM nodes WHERE node NOT IN (SELECT node FROM lin)),
rnd(origin, node, low) AS (SELECT node, node, node FROM ring UNION ALL SELECT origin, b, least(low, b) FROM rnd JOIN sim ON a = node WHERE b <> origin),
first AS (SELECT node FROM heads UNION ALL SELECT origin FROM rnd GROUP BY origin HAVING min(low) = origin),
walk(head, node, rank, seq) AS (SELECT f.node, f.node, 0, o.seq FROM first f JOIN ori o ON o.node = f.node UNION ALL SELECT head, b, rank + 1, concat(walk.seq, substr(o.seq, size + 1)) FROM walk JOIN sim ON a = walk.node JOIN ori o ON o.node = b WHERE b <> head),
path AS (SELECT head, min(node) AS chain, count(*) AS members, arg_max(seq, rank) AS seq FROM walk GROUP BY 1),
mem AS (SELECT p.chain, p.seq, p.members, w.node FROM walk w JOIN path p USING (head)),
kept AS (SELECT DISTINCT m.chain, m.seq, m.members FROM mem m JOIN mem t ON t.node = xor(m.node, 1) WHERE m.chain <= t.chain),
uni AS (SELECT chain // 2 AS v, seq, CAST(members AS BIGINT) AS members FROM kept UNION ALL SELECT idx, seq, 1 FROM uniq WHERE idx NOT IN (SELECT node // 2 FROM nodes))"""


def _unitigs(spark, sf_dir):
    vertices, arcs = _graph(spark, sf_dir)
    merged, moved = G.compact(vertices, arcs)
    return durable(merged, "unitigs"), durable(moved, "unitig-arcs")


@query("WITH RECURSIVE " + ctes(*GRAPH, STEPS)[5:] + "SELECT v, seq, members FROM uni")
def unitigs(spark, sf_dir):
    return _unitigs(spark, sf_dir)[0].select("v", "seq", "members")


@query("WITH RECURSIVE " + ctes(*GRAPH, STEPS)[5:] + """, l AS (SELECT length(seq) AS len FROM uni WHERE length(seq) >= 100), o AS (SELECT len, sum(len) OVER (ORDER BY len DESC) AS upto, sum(len) OVER () AS total FROM l)
SELECT CAST(max(total) AS BIGINT) AS total, count(*) AS contigs, CAST(max(len) AS INTEGER) AS longest, CAST(min(len) AS INTEGER) AS shortest, CAST(max(len) FILTER (WHERE upto >= total * 0.2) AS INTEGER) AS n20, CAST(max(len) FILTER (WHERE upto >= total * 0.5) AS INTEGER) AS n50, CAST(max(len) FILTER (WHERE upto >= total * 0.8) AS INTEGER) AS n80 FROM o""")
def contig_n50(spark, sf_dir):
    return G.contiguity(_unitigs(spark, sf_dir)[0].select(F.length("seq").alias("len")), 100)


@query("WITH RECURSIVE " + ctes(*GRAPH, STEPS)[5:] + "SELECT concat('>contig-', v, ' ', length(seq), ' ', members, chr(10), seq) AS value FROM uni")
def contig_fasta(spark, sf_dir):
    return records.contig_lines(_unitigs(spark, sf_dir)[0])


@query(ctes(*GRAPH) + """, w AS (SELECT a, b, arcs.size, length(x.seq) AS len, length(y.seq) AS other FROM arcs JOIN ori x ON x.node = a JOIN ori y ON y.node = b)
SELECT a, b, size FROM w WHERE len < 1000 AND CAST(size AS DOUBLE) / least(len, other) < 0.6""")
def overlap_ratio_sweep(spark, sf_dir):
    vertices, arcs = _graph(spark, sf_dir)
    return G.low_ratio(vertices, arcs, 0.6, 1000)


@query(ctes(*GRAPH) + """, w AS (SELECT a, b, arcs.size, max(arcs.size) OVER (PARTITION BY a) AS top, count(*) OVER (PARTITION BY a) AS n FROM arcs JOIN ori x ON x.node = a WHERE length(x.seq) >= 60),
z AS (SELECT *, (top > 55 AND size < 55) OR top - size >= 20 AS bad FROM w WHERE n > 1), y AS (SELECT *, bool_and(bad) OVER (PARTITION BY a) AS every FROM z)
SELECT a, b, size FROM y WHERE bad AND NOT every""")
def overlap_length_difference(spark, sf_dir):
    vertices, arcs = _graph(spark, sf_dir)
    return G.length_differences(vertices, arcs, 60, 55, 20)


@query(ctes(*GRAPH) + """, b AS (SELECT a // 2 AS v, max(size) FILTER (WHERE a % 2 = 0) AS s, max(size) FILTER (WHERE a % 2 = 1) AS t FROM arcs GROUP BY 1)
SELECT idx AS v FROM uniq JOIN b ON b.v = idx WHERE length(seq) BETWEEN 31 AND 100 AND s <= 50 AND t <= 50""")
def short_edges_both_sides(spark, sf_dir):
    vertices, arcs = _graph(spark, sf_dir)
    return G.short_both_sides(vertices, arcs, 100, 50)


@query(ctes(*GRAPH, DEGREES) + """, one AS (SELECT v FROM deg WHERE s = 1 AND t = 1),
pa AS (SELECT x.a AS s, y.b AS t, x.b // 2 AS v, length(u.seq) - x.size - y.size AS gap FROM arcs x JOIN arcs y ON y.a = x.b JOIN uniq u ON u.idx = x.b // 2 WHERE x.b // 2 IN (SELECT v FROM one) AND x.a // 2 <> x.b // 2 AND y.b // 2 <> x.b // 2 AND x.a <= xor(y.b, 1)),
gr AS (SELECT s, t, count(*) AS n, max(gap) - min(gap) AS spread, min(v) AS best FROM pa GROUP BY 1, 2)
SELECT DISTINCT v FROM pa JOIN gr USING (s, t) WHERE n > 1 AND spread <= 9 AND v <> best""")
def bubble_smoothing(spark, sf_dir):
    return G.bubbles(*_graph(spark, sf_dir))


COUNT31 = f"""cnt AS (SELECT least(kmer, rc) AS canon, count(*) FILTER (WHERE kmer <= rc) AS fw, count(*) FILTER (WHERE kmer >= rc) AS rv FROM (SELECT kmer, {rc('kmer')} AS rc FROM km) GROUP BY 1)"""


@query(ctes(*GRAPH, DEGREES, km(31), COUNT31) + f""", en AS (SELECT v, s, t FROM deg WHERE s = 0 OR t = 0),
ex AS (SELECT v, s, t, seq, CAST(unnest(range(0, length(seq) - 30)) AS INTEGER) AS p FROM en JOIN uniq ON idx = v WHERE length(seq) >= 31),
st AS (SELECT ex.v, min(p) AS lo, max(p) AS hi FROM ex JOIN cnt ON canon = least(substr(ex.seq, p + 1, 31), {rc('substr(ex.seq, p + 1, 31)')}) WHERE greatest(fw, rv) >= 2 AND least(fw, rv) >= 0 GROUP BY 1),
c AS (SELECT idx AS v, seq, en.v IS NOT NULL AS weak, CASE WHEN t = 0 AND lo IS NOT NULL THEN lo ELSE 0 END AS b, CASE WHEN s = 0 AND hi IS NOT NULL THEN hi + 31 ELSE length(seq) END AS e FROM uniq LEFT JOIN en ON en.v = idx LEFT JOIN st ON st.v = idx)
SELECT v, CASE WHEN weak AND e - b >= 40 THEN substr(seq, b + 1, e - b) ELSE seq END AS seq FROM c""")
def erode_ends(spark, sf_dir):
    vertices, arcs = _graph(spark, sf_dir)
    return G.erode(vertices, arcs, K.strand_counts(tiles(spark, sf_dir), 31, True), 31, 2, 0, 40)


@query(ctes(*GRAPH) + """SELECT 'HT' AS kind, concat('HT', chr(9), 'VN:i:1', chr(9), 'ER:f:0', chr(9), 'OL:i:45') AS line UNION ALL SELECT 'VT', concat('VT', chr(9), id, chr(9), seq) FROM uniq
UNION ALL SELECT 'ED', concat('ED', chr(9), x.id, ' ', y.id, ' ', s0, ' ', s0 + size - 1, ' ', length(x.seq), ' ', s1, ' ', s1 + size - 1, ' ', length(y.seq), ' ', CASE WHEN a % 2 <> b % 2 THEN 1 ELSE 0 END, ' 0')
FROM (SELECT e.*, CASE WHEN a % 2 = 0 THEN length(x.seq) - size ELSE 0 END AS s0, CASE WHEN b % 2 = 0 THEN 0 ELSE length(y.seq) - size END AS s1, x, y FROM arcs e JOIN uniq x ON x.idx = a // 2 JOIN uniq y ON y.idx = b // 2 WHERE a < xor(b, 1) OR (a = xor(b, 1) AND b <= xor(a, 1)))""")
def graph_file(spark, sf_dir):
    vertices, arcs = _graph(spark, sf_dir)
    return records.graph_lines(vertices, O.emitted(arcs), LEAST)


@query(ctes(*GRAPH) + """SELECT x.id AS id0, y.id AS id1, CAST(size AS INTEGER) AS size, a % 2 <> b % 2 AS is_rc FROM arcs JOIN uniq x ON x.idx = a // 2 JOIN uniq y ON y.idx = b // 2 WHERE (a < xor(b, 1) OR (a = xor(b, 1) AND b <= xor(a, 1))) AND size >= 50""")
def graph_file_scan(spark, sf_dir):
    """Edges of the rendered graph file, parsed again with a least overlap."""
    vertices, arcs = _graph(spark, sf_dir)
    edges = records.parse_graph(records.graph_lines(vertices, O.emitted(arcs), LEAST).select(F.col("line").alias("value")), 50)[2]
    return edges.select("id0", "id1", (F.col("e0") - F.col("s0") + 1).alias("size"), "is_rc")


@query(ctes(*GRAPH) + """SELECT concat('"', idx, '" [ label="', idx, ' ', length(seq), '" ];') AS value FROM uniq
UNION ALL SELECT concat('"', a // 2, '" -> "', b // 2, '" [label="', size, '" color="', CASE WHEN a % 2 = 0 THEN 'black' ELSE 'red' END, '"];') FROM arcs""")
def graph_drawing(spark, sf_dir):
    return records.dot_lines(*_graph(spark, sf_dir))


@query(ctes(READS, R.SQL_PAIRS) + f""", o AS (SELECT pair_id, first, {rc('second')} AS other FROM pairs), m AS (SELECT pair_id, first, other, n FROM (SELECT *, unnest(range(20, least(length(first), length(other)) + 1)) AS n FROM o) WHERE right(first, n) = left(other, n)),
b AS (SELECT pair_id, max(n) AS n FROM m GROUP BY 1)
SELECT pair_id, CAST(n AS INTEGER) AS size, concat(first, substr(other, n + 1)) AS merged FROM b JOIN o USING (pair_id)""")
def pair_overlap_merge(spark, sf_dir):
    return W.overlapped(pairs(spark, sf_dir), 20)


@query(ctes(READS, R.SQL_PAIRS) + f""", w AS (SELECT substr(seq, CAST(i AS INTEGER), 31) AS w FROM (SELECT seq, unnest(range(1, length(seq) - 29)) AS i FROM reads WHERE length(seq) >= 31)),
c AS (SELECT least(w, {rc('w')}) AS canon, count(*) AS n FROM w GROUP BY 1)
SELECT pair_id FROM pairs LEFT JOIN c x ON x.canon = least(left(first, 31), {rc('left(first, 31)')}) LEFT JOIN c y ON y.canon = least(left(second, 31), {rc('left(second, 31)')}) WHERE length(first) >= 31 AND length(second) >= 31 AND coalesce(x.n, 0) < 4 AND coalesce(y.n, 0) < 4""")
def walk_suitable_pairs(spark, sf_dir):
    reads = tiles(spark, sf_dir)
    return W.suitable(R.paired(reads), reads, 31, 4).select("pair_id")


ENDS = f"""uc AS (SELECT *, least(seq, {rc('seq')}) AS canon FROM uniq), pl AS (SELECT r.doc_id, r.pos, r.idx, u.idx * 2 + CASE WHEN u.seq = r.seq THEN 0 ELSE 1 END AS node FROM reads r JOIN uc u ON u.canon = least(r.seq, {rc('r.seq')})),
ends AS (SELECT x.idx AS pair_id, x.node AS a, y.node AS b FROM pl x JOIN pl y ON x.doc_id = y.doc_id AND y.pos = x.pos + 100)"""


def _ends(reads):
    """Reads with their oriented unique reads, and pair_id and those of both mates, the second seen from the first's strand. Two hashes, 128 bits, stand for a sequence, so none is shuffled."""
    canon = dna.canonical("seq")
    rows = reads.select("doc_id", "pos", "idx", F.xxhash64(canon).alias("h"), F.xxhash64(F.lit(7), canon).alias("g"), (F.col("seq") != canon).cast("bigint").alias("turned"))
    least = rows.groupBy("h", "g").agg(F.min(F.col("idx") * 2 + F.col("turned")).alias("u"))
    node = F.col("u") - F.col("u") % 2 + ((F.col("u") % 2) != F.col("turned")).cast("bigint")
    placed = durable(rows.join(least, ["h", "g"]).select("doc_id", "pos", "idx", node.alias("node")), "placed")
    other = placed.select("doc_id", (F.col("pos") - 100).alias("pos"), F.col("node").alias("b"))
    return placed, placed.select("doc_id", "pos", F.col("idx").alias("pair_id"), F.col("node").alias("a")).join(other, ["doc_id", "pos"]).select("pair_id", "a", "b")


@query("WITH RECURSIVE " + ctes(*GRAPH, ENDS)[5:] + """, wk(pair_id, node, b, path, score, step) AS (SELECT pair_id, a, b, seq, 0, 0 FROM ends JOIN ori ON node = a
  UNION ALL SELECT pair_id, r.b, w.b, concat(path, substr(o.seq, r.size + 1)), score + r.size, step + 1 FROM wk w JOIN arcs r ON r.a = w.node JOIN ori o ON o.node = r.b WHERE w.node <> w.b AND step < 2 AND length(path) + length(o.seq) - r.size <= 300),
dn AS (SELECT * FROM wk WHERE node = b)
SELECT pair_id, arg_min(path, (-score, path)) AS merged, CAST(length(arg_min(path, (-score, path))) AS INTEGER) AS size, count(*) AS paths FROM dn GROUP BY 1""")
def pair_walk_merge(spark, sf_dir):
    reads = tiles(spark, sf_dir)
    vertices, arcs = _graph(spark, sf_dir)
    _, ends = _ends(reads)
    return W.walks(ends, arcs, O.oriented(vertices.select(F.col("v").alias("idx"), "seq")), 2, 300, 1 << 20)


@query(ctes(READS, UNIQUE, ENDS) + "SELECT least(a // 2, b // 2) AS v, greatest(a // 2, b // 2) AS w, count(*) AS pairs FROM ends WHERE a // 2 <> b // 2 GROUP BY 1, 2")
def pair_support(spark, sf_dir):
    reads = tiles(spark, sf_dir)
    placed, _ = _ends(reads)
    rows = placed.select(F.col("idx").alias("r"), G.vertex("node").alias("v"))
    mates = reads.select(F.col("idx").alias("r1"), (F.col("idx") + 100).alias("r2"))
    return W.support(rows, mates)


LINKS = "lk AS (SELECT least(a // 2, b // 2) AS v, greatest(a // 2, b // 2) AS w, count(*) AS pairs FROM ends WHERE a // 2 <> b // 2 GROUP BY 1, 2)"


def _links(spark, sf_dir):
    vertices, arcs = _graph(spark, sf_dir)
    reads = tiles(spark, sf_dir)
    placed, _ = _ends(reads)
    rows = placed.select(F.col("idx").alias("r"), G.vertex("node").alias("v"))
    return vertices, arcs, durable(W.support(rows, reads.select(F.col("idx").alias("r1"), (F.col("idx") + 100).alias("r2"))), "links")


@query(ctes(*GRAPH, DEGREES, ENDS, LINKS) + ", de AS (SELECT v FROM deg WHERE s = 0 OR t = 0) SELECT v, w, pairs FROM lk WHERE pairs > 1 AND v IN (SELECT v FROM de) AND w IN (SELECT v FROM de)")
def island_links(spark, sf_dir):
    vertices, arcs, links = _links(spark, sf_dir)
    ends = G.degrees(vertices, arcs).filter("sense = 0 OR anti = 0").select("v")
    return W.island_links(ends, links, 1)


@query(ctes(*GRAPH, ENDS, LINKS) + "SELECT a, b, size FROM arcs WHERE NOT EXISTS (SELECT 1 FROM lk WHERE lk.v = least(a // 2, b // 2) AND lk.w = greatest(a // 2, b // 2))")
def unsupported_edges(spark, sf_dir):
    _, arcs, links = _links(spark, sf_dir)
    return W.unsupported_edges(arcs, links)


@query(ctes(READS) + "SELECT a.idx AS idx, b.idx AS mate FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS n FROM reads) a JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS n FROM reads) b ON a.doc_id = b.doc_id AND b.n = xor(a.n, 1)")
def mate_join(spark, sf_dir):
    """Mates by parity of the read's place."""
    rows = tiles(spark, sf_dir).select("doc_id", "idx", F.floor(F.col("pos") / R.STEP).alias("n"))
    other = rows.select("doc_id", F.col("n").bitwiseXOR(F.lit(1).cast("bigint")).alias("n"), F.col("idx").alias("mate"))
    return rows.join(other, ["doc_id", "n"]).select("idx", "mate")


@query()
def assemble_contigs(spark, sf_dir):
    """The whole run, from reads to contigs."""
    found, _ = assembly.assemble(R.with_scores(tiles(spark, sf_dir)), assembly.Settings(least_overlap=45))
    return found.select("v", F.length("seq").alias("len"), "cov", "seq")


INSERT = 160
SUPPORT = f"""wk(start, first, node, seq, far, nodes, done) AS (SELECT a, b, b, concat(x.seq, substr(y.seq, r.size + 1)), length(y.seq) - r.size, [a, b], length(y.seq) - r.size > {INSERT * 3 // 2} OR a = b
  FROM arcs r JOIN ori x ON x.node = a JOIN ori y ON y.node = b WHERE a IN (SELECT a FROM arcs WHERE size < {INSERT} * 0.8)
  UNION ALL SELECT start, first, r.b, concat(w.seq, substr(y.seq, r.size + 1)), far + length(y.seq) - r.size, list_append(nodes, r.b), far + length(y.seq) - r.size > {INSERT * 3 // 2} OR list_contains(nodes, r.b)
  FROM wk w JOIN arcs r ON r.a = w.node JOIN ori y ON y.node = r.b WHERE NOT done),
ways AS MATERIALIZED (SELECT * FROM wk WHERE done OR node NOT IN (SELECT a FROM arcs)),
given AS (SELECT start FROM ways GROUP BY 1 HAVING count(*) > 128),
jd AS MATERIALIZED (SELECT a, b, seq, length(seq) - size - 1 AS p FROM arcs JOIN ori ON node = a WHERE size < {INSERT} * 0.8 AND a NOT IN (SELECT start FROM given)),
seeds AS (SELECT a, b, 0 AS side, substr(seq, CAST(greatest(p - 15 * i, 0) + 1 AS INTEGER), 31) AS w FROM jd, range(3) t(i)),
gl AS (SELECT a, b, seq, greatest(p - 15, 0) + {INSERT} + 16 * i AS t FROM (SELECT j.a, j.b, w.seq, j.p FROM ways w JOIN jd j ON j.a = w.start AND j.b = w.first), range(-1, 2) t(i)),
ak AS MATERIALIZED (SELECT DISTINCT a, b, side, least(w, {rc('w')}) AS canon FROM (SELECT * FROM seeds UNION ALL SELECT a, b, 1, substr(seq, CAST(t - 30 AS INTEGER), 31) FROM gl WHERE length(seq) >= t) WHERE length(w) = 31),
mt AS (SELECT pair_id, 1 AS mate, first AS seq FROM pairs UNION ALL SELECT pair_id, 2, second FROM pairs),
mk AS (SELECT pair_id, mate, substr(seq, CAST(i AS INTEGER), 31) AS w FROM (SELECT *, unnest(range(1, length(seq) - 29)) AS i FROM mt WHERE length(seq) >= 31)),
sp AS MATERIALIZED (SELECT * FROM (SELECT pair_id, mate, least(w, {rc('w')}) AS canon FROM mk) WHERE canon IN (SELECT canon FROM ak)),
pt AS (SELECT DISTINCT pair_id, mate, canon FROM sp WHERE canon IN (SELECT canon FROM sp GROUP BY 1 HAVING count(*) <= 600)),
ct AS (SELECT n.a, n.b, count(DISTINCT n.pair_id) AS n FROM (SELECT a, b, pair_id, mate FROM ak JOIN pt USING (canon) WHERE side = 0) n JOIN (SELECT a, b, pair_id, 3 - mate AS mate FROM ak JOIN pt USING (canon) WHERE side = 1) f USING (a, b, pair_id, mate) GROUP BY 1, 2),
su AS MATERIALIZED (SELECT r.a, r.b, r.size, CASE WHEN jd.a IS NOT NULL THEN 'judged' WHEN r.size < {INSERT} * 0.8 THEN 'open' ELSE 'wide' END AS state, CASE WHEN jd.a IS NOT NULL THEN coalesce(ct.n, 0) END AS pairs FROM arcs r LEFT JOIN jd ON jd.a = r.a AND jd.b = r.b LEFT JOIN ct ON ct.a = r.a AND ct.b = r.b),
lost AS (SELECT a, b FROM su WHERE pairs < 1)"""


@query("WITH RECURSIVE " + ctes(*GRAPH, R.SQL_PAIRS, SUPPORT)[5:] + "SELECT a, b, size, state, coalesce(pairs, -1) AS pairs, NOT EXISTS (SELECT 1 FROM lost WHERE (lost.a = su.a AND lost.b = su.b) OR (lost.a = xor(su.b, 1) AND lost.b = xor(su.a, 1))) AS kept FROM su")
def pe_edge_removal(spark, sf_dir):
    """Arcs with the pairs an insert apart that go over them (-1: not judged); those without any, from either end, go."""
    vertices, arcs = _graph(spark, sf_dir)
    found = durable(PL.edge_support(vertices, arcs, pairs(spark, sf_dir), 31, INSERT), "support")
    left = PL.drop_unsupported(arcs, found).select("a", "b", F.lit(True).alias("kept"))
    rows = found.join(left, ["a", "b"], "left")
    return rows.select("a", "b", "size", "state", F.coalesce("pairs", F.lit(-1)).alias("pairs"), F.coalesce("kept", F.lit(False)).alias("kept"))


@query()
def join_islands(spark, sf_dir):
    """Dead ends of the unitigs of cleaned reads, tied by pairs and joined by walks; those that no walk joins have a null ``added``."""
    clean = P.process(R.with_scores(tiles(spark, sf_dir)), P.Options(gc=(0.3, 0.7))).filter(F.col("fate") == "kept")
    reads = durable(qc.unique_reads(clean.select("idx", "id", "seq")), "unique")
    sizes = O.lengths(reads)
    arcs = G.single_edges(G.with_twins(O.irreducible(O.fanout_cap(durable(O.exact(reads, LEAST), "overlaps"), sizes), sizes)))
    vertices, arcs = G.compact(reads.select(F.col("idx").alias("v"), "seq", F.lit(1).cast("bigint").alias("cov")), durable(arcs, "arcs"))
    vertices, arcs = durable(vertices, "unitigs"), durable(arcs, "unitig-arcs")
    every = tiles(spark, sf_dir, 20)  # each 21-mer inside a text is in four of them
    counts = durable(K.strand_counts(every, 21), "counts")
    mates = durable(PL.mates_of(R.paired(every)), "mates")
    ends = durable(PL.dead_ends(vertices, arcs, 100), "dead-ends")
    cutoff = MW.repeat_cutoff(every, 21).first()["cutoff"]
    links = PL.end_links(PL.end_reads(ends, mates, counts, 21, 200, cutoff), 2)
    return PL.walk_links(links, ends, MW.Places(every, 21), counts, MW.Limits(seed=21, most_overlap=80, support=2, leaves=128, most_length=240))
