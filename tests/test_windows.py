"""Windows that are cut in the task that reads the texts, against those cut by Spark's expressions."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.functions import dna, kernels
from strandloom.operators import preprocess as P, reads as R, windows as W
from strandloom.plans import scalars
from strandloom.sources import records

SF = "/root/testdata/sf0.001"


def _docs(spark, twice=False):
    rng = random.Random(4)
    sizes = [0, 1, 49, 50, 51, 99, 100, 101, 149, 150, 151, 200, 1000, 7001]
    rows = [(i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz AZ.é") for _ in range(n))) for i, n in enumerate(sizes)]
    rows += [(20, None), (21, "!?"), (None, "no id " * 40), (22, "KİKELVIN" * 30), (23, "äöü日本語" * 50 + "x"), (24, "acgttac gattcaa " * 40), (25, "a" * 300), (26, "gattcaaacgttac" * 30)]
    rows += [(12, "another text of the same id " * 20), (12, "a third one " * 30)] if twice else []
    return spark.createDataFrame(rows, "doc_id long, text string")


def _rows(df):
    return sorted(map(str, df.collect()))


def test_windows_are_tiles(spark):
    docs = _docs(spark)
    got = W.told(docs, "doc_id long, pos int, id string, seq string", lambda w: [w.doc_id, pa.array(w.pos), w.id, w.seq])
    assert _rows(got) == _rows(R.tiled(docs).select("doc_id", "pos", "id", "seq"))


@pytest.mark.parametrize("apart", [50, 100])
def test_neighbours_of_windows(spark, apart):
    docs = _docs(spark, twice=True)
    got = W.neighbours(docs, apart, "doc_id long, pos int, id string, seq string, next string", lambda w: [w.doc_id, pa.array(w.pos), w.id, w.seq, w.next])
    assert _rows(got) == _rows(R.neighbours(docs, apart).select("doc_id", "pos", "id", "seq", "next"))


def test_fates_are_those_of_process(spark):
    docs, options = _docs(spark), scalars.OPTIONS
    got = W.told(docs, "id string, seq string, fate string", lambda w: [w.id, *P.fates(w.seq, kernels._scores(w.seq), options)])
    want = P.process(R.with_scores(R.tiled(docs)), options).select("id", "seq", "fate")
    assert _rows(got) == _rows(want)
    assert len({r.fate for r in want.collect()}) >= 4
    with pytest.raises(ValueError):
        P.fates(pa.array(["ACGT"]), pa.array([[1, 2, 3, 4]]), P.Options(trim=20))


def test_dust_by_counts(spark):
    seqs = ["", "A", "AC", "ACG", "ACGT", "AAAAAAAAAA", "ACACACACAC", "AATTTTTTTTTTTCCC", None, "ACGTTGCAAGTC"]
    rows = spark.createDataFrame([(s,) for s in seqs], "seq string").select(kernels.dust("seq").alias("got"), dna._dust("seq").alias("want"), "seq").collect()
    assert all(r.got == r.want for r in rows if r.seq is not None)


def test_pair_counts_add_up(spark):
    rows = spark.createDataFrame([(1, "kept"), (1, "kept"), (2, "dust"), (2, "kept"), (3, "gc"), (None, "kept"), (None, "kept"), (0, "kept"), (1, "dust")], "pair_id long, fate string").coalesce(1)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(P.pair_counts(b.column("pair_id"), b.column("fate")), names=["pair_id", "mates", "kept"])

    assert _rows(P.summed_pairs(rows.mapInArrow(run, "pair_id long, mates long, kept long"))) == _rows(P.pairs(rows))


def test_fastq_records_are_those_of_split(spark):
    texts = ["@a b\nAC\n+\nII\n", "@a\tb\r\nAC\r\n+\r\nII\r\n\r\n@c\nG\n+c\nI", "@a\nAC\n+", "@", "@x\n\nAC\n+\n@I\nleft"]
    rows = spark.createDataFrame([(t,) for t in texts], "value string").select(F.inline(records._split(F.col("value"))))
    got = list(zip(*[c.to_pylist() for c in records.fastq_records(pa.array(texts))]))
    assert got == [tuple(r) for r in rows.collect()]
    assert records.fastq_texts(pa.array(["a"]), pa.array(["AC"]), pa.array(["II"])).to_pylist() == ["@a\nAC\n+\nII"]


@pytest.mark.parametrize("name", ["hamming_difference", "pair_filter", "quality_scores", "soft_clip", "fastq_round_trip"])
def test_reads_stay_in_the_task(spark, name):
    """Reads, twice as large as their texts, were made in the JVM, row by row, and sent to Python again."""
    plan = getattr(scalars, name)(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
    assert "Generate explode(sequence(1, greatest(1" not in plan
