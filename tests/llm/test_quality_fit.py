"""The quality model depends on all labelled rows and on the whole of their texts."""

import random

import numpy as np
import pytest

from strandloom.llm import quality


def _tables(spark, n, extra=()):
    rng = random.Random(8)
    words = {1: ["river", "stone", "garden", "quiet", "morning"], 0: ["zzq", "xkcd", "qqwv", "buy", "click"]}
    rows = [(i, i % 2, " ".join(rng.choice(words[i % 2]) for _ in range(20))) for i in range(n)] + list(extra)
    return spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string"), spark.createDataFrame([(i, q, 0) for i, q, _ in rows], "doc_id long, quality int, toxic int")


def test_all_rows_are_counted(spark):
    docs, labels = _tables(spark, 5000)  # more than 1,600 a label, which was the cut
    rows = quality.labelled(docs, labels)
    size = rows.count()
    assert size == labels.filter(~quality.held_out(labels["doc_id"])).count() > 3200
    counts = quality._gram_counts(rows)
    assert counts[:, -1].sum() == sum(-(-len(r.text) // quality.SEGMENT) for r in rows.collect())
    points = quality._points(rows, [b"river stone" * 9, b"zzq buy" * 9], 6)
    assert points["n"].sum() == size


def test_long_texts_tell_too(spark):
    """Texts over 20,000 characters were left out."""
    rng = random.Random(3)
    long = [(10_000 + i, i % 2, " ".join(rng.choice((["lantern", "willow"], ["spamword", "cheapo"])[1 - i % 2]) for _ in range(4000))) for i in range(40)]
    docs, labels = _tables(spark, 0, long)
    got = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert min(got[i] for i, q, _ in long if q) > max(got[i] for i, q, _ in long if not q)


def test_model_does_not_depend_on_partitions(spark):
    docs, labels = _tables(spark, 400)
    one, two = quality.fit(docs.coalesce(1), labels), quality.fit(docs.repartition(7), labels)
    assert (one.good, one.bad) == (two.good, two.bad) and one.slope == pytest.approx(two.slope) and one.offset == pytest.approx(two.offset)


def test_grams_of_segments():
    texts = ["a" * 7, "abcdefgh" * 40, "é" * 300, "x" * 256]
    parts = list(quality._grams(texts, ends=True))
    raw = [t.encode() for t in texts]
    got = [whole[i:j] for _, whole, one, two, _, _ in parts for i, j in zip(one, two)]
    assert got == [r[i : i + quality.SEGMENT] for r in raw for i in range(0, len(r), quality.SEGMENT)]
    distinct = [len({g[i : i + 8] for i in range(len(g) - 7)}) for g in got]
    assert np.bincount(parts[0][4], minlength=len(got)).tolist() == distinct


def test_labelled_texts_are_joined_alike_at_any_size(spark):
    """Small labels were broadcast and larger ones sorted with all texts, labelled or not."""
    docs, labels = _tables(spark, 300)
    docs = docs.unionAll(spark.createDataFrame([(None, "no id"), (7, "a second text"), (900, "no label"), (8, ""), (9, None)], docs.schema))
    plain = docs.filter("length(text) > 0").join(labels, "doc_id").filter(~quality.held_out(labels["doc_id"]))
    for least in ("10MB", "-1"):
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
        try:
            rows = quality.labelled(docs, labels)
            plan = rows._jdf.queryExecution().executedPlan().toString()
            assert plan.count("ShuffledHashJoin") == 1 and "SortMergeJoin" not in plan
            assert plan.count("BroadcastHashJoin") == 1  # the bit table
            assert sorted((r.quality, r.text) for r in rows.collect()) == sorted((r.quality, r.text) for r in plain.collect())
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_label_ids_of_another_type(spark):
    docs, labels = _tables(spark, 100)
    assert quality.labelled(docs, labels.withColumn("doc_id", labels["doc_id"].cast("int"))).count() == quality.labelled(docs, labels).count() > 0


def test_sums_go_in_slices(spark, monkeypatch):
    """All tasks' sums of a label came together as whole rows in one group."""
    docs, labels = _tables(spark, 200)
    rows, seen = quality.labelled(docs, labels).repartition(6), []
    group = type(rows.groupBy())
    plain = group.applyInPandas

    def noted(self, run, schema):
        return plain(self, lambda frame: run(frame).assign(n=frame["sums"].map(len).max()), f"{schema}, n int")

    monkeypatch.setattr(group, "applyInPandas", noted)
    collect = type(rows).collect
    monkeypatch.setattr(type(rows), "collect", lambda self: seen.extend(found := collect(self)) or found)
    counts = quality._gram_counts(rows)
    monkeypatch.undo()
    assert max(r.n for r in seen) <= 8 * (1 << 12) < 8 * counts.shape[1]
    grams = np.zeros_like(counts)
    for r in rows.collect():
        grams[r.quality, -1] += -(-len(r.text) // quality.SEGMENT)
        for *_, bucket in quality._grams([r.text]):
            np.add.at(grams[r.quality], bucket, 1)
    assert (counts == grams).all()
