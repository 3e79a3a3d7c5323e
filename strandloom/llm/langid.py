"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; letters are kept and every other run of characters is one
blank. The 1- to 3-grams are hashed to ``buckets`` columns; counts of the
training rows give a matrix of log probabilities with add-``alpha`` smoothing,
which is broadcast. Every language of the training rows is learned; above
``cells`` / ``buckets`` of them the columns become fewer, so that the matrix
stays within ``cells`` numbers up to ``cells`` / 256 languages. Scoring sums
matrix rows over a text's n-grams, batch by batch. Languages have equal priors,
as each is fitted on a sample of its own.

The matrix is fitted on at most ``fit_rows`` rows of each language, those of
least hash of their id, of at most ``fit_chars`` characters (longer
ones only where a language has too few others). Null texts and texts without a
letter are ``und`` with score 0; without training rows all are. A null id is in no fold: its
``held_out`` is null and it isn't learned from. Repeated rows are judged each; an
empty table gives no rows; columns besides doc_id, text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from strandloom.llm.text import chunks, mix

FOLDS, HELD = 4, 2
ORDERS = (1, 2, 3)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % FOLDS == HELD


def _table() -> np.ndarray:
    """Code point to its lower-case letter, or 0 where it is no letter."""
    found = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            found[code] = ord(low) if len(low) == 1 else code
    return found


_LETTERS: list[np.ndarray] = []


def grams(texts: list[str | None], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed columns, each one's text, and which texts have a letter."""
    if not _LETTERS:
        _LETTERS.append(_table())
    parts = ["" if t is None else t for t in texts]
    joined = " " + "  ".join(parts) + " "
    code = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), size + 2)
    letter = _LETTERS[0][np.minimum(code, 0x10FFFF)]
    blank = letter == 0
    keep = ~(blank & np.concatenate([[False], blank[:-1] & (owner[1:] == owner[:-1])]))
    letter, owner = letter[keep], owner[keep]
    has = np.bincount(owner, letter > 0, minlength=len(parts)) > 0
    columns, owners, n = [], [], len(letter)
    wide = letter.astype(np.uint64)
    run = np.zeros(n, np.uint64)
    for k in range(1, max(ORDERS) + 1):
        m = n - k + 1
        if m <= 0:
            break
        run = run[:m] * _A + wide[k - 1 :] + np.uint64(1)
        if k in ORDERS:
            ok = owner[:m] == owner[k - 1 :]
            if k == 1:
                ok &= letter > 0
            columns.append((mix(run[ok] * _B + np.uint64(k)) & np.uint64(buckets - 1)).astype(np.int32))
            owners.append(owner[:m][ok])
    return np.concatenate(columns), np.concatenate(owners), has


def fit(docs: DataFrame, fit_rows: int = 1000, fit_chars: int = 20_000, buckets: int = 1 << 15, alpha: float = 0.5, cells: int = 1 << 24) -> tuple[list[str], np.ndarray]:
    """Learned language values and the log-probability matrix. Uses text and lang only; texts above ``fit_chars`` are chosen last."""
    size = F.length("text")
    rows = docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (size > 0))
    rows = rows.withColumn("turn", F.xxhash64("doc_id"))
    # a first cut by hash bounds what the ranking below has to hold
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], np.zeros((0, buckets), np.float32)
    langs = sorted(counts)
    while buckets > 256 and buckets * len(langs) > cells:
        buckets >>= 1
    part = F.pmod("turn", F.lit(1 << 20))
    cut = docs.sparkSession.createDataFrame([(k, min(1 << 20, int((1 << 20) * 2 * fit_rows / n) + 1)) for k, n in counts.items()], "lang string, cut long")
    first = Window.partitionBy("lang").orderBy(F.length("text") > fit_chars, "turn", "doc_id", "text")
    few = rows.join(cut, "lang").filter(part < F.col("cut")).withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= fit_rows)
    place = {k: i for i, k in enumerate(langs)}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(langs), buckets), np.int64)
        for frame in frames:
            for piece in chunks([frame]):
                column, owner, _ = grams(list(piece["text"]), buckets)
                lang = piece["lang"].map(place).to_numpy(np.int64)
                total += np.bincount(lang[owner] * buckets + column, minlength=total.size).reshape(total.shape)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at, "n": total.ravel()[at]})

    sums = few.mapInPandas(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # languages x buckets at most
    matrix = np.full(len(langs) * buckets, alpha)
    matrix[sums["at"].to_numpy(np.int64)] += sums["n"].to_numpy(np.float64)
    matrix = matrix.reshape(len(langs), buckets)
    return langs, np.log(matrix / matrix.sum(1, keepdims=True)).astype(np.float32)


def predict(docs: DataFrame, langs: list[str], matrix: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score: the best language and its share of the likelihood, tempered by text length; ties go to the first by name."""
    sent = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(matrix.T))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = sent.value
        for frame in frames:
            for piece in chunks([frame], most=1 << 20):
                texts = [t if isinstance(t, str) else None for t in piece["text"]]
                column, owner, has = grams(texts, max(1, table.shape[0]))
                ok = has & (table.shape[1] > 0)
                if not ok.any():
                    yield pd.DataFrame({"doc_id": piece["doc_id"], "lang_pred": "und", "score": 0.0})
                    continue
                total = np.column_stack([np.bincount(owner, table[column, j], minlength=len(texts)) for j in range(table.shape[1])])
                total /= np.maximum(1, np.bincount(owner, minlength=len(texts)))[:, None] ** 0.5
                best = total.argmax(1)
                share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                yield pd.DataFrame({"doc_id": piece["doc_id"], "lang_pred": np.where(ok, np.array(langs, object)[best], "und"), "score": np.where(ok, share, 0.0)})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, **options) -> DataFrame:
    return predict(docs, *fit(docs, **options))
