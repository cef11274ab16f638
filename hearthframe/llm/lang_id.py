"""Language ID by multilingual mixture inference.

Learning: byte trigrams (lower-cased ASCII) of labelled documents are counted for each
language in ``GRAMS`` hashed bins, inside the executors; the driver receives at most languages times
``GRAMS`` sums. Every language is learned, from at most ``SAMPLE`` of its distinct texts: those of least
hash. Copies of a text enter once, so no text outweighs the others and a language with any text
has at least one. Only texts and languages of the learning side are read. The model takes 256 kB
a language.

Prediction: a text is cut in units of ``UNIT`` bytes. Each unit has a log-likelihood under
every language; expectation-maximisation over the units gives the text's language
proportions. The language set is chosen by penalised likelihood: the mixture of all
languages with a share of ``LEAST_SHARE`` or more must beat the best single language by
``PENALTY`` * log(units) for each further language. The prediction is the set's
language of largest share, the score its share.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; without any
learned language all texts are ``und``; ties go to the alphabetically first language;
repeated rows are judged alike; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .frames import LOWER, blocks, column, text_pass, utf8_view

GRAMS = 1 << 16
SAMPLE = 2000
UNIT = 48
ROUNDS, LEAST_SHARE, PENALTY = 12, 0.1, 2.0
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[0x61:0x7B] = True


def grams(data: np.ndarray) -> np.ndarray:
    """Bin of the trigram that starts at each byte; the last two bytes have none of their own."""
    low = LOWER[data].astype(np.uint32)
    h = low.copy()
    h[:-1] |= low[1:] << np.uint32(8)
    h[:-2] |= low[2:] << np.uint32(16)
    return ((h * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int32)


def learn(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities by bin and language) from columns ``text`` and ``lang``."""
    ship(labelled.sparkSession)
    labelled = labelled.filter("lang IS NOT NULL AND text IS NOT NULL AND text <> ''")
    keyed = labelled.select("lang", "text", F.xxhash64("text", F.lit(9)).alias("a"), F.xxhash64("text", F.lit(10)).alias("b"))
    # a count of distinct texts within a few hundredths is enough to thin out before the exact choice
    counts = {r[0]: r[1] for r in keyed.groupBy("lang").agg(F.approx_count_distinct("a", 0.02)).collect()}
    if not counts:
        return [], np.zeros((GRAMS, 0), np.float32)
    langs = sorted(counts)
    thin = {k: n for k, n in counts.items() if n > 2 * SAMPLE}
    if thin:
        share = F.pmod("a", F.lit(1 << 30)) / float(1 << 30)
        rate = F.try_element_at(F.create_map(*[F.lit(x) for k, n in thin.items() for x in (k, 2.0 * SAMPLE / n)]), F.col("lang"))
        keyed = keyed.filter(share < F.coalesce(rate, F.lit(1.0)))
    least = Window.partitionBy("lang").orderBy(F.pmod("a", F.lit(1 << 30)), "a", "b")
    sample = keyed.groupBy("lang", "a", "b").agg(F.first("text").alias("text")).withColumn("r", F.row_number().over(least)).filter(F.col("r") <= SAMPLE).select("lang", "text")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0).to_pylist()
            for lo, hi, data, offs in blocks(*utf8_view(batch.column(1))):
                bins = grams(data)
                for k in range(lo, hi):
                    s = sums.setdefault(names[k], np.zeros(GRAMS, np.int64))
                    s += np.bincount(bins[offs[k - lo] : max(offs[k - lo], offs[k - lo + 1] - 2)], minlength=GRAMS)
        for name, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(s[at], pa.int64())], names=["lang", "bin", "n"])

    sums = sample.mapInArrow(count, "lang string, bin int, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((GRAMS, len(langs)))
    table[sums["bin"].to_numpy(), np.searchsorted(langs, sums["lang"].to_numpy(str))] = sums["n"].to_numpy()
    table += 0.5
    return langs, np.log(table / table.sum(axis=0)).astype(np.float32)


def infer(table: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language number, score) of each row of a block; number -1 without letters."""
    n_rows, n_langs = len(offsets) - 1, table.shape[1]
    best, score = np.full(n_rows, -1), np.zeros(n_rows)
    letters = np.append(0, np.cumsum(ASCII_LETTER[LOWER[data]]))
    lettered = letters[offsets[1:]] > letters[offsets[:-1]]
    raw = None
    for k in np.flatnonzero(~lettered & (np.diff(offsets) > 0)).tolist():
        raw = data.tobytes() if raw is None else raw
        lettered[k] = any(map(str.isalpha, raw[offsets[k] : offsets[k + 1]].decode("utf-8", "replace")))
    rows = np.flatnonzero(lettered)
    if not len(rows) or not n_langs:
        return best, score
    # units: their first bytes, row by row
    units = -(-np.diff(offsets)[rows] // UNIT)
    first_unit = np.cumsum(units) - units
    at = np.repeat(offsets[rows] - first_unit * UNIT, units) + np.arange(units.sum()) * UNIT
    bins = grams(data)
    weight = np.ones(len(data), np.float32)  # trigrams across a text's end do not count
    for back in (1, 2):
        weight[np.maximum(offsets[1:] - back, 0)[np.diff(offsets) >= back]] = 0
    weight[np.repeat(~lettered, np.diff(offsets))] = 0  # nor do rows without letters, which lie between units
    like = np.empty((len(at), n_langs))
    for lang in range(n_langs):
        like[:, lang] = np.add.reduceat(table[bins, lang] * weight, at, dtype=np.float64)
    top = like.max(axis=1, keepdims=True)
    odds = np.exp(like - top)
    each = np.repeat(np.arange(len(rows)), units)
    share = np.full((len(rows), n_langs), 1.0 / n_langs)
    for _ in range(ROUNDS):
        joint = odds * share[each]
        joint /= joint.sum(axis=1, keepdims=True)
        share = np.add.reduceat(joint, first_unit, axis=0) / units[:, None]
    total = np.add.reduceat(like, first_unit, axis=0)
    single = total.argmax(axis=1)
    chosen = share >= LEAST_SHARE
    kept = np.where(chosen, share, 0)
    kept /= kept.sum(axis=1, keepdims=True)
    mixed = np.add.reduceat(np.log(np.maximum((odds * kept[each]).sum(axis=1), 1e-300)) + top[:, 0], first_unit)
    more = chosen.sum(axis=1) - 1
    wins = (more > 0) & (mixed - total.max(axis=1) > PENALTY * more * np.log(units + 1))
    lang = np.where(wins, kept.argmax(axis=1), single)
    best[rows] = lang
    score[rows] = np.where(wins, kept[np.arange(len(rows)), lang], share[np.arange(len(rows)), lang])
    return best, np.clip(score, 0, 1)


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score``. The model (bins times languages floats) is broadcast."""
    langs, table = model
    shared = df.sparkSession.sparkContext.broadcast(table)
    names = np.array([*langs, "und"], object)

    def kernel(col: pa.Array) -> list[pa.Array]:
        best, score = [np.zeros(0, int)], [np.zeros(0)]
        for _, _, data, offs in blocks(*utf8_view(col)):
            b, s = infer(shared.value, data, offs)
            best.append(b), score.append(s)
        return [pa.array(names[np.concatenate(best)].tolist(), pa.string()), pa.array(np.concatenate(score), pa.float64())]

    return text_pass(df, text_col, kernel, "lang_pred string, score double", keep)


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit_documents(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The model of ``documents``: learned where crc32 of the id, modulo 4, is not 2."""
    return learn(docs.filter(~held_out(column("doc_id"))).select("text", "lang"))


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs, fit_documents(docs), keep=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
