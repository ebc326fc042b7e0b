"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the character 1- to 3-grams of a whole text in lower case, with one space
for whatever stands between its words (white space, ASCII digits and marks), hashed into ``DIMENSIONS`` buckets; weights are tf * idf, scaled to length one.  Document
frequencies cover every row that may be learned from.  The regression is fitted
by follow-the-regularised-leader (per-coordinate, McMahan et al. 2013) with an
elastic-net penalty; its L1 part leaves most of the buckets that occur without a weight.
Its scores are then calibrated by one temperature on rows that it was not fitted on.

The fit reads a sample of at most ``FIT_ROWS`` labelled rows (a documented
bound; those with the smallest hash of id and text) and runs on the driver in a few
seconds, on the packed rows as they came (6 bytes for each bucket of a text: 98 kB a row at
most).  Frequencies and predictions run as Spark tasks over all rows, a few
texts at a time, and nothing is shuffled but one row of counts for each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.llm.names import columns, fresh, quoted, shape_of
from reelspan.llm.scratch import bounded_batches

DIMENSIONS = 1 << 14
ORDERS = 3
FIT_ROWS = 3000
#: Characters handled at once, unless one text is longer.
CHUNK_CHARS = 1 << 18
TEXTS_AT_ONCE = 48

EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.3, 1e-3
UNKNOWN = "und"
#: Of the code points up to 128, those that are no letter (128 stands for all above, which count as letters).
NO_LETTER = np.array([not chr(c).isalpha() for c in range(128)] + [False])
#: Bounds for foreign texts, in spreads: how far the usual (median) fit of kept-back rows lies above that of their least usual hundredth.
#: A text is foreign if it lies ``FAR`` spreads below that hundredth, or ``NEAR`` spreads while its score is not half-way from chance to certain.
FAR, NEAR, HALF = 6.0, 2.0, 0.5
LEAST_SPREAD = 0.1


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, str, np.ndarray]]:
    """(first row, rows, joined lower-case texts, offsets in characters); null counts as empty."""
    n, low = len(texts), 0
    while low < n:
        first, own, size = low, [], 0
        while low < n and len(own) < TEXTS_AT_ONCE and (not own or size < CHUNK_CHARS):
            own.append((texts[low].as_py() or "").lower())
            size += len(own[-1])
            low += 1
        yield first, low - first, "".join(own), np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int64)


def counts(joined: str, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, count) of the hashed n-grams of each text, in order."""
    points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    rows = len(offsets) - 1
    owner = np.repeat(np.arange(rows, dtype=np.int64) * DIMENSIONS, np.diff(offsets))
    # Digits, marks and white space of ASCII are one space between words.
    gap = NO_LETTER[np.minimum(points, 128)]
    more = np.zeros(len(gap), bool)
    more[1:] = gap[1:] & gap[:-1] & (owner[1:] == owner[:-1])
    points, owner = np.where(gap, 32, points).astype(np.uint64)[~more], owner[~more]
    cells = []
    gram = np.zeros(len(points), np.uint64)
    for order in range(ORDERS):
        n = len(points) - order
        if n <= 0:
            break
        gram = gram[:n] * np.uint64(0x100000001B3) + points[order:] + np.uint64(order)
        inside = owner[:n] == owner[order:] if order else slice(None)
        bucket = ((gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)).astype(np.int64)
        cells.append((owner[:n] + bucket)[inside])
    out = np.bincount(np.concatenate(cells), minlength=rows * DIMENSIONS) if cells else np.zeros(0, np.int64)
    cell = np.flatnonzero(out)
    return cell // DIMENSIONS, cell % DIMENSIONS, out[cell]


def tf_idf(text: np.ndarray, bucket: np.ndarray, n: np.ndarray, idf: np.ndarray, rows: int) -> np.ndarray:
    """Weights of each text's buckets, each text's of length one."""
    x = n * idf[bucket]
    return x / np.sqrt(np.bincount(text, weights=x * x, minlength=rows))[text]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found, rows = np.zeros(DIMENSIONS, np.int64), 0
    for batch in batches:
        for _, n, joined, offsets in chunks(batch.column(0)):
            found += np.bincount(counts(joined, offsets)[1], minlength=DIMENSIONS)
            rows += n
    yield pa.RecordBatch.from_arrays([pa.array([*np.flatnonzero(found), -1], pa.int32()), pa.array([*found[found > 0], rows], pa.int64())], names=["bucket", "n"])


def _vectors(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows, joined, offsets in chunks(batch.column(1)):
                text, bucket, n = counts(joined, offsets)
                x = tf_idf(text, bucket, n, idf, rows).astype("<f4")
                bucket, cuts = bucket.astype("<u2"), np.searchsorted(text, np.arange(rows + 1))
                part = lambda values: pa.array([values[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), part(bucket), part(x)], names=["lang", "buckets", "weights"])

    return run


class Model:
    """Weights by bucket and label, the temperature of its scores, and how usual each bucket is in each label's texts."""

    def __init__(self, labels: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0, usual: np.ndarray | None = None):
        self.labels, self.idf, self.weights, self.bias, self.temperature = labels, idf, weights, bias, temperature
        self.usual = np.zeros(weights.shape, np.float32) if usual is None else usual  # log shares of the label's texts that have the bucket
        #: Of kept-back rows, the fit that a hundredth does not reach, and how far the median lies above it.
        self.least, self.spread = -np.inf, LEAST_SPREAD

    def scores(self, text: np.ndarray, bucket: np.ndarray, x: np.ndarray, rows: int) -> np.ndarray:
        """Sparse rows times weights: texts x labels."""
        out = np.tile(self.bias.astype(np.float64), (rows, 1))
        for k in range(len(self.labels)):
            w = self.weights[:, k]
            has = np.flatnonzero(w[bucket])
            out[:, k] += np.bincount(text[has], weights=x[has] * w[bucket[has]], minlength=rows)
        return out

    def predicted(self, text: np.ndarray, bucket: np.ndarray, n: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text its best label, the label's calibrated probability, and the mean log share of its n-grams in that label's texts."""
        p = softmax(self.scores(text, bucket, tf_idf(text, bucket, n, self.idf, rows), rows) / self.temperature)
        best = p.argmax(axis=1)
        total = np.bincount(text, weights=n, minlength=rows)
        fit = np.bincount(text, weights=n * self.usual[bucket, best[text]], minlength=rows) / np.maximum(total, 1)
        return best, np.minimum(p[np.arange(rows), best], 1.0), fit


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, n_labels: int, epochs: int = EPOCHS, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by FTRL-proximal over sparse rows (buckets, weights); the bias has no penalty."""
    z, n = np.zeros((dimensions, n_labels)), np.zeros((dimensions, n_labels))
    z_bias, n_bias = np.zeros(n_labels), np.zeros(n_labels)

    def weight(z: np.ndarray, n: np.ndarray, l1: float = L1, l2: float = L2) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            own_z, own_n = z[at], n[at]
            w, bias = weight(own_z, own_n), weight(z_bias, n_bias, 0.0, 0.0)
            gradient = softmax(x @ w + bias)
            gradient[label[i]] -= 1.0
            g = np.outer(x, gradient)
            squares = own_n + g * g
            z[at] = own_z + g - (np.sqrt(squares) - np.sqrt(own_n)) / ALPHA * w
            n[at] = squares
            z_bias += gradient - (np.sqrt(n_bias + gradient**2) - np.sqrt(n_bias)) / ALPHA * bias
            n_bias += gradient**2
    return weight(z, n).astype(np.float32), weight(z_bias, n_bias, 0.0, 0.0).astype(np.float32)


def fit_temperature(scores: np.ndarray, label: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search.

    Each row's target is drawn in by one row's share, so that scores stay short of certain even if all rows are right.
    """
    target = np.full(scores.shape, 1 / (len(label) + 2) / max(scores.shape[1] - 1, 1))
    target[np.arange(len(label)), label] = 1 - 1 / (len(label) + 2)

    def loss(log_t: float) -> float:
        return -(target * np.log(np.maximum(softmax(scores / np.exp(log_t)), 1e-300))).sum(axis=1).mean()

    low, high = np.log(0.02), np.log(20.0)
    step = (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - step * (high - low), low + step * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def held_out(id_col: str, of: int = 4, remainder: int = 2) -> Column:
    """crc32 of the id as text has this remainder; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(quoted(id_col)).cast("string").cast("binary")) % of == remainder, F.lit(False))


def train(rows: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """A model from ``id, text, lang`` rows; lang must not be null.

    No rows give a model without labels (every text is ``und``), one label gives
    that label with score 1.  Rows without an id are drawn like any others.
    """
    bounded_batches(rows.sparkSession)
    seen = {r["bucket"]: r["n"] for r in rows.select("text").mapInArrow(_frequencies, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    total = seen.pop(-1, 0)
    df = np.zeros(DIMENSIONS)
    df[list(seen)] = list(seen.values())
    idf = np.log((1 + total) / (1 + df)) + 1
    share = 1.0 if total <= fit_rows else min(1.0, 1.5 * fit_rows / total)
    drawn = rows.withColumn("_h", F.xxhash64("id", "text")).where(F.pmod("_h", F.lit(1 << 30)) < int(share * (1 << 30))).orderBy("_h", "lang").limit(fit_rows)
    got = drawn.repartition("_h").select("lang", "text").mapInArrow(_vectors(idf), "lang string, buckets binary, weights binary").collect()
    got.sort()
    labels = sorted({r["lang"] for r in got})
    y = np.array([labels.index(r["lang"]) for r in got], np.int64)
    x = [(np.frombuffer(r["buckets"], "<u2"), np.frombuffer(r["weights"], "<f4")) for r in got]
    kept_back = np.random.default_rng(11).permutation(len(y)) % 5 == 0  # for the temperature
    fitted, rest = np.flatnonzero(~kept_back), np.flatnonzero(kept_back)
    if len(labels) > 1:
        weights, bias = fit_ftrl([x[i] for i in fitted], y[fitted], len(labels))
    else:
        weights, bias = np.zeros((DIMENSIONS, len(labels)), np.float32), np.zeros(len(labels), np.float32)
    has = np.zeros((DIMENSIONS, len(labels)))
    for i in fitted:
        has[x[i][0], y[i]] += 1
    usual = np.log((has + 0.5) / (np.bincount(y[fitted], minlength=len(labels)) + 1)).astype(np.float32)
    model = Model(labels, idf, weights, bias, usual=usual)
    if len(labels) and len(rest):
        # The weights over idf are the counts up to a factor, which a mean does not need.
        scores = np.array([x[i][1] @ weights[x[i][0]] + bias for i in rest])
        model.temperature = fit_temperature(scores, y[rest]) if len(labels) > 1 else 1.0
        fits = [np.average(usual[x[i][0], k], weights=x[i][1] / idf[x[i][0]]) for i, k in zip(rest, scores.argmax(axis=1), strict=True) if len(x[i][0])]
        if fits:
            model.least = float(np.quantile(fits, 0.01))
            model.spread = max(float(np.median(fits)) - model.least, LEAST_SPREAD)
    return model


def predict(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "fit")) -> DataFrame:
    """``docs`` with the predicted language, its score (0 to 1) and fit (see ``Model.predicted``), from the text alone.

    A text that is null or has no letter is ``und`` with score 0.  Empty and very long texts are
    read whole like any others; equal texts get equal answers; an empty table gives no rows.
    Columns of these names in ``docs`` are replaced, others are kept.
    """
    docs = docs.drop(*names)
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.columns
    at = own.index(text)
    docs = docs.toDF(*[f"c{k}" for k in range(len(own))])  # names with dots do not go through mapInArrow
    shape = f"{shape_of(docs)}, lang_pred string, score double, fit double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(at)
            # A cased or uncased letter of any script.
            letter = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            found, scores, fits = [], [], []
            for first, rows, joined, offsets in chunks(texts):
                known = letter[first : first + rows] & bool(model.labels)
                if known.any():
                    best, p, fit = model.predicted(*counts(joined, offsets), rows)
                    found += [model.labels[k] if yes else UNKNOWN for k, yes in zip(best, known, strict=True)]
                    scores += np.where(known, p, 0.0).tolist()
                    fits += fit.tolist()
                else:
                    found += [UNKNOWN] * rows
                    scores += [0.0] * rows
                    fits += [0.0] * rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64()), pa.array(fits, pa.float64())], names=[*batch.schema.names, "lang_pred", "score", "fit"])

    return docs.mapInArrow(run, shape).toDF(*own, *names)


def _learnable(docs: DataFrame, text: str, lang: str, id_col: str) -> DataFrame:
    own = docs.where(F.col(quoted(lang)).isNotNull() & ~held_out(id_col))
    return own.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text)).alias("text"), F.col(quoted(lang)).alias("lang"))


def keep_known(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` whose text is in one of the languages learned from ``lang``.

    What goes has no letter (null and empty texts too), or is foreign: its n-grams are far less
    usual in its best language than those of nearly all texts that were kept back from the fit, or
    less usual while no language stands out.  Bounds are set by the spread of kept-back rows, and a score is
    measured from chance, so neither hangs on the number of labels; a short or mixed text of known languages has usual n-grams and stays.
    Equal texts go or stay together; very long texts are judged whole; an empty table, or one
    without a label, gives no rows.  All columns are kept, whatever their names.
    """
    model = train(_learnable(docs, text, lang, id_col), fit_rows)
    names = fresh(docs, "lang_pred", "score", "fit")
    label, score, fit = columns(names)
    chance = 1 / max(len(model.labels), 1)
    unsure = score < chance + HALF * (1 - chance)
    foreign = (fit < model.least - FAR * model.spread) | ((fit < model.least - NEAR * model.spread) & unsure)
    return predict(docs, model, text, tuple(names)).where((label != UNKNOWN) & ~foreign).select(*columns(docs.columns))


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score``.

    Learns from text and lang of rows whose lang is not null and whose crc32 of the
    id (as text) modulo 4 is not 2; predicts from the text alone.  A text that is null or
    has no letter is ``und``.  Repeated rows get the same prediction; very long texts are
    read whole; an empty table gives no rows; other columns are not read.
    """
    model = train(_learnable(docs, text, lang, id_col), fit_rows)
    rows = docs.select(F.col(quoted(id_col)).cast("bigint").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(quoted(text)).alias("text"))
    return predict(rows, model).drop("text", "fit")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
