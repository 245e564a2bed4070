"""A convolutional text classifier: hashed word embeddings, several filter widths, max pooling."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.wordhash import Spans, runs
from tessera.session import materialize, remove

#: Buckets of the embedding table and its width; filters of each width in words.
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 16, 8, (1, 2, 3)
#: A word is embedded as the sum of the rows for itself and for its beginnings of these many bytes.
STEMS = (4, 5)
#: The fit reads a bounded sample: at most this many labelled documents of each class, in the order of a hash of
#: the id, of those whose text has at most FIT_BYTES bytes. What the driver holds is at most their product.
FIT_ROWS, FIT_BYTES = 3_000, 1 << 16
#: Thresholds come from counts of scores in this many steps, and by language where both classes have this many rows.
STEPS, LEAST_ROWS = 1_000, 20
EPOCHS, BATCH, RATE = 8, 16, 0.02
#: Small samples are gone through more often, up to this many batches but no more than 60 times.
BATCHES = 1_500
#: Words that a task scores together.
WINDOW = 1 << 14
#: The decision that the query reports; stages use the thresholds by language.
CUT = 0.3

_letters = np.zeros(256, bool)
_letters[128:] = True
for _span in (b"az", b"09"):
    _letters[_span[0] : _span[1] + 1] = True


def word_rows(text: str | None) -> np.ndarray:
    """Bucket numbers, a row per word and a column per hashed form. Words are runs of letters and digits."""
    data = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
    begin, end = runs(_letters[data])
    spans = Spans(data)
    forms = [spans.hashes(begin, end)] + [spans.hashes(begin, np.minimum(begin + n, end)) + np.uint64(n) for n in STEMS]
    return np.stack([(h >> np.uint64(64 - 16)).astype(np.uint16) for h in forms], axis=1)


@dataclass
class TextCNN:
    """Parameters: embedding table, filters [input, width step, filter], their bias, output weights and bias."""

    table: np.ndarray
    kernels: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: dict[str | None, float] = field(default_factory=dict)

    @staticmethod
    def fresh(seed: int = 7) -> TextCNN:
        rng = np.random.default_rng(seed)
        scale = 1 / np.sqrt(DIM)
        return TextCNN(rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), [rng.normal(0, scale / np.sqrt(w), (DIM, w, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(FILTERS * len(WIDTHS), np.float32), rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), 0.0)

    def embed(self, rows: np.ndarray) -> np.ndarray:
        return self.table[rows].sum(axis=1)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per filter its greatest response over the text and where that is. Texts are padded with zero words."""
        if len(x) < max(WIDTHS):
            x = np.concatenate([x, np.zeros((max(WIDTHS) - len(x), DIM), np.float32)])
        best, at = [], []
        for kernel in self.kernels:
            w = kernel.shape[1]
            response = (x @ kernel.reshape(DIM, -1)).reshape(len(x), w, FILTERS)
            n = len(x) - w + 1
            total = response[:n, 0]
            for k in range(1, w):
                total = total + response[k : n + k, k]
            where = total.argmax(axis=0)
            at.append(where)
            best.append(total[where, np.arange(FILTERS)])
        return np.concatenate(best) + self.bias, np.concatenate(at)

    def score(self, rows: np.ndarray) -> float:
        """The probability of a text given its word rows; pooled in overlapping windows, whatever its length."""
        step, best = WINDOW - max(WIDTHS) + 1, None
        for begin in range(0, max(1, len(rows) - max(WIDTHS) + 1), step):
            top, _ = self.pooled(self.embed(rows[begin : begin + WINDOW]))
            best = top if best is None else np.maximum(best, top)
        return float(1 / (1 + np.exp(-(np.maximum(best, 0) @ self.out + self.out_bias))))

    def start(self, texts: list[np.ndarray], labels: np.ndarray) -> None:
        """Let the first component of every bucket begin as the surplus of label 1 among its texts, in
        deviations, and one filter of each width begin with it: max pooling gives no gradient to words that
        do not win, so with few texts telling words would be found late."""
        seen, hits = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for rows, y in zip(texts, labels, strict=True):
            own = np.unique(rows)
            seen[own] += 1
            hits[own] += y
        share = labels.mean()
        surplus = (hits - share * seen) / np.sqrt(share * (1 - share) * seen + 1)
        self.table[:, 0] = np.clip(surplus / 4, -1, 2)
        for k, kernel in enumerate(self.kernels):
            kernel[:, :, 0] *= 0.1
            kernel[0, 0, 0] = 1.0
            self.out[k * FILTERS] = 0.5

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> None:
        """Adagrad on the cross-entropy. Only the words that won a pool have a gradient."""
        rng = np.random.default_rng(seed)
        self.start(texts, labels)
        squares = {k: np.full(getattr(self, k).shape, 1e-4, np.float32) for k in ("table", "bias", "out")}
        kernel_squares, bias_square = [np.full(k.shape, 1e-4, np.float32) for k in self.kernels], 1e-4
        for _ in range(max(EPOCHS, min(60, -(-BATCHES * BATCH // max(1, len(texts)))))):
            order = rng.permutation(len(texts))
            for start in range(0, len(order), BATCH):
                grads = [np.zeros_like(k) for k in self.kernels]
                g_bias, g_out, g_b, touched, moves = np.zeros_like(self.bias), np.zeros_like(self.out), 0.0, [], []
                for i in order[start : start + BATCH]:
                    rows = texts[i]
                    x = self.embed(rows)
                    top, at = self.pooled(x)
                    hidden = np.maximum(top, 0)
                    error = 1 / (1 + np.exp(-(hidden @ self.out + self.out_bias))) - labels[i]
                    g_out += error * hidden
                    g_b += error
                    inner = error * self.out * (top > 0)
                    g_bias += inner
                    for j, kernel in enumerate(self.kernels):
                        d = inner[j * FILTERS : (j + 1) * FILTERS]
                        for f in np.flatnonzero(d):
                            p = at[j * FILTERS + f]
                            seen = x[p : p + kernel.shape[1]]
                            grads[j][:, : len(seen), f] += d[f] * seen.T
                            for k in range(len(seen)):
                                touched.append(rows[p + k])
                                moves.append(d[f] * kernel[:, k, f])
                if touched:
                    where, group = np.unique(np.concatenate(touched), return_inverse=True)
                    g = np.zeros((len(where), DIM), np.float32)
                    np.add.at(g, group, np.repeat(np.array(moves), len(touched[0]), axis=0))
                    squares["table"][where] += g * g
                    self.table[where] -= RATE * g / np.sqrt(squares["table"][where])
                for name, g in (("bias", g_bias), ("out", g_out)):
                    squares[name] += g * g
                    getattr(self, name)[...] -= RATE * g / np.sqrt(squares[name])
                for k, s, g in zip(self.kernels, kernel_squares, grads, strict=True):
                    s += g * g
                    k -= RATE * g / np.sqrt(s)
                bias_square += g_b * g_b
                self.out_bias -= RATE * g_b / np.sqrt(bias_square)


def best_cut(counts: dict[int, tuple[int, int]]) -> float:
    """The score in the middle of the gap below the steps of best F1, given (rows of label 0, of label 1) by step."""
    steps = sorted(counts, reverse=True)
    wrong = np.cumsum([counts[k][0] for k in steps])
    right = np.cumsum([counts[k][1] for k in steps])
    k = int((2 * right / (right + wrong + right[-1])).argmax())
    below = steps[k + 1] if k + 1 < len(steps) else 0
    return (steps[k] + below) / 2 / STEPS


def held_out(id_col: str):
    """Rows that the fit never sees: those whose id as text has a CRC-32 of 2 modulo 4."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def _labelled(labels: DataFrame, label_col: str, id_col: str) -> DataFrame:
    """(__id, __y): the ids with a label that are not held out. An id with several labels has the highest."""
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    return usable.groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.max((F.col(label_col) != 0).cast("int")).alias("__y"))


def _part(column: Column) -> Column:
    """A number from 0 to 4 from an id; ids of 4 are kept from the fit, for the thresholds."""
    return F.pmod(F.xxhash64(column, F.lit("part")), F.lit(5))


def _as_word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as the bytes of their word rows, so that no text comes to the driver."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([word_rows(t.as_py()).tobytes() for t in batch.column(2)], pa.binary())], ["__id", "__y", "__w"])


def fit_classifier(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> TextCNN:
    """Fit on a bounded sample of labelled documents that are not held out (FIT_ROWS, FIT_BYTES).

    The sample has up to as many of either class, so that a rare class is learned; the bias is then set back to
    the share of label 1 among all labelled ids, so scores mean the same whatever the size of the table. Labels
    that are null or without a document are left out, of rows that repeat an id one is read (the least by
    a hash of its text), and with one class alone the model stays untrained and gives its share as the score.
    """
    usable, path = materialize(_labelled(labels, label_col, id_col), "toxic-labels")
    counts = dict(usable.groupBy("__y").count().collect())
    short = docs.where(F.octet_length(F.coalesce(text_col, F.lit(""))) <= FIT_BYTES)
    picked = None
    for y in (0, 1):
        some = usable.where((F.col("__y") == y) & (_part(F.col("__id")) < 4)).orderBy(F.xxhash64("__id"), "__id").limit(FIT_ROWS)
        picked = some if picked is None else picked.union(some)
    # Bounded by FIT_ROWS rows of two numbers a class; and then by these rows with the numbers of FIT_BYTES of words each.
    met = short.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__t")).join(F.broadcast(picked), "__id")
    one = met.groupBy("__id", "__y").agg(F.min_by("__t", F.struct(F.xxhash64("__t"), "__t")).alias("__t"))
    rows = one.mapInArrow(_as_word_rows, "__id long, __y int, __w binary").collect()
    remove(docs.sparkSession, path)
    rows.sort(key=lambda r: r["__id"])
    model = TextCNN.fresh()
    y = np.array([r["__y"] for r in rows], np.float32)
    share = lambda one, zero: float(np.log((one + 1e-3) / (zero + 1e-3)))
    if not len(y) or y.all() or not y.any():
        model.out[...] = 0
        model.out_bias = share(counts.get(1, 0), counts.get(0, 0)) if counts else share(0, 1)
        return model
    texts = [np.frombuffer(r["__w"], np.uint16).reshape(-1, 1 + len(STEMS)) for r in rows]
    texts = [t if len(t) else np.zeros((1, 1 + len(STEMS)), np.uint16) for t in texts]
    model.fit(texts, y)
    model.out_bias += share(counts[1], counts[0]) - share(y.sum(), len(y) - y.sum())
    return model


def calibrate(model: TextCNN, docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> TextCNN:
    """The model with thresholds: by language the cut of best F1 over all labelled documents that are neither held
    out nor of the fit's part. Languages with fewer than LEAST_ROWS rows of either class, and tables without a
    language column, take the cut of all (key None); without both classes that is CUT.

    Scores are counted in STEPS steps by language and label, so what is collected does not grow with rows.
    """
    asked = _labelled(labels, label_col, id_col).where(_part(F.col("__id")) == 4)
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    scored = score_documents(docs.select(F.col(id_col).cast("long").alias("__id"), lang.alias("__lang"), F.col(text_col).alias("__t")).where(_part(F.col("__id")) == 4), model, "__id", "__t", "__s")
    counted = scored.select("__id", "__lang", F.floor(F.col("__s") * STEPS).cast("int").alias("step")).join(asked, "__id").groupBy("__lang", "step").agg(F.count(F.when(F.col("__y") == 0, 1)).alias("zero"), F.count(F.when(F.col("__y") == 1, 1)).alias("one"))
    by: dict = {None: {}}
    for r in counted.collect():
        for key in {None, r["__lang"]}:
            own = by.setdefault(key, {})
            zero, one = own.get(r["step"], (0, 0))
            own[r["step"]] = (zero + r["zero"], one + r["one"])
    total = lambda of: min(sum(c[i] for c in of.values()) for i in (0, 1))
    model.thresholds = {None: best_cut(by[None]) if total(by[None]) else CUT}
    model.thresholds |= {key: best_cut(of) for key, of in by.items() if key is not None and total(of) >= LEAST_ROWS}
    return model


def score_documents(docs: DataFrame, model: TextCNN, id_col: str = "doc_id", text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with the column `out`: the probability of label 1, from the whole text alone.

    A null text is empty; an empty text is scored as one without words. All columns are kept (one
    named `out` is replaced), so repeated rows and null ids need no join. The model goes to each
    executor once; its size is fixed.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            scores = pa.array([own.score(word_rows(t.as_py())) for t in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, out])

    base = docs.drop(out)
    return base.mapInArrow(work, T.StructType([*base.schema.fields, T.StructField(out, T.DoubleType())]))


def reject_toxic(docs: DataFrame, model: TextCNN, lang_col: str = "lang", **columns: str) -> DataFrame:
    """The documents whose score stays below their language's threshold, with the columns of docs.

    The language chooses the threshold only, never the score; a null or unseen one takes the general
    threshold.
    """
    known = lang_col in docs.columns
    cuts = [] if not known else [F.when(F.col(lang_col) == lang, F.lit(cut)) for lang, cut in model.thresholds.items() if lang is not None]
    scored = score_documents(docs, model, out="__toxic_score", **columns)
    return scored.where(F.col("__toxic_score") < F.coalesce(*cuts, F.lit(model.thresholds[None]))).drop("__toxic_score")


def toxicity_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score, predicted (1 from a score of CUT on)."""
    model = fit_classifier(docs, labels, id_col=id_col, text_col=text_col)
    scored = score_documents(docs.select(id_col, text_col), model, id_col, text_col)
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
