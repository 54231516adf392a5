"""Quality classifier by co-training of two views.

View 1 reads the text's content (a histogram of its bytes and a few layout shares), view 2 the
page's metadata (language, source, length). Both are logistic models. In each round each view
scores all documents and hands its confident ones, with the label it gives them, to the other
view, which is fitted anew. At the end each view is calibrated on a held-out fold of the
labelled rows, the calibrated log odds are combined by a third logistic model fitted on that
fold, and every document is scored.

Bounds: about ``max_labelled`` labelled rows and ``max_pseudo`` pseudo-labelled rows a class, view
and round (those with the smallest hashes, by a threshold that follows from their exact number) are
brought to the driver; all counts and scores cover all documents. A class of which the labels have no row, or an empty label table, leaves
nothing to learn: every document then scores the share of good labels (1 without labels).

Edge cases: null text counts as empty; null metadata has features of its own; null labels are
not used, and of rows that repeat an id the greatest label counts; an empty table gives an
empty result; input columns named like a result column are replaced.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, release, strings, table, without

#: Byte classes of the content view: every printable ASCII byte with the cases of letters apart
#: from each other, white space, other controls, and the leading bytes of longer characters.
_CLASS = np.array([0 if b in (9, 10, 13, 32) else 1 if b < 32 or b == 127 else b - 30 if b < 127 else 97 if b < 192 else 98 for b in range(256)])
N_BYTES = 99
CONTENT = N_BYTES + 7
SOURCES, LANGS, SIZES = 64, 16, 24
META = SOURCES + LANGS + SIZES + 3
RESULT = ["content_score", "metadata_score", "score", "kept"]


def content_features(text: str) -> np.ndarray:
    """Content vector of one text."""
    raw = text.encode("utf-8", "surrogatepass")
    out = np.zeros(CONTENT, np.float32)
    if not raw:
        out[N_BYTES] = 1
        return out
    data = np.frombuffer(raw, np.uint8)
    out[:N_BYTES] = np.sqrt(np.bincount(_CLASS, np.bincount(data, minlength=256), N_BYTES) / data.size)
    words = raw.split()
    n = max(1, len(words))
    lines = raw.split(b"\n")
    out[N_BYTES + 1] = min(4.0, data.size / n / 8)
    out[N_BYTES + 2] = len(set(words)) / n
    out[N_BYTES + 3] = len(set(lines)) / len(lines)
    out[N_BYTES + 4] = min(4.0, len(lines) / n * 10)
    out[N_BYTES + 5] = min(2.0, np.log10(1 + n) / 4)
    out[N_BYTES + 6] = np.count_nonzero((data >= 65) & (data <= 90)) / data.size
    return out


def _bucket(value: str, n: int) -> int:
    return xxhash.xxh32_intdigest(value) % n


def metadata_places(lang: str | None, source: str | None, size: int | None) -> list[int]:
    """The places of the ones in the metadata vector."""
    at = SOURCES + LANGS + SIZES
    a = at if source is None else _bucket(source, SOURCES)
    b = at + 1 if lang is None else SOURCES + _bucket(lang, LANGS)
    c = at + 2 if size is None else SOURCES + LANGS + min(SIZES - 1, max(0, int(size)).bit_length())
    return [a, b, c]


def _matrix(texts: pa.Array, langs: pa.Array, sources: pa.Array, sizes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    n = len(texts)
    x = np.zeros((n, CONTENT), np.float32)
    for i, t in enumerate(strings(texts)):
        x[i] = content_features(t)
    z = np.zeros((n, META), np.float32)
    for i, m in enumerate(zip(langs.to_pylist(), sources.to_pylist(), sizes.to_pylist())):
        z[i, metadata_places(*m)] = 1
    return x, z


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, rounds: int = 40, counts: np.ndarray | None = None) -> np.ndarray:
    """Weights (bias last) of a ridge logistic model, by damped Newton steps; ``counts``: rows that each row stands for."""
    c = np.ones(len(x)) if counts is None else counts
    a = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w = np.zeros(a.shape[1])
    ridge = np.full(a.shape[1], l2)
    ridge[-1] = 1e-6

    def loss(v: np.ndarray) -> float:
        return float((c * np.logaddexp(0, -(2 * y - 1) * (a @ v))).sum() + 0.5 * (ridge * v * v).sum())

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        g = a.T @ (c * (p - y)) + ridge * w
        h = (a * (c * (p * (1 - p) + 1e-9))[:, None]).T @ a + np.diag(ridge)
        step = np.linalg.solve(h, g)
        size = 1.0
        while size > 1e-3 and (then := loss(w - size * step)) > now:
            size /= 2
        if size <= 1e-3:
            break
        w = w - size * step
        if now - then < 1e-7 * max(1.0, now):
            break
        now = then
    return w


def _logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x.astype(np.float64) @ w[:-1] + w[-1]


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -35, 35)))


@dataclass(frozen=True)
class Model:
    """Both views, their calibration (scale, shift) and the combination; or a constant score."""

    content: np.ndarray | None
    metadata: np.ndarray | None
    scale: np.ndarray | None
    combine: np.ndarray | None
    constant: float = 1.0

    def views(self, x: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Calibrated log odds of the two views."""
        raw = np.stack([_logit(x, self.content), _logit(z, self.metadata)], axis=1)
        return raw * self.scale[:, 0] + self.scale[:, 1]

    def scores(self, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.content is None:
            flat = np.full(len(x), self.constant)
            return flat, flat, flat
        v = self.views(x, z)
        return _sigmoid(v[:, 0]), _sigmoid(v[:, 1]), _sigmoid(_logit(np.clip(v, -20, 20), self.combine))


def _columns(docs: DataFrame, text_col: str) -> list[Column]:
    low = {c.lower(): c for c in docs.columns}
    of = lambda n, kind: (F.col(f"`{low[n]}`") if n in low else F.lit(None)).cast(kind)
    return [F.col(f"`{text_col}`").cast("string"), of("lang", "string"), of("source", "string"), of("n_chars", "long")]


def _features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, order hash, content vector (float32 bytes) and metadata places of all documents."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long"), *_columns(docs, text_col))

    def run(batches):
        release()
        for b in batches:
            x = [content_features(t).tobytes() for t in strings(b.column(1))]
            z = [metadata_places(*m) for m in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.binary()), pa.array(z, pa.list_(pa.int32()))], names=["id", "x", "z"])

    return rows.mapInArrow(run, "id long, x binary, z array<int>").withColumn("h", F.xxhash64("id", "x"))


def _arrays(rows: list) -> tuple[np.ndarray, np.ndarray]:
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in rows]) if rows else np.zeros((0, CONTENT), np.float32)
    z = np.zeros((len(rows), META), np.float32)
    for i, r in enumerate(rows):
        z[i, r["z"]] = 1
    return x, z


_SPREAD = 1 << 40


def _below(hash_col: str, n: int, most: int) -> Column:
    """True for all of ``n`` rows, or for about ``most`` of them, by their hash."""
    return F.pmod(F.col(hash_col), F.lit(_SPREAD)) < F.lit(_SPREAD if n <= most else _SPREAD * most // n)


def _about(df: DataFrame, hash_col: str, n: int, most: int) -> DataFrame:
    return df if n <= most else df.where(_below(hash_col, n, most))


def train(docs: DataFrame, labels: DataFrame, rounds: int = 3, confidence: float = 0.97, max_labelled: int = 20_000,
          max_pseudo: int = 4_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit both views by co-training. ``confidence``: calibrated probability of a pseudo-label.

    ``max_labelled`` and ``max_pseudo`` bound the rows on the driver; each stands for its share of all
    rows of its kind, so that the fits follow the counts over all documents at every size.
    """
    marked = (
        labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y"))
        .where(F.col("id").isNotNull() & F.col("y").isNotNull()).groupBy("id").agg(F.max("y").alias("y"))
        .withColumn("lh", F.xxhash64("id"))
    )
    n_marked = marked.count()
    marked = _about(marked, "lh", n_marked, max_labelled).select("id", "y")
    n_kept = n_marked if n_marked <= max_labelled else marked.count()
    features = checkpointed(_features(docs, id_col, text_col))
    found = features.join(F.broadcast(marked), "id").select("id", "x", "z", "y", "h")
    n_found = found.count()
    known = _about(found, "h", n_found, max_labelled).collect()
    y = np.array([r["y"] for r in known], np.float64)
    if not len(y) or y.min() == y.max():
        return Model(None, None, None, None, float(y.mean()) if len(y) else 1.0)
    x, z = _arrays(known)
    held = np.array([xxhash.xxh32_intdigest(str(r["id"])) % 5 == 0 for r in known])
    if not held.any() or y[held].min() == y[held].max() or held.all() or y[~held].min() == y[~held].max():
        held = np.ones(len(y), bool)
        fit = held
    else:
        fit = ~held
    each = n_marked / n_kept * n_found / len(y)  # labelled rows that a collected one stands for
    own = np.full(int(fit.sum()), each)
    extra: list[list] = [[np.zeros((0, CONTENT)), np.zeros(0), np.zeros(0)], [np.zeros((0, META)), np.zeros(0), np.zeros(0)]]
    spark = docs.sparkSession
    for turn in range(rounds + 1):
        content = fit_logistic(np.vstack([x[fit], extra[0][0]]), np.concatenate([y[fit], extra[0][1]]), l2=0.1, counts=np.concatenate([own, extra[0][2]]))
        metadata = fit_logistic(np.vstack([z[fit], extra[1][0]]), np.concatenate([y[fit], extra[1][1]]), l2=1.0, counts=np.concatenate([own, extra[1][2]]))
        raw = [_logit(x[held], content), _logit(z[held], metadata)]
        scale = np.array([fit_logistic(r[:, None] / (s := max(1e-6, np.abs(r).max())), y[held], l2=0.5) / np.array([s, 1.0]) for r in raw])
        scale[:, 0] = np.maximum(scale[:, 0], 0.0)  # a view that is no better than chance has no say
        model = Model(content, metadata, scale, None)
        if turn == rounds:
            break
        shared = spark.sparkContext.broadcast(model)

        def confident(batches, shared=shared):
            release()
            m = shared.value
            for b in batches:
                if not b.num_rows:
                    continue
                rows = [{"x": a, "z": c} for a, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
                p = _sigmoid(m.views(*_arrays(rows)))
                for view in (0, 1):
                    sure = (p[:, view] >= confidence) | (p[:, view] <= 1 - confidence)
                    if sure.any():
                        mask = pa.array(sure)
                        part = b.filter(mask)
                        k = part.num_rows
                        yield pa.RecordBatch.from_arrays(
                            [*part.columns, pa.array(np.full(k, view), pa.int32()), pa.array((p[sure, view] > 0.5).astype(np.int32))], names=["id", "x", "z", "h", "view", "guess"]
                        )

        unmarked = features.join(F.broadcast(marked.select("id")), "id", "left_anti").select("id", "x", "z", "h")
        sure = unmarked.mapInArrow(confident, "id long, x binary, z array<int>, h long, view int, guess int")
        counts = {(r["view"], r["guess"]): r["count"] for r in sure.groupBy("view", "guess").count().collect()}
        some = F.lit(False)
        for (view, guess), n in counts.items():
            some = some | ((F.col("view") == view) & (F.col("guess") == guess) & _below("h", n, max_pseudo))
        taken = sure.where(some).collect() if counts else []
        shared.unpersist()
        got = Counter((r["view"], r["guess"]) for r in taken)
        for view in (0, 1):  # what one view is sure of teaches the other
            rows = [r for r in taken if r["view"] == 1 - view]
            share = [counts[k] / got[k] for k in ((r["view"], r["guess"]) for r in rows)]
            extra[view] = [_arrays(rows)[view], np.array([r["guess"] for r in rows], np.float64), np.array(share, np.float64)]
    both = np.clip(model.views(x[held], z[held]), -20, 20)
    return Model(content, metadata, scale, fit_logistic(both, y[held], l2=0.05))


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with content_score, metadata_score, score and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<a: double, b: double, c: double>")
    def scores(texts: pa.Array, langs: pa.Array, sources: pa.Array, sizes: pa.Array) -> pa.Array:
        a, b, c = shared.value.scores(*_matrix(texts, langs, sources, sizes))
        return pa.StructArray.from_arrays([pa.array(v, pa.float64()) for v in (a, b, c)], names=["a", "b", "c"])

    rows = without(docs, [*RESULT, "__ct"])
    out = rows.withColumn("__ct", scores(*_columns(rows, text_col)))
    s = F.col("__ct")
    return out.select(
        *[f"`{c}`" for c in rows.columns], s["a"].alias("content_score"), s["b"].alias("metadata_score"), s["c"].alias("score"), (s["c"] >= threshold).alias("kept")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: scores and verdict of all documents."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels"))).select("doc_id", *RESULT)
