"""Stupid-backoff language-model scores from the corpus's own n-gram counts.

    S(w | u v) = c(u v w) / c(u v)   if c(u v w) > 0,   else 0.4 S(w | v)
    S(w | v)   = c(v w) / c(v)       if c(v w) > 0,     else 0.4 max(c(w), 1) / max(N, 1)

Counts cover all documents and leave out the scored document's own occurrences, which would
otherwise vouch for themselves; N is the number of words of the other documents. A document's
score is the sum of ln S over its words (words: runs of characters but the six ASCII white
spaces; no padding at the start).

Relational plan: words become 64-bit hashes and n-grams hashes of those. Documents are dealt in
chunks of at most ``chunk_words`` words (a longer document is a chunk of its own, held whole by one task).
Then, for a part of the hash space at a time:

* ``exploded``: the distinct n-grams of each chunk with the chunk's own counts, one row a chunk and
  bucket of the hash space (a frequent n-gram comes once a chunk, so no n-gram is a hot key);
* ``count_table``: exploded, grouped by bucket: each n-gram's count in the whole corpus;
* exploded is joined to the count table by the bucket and n-gram (a cogroup, as the n-grams of
  a row are an array).

The joined counts are gathered by chunk, put back on the positions and summed per document.
Arrays travel sorted, as compressed differences: the same rows one by one are some 400 million for
0.5 GB, 13 bytes each in a shuffle, ten times the input against a disk budget of four.
There are never more rows than distinct n-grams of chunks, however many buckets there are.

Two different n-grams of one 64-bit hash count as one; among n distinct n-grams n^2 / 2^65 such pairs are
expected (one in 6 x 10^9 n-grams, some 10 GB of text; a share of 3 x 10^-6 of all n-grams at 100 TB).

Edge cases: null, empty or wordless text has 0 words and a score of 0 (mean null); repeated rows are
documents of their own and count for each other; null ids are kept; an empty table gives an
empty result; columns beside id and text are not read.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, free_shuffles, grouped_stream, mix64, release, shuffle_width, strings, table, word_hashes

ALPHA = 0.4
_IS_WORD = np.array([b not in (32, 9, 10, 11, 12, 13) for b in range(256)])
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STATE = "chunk long, n_words long, words binary, ids binary, docs binary, lengths binary"


def _press(x: np.ndarray) -> bytes:
    """Byte planes of an array, compressed."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T)
    return zstandard.compress(planes.tobytes(), 1)


def _unpress(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _press_sorted(x: np.ndarray) -> bytes:
    return _press(np.diff(x, prepend=np.uint64(0)))


def _unpress_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpress(raw, np.uint64), dtype=np.uint64)


def _chunks(docs: DataFrame, id_col: str, text_col: str, chunk_words: int) -> DataFrame:
    """One row per chunk: its distinct words, the words' places, and the documents' ids and lengths."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))

    def run(batches):
        release()
        held: list[np.ndarray] = []
        ids: list = []
        size = 0

        def flush():
            words, at = np.unique(np.concatenate(held), return_inverse=True)
            null = np.array([x is None for x in ids])
            keys = np.array([0 if x is None else x for x in ids], np.int64)
            out = [int.from_bytes(os.urandom(8), "little", signed=True), size, _press_sorted(words), _press(at.astype(np.uint32)),
                   _press(keys) , _press(np.array([h.size for h in held], np.int64) * 2 + null)]
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in out], names=[c.split()[0] for c in _STATE.split(", ")])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), strings(b.column(1))):
                h = word_hashes(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8), _IS_WORD)[0]
                if held and size + h.size > chunk_words:
                    yield flush()
                    held, ids, size = [], [], 0
                held.append(h)
                ids.append(i)
                size += int(h.size)
        if held:
            yield flush()

    return rows.mapInArrow(run, _STATE)


class _Grams:
    """The n-grams of a chunk: distinct by document, distinct in all, and their places."""

    def __init__(self, words: bytes, ids: bytes, lengths: bytes, low: int = 0, high: int = 2**64) -> None:
        """``low``, ``high``: hashes that ``grams`` and ``counts`` take."""
        dictionary = _unpress_sorted(words)
        h = dictionary[_unpress(ids, np.uint32)] if dictionary.size else dictionary
        coded = _unpress(lengths, np.int64)
        self.null, self.lengths = (coded & 1).astype(bool), coded >> 1
        n = h.size
        start = np.concatenate(([0], np.cumsum(self.lengths)))
        h2, h3 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        if n > 1:
            h2[1:] = mix64(h[:-1] * _STEP + h[1:])
        if n > 2:
            h3[2:] = mix64(h2[1:-1] * _STEP + h[2:])
        place = np.full((3, n), -1, np.int32)  # of each position's n-gram among the documents' distinct ones
        distinct, counts, size = [], [], 0
        for a, b in zip(start[:-1].tolist(), start[1:].tolist()):
            k = b - a
            if not k:
                continue
            u, at, c = np.unique(np.concatenate([h[a:b], h2[a + 1 : b], h3[a + 2 : b]]), return_inverse=True, return_counts=True)
            at += size
            place[0, a:b] = at[:k]
            place[1, a + 1 : b] = at[k : 2 * k - 1]
            place[2, a + 2 : b] = at[2 * k - 1 :]
            distinct.append(u)
            counts.append(c)
            size += u.size
        del h2, h3
        self.start, self.place = start, place
        self.own = np.concatenate(counts).astype(np.int32) if counts else np.zeros(0, np.int32)
        every = np.concatenate(distinct) if distinct else np.zeros(0, np.uint64)
        del distinct, counts
        if low or high < 2**64:
            mine = (every >= np.uint64(low)) & (every <= np.uint64(high - 1))
            every, self.own = every[mine], self.own[mine]
        self.order = np.argsort(every)
        every = every[self.order]
        self.fresh = np.concatenate((np.ones(min(1, every.size), bool), every[1:] != every[:-1]))
        self.grams = every[self.fresh]

    def counts(self) -> np.ndarray:
        """The chunk's own counts of ``grams``."""
        return np.add.reduceat(self.own[self.order], np.flatnonzero(self.fresh)) if self.grams.size else self.own

    def scores(self, total: np.ndarray, n_words: int) -> np.ndarray:
        """Sum of ln S of each document, given the corpus's counts of ``grams``."""
        others = np.empty(self.own.size, np.float64)
        others[self.order] = total[np.cumsum(self.fresh, dtype=np.int32) - 1]
        others -= self.own
        del self.order, self.fresh, self.grams
        n = self.place.shape[1]
        c = np.where(self.place >= 0, others[np.maximum(self.place, 0)], 0.0) if n else np.zeros((3, 0))
        doc = np.repeat(np.arange(self.lengths.size), self.lengths)
        rest = np.maximum(n_words - self.lengths, 1).astype(np.float64)[doc]
        before = lambda x: np.concatenate(([1.0], x[:-1])) if n else x
        pos = np.arange(n) - self.start[doc]
        backed = np.where(pos >= 2, ALPHA, 1.0)  # from three words to two
        backed2 = backed * np.where(pos >= 1, ALPHA, 1.0)
        s = np.where(
            c[2] > 0, c[2] / np.maximum(before(c[1]), 1.0),
            np.where(c[1] > 0, backed * c[1] / np.maximum(before(c[0]), 1.0), backed2 * np.maximum(c[0], 1.0) / rest),
        )
        return np.bincount(doc, np.log(s), self.lengths.size) if n else np.zeros(self.lengths.size)


_EXPLODED, _COUNTS = "part int, chunk long, grams binary, counts binary", "part int, grams binary, counts binary"


def exploded(state: DataFrame, edges: list[int], first: int, last: int) -> DataFrame:
    """The distinct n-grams of each chunk with its own counts, by buckets ``first`` .. ``last - 1`` of the hash space."""

    def run(batches):
        release()
        for b in batches:
            for chunk, words, ids, lengths in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 5))):
                g = _Grams(words, ids, lengths, edges[first], edges[last])
                counts = g.counts().astype(np.uint32)
                cuts = np.searchsorted(g.grams, np.array(edges[first + 1 : last], np.uint64)).tolist()
                bounds = [(p, x, y) for p, (x, y) in enumerate(zip([0, *cuts], [*cuts, g.grams.size]), first) if y > x]
                for a in range(0, len(bounds), 64):
                    some = bounds[a : a + 64]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([p for p, _, _ in some], pa.int32()), pa.array([chunk] * len(some), pa.int64()),
                         pa.array([_press_sorted(g.grams[x:y]) for _, x, y in some]), pa.array([_press(counts[x:y]) for _, x, y in some])],
                        names=["part", "chunk", "grams", "counts"],
                    )

    return state.mapInArrow(run, _EXPLODED)


def count_table(grams: DataFrame) -> DataFrame:
    """The corpus's counts: one row a bucket, with its n-grams in order and their counts."""

    def add(t: pa.Table) -> pa.Table:
        release()
        found, at = np.unique(np.concatenate([_unpress_sorted(x) for x in t.column("grams").to_pylist()]), return_inverse=True)
        total = np.bincount(at, np.concatenate([_unpress(x, np.uint32) for x in t.column("counts").to_pylist()])).astype(np.uint64)
        return pa.table({"part": t.column("part").slice(0, 1), "grams": [_press_sorted(found)], "counts": [_press(total)]})

    return grams.groupBy("part").applyInArrow(add, _COUNTS)


def join_counts(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """Exploded n-grams joined to the count table: the corpus's counts of each row's n-grams."""

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        release()
        known = _unpress_sorted(right.column("grams")[0].as_py())
        total = _unpress(right.column("counts")[0].as_py(), np.uint64)
        out = [_press(total[np.searchsorted(known, _unpress_sorted(x.as_py()))]) for x in left.column("grams")]
        return pa.table({"chunk": left.column("chunk"), "part": left.column("part"), "total": out})

    return grams.groupBy("part").cogroup(counts.groupBy("part")).applyInArrow(join, "chunk long, part int, total binary")


def _edges(parts: int) -> list[int]:
    return [k * 2**64 // parts for k in range(parts + 1)]


def ngram_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """The count table one n-gram a row: hash (signed) and count of all n-grams of one to three words."""
    parts = parts or shuffle_width(docs.sparkSession)
    table = count_table(exploded(_chunks(docs, id_col, text_col, 2_200_000), _edges(parts), 0, parts))

    def run(batches):
        for b in batches:
            for g, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(_unpress_sorted(g).view(np.int64)), pa.array(_unpress(c, np.uint64).astype(np.int64))], names=["hash", "count"])

    return table.mapInArrow(run, "hash long, count long")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_words: int = 2_200_000,
          grams_a_part: int = 2_000_000, rounds: int = 4) -> DataFrame:
    """doc_id, n_words, log_score and mean_log_score of every document."""
    state = checkpointed(_chunks(docs, id_col, text_col, chunk_words))
    n_words = state.agg(F.sum("n_words")).first()[0] or 0
    parts = max(shuffle_width(docs.sparkSession), -(-2 * n_words // grams_a_part))
    edges = _edges(parts)

    # The hash space is joined in rounds whose answers are written, so that the exploded n-grams' shuffle
    # files, several times as large, take disk for one round at a time.
    answers = None
    for k in range(rounds):
        first, last = k * parts // rounds, (k + 1) * parts // rounds
        if first < last:
            grams = exploded(state, edges, first, last)
            got = checkpointed(join_counts(grams, count_table(grams)))
            answers = got if answers is None else answers.unionByName(got)
            del grams, got
            free_shuffles(docs.sparkSession)
    nothing = F.lit(None).cast("binary")
    joined = answers.select("chunk", "part", "total", *[nothing.alias(c) for c in ("words", "ids", "docs", "lengths")]).unionByName(
        state.select("chunk", F.lit(-1).alias("part"), nothing.alias("total"), "words", "ids", "docs", "lengths")
    )

    def add_up(key, t):
        order = np.argsort(t.column("part").to_numpy(), kind="stable")
        first = int(order[0])
        g = _Grams(*(t.column(c)[first].as_py() for c in ("words", "ids", "lengths")))
        totals = t.column("total")
        got = [_unpress(totals[int(i)].as_py(), np.uint64) for i in order[1:]]
        total = np.concatenate(got).astype(np.int64) if got else np.zeros(0, np.int64)
        if total.size != g.grams.size:
            raise RuntimeError("a chunk's answers are incomplete")
        s = g.scores(total, n_words)
        ids = _unpress(t.column("docs")[first].as_py(), np.int64)
        return [pa.RecordBatch.from_arrays([pa.array(ids, mask=g.null), pa.array(g.lengths), pa.array(s)], names=["doc_id", "n_words", "log_score"])]

    out = grouped_stream(joined, ["chunk"], add_up, "doc_id long, n_words long, log_score double")
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return out.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"), F.round(mean, 6).alias("mean_log_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: scores of all documents."""
    return score(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
n AS (SELECT coalesce(sum(len(ws)), 0) AS n_all FROM t),
p AS (SELECT r, i, ws[i] AS w, ws[i - 1] AS v, ws[i - 2] AS u FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM t)),
q AS (SELECT r, i, w, CASE WHEN i >= 2 THEN [v, w] END AS b, CASE WHEN i >= 3 THEN [u, v, w] END AS g FROM p),
c1 AS (SELECT w, count(*) AS c FROM q GROUP BY w), d1 AS (SELECT r, w, count(*) AS c FROM q GROUP BY r, w),
c2 AS (SELECT b, count(*) AS c FROM q WHERE b IS NOT NULL GROUP BY b), d2 AS (SELECT r, b, count(*) AS c FROM q WHERE b IS NOT NULL GROUP BY r, b),
c3 AS (SELECT g, count(*) AS c FROM q WHERE g IS NOT NULL GROUP BY g), d3 AS (SELECT r, g, count(*) AS c FROM q WHERE g IS NOT NULL GROUP BY r, g),
l1 AS (SELECT d1.r, d1.w, c1.c - d1.c AS c FROM d1 JOIN c1 USING (w)),
l2 AS (SELECT d2.r, d2.b, c2.c - d2.c AS c FROM d2 JOIN c2 USING (b)),
l3 AS (SELECT d3.r, d3.g, c3.c - d3.c AS c FROM d3 JOIN c3 USING (g)),
x AS (SELECT q.r, q.i, l1.c AS x1, l2.c AS x2, l3.c AS x3 FROM q JOIN l1 ON q.r = l1.r AND q.w = l1.w
      LEFT JOIN l2 ON q.r = l2.r AND q.b = l2.b LEFT JOIN l3 ON q.r = l3.r AND q.g = l3.g),
y AS (SELECT *, lag(x1) OVER o AS y1, lag(x2) OVER o AS y2 FROM x WINDOW o AS (PARTITION BY r ORDER BY i)),
s AS (SELECT y.r, sum(ln(CASE WHEN x3 > 0 THEN x3 / y2 WHEN x2 > 0 THEN CASE WHEN i >= 3 THEN 0.4 ELSE 1 END * x2 / y1
        ELSE CASE WHEN i >= 3 THEN 0.4 ELSE 1 END * CASE WHEN i >= 2 THEN 0.4 ELSE 1 END * greatest(x1, 1) / greatest(n_all - len(ws), 1) END::DOUBLE)) AS log_score
      FROM y JOIN t USING (r), n GROUP BY y.r)
SELECT doc_id, len(ws) AS n_words, round(coalesce(log_score, 0), 6) AS log_score,
  CASE WHEN len(ws) > 0 THEN round(log_score / len(ws), 6) END AS mean_log_score
FROM t LEFT JOIN s USING (r)
"""
