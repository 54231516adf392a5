"""Vector best-fit packing of documents into token sequences.

Every piece of a document is a vector (tokens, 1 document, attention cost = tokens squared) and
every sequence has a capacity in each component. Pieces go in decreasing length; among the open
sequences with room in *every* component the one with the smallest weighted residual norm after
placing (or the greatest weighted dot product of residual and piece) is selected, and a new
sequence is opened only when none fits.

Pieces of equal length are equal vectors, so the plan is made over the histogram of lengths: open
sequences with equal residuals are one class with a count. The plan has at most a few rows for
each length whatever the number of documents; it is made on the driver and broadcast. Each piece
finds its slot by its rank among the pieces of its length; ranks are counted by (length, salt) with a
salt drawn from the place of the row in the written pieces, so neither a length nor equal rows meet in one task.

Edge cases: null text counts as empty (one end token); pieces of repeated rows are placed each;
documents longer than a sequence are cut into full pieces and a rest; an empty table gives an
empty result; other input columns are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, strings, table
from .word_bpe import encoder

END_ID = 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Capacity:
    """What a sequence may hold, and the components' weights. None: no limit beyond the tokens'."""

    tokens: int = 4096
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 1e-4, 1e-4)
    rule: str = "norm"  # or "dot"

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], np.float64)


def plan(lengths: np.ndarray, counts: np.ndarray, cap: Capacity) -> tuple[np.ndarray, int]:
    """Vector best-fit decreasing over a histogram.

    Returns rows (length, first rank, first sequence, slots a sequence, first offset) sorted by
    length and rank, and the number of sequences.
    """
    c = cap.vector()
    w = np.asarray(cap.weights, np.float64)
    order = np.argsort(-lengths)
    room = 1024
    res = np.zeros((room, 3))  # residual of each class of open sequences
    lo, num, used = np.zeros(room, np.int64), np.zeros(room, np.int64), np.zeros(room, np.int64)
    n_class, n_seq, rows = 0, 0, []

    def add(r: np.ndarray, first: int, k: int, offset: int) -> None:
        nonlocal n_class, room, res, lo, num, used
        if n_class == room:
            keep = np.flatnonzero(num[:n_class] > 0)
            m = keep.size
            res[:m], lo[:m], num[:m], used[:m] = res[keep], lo[keep], num[keep], used[keep]
            n_class = m
            if 2 * m > room:
                room *= 2
                res = np.concatenate([res, np.zeros_like(res)])
                lo, num, used = (np.concatenate([x, np.zeros_like(x)]) for x in (lo, num, used))
        res[n_class], lo[n_class], num[n_class], used[n_class] = r, first, k, offset
        n_class += 1

    for i in order:
        length, left, rank = int(lengths[i]), int(counts[i]), 0
        v = np.array([length, 1.0, float(length) ** 2])
        if (v > c).any():
            raise ValueError(f"a piece of {length} tokens exceeds a sequence's capacity")
        while left:
            r = res[:n_class]
            fits = np.flatnonzero((num[:n_class] > 0) & (r >= v).all(axis=1))
            if fits.size:
                rest = (r[fits] - v) / c
                score = -(w * rest**2).sum(axis=1) if cap.rule == "norm" else ((w * (r[fits] / c)) * (v / c)).sum(axis=1)
                j = int(fits[int(np.argmax(score))])
                state, first, have, offset = res[j].copy(), int(lo[j]), int(num[j]), int(used[j])
            else:
                j, state, first, have, offset = -1, c.copy(), n_seq, left, 0
            # By the norm, and if nothing else has room, a sequence stays the best for the next equal piece; by the
            # dot product one with less room scores less, so each sequence of the class gets one.
            m = 1 if j >= 0 and cap.rule == "dot" else int(min((state / v).min(), left))
            k = min(have, left // m)
            rows.append((length, rank, first, m, offset))
            rank, left = rank + k * m, left - k * m
            if j >= 0:
                lo[j], num[j] = first + k, have - k
            else:
                n_seq += k
            after = state - m * v
            if after[0] >= 1 and after[1] >= 1 and after[2] >= 1:
                add(after, first, k, offset + m * length)
    out = np.array(rows, np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))], n_seq


def pieces_of(docs: DataFrame, tokenizer: str, cap: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """One row per piece: its place in the document, length and checksum (and ids)."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    end = np.asarray([END_ID], "<u4").tobytes()
    size = 4 * cap

    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            texts, ids = strings(batch.column(1)), batch.column(0).to_pylist()
            for a in range(0, len(texts), 512):
                out = []
                for doc, raw in zip(ids[a : a + 512], enc.encode(texts[a : a + 512])):
                    raw += end
                    for k, at in enumerate(range(0, len(raw), size)):
                        part = raw[at : at + size]
                        out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), part))
                cols = list(zip(*out))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                arrays = [pa.array(c, t) for c, t in zip(cols, kinds)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in cols[5]], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)
        enc.rest()

    return rows.mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def pack(docs: DataFrame, tokenizer: str | None = None, cap: Capacity = Capacity(), id_col: str = "doc_id",
         text_col: str = "text", with_ids: bool = False, salt_rows: int = 100_000, cut: int | None = None) -> DataFrame:
    """Pieces with sequence_id and offset; ``with_ids`` adds the token ids.

    ``cut``: length of a piece at most, a sequence's by default (one piece must fit every limit).

    ``salt_rows``: about as many pieces share a salt, so a group of equal length is split
    over as many ranks counters as the data need.
    """
    tokenizer = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    pieces = checkpointed(pieces_of(docs, tokenizer, cut or cap.tokens, id_col, text_col, with_ids))
    hist = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most cap.tokens rows
    total = sum(hist.values())
    salts = max(256, -(-total // salt_rows))
    lengths = np.array(sorted(hist), np.int64)
    rows, _ = plan(lengths, np.array([hist[x] for x in lengths], np.int64), cap)
    shared = docs.sparkSession.sparkContext.broadcast(rows)

    salted = pieces.withColumn("__pk_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)))
    sizes = salted.groupBy("length", "__pk_salt").agg(F.count(F.lit(1)).alias("__pk_n"))
    before = Window.partitionBy("length").orderBy("__pk_salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("length", "__pk_salt", F.coalesce(F.sum("__pk_n").over(before), F.lit(0)).alias("__pk_first"))
    local = F.row_number().over(Window.partitionBy("length", "__pk_salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("__pk_local", local).join(firsts, ["length", "__pk_salt"])
    names = [c for c in pieces.columns]
    ranked = ranked.select(*names, (F.col("__pk_first") + F.col("__pk_local") - 1).cast("long").alias("__pk_rank"))
    at = names.index("length")
    schema = PIECES + (", ids array<int>" if with_ids else "") + ", sequence_id long, offset long"

    def place(batches):
        p = shared.value
        key = (p[:, 0] << 44) + p[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column(at).to_numpy(zero_copy_only=False)
            rank = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            i = np.searchsorted(key, (length << 44) + rank, side="right") - 1
            t = rank - p[i, 1]
            seq, off = p[i, 2] + t // p[i, 3], p[i, 4] + (t % p[i, 3]) * length
            arrays = [batch.column(k) for k in range(len(names))] + [pa.array(seq, pa.int64()), pa.array(off, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """Sequences of a ``pack(..., with_ids=True)``: sequence_id, input_ids, doc_ids and starts."""
    rows = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(rows.alias("r")).select(
        "sequence_id", F.flatten("r.ids").alias("input_ids"), F.col("r.doc_id").alias("doc_ids"), F.col("r.offset").alias("starts")
    )


def limits_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens, 12 documents and 8 million units of attention cost: limits that bind."""
    cap = Capacity(documents=12, attention=8_000_000, weights=(1.0, 0.5, 0.5), rule="dot")
    return pack(table(spark, sf_dir, "documents"), cap=cap, cut=2048)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: all documents in sequences of at most 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"))
