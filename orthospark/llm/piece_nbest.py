"""N-best segmentation over the lattice of a SentencePiece vocabulary, and decoding.

Scores: those of a unigram model are log probabilities and are taken as they are. Those of a BPE model are
merge ranks, whose sums are no likelihoods (they prefer crumbs); they become log probabilities by Zipf's law,
p(rank) in proportion to 1 / (rank + 2.7), in steps of 2^-20, so that sums are exact.

The lattice of a text has a node between any two characters and an edge for every piece that
matches; a character that is no piece has one edge with its byte pieces. A segmentation's score
is the sum of its pieces' scores. Forward Viterbi gives every node the best score from the
start, which is an exact heuristic for an A* search that runs backward from the end: complete
paths leave its queue in order of score, so the first N are the N best.

Text: one space is put in front, spaces become the mark U+2581. If no piece has the mark behind
another character, all paths meet at every word, so the lattice falls into words, and a word falls
apart between any two characters that follow each other in no piece: a part's lattice is built once for a worker's cache, and a text's N best are merged from its words' N
best (only the N - 1 words with the smallest loss from best to second best can differ, which
the two best forward scores tell without a search).

Edge cases: null counts as empty; an empty text is the single mark (one space in front), which
decodes to the empty text; texts with the mark itself decode exactly (it is spelled in bytes);
ties go to the segmentation with longer last pieces, then to the earlier word; fewer than N
segmentations give fewer rows; repeated rows get equal results; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from array import array
from collections.abc import Iterable

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import resident, strings, table

MARK, _LITERAL = "▁", "\udfff"
UNKNOWN_LOSS = 10.0
#: Offset of ranks in Zipf's law (as Mandelbrot has it).
ZIPF = 2.7
_LOW = float("-inf")
SCHEMA = "doc_id long, n_ids long, score double, ids_crc32 long, nbest_scores array<double>, nbest_crc32 array<long>, round_trip boolean"


def merge_ranks(scores: Iterable[float]) -> bool:
    """Are these the scores of a BPE model: whole numbers of 0 or less, as no log probabilities are?"""
    return all(s <= 0 and s == int(s) for s in scores)


class Pieces(dict):
    """The vocabulary; as a dict, word -> (ids, score, loss of the second best)."""

    def __init__(self, path: str, most: int = 400_000) -> None:
        super().__init__()
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids, self.score, self.byte = {}, {}, {}
        self.text: list[bytes] = []
        for i in range(sp.vocab_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                b = int(p[3:5], 16)
                self.byte[b] = i
                self.text.append(bytes([b]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.text.append(b"")
            else:
                self.ids[p], self.score[p] = i, float(sp.get_score(i))
                self.text.append(p.replace(MARK, " ").encode())
        if merge_ranks(self.score.values()):
            total = sum(1 / (ZIPF - s) for s in self.score.values())
            self.score = {p: -round(math.log((ZIPF - s) * total) * 2**20) / 2**20 for p, s in self.score.items()}
        self.unknown = min(self.score.values()) - UNKNOWN_LOSS
        #: Every beginning of a piece -> its score, False where it is no piece itself.
        self.walk: dict = {p[:k]: False for p in self.ids for k in range(1, len(p) + 1)} | self.score
        #: Two characters that follow each other in no piece: all paths meet between them.
        self.inner = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.apart = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.most, self.old, self.lists, self.parts = most, {}, {}, {}

    def _bytes(self, c: str) -> tuple[int, ...]:
        raw = MARK.encode() if c == _LITERAL else c.encode("utf-8", "surrogatepass")
        return tuple(self.byte[b] for b in raw)

    def lattice(self, word: str) -> tuple[list[tuple], list[float], list[int]]:
        """Edges (start, end, score, is a piece) by start, forward scores, best start of each node."""
        n = len(word)
        edges: list[tuple] = []
        best, start = [0.0] + [_LOW] * n, [0] * (n + 1)
        step, unknown = self.walk.get, self.unknown
        for s in range(n):
            base, e = best[s], s + 1
            w = step(word[s:e])
            if w is None or w is False:  # no piece of its own: its bytes
                edges.append((s, e, unknown, False))
                if base + unknown > best[e]:
                    best[e], start[e] = base + unknown, s
            while w is not None:
                if w is not False:
                    edges.append((s, e, w, True))
                    if base + w > best[e]:
                        best[e], start[e] = base + w, s
                e += 1
                if e > n:
                    break
                w = step(word[s:e])
        return edges, best, start

    def __missing__(self, word: str) -> tuple[bytes, float, float]:
        got = self.old.get(word)
        if got is None:
            inner, parts, start, found = self.inner, self.parts, 0, []
            for k in range(1, len(word)):
                if word[k - 1 : k + 1] not in inner:
                    p = word[start:k]
                    found.append(parts.get(p) or self._part(p))
                    start = k
            p = word[start:]
            got = parts.get(p) or self._part(p)
            if found:
                found.append(got)
                got = (b"".join([f[0] for f in found]), sum([f[1] for f in found]), min([f[2] for f in found]))
        self[word] = got
        return got

    def _part(self, word: str) -> tuple[bytes, float, float]:
        """(ids, score, loss of the second best) of a stretch that is not cut any further.

        Forward Viterbi with the two best scores of each node.
        """
        n = len(word)
        best, next_best, start = [0.0] + [_LOW] * n, [_LOW] * (n + 1), [0] * (n + 1)
        step, unknown = self.walk.get, self.unknown
        for s in range(n):
            base, base2, e = best[s], next_best[s], s + 1
            w = step(word[s])
            if w is None or w is False:  # no piece of its own: its bytes
                x, old = base + unknown, best[e]
                if x > old:
                    next_best[e] = max(old, base2 + unknown)
                    best[e], start[e] = x, s
                elif x > next_best[e]:
                    next_best[e] = x
            while w is not None:
                if w is not False:
                    x, old = base + w, best[e]
                    if x > old:
                        y = base2 + w
                        next_best[e] = old if old > y else y
                        best[e], start[e] = x, s
                    elif x > next_best[e]:
                        next_best[e] = x
                e += 1
                if e > n:
                    break
                w = step(word[s:e])
        e, ids, number = n, [], self.ids.get
        while e:
            s = start[e]
            i = number(word[s:e])
            if i is None:
                ids += reversed(self._bytes(word[s:e]))
            else:
                ids.append(i)
            e = s
        ids.reverse()
        got = self.parts[word] = (array("I", ids).tobytes(), best[n], best[n] - next_best[n])
        return got

    def nbest_word(self, word: str, n: int) -> list[tuple[float, bytes]]:
        """The ``n`` best segmentations of a word: backward A* with the forward scores."""
        known = self.lists.get(word)
        if known is not None and (len(known[1]) >= n or known[0] < n and len(known[1]) < known[0]):
            return known[1][:n]
        edges, best, _ = self.lattice(word)
        end = len(word)
        into: list[list] = [[] for _ in range(end + 1)]
        for s, e, w, _ in edges:
            into[e].append((s, w))
        queue = [(-best[end], 0, end, 0.0, None)]
        out, tie = [], 0
        while queue and len(out) < n:
            _, _, node, done, tail = heapq.heappop(queue)
            if node == 0:
                ids: list[int] = []
                while tail:
                    p, tail = tail
                    ids += (self.ids[p],) if p in self.score else self._bytes(p)
                out.append((done, array("I", ids).tobytes()))
                continue
            for s, w in into[node]:
                tie += 1
                heapq.heappush(queue, (-(best[s] + w + done), tie, s, done + w, (word[s:node], tail)))
        if len(self.lists) > self.most // 10:
            self.lists.clear()
        self.lists[word] = (n, out)
        return out

    def words(self, text: str) -> list[str]:
        if MARK in text:
            text = text.replace(MARK, _LITERAL)
        marked = MARK + text.replace(" ", MARK)
        if not self.apart:
            return [marked]
        if MARK + MARK in marked:
            return re.findall(f"{MARK}+[^{MARK}]*", marked)
        return [MARK + x for x in marked[1:].split(MARK)]

    def encode(self, text: str, n: int) -> list[tuple[float, bytes]]:
        """The ``n`` best segmentations of a text: (score, ids as unsigned 32-bit bytes), best first."""
        words = self.words(text)
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        if len(self.parts) > self.most:
            self.parts.clear()
        got = list(map(self.__getitem__, words))
        best = [g[0] for g in got]
        total = sum([g[1] for g in got])
        out = [(total, b"".join(best))]
        if n <= 1:
            return out
        loss = [g[2] for g in got]
        free = [i for i in heapq.nsmallest(n - 1, range(len(words)), key=loss.__getitem__) if loss[i] < float("inf")]
        lists = [self.nbest_word(words[i], n) for i in free]
        # The best combinations: a change of word k only follows changes of words before it.
        queue = [(loss[free[0]], 0, ((0, 1),))] if free else []
        tie = 0
        while queue and len(out) < n:
            lost, _, changes = heapq.heappop(queue)
            ids = list(best)
            for k, r in changes:
                ids[free[k]] = lists[k][r][1]
            out.append((total - lost, b"".join(ids)))
            k, r = changes[-1]
            step = lists[k][0][0] - lists[k][r][0]
            nexts = []
            if r + 1 < len(lists[k]):
                nexts.append((lost - step + lists[k][0][0] - lists[k][r + 1][0], (*changes[:-1], (k, r + 1))))
            if k + 1 < len(free):
                more = lists[k + 1][0][0] - lists[k + 1][1][0]
                nexts.append((lost + more, (*changes, (k + 1, 1))))
                if r == 1:
                    nexts.append((lost - step + more, (*changes[:-1], (k + 1, 1))))
            for lost2, changes2 in nexts:
                tie += 1
                heapq.heappush(queue, (lost2, tie, changes2))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of a segmentation.

        An id that is no piece, and bytes that are no character, give U+FFFD; a space in front (the mark of the
        first word) goes, and nothing else.
        """
        text, n = self.text, len(self.text)
        raw = b"".join([text[i] if i is not None and 0 <= i < n else b"\xef\xbf\xbd" for i in ids])
        try:
            out = raw.decode("utf-8", "surrogatepass")
        except UnicodeDecodeError:
            out = raw.decode("utf-8", "replace")
        return out.removeprefix(" ")


def pieces(path: str) -> Pieces:
    """This worker process's vocabulary of ``path``."""
    return resident(("pieces", path), lambda: Pieces(path))


def encode_nbest(docs: DataFrame, model: str | None = None, n: int = 4, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: the best segmentation and the scores and checksums of the N best.

    ``with_ids`` adds the ids of all N, best first. ``round_trip``: the best decodes to the text.
    """
    path = model or public_tokenizers.path("piece_bpe_32k.model")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    schema = SCHEMA + (", nbest_ids array<array<int>>" if with_ids else "")

    def run(batches):
        vocabulary = pieces(path)
        for b in batches:
            out = []
            for t in strings(b.column(1)):
                found = vocabulary.encode(t, n)
                score, ids = found[0]
                row = [len(ids) // 4, score, zlib.crc32(ids), [s for s, _ in found], [zlib.crc32(x) for _, x in found], vocabulary.decode(memoryview(ids).cast("I")) == t]
                out.append(row + ([[memoryview(x).cast("I").tolist() for _, x in found]] if with_ids else []))
            cols = list(zip(*out)) if out else [()] * (6 + with_ids)
            kinds = [pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.bool_(), pa.list_(pa.list_(pa.int32()))]
            names = ["doc_id", "n_ids", "score", "ids_crc32", "nbest_scores", "nbest_crc32", "round_trip", "nbest_ids"]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=names[: len(cols) + 1])

    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, ids_col: str, model: str | None = None) -> DataFrame:
    """``encoded`` with the text of the ids in ``ids_col`` as ``decoded``.

    A null list gives null and an empty one the empty text; any ids decode (``Pieces.decode``), null ones too.
    """
    path = model or public_tokenizers.path("piece_bpe_32k.model")

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        v = pieces(path)
        return pa.array([None if x is None else v.decode(x) for x in ids.to_pylist()], pa.string())

    return encoded.withColumn("decoded", text(F.col(f"`{ids_col}`")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the four best segmentations of all documents."""
    return encode_nbest(table(spark, sf_dir, "documents"))
