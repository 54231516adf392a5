"""N-gram Jaccard self-join by chosen paths.

A document's set holds the hashes of its five-word shingles (lower-cased words of letters and
digits; fewer than five words: one shingle). Documents with equal sets are one class. A set is
embedded as ``POSITIONS`` minhash tokens, of which two sets with Jaccard similarity j share a
part j on average.

Chosen paths: a node of the recursion is a set of documents that agree on the tokens chosen so
far. A node that is larger than ``limit`` is split: ``branch_for(threshold)`` positions (2 at 0.8) are drawn by a hash of
the node, and each document goes, for each of them, to the child of its token there. A node of at
most ``limit`` classes (1024) is brute-forced. With 2 positions a pair at similarity 0.8 shares 1.6
children on average and is found in one run with probability q, from q = 1 by
q = 1 - (1 - 0.8 q)^2 a level (0.9388 at the greatest depth); independent runs are repeated
until 1 - (1 - q)^runs reaches the target recall. All runs share the 64 tokens: at 0.8 four runs of
depth 4 miss 9.4e-5, and with the sketches (below; 4e-6 alone) 9.8e-5 in all.

Nodes that splitting doesn't shrink hold one large group of near copies. They are brute-forced
too, in blocks of at most about ``limit`` classes and ``MOST_SHINGLES`` shingles: each pair of blocks is a bounded
task, so no group meets in one task and no cap drops a partner. A member of a leaf of g classes travels g / limit times. A pair that meets in several leaves is compared exactly in the one with the
smallest id only. First the leaves are compared by 64-byte sketches, to find which documents have
a partner at all; only those get their full sets, and every link is decided by the exact Jaccard
similarity of the sets. Pairs are never written: a block returns counts a class and a star of
edges to the least linked class, from which components are found by hooking, pointer jumping and
contraction.

Result of ``jaccard_join``: one row per document with class_id (the least id in its connected component of links), set_id
(the least id of the documents with an equal set), and n_links (documents with similarity at
least the threshold, equal sets included, itself not). Components are labelled by digests of sets, so
repeated or null ids neither join nor part them.

Edge cases: null or wordless text has an empty set and links to nothing; null ids are passed
over by the least id, which is null where all ids are; repeated rows are copies of each other; an empty table gives an
empty result; columns beside id and text are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, grouped_stream, mix64, release, shingles, shuffle_width, strings, table, word_hashes

POSITIONS, MAX_DEPTH = 64, 4
#: Shingles of a block, 8 bytes each, whose sets are compared in one task.
MOST_SHINGLES = 1 << 20
#: Ids that are broadcast at most (a few MB).
BROADCAST_ROWS = 500_000
_IS_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_SEEDS = mix64(np.arange(1, POSITIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    return np.unique(shingles(word_hashes(data, _IS_WORD)[0], width))


def minhash(s: np.ndarray) -> np.ndarray:
    """The least value of each of POSITIONS hash functions over the set."""
    out = np.full(POSITIONS, np.uint64(2**64 - 1))
    for a in range(0, s.size, 4096):
        part = s[a : a + 4096]
        h = (part[None, :] ^ _SEEDS[:, None]) * np.uint64(0xBF58476D1CE4E5B9)
        np.minimum(out, (h ^ (h >> np.uint64(29))).min(axis=1), out=out)
    return mix64(out)


def branch_for(threshold: float) -> int:
    """Positions a node draws: a pair at the threshold shares 1.6 children or more on average."""
    return max(2, math.ceil(1.6 / threshold))


def runs_for(recall: float, threshold: float) -> int:
    """Runs that reach ``recall`` for pairs at the threshold, however many of the MAX_DEPTH levels split."""
    q = 1.0
    for _ in range(MAX_DEPTH):
        q = 1 - (1 - threshold * q) ** branch_for(threshold)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - q)))


def sketch_cutoff(threshold: float) -> float:
    """Places in which sketches must agree: five standard deviations below the mean at the threshold."""
    return POSITIONS * threshold - 5 * math.sqrt(POSITIONS * threshold * (1 - threshold))


def chosen(node: np.ndarray, branch: int) -> np.ndarray:
    """The ``branch`` distinct positions that each node draws: steps of an odd width from a first one."""
    first = mix64(node ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    width = (first >> np.uint64(32)) | np.uint64(1)
    return ((first[:, None] + np.arange(branch, dtype=np.uint64) * width[:, None]) % np.uint64(POSITIONS)).astype(np.int64)


def children(node: np.ndarray, sig: np.ndarray, branch: int) -> np.ndarray:
    """Child nodes (rows x branch) of documents with signatures ``sig`` in nodes ``node``."""
    at = chosen(node, branch)
    value = np.take_along_axis(sig, at, axis=1)
    return mix64(mix64(node[:, None] + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ value)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sigs(column: pa.Array) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.uint64).reshape(-1, POSITIONS)


def digest(s: np.ndarray) -> bytes | None:
    """16 bytes that tell sets apart; null for the empty set."""
    return s.sum(dtype=np.uint64).tobytes() + mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).tobytes() if s.size else None


def _sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """id, cid (digest of the set, 16 bytes), n (size), sig (512 bytes) of documents with words; others have no cid."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))

    def run(batches):
        release()
        for b in batches:
            cid, n, sig = [], [], []
            for t in strings(b.column(1)):
                s = shingle_set(t, width)
                n.append(s.size)
                cid.append(digest(s))
                sig.append(minhash(s).tobytes() if s.size else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cid, pa.binary()), pa.array(n, pa.int32()), pa.array(sig, pa.binary())], names=["id", "cid", "n", "sig"])

    return rows.mapInArrow(run, "id long, cid binary, n int, sig binary")


def _blocks(size: str, total: str, limit: int) -> Column:
    return F.greatest(F.ceil(F.col(size) / limit), F.ceil(F.col(total) / MOST_SHINGLES)).cast("int").alias("blocks")


def _leaves(classes: DataFrame, runs: int, branch: int, limit: int) -> DataFrame:
    """(leaf, cid, blocks): memberships of classes in leaves of at least two classes."""

    def first(batches):
        release()
        roots = mix64(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        for b in batches:
            k = b.num_rows
            if k:
                node = np.tile(roots, k)
                kids = children(node, np.repeat(_sigs(b.column(2)), runs, axis=0), branch).reshape(-1)
                at = pa.array(np.repeat(np.arange(k), runs * branch))
                yield pa.RecordBatch.from_arrays([pa.array(_signed(kids)), b.column(0).take(at), b.column(1).take(at)], names=["node", "cid", "n"])

    def deeper(batches):
        for b in batches:
            k = b.num_rows
            if k:
                node = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                kids = children(node, _sigs(b.column(3)), branch).reshape(-1)
                at = pa.array(np.repeat(np.arange(k), branch))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(_signed(kids)), b.column(1).take(at), b.column(2).take(at)], names=["up", "node", "cid", "n"])

    found: list[DataFrame] = []
    active = checkpointed(classes.select("cid", "n", "sig").mapInArrow(first, "node long, cid binary, n int"))
    for depth in range(1, MAX_DEPTH + 1):
        sizes = active.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total")).where("size > 1")
        small = checkpointed(sizes)
        last = depth == MAX_DEPTH
        done = small if last else small.where(F.col("size") <= limit)
        found.append(active.join(done, "node").select("node", "cid", _blocks("size", "total", limit)))
        if last:
            break
        large = small.where(F.col("size") > limit).select("node", F.col("size").alias("whole"), "total")
        if large.isEmpty():
            break
        held = active.join(large.select("node"), "node", "left_semi").join(classes.select("cid", "sig"), "cid").select("node", "cid", "n", "sig")
        split = checkpointed(held.mapInArrow(deeper, "up long, node long, cid binary, n int"))
        # a node whose largest child holds most of it is one group of near copies: it is a leaf
        most = split.groupBy("up", "node").agg(F.count(F.lit(1)).alias("size")).groupBy("up").agg(F.max("size").alias("most"))
        alike = checkpointed(most.join(large, most["up"] == large["node"]).where(F.col("most") * 2 > F.col("whole")).select("node", "whole", "total"))
        found.append(active.join(alike, "node").select("node", "cid", _blocks("whole", "total", limit)))
        active = split.join(alike.select(F.col("node").alias("up")), "up", "left_anti").select("node", "cid", "n")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return checkpointed(out.withColumnRenamed("node", "leaf"))


def _block_pairs(rows: DataFrame) -> DataFrame:
    """One row per pair of blocks that a membership takes part in: p <= q, and its own block."""
    own = F.pmod(F.xxhash64("cid", "leaf"), F.col("blocks")).cast("int")
    with_own = rows.withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    names = [c for c in rows.columns if c != "blocks"]
    return with_own.select(*names, "own", other).select(
        *names, F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own"
    )


def _owned(leaf: int, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """For each pair (rows of a, rows of b): is ``leaf`` the least leaf that both are in?

    Only pairs that share a smaller leaf are not owned; smaller leaves are few.
    """
    out = np.ones((len(a), len(b)), bool)
    where: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        for v in x[x < leaf].tolist():
            where.setdefault(v, []).append(j)
    for i, x in enumerate(a):
        for v in x[x < leaf].tolist():
            if v in where:
                out[i, where[v]] = False
    return out


def _sides(t: pa.Table, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    own = t.column("own").to_numpy()
    if p == q:
        i = np.arange(len(own))
        return i, i
    return np.flatnonzero(own == p), np.flatnonzero(own == q)


def _alike(t: pa.Table, key: tuple, least: float, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of a block pair that this leaf owns and whose sizes and sketches can reach the threshold."""
    leaf, p, q = key
    i, j = _sides(t, p, q)
    if not i.size or not j.size:
        return i[:0], j[:0]
    sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, POSITIONS)
    lists = t.column("leaves").to_pylist()
    lists = [np.frombuffer(x, np.int64) for x in lists]
    n = t.column("n").to_numpy().astype(np.float64)
    ok = np.empty((i.size, j.size), bool)
    for a in range(0, i.size, 64):
        ok[a : a + 64] = (sketch[i[a : a + 64], None, :] == sketch[None, j, :]).sum(axis=2) >= least
    if p == q:
        ok = np.triu(ok, 1)
    x, y = np.nonzero(ok)
    if x.size:
        own = _owned(leaf, [lists[k] for k in i], [lists[k] for k in j])[x, y]
        x, y = x[own], y[own]
    close = np.minimum(n[i[x]], n[j[y]]) >= threshold * np.maximum(n[i[x]], n[j[y]]) - 1e-9
    return i[x[close]], j[y[close]]


def intersections(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets x[k] and y[k]."""
    if x.size < 64 or 4 * x.size < len(sets):
        return np.array([np.intersect1d(sets[a], sets[b], assume_unique=True).size for a, b in zip(x.tolist(), y.tolist())], np.int64)
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [s.size for s in sets])
    _, place, count = np.unique(tokens, return_inverse=True, return_counts=True)
    keep = count[place] > 1  # a token of one set is in no intersection
    vocab, place = np.unique(place[keep], return_inverse=True)
    owner = owner[keep]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for a in range(0, vocab.size, 4096):
        at = (place >= a) & (place < a + 4096)
        m = np.zeros((len(sets), min(4096, vocab.size - a)), np.float32)
        m[owner[at], place[at] - a] = 1
        total += m @ m.T
    return total[x, y].astype(np.int64)


def _links(rows: DataFrame, least: float, threshold: float) -> DataFrame:
    """Exact links in each block pair: (cid, links, least): documents linked and the star's centre."""

    def compare(key, t):
        x, y = _alike(t, key, least, threshold)
        if not x.size:
            return None
        sets = [np.frombuffer(s, np.uint64) for s in t.column("shingles").to_pylist()]
        n = np.array([s.size for s in sets], np.int64)
        both = intersections(sets, x, y)
        linked = both >= threshold * (n[x] + n[y] - both) - 1e-9
        x, y = x[linked], y[linked]
        if not x.size:
            return None
        weight = t.column("weight").to_numpy()
        count = np.zeros(len(sets), np.int64)
        np.add.at(count, x, weight[y])
        np.add.at(count, y, weight[x])
        root = np.arange(len(sets))  # components inside the block pair
        while True:
            low = np.minimum(root[x], root[y])
            new = root.copy()
            np.minimum.at(new, x, low)
            np.minimum.at(new, y, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        hit = np.flatnonzero(count)
        cid = t.column("cid").combine_chunks()
        return [pa.RecordBatch.from_arrays([cid.take(pa.array(hit)), pa.array(count[hit]), cid.take(pa.array(root[hit]))], names=["cid", "links", "least"])]

    return grouped_stream(rows, ["leaf", "p", "q"], compare, "cid binary, links long, least binary")


def _undirected(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (hi, lo) of different labels x and y."""
    return pairs.where("x != y").select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct()


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(cid, label): the least label of each node's connected component.

    ``edges``: a, b; ``nodes``: cid, label. Each round, a label with smaller neighbours hooks on the
    least of them, pointer jumping takes all to their trees' roots, and edges are contracted to
    edges between roots, of which few are left after the first round.
    """
    now = checkpointed(nodes.select("cid", "label"))
    ends = edges.join(now.select(F.col("cid").alias("a"), F.col("label").alias("x")), "a")
    ends = ends.join(now.select(F.col("cid").alias("b"), F.col("label").alias("y")), "b")
    e = checkpointed(_undirected(ends))
    while not e.isEmpty():
        parent = checkpointed(e.groupBy("hi").agg(F.min("lo").alias("p")))
        moved = True
        while moved:
            up = parent.select(F.col("hi").alias("p"), F.col("p").alias("pp"))
            then = checkpointed(parent.join(up, "p", "left").select("hi", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")))
            moved = not then.where("moved").isEmpty()
            parent = then.drop("moved")
        one = e.join(parent.select("hi", F.col("p").alias("x")), "hi")
        two = one.join(parent.select(F.col("hi").alias("lo"), F.col("p").alias("y")), "lo", "left")
        e = checkpointed(_undirected(two.select("x", F.coalesce("y", "lo").alias("y"))))
        root = parent.select(F.col("hi").alias("label"), F.col("p").alias("root"))
        now = checkpointed(now.join(root, "label", "left").select("cid", F.coalesce("root", "label").alias("label")))
    return now


def _solve(docs: DataFrame, threshold: float = 0.8, width: int = 5, recall: float = 0.9999, limit: int = 1024,
           id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(id, cid) of all documents, and (cid, label, weight, root, component, links) of all sets.

    ``label``: least id of a set; ``root``: the least digest of its component, null where nothing
    is linked; ``component``: the least id of the component.
    """
    parts = shuffle_width(docs.sparkSession)
    sets = checkpointed(_sets(docs, id_col, text_col, width))
    classes = (
        sets.where("cid IS NOT NULL").groupBy("cid").agg(F.min("id").alias("label"), F.count(F.lit(1)).alias("weight"), F.max("n").alias("n"), F.max("sig").alias("sig"))
    )
    classes = checkpointed(classes)
    leaves = _leaves(classes, runs_for(recall, threshold), branch_for(threshold), limit)
    packed = leaves.groupBy("cid").agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))
    sketch = F.expr("unhex(array_join(transform(sequence(0, %d), i -> substr(hex(sig), 16 * i + 1, 2)), ''))" % (POSITIONS - 1))
    known = packed.join(classes, "cid").select("cid", "n", "weight", sketch.alias("sketch"), "leaves")

    def to_bytes(batches):
        for b in batches:
            raw = [np.asarray(x, np.int64).tobytes() for x in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(raw, pa.binary())], names=["cid", "n", "weight", "sketch", "leaves"])

    known = checkpointed(known.mapInArrow(to_bytes, "cid binary, n int, weight long, sketch binary, leaves binary"))
    pairs = _block_pairs(leaves.join(known, "cid"))
    least = sketch_cutoff(threshold)

    def partners(key, t):
        x, y = _alike(t, key, least, threshold)
        if not x.size:
            return None
        at = pa.array(np.unique(np.concatenate([x, y])))
        cid = t.column("cid").combine_chunks().take(at)
        one = lambda v: pa.array(np.full(len(at), v), pa.int32())
        own = t.column("own").combine_chunks().take(at)
        return [pa.RecordBatch.from_arrays([pa.array(np.full(len(at), key[0], np.int64)), cid, one(key[1]), one(key[2]), own], names=["leaf", "cid", "p", "q", "own"])]

    wanted = checkpointed(grouped_stream(pairs, ["leaf", "p", "q"], partners, "leaf long, cid binary, p int, q int, own int", parts))

    # full sets of one document of each class that has a possible partner
    owners = wanted.select("cid").distinct().join(classes.select("cid", "label"), "cid").select("cid", F.col("label").alias("id"))
    full = _full_sets(docs, owners, id_col, text_col, width, broadcast_rows)
    rows = wanted.join(known, "cid").join(full, "cid")
    found = checkpointed(_links(rows, least, threshold))
    nodes = found.select("cid").unionByName(found.select(F.col("least").alias("cid"))).distinct().select("cid", F.col("cid").alias("label"))
    roots = components(found.where("cid != least").select(F.col("cid").alias("a"), F.col("least").alias("b")), nodes)
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    linked = roots.withColumnRenamed("label", "root").join(classes.select("cid", "label"), "cid")
    least = linked.groupBy("root").agg(F.min("label").alias("component"))
    linked = linked.drop("label").join(least, "root").join(counts, "cid", "left").select("cid", "root", "component", F.coalesce("links", F.lit(0)).alias("links"))
    about = checkpointed(classes.select("cid", "label", "weight").join(linked, "cid", "left"))
    return sets.select("id", "cid"), about


def jaccard_join(docs: DataFrame, threshold: float = 0.8, width: int = 5, recall: float = 0.9999, limit: int = 1024,
                 id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document: doc_id, class_id, set_id, n_links. ``recall``: target for each link."""
    sets, about = _solve(docs, threshold, width, recall, limit, id_col, text_col, broadcast_rows)
    out = sets.join(about, "cid", "left")
    return out.select(
        F.col("id").alias("doc_id"),
        F.coalesce("component", "label", "id").alias("class_id"),
        F.coalesce("label", "id").alias("set_id"),
        F.coalesce(F.col("weight") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
    )


def _full_sets(docs: DataFrame, owners: DataFrame, id_col: str, text_col: str, width: int, broadcast_rows: int) -> DataFrame:
    """(cid, shingles) of the classes in ``owners`` (cid, id), from one document each.

    The ids are broadcast only up to ``broadcast_rows`` (a few MB); beyond that, an ordinary join.
    """
    owners = checkpointed(owners)
    small = owners.count() <= broadcast_rows
    side = lambda c: F.broadcast(owners.select(c)) if small else owners.select(c)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("t_id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    rows = rows.join(side("id").distinct(), F.col("t_id").eqNullSafe(F.col("id")), "left_semi").select("t")

    def run(batches):
        release()
        for b in batches:
            sets = [s for s in (shingle_set(t, width) for t in strings(b.column(0))) if s.size]
            yield pa.RecordBatch.from_arrays(
                [pa.array([digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cid", "shingles"]
            )

    # an id may be repeated with other texts
    found = rows.mapInArrow(run, "cid binary, shingles binary").join(side("cid"), "cid", "left_semi")
    return checkpointed(found.dropDuplicates(["cid"]))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS, **options) -> DataFrame:
    """The rows of ``docs`` that stay: all without words, and one of each class.

    That is a row of the least id (null ids last) and, among those, of the least digest; rows are told
    apart by id and digest, so that a repeated or null id takes no other row along. Rows equal in
    both are copies, of which any one stays. The ids in question are broadcast up to
    ``broadcast_rows``; beyond that, an ordinary join decides.
    """
    sets, about = _solve(docs, id_col=id_col, text_col=text_col, broadcast_rows=broadcast_rows, **options)
    # only sets of more than one row or with links lose rows
    shared = about.where("weight > 1 OR root IS NOT NULL").select("cid", F.coalesce("root", "cid").alias("root"))
    rows = checkpointed(sets.join(shared, "cid").groupBy("root", "cid", "id").agg(F.count(F.lit(1)).alias("n")))
    rank = F.struct(F.col("id").isNull().alias("last"), "id", "cid", "n")
    first = checkpointed(rows.groupBy("root").agg(F.min(rank).alias("first")).select("first.id", "first.cid", "first.n"))
    names = [f"`{c}`" for c in docs.columns]
    width = options.get("width", 5)

    @F.arrow_udf("binary")
    def digests(texts: pa.Array) -> pa.Array:
        return pa.array([digest(shingle_set(t, width)) for t in strings(texts)], pa.binary())

    same = lambda side: (F.col("__nd_cid") == side["cid"]) & F.col("__nd_id").eqNullSafe(side["id"])
    pairs = rows.select("cid", "id")
    drop = pairs.join(first.select("cid", F.col("id").alias("__id")), (pairs["cid"] == first["cid"]) & pairs["id"].eqNullSafe(F.col("__id")), "left_anti")
    copies = first.where("n > 1").select("cid", "id")
    drop, copies = checkpointed(drop), checkpointed(copies)
    # rows of other ids stay; only these ids' texts are read for their digests again
    doubt = checkpointed(drop.select("id").unionByName(copies.select("id")).distinct())
    doubt = F.broadcast(doubt) if doubt.count() <= broadcast_rows else doubt
    known = docs.withColumn("__nd_id", F.col(f"`{id_col}`").cast("long"))
    clear = known.join(doubt, F.col("__nd_id").eqNullSafe(doubt["id"]), "left_anti")
    known = known.join(doubt, F.col("__nd_id").eqNullSafe(doubt["id"]), "left_semi").withColumn("__nd_cid", digests(F.col(f"`{text_col}`").cast("string")))
    kept = known.join(drop, same(drop), "left_anti")
    out = clear.select(*names)
    if copies.isEmpty():
        return out.unionByName(kept.select(*names))
    one = kept.join(copies, same(copies), "left_semi").dropDuplicates(["__nd_cid", "__nd_id"])
    return out.unionByName(kept.join(copies, same(copies), "left_anti").select(*names)).unionByName(one.select(*names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the join of all documents."""
    return jaccard_join(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM t),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b, k = na AND k = nb AS same FROM p WHERE k >= 0.8 * (na + nb - k) - 1e-9),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a),
c AS (SELECT a, min(c) AS class_id FROM r GROUP BY a),
l AS (SELECT a, count(*) AS n_links, min(CASE WHEN same THEN b END) AS twin FROM e GROUP BY a)
SELECT doc_id, class_id, least(doc_id, coalesce(twin, doc_id)) AS set_id, coalesce(n_links, 0) AS n_links
FROM documents JOIN c ON c.a = doc_id LEFT JOIN l ON l.a = doc_id
"""
