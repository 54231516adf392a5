import hashlib
import random
from collections import Counter, defaultdict

from orthospark.llm import exact_dedup as X
from orthospark.llm import jaccard_join as J

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(t):
    return (t or "").translate(FOLD)


def test_exact_decisions_match_brute_force(corpus):
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[key(t)].append(i)
    for counters in (2, 4, 2048):  # few counters: the heavy path; many: also
        got = X.dedup_decisions(corpus, counters=counters).collect()
        assert len(got) == len(rows)
        assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
        by = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
        kept = Counter()
        for r in got:
            ids = by[r.text_sha256]
            best = max((i for i in ids if i is not None), default=None)
            assert (r.keep_id, r.group_size) == (best, len(ids))
            if r.kept:
                kept[r.text_sha256] += 1
                assert r.doc_id == best
        assert kept == Counter(dict.fromkeys(by, 1))


def test_heavy_hitters_are_found(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    digests = X._digests(df, "doc_id", "text")
    heavy = X.misra_gries(digests, 8).collect()
    assert [r[0] for r in heavy] == [hashlib.sha256(b"hot").digest()]
    out = X.dedup_decisions(df, counters=8)
    assert out.where("kept").count() == 2001
    assert out.where("group_size = 1000 and keep_id = 2997").count() == 1000


def test_heavy_rows_of_one_id(spark):
    """Rows that repeat id and text (null ids too) leave one row each, and no task gathers them."""
    rows = [(9 if i % 3 == 0 else None if i % 3 == 1 else i, ("hot", "cold", f"t{i}")[i % 3]) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    out = X.dedup_decisions(df, counters=8).collect()
    for text, best in (("hot", 9), ("cold", None)):
        got = [r for r in out if r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()]
        assert len(got) == 1000 and sum(r.kept for r in got) == 1 and {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(best, best, 1000)}
    assert sum(r.kept for r in out) == 1002 and len(out) == 3000
    stay = X.exact_dedup(df, counters=8)
    assert Counter(r.text for r in stay.collect()) == Counter(t for t in {t for _, t in rows})
    assert "WindowGroupLimit" in stay._jdf.queryExecution().executedPlan().toString()


def test_exact_dedup_keeps_columns_and_rows(corpus, empty):
    kept = X.exact_dedup(corpus.drop("keep_id", "kept"), counters=3)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "SCORE"]
    texts = [key(r.text) for r in kept.collect()]
    assert Counter(texts) == Counter({key(r.text) for r in corpus.collect()})
    assert X.exact_dedup(empty).count() == 0 and X.dedup_decisions(empty).count() == 0
    assert "SCORE" in X.exact_dedup(corpus).columns  # clashing columns don't break it


def words(t):
    import re

    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())


def shingle(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingle(t) for _, t in rows]
    links = [0] * len(rows)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                    links[a] += 1
                    links[b] += 1
                    parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        r = find(a)
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [(i, n, least.get(find(a))) for a, ((i, _), n) in enumerate(zip(rows, links))]


def test_jaccard_join_matches_brute_force(corpus, empty):
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    want = Counter(brute(rows))
    for limit in (4, 128):  # a small limit takes the recursion and the blocks
        got = Counter((r.doc_id, r.n_links, r.class_id) for r in J.jaccard_join(corpus, limit=limit).collect())
        assert got == want
    assert J.jaccard_join(empty).count() == 0


def test_jaccard_join_of_one_large_group(spark):
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
    rows = []
    for i in range(220):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(150)] = f"x{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_links, r.class_id) for r in J.jaccard_join(df, limit=32).collect()}
    want = {i: (n, c) for i, n, c in brute(rows)}
    assert got == want
    assert J.near_dedup(df).count() == len({c for _, c in want.values()})


def test_near_dedup_keeps_unlinked_and_one_of_each_class(corpus):
    docs = corpus.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {i for i, _, c in brute(rows) if i == c}
    out = J.near_dedup(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == want


def test_near_dedup_of_repeated_and_null_ids(spark):
    def text(seed, change=None):
        rng = random.Random(seed)
        w = [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
        return " ".join(w if change is None else [*w[:-1], change])

    rows = [
        (9, text(1)), (9, text(2)), (3, text(1, "x")),  # a clean row of a dropped id
        (5, text(3)), (None, text(3)), (None, text(4)), (None, ""), (None, "!"),  # clean rows with a null id
        (7, text(5)), (7, text(5, "x")), (7, text(5)),  # near and exact copies of one id
        (None, text(6)), (None, text(6, "x")), (None, text(6, "y")),  # a class without ids
        (9, text(7)), (8, text(7, "x")), (9, text(8)), (8, text(8, "x")),  # two classes of the same ids
    ]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, k int").repartition(5)
    got = [r.k for r in J.near_dedup(df, limit=4).collect()]
    assert sorted(k for k in got if k < 8) == [1, 2, 3, 5, 6, 7]
    for group in ({8, 9, 10}, {11, 12, 13}):
        assert len(group & set(got)) == 1
    assert sorted(k for k in got if k > 13) == [15, 17]
    links = Counter((r.doc_id, r.n_links, r.class_id) for r in J.jaccard_join(df, limit=4).collect())
    assert links == Counter(brute(rows))


def test_near_dedup_of_the_whole_corpus(corpus):
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    sets = [shingle(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for a, (i, t) in enumerate(rows):
        groups[find(a)].append((i is None, i or 0))
    want = Counter(min(g)[:2] for g in groups.values())
    got = J.near_dedup(corpus)
    assert got.columns == corpus.columns
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == want


def test_components_of_a_chain(spark):
    from orthospark.llm.jaccard_join import components

    e = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(40)] + [(b"\xf0", b"\xf1")], "a binary, b binary")
    n = spark.createDataFrame([(bytes([i]), 100 - i) for i in range(41)] + [(b"\xf0", 500), (b"\xf1", 501)], "cid binary, label long")
    got = {bytes(r.cid): r.label for r in components(e, n).collect()}
    assert got == {bytes([i]): 60 for i in range(41)} | {b"\xf0": 500, b"\xf1": 500}


def test_sketches_and_runs_together_reach_the_recall():
    from math import comb

    def found(k, depth=J.MAX_DEPTH):  # k of the positions agree, a node draws two different ones
        both, one = k * (k - 1) / (J.POSITIONS * (J.POSITIONS - 1)), 2 * k * (J.POSITIONS - k) / (J.POSITIONS * (J.POSITIONS - 1))
        q = 1.0
        for _ in range(depth):
            q = both * (1 - (1 - q) ** 2) + one * q
        return q

    for j in (0.8, 0.85, 0.9):
        runs, least = J.runs_for(0.9999, 0.8), J.sketch_cutoff(0.8)
        miss = sum(comb(J.POSITIONS, k) * j**k * (1 - j) ** (J.POSITIONS - k) * (1 if k < least else (1 - found(k)) ** runs) for k in range(J.POSITIONS + 1))
        assert miss <= 1e-4


def test_runs_reach_the_recall():
    assert J.runs_for(0.9999, 0.8) == 4 and J.runs_for(0.9, 0.8) == 1


def test_joins_beyond_the_broadcast_bound_and_other_thresholds(spark, corpus):
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    got = J.jaccard_join(corpus, limit=16, broadcast_rows=0)
    assert Counter((r.doc_id, r.n_links, r.class_id) for r in got.collect()) == Counter(brute(rows))
    kept = [sorted((r.doc_id is None, r.doc_id or 0) for r in J.near_dedup(corpus, broadcast_rows=n).collect()) for n in (0, 500_000)]
    assert kept[0] == kept[1]
    # sets of 40 and 100 shingles, one inside the other: similarity 0.4
    w = [f"w{i}" for i in range(104)]
    df = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(w[:44])), (3, "far from them all by far")], "doc_id long, text string")
    assert {r.doc_id: r.n_links for r in J.jaccard_join(df, threshold=0.3).collect()} == {1: 1, 2: 1, 3: 0}


def test_recall_over_random_pairs(spark):
    """Planted pairs just above the threshold, each in a class of its own: all are linked."""
    rng = random.Random(11)
    rows = []
    for i in range(300):
        w = [f"w{i}x{k}" for k in range(204)]
        v = list(w)
        v[rng.randrange(20, 60)], v[rng.randrange(80, 120)], v[rng.randrange(140, 180)], v[199] = "a", "b", "c", "d"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter((i, n) for i, n, _ in [(r[0], 1, None) for r in rows if len(shingle(rows[r[0] ^ 1][1]) & shingle(r[1])) * 9 >= 8 * 200])
    got = Counter((r.doc_id, r.n_links) for r in J.jaccard_join(df).collect() if r.n_links)
    assert got == want and len(want) > 500
