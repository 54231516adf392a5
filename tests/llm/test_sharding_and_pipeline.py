from collections import Counter

import duckdb
import pytest

from orthospark import llm
from orthospark.llm import sharding as S

SF = "/root/testdata/sf0.001"


def content(df):
    return Counter(tuple(r) for r in df.select("doc_id", "text", "source").collect())


def test_appends_merges_and_versions(spark, corpus, empty, tmp_path):
    store = S.ShardStore(spark, str(tmp_path / "store"))
    assert store.version() == 0 and store.manifest() == []
    parts = corpus.randomSplit([1.0] * 6, seed=1)
    for p in parts:
        store.append(p.coalesce(1))
    assert store.version() == 6 and len(store.manifest()) == 6
    before = content(store.read())
    policy = S.Policy(target_bytes=1 << 20, fan_in=3)
    last = store.compact(policy)
    assert last > 6 and len(store.manifest()) < 6
    assert content(store.read()) == before == content(corpus)
    assert content(store.read(6)) == before  # an old version until it is vacuumed
    assert store.compact(policy) == last  # nothing left to do
    assert store.vacuum() == 0 and content(store.read(6)) == before  # too young to go
    assert store.vacuum(keep_versions=last, min_age_s=0) == 0  # and named by a version to keep
    assert store.vacuum(min_age_s=0, keep_versions=1) > 0 and content(store.read()) == before
    none = S.ShardStore(spark, str(tmp_path / "none"))
    assert none.places().count() == 0 and none.read().count() == 0
    places = store.places().collect()
    assert len(places) == corpus.count() == len({(p.shard, p.row) for p in places})
    other = S.ShardStore(spark, str(tmp_path / "empty"))
    other.append(empty)
    assert other.version() == 1


def test_a_taken_version_is_refused(spark, corpus, tmp_path):
    store = S.ShardStore(spark, str(tmp_path / "race"))
    store.append(corpus.limit(3))
    with pytest.raises(S.ConcurrentCommit):
        store.commit([], 0)
    assert store.version() == 1


def test_two_writers_lose_nothing(spark, corpus, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path / "two")

    def write(k):
        store = S.ShardStore(spark, root)
        for i in range(4):
            store.append(spark.range(10).selectExpr(f"id + {1000 * k + 100 * i} AS doc_id").coalesce(1))
            if i == 2:
                store.compact(S.Policy(target_bytes=1 << 20, fan_in=2))

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(write, range(2)))
    store = S.ShardStore(spark, root)
    got = sorted(r.doc_id for r in store.read().collect())
    assert got == sorted(1000 * k + 100 * i + j for k in range(2) for i in range(4) for j in range(10))
    assert store.version() >= 9


def test_stores_without_atomic_renames_are_refused(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(S, "ATOMIC", ("hdfs",))
    with pytest.raises(ValueError):
        S.ShardStore(spark, str(tmp_path))
    assert S.ShardStore(spark, str(tmp_path), single_writer=True).version() == 0


def test_plan_takes_similar_sizes_up_to_the_target():
    shards = [S.Shard(f"a{i}", 10, 0) for i in range(9)] + [S.Shard("big", 900, 2), S.Shard("mid", 200, 1)]
    runs = S.plan_merges(shards, S.Policy(target_bytes=1000, fan_in=4, max_run=4))
    assert sorted(len(r) for r in runs) == [4, 4]
    assert all(s.size == 10 for r in runs for s in r)
    assert S.tier(500, S.Policy(target_bytes=1000)) == 0 and S.tier(0, S.Policy(target_bytes=1000)) == 40


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_oracles_agree(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(llm.oracle_sql()[name])
    names = sorted(want.columns)
    clean = lambda v: float(f"{v:.6g}") if isinstance(v, float) else v
    rows = lambda cols, data: Counter(tuple(clean(r[cols.index(n)]) for n in names) for r in data)
    got = llm.queries()[name](spark, SF)
    assert sorted(got.columns) == names
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = [n for n, _ in P.STAGES]
    assert stages == ["quality", "exact_dedup", "near_dedup", "pii", "packing"]
    sizes, df = [], docs
    for name, stage in P.STAGES:
        stage(spark, df, SF).write.parquet(str(tmp_path / name))
        new = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert new.columns == docs.columns
        sizes.append(new.count())
        last, df = df, new
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in spark.read.parquet(str(tmp_path / "quality")).select("doc_id").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.97 * len(good)
    assert sum(i in kept for i, q in labels.items() if q == 0) <= 0.2 * (len(labels) - len(good))
    assert sizes[0] >= sizes[1] >= sizes[2] == sizes[3]
    assert {r.doc_id for r in df.collect()} == {r.doc_id for r in last.select("doc_id").collect()}
    assert P.run(spark, SF).count() == sizes[4]


def test_pipeline_of_odd_tables(spark, corpus, empty, tmp_path):
    """Nulls, empties, repeated rows, a very long text and clashing columns; and no rows at all."""
    import corpus_pipeline as P

    labels = spark.createDataFrame([(i, int(i % 9 != 0), 0) for i in range(60)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    for name, docs, marks in (("odd", corpus, labels), ("none", empty, labels.limit(0)), ("unlabelled", corpus, labels.limit(0))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        marks.write.parquet(str(tmp_path / name / "labels.parquet"))
        df, folder = spark.read.parquet(str(tmp_path / name / "documents.parquet")), str(tmp_path / name)
        seen = []
        for step, stage in P.STAGES:
            stage(spark, df, folder).write.parquet(f"{folder}/{step}")
            after = spark.read.parquet(f"{folder}/{step}")
            if step != "packing":
                assert after.dtypes == docs.dtypes, step
                rows, old = (Counter((r.doc_id, *([] if step == "pii" else [r.text]), r.lang, r.source, r.keep_id, r.SCORE, r.kept) for r in d.collect()) for d in (after, df))
                assert not rows - old and (step != "pii" or rows == old)
                seen.append(sum(rows.values()))
            else:
                assert Counter(r.doc_id for r in after.where("piece = 0").collect()) == Counter(r.doc_id for r in df.collect())
            df = after
        if name == "none":
            assert seen == [0] * 4
        if name == "unlabelled":  # nothing to learn: all documents stay
            texts = {(r.text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for r in corpus.collect()}
            assert seen[:2] == [corpus.count(), len(texts)] and 0 < seen[2] < seen[1]


def test_other_queries_run(spark):
    for name in ("op2_jaccard_join", "op6_size_tiered_sharding", "op8_html_extraction", "op9_piece_nbest"):
        table = "pages" if "html" in name else "documents"
        assert llm.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
