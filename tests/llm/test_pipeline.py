"""The pipeline's stages take effect, each on what its predecessor kept, and give defined results on odd tables."""

import corpus_pipeline as C


def test_stages(spark, sf_dir, tmp_path):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # enough labels to learn from
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(C.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs.count())
        if name != "token_files":
            assert docs.columns == columns, name
    assert seen[0] > seen[1] > seen[2] > seen[3] and seen[4] == seen[5]
    assert seen[1] > 0.8 * seen[0]


ODD = "source string, text string, doc_id long, `__gone` int, meta map<string,int>"


def odd(spark):
    words = " ".join(f"w{i}" for i in range(80))
    rows = [("a", words, 5), ("a", words, 2), ("b", words, None), ("b", words, None), (None, None, 3), ("a", "", 4), ("a", "short text", 7), ("a", "short text", 7), ("a", "another text", 7)]
    return spark.createDataFrame([(*r, 1, {"k": 1}) for r in rows], ODD)


def tables(spark, tmp_path, items):
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def kept(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_stages_on_odd_rows(spark, tmp_path):
    df = odd(spark)
    sf_dir = tables(spark, tmp_path, [(1, " ".join(f"w{i}" for i in range(10, 40)))])
    everything = kept(df)
    assert kept(C.toxicity_filter(spark, df, sf_dir)) == everything  # no labels, nothing goes
    near = C.near_duplicate_filter(spark, df, sf_dir)
    # 5 is a copy of 2, one of the repeated rows of 7 goes; rows without id stay
    gone = list(everything)
    gone.remove(next(r for r in everything if r[0] == 5))
    gone.remove((7, "short text"))
    assert kept(near) == gone and near.columns == df.columns
    clean = C.benchmark_filter(spark, df, sf_dir)
    assert kept(clean) == [r for r in everything if r[0] not in (2, 5)] and clean.columns == df.columns
    mixed = C.source_mix(spark, df, sf_dir)
    assert mixed.columns == df.columns and mixed.where("text IS NULL OR text = ''").count() == 0 and mixed.count() > 0
    out = C.token_output(spark, df, sf_dir).orderBy("start").collect()
    assert len(out) == 9 and [r.doc_id for r in out] == [2, 3, 4, 5, 7, 7, 7, None, None]
    assert [r.start for r in out[1:]] == [r.start + r.n_tokens for r in out[:-1]]


def test_mix_takes_what_the_mix_says_and_moves_no_text(spark, tmp_path):
    """Every row as often and as long as ``mix_sources`` says, also with shared ids, null ids and blank texts, by a plan
    whose texts are not shuffled where the mix itself is too large to be sent."""
    from collections import Counter

    from orthoflux.llm.mixing import mix_sources

    rows = [(("a", "b", "c", None)[i * i % 7 % 4], " ".join(f"w{i}_{k}" for k in range(1 + i * 37 % 23)), i if i % 5 else i // 50) for i in range(3000)]
    rows += [("a", f"no id {i}", None) for i in range(5)] + [("b", "", 9001), ("b", None, 9002), ("c", " \t", 0), ("d", "", 9003)]
    spark.createDataFrame([(*r, 1, {"k": 1}) for r in rows], ODD).write.parquet(f"{tmp_path}/docs")
    df = spark.read.parquet(f"{tmp_path}/docs")
    size, taken = {}, {}
    for r in mix_sources(df).where("taken > 0").collect():
        size[r.doc_id], taken[r.doc_id] = max(size.get(r.doc_id, 0), r["size"]), max(taken.get(r.doc_id, 0), r.taken)
    want = Counter()
    for _, text, i in rows:
        left = taken.get(i, 0)
        while left > 0:
            want[i, text if left >= size[i] else " ".join((text or "").split()[:left])] += 1
            left -= size[i]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "12k")
    try:
        mixed = C.source_mix(spark, df, "")
        assert Counter((r.doc_id, r.text) for r in mixed.collect()) == want and len(want) > 2000
        own = df.where("doc_id % 5 != 0").dropDuplicates(["doc_id"]).coalesce(1)
        own.write.parquet(f"{tmp_path}/own")
        plan = C.source_mix(spark, spark.read.parquet(f"{tmp_path}/own"), "")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stages_on_empty_tables(spark, tmp_path):
    df = odd(spark).limit(0)
    sf_dir = tables(spark, tmp_path, [])
    for _, stage in C.STAGES:
        assert stage(spark, df, sf_dir).count() == 0


def test_shuffles_of_written_plans_are_freed(spark):
    """Those of the last plan too, which the listeners' threads hold until another event comes."""
    import time

    from orthoflux.scratch import free_shuffles, materialize

    tracked = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    free_shuffles(spark)
    time.sleep(2)
    before = tracked.size()
    materialize(spark.range(1000).repartition(3, "id"), "shuffled")
    assert tracked.size() == before + 1
    free_shuffles(spark)
    for _ in range(50):
        if tracked.size() <= before:
            break
        time.sleep(0.1)
    assert tracked.size() <= before
