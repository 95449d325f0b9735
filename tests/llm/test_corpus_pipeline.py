import corpus_pipeline
from helpers_llm import LONG, empty_docs
from pyspark.sql import functions as F
from riskframe.llm import exact_dedup, simhash, toxicity
from test_toxicity import corpus


def write(spark, folder, docs, labels):
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def frames(spark):
    rows, labels, toxic = corpus(600)
    clean = next(t for i, t, _ in rows if i not in toxic)
    rows += [(1000, clean, "en"), (1001, clean + "  ", "en"), (1002, LONG, "en"), (1003, LONG + " end", None),
             (1004, None, None), (1005, "", "en"), (1004, None, None), (None, "lone text", "en")]
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("key", F.lit(1)).repartition(3),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_stages_agree_with_their_operators(spark, tmp_path):
    docs, labels = frames(spark)
    d = write(spark, tmp_path, docs, labels)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out[name] = stage(spark, docs, d)
        assert out[name].columns == docs.columns
    model = toxicity.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    bad = toxicity.score(docs, model).where("predicted = 1").count()
    assert bad > 50 and out["toxicity"].count() == docs.count() - bad
    n = exact_dedup.exact_dedup(docs).select("text_sha256").distinct().count()
    kept = out["exact_dedup"].collect()
    assert len(kept) == n and sum(r.text in (None, "") for r in kept) == 1
    groups = simhash.simhash_components(docs).select("component_id").distinct().count()
    left = out["simhash_near_dedup"].collect()
    assert len(left) == groups and {r.doc_id for r in left} >= {1002, None} and 1003 not in {r.doc_id for r in left}


def test_run_packs_what_the_stages_keep(spark, tmp_path):
    docs, labels = frames(spark)
    d = write(spark, tmp_path, docs, labels)
    step = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, d)
    want = sorted(str(r.doc_id) for r in step.select("doc_id").collect())
    got = corpus_pipeline.run(spark, d)
    whole = got.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert sorted(str(r.doc_id) for r in whole) == want and all(r.n == r.t for r in whole)


def test_empty_tables(spark, tmp_path):
    d = write(spark, tmp_path, empty_docs(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert corpus_pipeline.run(spark, d).count() == 0
