from collections import Counter

import test_decontam
import test_near_dedup
from pyspark.sql import functions as F

import corpus_pipeline
from framespan.llm.packing import op1
from framespan.llm.quality_model import op4
from framespan.llm.toxicity import op8

AT = "/root/testdata/sf0.01"


def as_counter(df):
    return Counter(tuple(r) for r in df.collect())


def test_each_stage_on_all_that_the_one_before_kept(spark, tmp_path):
    labels = spark.read.parquet(f"{AT}/labels.parquet")
    docs = spark.read.parquet(f"{AT}/documents.parquet")
    numbers = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = f"{tmp_path}/{name}"
        stage(spark, docs, AT).write.parquet(out)
        kept = spark.read.parquet(out)
        if k < 4:
            assert kept.columns == docs.columns
            numbers.append(kept.count())
        if name == "toxicity":
            good = [r["doc_id"] for r in op8(docs, labels).collect() if not r["predicted"]]
            assert Counter(r["doc_id"] for r in kept.collect()) == Counter(good)
        elif name == "quality":
            good = [r["doc_id"] for r in op4(docs, labels).collect() if r["predicted"]]
            assert Counter(r["doc_id"] for r in kept.collect()) == Counter(good)
        elif name == "near_duplicates":
            want = [r[0] for r in test_near_dedup.brute([(r["doc_id"], r["text"]) for r in docs.collect()]) if r[3]]
            assert Counter(r["doc_id"] for r in kept.collect()) == Counter(want)
        elif name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{AT}/benchmark.parquet").collect()]
            want = [r[0] for r in test_decontam.brute([(r["doc_id"], r["text"]) for r in docs.collect()], items) if not r[5]]
            assert Counter(r["doc_id"] for r in kept.collect()) == Counter(want)
        else:
            pieces = Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in op1(docs).collect())
            assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in kept.collect()) == pieces
            assert corpus_pipeline.run(spark, AT).count() == sum(pieces.values())
        if k < 4:
            assert not as_counter(kept) - as_counter(docs)
        docs = kept
    assert all(a > b for a, b in zip(numbers, numbers[1:]))


#: Names that stages use for columns of their own, or once did, and one that must be quoted.
CLASHES = "quality score n_chars_ tag Score k1 k2 __k1 __k2 __score __tag __blank i none t1 t2 row salt salts n w hw wid own c key root label a.b".split()


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "some plain words of a text", "en", None, 5), (3, "some plain words of a text", "en", None, 5), (None, "another text of plain words", None, "s", 5)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = plain.select("*", *(F.lit(f"x{k}").alias(c) for k, c in enumerate(CLASHES) if c != "Score"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        kept = stage(spark, docs, AT)
        assert kept.columns == docs.columns
        assert as_counter(kept.select("doc_id", "text")) == as_counter(stage(spark, plain, AT).select("doc_id", "text"))
        assert not as_counter(kept) - as_counter(docs)
        assert stage(spark, docs.limit(0), AT).count() == 0
    assert corpus_pipeline.STAGES[2][1](spark, docs, AT).count() == 4
    assert corpus_pipeline.STAGES[-1][1](spark, docs, AT).count() == 5
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), AT).count() == 0


def test_of_repeated_rows_the_least_stays(spark):
    rows = [(3, "some plain words of a text", source) for source in "cab"] + [(4, "Some plain words of a text", "0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    assert [tuple(r) for r in corpus_pipeline.STAGES[2][1](spark, docs, AT).collect()] == [rows[1]]
