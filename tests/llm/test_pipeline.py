"""The pipeline stage by stage, and the registered queries."""

import shutil

import corpus_pipeline as cp
import pytest

from gridloom.llm import near_dedup, quality, suffix_dedup
from gridloom.llm.common import Scratch, table
from gridloom.llm.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"


def test_names():
    assert {n.split("_")[0] for n in queries()} == {f"op{k}" for k in range(1, 14)} and set(oracle_sql()) <= set(queries())
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "near_dedup", "suffix_dedup", "mix_sources", "pack_sequences"]


def test_stages(spark, tmp_path):
    docs = table(spark, DATA, "documents")
    columns, n = docs.columns, docs.count()
    net = quality.learned(docs, table(spark, DATA, "labels"))
    for k, (name, stage) in enumerate(cp.STAGES):
        before = docs
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if name == "pack_sequences":
            assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").isEmpty()
            assert docs.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
            continue
        assert docs.columns == columns
        if name == "quality_classifier":
            kept = {r.doc_id for r in quality.score(before, net, "s").where("s >= 0.7").collect()}
            assert {r.doc_id for r in docs.select("doc_id").collect()} == kept and 0.7 * n < len(kept) < n
        elif name == "near_dedup":
            assert {r.doc_id for r in docs.collect()} == {r.class_id for r in near_dedup.classes(before).collect()}
        elif name == "suffix_dedup":
            texts = [r.text for r in docs.collect()]
            seen = set()
            for t in texts:  # no passage of the length is left twice, but where a cut brought two ends together
                own = {t[i : i + 400] for i in range(0, len(t) - 400)}
                assert not own & seen
                seen |= own
        else:
            words = lambda d: sum(len(r.text.split()) for r in d.collect())
            assert abs(words(docs) - words(before)) <= 0.01 * words(before) + 20


def test_columns_with_any_name_are_passed_on(docs_of, prose):
    names = ["__score", "__h1", "__h2", "__k1", "__k2", "__ranges", "__copies"]
    docs = docs_of([(1, prose(60, 1), "s"), (2, prose(60, 1), "s"), (3, prose(60, 2), "s")])
    for n in names:
        docs = docs.withColumn(n, docs["doc_id"] * 7)
    for out in (near_dedup.representatives(docs), suffix_dedup.strip_repeats(docs, 400), cp.keep_quality(docs.sparkSession, docs, DATA)):
        assert out.columns == docs.columns and all(r[n] == 7 * r.doc_id for r in out.collect() for n in names)


def test_stages_take_any_table(spark, docs_of, mixed_docs):
    # nulls, empty and very long texts, repeated rows, clashing column names; then no rows at all
    for docs in (docs_of(mixed_docs), docs_of([])):
        empty, columns, scratch = docs.isEmpty(), docs.columns, Scratch(spark, "any")
        for name, stage in cp.STAGES[:-1]:
            before, docs = docs, scratch.keep(stage(spark, docs, DATA))
            assert docs.columns == columns and docs.isEmpty() == empty
            if name == "quality_classifier":
                assert docs.exceptAll(before).isEmpty()
                docs = before  # the other stages are to see every case
            elif name == "near_dedup":
                assert docs.exceptAll(before).isEmpty() and docs.where("doc_id = 20 or doc_id = 21").count() == (0 if empty else 1)
            elif name == "suffix_dedup":
                texts = [r.text or "" for r in docs.collect()]
                cut = cp.PASSAGE_BYTES
                raw = [t.encode() for t in texts if len(t) < 20_000]
                seen = [{b[i : i + cut] for i in range(len(b) - cut + 1)} for b in raw]
                assert sum(map(len, seen)) == len(set().union(*seen))  # no passage is left twice
        packed = cp.STAGES[-1][1](spark, docs, DATA)
        assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").isEmpty() and packed.isEmpty() == empty


def test_run(spark):
    assert cp.run(spark, DATA).count() > 0


@pytest.mark.parametrize("name", ["op1_near_dedup", "op7_mix_sources", "op9_suffix_dedup"])
def test_queries_cover_the_table(spark, name):
    assert queries()[name](spark, DATA).count() == table(spark, DATA, "documents").count()


def teardown_module():
    shutil.rmtree("spark-warehouse", ignore_errors=True)
