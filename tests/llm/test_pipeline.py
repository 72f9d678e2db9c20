"""The pipeline's stages take effect, one after another."""

import hashlib

import corpus_pipeline as P
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "x")
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_columns_stay(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns and after.count() <= before.count()


def test_each_takes_effect(stages, spark):
    from prosemill.llm import decontaminate, simhash, substring_dedup

    (raw, good), (_, single), (_, cut), (_, clean), (_, ids) = stages
    assert 0 < good.count() < raw.count()
    groups = simhash.near_duplicates(good)
    assert single.count() == groups.select("component_id").distinct().count()
    assert not single.join(groups.filter("doc_id = component_id"), "doc_id", "left_anti").count()
    words = substring_dedup.remove_repeats(single, with_text=False)
    again = {r["doc_id"]: r["text"] for r in cut.collect()}
    for r in words.collect():
        assert hashlib.sha256(b" ".join(again[r["doc_id"]].encode().split())).hexdigest() == r["kept_sha256"]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert not decontaminate.contamination(clean, bench).filter("contaminated").count()
    assert cut.count() - clean.count() == decontaminate.contamination(cut, bench).filter("contaminated").count()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    found = {r["doc_id"]: r["ids"] for r in ids.collect()}
    assert found == {i: t.encode(x, add_special_tokens=False).ids for i, x in texts.items()}


def test_repeated_rows_leave_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    once = P.near_dedup(spark, docs, SF).count()
    assert P.near_dedup(spark, docs.union(docs).withColumn("key0", F.lit(1)), SF).count() == once


def test_odd_tables(spark):
    """Nulls in any column, blank and long texts, repeated rows, extra columns with the operators' own names, an empty table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (900_001, "", "en", None, 0), (900_002, " \n ", None, "s", None), (900_003, "w " * 40_000, "en", "s", 80_000), (None, "an id is missing", "en", "s", 16)], docs.schema)
    d = docs.union(odd).union(odd).withColumns({"kept": F.lit("k"), "chunk": F.lit(1), "key0": F.lit(None).cast("string"), "words": F.lit(2), "t": F.lit(3)})
    empty = d.filter("false")
    for name, stage in P.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
        out = stage(spark, d, SF)
        assert out.count() <= d.count()
        if name != "bpe":
            assert out.columns == d.columns
    assert P.STAGES[-1][1](spark, d, SF).count() == d.count()
