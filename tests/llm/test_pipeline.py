"""The pipeline against its stages put together by hand on a small corpus with planted cases."""

import random

import corpus_pipeline
import pytest

from feedweir.llm import common


@pytest.fixture
def folder(spark, tmp_path):
    draw = random.Random(9)
    vocabulary = {"en": "the cat sat on mat and then with this that house there".split(), "de": "der hund und die katze sitzt auf einem tisch mit haus nicht".split()}
    text = lambda lang, n: " ".join(draw.choice(vocabulary[lang]) + draw.choice(["", "s", "er", "ing", f"x{draw.randrange(90)}"]) for _ in range(n))
    item = " ".join(f"question{i}" for i in range(20))
    rows = [(i, text(lang, 120), lang, f"src{i % 3}") for i, lang in enumerate(["en", "de"] * 20)]
    rows += [(100, rows[0][1], "en", "src0"), (101, rows[1][1] + " ende", "de", "src1")]  # copies
    rows += [(102, text("en", 60) + " " + item + " " + text("en", 60), "en", "src0")]  # leak
    rows += [(103, "too short", "en", "src0"), (104, "again and again " * 40, "en", "src0"), (105, None, None, None)]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_every_stage_takes_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, after = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == names
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        after[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    clean = set(range(40))
    assert after["language_id"] == clean | {100, 101, 102, 103, 104}
    assert after["quality_rules"] == clean | {100, 101, 102}
    assert after["ngram_jaccard_join"] == clean | {102}
    assert after["benchmark_decontamination"] == clean
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    whole = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in packed} == clean and sorted(r["ids_crc32"] for r in packed) == sorted(r["ids_crc32"] for r in whole)


def test_empty_corpus(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).collect() == []


def test_the_driver_gives_freed_memory_back(spark):
    """Native memory that the JVM has freed in pieces, as after many queries, doesn't stay with the driver."""
    jvm = spark.sparkContext._jvm
    status = f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/status"
    resident = lambda: next(int(x.split()[1]) >> 10 for x in open(status) if x.startswith("VmRSS"))
    data, out = (spark.sparkContext._gateway.new_array(jvm.byte, 1 << 16) for _ in range(2))
    held = [jvm.java.util.zip.Deflater() for _ in range(1000)]  # each takes a quarter of a megabyte outside the heap
    for x in held:
        x.setInput(data)
        x.deflate(out)
    for i, x in enumerate(held):
        if i % 20:  # what stays in between keeps the rest from going back by itself
            x.end()
    before = resident()
    common.materialize(spark.range(10), "small")
    after = resident()
    for x in held[::20]:
        x.end()
    assert after < before - 50
