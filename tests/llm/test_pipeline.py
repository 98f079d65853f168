"""The pipeline's stages against brute force, each on what the one before kept."""

import re
from collections import Counter

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F
from test_operators import brute_leaks, brute_lines, brute_simhash

from tidemark.llm import quality
from tidemark.llm.common import written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, SF))
        out.append((name, before, docs))
    return {name: (before, after) for name, before, after in out}


def test_columns(stages):
    for name, (before, after) in stages.items():
        assert before.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert after.columns == before.columns + ["copies"] * (name == "mix_sources")


def test_quality(stages, duck):
    kept = {r[0] for r in duck.execute(f"SELECT doc_id FROM ({quality.OP10_SQL}) WHERE kept").fetchall()}
    assert kept == {r["doc_id"] for r in stages["quality_rules"][1].collect()}


def test_lines(stages):
    before, after = stages["line_dedup"]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    want = {}
    for (i, t), kept in zip(rows, brute_lines(rows), strict=True):
        lines = t.split("\n")
        if kept:
            want[i] = t if len(kept) == sum(bool(x.strip(" \t\n\x0b\x0c\r")) for x in lines) else "\n".join(lines[k] for k in kept)
    assert want == {r["doc_id"]: r["text"] for r in after.collect()}
    assert after.filter(F.length("text") != F.col("n_chars")).count() == 0


def test_near(stages):
    before, after = stages["simhash_dedup"]
    found = brute_simhash([(r["doc_id"], r["text"]) for r in before.collect()])
    assert Counter(key for key, _, least in found if key == least) == Counter(r["doc_id"] for r in after.collect())


def test_leaks(stages, spark):
    before, after = stages["decontamination"]
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = {key for key, _ in brute_leaks([(r["doc_id"], r["text"]) for r in before.collect()], items)}
    assert {r["doc_id"] for r in before.collect()} - gone == {r["doc_id"] for r in after.collect()}


def test_mix(stages, tmp_path):
    from tidemark.llm.mixing import OP7_SQL

    before, after = stages["mix_sources"]
    before.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = {r[0]: r[1] for r in con.execute(f"SELECT doc_id, taken FROM ({OP7_SQL}) WHERE taken > 0").fetchall()}
    words = {r["doc_id"]: r["copies"] * len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in after.collect()}
    assert want == words
    # the mix is of the documents as they were
    assert after.drop("copies").exceptAll(before).isEmpty()


def test_run_gives_the_last_stage(stages, spark):
    assert sorted(corpus_pipeline.run(spark, SF).collect()) == sorted(stages["mix_sources"][1].collect())


def test_stages_on_odd_documents(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows and clashing columns go through the whole chain; so does an empty table."""
    words = lambda k, n=40: " ".join(f"w{(k * 7919 + i * 104729) % 100003}" for i in range(n))
    rows = [
        (None, words(1), "en", "a", None), (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", "en", None, 3), (4, words(4, 30_000), "en", "b", 1),
        (5, words(5), "en", "b", 5), (5, words(5), "en", "b", 5), (6, words(5) + " ", "en", "a", 6), (None, words(7), None, None, None), (None, words(7), None, None, None),
        (8, words(8) + "\n" + words(5), "en", "a", 8), (9, words(9), "en", "a", 9),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(c) for c in ("row", "key", "id", "th", "at", "kept", "line", "fp", "size", "copies", "digest", "n_kept", "_row", "a.b", "q`r", "_doc")})
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            before, frame = frame, written(stage(spark, frame, SF))
            assert frame.columns == [c for c in before.columns if name != "mix_sources" or c != "copies"] + ["copies"] * (name == "mix_sources")
            if name == "mix_sources" and before.count():
                assert frame.drop("copies").exceptAll(before.drop("copies")).isEmpty() and not frame.filter("copies < 1 or text is null").count()
            if name == "line_dedup" and before.count():
                kept = Counter((r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect())
                # rows 5 repeat and stay alike; 6 has but their line; 8 keeps its own line; unnamed ones keep theirs
                assert kept == Counter([(None, words(1)), (4, words(4, 30_000)), (5, words(5)), (5, words(5)), (None, words(7)), (None, words(7)), (8, words(8)), (9, words(9))])
            if name == "simhash_dedup" and before.count():
                assert Counter(r["doc_id"] for r in frame.collect()) == Counter([None, None, 4, 5, 5, 8, 9])
