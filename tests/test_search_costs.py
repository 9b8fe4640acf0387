"""What search costs: postings are counted where their text lies, a search makes them once, an index moves texts instead of postings."""

from pyspark.sql import functions as F

from mailweave.plans.listing import full_text, postings

ROWS = [(1, "the crane and the quay"), (2, "The crane"), (3, None), (4, "!!"), (5, "a quay of the harbour, the old one"), (5, "crane the")]


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_move_texts_only(spark):
    texts = spark.createDataFrame(ROWS, "id long, text string")
    plan = planned(postings(texts))
    assert plan.count("Exchange ") == 1 and "hashpartitioning(id" in plan
    got = {(r["term"], r["id"], r["n"]): r["tf"] for r in postings(texts).collect()}
    assert got[("the", 1, 5)] == 2 and got[("the", 5, 8)] == 2 and got[("crane", 5, 2)] == 1 and {k[1] for k in got} == {1, 2, 5}


def test_a_search_makes_the_postings_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    texts = spark.createDataFrame(ROWS[:4], "id long, text string").mapInPandas(count, "id long, text string")
    found = full_text(postings(texts), "the CRANE", 5)
    assert [r["id"] for r in found.collect()] == [2, 1] and made.value == 4
    assert full_text(postings(texts.filter(F.lit(False))), "the", 5).collect() == []


def test_an_index_moves_texts_and_whole_blocks(spark, tmp_path, monkeypatch):
    from mailweave.plans.postings import PostingsIndex

    plans, write = [], PostingsIndex._write
    monkeypatch.setattr(PostingsIndex, "_write", lambda self, rows, folder: plans.append(planned(rows)) or write(self, rows, folder))
    index = PostingsIndex(spark, str(tmp_path / "index"))
    texts = spark.createDataFrame(ROWS[:5], "id long, text string")
    for k in range(2):
        index.add(texts.filter(F.col("id") % 2 == k), f"batch-{k}")
    index.merge("all")
    assert len(plans) == 3 and not any("hashpartitioning(term" in p for p in plans) and "Generate explode" not in plans[2]
    assert [tuple(r) for r in index.search("crane the", 9).collect()] == [tuple(r) for r in full_text(postings(texts), "crane the", 9).collect()]
