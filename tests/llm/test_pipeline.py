import corpus_pipeline
from tests.llm.test_similar import brute_near
from weirflow.llm import common, exact_dedup

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    by_name = dict(corpus_pipeline.STAGES)
    assert list(by_name) == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]
    one = by_name["language_id"](spark, docs, SF).cache()
    assert one.columns == docs.columns and one.count() >= 0.99 * docs.count()
    two = by_name["exact_dedup"](spark, one, SF).cache()
    assert {r.doc_id for r in two.select("doc_id").collect()} == {r.doc_id for r in exact_dedup.exact_dedup(one).filter("kept").collect()}
    assert two.count() == one.select("text").distinct().count()
    three = by_name["near_dedup"](spark, two, SF).cache()
    near = brute_near([(r.doc_id, r.text) for r in two.select("doc_id", "text").collect()], 80)
    assert {r.doc_id for r in three.select("doc_id").collect()} == {i for i, (_, c) in near.items() if c == i}
    four = by_name["mixing"](spark, three, SF).cache()
    assert four.columns == docs.columns and four.join(three, "doc_id", "left_anti").count() == 0
    five = by_name["packing"](spark, four, SF)
    assert {r.doc_id for r in five.select("doc_id").distinct().collect()} == {r.doc_id for r in four.select("doc_id").collect()}


def test_columns_of_any_case(spark, edge):
    """Columns named like the operators' own, in another case, go through all stages."""
    docs = edge.select("doc_id", "text", "lang", "source", "n_chars").selectExpr("*", "'l' AS Language", "'m' AS Mix", "'d' AS _doc", "'r' AS Chance")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert out.filter("Language = 'l' AND Mix = 'm' AND Chance = 'r'").count() == out.count()


def test_the_run_leaves_only_what_its_result_reads(spark):
    before = common.tables()
    out = corpus_pipeline.run(spark, SF)
    left = common.tables() - before
    assert out.count() > 0 and len([p for p in left if "/stage-" in p]) == 1
    common.release(spark, before)


def test_repeated_rows_and_nulls(spark):
    rows = [(1, "some words here", "en", "s", 1)] * 3 + [(None, None, None, None, None)] * 2 + [(2, "other words there", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.exact_copies(spark, docs, SF).count() == 3
    assert corpus_pipeline.languages(spark, docs, SF).count() == 4
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
