"""Registered queries on the smallest sample: SQL where there is some, planted and held-out cases elsewhere."""
import pytest

from bourseflow.llm import catalog

from tests.compare import compare, connection
from tests.conftest import SMALL


def test_one_query_of_each_operator():
    numbers = [int(n[2:].split("_")[0]) for n in catalog.queries()]
    assert sorted(numbers) == list(range(1, 14)) and set(catalog.oracle_sql()) <= set(catalog.queries())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    ok, what = compare(name, catalog.queries()[name](spark, SMALL), catalog.oracle_sql()[name], connection(SMALL))
    assert ok, what


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    got = [r for r in catalog.queries()["op3_word_first_language"](spark, SMALL).join(docs, "doc_id").collect() if r.held_out]
    assert len(got) > 30 and sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)


def test_model_is_better_than_single_words(spark):
    got = [r for r in catalog.queries()["op6_kneser_ney"](spark, SMALL).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_benchmark_items_inside_documents_are_found(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    planted = {(d, i) for d, t in docs.items() for i, x in items.items() if x in (t or "")}
    got = {(r.doc_id, r.item_id) for r in catalog.queries()["op7_seed_and_align"](spark, SMALL).collect()}
    assert planted <= got


def test_every_page_has_its_article(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = catalog.queries()["op4_min_cut_extraction"](spark, SMALL).collect()
    assert len(got) == len(pages)
    assert all(r.text for r in got if "<article>" in pages[r.page_id] and "</article>" in pages[r.page_id])
