"""The registered corpus queries: SQL where there is some, and the pipeline's stages one by one."""

import pytest

duckdb = pytest.importorskip("duckdb")

import corpus_pipeline  # noqa: E402
from ledgerloom.llm.registry import QUERIES, SQL  # noqa: E402
from ledgerloom.session import stage  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    assert {name.split("_")[0] for name in QUERIES} >= {f"op{n}" for n in range(1, 11)} and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours = QUERIES[name](spark, SF)
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(ours.columns)
    assert sorted(map(str, cursor.fetchall())) == sorted(str(tuple(r[c] for c in names)) for r in ours.collect())


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    extra = spark.createDataFrame([(10_000, None, None, None, None), (10_001, "12 34", "en", "s", 5)], docs.schema)
    docs = docs.union(extra).union(docs.where("doc_id = 3"))
    sizes = [docs.count()]
    for k, (_, work) in enumerate(corpus_pipeline.STAGES):
        docs, _ = stage(work(spark, docs, SF), "stage")
        assert docs.columns[:5] == list(corpus_pipeline.COLUMNS)
        sizes.append(docs.count())
        if k == 0:
            assert docs.where("doc_id >= 10000").count() == 0
        if k == 1:
            assert docs.count() == docs.select("doc_id", "text").distinct().count()
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.6 * sizes[0]
    assert docs.where("n_tokens IS NULL OR ids IS NULL").count() == 0


def test_two_texts_under_one_id_are_two_documents(spark):
    """A near copy is dropped, another text with its id stays, and rows that repeat as a whole stay once."""
    words = [f"w{i}" for i in range(60)]
    near, other = " ".join(words), " ".join(reversed(words))
    rows = [(1, near), (2, near + " more"), (2, other), (2, other), (3, None), (None, near), (4, ""), (4, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()), key=str)
    assert kept == sorted([(1, near), (2, other), (3, None), (None, near), (4, "")], key=str)


def test_every_stage_takes_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, work in corpus_pipeline.STAGES[1:]:
        assert work(spark, docs, SF).collect() == [], name


def test_near_copies_move_no_texts(spark):
    """What is dropped is a few narrow rows, so no exchange of the result carries texts, but that of rows that repeat."""
    words = [f"w{i}" for i in range(60)]
    docs = [(1, " ".join(words)), (2, " ".join([*words, "end"])), (3, "another text of its own kind"), (3, "another text of its own kind"), (None, " ".join(words)), (4, None)]
    rows = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = corpus_pipeline.drop_near_copies(spark, rows, SF)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
        assert sorted(((r.doc_id or 0), (r.text or "")[:7]) for r in kept.collect()) == [(0, "w0 w1 w"), (1, "w0 w1 w"), (3, "another"), (4, "")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
