import corpus_pipeline
from chatpack.llm import mixing
from chatpack.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).persist()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        sizes.append(docs.count())
    assert sizes[0] < 200 and sizes[1] <= sizes[0] and sizes[1] == sizes[2] == sizes[3]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert out.count() == sizes[-1] and out.where("not lossless or n_tokens <> size(ids)").count() == 0


def test_an_empty_table_passes(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() == 0


def test_queries_have_a_row_for_each_row(spark):
    for name, table in (("op1_bpe", "documents"), ("op2_mixing", "documents"), ("op4_urls", "pages"), ("op9_vectors", "embeddings")):
        assert QUERIES[name](spark, DATA).count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()


def test_rows_of_the_run_carry_their_place_in_the_mix(spark, monkeypatch):
    inputs = {}

    def seen(name, stage):
        def wrapped(spark, docs, sf_dir):
            inputs[name] = docs
            return stage(spark, docs, sf_dir)

        return name, wrapped

    monkeypatch.setattr(corpus_pipeline, "STAGES", [seen(*s) for s in corpus_pipeline.STAGES])
    got = {(r.doc_id, r.slot, r.place) for r in corpus_pipeline.run(spark, DATA).select("doc_id", "slot", "place").collect()}
    placed = mixing.placed(inputs["mixing"]).select("row.doc_id", "slot", "place").collect()
    assert got == {tuple(r) for r in placed} and len({r[1:] for r in got}) == len(placed) > 100
