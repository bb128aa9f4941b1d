import corpus_pipeline
import pyarrow as pa
import sentencepiece
from lodestone.llm import pii, quality, sentencepiece_codec
from tests.llm.test_decontamination import brute as leaks
from tests.llm.test_ngram_join import brute as groups
from tests.llm.test_pii import whole

SMALL = "/root/testdata/sf0.01"


def test_pipeline_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr("tests.llm.test_pii.KEY", pii.session_key(spark))
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    found = docs.select("doc_id", "text").collect()
    scores = quality.train(docs, labels).scores(pa.array([r.text for r in found]))
    rows = {r.doc_id: r.text for r, s in zip(found, scores, strict=True) if s >= 0.5}
    assert 0.5 * docs.count() < len(rows) < docs.count()
    first = {c for _, c in groups(rows.items()).values()}
    rows = {d: t for d, t in rows.items() if d in first}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    bad = {d for d, _ in leaks(rows.items(), items)}
    assert bad
    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    want = {d: model.encode(whole(t)[0]) for d, t in rows.items() if d not in bad}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got == want


def test_stages_keep_columns_and_take_edge_rows(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "the dog " * 40, None, "s", 1), (3, "the dog " * 40, "en", None, 1)]
    for some in (rows, []):
        docs = spark.createDataFrame(some, kind)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SMALL)
            assert out.columns == docs.columns
            docs = spark.createDataFrame([tuple(r) for r in out.collect()], kind)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == docs.count()
