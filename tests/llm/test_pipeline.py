from collections import Counter

import corpus_pipeline
from millrace.llm import common, quality_rules, sentencepiece_codec

from . import brute

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_stages_return_documents(spark):
    docs = common.documents(spark, SMALL)
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, SMALL)
        assert out.columns == docs.columns, name
    assert len(corpus_pipeline.STAGES) == 5


def test_run_by_brute_force(spark):
    """The rows left by plain versions of the stages, up to the mix, are what the mix has; and its ids are the library's."""
    import sentencepiece

    rows = {r.doc_id: r for r in common.documents(spark, MORE).collect()}
    judged = quality_rules.judge(common.documents(spark, MORE), spark.read.parquet(f"{MORE}/labels.parquet"))
    left = {r.doc_id for r in judged.where("kept").collect()}
    by_text = {}
    for i in left:
        by_text[rows[i].text] = max(i, by_text.get(rows[i].text, -1))
    left = set(by_text.values())
    near = brute.components([(i, brute.shingles(rows[i].text)) for i in left])
    left = {i for i in left if near[i] == i}
    out = corpus_pipeline.run(spark, MORE).collect()
    taken = Counter(r.doc_id for r in out)
    assert set(taken) <= left and max(taken.values()) <= 2
    sizes = {i: len(brute.words(rows[i].text)) for i in left}
    total = sum(sizes.values())
    assert abs(sum(sizes[i] * n for i, n in taken.items()) - 1.5 * total) < 0.05 * total
    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.model_path())
    assert all(r.n_tokens == len(lib.encode(rows[r.doc_id].text)) for r in out)


def test_clean_labelled_documents_stay(spark):
    judged = quality_rules.judge(common.documents(spark, MORE), spark.read.parquet(f"{MORE}/labels.parquet"))
    lost = judged.join(spark.read.parquet(f"{MORE}/labels.parquet"), "doc_id").where("quality = 1 AND NOT kept AND NOT base_failed").count()
    assert lost <= 2


def test_run_on_odd_rows_and_an_empty_table(spark, tmp_path):
    """Nulls, repeated rows and ids, long texts, clashing columns: nothing that the base rules reject, one row at most of each group of copies."""
    labels = spark.read.parquet(f"{MORE}/labels.parquet")
    for name, docs in (("odd", brute.odd(spark)), ("empty", brute.empty(spark))):
        at = str(tmp_path / name)
        docs.write.parquet(f"{at}/documents.parquet")
        labels.write.parquet(f"{at}/labels.parquet")
        taken = Counter(r.doc_id for r in corpus_pipeline.run(spark, at).collect())
        if name == "empty":
            assert not taken
    rows = [(r[0], r[1]) for r in brute.odd_rows() if r[0] is not None]
    passed = [(i, t) for i, t in rows for n, _, _, _, hit in [brute.quality(t)] if n >= 20 and 100 * hit <= 30 * n]
    at = str(tmp_path / "odd")
    taken = Counter(r.doc_id for r in corpus_pipeline.run(spark, at).collect())
    near = brute.components([(i, brute.shingles(t)) for i, t in passed])
    assert taken and set(taken) <= set(near) and max(taken.values()) <= 2
    assert len({near[i] for i in taken}) == len(taken)
