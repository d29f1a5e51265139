"""Each stage of the pipeline against a plain version, and the whole over the smallest tables."""

import corpus_pipeline as p

from lodestone.llm import pii_crf, toxicity_gbt
from lodestone.llm.common import table

from .test_operators import weighted_classes


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    assert [n for n, _ in p.STAGES] == ["toxicity", "near_dedup", "decontamination", "personal_data", "token_ids"]
    kept = p.toxicity(spark, docs, sf)
    assert kept.columns == p.COLUMNS
    scores = toxicity_gbt.score(docs, toxicity_gbt.train(docs, table(spark, sf, "labels")))
    assert ids(kept) == ids(scores.where("predicted = 0"))

    one = p.near_dedup(spark, docs.union(docs.limit(5)), sf)
    assert one.columns == p.COLUMNS
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    from lodestone.llm.icws_dedup import inverse_frequency

    place = weighted_classes(rows, inverse_frequency(docs.union(docs.limit(5)).select("text")))
    assert ids(one) == sorted(set(place.values()))

    clean = p.decontamination(spark, docs, sf)
    from lodestone.llm.decontaminate import decontaminate

    bench = table(spark, sf, "benchmark")
    assert ids(clean) == ids(decontaminate(docs, bench).where("n_hit = 0")) and len(ids(clean)) < docs.count()
    assert decontaminate(clean, bench).where("n_hit > 0").count() == 0  # no window survives

    redacted = {r.doc_id: r for r in p.personal_data(spark, docs, sf).collect()}
    assert len(redacted) == len(rows)
    for i, t in rows:
        assert not pii_crf.base_spans(redacted[i].text) or not pii_crf.base_spans(t)
        assert redacted[i].n_chars == len(redacted[i].text)


def test_run(spark, sf):
    got = p.run(spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert 0 < got.count() < table(spark, sf, "documents").count()


def test_odd_rows(spark, sf):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b", None, "s", 3), (None, "a b", None, "s", 3), (3, "x", "en", None, 1), (3, "y", "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in p.STAGES:
        assert stage(spark, docs, sf).count() >= 4, name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    assert p.near_dedup(spark, docs, sf).count() == 4
