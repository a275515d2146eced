"""The corpus pipeline, stage by stage, against brute force on its own input."""

import corpus_pipeline as cp
from lowdata.llm import pii, toxicity
from lowdata.llm.common import table
from tests.conftest import SMALL
from tests.llm.test_operators_llm import brute_decon, brute_simhash, edge, empty, sent_by_broadcast


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages_match_brute_force(spark):
    docs = table(spark, SMALL, "documents")
    model = toxicity.train(docs, table(spark, SMALL, "labels"), "toxic")
    kept = cp.remove_toxic(spark, docs, SMALL)
    assert sorted(rows(kept)) == sorted((i, t) for i, t in rows(docs) if model.score(t) < 0.5) and kept.columns == docs.columns
    once = cp.remove_near_duplicates(spark, docs, SMALL)
    before = rows(docs)
    _, comp = brute_simhash(before)
    assert sorted(rows(once)) == sorted((i, t) for (i, t), c in zip(before, comp) if i == c) and once.columns == docs.columns
    clean = cp.remove_contaminated(spark, docs, SMALL)
    bench = [(r["item_id"], r["text"]) for r in table(spark, SMALL, "benchmark").collect()]
    assert sorted(rows(clean)) == sorted((i, t) for i, t in before if all(h == 0 for _, _, h, _ in brute_decon([(i, t)], bench)))
    field = pii.train(docs)
    redacted = cp.redact_personal_data(spark, docs, SMALL)
    assert sorted(rows(redacted)) == sorted((i, pii.redact(t, field)) for i, t in before)
    assert all(r["n_chars"] == len(r["text"]) for r in redacted.collect())


def test_run_and_edges(spark):
    out = cp.run(spark, SMALL)
    assert out.count() > 0 and {"doc_id", "bin", "bin_length"} <= set(out.columns)
    for docs in (edge(spark), empty(spark)):
        n = docs.count()
        for name, stage in cp.STAGES:
            docs = cp.store(stage(spark, docs, SMALL), f"test-{name}")
        assert (docs.count() > 0) == (n > 0)


def test_contaminated_rows_leave_by_row(spark):
    bench = table(spark, SMALL, "benchmark").first()["text"]
    docs = spark.createDataFrame([(1, "start " + bench + " end"), (1, "clean text"), (None, bench), (None, "fine"), (2, None)], "doc_id bigint, text string")
    assert sorted(rows(cp.remove_contaminated(spark, docs, SMALL)), key=str) == sorted([(1, "clean text"), (None, "fine"), (2, None)], key=str)


def test_decontamination_stage_broadcasts_no_candidates(spark, monkeypatch):
    """Keys of hit documents may be broadcast where Spark finds them small (their estimate is a product of tables); candidates may not."""
    sent = sent_by_broadcast(spark, monkeypatch, lambda: cp.remove_contaminated(spark, table(spark, SMALL, "documents"), SMALL))
    assert not [x for x in sent if "tables/decon-candidates" in x]
