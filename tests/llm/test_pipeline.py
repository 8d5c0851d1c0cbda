"""The pipeline stage by stage against brute force, and registered queries against their statements."""

from collections import defaultdict

import pytest

import corpus_pipeline
from lonja.llm import puquality, semicrf
from lonja.llm.common import table, word_bytes
from oracle_check import check, duck
from test_minhash import brute as classes_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(name, input, output) of every stage, each written and read again."""
    out, docs = [], table(spark, SF, "documents")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        new = spark.read.parquet(path)
        out.append((name, docs, new))
        docs = new
    return out


def test_order_and_columns(stages, spark):
    assert [n for n, _, _ in stages] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "PII", "best-fit packing"]
    for _, before, after in stages[:-1]:
        assert before.dtypes == after.dtypes


def test_quality_drops_what_it_rejects(stages, spark):
    _, before, after = stages[0]
    scored = puquality.score(before, table(spark, SF, "labels"))
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in scored.collect() if r.predicted}
    bad = {r.doc_id for r in table(spark, SF, "labels").filter("quality = 0").collect()}
    good = {r.doc_id for r in table(spark, SF, "labels").filter("quality = 1").collect()}
    kept = {r.doc_id for r in after.collect()}
    assert len(good & kept) >= 0.85 * len(good) and len(bad & kept) <= 0.3 * len(bad)  # 50 positives to learn from


def test_quality_of_a_larger_table(spark):
    found = {r.doc_id: r for r in puquality.score(table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")).collect()}
    held = [(found[r.doc_id].predicted, r.quality) for r in table(spark, "/root/testdata/sf0.01", "labels").collect() if found[r.doc_id].held_out]
    assert sum(p == q for p, q in held) >= 0.98 * len(held)


def test_one_document_of_each_group_stays(stages):
    _, before, after = stages[1]
    groups = classes_of([(r.doc_id, r.text) for r in before.collect()])
    assert sorted(r.doc_id for r in after.collect()) == sorted({c for _, c, _ in groups})


def test_no_window_is_left(stages, spark):
    _, before, after = stages[2]
    windows = set()
    for r in table(spark, SF, "benchmark").collect():
        w = word_bytes(r.text)
        n = min(10, len(w))
        windows |= {tuple(w[j:j + n]) for j in range(len(w) - n + 1)} if n else set()

    def hit(text):
        w = word_bytes(text)
        return any(tuple(w[p:p + n]) in windows for n in {len(x) for x in windows} for p in range(len(w) - n + 1))

    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect() if not hit(r.text)}


def test_personal_data_is_masked(stages):
    _, before, after = stages[3]
    old, new = {r.doc_id: r.text for r in before.collect()}, {r.doc_id: r for r in after.collect()}
    model = semicrf.train(before)
    assert set(old) == set(new)
    for d, text in old.items():
        assert new[d].text == semicrf.masked(text, semicrf.all_spans(text, model)[1]) and new[d].n_chars == len(new[d].text)


def test_packing_holds_every_token_once(stages):
    from lonja.llm.packing import default_vocabulary, token_ids

    _, before, after = stages[4]
    want = {r.doc_id: len(token_ids(r.text, default_vocabulary(), 2)) for r in before.collect()}
    got, fill = defaultdict(int), defaultdict(int)
    for r in after.collect():
        got[r.doc_id] += r.length
        fill[r.sequence_id] += r.length
    assert got == want and max(fill.values()) <= 1024 and len(fill) <= 1.05 * sum(want.values()) / 1024 + 1


@pytest.mark.parametrize("name", ["op1_quote_links", "op2_warc_boundary_chain", "op6_benchmark_decontamination"])
def test_query_equals_its_statement(spark, name):
    import __spark_entry__ as entry

    status, _, _, _, why = check(name, spark, duck(SF), SF, entry.queries(), entry.oracle_sql())
    assert status == "ok", why


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
