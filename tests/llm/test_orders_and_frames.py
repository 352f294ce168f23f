"""The cascade's order and the bundles' frames; the pipeline from end to end on a small table."""

import random

import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrafold.llm import quality, warc

SF = "/root/testdata/sf0.1"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.floats(0.1, 1e6), st.floats(0, 1)), max_size=12))
def test_rules_are_sorted_by_rejection_per_cost(measured):
    rules = [(quality.Rule(str(i), "true"), c, s) for i, (c, s) in enumerate(measured)]
    got = quality.by_rate(rules)
    rates = [s / c for _, c, s in got]
    assert rates == sorted((s / c for _, c, s in rules), reverse=True)
    for (a, ca, sa), (b, cb, sb) in zip(got, got[1:], strict=False):
        assert sa / ca > sb / cb or int(a.name) < int(b.name)


def test_a_rising_chain_of_rates_is_turned_round():
    rules = [(quality.Rule(str(i), "true"), 1.0, r / 20) for i, r in enumerate((1, 1.9, 3.6, 6.8, 13))]
    assert [r.name for r, _, _ in quality.by_rate(rules)] == ["4", "3", "2", "1", "0"]


def test_the_order_is_the_same_every_time(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    orders = {tuple((r.name, c, s) for r, c, s in quality.order_rules(docs, quality.RULES, known=known)) for _ in range(5)}
    assert len(orders) == 1
    order = orders.pop()
    cost = {name: c for name, c, _ in order}
    assert cost["symbols"] == 1 and cost["dup_lines"] > 100 and [s / c for _, c, s in order] == sorted((s / c for _, c, s in order), reverse=True)


def test_records_share_frames_and_one_frame_is_read_for_one_record(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, f"http://h/{i}", f"<html>{'common text ' * 30}{rng.random()}</html>") for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    bundles = warc.archive(df, frame_bytes=8000)
    row = bundles.first()
    per = [row.frame.count(f) for f in range(max(row.frame) + 1)]
    assert len(per) > 5 and min(per[:-1]) >= 2 and len(row.frame_offset) == len(per)
    store, path = warc.opened(row.bundle)
    with store.open_input_file(path) as file:
        whole = file.read()
    for page, frame, at, size in zip(row.record_id, row.frame, row.record_offset, row.record_size, strict=True):
        raw = whole[row.frame_offset[frame] : row.frame_offset[frame] + row.frame_size[frame]]  # this frame's bytes alone
        fields, _, payload = warc.parse(zstandard.ZstdDecompressor().decompress(raw)[at : at + size])
        assert fields["X-Page-ID"] == str(page) and payload.decode() == rows[page][2]
    got = {r.record_id: bytes(r.record) for r in warc.fetch(bundles, spark.createDataFrame([(3,), (150,)], "id long"), "id").collect()}
    assert {i: warc.parse(raw)[2].decode() for i, raw in got.items()} == {i: rows[i][2] for i in (3, 150)}
    single = warc.archive(df, frame_bytes=1).first()  # a frame for each record
    assert len(single.frame_size) == 200 and sum(single.frame_size) > 3 * sum(row.frame_size)


def test_payloads_larger_than_a_frame(spark):
    rows = [(1, "u", "é" * 400_000), (2, "u", None), (3, "u", "é" * 400_000), (4, "v", "x")]
    bundles = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = sorted((r.record_id, r.record_type, r.payload_bytes, r.refers_to) for r in warc.read_bundles(bundles).collect())
    assert got == [(1, "revisit", 800_000, 3), (2, "response", 0, None), (3, "response", 800_000, None), (4, "response", 1, None)]


def test_the_whole_pipeline(spark, tmp_path):
    """All five stages from a folder, with a null text, a blank one, repeated rows and columns whose names clash."""
    import corpus_pipeline

    sf, here = "/root/testdata/sf0.001", str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({"bin": F.lit("x"), "reason": F.lit("y"), "score": F.lit(0.5)})
    first = docs.where("doc_id = 0")
    odd = first.withColumns({"doc_id": F.lit(900_001).cast("long"), "text": F.lit(None).cast("string")})
    odd = odd.unionByName(first.withColumns({"doc_id": F.lit(900_002).cast("long"), "text": F.lit("  \n ")})).unionByName(first)
    docs.unionByName(odd).write.parquet(f"{here}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{here}/labels.parquet")
    out = corpus_pipeline.run(spark, here).persist()
    assert out.count() > 0 and {r.doc_id for r in out.select("doc_id").distinct().collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
    docs.limit(0).write.parquet(f"{here}/none/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").limit(0).write.parquet(f"{here}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{here}/none").count() == 0


def test_pipeline_stages_keep_the_columns_of_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, "/root/testdata/sf0.001")
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
