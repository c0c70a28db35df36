"""Every registered query of this subpackage, and the pipeline stage by stage, on a table small enough to be looked at whole."""

import hashlib
import importlib.util
import random
import zlib

import pytest

from loglattice.llm.queries import QUERIES


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    r = random.Random(1)
    texts = {k: " ".join(r.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta"]) + str(r.randrange(9)) for _ in range(r.choice([3, 30, 90]))) for k in range(60)}
    texts |= {60 + k: texts[k] for k in range(5)} | {70: None, 71: "", 72: "Mr. John Smith wrote to j.smith@corp.org from 10.1.2.3 about the report"}
    rows = [(k, t, "en", "web", None if t is None else len(t)) for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, 0, "user", "hi <"), (1, 1, "assistant", "yes"), (2, 0, "user", None)], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [1.0, 0.0], 2)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    pages = [(k, f"http://h.example/{k}", f"<body><nav><a>x{k}</a></nav><div>Same on all</div><article><p>Body {k} &amp; more</article>") for k in range(8)] + [(8, None, None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return d, texts


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_query_runs_on_all_rows(spark, small, name):
    d, texts = small
    got = QUERIES[name](spark, d).collect()
    n = {"op6_chat_formatting": 3, "op10_vector_dedup": 3, "op13_wrapper_induction": 9}.get(name, len(texts))
    assert got and (len(got) == n or name in ("op5_importance_resampling", "op7_best_fit_packing", "op9_sampled_segmentations", "op11_errata_trie"))
    if name == "op13_wrapper_induction":
        assert {x.page_id: x.text for x in got} == {k: f"Body {k} & more" for k in range(8)} | {8: ""}
    if name == "op3_media_sniffing":
        for x in got:
            raw = (texts[x.doc_id] or "").encode()
            pad = raw + b"\0" * (-len(raw) % 64 if raw else 64)
            assert (x.payload_sha256, x.tail_crc32, x.n_bytes) == (hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]), len(raw))
    if name == "op7_best_fit_packing":
        assert {x.doc_id: x.ids_crc32 for x in got} == {k: zlib.crc32((t or "").encode() + b"\0") for k, t in texts.items()}
    if name == "op9_sampled_segmentations":
        assert all(x.decoded_crc32 == zlib.crc32((texts[x.doc_id] or "").encode()) for x in got) and {x.doc_id for x in got} == set(texts)
    if name == "op6_chat_formatting":
        assert {x.conv_id for x in got} == {-7, 1, 2}


def test_the_pipeline_stage_by_stage(spark, small):
    if importlib.util.find_spec("corpus_pipeline") is None:
        pytest.skip("the pipeline is not there")
    import corpus_pipeline

    d, texts = small
    docs = spark.read.parquet(f"{d}/documents.parquet").selectExpr("*", "'own' as pii")
    kept = corpus_pipeline.quality(spark, docs, d)
    assert kept.columns == docs.columns and kept.count() == len(texts)  # no label is bad
    one = corpus_pipeline.near_duplicates(spark, kept, d)
    assert {x.doc_id for x in one.collect()} == set(texts) - {60, 61, 62, 63, 64}
    clean = corpus_pipeline.personal_data(spark, one, d)
    said = {x.doc_id: x for x in clean.collect()}
    assert clean.columns == docs.columns and said[72].pii == "own" and "Smith" not in said[72].text and "10.1.2.3" not in said[72].text and said[72].n_chars == len(said[72].text)
    assert all(said[k].text == texts[k] for k in range(60))
    packed = corpus_pipeline.packed(spark, clean, d).collect()
    assert b"".join(bytes(x.ids) for x in packed).count(b"\0") == len(said)
    assert sum(x.used for x in packed) == sum(len((x.text or "").encode()) + 1 for x in said.values())
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, d)
    assert empty.count() == 0
