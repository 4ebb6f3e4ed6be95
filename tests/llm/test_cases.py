"""Odd tables: nulls, empty and long texts, ties, repeated rows, no rows, and columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import fixity, neardup, packing, pieces, pii, quality, repeats, simhash, topk, toxicity, urlrules

LONG = "the long text of many words goes on and on, 4111 1111 1111 1111 " * 3000
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, fp string, pii int, n_bytes string, kept boolean, ids string, rows int, block int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None, 7.0, "x", 1, "y", None, "z", 2, 3) for i, t in rows], SCHEMA)


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "One word."), (5, LONG), (6, "One word."), (None, "One word."), (None, None), (7, "日本 ☃ " * 40), (7, "日本 ☃ " * 40), (8, "\x00\x1c ˈ½²")]


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def test_packing(odd, none):
    rows = packing.pack_documents(odd, packing.default_tokenizer()).collect()
    assert {r.doc_id for r in rows} == {r[0] for r in ODD}
    assert sum(r.length for r in rows if r.doc_id == 1) == 1
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 4096 and end & (end - 1) == 0
    assert packing.pack_documents(none, packing.default_tokenizer()).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(none, packing.default_tokenizer(), tiers=(1000,))


def test_pieces(odd, none):
    rows = pieces.digest(odd, pieces.default_model()).collect()
    assert len(rows) == len(ODD)
    assert all(r.restored for r in rows)
    assert {r.n_ids for r in rows if r.doc_id in (1, 2)} == {0}
    assert pieces.digest(none, pieces.default_model()).count() == 0
    back = pieces.decode(pieces.encode(odd, pieces.default_model()), pieces.default_model())
    assert sorted((r.doc_id or -1, r.text) for r in back.collect()) == sorted((i or -1, t or "") for i, t in ODD)


def test_quality(odd, none):
    rows = quality.apply_policy(quality.ledger(odd)).collect()
    assert len(rows) == len(ODD)
    assert {r.n_words for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert not any(r.kept for r in rows if r.doc_id in (1, 2, 3, 4))
    assert quality.ledger(none).count() == 0
    assert quality.ablation(quality.ledger(none)).count() == 0


def test_simhash(odd, none):
    rows = simhash.near_components(odd).collect()
    assert len(rows) == len(ODD)
    found = {r.doc_id: r for r in rows}
    assert found[1].fp == found[2].fp == found[3].fp == 0
    assert (found[1].component_id, found[2].component_id, found[6].component_id) == (1, 1, 4)
    assert {r.component_id for r in rows if r.doc_id is None} == {1, 4}
    assert simhash.near_components(none).count() == 0
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 7, 7, 8]
    assert neardup.keep_one(none).count() == 0


def test_keep_one_without_ids(spark):
    rows = table(spark, [(None, "a b c d e f"), (None, "A b c d e f"), (None, "quite another text, of other words"), (3, "quite another text, of other words")])
    kept = sorted((r.doc_id or -1, r.text.lower()) for r in neardup.keep_one(rows).collect())
    assert kept == [(-1, "a b c d e f"), (3, "quite another text, of other words")]


def test_repeats(odd, none):
    rows = repeats.mark_repeats(odd, with_kept=True).collect()
    assert len(rows) == len(ODD)
    assert {(r.doc_id, r.n_removed) for r in rows} == {(i, 0) for i, _ in ODD}  # copies inside one document stay
    assert {r.kept_text for r in rows if r.doc_id == 5} == {LONG}
    assert {r.score for r in rows} == {7.0}
    out = repeats.mark_repeats(none)
    assert out.count() == 0
    assert sorted(out.columns) == sorted([*none.columns, "n_removed", "n_spans", "kept_sha256"])


def test_null_id_is_the_largest(spark):
    text = "a passage that is a good deal longer than fifty bytes, and stands twice"
    rows = {r.doc_id: r.n_removed for r in repeats.mark_repeats(table(spark, [(None, text), (9, text)])).collect()}
    assert rows == {None: len(text), 9: 0}


def test_pii(odd, none):
    rows = pii.pseudonymise(odd, pii.EXAMPLE_KEY).collect()
    assert len(rows) == len(ODD)
    texts = {r.doc_id: r.text for r in rows}
    assert texts[1] == "" and texts[8] == "\x00\x1c ˈ½²"
    assert "4111 1111" not in texts[5] and len(texts[5]) == len(LONG)
    assert {r.pii.card for r in rows if r.doc_id == 5} == {3000}
    assert pii.pseudonymise(none, pii.EXAMPLE_KEY).count() == 0


def test_toxicity(spark, odd, none):
    labels = spark.createDataFrame([(1, 0), (5, 1), (7, None), (None, 1), (5, 0)], "doc_id bigint, toxic int")
    model = toxicity.fit(odd, labels)
    scored = toxicity.score_documents(odd, model).collect()
    assert len(scored) == len(ODD)
    assert all(0 <= r.score <= 1 for r in scored)
    assert all(r.score < toxicity.THRESHOLD for r in scored if not (r.text or "").strip())
    assert toxicity.fit(none, labels) is None
    assert {r.score for r in toxicity.score_documents(odd, None).collect()} == {0.0}
    assert toxicity.score_documents(none, None).count() == 0


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://ORG", "http://ORG/", "ftp://a.example.org/es/x?y", "http://example.org/en/12", "http://xexample.org/es/", "https://com?fr/", "http://x.com/de/#f", "a://b://c.org/p", "http://example.org./es/"]
    pages = spark.createDataFrame([(i, u, None, "r") for i, u in enumerate([*urls, urls[6]])], "page_id bigint, url string, html string, rule string")
    rows = {r.page_id: r for r in urlrules.judge(pages, urlrules.QUERY_RULES).collect()}
    assert len(rows) == len(urls) + 1
    assert [rows[i].host for i in range(6)] == ["", "", "", "", "org", "org"]
    assert [rows[i].rule for i in range(len(urls) + 1)] == [None, None, None, None, None, "org/", "example.org/es/", "example.org/en/1", "org/", None, "com/de/", None, None, "example.org/es/"]
    assert (rows[6].verdict, rows[0].verdict, rows[9].path) == ("block", "allow", "")
    frame = spark.createDataFrame(urlrules.QUERY_RULES, "verdict string, text string")
    assert sorted(map(tuple, urlrules.judge(pages, frame, per_pass=2).collect()), key=repr) == sorted(map(tuple, urlrules.judge(pages, urlrules.QUERY_RULES).collect()), key=repr)
    assert urlrules.judge(pages.limit(0), urlrules.QUERY_RULES).count() == 0


def test_vectors(spark):
    rows = [(0, [1.0, 0.0], "c"), (0, [1.0, 0.0], "c"), (50, [0.5], "c"), (1, None, "c"), (2, [float("nan"), 1.0], None), (3, [None, 1.0], "c"), (4, [float("inf"), 0.0], "c"), (5, [-1.0, 2.0], "c"), (None, [1.0, 1.0], "c"), (6, [-1.0, 2.0], "c"), (7, [], "c")]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score string")
    v = topk.integers(table)
    found = sorted(tuple(r) for r in topk.top_k(v, F.col("vec_id") % 50 == 0, 5).collect())
    # Ids 0 (twice), 50, 5, 6, 7 take part; missing components are 0.
    assert found == [(0, 1, 50, 256 * 128), (0, 2, 7, 0), (0, 3, 5, -(256**2)), (0, 4, 6, -(256**2)), (50, 1, 0, 256 * 128), (50, 2, 7, 0), (50, 3, 5, -256 * 128), (50, 4, 6, -256 * 128)]
    assert topk.top_k(v.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_fixity(spark):
    schema = "page_id bigint, url string, html string, node int, hash string"
    pages = spark.createDataFrame([(i, None if i == 3 else f"u{i}", "h" * i, 1, "x") for i in range(20)] + [(None, "a", "b", 1, None), (None, None, None, 1, None), (5, "u5", "other", 1, "x")], schema)
    assert {r.status for r in fixity.fixity(pages, pages.repartition(5)).collect()} == {"intact"}
    assert {r.status for r in fixity.fixity(pages.limit(0), pages).collect()} == {"extra"}
    assert {r.status for r in fixity.fixity(pages, pages.limit(0)).collect()} == {"missing"}
    assert fixity.fixity(pages.limit(0), pages.limit(0)).count() == 0
    changed = pages.withColumn("html", F.when(F.col("page_id") == 7, "!").otherwise(F.col("html"))).where("page_id IS NULL OR page_id <> 9")
    assert {r.record_key: r.status for r in fixity.fixity(pages, changed).where("status <> 'intact'").collect()} == {7: "damaged", 9: "missing"}


@pytest.mark.parametrize("at", range(5))
def test_stages_of_the_pipeline(spark, odd, none, at, tmp_path):
    """Each stage over the odd table and over none: whole rows of the documents' columns come out."""
    import corpus_pipeline

    labels = spark.createDataFrame([(1, 0), (5, 1)], "doc_id bigint, quality int, toxic int".replace("quality int, ", ""))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    name, stage = corpus_pipeline.STAGES[at]
    out = stage(spark, odd, str(tmp_path))
    rows = out.collect()
    assert stage(spark, none, str(tmp_path)).count() == 0
    if name == "packing":
        assert {r.doc_id for r in rows} == {i for i, _ in ODD}
        return
    assert out.columns == corpus_pipeline.COLUMNS
    ids = sorted((r.doc_id or -1) for r in rows)
    if name == "toxicity":
        assert ids[0] == -1 and {1, 2, 3} <= set(ids)  # no word, not toxic
    elif name == "near_duplicates":
        assert ids == [1, 4, 5, 7, 7, 8]
    else:
        assert len(rows) == len(ODD) and {r.text for r in rows if r.doc_id == 1} == {""}
        assert all(r.n_chars == len(r.text) for r in rows)
