"""Language identification and the quality classifier, by held-out accuracy."""

import zlib

import numpy as np
import pytest

from auditlens.llm import language, quality, queries


@pytest.fixture(scope="module")
def sf_mid(sf_dir):
    return sf_dir.replace("sf0.001", "sf0.01")


def test_held_out_rows(spark, make_docs):
    from auditlens.llm.common import held_out

    rows = make_docs([(n, "x") for n in range(200)] + [(None, "x")]).select(
        "doc_id", held_out("doc_id").alias("h")
    )
    for row in rows.collect():
        expected = row.doc_id is not None and zlib.crc32(str(row.doc_id).encode()) % 3 == 1
        assert row.h == expected


def test_language_accuracy(spark, sf_mid):
    found = queries.op9_language(spark, sf_mid)
    docs = spark.read.parquet(f"{sf_mid}/documents.parquet").select("doc_id", "lang")
    rows = found.join(docs, "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_equals_single_texts(spark):
    """Bundles of a batch are what each text gives alone."""
    texts = ["Der Hund und die Katze", "le chat et le chien, où ?", "", "12 - 3", "İi ẞ", "a"]
    counts, vectors = language.triples(texts)
    for n, text in enumerate(texts):
        alone_counts, alone_vectors = language.triples([text])
        np.testing.assert_allclose(counts[n] @ vectors, (alone_counts @ alone_vectors)[0])


def test_long_texts_are_cut_without_a_change(monkeypatch):
    text = "Ein längerer Text, mit – Lücken und 12 Zahlen; " * 40 + "x" * 300
    counts, vectors = language.triples([text])
    monkeypatch.setattr(language, "BATCH", 97)
    parts = list(language.bundles(["kurz", text, "", "ende"]))
    whole = sum(v[o == 1].sum(axis=0) for o, _, v in parts)
    np.testing.assert_allclose(whole, (counts @ vectors)[0])
    assert sorted({int(n) for o, _, _ in parts for n in o}) == [0, 1, 2, 3]


def test_language_vectors_bind_permuted_letters():
    one, two, three = language._letters()
    counts, vectors = language.triples(["abc"])
    expected = (
        one[0] * two[1] * three[2] + one[1] * two[2] * three[3] + one[2] * two[3] * three[0]
    )
    np.testing.assert_allclose((counts @ vectors)[0], expected)


def test_language_edges(make_docs):
    rows = [(n, "the cat and the dog and the bird", "en") for n in range(8)]
    rows += [(n, "der hund und die katze und der vogel", "de") for n in range(8, 16)]
    rows += [(20, None, None), (21, "", "en"), (22, "123 !?", None), (None, "the dog", None)]
    rows += [(23, "der vogel und der hund " * 20_000, None)] * 2
    found = language.language_report(make_docs(rows)).collect()
    assert len(found) == len(rows)
    got = {r.doc_id: (r.lang_pred, r.score) for r in found}
    assert got[20] == got[21] == got[22] == ("und", 0.0)
    assert got[23][0] == "de" and got[None][0] == "en"
    unknown = language.language_report(make_docs([(1, "text", None), (2, None, None)])).collect()
    assert {(r.lang_pred, r.score) for r in unknown} == {("und", 0.0)}
    assert language.language_report(make_docs([])).count() == 0


def test_quality_accuracy(spark, sf_mid):
    found = queries.op8_quality(spark, sf_mid)
    labels = spark.read.parquet(f"{sf_mid}/labels.parquet")
    rows = found.join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_quality_scores_are_table_sums():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(600, 4))
    y = ((x[:, 0] * x[:, 1] > 0) | (x[:, 2] > 1)).astype(float)
    model = quality.fit(x, y)
    assert np.mean((model.scores(x) >= 0.5) == y) > 0.95
    assert (0, 1) in model.pairs
    row, total = x[:1], model.intercept
    for j in range(4):
        total += model.tables[j][np.searchsorted(model.edges[j], row[0, j], "right")]
    for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
        at = [np.searchsorted(model.coarse[k], row[0, k], "right") for k in (i, j)]
        total += table[at[0], at[1]]
    assert model.scores(row)[0] == pytest.approx(1 / (1 + np.exp(-total)))


def test_quality_edges(spark, make_docs, written):
    schema = "doc_id long, quality int, toxic int"
    docs = make_docs([(1, None), (2, ""), (2, ""), (3, "x" * 100_000), (None, "some words")])
    for labels in ([], [(1, 1, 0)], [(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0), (3, 5, 0)]):
        report = quality.quality_report(docs, spark.createDataFrame(labels, schema), written)
        rows = report.collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    none = quality.quality_report(make_docs([]), spark.createDataFrame([], schema), written)
    assert none.count() == 0


def test_fit_rows_are_bounded(spark, make_docs):
    rows = quality.measured(make_docs([(n, f"w{n} " * (n % 7)) for n in range(60)]))
    labelled = rows.selectExpr("*", "cast(doc_id % 2 as int) as y")
    assert quality.train(labelled, "y", "doc_id", most=5).scores(np.zeros((1, 21)))[0] <= 1


def test_a_repeated_id_neither_hides_nor_floods_the_sample(spark):
    """3,000 rows of one id and 100 others, of which 50 are to be learned from."""
    from auditlens.llm import quality

    size = len(quality.FEATURES)
    rows = [(7, ([float(i % 1500)] * size,), i % 2) for i in range(3000)]
    rows += [(i, ([float(i)] * size,), 1) for i in range(100, 200)]
    frame = spark.createDataFrame(rows, "id long, features struct<x: array<double>>, y int")
    seen = []
    original = quality.fit
    quality.fit = lambda x, y: seen.append(len(x)) or original(x, y)
    try:
        quality.train(frame, "y", "id", most=50)
        same = frame.withColumn("features", frame["features"].withField("x", frame["features.x"]))
        quality.train(same.filter("id = 7 AND features.x[0] = 3.0"), "y", "id", most=50)
    finally:
        quality.fit = original
    assert 20 <= seen[0] <= 60 and seen[1] == 2


def test_many_short_texts_take_little_memory():
    import tracemalloc

    rng = np.random.default_rng(2)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzäöüßéèñçøåæœ"))
    texts = ["".join(rng.choice(letters, 40)) for _ in range(10_000)]
    list(language.bundles(texts[:1]))  # tables that are made once
    tracemalloc.start()
    seen = 0
    for owners, counts, vectors in language.bundles(texts):
        assert len(owners) == len(counts) == len(vectors) <= language.MOST_TEXTS
        seen += len(owners)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == 10_000 and peak < 150 * 2**20
    whole, parts = language.triples(texts[:300]), [*language.bundles(texts[:300])]
    assert (np.concatenate([p[2] for p in parts]) == whole[0] @ whole[1]).all()
