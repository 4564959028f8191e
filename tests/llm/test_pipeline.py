"""The corpus pipeline stage by stage, on planted documents and on the tables."""

import numpy as np
import public_tokenizers
import sentencepiece

import corpus_pipeline
from auditlens.llm import pii, queries


def _write(spark, path, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    full = [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows]
    spark.createDataFrame(full, schema).write.parquet(f"{path}/documents.parquet")


def test_planted_documents(spark, tmp_path):
    leak = " ".join(f"bench{n}" for n in range(12))
    base = " ".join(f"word{n}" for n in range(120))
    rows = [(n, f"the cat {n} and the bird of {n * 7} was {n * 3} here", "en") for n in range(40, 60)]
    rows += [(60, base, "en"), (61, base, "en"), (62, base + " ", "en"), (63, base, None)]
    rows += [(70, "a tale of " + leak.upper() + " told", "en"), (71, leak[:-8] + " else", "en")]
    rows += [(80, None, None), (81, "", "en"), (82, "12 34 !!", None), (83, "12 34 !!", None)]
    rows += [(90, "write to jo@mail.example.com about the cat and 10.0.0.1 please", "en")]
    rows += [(90, "write to jo@mail.example.com about the cat and 10.0.0.1 please", "en")]
    _write(spark, tmp_path, rows)
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = queries.written("t")(stage(spark, docs, str(tmp_path)))
        if number < 4:
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        seen.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
    clean = list(range(40, 60))
    assert seen[0] == sorted([*clean, 60, 61, 62, 63, 70, 71, 90, 90])
    assert set(clean) <= set(seen[1]) | {0} and 60 in seen[1] and seen[1].count(90) == 1
    assert not {61, 62, 63} & set(seen[1])
    assert 70 not in seen[2] and set(seen[1]) - set(seen[2]) <= {70, 71}
    last = {r.doc_id: r for r in docs.collect()}
    assert last[90].n_chars == len("write to [email] about the cat and [ip] please")
    library = sentencepiece.SentencePieceProcessor(
        model_file=public_tokenizers.path(queries.VOCABULARY)
    )
    ids = np.frombuffer(last[90].ids, "<u4").tolist()
    assert library.decode(ids) == "write to [email] about the cat and [ip] please"
    assert all(r.round_trip and r.n_tokens == len(r.ids) // 4 for r in last.values())


def test_near_duplicates_without_an_id_or_under_one_id(spark, make_docs):
    """One row of each group stays, whether or not its rows have ids, or share one."""
    text = lambda name: " ".join(f"{name}{n}" for n in range(120))
    rows = [(None, text("lone")), (None, text("twice")), (None, text("twice"))]
    rows += [(None, text("known")), (5, text("known")), (None, text("known") + " ")]
    rows += [(7, text("x")), (7, text("y")), (8, text("x")), (9, text("y")), (7, text("x"))]
    rows += [(None, text("near")), (None, text("near") + " "), (1, text("copy")), (10, text("copy"))]
    rows += [(1, text("alone"))]
    kept = corpus_pipeline.near_duplicates(spark, make_docs(rows), "").collect()
    found = [(r.doc_id, r.text.split()[0]) for r in kept]
    assert sorted(found, key=str) == sorted(
        [(None, "lone0"), (None, "twice0"), (5, "known0"), (7, "x0"), (7, "y0"), (None, "near0"),
         (1, "copy0"), (1, "alone0")],
        key=str,
    )
    assert tuple(kept[0].asDict()) == corpus_pipeline.COLUMNS


def test_run_on_the_tables(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = out.collect()
    assert 0 < len(rows) <= len(docs)
    for row in rows:
        spans = pii.find_spans(docs[row.doc_id])[1]
        assert spans or row.n_chars == len(docs[row.doc_id])


def test_empty_documents(spark, tmp_path):
    _write(spark, tmp_path, [])
    spark.createDataFrame([], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
