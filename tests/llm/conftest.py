import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that an input may have besides, named like what the operators make.
CLASH = (
    "n_words int, id string, key string, v string, shard string, component string, n string, "
    "size string, kept string, pieces string, leaks string, pii string, found string, "
    "features string, simhash string, article string, k1 string, score string, words string"
)


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents frame of (doc_id, text) or (doc_id, text, lang) rows, with clashing columns."""

    def make(rows, clash=True):
        full = [
            (r[0], r[1], r[2] if len(r) > 2 else "en", "src", None if r[1] is None else len(r[1]))
            for r in rows
        ]
        if not clash:
            return spark.createDataFrame(full, DOCS)
        more = len(CLASH.split(", "))
        return spark.createDataFrame(
            [(*r, 7, *["x"] * (more - 1)) for r in full], f"{DOCS}, {CLASH}"
        )

    return make


@pytest.fixture(scope="session")
def written(tmp_path_factory, spark):
    from auditlens.llm.queries import written

    return written("test")
