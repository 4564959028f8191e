"""Operators that work on each text alone, against plain versions and the libraries."""

import hashlib
import html
import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from auditlens.llm import decontam, html_blocks, pieces, pii, queries

EDGES = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "one word"),
    (5, "ünï " * 3000),
    (5, "ünï " * 3000),
    (None, "no id here 1.2.3.4"),
    (7, "a" * 200_000),
]


# --- SentencePiece


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(
        model_file=public_tokenizers.path(queries.VOCABULARY)
    )


@pytest.fixture(scope="module")
def chunk_table():
    return pieces.ChunkTable(queries.vocabulary(), most=50)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab ▁\n.é<s>/x0A中🙂\t "), max_size=40))
def test_pieces_equal_the_library(library, chunk_table, text):
    ids = library.encode(text, add_bos=True, add_eos=True)
    packed = chunk_table.encode(text)
    assert np.frombuffer(packed, "<u4").tolist() == ids
    assert chunk_table.decode(packed) == library.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 31_999), max_size=12))
def test_any_ids_decode_as_in_the_library(library, chunk_table, ids):
    assert chunk_table.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids)


def test_pieces_of_edge_rows(make_docs, library):
    rows = queries.pieces.piece_digests(make_docs(EDGES), queries.vocabulary()).collect()
    expected = []
    for doc_id, text in EDGES:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        raw = np.array(ids, "<u4").tobytes()
        decoded = library.decode(ids).encode()
        sha = lambda x: hashlib.sha256(x).hexdigest()
        expected.append((doc_id, len(ids), sha(raw), sha(decoded)))
    key = lambda r: (r[0] or 0, r[1])
    assert sorted(map(tuple, rows), key=key) == sorted(expected, key=key)
    empty = pieces.piece_digests(make_docs([]), queries.vocabulary())
    assert empty.count() == 0 and len(empty.columns) == 4


# --- Benchmark decontamination


def _brute_leaks(text, items):
    words = lambda t: decontam.WORD.findall((t or "").translate(decontam.TO_LOWER))
    doc, hit, found = words(text), set(), set()
    for item, content in items:
        own = words(content)
        size = min(10, len(own))
        if not size:
            continue
        for i in range(len(own) - size + 1):
            for j in range(len(doc) - size + 1):
                if doc[j : j + size] == own[i : i + size]:
                    hit |= set(range(j, j + size))
                    if item is not None:
                        found.add(str(item))
    return len(doc), len(hit), len(found), ",".join(sorted(found))


@pytest.mark.parametrize("block", [decontam.BLOCK, 7])
def test_leaks_equal_brute_force(spark, make_docs, block):
    draw = random.Random(3)
    word = lambda: draw.choice(["A", "b", "Ä", "ä", "7"])
    items = [(n, " ".join(word() for _ in range(draw.randint(0, 14)))) for n in range(25)]
    items += [(25, None), (25, "!!"), (26, "solo"), (None, "b b"), (2, items[2][1])]
    texts = [" ".join(word() for _ in range(draw.randint(0, 60))) for _ in range(40)]
    texts += [texts[0], None, "", "--", "x Solo. y", "b-" * 50, items[3][1].upper()]
    docs = make_docs(list(enumerate(texts)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.contamination(docs, benchmark, block=block).select("doc_id", "leaks.*").collect()
    assert len(rows) == len(texts)
    for row in rows:
        n_words, n_hit, n_items, joined = _brute_leaks(texts[row.doc_id], items)
        assert (row.n_words, len(row.hits)) == (n_words, n_hit)
        assert (len(row["items"]), ",".join(row["items"])) == (n_items, joined)


def test_leaks_of_items_without_an_id(spark, make_docs, tmp_path):
    """Hit, and nothing named; the SQL says the same."""
    passage = "one two three four five six seven eight nine ten"
    docs = make_docs([(1, f"x {passage} y"), (2, "none of it")], clash=False)
    benchmark = spark.createDataFrame([(None, passage), (5, "other")], "item_id long, text string")
    found = decontam.leak_report(docs, benchmark)
    row = found.filter("doc_id = 1").first()
    assert (row.n_hit, row.n_items, row.contaminated) == (10, 0, True)
    import duckdb

    with duckdb.connect() as db:
        for name, frame in (("documents", docs), ("benchmark", benchmark)):
            frame.write.parquet(str(tmp_path / name))
            db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
        result = db.sql(decontam.ORACLE)
        assert sorted(result.fetchall()) == sorted(
            map(tuple, found.select(*result.columns).collect())
        )


def test_leaks_of_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    one = decontam.leak_report(make_docs([(1, "some words"), (2, None)]), none).collect()
    assert {(r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in one} == {
        (1, 2, 0, False),
        (2, 0, 0, False),
    }
    some = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert decontam.leak_report(make_docs([]), some).count() == 0


# --- Personal data


def _brute_base(text):
    """The contract's patterns, as they stand."""
    out = []
    patterns = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    )
    for kind, pattern in patterns:
        for match in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", match.group())
            doubled = [int(d) * (1 + n % 2) for n, d in enumerate(digits[::-1])]
            fine = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in match.group().split(".")),
                "card": 13 <= len(digits) <= 19 and not sum(d - 9 * (d > 9) for d in doubled) % 10,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fine:
                out.append((kind, *match.span()))
    return out


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="a1.@+- ()2b%9\n0é４", max_size=60))
def test_base_spans_equal_the_patterns(text):
    base, every = pii.find_spans(text)
    assert base == _brute_base(text)
    assert set(base) <= set(every)


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("mail john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
        ("john at example dot com.", "email", "john at example dot com"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("é ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("al​ice@exam​ple.com", "email", "al​ice@exam​ple.com"),
        ("a plus one six seven two five five five zero one nine six", "phone",
         "plus one six seven two five five five zero one nine six"),
        ("ip one nine two dot one six eight dot one dot one", "ip",
         "one nine two dot one six eight dot one dot one"),
        ("at 192[.]168[.]1[.]7 there", "ip", "192[.]168[.]1[.]7"),
        ("four one one one, one one one one, one one one one, one one one one", "card",
         "four one one one, one one one one, one one one one, one one one one"),
    ],
)
def test_disguises_are_mapped_back(text, kind, span):
    base, every = pii.find_spans(text)
    assert not base
    assert [(k, text[a:b]) for k, a, b in every] == [(kind, span)]


GATED = [
    ("call plus 44 20 7946 0958 now", "phone", "plus 44 20 7946 0958"),
    ("call plus one 202 555 0143 now", "phone", "plus one 202 555 0143"),
    ("call Plus 44 twenty or plus-4 four 20 7946 0958 now", "phone", "plus-4 four 20 7946 0958"),
    ("ip 10 point 0 point 0 point 1 now", "ip", "10 point 0 point 0 point 1"),
    ("mail jane at example.com now", "email", "jane at example.com"),
    ("mail jane@example·com now", "email", "jane@example·com"),
    ("mail jane at example·com now", "email", "jane at example·com"),
]
UNRELATED = ["", " one two", " (so) [it] {is} <b>", " a dot", " four.five", " ж é ·", " plus 1 2"]


@pytest.mark.parametrize("more", UNRELATED)
@pytest.mark.parametrize(("text", "kind", "span"), GATED)
def test_other_passages_decide_nothing(text, kind, span, more):
    whole = f"{text}, we say.{more}"
    base, every = pii.find_spans(whole)
    assert not base
    assert [(k, whole[a:b]) for k, a, b in every] == [(kind, span)]


@settings(max_examples=1000, deadline=None)
@given(st.lists(st.sampled_from(
    "plus one Two 4 20 dot point at jo mail com [dot] (.) [at] @ . - , · ſix fıve".split() + [" "] * 9
), max_size=14))
def test_hints_lose_no_match(parts):
    text = "".join(parts)
    for hint, pattern, edits in (
        (pii.SPELLED_HINT, pii.SPELLED, pii._number),
        (pii.DISGUISED_HINT, pii.DISGUISED, pii._address),
    ):
        assert hint.search(text) or not any(edits(m) for m in pattern.finditer(text))


@pytest.mark.parametrize(
    "ending", "dev fi no ie nz kr gr za tr me tv app xyz cloud invalid com xn--p1ai".split()
)
@pytest.mark.parametrize("name", ["jane at mail dot {}", "Jane At a dot mail dot {}", "jane at mail.{}"])
def test_addresses_in_bare_words_end_in_any_top_level_name(name, ending):
    text = name.format(ending)
    assert pii.find_spans(f"to {text}, please") == ([], [("email", 3, 3 + len(text))])


@pytest.mark.parametrize(
    "text",
    ["look at the dot now", "she stared at a dot in here", "sits at every dot is fine",
     "we met at noon dot then", "jane at mail dot nosuchending"],
)
def test_dots_in_prose_are_no_addresses(text):
    assert pii.find_spans(text) == ([], [])


@pytest.mark.parametrize("text", ["sold at 3.5 (or so)", "it was at noon.Then (b) we left", "at 5.30pm (x)"])
def test_prose_with_a_bare_at_is_no_address(text):
    assert pii.find_spans(text) == ([], [])


@pytest.mark.parametrize(
    "text", ["on that at the dot of", "one two", "see dot one", "a (b) at c.d", "ærøskøbing"]
)
def test_plain_prose_has_no_disguises(text):
    assert pii.find_spans(text) == ([], [])


def test_long_texts_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "a@" * 150_000, "+1" + "(" * 300_000):
        pii.find_spans(text)
    for words in ("onedot ", "1dot ", "one ", "plus one ", "one dot ", "a dot ", "x at y dot ", "a."):
        started = time.process_time()
        pii.find_spans(words * (1_000_000 // len(words)))
        assert time.process_time() - started < 8, words


def test_runs_of_digits_end_at_a_word_border():
    """A run goes as far as its last digit that no letter follows, wherever it is cut."""
    for text, undone in (
        ("one two dotone threety", "12 dotone threety"),
        ("one dot two dot threedot four", "1.2.3.4"),
        ("onedot twodot threety", None),
        ("onedot twodot three", "1.2.3"),
        ("plus four four onedot", "+44 onedot"),
        ("one twoty", None),
    ):
        tape = pii.deobfuscated(text)
        assert (tape and tape.text) == undone, text


def test_redaction(make_docs):
    texts = EDGES + [(8, "a@b.c 1.2.3.4 +1 (555) 123-4567, +4111 1111 1111 1111 z")]
    redacted = pii.redact(make_docs(texts)).select("doc_id", "text", "source").collect()
    by_text = {(r.doc_id, r.text) for r in redacted}
    assert len(redacted) == len(texts)
    assert (8, "[email] [ip] [phone], [phone]1 z") in by_text or any(
        r.doc_id == 8 and r.text.startswith("[email] [ip] [phone], ") for r in redacted
    )
    assert (None, "no id here [ip]") in by_text
    assert {(1, None), (2, ""), (4, "one word")} <= by_text
    report = pii.pii_digests(make_docs(texts)).filter("doc_id = 8").first()
    assert (report.n_email, report.n_ip) == (1, 1)
    assert report.spans.startswith("email:0:5,ip:6:13,card:")
    joined = ",".join(":".join(map(str, s)) for s in _brute_base(texts[-1][1]))
    assert report.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
    assert pii.pii_digests(make_docs([])).count() == 0


# --- Main text of pages

PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1></header>
<div id="menu"><a href=x>Home</a></div>
<div class="cookie-notice">We use cookies, which takes a long sentence to tell you all about.</div>
<div id="content"><h1>Title &amp; more</h1><p>A &quot;long&quot;   paragraph with <b>bold</b>ness
and &lt;signs&gt; that is long enough to be a surge of its own.<p>Short.</p>
<script>var t="</p>";</script><table><tr><td>cell 1<td>cell 2</table></div>
<div class=sidebar><p>Other things that you may like to read, which are told at some length.</p></div>
<section id="comments"><p>First comment, which is rather long, and longer, and longer still, to be
sure.</p></section><form>Search <input></form><footer>foot</footer></body></html>"""
MAIN = (
    'Title & more A "long" paragraph with boldness and <signs> that is long enough to be a surge '
    "of its own. Short. cell 1 cell 2"
)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (PAGE, MAIN),
        ("<nav>m</nav><article><h1>T</h1><p>One.<div class=ad>buy</div><p>Two<br>three"
         "<aside>x</aside><p>Five <form>a</form>six</article><p>out", "T One. Two three Five six"),
        ("<article><p>a</p><section class=comments><article><p>no</article></section></article>", "a"),
        ("plain text, no markup", "plain text, no markup"),
        ("<p>a < b and c > d &am &amp</p>", "a < b and c > d &am &"),
        ("", ""),
        ("<div class='ad'>only</div>", ""),
        ("<div class='ad'>unclosed <article><p>a</p></article>", "a"),
        ("<section class=comments><article class=comment>c</article></section><main>m</main>", "m"),
        ("<p title='hidden nav'>a <span class='hidden-xs'>b</span></p><p hidden>c</p>", "a b"),
        ("<div class='content-sidebar-wrap'><p>a</p><ol class=commentlist><li>c</ol></div>", "a"),
        ("<div class=page-header>h</div><article><header><h1>t</h1></header>x</article>", "t x"),
        ("<article><p>cut in a <b", "cut in a"),
    ],
)
def test_main_text(page, text):
    assert " ".join(html_blocks.kept_blocks(html_blocks.lines_of(page))) == text


BODY = "A paragraph of the body, in a plain element, as long as the ones in an article would be. "


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # Teasers in article elements beside a text that stands in divs.
        (f"<div id=c><h1>T</h1><p>{BODY}<p>{BODY}</div><div><article>Read on</article></div>",
         f"T {BODY}{BODY}".strip()),
        (f"<article class=teaser>Next</article><div><p>{BODY}</div><article>Last</article>",
         BODY.strip()),
        # A short article keeps its page against less text elsewhere.
        (f"<article><p>A short article, of some words.</article><p>{BODY}",
         "A short article, of some words."),
        # Short runs beside a surge of their container, and of others.
        (f"<div id=c><p>{BODY}<aside>x</aside><p>End.</div><div>Imprint</div>", f"{BODY}End."),
        (f"<div id=c><p>Start.<form>f</form><p>On.<form>f</form><p>{BODY}</div><form>f</form><p>No",
         f"Start. On. {BODY}".strip()),
    ],
)
def test_lengths_decide_where_the_text_stands(page, text):
    assert " ".join(html_blocks.kept_blocks(html_blocks.lines_of(page))) == text


def test_odd_markup_takes_linear_time():
    for page in ("<b>" * 50_000, "</div>" * 50_000, '<a "' * 50_000, "<" * 200_000, "<!--" * 50_000):
        html_blocks.lines_of(page)
    for page in (
        "<i><main>" + "<b>" * 50_000 + "</i>" * 50_000,
        "<b>" * 50_000 + "<nav>" + "<article></article>x" * 50_000,
        "<article>" + "<p>x</p>" * 50_000 + "</article><div class=ad>" + "<article>x" * 50_000,
    ):
        started = time.process_time()
        html_blocks.lines_of(page)
        assert time.process_time() - started < 8


def test_pages_of_the_tables(spark, sf_dir):
    """The generated pages have one article each, so its markup gives the expected text."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = {r.page_id: (r.text, r.n_chars) for r in html_blocks.page_texts(pages).collect()}
    for page in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", page.html, re.DOTALL)[1]
        plain = re.sub(r"<(?!/?b>)[^>]*>", " ", inner).replace("<b>", "").replace("</b>", "")
        text = " ".join(html.unescape(plain).split())
        assert found[page.page_id] == (text, len(text))


def test_edge_pages(spark):
    schema = "page_id long, url string, html string, text string, article string"
    rows = [(1, "u", None, "t", "a"), (None, None, "<p>x</p>", "t", "a"), (1, "u", None, "t", "a")]
    found = html_blocks.page_texts(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in found) == [
        (0, "x", 1), (1, "", 0), (1, "", 0)
    ]
    assert html_blocks.page_texts(spark.createDataFrame([], schema)).count() == 0
