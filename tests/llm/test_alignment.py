"""Alignment of two tokenizers against a plain version over whole texts."""

import hashlib
import random
from collections import Counter
from functools import reduce

import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from auditlens.llm import alignment as A

BOTH = A.Vocabularies.read(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a\n b", "a \n b", "a\n  b", "a \nb\n\n c",
    "\t x\t y", "a▁b c", "▁", "x ▁ y", "café naïve 你好 世界",
    "<|endoftext|> <s> </s> <unk> <0x0A>", "don't we'll  I'm 's 12 345 $%^", "a b   c　d",
    "\x00 \x1c \x1d x", "\U0001f600 \U0001f468‍\U0001f469 é ", "﻿x ﻿ y​ z",
    "\r\n a\r\n  b\x85c \x85 d", "word" * 300, "x" * 200 + " " + "y" * 200, "�  ͸",
]


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_str(BOTH.a)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_proto=BOTH.b)
    a_bytes, b_bytes = A.bytes_of_a(BOTH.a), A.bytes_of_b(b)

    def groups(text):
        """Groups of (a ids, b ids) of a whole text by the sets of ends; None without tokens."""
        if not text:
            return None
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        raw = (" " + text).encode()
        if b"".join(a_bytes[i] for i in x) != raw or b"".join(b_bytes[i] for i in y) != raw:
            return None

        def ends(ids, table):
            at, out = 0, []
            for i in ids:
                at += len(table[i])
                out.append(at)
            return out

        ex, ey = ends(x, a_bytes), ends(y, b_bytes)
        last, out = 0, []
        for end in sorted(set(ex) & set(ey)):
            out.append(
                (
                    [i for i, e in zip(x, ex, strict=True) if last < e <= end],
                    [i for i, e in zip(y, ey, strict=True) if last < e <= end],
                )
            )
            last = end
        return out

    return groups


def expected(rows, groups):
    found = [(doc_id, groups(text)) for doc_id, text in rows]
    count = Counter((g[0][-1], g[1][-1]) for _, gs in found for g in gs or ())
    highest = Counter()
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    out = []
    for doc_id, gs in found:
        pairs = [(g[0][-1], g[1][-1]) for g in gs or ()]
        joined = ";".join(A.group_text(*g) for g in gs or ())
        out.append(
            {
                "doc_id": doc_id,
                "n_a": sum(len(g[0]) for g in gs or ()),
                "n_b": sum(len(g[1]) for g in gs or ()),
                "n_groups": len(pairs),
                "n_links": len(pairs),
                "n_best": sum(count[p] == highest[p[1]] for p in pairs),
                "count_sum": sum(count[p] for p in pairs),
                "groups_sha256": hashlib.sha256(joined.encode()).hexdigest() if joined else "",
            }
        )
    return sorted(out, key=str)


def report(frame):
    return sorted((r.asDict() for r in frame.collect()), key=str)


def same(found, want):
    key = lambda r: (str(r["doc_id"]), str(sorted(r.items())))
    assert sorted(found, key=key) == sorted(want, key=key)


def random_text(draw, words=30):
    parts = ["a", "the", "Wort", "été", "x1", "12", "你", "...", "'s", "\n", "\t", "", "",
             " ", " z", "\U0001f600", "-", "of", "​", "\r"]
    return "".join(
        draw.choice(parts) + draw.choice(["", " ", " ", "  ", "\n"]) for _ in range(words)
    )


def test_ranges_are_independent(plain):
    """Ranges of a few characters, composed, give the groups of whole texts."""
    draw, both = random.Random(3), A.Aligner(BOTH)
    assert both.independent
    texts = [*ODD, *(random_text(draw) for _ in range(3000))]
    found = A.text_fragments(both, texts, digest=False)
    for text, row in zip(texts, found, strict=True):
        want = ";".join(A.group_text(*g) for g in plain(text) or ())
        assert row["closed"] == want, repr(text)
        if text:
            parts = A.ranges(text, draw.randrange(1, 40))
            assert " ".join(parts) == text
            rows = [A.range_fragment(both, p) for p in parts]
            if all(r["ok"] for r in rows):
                made = (A._as_fragment(r, len(both.b_bytes)) for r in rows)
                assert A.whole(reduce(A.composed, made, A.NOTHING)).closed == want, repr(text)
            else:
                assert want == ""


@st.composite
def tokens(draw):
    length = draw(st.integers(1, 30))
    ends = [
        sorted(draw(st.sets(st.integers(1, length), max_size=length)) | {length}) for _ in range(2)
    ]
    return length, ends


@given(tokens(), st.lists(st.integers(0, 30), max_size=5))
@settings(max_examples=300, deadline=None)
def test_any_ranges_in_any_order_of_composition(made, cuts):
    """Ranges cut anywhere, inside tokens too, compose to the groups of the whole."""
    length, (a_ends, b_ends) = made
    a, b = list(range(100, 100 + len(a_ends))), list(range(200, 200 + len(b_ends)))
    borders = [0, *sorted(c for c in cuts if 0 < c < length), length]

    def part(low, high):
        pick = lambda ids, ends: [
            (i, e) for i, e in zip(ids, ends, strict=True) if low < e <= high
        ]
        x, y = pick(a, a_ends), pick(b, b_ends)
        return A.fragment([i for i, _ in x], [e for _, e in x], [i for i, _ in y], [e for _, e in y])

    parts = [part(*z) for z in zip(borders, borders[1:], strict=False)]
    left = reduce(A.composed, parts, A.NOTHING)
    right = reduce(lambda acc, f: A.composed(f, acc), reversed(parts), A.NOTHING)
    one = A.fragment(a, a_ends, b, b_ends)
    assert left == right == one
    assert A.whole(one).suffix == ([], [])


@pytest.mark.parametrize("size", [A.RANGE, 20])
def test_equals_plain_version(spark, written, make_docs, plain, size):
    draw = random.Random(8)
    texts = [*ODD, *(random_text(draw, draw.randrange(200)) for _ in range(60)), "the of", "the of"]
    rows = [*enumerate(texts), (None, "no id"), (3, "id again"), (9, "word " * 2000)]
    found = report(A.alignment_report(make_docs(rows), BOTH, written, size))
    same(found, expected(rows, plain))


def test_empty_table(spark, written, make_docs):
    assert A.alignment_report(make_docs([]), BOTH, written).count() == 0


def test_whole_table(spark, sf_dir, plain):
    from auditlens.llm.queries import op13_alignment

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    same(report(op13_alignment(spark, sf_dir)), expected(map(tuple, rows), plain))


def test_groups_are_the_operators_result(spark, written, make_docs, plain):
    docs = make_docs([(1, "Hello world, café " * 40)])
    (row,) = A.align(docs, BOTH, written, size=50).collect()
    assert row.closed == ";".join(A.group_text(*g) for g in plain("Hello world, café " * 40))


def test_pairs_are_bounded_by_the_vocabularies():
    assert A.most_pairs(BOTH) < 600_000
