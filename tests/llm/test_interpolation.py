"""Deleted interpolation against a plain version that counts words in dictionaries."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from auditlens.llm import interpolation as I
from auditlens.llm.queries import op12_interpolation


def crc(doc_id, salt=""):
    return None if doc_id is None else zlib.crc32(f"{doc_id}{salt}".encode())


def tokens_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), ("end",)]


def plain(rows, order, deleted):
    """(report rows, weights) by dictionaries of tuples."""
    docs = []
    for doc_id, text in rows:
        value = crc(doc_id)
        held = value is not None and value % 7 == 2
        gone = doc_id is not None and not held and crc(doc_id, " deleted") % deleted == 0
        docs.append((doc_id, tokens_of(text), held, gone))

    def counted(which):
        seen = [Counter() for _ in range(order + 1)]
        for _, words, held, gone in docs:
            if which(held, gone):
                padded = [("start",), *words]
                for i in range(1, len(padded)):
                    for k in range(1, order + 1):
                        gram = tuple(padded[max(0, i - k + 1) : i + 1])
                        seen[k][gram] += 1
                        seen[0][k, gram[:-1]] += 1
        return seen

    def pairs(seen, words):
        """Counts and context counts of every order at every token."""
        padded = [("start",), *words]
        for i in range(1, len(padded)):
            grams = [tuple(padded[max(0, i - k + 1) : i + 1]) for k in range(1, order + 1)]
            yield [(seen[k][g], seen[0][k, g[:-1]]) for k, g in enumerate(grams, 1)]

    everything = counted(lambda held, gone: not held)
    v = len(everything[1])
    n = sum(everything[1].values())
    even = 1 / (v + 1)
    kept = counted(lambda held, gone: not held and not gone)
    events = Counter(
        tuple(p) for _, words, _, gone in docs if gone for p in pairs(kept, words)
    )
    weights = [[0.5] * 65 for _ in range(order)]

    def mixture(pair, upto):
        p = even
        for k in range(upto):
            c, context = pair[k]
            if context:
                w = weights[k][context.bit_length()]
                p = w * c / context + (1 - w) * p
        return p

    for _ in range(I.ROUNDS):
        came, stopped = Counter(), Counter()
        for pair, times in events.items():
            reach = times
            for k in reversed(range(order)):
                c, context = pair[k]
                if context:
                    at = (k, context.bit_length())
                    stop = reach * weights[k][at[1]] * c / context / mixture(pair, k + 1)
                    came[at] += reach
                    stopped[at] += stop
                    reach -= stop
        for (k, b), total in came.items():
            if total:
                weights[k][b] = stopped[k, b] / total
    out = []
    for doc_id, words, held, _ in docs:
        found = [everything[1][(w,)] for w in words]
        out.append(
            {
                "doc_id": doc_id,
                "held_out": held,
                "n_tokens": len(words),
                "n_known": sum(c > 0 for c in found),
                "train_tokens": n,
                "base_score": sum(math.log10((c + 1) / (n + v + 1)) for c in found),
                "score": sum(math.log10(mixture(p, order)) for p in pairs(everything, words)),
            }
        )
    return out, weights


def same(found, want):
    key = lambda r: (str(r["doc_id"]), r["n_tokens"], round(r["score"], 6))
    found, want = sorted(found, key=key), sorted(want, key=key)
    assert len(found) == len(want)
    for f, w in zip(found, want, strict=True):
        assert f.keys() == w.keys()
        for name, value in w.items():
            if isinstance(value, float):
                assert f[name] == pytest.approx(value, rel=1e-9, abs=1e-9), (f, w)
            else:
                assert f[name] == value, (f, w)


def made(n=120, seed=4):
    draw = random.Random(seed)
    words = ["the", "The", "of", "ÉTÉ", "été", "a", "x\x00y", "12", "\x1c", " ", "end", "start"]
    words += [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(len(words))]
    texts = [
        draw.choice([" ", "\n", "\t "]).join(draw.choices(words, weights, k=draw.randrange(60)))
        for _ in range(n)
    ]
    texts += [None, "", " \n ", texts[0], texts[0], "the " * 3000]
    return [*enumerate(texts), (None, "no id"), (None, None), (3, "id again the of the of")]


@pytest.mark.parametrize(("order", "block", "merged"), [(2, 4_000_000, 6_000_000), (3, 300, 500), (1, 50, 90)])
def test_equals_plain_version(spark, written, make_docs, order, block, merged):
    rows = made()
    docs = make_docs(rows).repartition(3)
    found = I.score_report(docs, written, order=order, block=block, merged=merged, deleted=4)
    same([r.asDict() for r in found.collect()], plain(rows, order, 4)[0])


def test_whole_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = [r.asDict() for r in op12_interpolation(spark, sf_dir).collect()]
    same(found, plain([tuple(r) for r in rows], I.ORDER, I.DELETED)[0])
    held = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_probabilities_sum_to_one():
    """Over all words and one unknown one, after any context."""
    rows = made()
    docs, weights = plain(rows, 2, 4)
    words = {w for _, text in rows for w in tokens_of(text)}
    trained = [
        tokens_of(t) for i, t in rows if i is None or crc(i) % 7 != 2
    ]
    uni = Counter(w for t in trained for w in t)
    two = Counter((a, b) for t in trained for a, b in zip(["<s>", *t], t, strict=False))
    n, v = sum(uni.values()), len(uni)
    for h in ["the", "of", "w3"]:
        c_h = uni[h]

        def p(w, h=h, c_h=c_h):
            low = 1 / (v + 1)
            a, b = weights[0][n.bit_length()], weights[1][c_h.bit_length()]
            return b * two[h, w] / c_h + (1 - b) * (a * uni[w] / n + (1 - a) * low)

        assert sum(map(p, uni)) + p("never seen") == pytest.approx(1)
    assert words


def test_nothing_to_learn_from(spark, written, make_docs):
    ids = [i for i in range(100) if crc(i) % 7 == 2][:3]
    found = [r.asDict() for r in I.score_report(make_docs([(i, "a b") for i in ids]), written).collect()]
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in found] == [(3, 0, 0)] * 3
    assert all(r["score"] == r["base_score"] == 0 for r in found)
    assert I.score_report(make_docs([]), written).count() == 0


def test_numbers_survive_packing():
    draw = np.random.default_rng(1)
    keys = np.sort(draw.integers(0, 2**64, 1000, np.uint64))
    assert (I.unpacked(I.packed(keys, "<u8"), "<u8") == keys).all()
    counts = draw.integers(0, 2**32, 1000, np.uint32)
    assert (I.unpacked(I.packed(counts)) == counts).all()
    assert len(I.unpacked(I.packed(counts[:0]))) == 0
    assert I.bucket([0, 1, 2, 3, 4, 2**29, 2**40 - 1]).tolist() == [0, 1, 2, 2, 3, 30, 40]
