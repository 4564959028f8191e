"""Operators that compare rows, against brute force on small tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from auditlens.llm import components, embed_dedup, sharding, simhash, substring
from auditlens.llm.common import scratch


def groups_of(nodes, links):
    """The smallest reachable node of every node."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    scratch(spark)
    draw = random.Random(5)
    links = {
        "chain": [(n, n + 1) for n in range(-20, 40)],
        "star": [(7, n) for n in range(30)] + [(100, 101), (101, 100), (5, 5)],
        "random": [(draw.randint(0, 90), draw.randint(0, 90)) for _ in range(60)],
        "none": [],
    }[shape]
    found = components.components(spark.createDataFrame(links, "u long, v long")).collect()
    real = [e for e in links if e[0] != e[1]]
    expected = groups_of({n for e in real for n in e}, real)
    assert {r.node: r.root for r in found} == expected and len(found) == len(expected)


# --- SimHash


def _brute_print(text):
    words = (text or "").encode().lower().split()
    size = len(words)
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, size - 3))] if size else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _near_texts():
    draw = random.Random(11)
    base = [" ".join(draw.choice("abcdefghij") + str(draw.randint(0, 99)) for _ in range(200))
            for _ in range(6)]
    texts = list(base)
    for text in base:
        for _ in range(12):
            words = text.split()
            for _ in range(draw.randint(0, 3)):
                words[draw.randrange(len(words))] = "X"
            texts.append(" ".join(words))
    return [*texts, None, "", " \n", "one", "ONE", "one two three", "ÄÖ one", "äö one", texts[0]]


def test_near_duplicates_equal_brute_force(make_docs, written):
    texts = _near_texts()
    docs = make_docs([(100 + n, t) for n, t in enumerate(texts)])
    prints = {100 + n: _brute_print(t) for n, t in enumerate(texts)}
    ids = sorted(prints)
    links = [
        (a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 4
    ]
    expected = groups_of(ids, links)
    rows = simhash.group_report(docs, written).collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert int(row.fingerprint, 16) == prints[row.doc_id] and len(row.fingerprint) == 16
        assert row.component_id == expected[row.doc_id]


@pytest.mark.parametrize("tile", [3, 4096])
def test_links_of_fingerprints(spark, monkeypatch, tile):
    """Random and close fingerprints, in files of one and of several tiles."""
    scratch(spark)
    monkeypatch.setattr(simhash, "TILE", tile)
    draw = random.Random(2)
    prints = {draw.getrandbits(64) for _ in range(60)} | {0}
    for value in list(prints)[:15]:
        for _ in range(6):
            flipped = value
            for bit in draw.sample(range(64), draw.randint(1, 5)):
                flipped ^= 1 << bit
            prints.add(flipped)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "bits long")
    found = components.components(simhash.links(frame)).collect()
    close = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4
    expected = groups_of(signed, [(a, b) for a in signed for b in signed if a < b and close(a, b)])
    linked = {n: r for n, r in expected.items() if Counter(expected.values())[r] > 1}
    assert {r.node: r.root for r in found} == linked


def test_near_duplicates_edges(make_docs, written):
    rows = [(None, "some text here now"), (None, "some text here now"), (5, None), (4, ""), (4, "")]
    got = sorted(
        ((r.doc_id or 0, r.component_id) for r in
         simhash.group_report(make_docs(rows), written).collect())
    )
    assert got == [(0, None), (0, None), (4, 4), (4, 4), (5, 4)]
    assert simhash.group_report(make_docs([]), written).count() == 0


# --- Repeated passages


def _brute_kept(texts):
    docs = [(t or "").encode().split() for t in texts]
    count = Counter(
        tuple(d[i : i + substring.WINDOW])
        for d in docs
        for i in range(len(d) - substring.WINDOW + 1)
    )
    out = []
    for d in docs:
        gone = set()
        for i in range(len(d) - substring.WINDOW + 1):
            if count[tuple(d[i : i + substring.WINDOW])] > 1:
                gone |= set(range(i, i + substring.WINDOW))
        kept = b" ".join(w for i, w in enumerate(d) if i not in gone)
        out.append((len(d), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def _passages():
    draw = random.Random(4)
    words = lambda n: " ".join(f"w{draw.randint(0, 400)}" for _ in range(n))
    passage, longer = words(35), words(90)
    texts = [f"{words(40)} {passage} {words(3)}", f"{passage} {words(50)}", words(300)]
    texts += [f"{longer} {words(9)}", f"{words(2)}\n{longer}", longer[5:-7], longer]
    texts += ["a " * 80, "a " * 34, "b " * 35, "a b " * 40, words(60) + "\x85é " + words(20)]
    short = passage.rsplit(" ", 1)[0]  # one word less than a window
    return [*texts, f"{short} {words(4)}", f"{words(3)} {short}", None, "", texts[2], texts[2]]


def test_repeated_passages_equal_brute_force(make_docs, written):
    texts = _passages()
    rows = substring.repeat_report(make_docs(list(enumerate(texts))), written).collect()
    expected = _brute_kept(texts)
    assert len(rows) == len(texts)
    for row in rows:
        assert (row.n_words, row.n_removed, row.kept_sha256) == expected[row.doc_id]


def test_a_full_sketch_loses_nothing(make_docs, written, monkeypatch):
    """Where every cell is taken, all windows go on to the exact pass."""
    texts = _passages()
    size = (substring.DEPTH << substring.CELL_BITS) // 8
    monkeypatch.setattr(substring, "sketch", lambda docs: np.full(size, 255, np.uint8))
    rows = substring.repeat_report(make_docs(list(enumerate(texts))), written).collect()
    expected = _brute_kept(texts)
    assert all((r.n_words, r.n_removed, r.kept_sha256) == expected[r.doc_id] for r in rows)


def test_repeated_passages_edges(make_docs, written):
    once = " ".join(map(str, range(70)))
    rows = [(None, once), (None, once), (3, None), (4, ""), (5, "x")]
    got = substring.without_repeats(make_docs(rows), written).select("doc_id", "kept.*").collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed, r.text) for r in got) == [
        (0, 70, 70, ""), (0, 70, 70, ""), (3, 0, 0, ""), (4, 0, 0, ""), (5, 1, 0, "x")
    ]
    assert substring.repeat_report(make_docs([]), written).count() == 0


def test_stretches_hold_every_window_once():
    texts = [(t or "").encode().split() for t in _passages()]
    found = substring.Stretches(texts, substring.WordHashes())
    places = [
        (o, f - found.starts[o] + i)
        for o, f, n in zip(found.owner, found.first, found.count, strict=True)
        for i in range(n)
    ]
    expected = [(o, i) for o, t in enumerate(texts) for i in range(len(t) - substring.WINDOW + 1)]
    assert sorted(places) == expected and found.count.max() <= substring.GRAMS


# --- Embeddings

VECTORS = "vec_id long, embedding array<float>, label int, id string, key string, n string"


def _vectors():
    draw = np.random.default_rng(8)
    base = draw.normal(size=(12, 16))
    rows = [b + draw.normal(size=16) * s for b in base for s in (0, 0, 0.1, 0.2, 0.3)]
    vectors = [np.float32(r).tolist() for r in rows]
    vectors += [(np.float32(rows[0]) * 2).tolist(), [0.0] * 16, [], None, [1.0, 2.0], [2.0, 4.0]]
    vectors += [[float("nan")] + [1.0] * 15, [float("inf")] * 16, [None] + [1.0] * 15, vectors[3]]
    return vectors


def _brute_links(vectors):
    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        return np.array(v, float) / np.linalg.norm(np.array(v, float))

    units = [unit(v) for v in vectors]
    return [
        (a, b)
        for a, u in enumerate(units)
        for b, w in enumerate(units)
        if a < b and u is not None and w is not None and len(u) == len(w) and u @ w >= 0.9
    ]


@pytest.mark.parametrize("tile", [8, 8192])
def test_embedding_links_equal_brute_force(spark, written, monkeypatch, tile):
    monkeypatch.setattr(embed_dedup.tiles, "__defaults__", (tile,))
    vectors = _vectors()
    links = _brute_links(vectors)
    expected = groups_of(range(len(vectors)), links)
    degree = Counter(n for link in links for n in link)
    frame = spark.createDataFrame(
        [(n, v, n % 3, "x", "x", "x") for n, v in enumerate(vectors)], VECTORS
    )
    rows = embed_dedup.link_report(frame, written).collect()
    assert len(rows) == len(vectors)
    for row in rows:
        assert (row.n_links, row.component_id) == (degree[row.vec_id], expected[row.vec_id])
        assert row.kept == (row.vec_id == expected[row.vec_id])


def test_vectors_of_a_rare_dimension_are_counted_once(spark, written):
    """They leave most of the tiles that the common dimension needs without a vector."""
    draw = np.random.default_rng(8)
    near = draw.normal(size=(40, 5)) * 0.05 + 1  # more than the 16 tiles: some share one
    vectors = draw.normal(size=(4000, 8)).tolist() + near.tolist()
    frame = spark.createDataFrame([(n, v, 0, "x", "x", "x") for n, v in enumerate(vectors)], VECTORS)
    rows = embed_dedup.link_report(frame, written).filter("vec_id >= 4000").collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in rows) == [
        (n, 39, 4000) for n in range(4000, 4040)
    ]


def test_quantisation_bounds_hold():
    draw = np.random.default_rng(3)
    for dims in (3, 64, 1500):
        v = draw.normal(size=(200, dims)) * draw.exponential(size=(200, 1))
        v[50:] = v[draw.integers(0, 50, 150)] + draw.normal(size=(150, dims)) * 0.2
        unit = v / np.linalg.norm(v, axis=1, keepdims=True)
        parts = embed_dedup.quantised(unit)
        rows, columns = embed_dedup.candidates(parts, parts, 0.9)
        assert set(zip(*np.nonzero(unit @ unit.T >= 0.9), strict=True)) <= set(
            zip(rows, columns, strict=True)
        )


def test_embedding_edges(spark, written):
    rows = [(None, [1.0, 0.0]), (None, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [0.0, 1.0])]
    frame = spark.createDataFrame([(*r, 0, "x", "x", "x") for r in rows], VECTORS)
    found = embed_dedup.link_report(frame, written).collect()
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in found)
    assert got == [(0, 1, None, False)] * 2 + [(3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True)]
    assert embed_dedup.link_report(spark.createDataFrame([], VECTORS), written).count() == 0


# --- Shards


def _check_shards(rows, texts, shards=8):
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == len(texts)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(shards)) <= 1
    slots = defaultdict(list)
    for row in rows:
        slots[row.shard].append(row.slot)
        assert row.law == "rows" and row.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    plain = sorted((n, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
                   for n, t in texts)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == plain


@pytest.mark.parametrize("kind", ["few", "half", "all", "one group"])
def test_shards_are_even_and_groups_stay_together(make_docs, kind):
    draw = random.Random(6)
    texts = {
        "few": [(n, f"text {n}") for n in range(93)] + [(100 + n, f"é {n // 3}") for n in range(12)],
        "half": [(n, f"text {n // 4 if n % 2 else n}") for n in range(400)],
        "all": [(n, f"text {draw.randint(0, 30)}") for n in range(251)],
        "one group": [(n, "hot" if n % 3 == 0 else f"text {n}") for n in range(300)],
    }[kind]
    rows = sharding.shard_report(make_docs(texts)).collect()
    _check_shards(rows, texts)
    text_of = dict(texts)
    where = defaultdict(set)
    for row in rows:
        where[text_of[row.doc_id]].add(row.shard)
    members = Counter(text_of.values())
    cut = [t for t, s in where.items() if len(s) > 1]
    if kind in ("few", "half"):
        assert not cut
    elif kind == "one group":
        assert cut == ["hot"] and len(where["hot"]) <= 4
    else:
        # No room is free at all, so only exchanges move documents; evenly dealt ones would
        # keep an eighth of their links.
        pair = lambda n: n * (n - 1) / 2
        together = Counter((text_of[r.doc_id], r.shard) for r in rows)
        share = sum(map(pair, together.values())) / sum(map(pair, members.values()))
        print("share", share)
        assert share > 0.5


def test_shard_edges(make_docs):
    texts = [(1, None), (2, None), (3, ""), (4, ""), (5, "x"), (5, "x"), (6, "é" * 100_000)]
    rows = sharding.shard_report(make_docs(texts)).collect()
    _check_shards(rows, texts)
    where = defaultdict(set)
    for row in rows:
        where[(row.size, row.doc_id in (1, 2))].add(row.shard)
    assert sharding.shard_report(make_docs([(None, "x"), (None, None)])).count() == 2
    assert sharding.shard_report(make_docs([])).count() == 0


def test_shards_use_no_python(make_docs):
    frame = sharding.balanced_shards(make_docs([(1, "a"), (2, "a"), (3, "b")]))
    plan = frame._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_least_of_groups_in_slices(spark):
    """One group holds most rows; some rows have no value, and one group only such rows."""
    rows = [(i, None if i % 7 == 0 else 5000 - i) for i in range(3000)] + [(9000, None), (9001, None)]
    pairs = [(i, 0) for i in range(2500)] + [(2600, 2599), (9001, 9000), (9000, 9000), (2599, 2599)]
    members = spark.createDataFrame(rows, "node_id long, value long")
    roots = spark.createDataFrame(pairs, "node long, root long")
    found = components.with_least(members, roots, "node_id", "value").collect()
    root = dict(pairs)
    groups = {}
    for node, value in rows:
        groups.setdefault(root.get(node, node), []).append(value)
    least = {r: min((v for v in vs if v is not None), default=None) for r, vs in groups.items()}
    assert sorted((r.node_id, r.root, r.component) for r in found if r.component is not None) == sorted(
        (n, root.get(n, n), least[root.get(n, n)]) for n, _ in rows if least[root.get(n, n)] is not None
    )
    assert len(found) == len(rows)
