"""Benchmark decontamination by Wu-Manber search over words.

The patterns are the benchmark's word windows. Windows of one length form a search: a shift
table over pairs of words says how far a position can be advanced, pairs that end a window
have shift 0 and name the bucket of windows with that suffix, and a bucket's windows are
compared word by word. The document is read once a block of patterns; a block has a bounded
number of windows, so what each task holds is bounded as the benchmark grows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlens.llm.common import content_key, each_text, scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TO_LOWER = str.maketrans(UPPER, LOWER)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 10
#: Windows in one block of patterns; about 1 KB each in a worker.
BLOCK = 100_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.translate(TO_LOWER))


class Search:
    """Wu-Manber tables for windows of one length, by pairs of words (or one word)."""

    def __init__(self, length: int, patterns: dict[tuple, set[str]]):
        self.length, self.patterns = length, patterns
        self.pair = min(2, length)
        self.furthest = length - self.pair + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, list[tuple]] = defaultdict(list)
        for window in patterns:
            for end in range(self.pair, length + 1):
                block = window[end - self.pair : end]
                self.shift[block] = min(self.shift.get(block, self.furthest), length - end)
            self.buckets[window[length - self.pair :]].append(window)

    def scan(self, words: list[str]) -> Iterator[tuple[int, set[str]]]:
        """(start, items) of every occurrence."""
        shift, furthest, length, n = self.shift.get, self.furthest, self.length, len(words)
        end = length
        if self.pair == 2:
            while end <= n:
                block = (words[end - 2], words[end - 1])
                step = shift(block, furthest)
                if step:
                    end += step
                    continue
                yield from self._confirm(words, end, block)
                end += 1
        else:
            for end in range(1, n + 1):
                if (words[end - 1],) in self.shift:
                    yield from self._confirm(words, end, (words[end - 1],))

    def _confirm(self, words: list[str], end: int, block: tuple) -> Iterator[tuple]:
        here = tuple(words[end - self.length : end])
        for window in self.buckets[block]:
            if window[0] == here[0] and window == here:
                yield end - self.length, self.patterns[window]


def windows(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows with the items that have them: (words, items).

    An item of fewer than WINDOW words is one window; an item without words, or with a null
    text, has none. The windows of an item whose id is null are searched for as well, but name no
    item.
    """
    lowered = F.translate(F.col(text), UPPER, LOWER)
    words = F.regexp_extract_all(lowered, F.lit(f"({WORD.pattern})"), F.lit(1))
    last = F.greatest(F.size("w") - WINDOW + 1, F.lit(1))
    return (
        benchmark.select(F.col(item).cast("string").alias("item"), words.alias("w"))
        .filter("size(w) > 0")
        .select("item", "w", F.explode(F.sequence(F.lit(1), last)).alias("at"))
        .select("item", F.slice("w", F.col("at"), F.lit(WINDOW)).alias("words"))
        .groupBy("words")
        .agg(F.collect_set("item").alias("items"))
    )


def _scanner(rows: list) -> Callable:
    """The UDF that gives a text's word count, hit positions and items for one block."""
    known = [(tuple(r["words"]), set(r["items"])) for r in rows]

    def make():
        by_length: dict[int, dict] = defaultdict(dict)
        for window, items in known:
            by_length[len(window)][window] = items
        searches = [Search(n, p) for n, p in sorted(by_length.items())]

        def one(text: str) -> tuple:
            words = words_of(text)
            hits: set[int] = set()
            items: set[str] = set()
            for search in searches:
                for start, of in search.scan(words):
                    hits.update(range(start, start + search.length))
                    items |= of
            return len(words), sorted(hits), sorted(items)

        return lambda texts: map(one, texts)

    return each_text(make, "n_words long; hits array<int>; items array<string>")


def contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", block: int = BLOCK
) -> DataFrame:
    """Adds `leaks`: struct<n_words, hits, items> to every row, and keeps the rest.

    hits are the positions of the words inside occurrences, items the ids (as text, sorted)
    of the items that occur; what only occurs in items without an id is hit and names none. Null texts have no words. Without benchmark windows nothing is
    hit. Repeated rows are repeated in the result, repeated items count once. A column
    `leaks` of the input is replaced.
    """
    scratch(docs.sparkSession)
    patterns = windows(benchmark).checkpoint()
    blocks = max(1, -(-patterns.count() // block))

    def scanner(b: int) -> Callable:
        return _scanner(patterns.filter(F.pmod(F.xxhash64("words"), F.lit(blocks)) == b).collect())

    if blocks == 1:
        return docs.withColumn("leaks", scanner(0)(F.col(text)))
    keyed = docs.drop("leaks").select("*", *content_key(F.coalesce(F.col(text), F.lit(""))))
    found = [
        keyed.select("_k1", "_k2", scanner(b)(F.col(text)).alias("r")).select("_k1", "_k2", "r.*")
        for b in range(blocks)
    ]
    merged = (
        reduce(DataFrame.unionByName, found)
        .groupBy("_k1", "_k2")
        .agg(
            F.max("n_words").alias("n_words"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("hits")))).alias("hits"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
        .select("_k1", "_k2", F.struct("n_words", "hits", "items").alias("leaks"))
    )
    return keyed.join(merged, ["_k1", "_k2"]).drop("_k1", "_k2")


def leak_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document the counts of words, hit words and items, and the items' digest."""
    found = contamination(docs.select("doc_id", "text"), benchmark)
    n_hit = F.size("leaks.hits").cast("bigint")
    return found.select(
        "doc_id",
        F.col("leaks.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("leaks.items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "leaks.items"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i
        FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM d, n WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n),
pos AS (
  SELECT doc_id, count(*) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit WHERE item_id IS NOT NULL)
  GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words,
  CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
