"""SentencePiece encoding and decoding by a table of distinct chunks.

Where no piece of a vocabulary crosses into a whitespace marker, a text falls into marked
words (a run of markers and the word after it) that are segmented independently; where none
holds a line feed, a line's first word is a chunk too. Each distinct chunk is given to the
library once a task; every text is then a join of its chunks, by position, with that table.
The table is kept in the task: joining every word occurrence with one table of the whole
corpus would shuffle several times the input.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlens.llm.common import each_text

MARK = "▁"


def read_model(path: str) -> bytes:
    """The vocabulary file, to be handed to the executors with the function."""
    return Path(path).read_bytes()


def chunks(text: str, lines: bool = True) -> list[str]:
    """The text's marked words, each without its first marker and with the others as spaces.

    A run of markers with no word after it is a chunk of its own; one marker alone is "".
    lines: whether a line feed begins a chunk too; such a chunk has no marker.
    """
    if not text:
        return []
    text = text.replace(MARK, " ")
    parts = (text.replace("\n", " \n") if lines else text).split(" ")
    if "" not in parts:
        return parts
    found, empty = [], 0
    for part in parts:
        if not part:
            empty += 1
            continue
        if not (lines and part[0] == "\n"):
            found.append(" " * empty + part)
        elif empty:
            found += [" " * (empty - 1), part]
        else:
            found.append(part)
        empty = 0
    return found + [" " * (empty - 1)] * bool(empty)


class ChunkTable:
    """Distinct chunks with their ids, filled from the library as they are met.

    It is emptied when it holds `most` chunks, which bounds its memory and changes no
    result.
    """

    def __init__(self, model: bytes, most: int = 400_000):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(size)]
        self.independent = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        self.most, self.ids = most, {}
        self.begin = np.array([self.library.bos_id()], "<u4").tobytes()
        self.end = np.array([self.library.eos_id()], "<u4").tobytes()
        self.lone = np.array([self.library.piece_to_id(MARK)], "<u4").tobytes()
        self.bytes_of = [self._bytes(i, p) for i, p in enumerate(pieces)]
        self.marked = {i for i, p in enumerate(pieces) if p.startswith(MARK)}
        line_feed = self.library.encode("\n")
        self.lines = (
            len(line_feed) == 2
            and line_feed[0] == self.library.piece_to_id(MARK)
            and self.library.is_byte(line_feed[1])
            and not any("\n" in p for p in pieces)
        )
        self.plain = {i for i in range(size) if self.library.is_unknown(i)}

    def _bytes(self, i: int, piece: str) -> bytes:
        if self.library.is_control(i):
            return b""
        if self.library.is_byte(i):
            return bytes([int(piece[3:-1], 16)])
        return piece.replace(MARK, " ").encode()

    def _learn(self, words: list[str]) -> None:
        distinct = set(words)
        new = [w for w in distinct if w not in self.ids]
        if len(self.ids) + len(new) > self.most:
            self.ids.clear()
            new = list(distinct)
        for chunk, ids in zip(new, self.library.encode(new, num_threads=1), strict=True):
            marked = not (self.lines and chunk[:1] == "\n")
            packed = np.array(ids if marked else ids[1:], "<u4").tobytes()
            self.ids[chunk] = packed if chunk else self.lone

    def encode(self, text: str) -> bytes:
        """All ids as little-endian unsigned 32-bit integers, begin and end included."""
        if not self.independent:
            return self.begin + np.array(self.library.encode(text), "<u4").tobytes() + self.end
        words = chunks(text, self.lines)
        try:
            found = b"".join(map(self.ids.__getitem__, words))
        except KeyError:
            self._learn(words)
            found = b"".join(map(self.ids.__getitem__, words))
        return self.begin + found + self.end

    def decode(self, ids: bytes) -> str:
        """The text of packed ids, as the library's decode() gives it."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        if not self.plain.isdisjoint(numbers):
            return self.library.decode(numbers)
        raw = b"".join(map(self.bytes_of.__getitem__, numbers))
        first = next((i for i in numbers if self.bytes_of[i]), None)
        try:
            return (raw[1:] if first in self.marked else raw).decode()
        except UnicodeDecodeError:  # byte pieces that form no text
            return self.library.decode(numbers)


def _encoder(model: bytes) -> Callable:
    def make():
        table = ChunkTable(model)

        def work(texts: list[str]) -> Iterator[tuple]:
            for text in texts:
                ids = table.encode(text)
                yield len(ids) // 4, ids, table.decode(ids)

        return work

    return each_text(make, "n_tokens long; ids binary; decoded string")


def encode_and_decode(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """Adds `pieces`: struct<n_tokens, ids, decoded> to every row, and keeps the rest.

    ids are packed as little-endian unsigned 32-bit integers, with begin and end. Null and
    empty texts have these two ids and decode to "". Texts of any length are encoded whole.
    Rows are independent: repeated rows give repeated results, an empty table an empty one.
    A column `pieces` of the input is replaced.
    """
    return docs.withColumn("pieces", _encoder(model)(F.col(text)))


def piece_digests(docs: DataFrame, model: bytes) -> DataFrame:
    """Per document the number of ids and the SHA-256 of the ids and of the decoded text."""
    return encode_and_decode(docs.select("doc_id", "text"), model).select(
        "doc_id",
        F.col("pieces.n_tokens").alias("n_tokens"),
        F.sha2(F.col("pieces.ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("pieces.decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
