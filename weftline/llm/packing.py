"""Packing of tokenised documents into fixed windows by best-fit decreasing.

Documents are tokenised once, in the tasks that read them; only each piece's lengths and checksum are
shuffled, never its ids. Pieces are dealt to shards by a hash of the document id, the number of shards
follows the number of documents, and every shard is packed on its own, so no task sees more than a shard.
"""

from __future__ import annotations

import json
import math
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 4096
END_ID = 2
DOCS_PER_SHARD = 8000
#: Words, and pieces of words, that a worker remembers; the memory of a task is bounded by it and by one document.
REMEMBERED_WORDS = 1_200_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = f"{PIECES}, sequence_id long, offset long"

#: Texts in which splitting at white space could differ from the tokenizer's own rules.
_ODD = re.compile("[\x1c-\x1f]|<\\|")
_LATIN = re.compile("[!-~\xa1-\u024f]*")
_PLAIN = re.compile(r"([A-Za-z]+)([.,;:!?|]*)")
#: The steps before merging that ``WordIds`` may take piece by piece, as they stand in a tokenizer's file.
_STEPS = {
    "normalizer": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    "split": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}


class WordIds(dict):
    """Word -> its ids as little-endian 32-bit bytes, learnt as words come.

    A tokenizer that lowers case, drops white space and merges only inside pieces of one kind gives a text the ids of its pieces
    in order, so each piece is merged once and remembered. Any other tokenizer encodes whole texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        before = (said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_piece = (said.get("normalizer") or {}).get("normalizers") == _STEPS["normalizer"] and [x.get("type") for x in before] == ["Split", "ByteLevel"] and before[0]["pattern"] == {"Regex": _STEPS["split"]} and before[0]["behavior"] == "Removed" and before[0]["invert"]
        self.split = regex.compile(_STEPS["split"]).findall
        self.piece_ids: dict[str, bytes] = {}
        # byte-level alphabets write printable bytes as themselves and the others as characters from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in shown)}

    def of_piece(self, piece: str) -> bytes:
        got = self.piece_ids.get(piece)
        if got is None:
            if len(self.piece_ids) > REMEMBERED_WORDS:
                self.piece_ids.clear()
            written = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
            got = self.piece_ids[piece] = np.array([t.id for t in self.tokenizer.model.tokenize(written)], "<u4").tobytes()
        return got

    def __missing__(self, word: str) -> bytes:
        if len(self) > REMEMBERED_WORDS:
            self.clear()
        plain = _PLAIN.fullmatch(word)
        if plain:
            letters, marks = plain.groups()
            got = self.of_piece(letters.lower()) + (self.of_piece(marks) if marks else b"")
        elif _LATIN.fullmatch(word):  # Unicode versions and rules agree on these letters
            got = b"".join(map(self.of_piece, self.split(unicodedata.normalize("NFC", word).lower())))
        else:
            got = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = got
        return got

    def encode(self, text: str) -> bytes:
        if not self.by_piece or _ODD.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, text.split()))


def pieces(ids: bytes, window: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, crc32) of a document's full windows and of what is left after them."""
    n = len(ids) // 4
    for start in range(0, n, window):
        part = ids[4 * start : 4 * (start + window)]
        yield start, len(part) // 4, zlib.crc32(part)


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece; lengths must come in decreasing order.

    Leaf c of the segment tree counts open windows with c free places; the leftmost counted leaf at or right
    of a piece's length is the tightest window that holds it."""
    size = 1 << window.bit_length()
    tree = [0] * (2 * size)
    free: list[list[int]] = [[] for _ in range(window + 1)]
    number, offset, opened = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0

    def change(capacity: int, by: int) -> None:
        node = capacity + size
        while node:
            tree[node] += by
            node >>= 1

    for k, need in enumerate(lengths.tolist()):
        node = need + size
        while node and not tree[node]:
            while node & 1:  # from a right child go up; from the last leaf this ends above the root
                node >>= 1
            node += node > 0
        if node:
            while node < size:
                node = 2 * node if tree[2 * node] else 2 * node + 1
            capacity = node - size
            w = free[capacity].pop()
            change(capacity, -1)
        else:
            capacity, w, opened = window, opened, opened + 1
        number[k], offset[k] = w, window - capacity
        if capacity > need:
            free[capacity - need].append(w)
            change(capacity - need, 1)
    return number, offset


def pack_documents(docs: DataFrame, tokenizer_path: str, *, window: int = WINDOW, end_id: int = END_ID, docs_per_shard: int = DOCS_PER_SHARD) -> DataFrame:
    """One row per piece of a document: where it lies in its document and in which sequence.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null or empty text has
    only ``end_id``. A null doc_id is packed like any other and stays null. Rows that repeat are packed as often as they occur. Other
    columns are ignored. An empty table gives no rows. Documents over ``window`` ids are cut into full windows and
    a rest; ties among equal lengths fall by doc_id and start.
    """

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = WordIds(tokenizer_path), int(end_id).to_bytes(4, "little")
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = ids_of.encode(text.as_py() or "") + end
                out += [(doc_id, *piece, len(ids) // 4) for piece in pieces(ids, window)]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        number, offset = best_fit_decreasing(part["length"].to_numpy(), window)
        part["sequence_id"], part["offset"] = (int(key[0]) << 32) + number, offset
        return part.drop(columns="shard")

    shards = max(1, math.ceil(docs.count() / docs_per_shard))
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tokenise, PIECES)
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(shards))
    return cut.withColumn("shard", shard).groupBy("shard").applyInPandas(pack, PACKED)
