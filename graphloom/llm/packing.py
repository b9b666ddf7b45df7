"""Sum-of-squares online packing of token sequences into windows of a fixed length.

A document longer than the window gives whole windows first; what is left (a document shorter than the window, or a
remainder) goes online to the fill level that makes the sum of squares of the counts of partially filled windows
smallest.  The counts stand in an array by level, with a stack of open windows for each level.  At the end of a task the
open windows are joined end to end and cut at window bounds; the last one is split into powers of two, which need no
padding.  Each task packs its own rows: there is no shuffle, memory holds one batch and the open windows, and a task
that runs again on the same split gives the same sequences.  Sequence ids are (partition << 33) + number.

Tokens of a text are those of its words between ASCII spaces, one after the other: normalisation, lower-casing and
splitting of this tokenizer never look across white space, so words are encoded once and kept in a bounded table.  Null and empty texts are the end id alone.  Repeated rows are packed each.
Input columns other than the id and the text are ignored; a null id stays null.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import kept, sliced, table

WINDOW, END_ID, KEPT_WORDS = 2048, 1, 150_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_LATIN = re.compile(r"[\x21-\x7e\xa1-\xff]+")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^a-z0-9\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-\xff]+")
_WORD_END = "</w>"


class Recent:
    """A bounded table: two generations, of which the older is dropped when the younger is full."""

    def __init__(self, make, size: int):
        self.make, self.size, self.young, self.old = make, size, {}, {}

    def settle(self) -> None:
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young

    def add(self, key) -> bytes:
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        self.young[key] = got
        return got


class WordEncoder:
    """Texts (UTF-8) to little-endian unsigned 32-bit ids, by way of bounded tables of words and of the pieces they split into.

    A word of Latin-1 characters is split here and its pieces are merged by ``tiktoken`` from the same vocabulary and merges
    (a byte that UTF-8 lacks stands for the end of a word); all others are left to the tokenizer itself.  A vocabulary
    without word ends, or with a normaliser or splitter that differs, is left to the tokenizer altogether.
    """

    def __init__(self, path: str, kept: int = KEPT_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.merge = Tokenizer.from_file(path), _merger(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.words, self.pieces = Recent(self._word, kept), Recent(self._piece, kept)

    def _piece(self, piece: str) -> bytes:
        return np.array(self.merge(piece.encode() + b"\xff"), "<u4").tobytes()

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if self.merge and _LATIN.fullmatch(text) and not any(x in text for x in self.special):
            young, add = self.pieces.young, self.pieces.add
            return b"".join([young.get(p) or add(p) for p in _PIECES.findall(text.lower())])
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        self.words.settle()
        self.pieces.settle()
        split = [t.split() for t in texts]  # bytes split at the six ASCII spaces only
        young, add = self.words.young, self.words.add
        for w in {w for ws in split for w in ws}:
            if w not in young:
                add(w)
        get = young.__getitem__
        return [b"".join(map(get, ws)) for ws in split]


def _merger(path: str):
    """A function from a piece's bytes, 0xFF last, to its ids; None if the file isn't of the kind that ``WordEncoder`` splits itself."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    steps = [x["type"] for x in (whole.get("normalizer") or {}).get("normalizers", [])]
    split = ((whole.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
    if steps != ["NFC", "Replace", "Lowercase"] or split != r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" or whole["model"].get("end_of_word_suffix") != _WORD_END:
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    ranks = {bytes(byte_of[c] for c in t.removesuffix(_WORD_END)) + b"\xff" * t.endswith(_WORD_END): i for t, i in whole["model"]["vocab"].items()}
    return tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


def encoder(path: str) -> WordEncoder:
    """The process's encoder for a file; it outlives the tasks of a worker, until one of another operator begins."""
    encoders = kept("packing")
    if path not in encoders:
        encoders[path] = WordEncoder(path)
        kept("packing")  # what reading the file took goes back
    return encoders[path]


class SumOfSquares:
    """Online packing.  ``add`` gives (window, offset) for a piece shorter than the window; open windows keep their pieces."""

    def __init__(self, window: int = WINDOW):
        self.window, self.counts, self.made = window, np.zeros(window + 1, np.int64), 0
        self.open: list[list[list]] = [[] for _ in range(window + 1)]

    def add(self, piece: tuple, size: int) -> tuple[int, list] | None:
        """Place the piece; when its window is full, give the window's number and its pieces."""
        n, w = self.counts, self.window
        # level 0 (a new window) and the full level aren't partially filled: their counts stay 0
        gain = n[size:] - n[: w - size + 1]
        cost = 2 * gain + 2
        cost[0] -= 1
        cost[-1] -= 1
        usable = n[: w - size + 1] > 0
        usable[0] = True
        level = int(np.argmin(np.where(usable, cost, np.iinfo(np.int64).max)))
        if level:
            pieces = self.open[level].pop()
            n[level] -= 1
        else:
            pieces = []
        pieces.append(piece)
        level += size
        if level == w:
            self.made += 1
            return self.made - 1, pieces
        self.open[level].append(pieces)
        n[level] += 1
        return None

    def rest(self) -> list:
        """The pieces of all open windows, fullest first; they are open no more."""
        out = [p for level in range(self.window, 0, -1) for pieces in self.open[level] for p in pieces]
        self.counts[:] = 0
        self.open = [[] for _ in range(self.window + 1)]
        return out


def pack(items: Iterator[tuple], window: int = WINDOW) -> Iterator[tuple]:
    """items: (key, number of ids).  Yields (key, start, length, sequence, offset); ``sequence`` counts from 0."""
    packer = SumOfSquares(window)

    def placed(number: int, pieces: list) -> Iterator[tuple]:
        offset = 0
        for key, start, length in pieces:
            yield key, start, length, number, offset
            offset += length

    for key, n in items:
        at = 0
        while n - at >= window:
            yield key, at, window, packer.made, 0
            packer.made += 1
            at += window
        if at < n and (full := packer.add((key, at, n - at), n - at)):
            yield from placed(*full)
    rest = packer.rest()
    left = sum(p[2] for p in rest)
    room = 0
    for key, start, length in rest:
        while length:
            if not room:  # the next sequence: a whole window, or the largest power of two that is left
                size = window if left >= window else 1 << (left.bit_length() - 1)
                room, number, offset = size, packer.made, 0
                packer.made += 1
            take = min(room, length)
            yield key, start, take, number, offset
            start, length, room, offset, left = start + take, length - take, room - take, offset + take, left - take


def pack_documents(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text: str = "text", end_id: int = END_ID, window: int = WINDOW) -> DataFrame:
    """One row for each piece (``SCHEMA``).  ``tokenizer``: the path of a file that every worker can read."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = encoder(path), np.array([end_id], "<u4").tobytes()
        base = TaskContext.get().partitionId() << 33
        # the ids' bytes stay only while a piece of the document is open
        out: list[tuple] = []

        def items() -> Iterator[tuple]:
            for some in sliced(batches):
                for key, ids in zip(some.column(0).to_pylist(), words.encode(some.column(1).to_pylist()), strict=True):
                    ids += end
                    yield (key, ids, len(ids) // 4), len(ids) // 4

        def flush() -> pa.RecordBatch:
            arrays = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for (key, ids, total), start, length, sequence, offset in pack(items(), window):
            out.append((key, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total, base + sequence, offset))
            if len(out) >= 20_000:
                yield flush()
        if out:
            yield flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")).mapInArrow(run, SCHEMA)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: every document's pieces."""
    return pack_documents(docs)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op7_packing": op7_packing}
SQL: dict[str, str] = {}
