"""Packing of tokenized documents into sequences of a fixed number of tokens, by best-fit decreasing.

A document longer than a window is first cut into full windows; what remains is packed, longest piece first, into the
open window with the least room that still holds it. A segment tree over remaining capacities finds that window in
log(window) steps. Only piece lengths travel: tokenization is a map over the documents, and the lengths are dealt by a
hash of document and start into groups of about ``PIECES_PER_GROUP``, each packed on its own. A group leaves a few open
windows, so its size sets the padding: with thousands of pieces a group it is far below a percent.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import let_go, stored

WINDOW = 4096
END_ID = 2
PIECES_PER_GROUP = 20_000
#: Entries that a worker remembers of words and their ids, and of their pieces, about 200 bytes each.
CACHE = 300_000


class WordTokenizer:
    """Token ids of texts, remembered by word.

    The vocabulary's own pre-tokenizer never lets a token cross white space, so the ids of a text are those of its words
    in order. Words of Latin-1 letters with ASCII punctuation behind them are cut here and given to the model directly;
    all other words go through the whole tokenizer.
    """

    SIMPLE = re.compile(r"([a-zà-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
    #: The same marks, as bytes.
    ENDS = frozenset(range(33, 127)) - frozenset(b"'0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        #: Byte-level alphabet: printable bytes stand for themselves, the others for U+0100 onwards.
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {"": b""}

    def piece(self, piece: str) -> bytes:
        if len(self.pieces) > CACHE:
            self.pieces = {"": b""}
        spelt = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(spelt)]
        found = self.pieces[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def word(self, word: bytes) -> bytes:
        if word.isalpha():  # of bytes: A-Z and a-z alone
            letters = word.lower().decode()
            return self.pieces.get(letters) or self.piece(letters)
        if word[-1] in self.ENDS and word[:-1].isalpha():  # most others: one mark behind the letters
            letters, mark = word[:-1].lower().decode(), chr(word[-1])
            return (self.pieces.get(letters) or self.piece(letters)) + (self.pieces.get(mark) or self.piece(mark))
        text = word.decode()
        simple = self.SIMPLE.fullmatch(text.lower())
        if simple and b"<|" not in word and (word.isascii() or max(text) < "Ā"):
            letters, marks = simple.groups()
            front, back = self.pieces.get(letters), self.pieces.get(marks)
            return (self.piece(letters) if front is None else front) + (self.piece(marks) if back is None else back)
        ids = self.whole.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def forget(self) -> None:
        self.words.clear()
        self.pieces = {"": b""}

    def encode(self, text: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts, known = text.split(), self.words
        new = set(parts).difference(known)
        if new:
            if len(known) > CACHE:
                known.clear()
                new = set(parts)
            for w in new:
                known[w] = self.word(w)
        return b"".join(map(known.__getitem__, parts))


_loaded: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def best_fit_decreasing(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """(sequence number, offset) for each length; lengths must not grow along the list and lie in 1..window."""
    size = 1
    while size < window + 1:
        size *= 2
    tree = [0] * (2 * size)  # tree[size + room]: open windows with that much room; inner nodes: their sums
    open_at: list[list[int]] = [[] for _ in range(window + 1)]

    def change(room: int, by: int) -> None:
        node = room + size
        while node:
            tree[node] += by
            node //= 2

    def tightest(need: int) -> int:
        """The least room >= need of an open window, or -1."""
        node = need + size
        if tree[node]:
            return need
        while node > 1:
            if node % 2 == 0 and tree[node + 1]:
                node += 1
                while node < size:
                    node = 2 * node if tree[2 * node] else 2 * node + 1
                return node - size
            node //= 2
        return -1

    out, sequences = [], 0
    for n in lengths:
        room = tightest(n)
        if room < 0:
            sequence, room = sequences, window
            sequences += 1
        else:
            sequence = open_at[room].pop()
            change(room, -1)
        out.append((sequence, window - room))
        if room > n:
            open_at[room - n].append(sequence)
            change(room - n, 1)
    return out


def pieces(documents: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize each text and cut it: id, start, length, ids_crc32, doc_tokens."""
    kind = documents.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = tokenizer(vocabulary).encode, struct.pack("<I", end_id)
        for batch in batches:
            at, starts, lengths, sums, totals = [], [], [], [], []
            for i, text in enumerate(batch.column(1).cast(pa.binary())):
                ids = encode(text.as_py() or b"") + end
                total = len(ids) // 4
                for start in range(0, total, window):
                    part = ids[4 * start : 4 * (start + window)]
                    at.append(i)
                    starts.append(start)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
                    totals.append(total)
            numbers = [pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *numbers], names=[id_col, "start", "length", "ids_crc32", "doc_tokens"])
        tokenizer(vocabulary).forget()
        let_go()

    return documents.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long")


def group_count(cut: DataFrame, per_group: int) -> int:
    """Groups for the pieces, of about ``per_group`` each: a few long texts make many."""
    return max(1, -(-cut.count() // per_group))


def pack(documents: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", per_group: int = PIECES_PER_GROUP) -> DataFrame:
    """Place every token of every document in exactly one sequence of at most ``window`` tokens.

    Returns per piece: the id, start, length, ids_crc32 (of the ids as little-endian unsigned 32-bit), doc_tokens (with the
    end id), sequence_id, offset. A null or empty text is the end id alone. Repeated rows are packed as documents of their
    own; null ids are kept; equal lengths are taken in order of (id, start), so a rerun gives the same packing; other
    columns are left out; an empty table gives no rows. ``vocabulary`` is the path of a tokenizer file that every worker
    can read.
    """
    cut = stored(pieces(documents, vocabulary, window, end_id, id_col, text_col), "pieces")
    groups = group_count(cut, per_group)
    # repeated rows differ in their place in the partition only, which spreads them
    dealt = cut.withColumn("_group", F.pmod(F.xxhash64(id_col, "start", F.monotonically_increasing_id()), F.lit(groups)))
    fields = ["start", "length", "ids_crc32", "doc_tokens"]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), (id_col, "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        placed = best_fit_decreasing(table.column("length").to_pylist(), window)
        group = key[0].as_py()
        return table.select([id_col, *fields]).append_column("sequence_id", pa.array([s * groups + group for s, _ in placed], pa.int64())).append_column(
            "offset", pa.array([o for _, o in placed], pa.int64())
        )

    schema = f"`{id_col}` {documents.schema[id_col].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return dealt.groupBy("_group").applyInArrow(run, schema)
