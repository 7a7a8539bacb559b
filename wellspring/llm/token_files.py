"""Token ids in binary files of patched frame-of-reference blocks.

A file is a run of segments; a segment holds whole documents in ascending id order. Its ids
are cut into blocks of ``BLOCK``: the block's minimum is subtracted, differences are packed at
the bit width that fits ``KEPT`` of them, and the high bits of the rest go to an exception
list. The header, the document table and the block index (start, minimum, width, exceptions)
come first, so any block can be unpacked without the others.

Segments are stored as one binary column of a Parquet table (zstd) in the shared folder: it is written
by Spark's commit protocol (lost executors leave nothing behind) and can lie in any store.

Defined results: a null text counts as empty and becomes the end id alone; null ids come first;
rows with equal ids are ordered by their text and all kept; an empty table gives an empty one;
other columns are ignored.
"""

from __future__ import annotations

import os
import re
import string
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wellspring.llm.shared import TOKENIZERS, remembered, scratch_path

BLOCK, KEPT = 128, 0.9
SEGMENT_TOKENS = 1 << 19
#: Bytes of a generation of pieces with their ids; a worker remembers two generations.
KEPT_BYTES = 120 << 20
#: Bytes that an entry takes, its ids included, beside the signs of the piece.
ENTRY_BYTES = 200
#: Signs of text that are encoded at once, or one document.
SIGNS_AT_ONCE = 4 << 20
END_ID = 2
MAGIC = 0x31464F50
HEADER = np.dtype(
    [("magic", "<u4"), ("block", "<u4"), ("docs", "<u8"), ("tokens", "<u8"), ("blocks", "<u8"),
     ("exceptions", "<u8"), ("packed", "<u8")]
)
INDEX = np.dtype([("start", "<u8"), ("low", "<u4"), ("first_exception", "<u4"), ("width", "u1")])
#: Letters below this have simple lower cases, the same in every library.
LATIN_END = "\u0130"
LATIN_LETTERS = "".join(c for c in map(chr, range(ord(LATIN_END))) if c.isalpha())
#: The tokenizer takes such letters as one word, and ASCII signs behind them as another.
LATIN_WORD = re.compile(rf"([{LATIN_LETTERS}]+)([!-/:-@\[-`{{-~]*)")
#: Bytes between pieces, and their kinds: a piece also ends between a letter and a sign. Special tokens have "|" there.
BLANKS, OTHER, LETTER, SIGN, BLANK = b" \n", 0, 1, 2, 3
KINDS = bytearray(256)
for _kind, _signs in ((LETTER, string.ascii_letters), (SIGN, string.punctuation.replace("|", "")), (BLANK, BLANKS.decode())):
    for _sign in _signs:
        KINDS[ord(_sign)] = _kind
#: Distinct pieces that are looked up before the dictionary of pieces is trimmed.
PIECES_AT_ONCE = 4096
DOC = np.dtype([("id", "<i8"), ("known", "u1"), ("tokens", "<u8")])


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Block index, packed bytes, exception places and exception values of unsigned 32-bit ids."""
    blocks = -(-len(ids) // BLOCK)
    if not blocks:
        return np.empty(0, INDEX), np.empty(0, "u1"), np.empty(0, "u1"), np.empty(0, "<u4")
    values = np.full(blocks * BLOCK, ids[-1], np.uint32)
    values[: len(ids)] = ids
    values = values.reshape(blocks, BLOCK)
    low = values.min(axis=1)
    rest = values - low[:, None]
    at = min(BLOCK - 1, int(np.ceil(KEPT * BLOCK)) - 1)
    width = np.frexp(np.partition(rest, at, axis=1)[:, at].astype(np.float64))[1].astype(np.uint8)
    above = rest >> width[:, None].astype(np.uint32)
    outside = above != 0
    places = np.nonzero(outside)[1].astype(np.uint8)
    high = above[outside].astype("<u4")
    sizes = width.astype(np.uint64) * (BLOCK // 8)
    index = np.zeros(blocks, INDEX)
    index["low"], index["width"] = low, width
    index["start"][1:] = np.cumsum(sizes)[:-1]
    index["first_exception"][1:] = np.cumsum(outside.sum(axis=1))[:-1]
    packed = np.zeros(int(sizes.sum()), np.uint8)
    for w in np.unique(width):
        if w:
            rows = np.nonzero(width == w)[0]
            four = rest[rows].astype("<u4").view(np.uint8).reshape(len(rows), BLOCK, 4)
            flat = np.unpackbits(four, axis=2, count=int(w), bitorder="little")
            data = np.packbits(flat.reshape(len(rows), BLOCK * int(w)), axis=1, bitorder="little")
            packed[index["start"][rows].astype(np.int64)[:, None] + np.arange(data.shape[1])] = data
    return index, packed, places, high


def _values(data: np.ndarray) -> np.ndarray:
    """Values of rows of 8, which take as many bytes as each of them has bits."""
    w = data.shape[1]
    columns = [column.astype(np.uint64) for column in data.T]
    values = np.empty((len(data), 8), np.uint32)
    for i in range(8):
        first, skipped = divmod(i * w, 8)
        parts = columns[first : -(-(i + 1) * w // 8)]
        bits = sum(part << np.uint64(8 * k) for k, part in enumerate(parts)) >> np.uint64(skipped)
        values[:, i] = bits & np.uint64((1 << w) - 1)
    return values


def unpack(index: np.ndarray, packed: np.ndarray, places: np.ndarray, high: np.ndarray,
           first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of the blocks ``first`` to ``last`` (exclusive), the padding of the last one included."""
    last = len(index) if last is None else last
    chosen = index[first:last]
    out = np.zeros((len(chosen), BLOCK), np.uint32)
    for w in np.unique(chosen["width"]):
        if w:
            rows = np.nonzero(chosen["width"] == w)[0]
            data = packed[chosen["start"][rows].astype(np.int64)[:, None] + np.arange(BLOCK // 8 * int(w))]
            out[rows] = _values(data.reshape(-1, int(w))).reshape(len(rows), BLOCK)
    ends = np.append(index["first_exception"][1:], len(places))[first:last].astype(np.int64)
    counts = ends - chosen["first_exception"]
    rows = np.repeat(np.arange(len(chosen)), counts)
    if len(rows):
        span = slice(int(chosen["first_exception"][0]), int(ends[-1]))
        out[rows, places[span]] |= high[span] << chosen["width"][rows].astype(np.uint32)
    return (out + chosen["low"][:, None]).reshape(-1)


def write_segment(ids: list[int | None], counts: list[int], tokens: np.ndarray) -> bytes:
    index, packed, places, high = pack(tokens)
    docs = np.zeros(len(ids), DOC)
    docs["id"] = [0 if i is None else i for i in ids]
    docs["known"] = [i is not None for i in ids]
    docs["tokens"] = counts
    head = np.zeros(1, HEADER)
    head[0] = (MAGIC, BLOCK, len(docs), len(tokens), len(index), len(places), len(packed))
    return b"".join(x.tobytes() for x in (head, docs, index, packed, places, high))


def read_segment(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Document table and ids of one segment."""
    head = np.frombuffer(data, HEADER, 1)[0]
    if head["magic"] != MAGIC or head["block"] != BLOCK:
        raise ValueError("not a token segment of this format")
    at, parts = HEADER.itemsize, []
    for kind, count in ((DOC, "docs"), (INDEX, "blocks"), (np.dtype("u1"), "packed"),
                        (np.dtype("u1"), "exceptions"), (np.dtype("<u4"), "exceptions")):
        parts.append(np.frombuffer(data, kind, int(head[count]), at))
        at += kind.itemsize * int(head[count])
    docs, index, packed, places, high = parts
    return docs, unpack(index, packed, places, high)[: int(head["tokens"])]


def _ends_in_letter(piece: str) -> bool:
    """Whether the piece, lowered, ends in a letter; a capital may become a letter and a mark."""
    return piece != "" and piece[-1].isalpha() and piece[-1].lower()[-1].isalpha()


class _Pieces(dict):
    """Pieces with their ids: those met since the last change of generations, and those before.

    A piece is encoded when it is first asked for. Latin letters make one word of the tokenizer's pattern,
    and its other steps leave them alone once lowered, so its model gets their bytes at once.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, pattern = self.tokenizer.model, self.tokenizer.pre_tokenizer
        #: Signs that the model takes for the bytes of a letter that is not ASCII.
        self.byte_signs = {ord(c): pattern.pre_tokenize_str(c)[0][0] for c in LATIN_LETTERS if not c.isascii()}
        self.older: dict[str, bytes] = {}
        self.size = 0
        self[""] = b""

    @property
    def known(self) -> dict[str, bytes]:
        """The younger generation, which is the dictionary itself."""
        return self

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            found = self._encoded(piece)
        self[piece] = found
        self.size += 2 * len(piece) + ENTRY_BYTES
        return found

    def _word(self, letters: str) -> bytes:
        return array("I", [token.id for token in self.model.tokenize(letters)]).tobytes()

    def _encoded(self, piece: str) -> bytes:
        if piece.isascii() and piece.isalpha() and piece.islower():
            return self._word(piece)
        if found := LATIN_WORD.fullmatch(piece):
            letters, signs = found.groups()
            lowered = letters.lower()
            if signs or lowered != piece:
                return self[lowered] + self[signs]
            return self._word(piece.translate(self.byte_signs))
        if piece[-1] in ".," and _ends_in_letter(piece[:-1]):
            return self[piece[:-1]] + self[piece[-1]]
        return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def trim(self, kept: int) -> None:
        if self.size > kept:
            self.older, self.size = dict(self), 0
            self.clear()
            self[""] = b""


def _lowered(text: str) -> str:
    """The text in lower case if each of its letters has a simple one, as the tokenizer lowers them itself.

    Not where a special token may be, since these are found by their exact signs.
    """
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text if "<|" in text else text.lower()


def _cut(texts: list[str]) -> tuple[pa.LargeStringArray, np.ndarray]:
    """Pieces of all texts in their order, and how many lie before each text and behind the last.

    Blanks end a piece and are left out; an ASCII letter before an ASCII sign ends one too.
    """
    encoded = [text.encode() for text in texts]
    starts = np.cumsum([0, *map(len, encoded)])
    signs = b"".join(encoded)
    kinds = np.frombuffer(signs.translate(KINDS), np.uint8)
    last = kinds == BLANK
    last[:-1] |= (kinds[:-1] == LETTER) & (kinds[1:] == SIGN)
    last[starts[1:][np.diff(starts) > 0] - 1] = True
    stops = np.flatnonzero(last) + 1
    offsets = np.zeros(len(stops) + 1, np.int64)
    offsets[1:] = stops - np.cumsum(kinds[stops - 1] == BLANK)
    kept = pa.py_buffer(signs.translate(None, BLANKS))
    pieces = pa.LargeStringArray.from_buffers(len(stops), pa.py_buffer(offsets), kept)
    return pieces, np.searchsorted(stops, starts, side="right")


def piece_encoder(path: str, kept: int = KEPT_BYTES) -> Callable[[list[str]], list[bytes]]:
    """Encodes texts to little-endian unsigned 32-bit ids, each distinct piece of a call once.

    The tokenizer's pattern never joins signs across a space or a line end and its other steps
    do not look across them either, so a text's ids are those of the pieces between them. For
    the same reason signs behind Latin letters, or a full stop or comma behind any letter, are encoded
    apart, and Latin letters are lowered beforehand, as the tokenizer does that itself. The pieces of a call
    become a dictionary and its indices in Arrow, so that Python sees each distinct one only. Pieces of the last
    ``kept`` bytes, and of as many before them, stay in the worker process until another operator works there.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    pieces = remembered(f"token pieces of {path}", lambda: _Pieces(path))

    def encode(texts: list[str]) -> list[bytes]:
        rows, before = _cut([_lowered(text) for text in texts])
        if not len(rows):
            return [b""] * len(texts)
        coded = rows.dictionary_encode()
        distinct, found = coded.dictionary.to_numpy(zero_copy_only=False), []
        for i in range(0, len(distinct), PIECES_AT_ONCE):
            found += map(pieces.__getitem__, distinct[i : i + PIECES_AT_ONCE].tolist())
            pieces.trim(kept)
        joined = pa.array(found, pa.large_binary()).take(coded.indices)
        stops = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1)[before].tolist()
        data = memoryview(joined.buffers()[2])
        return [bytes(data[a:b]) for a, b in zip(stops, stops[1:])]

    return encode


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """First and behind-last number of the texts to encode at once."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and (size + len(text) > SIGNS_AT_ONCE or i - start == 1024):
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID,
                      segment_tokens: int = SEGMENT_TOKENS, kept: int = KEPT_BYTES) -> None:
    """Writes the ids of all texts, each followed by ``end_id``, in ascending ``doc_id`` order.

    One shuffle by ranges of the id; the partitions are the files, in order.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text")).repartitionByRange("doc_id")
    rows = rows.sortWithinPartitions("doc_id", "text")
    end = np.array([end_id], "<u4").tobytes()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq = piece_encoder(tokenizer, kept), TaskContext.get().partitionId(), 0
        ids, chunks, held = [], [], 0

        def cut() -> pa.RecordBatch:
            data = write_segment(ids, [len(c) // 4 for c in chunks], np.frombuffer(b"".join(chunks), "<u4"))
            return pa.RecordBatch.from_pydict(
                {"part": [part], "seq": [seq], "n_tokens": [held], "data": [data]}, schema=schema
            )

        schema = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("n_tokens", pa.int64()), ("data", pa.binary())])
        for batch in batches:
            texts, doc_ids = [t or "" for t in batch.column(1).to_pylist()], batch.column(0).to_pylist()
            for start, stop in _slices(texts):
                for doc_id, chunk in zip(doc_ids[start:stop], encode(texts[start:stop])):
                    ids.append(doc_id)
                    chunks.append(chunk + end)
                    held += len(chunk) // 4 + 1
                    if held >= segment_tokens:
                        yield cut()
                        ids, chunks, held, seq = [], [], 0, seq + 1
            pa.default_memory_pool().release_unused()  # the encoder's; Arrow would keep it, and executors have little
        if ids:
            yield cut()

    table = rows.mapInArrow(segments, "part long, seq long, n_tokens long, data binary")
    table.write.option("compression", "zstd").parquet(path)


def read_token_files(spark, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens and the checksum of its ids."""
    files = spark.read.parquet(path)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("token files", dict)  # the pieces are written, so their memory is free
        for batch in batches:
            for part, seq, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                docs, ids = read_segment(data)
                raw = memoryview(ids.astype("<u4")).cast("B")
                stops = np.cumsum(docs["tokens"]).astype(np.int64)
                starts = stops - docs["tokens"].astype(np.int64)
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array(np.full(len(docs), part)),
                        "seq": pa.array(np.full(len(docs), seq)),
                        "doc_id": pa.array(docs["id"], mask=docs["known"] == 0),
                        "local_start": pa.array(starts),
                        "n_tokens": pa.array(docs["tokens"].astype(np.int64)),
                        "ids_crc32": [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, stops)],
                    }
                )

    found = files.select("part", "seq", "data").mapInArrow(
        decoded, "part long, seq long, doc_id long, local_start long, n_tokens long, ids_crc32 long"
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("_sum"))
    parts = parts.select("part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_part_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("_seq_start"))
    return (
        found.join(starts, ["part", "seq"])
        .join(parts, "part")
        .select(
            "doc_id",
            (F.col("_part_start") + F.col("_seq_start") + F.col("local_start")).alias("start"),
            "n_tokens",
            "ids_crc32",
        )
    )


def token_file_report(docs: DataFrame, tokenizer: str | None = None, path: str | None = None,
                      kept: int = KEPT_BYTES) -> DataFrame:
    """Writes the files, reads them back and returns one row per document."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-files")
    write_token_files(docs, path, tokenizer or f"{TOKENIZERS}/word_bpe_49k.json", kept=kept)
    return read_token_files(spark, path)
