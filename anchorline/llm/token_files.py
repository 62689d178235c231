"""Token ids in files of independent zstandard frames with a trailing seek table.

Layout of a file (the public "seekable format" of zstandard, so any zstd tool can decompress it):

* one frame per document, or several where a document has more than ``FRAME_BYTES`` of ids; ids are little-endian
  unsigned integers, 2 bytes wide if the vocabulary allows it, else 4;
* a skippable frame with the document index: number of documents, id width, then per document its id, whether the id
  is null, and its number of frames;
* a skippable frame with the seek table: per frame the compressed size, the decompressed size and the low 32 bits of
  XXH64 of the decompressed bytes; then the number of frames, a descriptor byte and the magic number.

A reader fetches the two tables at the end, then only the frames it was asked for.
"""

from __future__ import annotations

import os
import re
import struct
import sys
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from anchorline.llm.frames import map_arrow, parts, total_bytes
from anchorline.llm.kernels import joined_bytes, ranges, slices_of, text_bounds
from anchorline.session import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the public format.
SEEK_MAGIC, SKIP_SEEK, SKIP_INDEX = 0x8F92EAB1, 0x184D2A5E, 0x184D2A50
FRAME_BYTES = 1 << 28
SLICE_BYTES = 4 << 20
CACHED_UNITS = 600_000
FILE_SCHEMA = "part int, path string, documents long, tokens long"
TOKEN_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long, part int, place long"


def unit_marks(data: np.ndarray, close: np.ndarray) -> np.ndarray:
    """Where a text may be cut without changing its ids: before a blank and around a line end that stand between
    letters or signs, and between a letter and a byte of ``close``.

    Pre-tokens hold a blank only in front and end where letters end or begin, but for those that begin with an
    apostrophe; so no merge reaches over such a cut. Of the letters beyond ASCII those with two bytes from U+00C0 to
    U+023F count; other bytes from 0x7F on may belong to wide white space, so nothing is cut beside them.
    """
    ascii_letter = ((data | 0x20) >= 97) & ((data | 0x20) <= 122)
    lead = (data >= 0xC3) & (data <= 0xC8)
    latin = np.zeros(len(data), bool)  # leading bytes of such letters
    latin[:-1] = lead[:-1] & ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
    begins, ends = ascii_letter | latin, ascii_letter.copy()
    ends[1:] |= latin[:-1]
    plain = (data > 0x20) & (data < 0x7F)
    before, after = plain | ends, plain | begins
    marks = np.zeros(len(data) + 1, bool)
    marks[1:-2] = (data[1:-1] == 0x20) & before[:-2] & after[2:]
    sign = close[data]
    marks[1:-1] |= ends[:-1] & sign[1:] | sign[:-1] & begins[1:] & (data[:-1] != 0x27)
    line = 1 + np.flatnonzero((data[1:-1] == 0x0A) & before[:-2] & after[2:])
    marks[line] = marks[line + 1] = True
    return marks


def byte_letters() -> dict[int, str]:
    """The letters by which a byte-level vocabulary writes bytes: a printable byte stands for itself, the others, in
    order, for the code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """Ids of many texts; each distinct unit between cuts is encoded once.

    A unit of Latin letters with at most a blank in front is one pre-token, so it goes straight to the tokenizer's
    model; all others take the way through its pre-tokenizer.
    """

    WORD = re.compile("[ ]?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        self.close = np.zeros(256, bool)
        self.close[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True
        for added in self.tokenizer.get_added_tokens_decoder().values():
            self.close[list(added.content.encode())] = False  # such a token must not be cut
        self.letters = byte_letters()
        self.forget()

    def _encoded(self, fresh: list[str]) -> list[list[int]]:
        whole = self.WORD.fullmatch
        rest = [v for v in fresh if not whole(v)]
        others = {v: e.ids for v, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True)}
        model, letters = self.tokenizer.model, self.letters
        return [
            others[v] if v in others else [t.id for t in model.tokenize(v.encode().decode("latin-1").translate(letters))]
            for v in fresh
        ]

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = [np.zeros(0, np.uint32)]
        self.sizes = [np.zeros(0, np.int64)]

    def units(self, values: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all known units, where each of ``values`` begins in them, and how many ids it has."""
        if len(self.known) > CACHED_UNITS:
            self.forget()
        fresh = [v for v in values if v not in self.known]
        lists = self._encoded(fresh)
        self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
        count = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter(chain.from_iterable(lists), np.uint32, int(count.sum()))
        self.flat, self.sizes = [np.concatenate([*self.flat, ids])], [np.concatenate([*self.sizes, count])]
        number = np.fromiter(map(self.known.__getitem__, values), np.int64, len(values))
        ends = np.cumsum(self.sizes[0])
        return self.flat[0], (ends - self.sizes[0])[number], self.sizes[0][number]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string array (no nulls) one after another, and the bounds of each text's ids."""
        data, offsets = joined_bytes(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        marks = unit_marks(data, self.close)
        marks[offsets] = True
        bounds = np.flatnonzero(marks)
        cells = pa.Array.from_buffers(
            pa.string(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)]
        ).dictionary_encode()
        flat, begins, lengths = self.units(cells.dictionary.to_pylist())
        codes = cells.indices.to_numpy()
        each = lengths[codes]
        upto = np.concatenate([[0], np.cumsum(each)])
        return flat[ranges(begins[codes], each)], upto[np.searchsorted(bounds, offsets)]


def skippable(magic: int, body: bytes) -> bytes:
    return struct.pack("<II", magic, len(body)) + body


class TokenFileWriter:
    def __init__(self, sink, width: int):
        self.sink, self.width = sink, width
        self.frames: list[tuple[int, int, int]] = []
        self.documents: list[tuple[int | None, int]] = []
        self.tokens = 0
        self.zstd = zstandard.ZstdCompressor(level=3)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        raw = ids.astype(f"<u{self.width}").tobytes()
        step = FRAME_BYTES
        pieces = [raw[i : i + step] for i in range(0, len(raw), step)] or [b""]
        for piece in pieces:
            frame = self.zstd.compress(piece)
            self.sink.write(frame)
            self.frames.append((len(frame), len(piece), xxhash.xxh64_intdigest(piece) & 0xFFFFFFFF))
        self.documents.append((doc_id, len(pieces)))
        self.tokens += len(ids)

    def close(self) -> None:
        ids = np.array([d or 0 for d, _ in self.documents], "<i8")
        null = np.array([d is None for d, _ in self.documents], np.uint8)
        frames = np.array([n for _, n in self.documents], "<u4")
        head = struct.pack("<QI", len(ids), self.width)
        self.sink.write(skippable(SKIP_INDEX, head + ids.tobytes() + null.tobytes() + frames.tobytes()))
        body = np.array(self.frames, "<u4").tobytes() + struct.pack("<IBI", len(self.frames), 0x80, SEEK_MAGIC)
        self.sink.write(skippable(SKIP_SEEK, body))


class TokenFileReader:
    """Random access to the documents of one file; every frame's checksum is verified."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        n, flag, magic = struct.unpack("<IBI", self.at(end - 9, 9))
        if magic != SEEK_MAGIC or not flag & 0x80:
            raise ValueError("not a file with a seek table and checksums")
        seek_at = end - 9 - 12 * n
        self.table = np.frombuffer(self.at(seek_at, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        index_at = int(self.begin[-1])
        index = self.at(index_at + 8, seek_at - 8 - index_at - 8)
        count, self.width = struct.unpack_from("<QI", index)
        self.ids = np.frombuffer(index, "<i8", count, 12)
        self.null = np.frombuffer(index, np.uint8, count, 12 + 8 * count).astype(bool)
        frames = np.frombuffer(index, "<u4", count, 12 + 9 * count).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(frames)])
        self.zstd = zstandard.ZstdDecompressor()

    def at(self, offset: int, length: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(length)

    def __len__(self) -> int:
        return len(self.ids)

    def tokens(self, i: int) -> np.ndarray:
        """Ids of the i-th document: only its own frames are read."""
        out = []
        for f in range(self.first[i], self.first[i + 1]):
            raw = self.zstd.decompress(self.at(int(self.begin[f]), int(self.table[f, 0])), int(self.table[f, 1]) or 1)
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[f, 2]:
                raise ValueError(f"frame {f} is damaged")
            out.append(raw)
        return np.frombuffer(b"".join(out), f"<u{self.width}").astype(np.uint32)


def open_reader(path: str) -> TokenFileReader:
    fs, at = pafs.FileSystem.from_uri(path)
    return TokenFileReader(fs.open_input_file(at))


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0,
    file_bytes: int = 32 << 20,
) -> list[tuple[int, str, int, int]]:
    """Encode all texts, in ascending id order over files and within them, and write them below ``folder``.

    ``folder`` is a URI that all executors share. A null text is empty; an empty one holds only ``end_id``; a null id
    comes last; rows that repeat an id stand next to each other, ordered by text. A task writes under a name of its
    own and renames the file at its end, so a repeated task leaves one whole file. Returns one (part, path, documents,
    tokens) per file, in order; an empty table gives none.
    """
    folder = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col("text")]
    dealt = rows.repartitionByRange(parts(total_bytes(rows), file_bytes), *order[:2]).sortWithinPartitions(*order)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, at = pafs.FileSystem.from_uri(folder)
        final, own = f"{at}/part-{task.partitionId():06d}.tok", f"{at}/.try-{task.taskAttemptId()}"
        encoder, out = Encoder(tokenizer), None
        width = 2 if encoder.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        for batch in batches:
            texts = batch.column(1)
            ids = batch.column(0).to_pylist()
            for a, b in slices_of(text_bounds(texts), SLICE_BYTES):
                if out is None:
                    fs.create_dir(at)
                    out = TokenFileWriter(fs.open_output_stream(own), width)
                tokens, bounds = encoder.encode(texts.slice(a, b - a))
                for k in range(b - a):
                    out.add(ids[a + k], np.append(tokens[bounds[k] : bounds[k + 1]], np.uint32(end_id)))
        if out is not None:
            out.close()
            out.sink.close()
            fs.move(own, final)
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([task.partitionId()], pa.int32()), "path": [f"{folder}/part-{task.partitionId():06d}.tok"],
                 "documents": [len(out.documents)], "tokens": [out.tokens]}
            )

    return sorted(tuple(r) for r in map_arrow(dealt, write, FILE_SCHEMA).collect())


def read_token_files(spark, files: list[tuple[int, str, int, int]]) -> DataFrame:
    """Per document of the files: id, first token's number over all files, number of tokens and crc32 of the ids as
    little-endian unsigned 32-bit integers. One task reads one file."""
    if not files:
        return spark.createDataFrame([], TOKEN_SCHEMA)
    starts, total = [], 0
    for part, path, _, tokens in files:
        starts.append((part, path, total))
        total += tokens

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file, start = open_reader(row["path"]), row["first"]
                for a in range(0, len(file), 4096):
                    sizes, sums, begins = [], [], []
                    for i in range(a, min(a + 4096, len(file))):
                        ids = file.tokens(i)
                        begins.append(start)
                        sizes.append(len(ids))
                        sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                        start += len(ids)
                    b = a + len(sizes)
                    yield pa.RecordBatch.from_pydict(
                        {"doc_id": pa.array(file.ids[a:b], mask=file.null[a:b]), "start": begins, "n_tokens": sizes,
                         "ids_crc32": sums, "part": pa.array([row["part"]] * (b - a), pa.int32()), "place": range(a, b)}
                    )

    index = spark.createDataFrame(starts, "part int, path string, first long").repartitionByRange(len(starts), "part")
    return map_arrow(index, read, TOKEN_SCHEMA)


def token_files(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Write the token files (below the shared folder if none is named) and describe each document from them."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    return read_token_files(spark, write_token_files(docs, folder, tokenizer))
