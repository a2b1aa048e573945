"""Token-ID / binary output: flat unsigned integer files with 64-bit document offsets.

A shard is three files: ``.tokens`` (uint16 or uint32, as the vocabulary needs; ``end_id`` must fit as well), ``.offsets`` (uint64, one
more than it has documents, from 0 within the shard) and ``.ids`` (int64 document ids, null as INT64_MIN).
The manifest, a Parquet table, gives each shard's counts; prefix sums over it give each shard's base, so a
document's global start is base + offset and no shard is ever rewritten.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basewright.llm.common import shared_dir, slices, table, text_or_empty

NULL_ID = -(2**63)
MANIFEST = "shard int, first_id long, n_docs long, n_tokens long"


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


#: Texts that show whether a tokenizer's ids of a text are its pieces' ids in a row.
PROBES = ("two words", " a  b\nc \n d ", "The End.", "Él, été: ÀÇ!", "x\ty\r\nz", "a #b# (c) -- d/e", "it's 12 o'clock", "abc abc\nabc", "日本 語", "e\u0301 o\u0308", "A-B c_d!?", "$$$ %% x***")


class PieceEncoder(dict):
    """Token ids of texts, as bytes, with the ids of a bounded number of space-separated pieces remembered.

    Where white space ends every match of a tokenizer's split pattern and nothing is composed across it, a text's ids
    are its pieces' ids in a row. Whether this holds is tried with PROBES; whole texts are encoded where it does not.
    Pieces are remembered in two generations of ``most`` each: one that is met again outlives those that are not.
    """

    #: Pieces of one run of Latin letters and an optional run of marks are two splits at most and are given to
    #: the model without the pipeline around it, if the probes say that this gives the same ids.
    PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, path: str, split: bool = True, most: int = 400_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model, self.older = self.tokenizer.model, {}
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.split = self.plain = split
        if split:
            letters = (chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
            self.as_bytes = {ord(c): (self.tokenizer.pre_tokenizer.pre_tokenize_str(c) or [(c, 0)])[0][0] if self.tokenizer.pre_tokenizer else c for c in letters}
            self.plain = self._holds()
            self.split = self.plain or self._holds()
            self._forget()

    def _holds(self) -> bool:
        self._forget()
        return all(self.ids(x) == self._whole(x) for x in PROBES)

    def _forget(self) -> None:
        self.clear()
        self.older = {}

    def _packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _whole(self, text: str) -> bytes:
        return self._packed(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def _one(self, run: str) -> bytes:
        return self._packed([x.id for x in self.model.tokenize(run if run.isascii() else run.translate(self.as_bytes))])

    def __missing__(self, piece: str) -> bytes:
        out = self.older.get(piece)
        if out is None:
            if self.plain and (m := self.PLAIN.fullmatch(piece)):
                run, marks = m[1].lower(), m[2]
                out = self._one(run) if run == piece else self[run] + self[marks] if marks else self[run]
            elif self.plain and piece and piece.isascii() and not piece.isalnum() and self.PLAIN.fullmatch("a" + piece):
                out = self._one(piece)
            else:
                out = self._whole(piece)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[piece] = out
        return out

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" "))) if self.split else self._whole(text)


_encoders: dict[tuple, PieceEncoder] = {}


def _encoder(path: str, split: bool) -> PieceEncoder:
    if (path, split) not in _encoders:
        _encoders[path, split] = PieceEncoder(path, split)
    return _encoders[path, split]


def write_token_files(docs: DataFrame, out_dir: str, tokenizer_path: str, end_id: int = 2, split: bool = True) -> DataFrame:
    """Encode ``docs(doc_id, text)`` in ascending doc_id order into ``out_dir``; returns the manifest with bases.

    Null text is empty (only ``end_id`` is written); null ids come first. Rows that repeat an id stand in the
    order of their texts' hashes; ids that tie are spread over shards. An empty table writes no shard. A task
    writes to a name of its own attempt and renames it at the end, so a repeated task replaces equal files.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = ["doc_id", "tie", "row"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path, split)
        width, end = encoder.kind.itemsize, np.array([end_id], encoder.kind).tobytes()
        task = TaskContext.get()
        shard, attempt = task.partitionId(), task.taskAttemptId()
        store, root = _store(out_dir)
        store.create_dir(root)
        names = {x: f"{root}/{shard:06d}.{x}" for x in ("tokens", "offsets", "ids")}
        out = {x: store.open_output_stream(f"{p}.{attempt}") for x, p in names.items()}
        docs_n, tokens_n, first = 0, 0, None
        out["offsets"].write(np.zeros(1, "<u8").tobytes())
        for batch in slices(batches, 64):
            ids = batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            first = int(ids[0]) if first is None else first
            each = [encoder.ids(text) + end for text in batch.column(1).to_pylist()]
            ends = tokens_n + np.cumsum([len(x) // width for x in each])
            out["tokens"].write(b"".join(each))
            out["offsets"].write(ends.astype("<u8").tobytes())
            out["ids"].write(ids.astype("<i8").tobytes())
            docs_n, tokens_n = docs_n + len(ids), int(ends[-1])
        for x, stream in out.items():
            stream.close()
            if docs_n:
                store.move(f"{names[x]}.{attempt}", names[x])
            else:
                store.delete_file(f"{names[x]}.{attempt}")
        if docs_n:
            yield pa.RecordBatch.from_pylist([{"shard": shard, "first_id": first, "n_docs": docs_n, "n_tokens": tokens_n}], schema=pa.schema([("shard", pa.int32()), ("first_id", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    rows.mapInArrow(encode, MANIFEST).write.parquet(f"{out_dir}/manifest")
    return read_manifest(spark, out_dir)


def read_manifest(spark: SparkSession, out_dir: str) -> DataFrame:
    """Shards with the global index of their first document and first token: prefix sums over one row a shard."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = spark.read.schema(MANIFEST).parquet(f"{out_dir}/manifest")
    return shards.select("*", *(F.coalesce(F.sum(f"n_{x}").over(before), F.lit(0)).alias(f"{x}_before") for x in ("docs", "tokens")))


def _reader(store: fs.FileSystem, path: str, kind: str) -> Callable[[int, int], np.ndarray]:
    """Values [from, to) of a file: of the mapped file where the store is local, else of the bytes read for them."""
    if isinstance(store, fs.LocalFileSystem):
        mapped = np.memmap(path, dtype=kind, mode="r") if os.path.getsize(path) else np.empty(0, kind)
        return lambda lo, hi: mapped[lo:hi]
    file, width = store.open_input_file(path), np.dtype(kind).itemsize
    return lambda lo, hi: np.frombuffer(file.read_at((hi - lo) * width, lo * width), dtype=kind)


def read_token_files(spark: SparkSession, out_dir: str, ids: bool = False) -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens, ids_crc32, and the ids themselves if asked for.

    Shards are mapped into memory, or read by ranges of documents where the store is not local; only shard names are
    shuffled.
    """
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(out_dir)
        for batch in batches:
            for shard, n_docs, total, base in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                size = store.get_file_info(path := f"{root}/{shard:06d}.tokens").size
                offsets, doc_ids, tokens = (_reader(store, f"{root}/{shard:06d}.{x}", k) for x, k in (("offsets", "<u8"), ("ids", "<i8"), ("tokens", "<u2" if size == 2 * total else "<u4")))
                for i in range(0, n_docs, 256):
                    part = np.array(doc_ids(i, min(i + 256, n_docs)))
                    at = offsets(i, i + len(part) + 1).astype(np.int64)
                    flat = tokens(int(at[0]), int(at[-1])).astype("<u4")
                    inside, view = at - at[0], memoryview(flat).cast("B")
                    crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(inside.tolist(), inside[1:].tolist())]
                    columns = [pa.array(part, mask=part == NULL_ID), pa.array(base + at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns + [pa.ListArray.from_arrays(pa.array(inside.astype(np.int32)), pa.array(flat.astype(np.int64)))] * ids, schema=pa.schema(fields))

    shards = read_manifest(spark, out_dir).select("shard", "n_docs", "n_tokens", "tokens_before")
    parts = max(1, spark.read.parquet(f"{out_dir}/manifest").count())
    return shards.repartition(parts, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)


def token_output(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 2) -> DataFrame:
    """Write the files in the shared folder and return the documents read back from them."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    out_dir = shared_dir(docs.sparkSession)
    write_token_files(docs, out_dir, tokenizer_path, end_id)
    return read_token_files(docs.sparkSession, out_dir)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"))
