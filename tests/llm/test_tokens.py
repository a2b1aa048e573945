import zlib

import numpy as np
import public_tokenizers
from pyarrow import fs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from basewright.llm import tokens
from basewright.llm.common import shared_dir

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["The cat sat.", "", None, "Ünïcode ÉÀÇ ß, été! don't l'été", "a\tb\r\nc d e  f", "<|endoftext|> x<|startoftext|>y", "日本語 text 12345 #!?...", "ñ ñ ȩ́", "x\u001cy z", "İstanbul ΣΑΣ ﬁ", "!!!!!!!!!!!!!!!!!!!! ...,,,;;;", "w" * 3000, "ab, " * 5000]


def plain(texts):
    t, out, start = Tokenizer.from_file(PATH), [], 0
    for x in texts:
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        out.append((start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


def test_files_hold_what_plain_encoding_gives(spark):
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)], "doc_id long, text string").withColumn("start", F.lit("clash"))
    out = shared_dir(spark)
    tokens.write_token_files(docs.repartition(3), out, PATH)
    got = tokens.read_token_files(spark, out, ids=True).orderBy("doc_id").collect()
    assert [(r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) for r in got] == plain(TEXTS)
    manifest = tokens.read_manifest(spark, out).orderBy("shard").collect()
    assert sum(r["n_docs"] for r in manifest) == len(TEXTS) and manifest[0]["tokens_before"] == 0
    assert all(b["tokens_before"] == a["tokens_before"] + a["n_tokens"] for a, b in zip(manifest, manifest[1:]))


def test_ties_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b"), (5, "x"), (5, "x"), (5, "other"), (-3, None)], "doc_id long, text string")
    got = tokens.token_output(docs).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, -3, 5, 5, 5]
    ends = [r["start"] + r["n_tokens"] for r in got]
    assert [r["start"] for r in got] == [0, *ends[:-1]]
    assert tokens.token_output(docs.limit(0)).count() == 0


def test_forgetting_pieces_changes_nothing():
    small = tokens.PieceEncoder(PATH, most=3)
    whole = Tokenizer.from_file(PATH)
    for x in filter(None, TEXTS):
        assert np.frombuffer(small.ids(x), small.kind).tolist() == whole.encode(x, add_special_tokens=False).ids
    assert len(small) <= 3 and len(small.older) <= 3


def test_tokenizers_that_keep_white_space_get_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, whole = tokens.PieceEncoder(path), Tokenizer.from_file(path)
    assert not encoder.split and tokens.PieceEncoder(PATH).plain
    for x in filter(None, TEXTS):
        assert np.frombuffer(encoder.ids(x), encoder.kind).tolist() == whole.encode(x, add_special_tokens=False).ids


def test_ranges_of_files_in_stores(tmp_path):
    local = fs.LocalFileSystem()
    np.arange(100, dtype="<u2").tofile(tmp_path / "a")
    for store, path in ((local, str(tmp_path / "a")), (fs.SubTreeFileSystem(str(tmp_path), local), "a")):
        assert tokens._reader(store, path, "<u2")(7, 11).tolist() == [7, 8, 9, 10]
