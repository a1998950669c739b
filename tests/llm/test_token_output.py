import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.edge import documents, empty
from tidewater.llm.common import BATCH_BYTES, in_batches, new_path
from tidewater.llm.queries import tokenizer_path
from tidewater.llm.token_output import WordEncoder, file_number, read_index, token_digest, write_tokens


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


HARD = ["Don't stop, it's 'quoted'.", "ÀÉ öß İ Σας <|endoftext|> x", "a b c\x1cd\r\n\te", "x&&& y$$$ ***, 12.5% [a](b)", "é ́x", "", None, "日本語 текст ½", "a'sx b`s don't-'re x'.s   z  a̸≮b X́", " ", "it''s e'llo 'd'd ab'd12,3.ab", "ab<|startoftext|>cd"]


@pytest.mark.parametrize("store_bytes", [1 << 25, 0])
def test_words_are_encoded_as_texts_are(tokenizer, store_bytes):
    r = random.Random(1)
    texts = HARD + ["".join(r.choice("aAbs't'dre.,<|>-_`12éÉ̸́ \t\n \x85\x1c　Σσİ٣") for _ in range(r.randint(0, 30))) for _ in range(2000)]
    encoder = WordEncoder(tokenizer_path(), store_bytes)
    for some in (texts, texts[::-1], HARD[:1], [None], []):
        ids, counts = encoder.encode(pa.array(some, pa.string()))
        got = [x.tolist() for x in np.split(ids, np.cumsum(counts))[:-1]]
        assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in some]


def test_files_are_ordered_by_number(spark):
    names = spark.createDataFrame([(f"part-{n}-x.parquet",) for n in ("99999", "100000", "00002")], "file string")
    assert [r[0] for r in names.orderBy(file_number("file")).collect()] == ["part-00002-x.parquet", "part-99999-x.parquet", "part-100000-x.parquet"]


def test_round_trip(spark, tokenizer):
    rows = sorted(documents(spark).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or ""))
    got = sorted(token_digest(documents(spark), tokenizer_path()).collect(), key=lambda r: r["start"])
    at = 0
    for r, g in zip(rows, got, strict=True):
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        assert (g["doc_id"], g["start"], g["n_tokens"], g["ids_crc32"]) == (r["doc_id"], at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        at += len(ids)


def test_counters_are_read_without_tokens(spark):
    path = new_path(spark, "tokens")
    write_tokens(documents(spark), path, tokenizer_path())
    index = read_index(spark, path)
    assert index.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] == spark.read.parquet(path).agg(F.sum(F.size("tokens"))).first()[0]
    assert "tokens" not in index._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1].split("\n")[0].replace("n_tokens", "")


def test_empty_table(spark):
    assert token_digest(empty(spark), tokenizer_path()).count() == 0


def test_rows_reach_python_in_bounded_batches(spark):
    rows = spark.range(0, 400, 1, 1).select("id", F.repeat(F.lit("x"), F.when(F.col("id") == 7, 3 * BATCH_BYTES).otherwise(100_000)).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    found = in_batches(rows).mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in found) == 400
    assert all(r.size < BATCH_BYTES + 200_000 or r.size < 4 * BATCH_BYTES + 200_000 and r.n < 60 for r in found) and len(found) > 8
