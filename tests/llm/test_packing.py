import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from caselode.llm.packing import op3_packing, pack, word_tokenizer


def brute_ids(text):
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(text or "", add_special_tokens=False).ids + [1]


def check(rows, docs, capacity):
    """Every id of every document in exactly one piece, sequences gapless; returns the sequences' lengths."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(docs)
    for doc, ids in docs.items():
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            part = b"".join(i.to_bytes(4, "little") for i in ids[at : at + r["length"]])
            assert (r["ids_crc32"] == zlib.crc32(part)) if "ids_crc32" in r else bytes(r["ids"]) == part
            at += r["length"]
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return [sum(r["length"] for r in own) for own in sequences.values()]


TEXTS = [None, "", "Hello   world", "a b c\x1cd", "café ́x ΣΑΣ İstanbul", "<|endoftext|> x<|startoftext|>", "it's 123 e-mail!!! 中文 🙂👍🏽", "word " * 5000, "x" * 3000]


def test_edges_against_whole_text_encoding(spark):
    df = spark.createDataFrame([(i, t, "e") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string").repartition(3)
    rows = [r.asDict() for r in pack(df, word_tokenizer(), capacity=64, windows=2).collect()]
    check(rows, {i: brute_ids(t) for i, t in enumerate(TEXTS)}, 64)


def test_documents(spark, sf_dir):
    docs = {r.doc_id: brute_ids(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    lengths = check([r.asDict() for r in op3_packing(spark, sf_dir).collect()], docs, 2048)
    padded = sum(0 if n & (n - 1) == 0 else 2048 - n for n in lengths)
    assert padded <= 0.02 * sum(lengths)


@pytest.mark.parametrize("rows", [[], [(None, None)]])
def test_no_rows_and_null_rows(spark, rows):
    got = pack(spark.createDataFrame(rows, "doc_id long, text string"), word_tokenizer()).collect()
    assert [(r.doc_id, r.length) for r in got] == [(None, 1)] * len(rows)
