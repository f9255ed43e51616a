import zlib

import numpy as np
import pytest

from quarrywork.llm import rans
from quarrywork.llm import token_output as T


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 70_000, 140_001])
def test_blocks_round_trip_and_checkpoints(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 5000).astype(np.uint32)
    table = rans.Table(rans.quantise(np.bincount(ids, minlength=5000)))
    block = rans.encode(ids, table)
    assert (rans.decode(block, table) == ids).all()
    step = rans.CHECKPOINT * rans.LANES
    assert (rans.decode(block, table, 1, 2) == ids[step : 2 * step]).all()
    if n > 1000:
        assert len(block) < 4 * n
        bad = bytearray(block)
        bad[len(bad) // 2] ^= 1
        with pytest.raises(ValueError):
            rans.decode(bytes(bad), table)


def test_quantise_keeps_every_symbol():
    f = rans.quantise(np.array([10**9, 1, 0, 1] + [1] * 40_000))
    assert f.sum() == 1 << rans.PRECISION and f[2] == 0 and (f[[0, 1, 3]] > 0).all()


def test_encoder_equals_the_library():
    enc = T.WordEncoder(T.default_tokenizer())
    texts = ["Hello, world. It's 3.14; naïve É, ×, … x…, a'.", "", " \n\t\r ", "İstanbul ﬁ \x1c a\x85b ŉ µ ª ß", "<|endoftext|> Up <|ENDOFTEXT|>", "dots... a.,b .a, ,", "x" * 500, "日本語 テキスト。 ok."]
    for some in (texts, texts[:4], [texts[0]]):
        ids, n = enc.encode(some, 1)
        for got, want in zip(np.split(ids, np.cumsum(n)[:-1]), enc.tokenizer.encode_batch(some, add_special_tokens=False), strict=True):
            assert got.tolist() == [*want.ids, 1]


def test_files_against_the_library(docs, corpus):
    from tokenizers import Tokenizer

    rows = T.encode_documents(docs).collect()
    tok = Tokenizer.from_file(T.default_tokenizer())
    start, want = 0, []
    for d, t, *_ in sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows), key=lambda r: r[1]) == want


def test_ids_read_back(spark, docs):
    path = f"{T.Scratch(spark, 'test').path}/files"
    T.write_tokens(docs.filter("doc_id = 403"), path, T.default_tokenizer())
    row = T.read_tokens(spark, path).first()
    assert np.frombuffer(row.ids, "<u4").tolist()[-1] == 1 and row.n_tokens == 2


def test_empty(empty):
    assert T.encode_documents(empty).count() == 0


def test_keys_of_any_type_come_back(spark):
    big = (1 << 62) + 1
    for kind, keys in (("string", ["b", "a", None]), ("bigint", [big, 3, None]), ("int", [7, None, 2])):
        df = spark.createDataFrame([(k, f"text {k}", k) for k in keys], f"doc_id {kind}, text string, start {kind}").coalesce(1)
        rows = sorted(T.encode_documents(df).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in rows] == [None, *sorted(k for k in keys if k is not None)]
