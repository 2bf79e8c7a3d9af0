import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vakanz.llm import queries, token_blocks

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_blocks_round_trip():
    rng = np.random.default_rng(3)
    for kind in range(40):
        n = int(rng.integers(0, 3000))
        ids = rng.integers(0, [2, 50_000, 1 << 32, 300][kind % 4], n, dtype=np.uint64).astype(np.uint32)
        if n and kind % 5 == 0:
            ids[rng.integers(0, n, max(1, n // 30))] = (1 << 32) - 1  # outliers go to the exceptions
        payload = token_blocks.encode_segment([1, None], np.array([n, 0]), ids)
        segment = token_blocks.Segment(payload)
        assert (segment.ids() == ids).all() and segment.doc_ids == [1, None] and segment.lengths.tolist() == [n, 0]
        for _ in range(5):
            a = int(rng.integers(0, n + 1))
            size = int(rng.integers(0, n - a + 1))
            assert (token_blocks.read_ids(payload, a, size) == ids[a:a + size]).all()
    assert (token_blocks.Segment(token_blocks.encode_segment([], np.zeros(0), np.zeros(0, np.uint32))).ids() == []).all()
    low = np.concatenate([np.arange(123), [60_000] * 5, [7]]).astype(np.uint32)
    assert token_blocks.Segment(token_blocks.encode_segment([1], np.array([129]), low)).n_except.tolist() == [5, 0]


def test_encoder_equals_the_tokenizer(tokenizer):
    rng, encoder = random.Random(1), token_blocks.Encoder(PATH)
    letters = [" ", "  ", "\n", "\t", "a", "b", "é", "'s", "1", "23", ".", "!!", "　", "\x1c", "\x85", " \n", "\n\n", "x y",
               "🙂", "\r\n", "<|endoftext|>", " ", "word, ", "Word.\nNext", "ſ", "ß,"]
    for _ in range(6000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 14)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def expected(rows, tokenizer):
    start, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_odd_rows(odd_docs, odd_rows, no_docs, tokenizer):
    got = sorted((tuple(r) for r in token_blocks.token_table(odd_docs, PATH).collect()), key=lambda r: r[1])
    assert got == expected([r[:2] for r in odd_rows], tokenizer)
    assert token_blocks.token_table(no_docs, PATH).count() == 0


def test_query_on_the_table(spark, sf_dir, tokenizer):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.op3(spark, sf_dir).collect()), key=lambda r: r[1])
    assert got == expected(rows, tokenizer)


def test_one_part(spark, tokenizer):
    rows = [(i, "a b c " * 400) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    files = token_blocks.write_files(docs.coalesce(1), PATH)
    assert files.agg({"n_docs": "sum"}).first()[0] == 30
    got = sorted((tuple(r) for r in token_blocks.token_table(docs, PATH).collect()), key=lambda r: r[1])
    assert got == expected(rows, tokenizer)


def test_words_around_line_breaks_need_no_pattern():
    """Too slow in the check: words, commas, full stops and line breaks between them go without the pattern."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    made = token_blocks.Encoder(path)

    def cut(text):
        raise AssertionError(text)

    made.parts.cut = cut
    texts = ["One two.\nThree four\nfive, six.", "Größe, été.\nÉté zoné,\nzuß x", "a b\nc.\nd,\ne", "a idiot, idiot. idiot"]
    for text in texts:
        assert np.frombuffer(made.encode(text), "<u4").tolist() == made.parts.tokenizer.encode(text, add_special_tokens=False).ids
    made = token_blocks.Encoder(path)
    for text in ["a b.,\nc", "a b\n.c", "a .\n,", "a ,", "a <|x,\ny", "a б,\nв.", "a 1,\n2.", "a b\n\nc", "a ., b", "a 日,\n本", "a b\n'll.", "a b\n's,"]:
        assert np.frombuffer(made.encode(text), "<u4").tolist() == made.parts.tokenizer.encode(text, add_special_tokens=False).ids
