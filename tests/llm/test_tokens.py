"""Token files and counts against the libraries on whole texts."""

import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from declarium.llm import token_blocks, token_counts
from declarium.llm.common import table

ODD = [
    None, "", " ", "a", " a", "a ", "a  b", "\na", "a\n b", "a \nb", "a\n\nb", "\t x\r\n y", "a\x1c b",
    "<|endoftext|>", "x <|endoftext|> y", "it's I'LL don't, 'quoted'", "é à ñandú ß", "中文 字 符",
    "1a2 3 !!! ??a, b.", "▁a ▁ b▁ c", "<s> x </s> <unk> <0x41>", "ﬁ ① x y", "a b c",
    "word " * 20_000, "x" * 20_000, "THE!! *** $$$ a.b,c;d",
]


@pytest.fixture(scope="module")
def bpe():
    return Tokenizer.from_file(public_tokenizers.path(token_blocks.TOKENIZER))


@pytest.fixture(scope="module")
def pieces():
    path = public_tokenizers.path(token_counts.MODEL)
    return sentencepiece.SentencePieceProcessor(model_file=path)


def expected_rows(bpe, pairs):
    start, out = 0, []
    for doc_id, text in pairs:
        ids = [*bpe.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_hold_the_librarys_ids(make_docs, bpe):
    pairs = list(enumerate(ODD))
    found = token_blocks.token_blocks(make_docs(pairs[::-1], extra=True))
    found = sorted(tuple(r) for r in found.select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert found == expected_rows(bpe, pairs)


def test_repeated_rows_and_missing_ids(make_docs, bpe):
    rows = [(None, "b c"), (2, "a"), (2, "a"), (1, None)]
    found = token_blocks.token_blocks(make_docs(rows)).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens) for r in found) == [
        (False, 0, 0, 3), (True, 1, 3, 1), (True, 2, 4, 2), (True, 2, 6, 2),
    ]


def test_empty_tables(make_docs):
    assert token_blocks.token_blocks(make_docs([])).count() == 0
    assert token_counts.count_tokens(make_docs([])).count() == 0


def test_whole_table(spark, bpe):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    pairs = sorted((r.doc_id, r.text) for r in docs.collect())
    found = token_blocks.token_blocks(docs).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(map(tuple, found.collect())) == expected_rows(bpe, pairs)


def test_counts_are_the_librarys(make_docs, pieces):
    found = token_counts.count_tokens(make_docs(list(enumerate(ODD)), extra=True)).collect()
    for row in found:
        text = ODD[row.doc_id] or ""
        assert row.n_tokens == len(pieces.encode(text)), text[:40]
        assert row.n_bytes == len(text.encode())
        assert row.over_limit == (row.n_tokens > 4096)


def test_counts_of_the_whole_table(spark, pieces):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for row in token_counts.count_tokens(docs).collect():
        assert row.n_tokens == len(pieces.encode(texts[row.doc_id]))


def test_batches_are_bounded():
    batches = list(token_counts.by_bytes(["ab"] * 10, 6))
    assert [len(b) for b in batches] == [3, 3, 3, 1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), min_size=1, max_size=3000))
def test_blocks_round_trip(values):
    ids = np.array(values, "<u4")
    starts, payload = token_blocks.pack_ids(ids)
    assert (token_blocks.unpack_ids(starts, payload) == ids).all()
    block = len(values) // token_blocks.BLOCK if len(values) % token_blocks.BLOCK else 0
    part = ids[block * token_blocks.BLOCK :][: token_blocks.BLOCK]
    assert (token_blocks.read_block(starts, payload, block) == part).all()


def test_outliers_do_not_widen_blocks():
    ids = np.full(1000, 7, "<u4")
    ids[::100] = 4_000_000_000
    assert len(token_blocks.pack_block(ids)) < 100


def test_pieces_are_copied_with_little_memory_beside_them():
    data = np.arange(1_000, dtype="<u4")
    starts, sizes = np.tile([3, 990, 7, 0], 1_500), np.tile([900, 10, 0, 1_000], 1_500)
    expected = np.concatenate([data[s : s + n] for s, n in zip(starts.tolist(), sizes.tolist())])
    tracemalloc.start()
    found = token_blocks.gathered(data, starts, sizes)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.dtype == data.dtype and (found == expected).all()
    assert most < 2 * found.nbytes
    none = np.empty(0, np.int64)
    assert len(token_blocks.gathered(data, none, none)) == 0
    assert token_blocks.gathered(data, np.array([5, 9]), np.array([0, 0])).tolist() == []


def test_slices_of_texts_take_bounded_memory(bpe):
    """Ids of 8 MB of common words, with odd texts among them."""
    line = "the quick brown fox jumps over a lazy dog, and 12 more. " * 40
    texts = [line.strip() + f" end{i}" for i in range(3_700)]
    texts[5], texts[77], texts[3_000] = None, "a  b <|endoftext|>", "中文 字 符"
    encoder = token_blocks.Encoder(public_tokenizers.path(token_blocks.TOKENIZER))
    column = pa.array(texts)
    tracemalloc.start()
    ids, sizes = encoder.ids(column)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    ends = np.cumsum(sizes)
    for i in (0, 5, 6, 77, 78, 3_000, 3_001, 3_699):
        own = ids[ends[i] - sizes[i] : ends[i]].tolist()
        assert own == [*bpe.encode(texts[i] or "", add_special_tokens=False).ids, 0]
    assert most < 9 * column.nbytes


def test_batches_of_texts_are_bounded_while_tokens_are_written(spark, make_docs):
    docs = make_docs([(i, "word " * 200) for i in range(400)]).coalesce(1).select("doc_id", "text")

    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    before = spark.conf.get(token_blocks.BATCH_BYTES, None)
    with token_blocks.batches_of(spark, 50_000):
        found = [r.n for r in docs.mapInArrow(rows, "n long").collect()]
    assert sum(found) == 400 and max(found) < 200
    assert spark.conf.get(token_blocks.BATCH_BYTES, None) == before


def test_blocks_are_packed_and_unpacked_together(monkeypatch):
    """Not one by one in Python: 300 blocks of several widths, with exceptions, and a short one."""
    draw = np.random.default_rng(1)
    rows = [draw.integers(0, 1 << (i % 33), token_blocks.BLOCK, np.uint32) for i in range(300)]
    for row in rows:
        row[draw.integers(0, len(row), 20)] = draw.integers(0, 1 << 32, 20, np.uint32)
    ids = np.concatenate([*rows, np.arange(100, dtype=np.uint32)])
    calls, bits = [], []
    partition, unpackbits = np.partition, np.unpackbits
    monkeypatch.setattr(np, "partition", lambda *a, **k: calls.append(1) or partition(*a, **k))
    starts, payload = token_blocks.pack_ids(ids)
    assert len(calls) < 10
    monkeypatch.setattr(np, "unpackbits", lambda *a, **k: bits.append(1) or unpackbits(*a, **k))
    assert (token_blocks.unpack_ids(starts, payload) == ids).all()
    assert len(bits) < 200
    alone = [token_blocks.pack_block(ids[i : i + 1024]) for i in range(0, len(ids), 1024)]
    assert b"".join(alone) == payload
    assert (token_blocks.read_block(starts, payload, 299) == rows[299]).all()


def test_distinct_words_are_no_python_objects():
    """A hundred thousand new words, with and without punctuation behind them."""
    texts = [" ".join(f"w{chr(97 + i % 26)}{i:x}q{'.,!'[i % 3]} " f"v{i:o}x" for i in range(k, k + 100))
             for k in range(0, 50_000, 100)]
    encoder = token_blocks.Encoder(public_tokenizers.path(token_blocks.TOKENIZER))
    column = pa.array(texts)
    tracemalloc.start()
    encoder.ids(column)
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 60 * 100_000


@pytest.mark.parametrize("limit", ["REMEMBERED", "REMEMBERED_BYTES"])
def test_forgotten_words_are_learned_again(monkeypatch, bpe, limit):
    monkeypatch.setattr(token_blocks, limit, 20)
    encoder = token_blocks.Encoder(public_tokenizers.path(token_blocks.TOKENIZER))
    texts = [
        f"Word{i}s. and thing{i % 7}, the\nline{i} éa!!! {'?' * (i % 5)} x{'!' * (i % 40)} (a{i}b)"
        for i in range(60)
    ]
    for low in (0, 20, 0, 40, 10):
        own = texts[low : low + 20] + [None, "", "odd  <|endoftext|>"]
        ids, sizes = encoder.ids(pa.array(own))
        ends = np.cumsum(sizes)
        for text, end, size in zip(own, ends, sizes):
            whole = [*bpe.encode(text or "", add_special_tokens=False).ids, 0]
            assert ids[end - size : end].tolist() == whole
        assert len(encoder.stems.names) < 400


def test_texts_without_words_hold_the_end_id():
    encoder = token_blocks.Encoder(public_tokenizers.path(token_blocks.TOKENIZER))
    for texts in ([None], [""], ["", None]):
        ids, sizes = encoder.ids(pa.array(texts, pa.string()))
        assert ids.tolist() == [token_blocks.END_ID] * len(texts) and sizes.tolist() == [1] * len(texts)
