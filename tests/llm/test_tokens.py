import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinship.llm import tokens as tk
from kinship.llm.common import new_path


@pytest.fixture(scope="module")
def bpe(vocabulary):
    return tk.ByteBpe(vocabulary)


@pytest.fixture(scope="module")
def plain(vocabulary):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


def same(bpe, plain, text):
    assert bpe(text).tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


ODD = ["", " ", "\n", " \n", "  a", "a  b", "a \n b", "\n\n\nword", "don't you'll they've I'm he'd it's we're", "'s", " 's", "''s", "'S", "'ll'", "x'tx", "!'s", "\n's", "a'", "'", "12a3 4", "<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "word<|endoftext|>s", "<|endoftext|", "<|endof<|endoftext|>", "é'é ñ's", "×÷", "naïve ɏɐ", "日本 語", "a b", "tab\tend\t", "\r\n\r\n", "a\x00b", "🙂", "   ", "a   ", "end '", "'re", "'r", "'v e", "O'Neill'd've", "x" * 5000]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(bpe, plain, text):
    same(bpe, plain, text)


@given(st.lists(st.sampled_from([*"abstrelvmdST'' \n\t\r.!?09é×ñɏ日", "<|endoftext|>"]), max_size=60).map("".join))
@settings(max_examples=400, deadline=None)
def test_any_text(bpe, plain, text):
    same(bpe, plain, text)


def test_batches_with_resets(vocabulary, plain):
    small = tk.ByteBpe(vocabulary, most=50)
    texts = [None if i % 17 == 0 else f"word{i} it's {'ü' * (i % 5)} 日{i}" * (i % 7) for i in range(300)]
    for _ in range(2):
        got = list(small.batch(pa.array(texts, pa.string())))
        assert [g.tolist() for g in got] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_other_tokenizers_take_texts_whole():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    own, t = tk.ByteBpe(path), Tokenizer.from_file(path)
    assert not own.by_pieces
    for text in ("Hello  World", "", "it's\n12"):
        assert own(text).tolist() == t.encode(text, add_special_tokens=False).ids


def test_table():
    keys = np.random.default_rng(3).integers(0, 1 << 63, 5000, dtype=np.uint64) >> np.uint64(1)
    keys[:100] = np.arange(100)  # these share a slot
    keys = np.unique(keys)
    t = tk._Table(4)
    for lo in range(0, len(keys), 700):
        t.add(keys[lo : lo + 700])
    assert t.find(keys).tolist() == list(range(len(keys)))
    assert (t.find(keys ^ np.uint64(1 << 63)) == -1).all()


def test_files(spark, vocabulary, plain, monkeypatch):
    monkeypatch.setattr(tk, "BLOCK", 4000)
    rows = [(i * 7 % 50 if i % 11 else None, None if i % 13 == 0 else f"text number {i} " * (i % 40), i, "x") for i in range(200)]
    rows += [(70, "a text that ends <|endoftext|> and goes on", 0, "s"), (71, "<|endoftext|>", 0, "s")]
    rows += [(3, "", 0, "y"), (3, "tie", 1, "y"), (3, "tie", 1, "y"), (60, "long words here " * 4000, 2, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int, n_tokens string")
    path = new_path(spark, "tokens")
    tk.write_tokens(docs.repartition(5), path, vocabulary, 2)
    got = [tuple(r) for r in tk.read_tokens(spark, path).orderBy("start").collect()]
    want, at = [], 0
    for doc_id, text in sorted(((d, t or "") for d, t, _, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = plain.encode(text, add_special_tokens=False).ids + [2]
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    assert got == want
    assert tk.read_tokens(spark, path, ids=False).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_empty_table(spark, vocabulary):
    path = new_path(spark, "tokens")
    tk.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, vocabulary, 2)
    assert tk.read_tokens(spark, path).count() == 0


def test_workers_keep_what_they_have_learned():
    """The function that Spark sends, as it arrives in a worker, finds the encoder of the task before; other modules let go of it."""
    import public_tokenizers
    from pyspark import cloudpickle

    from kinship.llm import common, tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    sent = cloudpickle.dumps(tokens._records(path, 2))
    first, again = (cloudpickle.loads(sent).__wrapped__.__globals__["encoder"](path) for _ in range(2))
    assert first is again is tokens.encoder(path)
    common.kept("another")
    assert tokens.encoder(path) is not first
