import random

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from sentencepiece import SentencePieceProcessor

from tabulon.llm.sentencepieces import Pieces, decode, digests, encode, model, suffix_array

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  ", "a", " a", "a ", "a  b\n c\t x ", "Hello World. this  is   it", "é à ñ ÀÉ ß", "日本語テスト", "🙂🙂x", "aaaaaaaaaaaaaaaaaaaa",
         "▁a ▁▁b", "x y　z", "ﬁ ① Ａ", "á", "1234567890 99", "..... ,,,, ''''", "\r\n\x0b", "thethethe theandof", "z" * 3000]


def test_suffix_array():
    r = random.Random(1)
    s = [r.randrange(3) for _ in range(500)]
    got = suffix_array(np.array(s), 16)
    key = [tuple(s[i:i + 16]) for i in got]
    assert sorted(got) == list(range(500)) and key == sorted(key)


def test_ids_and_texts_match_the_library():
    r = random.Random(2)
    sp = SentencePieceProcessor(model_file=PATH)
    marks = ["a", "b", "e", "th", "the", "in", "tion", " ", "  ", "\n", "é", "日", "🙂", ".", "1", "X", "er", "s", "n"]
    texts = TEXTS + ["".join(r.choice(marks) for _ in range(r.randrange(60))) for _ in range(1500)]
    texts += pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    m = model(PATH)
    sizes, ids = m.encode(texts)
    want = sp.encode(texts, num_threads=1)
    for t, got, w in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), want, strict=True):
        assert got.tolist() == w, repr(t)
    assert m.decode_all(sizes, ids.astype(np.int64)) == [sp.decode(w) for w in want]


def test_operator(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (100, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids").repartition(3)
    sp = SentencePieceProcessor(model_file=PATH)
    out = encode(df, PATH)
    want = sorted((i, sp.encode(t or "")) for i, t in rows)
    assert sorted((r.doc_id, r.ids) for r in out.collect()) == want
    assert sorted((r.doc_id, r.text) for r in decode(out, PATH).collect()) == sorted((i, sp.decode(w)) for i, w in want)
    back = {r.doc_id: r for r in digests(df, PATH).collect()}
    assert all(back[i].n_ids == len(w) for i, w in want) and back[7].round_trip and not back[12].round_trip
    assert digests(df.where("false"), PATH).count() == 0


def test_new_words_go_to_the_model_s_own_matching():
    m = Pieces(PATH)
    assert m.light is None
    sizes, ids = m.encode(["one (two) one", "", "two"])
    want = SentencePieceProcessor(model_file=PATH).encode(["one (two) one", "", "two"])
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want and set(m.at) == {" one", " (two)", " two"}
