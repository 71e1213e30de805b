import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tabulon.llm import wavelet
from tabulon.llm.wavelet import Shard, build

WORD = public_tokenizers.path("word_bpe_49k.json")


def opened(ids, frame=64):
    old, wavelet.FRAME_BITS = wavelet.FRAME_BITS, frame
    data = b"".join(build(np.array([5]), np.array([len(ids)]), np.array(ids, np.uint32)))
    return Shard(lambda o, n: data[o:o + n], kept=3), old


@pytest.mark.parametrize("top", [1, 2, 40, 70_000])
def test_access_count_and_occurrences(top):
    rng = np.random.default_rng(top)
    ids = rng.integers(0, top, 700)
    s, old = opened(ids)
    try:
        assert s.tokens().tolist() == ids.tolist()
        assert [s.access(i) for i in range(0, 700, 13)] == ids[::13].tolist()
        for t in {int(ids[3]), int(ids[-1]), 0, top, 2**20}:
            where = np.flatnonzero(ids == t)
            assert s.count(t) == len(where) and s.count(t, 350) == (where < 350).sum()
            assert [s.select(t, k) for k in range(len(where))][:40] == where.tolist()[:40]
        with pytest.raises(IndexError):
            s.select(int(ids[0]), 700)
    finally:
        wavelet.FRAME_BITS = old


def test_empty_shard():
    s, old = opened([])
    wavelet.FRAME_BITS = old
    assert s.n == 0 and s.tokens().tolist() == [] and s.count(0) == 0


def expected(rows):
    t = Tokenizer.from_file(WORD)
    t.encode_special_tokens = True
    at, out = 0, []
    for i, x in sorted(rows, key=lambda r: r[0]):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    return out


def test_round_trip(spark):
    rows = [(i, " ".join(f"Word{j % 17}, it's É{j}" for j in range(i % 23))) for i in range(150)] + [(900, None), (901, ""), (902, "z" * 5000)]
    df = spark.createDataFrame(rows[::-1], "doc_id long, text string").selectExpr("*", "1 as part", "2 as file")
    folder, shards = wavelet.write(df, WORD, shard_tokens=500)
    assert shards.count() >= 3
    got = sorted(tuple(r) for r in wavelet.read(folder, shards, with_ids=True).collect())
    assert got == expected(rows)
    first = shards.orderBy("part", "place").first()
    s = wavelet.open_shard(folder, first.file)
    flat = [t for r in expected(rows) for t in r[4]]
    assert [s.access(i) for i in range(50)] == flat[:50] and s.count(1) == first.shard_docs


def test_empty_table(spark):
    assert wavelet.read(*wavelet.write(spark.createDataFrame([], "doc_id long, text string"), WORD)).count() == 0


def test_runs_of_letters_take_the_light_route_with_the_library_s_ids():
    import random

    from tabulon.llm import tokens

    rng = random.Random(7)
    bits = ["a", "B", "ch", "é", "İ", "ß", "שׁ", "क़", "'s", "'t", "'", '"', "(", ".", "!", "~", "1", "23", "²", "ア", "東京", "Д", "ς", "ŉ", "ª", "Å", "̈", "ſ", "#", "|", "<|endoftext|>", "_", " ", "  ", "\n", "\t"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(2000)] + ["Plain words, (and) more words!!"]
    store = tokens.Memo(WORD, False)
    assert store.light is not None and tokens.Memo(public_tokenizers.path("byte_bpe_50k.json"), True).light is None
    sizes, ids = store.encode(texts)
    t = Tokenizer.from_file(WORD)
    t.encode_special_tokens = True
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert {"plain", "and", "(and)", "(", ")"} <= set(store.at)


def library(texts):
    t = Tokenizer.from_file(WORD)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_columns_take_nulls_slices_marks_and_white_space():
    import pyarrow as pa

    from tabulon.llm import tokens

    texts = ["cut off", None, "", " ", "H\u0331 T\u0308 h\u0331 A\u030a a\u030a", "É I\u0307 İ ΣΑΣ straße STRASSE", "a\x0bb\x0cc\x1cd\x85e\u00a0f\u3000g",
             "\tA\r\nB\0C \n", "Ÿ ŉ ſ Ŀ", "''s 's'T x's", "~ ~a~ a~b", "カ\u3099 か", "e\u0301E\u0301", "last"]
    for kind in (pa.string(), pa.large_string()):
        store = tokens.Memo(WORD, False)
        for _ in range(2):
            sizes, ids = store.encode_column(pa.array(texts, kind).slice(1, 12))
            assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == library(texts[1:13])
    got = list(tokens.encoded([pa.RecordBatch.from_pydict({"text": texts})], WORD, False, 1, characters=20))
    assert len(got) > 3 and [b.column("text")[k].as_py() for b, _, _ in got for k in range(len(b))] == texts
    assert np.concatenate([x for _, _, x in got]).tolist() == [i for x in library(texts) for i in [*x, 1]]


def test_a_full_store_keeps_the_words_in_use_only():
    from tabulon.llm import tokens

    store = tokens.Memo(WORD, False)
    store.words_kept, learnt, learn = 50, [], store._learn
    store._learn = lambda words: (learnt.extend(words), learn(words))
    for k in range(20):
        texts = [f"common words, stay {' '.join(c + 'q' * k for c in 'abcdefghijklmnopqrstuvwxyz')}"]
        sizes, ids = store.encode(texts)
        assert ids.tolist() == library(texts)[0] and len(store.at) < 50 + 4 * 30
    assert learnt.count("common") == learnt.count("words,") == learnt.count("stay") == 1


def test_shards_are_written_with_a_small_store(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(wavelet, "encoded", lambda *a, remembered=2_000_000, **_: asked.append(remembered) or iter(()))
    list(_go(wavelet._write("f", WORD, False, 1, 10)))
    assert asked and asked[0] <= 500_000


def _go(go):
    from unittest import mock

    with mock.patch("pyspark.TaskContext.get"):
        yield from go(iter(()))
