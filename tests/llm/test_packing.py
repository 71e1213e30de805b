import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tabulon.llm import packing
from tabulon.llm.packing import Plan, pack, places
from tabulon.llm.tokens import Memo

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", " ", "a", " a", "a  b", "a \n b", "a\nb c\t d ", "it's don't  we'll x   y", "é́ ÀÉ ß 日本語 テスト 🙂🙂",
         "x" * 3000, "A.B,, c!! d?? 12 345 6\r\n7", "<|endoftext|> z", "\x1c a \x85 b c \x0b d \x0c e", "ΑΣ ΣΑΣ word's 'S", " lead and trail "]


def whole(path, texts):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("path,spaced", [(BYTE, True), (WORD, False)])
def test_word_memo_gives_the_ids_of_whole_texts(path, spaced):
    r = random.Random(1)
    marks = ["a", "the", "É", " ", "  ", "\n", "\t", "'s", "9", "!", " ", " ", "ß", "日"]
    texts = TEXTS + ["".join(r.choice(marks) for _ in range(r.randrange(40))) for _ in range(300)]
    m = Memo(path, spaced)
    for _ in range(2):
        sizes, ids = m.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == whole(path, texts)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)


def check(rows, out, sequence):
    want = {i: w + [0] for (i, _, _), w in zip(rows, whole(BYTE, [t or "" for _, t, _ in rows]), strict=True)}
    by, seqs = defaultdict(list), defaultdict(list)
    for p in out:
        by[p.doc_id].append(p)
        seqs[p.sequence_id].append((p.offset, p.length))
        own = want[p.doc_id][p.start:p.start + p.length]
        assert p.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes()) and p.ids == own and p.doc_tokens == len(want[p.doc_id])
    assert set(by) == set(want)
    for i, ps in by.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at
            at += p.length
        assert at == len(want[i])
    for s, parts in seqs.items():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == sequence or s == max(seqs)
    assert sorted(seqs) == list(range(len(seqs)))


def corpus(n=120):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(TEXTS) for _ in range(r.randrange(0, 30))), r.choice(["a", "a", "a", "b", "c"])) for i in range(n)]
    return rows + [(1000, None, "a"), (1001, "", None), (1002, "word " * 9000, "b")]


def test_pieces_tile_documents_and_sequences(spark):
    rows = corpus()
    for k in ({}, {"targets": {"a": 0.2, "b": 0.5, "c": 0.1}}):
        out = pack(frame(spark, rows), BYTE, sequence=64, window_sequences=4, with_ids=True, **k).collect()
        check(rows, out, 64)


def test_windows_hold_target_proportions():
    totals = {"a": 40_000, "b": 30_000, "c": 50_000}
    targets = {"a": 0.5, "b": 0.3, "c": 0.2}
    plan = Plan(totals, targets, 1000)
    place = {s: [q for _, n, p in plan.pieces(s, 0, totals[s]) for q in range(p, p + n)] for s in totals}
    assert sorted(q for x in place.values() for q in x) == list(range(120_000)) and plan.length == 120_000
    for w in range(40):
        held = Counter(s for s, x in place.items() for q in x if w * 1000 <= q < w * 1000 + 1000)
        assert all(abs(held[s] - 1000 * t) <= 1 for s, t in targets.items())
    upto = {"a": 0, "b": 40_000, "c": 70_000}
    place = {s: [q for n, p in places(0, totals[s], upto[s], upto[s] + totals[s], 120_000, 120_000, 1000) for q in range(p, p + n)] for s in totals}
    assert sorted(q for x in place.values() for q in x) == list(range(120_000))
    assert all(abs(sum(q < 7000 for q in x) - 7000 * totals[s] / 120_000) <= 1 for s, x in place.items())


def test_empty_table_and_extra_columns(spark):
    assert pack(frame(spark, []), BYTE).count() == 0
    df = frame(spark, [(1, "a b", "s")]).selectExpr("*", "7 as n", "8 as part", "9 as ids")
    assert [tuple(r)[:3] for r in pack(df, BYTE).collect()] == [(1, 0, 3)]


def test_any_number_of_sources(spark, monkeypatch):
    monkeypatch.setattr(packing, "QUEUES_PER_TASK", 1000)
    df = spark.range(200_000).selectExpr("id as doc_id", "if(id % 3 = 0, 'a b c', 'a') as text", "if(id % 5 = 0, 'large', concat('host', id % 150001)) as source").repartition(4)
    out = pack(df, BYTE, sequence=1024)
    got = out.groupBy("sequence_id").agg({"length": "sum", "offset": "max", "*": "count"}).toPandas().sort_values("sequence_id")
    full = int(out.agg({"length": "sum"}).first()[0])
    assert got["sequence_id"].tolist() == list(range(-(-full // 1024))) and (got["sum(length)"][:-1] == 1024).all()
    sizes = df.selectExpr("doc_id", "if(doc_id % 3 = 0, 4, 2) as n")
    some = out.where("sequence_id % 40 = 7").collect()
    for k in {p.sequence_id for p in some}:
        at = 0
        for p in sorted((p for p in some if p.sequence_id == k), key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
    assert out.groupBy("doc_id").agg({"length": "sum"}).join(sizes, "doc_id").where("`sum(length)` != n").count() == 0


def test_repeated_rows_are_documents_of_their_own(spark):
    rows = [(1, "a b", "s"), (1, "a b", "s"), (None, "c", "s")]
    got = sorted((r.doc_id or 0, r.start, r.length, r.sequence_id, r.doc_tokens) for r in pack(frame(spark, rows), BYTE).collect())
    assert got == [(0, 0, 2, 0, 2), (1, 0, 3, 0, 3), (1, 0, 3, 0, 3)]
