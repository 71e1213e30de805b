import corpus_pipeline as P
import public_tokenizers
from tokenizers import Tokenizer

from tabulon.llm import quality
from tests.llm.test_ngram_join import brute as near_groups
from tests.llm.test_substring_dedup import brute as cut

SF = "/root/testdata/sf0.001"


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in quality.classify(docs, labels).collect() if r.predicted}
    rows = {i: t for i, t in texts(docs).items() if i in good}
    now = P.quality(spark, docs, SF)
    assert now.columns == docs.columns and texts(now) == rows
    last = {t or "": i for i, t in sorted(rows.items())}
    rows = {i: t for i, t in rows.items() if last[t or ""] == i}
    now = P.stored(P.exact_dedup(spark, now, SF), "t")
    assert now.columns == docs.columns and texts(now) == rows
    rows = {i: rows[i] for i, _, c in near_groups(list(rows.items())) if i == c}
    now = P.stored(P.near_dedup(spark, now, SF), "t")
    assert now.columns == docs.columns and texts(now) == rows
    rows = {i: t for i, (t, n) in cut(sorted(rows.items())).items() if not n or t.strip(" ")}
    now = P.stored(P.substring_dedup(spark, now, SF), "t")
    assert now.columns == docs.columns and texts(now) == rows
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    size = {i: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in rows.items()}
    got = {}
    for r in P.run(spark, SF).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == size


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(1, None, "en", "s", 0), (2, "", "en", None, None), (3, "a b c d e f", None, "s", 11), (3, "a b c d e f", None, "s", 11),
            (4, "a b c d e f", None, "s", 11), (None, "x y", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((r.doc_id or 0, r.text) for r in P.exact_dedup(spark, docs, SF).collect())
    assert kept == [(0, "x y"), (2, ""), (4, "a b c d e f")]
    assert {r.doc_id for r in P.near_dedup(spark, docs, SF).collect()} == {1, 2, 3, None}
    for _, stage in P.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0


def test_an_id_with_another_text_keeps_it(spark):
    import corpus_pipeline as P

    docs = spark.createDataFrame([(5, "A"), (5, "B"), (9, "A"), (7, "C"), (8, "C")], "doc_id long, text string")
    got = sorted(tuple(r) for r in P.exact_dedup(spark, docs, "").collect())
    assert got == [(5, "B"), (8, "C"), (9, "A")]


def test_near_copies_go_by_row(spark):
    base = [f"v{k}" for k in range(60)]
    rows = [(1, " ".join(base)), (5, " ".join([*base[:59], "x"])), (5, "an unrelated text of some words")]
    got = sorted(tuple(r) for r in P.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect())
    assert got == [rows[0], rows[2]]


def test_columns_of_any_name_and_very_long_texts_pass_through(spark):
    long = " ".join(f"w{k}" for k in range(40_000))
    names = ["__sha", "_sha", "rep", "queue", "gone", "odd", "own", "row", "dig", "doc", "spans", "__spans", "__doc", "n_removed_", "text_sha256", "score", "ids"]
    rows = [(1, long, "en", "s", 1), (2, long + " more", "en", "s", 2), (3, "short text", "en", None, 3), (3, "another short text", "en", "q", 4), (7, "short text", "de", "q", 5), (None, "short text", "de", "q", 6), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    wide = docs.selectExpr("*", *[f"'{n}' as `{n}`" for n in names])
    for stage in (P.quality, P.exact_dedup, P.near_dedup, P.substring_dedup):
        out = stage(spark, wide, SF)
        assert out.columns == wide.columns
        plain = stage(spark, docs, SF).select("doc_id", "text")
        got = out.collect()
        assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted((tuple(r) for r in plain.collect()), key=str)
        assert all(r[n] == n for r in got for n in names)
    assert P.packing(spark, wide, SF).agg({"length": "sum"}).first()[0] == P.packing(spark, docs, SF).agg({"length": "sum"}).first()[0]
