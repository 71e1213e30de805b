"""Ambiguity injection into a checklist, and scoring against several targets.

Annotations say how well a vague *label* (``amount``) could stand for a
table *attribute* (``price``): a matrix ``label, <attribute_1>, ...`` of
scores per database, used here in long form
``(db_id, label, attribute, attr_ordinal, label_ordinal, score)``.

For every test whose query mentions an attribute that some label matches
with ``score >= threshold``, each mention of such an attribute in the
question is replaced by each of its labels; the new question's
``target_queries`` are the query with the attribute replaced by every
attribute that label could mean. A question text is kept once per database
(first test, the untouched question first), and rows without a swap are
dropped.

"Mentions" is plain substring containment, as in the original tool (so an
attribute also matches inside a longer name). One walk of an Aho-Corasick
automaton over each text finds all names it holds, so the work is the text's
length and only matches become rows, which then meet their attributes by an
equi-join. Names go to the tasks in blocks of a bounded size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.compare import ALL_METRICS
from ..session import ensure_checkpoint_dir

DEFAULT_THRESHOLD = 2.0


# ------------------------------------------------------------ annotations

def long_annotations(matrix: DataFrame, db_id: str, label_col: str = "label",
                     drop_first: bool = False) -> DataFrame:
    """A score matrix (label + one numeric column per attribute) in long form.

    ``drop_first`` drops the matrix's first column (a row index in
    spreadsheet exports). Database names get ``-`` replaced by ``_``.
    """
    cols = matrix.columns[1:] if drop_first else matrix.columns
    attrs = [c for c in cols if c != label_col]
    m = matrix.withColumn("_lo", F.monotonically_increasing_id())
    stack = ", ".join(f"'{a}', {i}, CAST(`{a}` AS DOUBLE)" for i, a in enumerate(attrs))
    return m.selectExpr(
        f"'{db_id.replace('-', '_')}' AS db_id", f"`{label_col}` AS label", "_lo AS label_ordinal",
        f"stack({len(attrs)}, {stack}) AS (attribute, attr_ordinal, score)")


def map_db_names(df: DataFrame, mapping: dict[str, str], col: str = "db_id") -> DataFrame:
    """Rename database ids through a mapping (others unchanged)."""
    if not mapping:
        return df
    m = F.create_map(*[x for kv in mapping.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return df.withColumn(col, F.coalesce(F.element_at(m, F.col(col)), F.col(col)))


def labels_above(ann: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """(db_id, label, attributes): the attributes a label may mean, in column order."""
    return (ann.where(F.col("score") >= threshold)
               .groupBy("db_id", "label")
               .agg(F.sort_array(F.collect_list(F.struct("attr_ordinal", "attribute"))).alias("_a"))
               .select("db_id", "label", F.col("_a.attribute").alias("ambiguous_attributes")))


# ------------------------------------------------------- substring joins

#: Characters of the terms that one automaton holds.
TERM_CHARS = 4_000_000


def _held_terms(terms, text_at: int):
    """The rows with the distinct terms that their text holds."""
    def go(batches):
        import ahocorasick
        import pyarrow as pa

        automaton = ahocorasick.Automaton()
        for term in terms.value:
            automaton.add_word(term, term)
        automaton.make_automaton()
        for b in batches:
            found = [sorted({term for _, term in automaton.iter(text)}) if text else [] for text in b.column(text_at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.string()))], [*b.schema.names, "_terms"])
    return go


def contains_join(texts: DataFrame, text_col: str, terms: DataFrame, term_col: str,
                  keys: list[str]) -> DataFrame:
    """Rows of ``texts`` x ``terms`` (equal on ``keys``) where the text contains the term; repeated rows of texts count once.

    The distinct terms are dealt by hash into blocks of about TERM_CHARS characters; each block's automaton walks all texts.
    Null texts hold nothing, and null or empty terms are in no text.
    """
    spark = texts.sparkSession
    own = terms.select(F.col(term_col).alias("_t")).where(F.length("_t") > 0).distinct()
    blocks = (own.agg(F.coalesce(F.sum(F.length("_t")), F.lit(0))).first()[0] or 0) // TERM_CHARS + 1
    schema = T.StructType([*texts.schema.fields, T.StructField("_terms", T.ArrayType(T.StringType()))])
    found = None
    for block in range(blocks):
        some = sorted(r[0] for r in own.where(F.pmod(F.xxhash64("_t"), F.lit(blocks)) == block).collect())
        if not some:
            continue
        held = texts.mapInArrow(_held_terms(spark.sparkContext.broadcast(some), texts.columns.index(text_col)), schema)
        held = held.select(*texts.columns, F.explode("_terms").alias("_sub"))
        found = held if found is None else found.unionByName(held)
    if found is None:
        return texts.join(terms, keys).limit(0)
    return found.distinct().join(terms.withColumn("_sub", F.col(term_col)), [*keys, "_sub"]).drop("_sub")


# ---------------------------------------------------------------- inject

def ambiguous_tests(tests: DataFrame, ann: DataFrame, threshold: float = DEFAULT_THRESHOLD,
                    order_col: str = "test_id") -> DataFrame:
    """Inject ambiguity into ``tests(db_id, tbl_name, query, question, <order_col>, ...)``.

    Output: the test columns plus ``ambiguous_question, swapped_attribute,
    ambiguous_label, ambiguous_attributes array<string>, target_queries
    array<string>`` - one row per new question.
    """
    strong = ann.where(F.col("score") >= threshold)
    attrs = strong.select("db_id", "attribute").distinct()
    # Tests whose query mentions an attribute with a strong label.
    hit = contains_join(tests.select("db_id", order_col, "query"), "query", attrs, "attribute", ["db_id"])
    chosen = tests.join(hit.select("db_id", order_col).distinct(), ["db_id", order_col], "left_semi")
    # Used three times below: written once (checkpoint folder) instead of
    # re-running the test table's plan for each use.
    ensure_checkpoint_dir(tests.sparkSession)
    chosen = chosen.checkpoint(eager=True)
    # Attributes mentioned in the question, each with its strong labels.
    mentioned = contains_join(chosen.select("db_id", order_col, "question"), "question",
                              strong.select("db_id", "attribute", "attr_ordinal", "label", "label_ordinal"),
                              "attribute", ["db_id"])
    meanings = labels_above(ann, threshold)
    swaps = (mentioned.join(meanings, ["db_id", "label"])
             .select("db_id", order_col,
                     F.replace(F.col("question"), F.col("attribute"), F.col("label")).alias("ambiguous_question"),
                     F.col("attribute").alias("swapped_attribute"), F.col("label").alias("ambiguous_label"),
                     "ambiguous_attributes", F.lit(1).alias("_k"), "attr_ordinal", "label_ordinal"))
    originals = chosen.select("db_id", order_col, F.col("question").alias("ambiguous_question"),
                              F.lit(None).cast("string").alias("swapped_attribute"),
                              F.lit(None).cast("string").alias("ambiguous_label"),
                              F.lit(None).cast("array<string>").alias("ambiguous_attributes"),
                              F.lit(0).alias("_k"), F.lit(-1).cast("int").alias("attr_ordinal"),
                              F.lit(-1).cast("bigint").alias("label_ordinal"))
    cand = swaps.unionByName(originals)
    # First occurrence of each question text per database, as a grouped min
    # over (test order, untouched first, attribute, label): partial
    # aggregation keeps a question repeated by many tests cheap. Then only
    # rows with a swap.
    payload = ["swapped_attribute", "ambiguous_label", "ambiguous_attributes"]
    first = (cand.groupBy("db_id", "ambiguous_question")
             .agg(F.min(F.struct(order_col, "_k", "attr_ordinal", "label_ordinal", *payload)).alias("_f"))
             .where(F.col("_f._k") == 1)
             .select("db_id", "ambiguous_question", F.col(f"_f.{order_col}").alias(order_col),
                     *[F.col(f"_f.{c}").alias(c) for c in payload]))
    out = chosen.join(first, ["db_id", order_col])
    return out.withColumn("target_queries", F.transform(
        "ambiguous_attributes", lambda a: F.replace(F.col("query"), F.col("swapped_attribute"), a)))


# ----------------------------------------------------- best of the targets

def best_of_targets(scored: DataFrame, key_cols: list[str], metric_names: list[str] | None = None) -> DataFrame:
    """Per test, the metrics of the target with the greatest mean of non-null metrics.

    ``scored`` holds one row per (test, target query) with metric columns.
    Ties go to the first target (``target_pos``) when present.
    """
    names = [m for m in (metric_names or ALL_METRICS) if m in scored.columns]
    vals = F.array(*[F.col(m) for m in names])
    present = F.filter(vals, lambda x: x.isNotNull())
    mean = F.when(F.size(present) > 0, F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.size(present))
    tie = F.col("target_pos") if "target_pos" in scored.columns else F.lit(0)
    ranked = scored.withColumn("_mean", mean).withColumn("_tie", -tie)
    best = ranked.groupBy(*key_cols).agg(
        F.max_by(F.struct(*[F.col(m) for m in names]), F.struct(F.coalesce("_mean", F.lit(float("-inf"))), "_tie"))
        .alias("_b"))
    return best.select(*key_cols, *[F.col(f"_b.{m}").alias(m) for m in names])
