"""Column expressions over tables of model responses and prompts.

All of these are Spark SQL built-ins (regex, arrays with lambdas, JSON),
so they run inside whole-stage codegen on the executors; nothing here is a
Python UDF. Each function takes and returns Columns, or DataFrames for the
table-shaped ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import quote

_WS_TRIM = r"^\s+|\s+$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x) -> Column:
    """Whitespace trimmed at both ends (newlines and tabs too, unlike ``trim``)."""
    return F.regexp_replace(_c(x), _WS_TRIM, "")


def final_answer(text) -> Column:
    """The last ``<answer>..</answer>`` span (without backtick fences and the word
    ``sql``, trimmed), else the last fenced ``sql`` block (trimmed), else the text."""
    t = _c(text)
    ans = F.try_element_at(F.regexp_extract_all(t, F.lit(r"(?s)<answer>(.*?)</answer>"), 1), F.lit(-1))
    ans = strip(F.replace(F.replace(ans, F.lit("```"), F.lit("")), F.lit("sql"), F.lit("")))
    block = strip(F.try_element_at(F.regexp_extract_all(t, F.lit(r"(?s)```sql(.*?)```"), 1), F.lit(-1)))
    return F.coalesce(ans, block, t)


def code_block(text) -> Column:
    """The first fenced ``python`` block (trimmed), else the empty string."""
    return strip(F.regexp_extract(_c(text), r"(?s)```python\s+(.*?)```", 1))


def runtime_seconds(text) -> Column:
    """``Runtime: <number>`` as a double, else null."""
    v = F.regexp_extract(_c(text), r"Runtime:\s*([0-9.]+)", 1)
    return F.when(v != "", v.try_cast("double"))


def _balanced_pattern(depth: int) -> str:
    """Regex for one ``[...]`` with brackets nested at most ``depth`` levels.

    Possessive quantifiers: no backtracking, linear in the text length.
    """
    p = r"\[[^\[\]]*+\]"
    for _ in range(depth - 1):
        p = r"\[(?:[^\[\]]++|" + p + r")*+\]"
    return p


_BALANCED = "^(" + _balanced_pattern(8) + ")"


def balanced_span(text) -> Column:
    """The first balanced ``[...]`` span starting at the first ``[``; null if none or unbalanced.

    A regex settles spans nested up to 8 levels inside codegen; only other
    texts (deeper, or unbalanced) take one exact left-to-right pass over
    the characters (``aggregate`` over ``split(s, '')``).
    """
    t = _c(text)
    start = F.instr(t, "[")
    rest = F.substring(t, start, F.length(t))
    fast = F.regexp_extract(rest, _BALANCED, 1)
    chars = F.split(rest, "")

    def step(acc, ch):
        depth = (acc["depth"] + F.when(ch == "[", 1).when(ch == "]", -1).otherwise(0))
        pos = acc["pos"] + 1
        end = F.when((acc["end"] == 0) & (depth == 0), pos).otherwise(acc["end"])
        return F.struct(depth.alias("depth"), pos.alias("pos"), end.alias("end"))

    init = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("pos"), F.lit(0).alias("end"))
    end = F.aggregate(chars, init, step)["end"]
    slow = F.when(end > 0, F.substring(rest, 1, end))
    return F.when(start > 0, F.coalesce(F.when(fast != "", fast), slow))


#: A quoted string of a Python literal, what stands for it while the rest is read, and the mark of a string's cell.
_QUOTED = r"""(?s)'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+\""""
_HOLE, _MARK = "\ue001", "\ue002"
#: Outside of strings, in this order: names, numbers (as strings, so that no digit is lost), brackets around one value, tuples
#: as lists, the comma at a list's end.
_OUTSIDE = [(r"\bNone\b", "null"), (r"\bTrue\b", "true"), (r"\bFalse\b", "false"),
            (r"(?<![\w.+-])([+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|nan|inf|NaN|Infinity))(?![\w.])", '"$1"'),
            (r"\(([^()\[\],]*[^()\[\],\s][^()\[\],]*)\)", "$1"),
            (r"\(", "["), (r"\)", "]"), (r",(\s*\])", "$1")]
#: Inside of strings, after an even number of backslashes: escapes that JSON writes otherwise or not at all.
_INSIDE = [(r"\\x([0-9a-fA-F]{2})", r"\\u00$2"), (r"\\0(?![0-7])", r"\\u0000"), (r"\\a", r"\\u0007"), (r"\\v", r"\\u000b"), (r"\\'", "'"), ('"', r'\\"'),
           (r"\\([^\\\"bfnrtu])", r"\\\\$2")]
_JSON = {"allowUnquotedControlChars": "true"}


def _json_string(quoted: Column, mark: str) -> Column:
    """A quoted Python string as a JSON string."""
    plain = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    fixed = plain
    for pattern, to in _INSIDE:
        fixed = F.regexp_replace(fixed, r"(?<!\\)((?:\\\\)*)" + pattern, "$1" + to)
    return F.concat(F.lit('"' + mark), F.when(plain.contains("\\") | plain.contains('"'), fixed).otherwise(plain), F.lit('"'))


def _outside(text: Column) -> Column:
    """A printed Python literal with a hole for each string, its values and brackets as in JSON."""
    out = F.regexp_replace(text, _QUOTED, _HOLE)
    for pattern, to in _OUTSIDE:
        out = F.regexp_replace(out, pattern, to)
    return out


def _filled(outside: Column, strings: Column, mark: str = "") -> Column:
    """JSON text: the holes filled with the strings in order."""
    between = F.split(outside, _HOLE)
    return F.array_join(F.zip_with(between, F.transform(strings, lambda x: _json_string(x, mark)), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def _rows(outside: Column, json: Column) -> Column:
    """Rows of a list of lists; a list of values is one row; null for anything else."""
    nested = outside.rlike(r"^\s*\[\s*(\[|\]\s*$)")
    flat = F.from_json(F.when(outside.rlike(r"^\s*\[[^\[]*$"), json), "array<string>", _JSON)
    return F.when(nested, F.from_json(json, "array<array<string>>", _JSON)).otherwise(F.when(flat.isNotNull(), F.array(flat)))


def _let(value: Column, f) -> Column:
    """``f`` of a value that is computed once (a one-element transform)."""
    return F.element_at(F.transform(F.array(value), f), 1)


def rows_from_text(text, span: bool = True, mark: str = "") -> Column:
    """Rows (``array<array<string>>``) from a printed Python list; a flat list is one row.

    With ``span`` the first balanced bracket span is parsed (as in tool output). Lists and tuples (``('x',)`` too) are rows,
    ``None`` is null, strings are read with their escapes; text that is no such literal gives null. Cells keep their printed
    text (``1`` stays ``"1"``, ``True`` is ``"true"``), a list inside a row is a cell with its JSON text. ``mark`` stands
    before the text of quoted cells.
    """
    src = balanced_span(text) if span else _c(text)
    parts = _let(src, lambda s: F.struct(F.regexp_extract_all(s, F.lit(_QUOTED), F.lit(0)).alias("strings"), _outside(s).alias("outside")))
    return _let(parts, lambda p: _rows(p["outside"], _filled(p["outside"], p["strings"], mark)))


def typed_rows(text, span: bool = True) -> Column:
    """``rows_from_text`` with each cell as ``struct<text, quoted>``: quoted cells are text even if they look like numbers.

    Every quoted string gets a mark after its opening quote before parsing; the mark is read and removed here.
    """
    def cell(x):
        quoted = F.coalesce(x.startswith(_MARK), F.lit(False))
        return F.struct(F.when(quoted, F.substring(x, 2, 1 << 30)).otherwise(x).alias("text"), quoted.alias("quoted"))

    return F.transform(rows_from_text(text, span, _MARK), lambda r: F.transform(r, cell))


def parse_rows(df: DataFrame, text_col: str, out_col: str = "rows", span: bool = True) -> DataFrame:
    """``rows_from_text`` as DataFrame steps: span, strings and the text around them are columns of their own, computed once
    per row, instead of one nested expression."""
    src = balanced_span(text_col) if span else F.col(text_col)
    d = df.withColumn("_span", src)
    d = d.withColumn("_strings", F.regexp_extract_all("_span", F.lit(_QUOTED), F.lit(0))).withColumn("_outside", _outside(F.col("_span")))
    d = d.withColumn("_json", _filled(F.col("_outside"), F.col("_strings")))
    return d.withColumn(out_col, _rows(F.col("_outside"), F.col("_json"))).drop("_span", "_strings", "_outside", "_json")


def table_from_json(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """``<json>..</json>`` after a ``Table Name: <x>.csv`` line, as rows ``(id, row_pos, record)``.

    Single quotes are read as double quotes; records are ``map<string,string>``.
    A response without both markers, or with text that does not parse, gives no rows.
    """
    t = F.col(text_col)
    ok = t.rlike(r"Table Name:\s*\S+\.csv") & t.rlike(r"(?s)<json>.*?</json>")
    body = F.replace(F.regexp_extract(t, r"(?s)<json>(.*?)</json>", 1), F.lit("'"), F.lit('"'))
    recs = F.from_json(body, "array<map<string,string>>")
    return (df.where(ok).select(F.col(id_col), F.posexplode(recs).alias("row_pos", "record")))


def unescape_newlines(text) -> Column:
    r"""Literal ``\n`` sequences turned into newlines."""
    return F.replace(_c(text), F.lit("\\n"), F.lit("\n"))


def clamped_score(values, lo: float = 1.0, hi: float = 10.0) -> Column:
    """``(sum - lo) / (hi - lo)`` clamped to [0, 1]; 0 for an empty or null list."""
    v = _c(values)
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (total - lo) / (hi - lo)))
    return F.when(F.coalesce(F.size(v), F.lit(0)) > 0, score).otherwise(F.lit(0.0))


def token_count(text) -> Column:
    """Whitespace-separated words (the budget unit of ``crop_to_budget``)."""
    s = strip(text)
    return F.when(s == "", F.lit(0)).otherwise(F.size(F.split(s, r"\s+")))


def crop_to_budget(entries, budget: int = 2048, floor: int = 4, max_halvings: int = 64) -> Column:
    """Keep a prefix of ``entries``: while their joined text is over ``budget``
    words and more than ``floor`` entries remain, keep the first
    ``round(n / 2)`` (half to even)."""
    e = _c(entries)
    counts = F.transform(e, lambda x: token_count(x))

    def tokens(m):
        return F.aggregate(F.slice(counts, 1, m), F.lit(0), lambda a, x: a + x)

    def step(acc, _):
        m = acc["m"]
        stop = acc["done"] | (tokens(m) <= budget) | (m <= floor)
        nm = F.when(stop, m).otherwise(F.bround(m / 2.0, 0).cast("int"))
        return F.struct(nm.alias("m"), stop.alias("done"))

    init = F.struct(F.size(e).alias("m"), F.lit(False).alias("done"))
    # A list of n entries needs at most log2(n) + 2 halvings.
    steps = F.least(F.lit(max_halvings), F.ceil(F.log2(F.size(e) + 1)).cast("int") + 2)
    m = F.aggregate(F.sequence(F.lit(1), steps), init, step)["m"]
    return F.when(e.isNotNull(), F.slice(e, 1, F.greatest(m, F.lit(0))))


def crop_entries(df: DataFrame, entries_col: str, out_col: str, budget: int = 2048, floor: int = 4,
                 halvings: int | None = None) -> DataFrame:
    """``crop_to_budget`` as DataFrame steps, all in codegen.

    The halving steps are unrolled as columns; a step counts the words of
    the joined prefix (``array_join`` + ``split``) only while not yet done.
    The number of steps is ``ceil(log2(longest list + 1)) + 2``, read with
    one aggregate over the list sizes unless ``halvings`` is given, so the
    generated code stays small enough to compile.
    """
    e = F.col(entries_col)
    if halvings is None:
        longest = df.agg(F.max(F.size(e))).first()[0] or 0
        halvings = math.ceil(math.log2(longest + 1)) + 2

    def tokens(m):
        s = strip(F.array_join(F.slice(e, 1, m), " "))
        return F.when(s == "", F.lit(0)).otherwise(F.size(F.split(s, r"\s+")))

    d = df.withColumn("_m", F.size(e)).withColumn("_done", F.lit(False))
    for _ in range(halvings):
        stop = F.col("_done") | (F.col("_m") <= floor) | (tokens(F.col("_m")) <= budget)
        d = d.withColumn("_done", stop).withColumn(
            "_m", F.when(F.col("_done"), F.col("_m")).otherwise(F.bround(F.col("_m") / 2.0, 0).cast("int")))
    return d.withColumn(out_col, F.when(e.isNotNull(), F.slice(e, 1, F.greatest(F.col("_m"), F.lit(0))))) \
            .drop("_m", "_done")


# ------------------------------------------------------ prompts and samples

def schema_text(catalog: DataFrame) -> DataFrame:
    """(tbl_name, db_schema): ``Table t(col type, ...)`` per table, columns in order."""
    col = F.concat_ws(" ", "column_name", "column_type")
    return (catalog.groupBy("tbl_name")
                   .agg(F.sort_array(F.collect_list(F.struct("ordinal", col.alias("c")))).alias("_c"))
                   .select("tbl_name", F.concat(F.lit("Table "), F.col("tbl_name"), F.lit("("),
                                                F.array_join(F.col("_c.c"), ", "), F.lit(")")).alias("db_schema")))


def record_text(df: DataFrame) -> Column:
    """A row as a Python-style record: ``{'col': 'text', 'n': 1, 'x': None}``.

    Strings are single-quoted (inner quotes escaped), booleans ``True/False``,
    nulls ``None``, other values as their text.
    """
    items = []
    for f in df.schema.fields:
        x = F.col(quote(f.name))
        name = f.name.replace("'", "\\'")
        if f.dataType.typeName() == "string":
            v = F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("\\'")), F.lit("'"))
        elif f.dataType.typeName() == "boolean":
            v = F.when(x, F.lit("True")).otherwise(F.lit("False"))
        else:
            v = x.cast("string")
        items.append(F.concat(F.lit(f"'{name}': "), F.coalesce(v, F.lit("None"))))
    return F.concat(F.lit("{"), F.concat_ws(", ", *items), F.lit("}"))


def sample_rows(tables: dict[str, DataFrame], n: int = 3,
                primary_keys: dict[str, list[str]] | None = None) -> DataFrame:
    """(tbl_name, entries array<string>): the first ``n`` rows of each table as records.

    First by primary key when declared (one ``TakeOrderedAndProject`` per
    table), else by an md5 of the row. Records are Python-style text
    (:func:`record_text`), as sample rows appear in prompts.
    """
    parts = []
    for t, df in tables.items():
        pk = (primary_keys or {}).get(t)
        key = [F.col(quote(c)) for c in pk] if pk else [F.md5(F.to_json(F.struct(*[F.col(quote(c)) for c in df.columns])))]
        first = df.select(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(key)]).alias("_o"),
                          record_text(df).alias("rec")) \
                  .orderBy("_o").limit(n)
        parts.append(first.groupBy().agg(F.sort_array(F.collect_list(F.struct("_o", "rec"))).alias("_r"))
                     .select(F.lit(t).alias("tbl_name"), F.col("_r.rec").alias("entries")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def prompt_table(tests: DataFrame, schemas: DataFrame, samples: DataFrame, template: str,
                 question_col: str = "question") -> DataFrame:
    """Tests joined with their table's schema text and sample rows; ``prompt`` filled in.

    ``template`` holds ``{question}`` and ``{db_schema}``; the sample rows
    are appended as `` Some instances: [...]``.
    """
    j = tests.join(schemas, "tbl_name", "left").join(samples, "tbl_name", "left")
    filled = F.replace(F.replace(F.lit(template), F.lit("{db_schema}"), F.coalesce("db_schema", F.lit(""))),
                       F.lit("{question}"), F.col(question_col))
    entries = F.concat(F.lit("["), F.array_join(F.coalesce("entries", F.array().cast("array<string>")), ", "),
                       F.lit("]"))
    return j.withColumn("prompt", F.concat(filled, F.lit(" Some instances: "), entries))


# Our own short prompt templates (the task wording is free; the fields are
# the same: question, schema, sample rows).
PROMPTS = {
    "text2sql": "Write one SQL query that answers the question. Schema: {db_schema}. Question: {question}. "
                "Put the query between <answer> and </answer>.",
    "text2answer": "Answer the question with the rows of the result as a Python list of lists. "
                   "Schema: {db_schema}. Question: {question}.",
    "python": "Write Python code that prints the answer as a list of lists. Schema: {db_schema}. "
              "Question: {question}.",
}


def cost_summary(responses: DataFrame, metric_cols: list[str]) -> DataFrame:
    """Per model: total cost, mean time and mean of every metric."""
    aggs = [F.sum("cost").alias("total_cost"), F.avg("time").alias("mean_time"), F.count("*").alias("n")]
    aggs += [F.avg(m).alias(f"mean_{m}") for m in metric_cols]
    return responses.groupBy("model").agg(*aggs)
