"""License scans: an Aho-Corasick automaton finds notice phrases and identifier tags, a shunting-yard parser evaluates
the licence expressions behind the tags.

A text is read as its words (runs of 0-9, a-z and non-ASCII characters, A-Z lower-cased) with one space between, so a
phrase is found wherever its words stand consecutively, whatever marks or line ends lie between; all phrases and tags are
found in one walk. Behind a tag, on its line, the longest run of tokens that makes a whole expression of licence
identifiers, ``and``, ``or``, ``with`` and brackets counts (``with`` binds tightest, then ``and``, then ``or``).

Every licence has a burden from 0 (none) to 1 (all rights reserved): an ``or`` has that of its lighter side, an ``and`` that
of its heavier one, an exception (``with``) halves it. A document's score is the greatest burden found in it, 0 with none.

Defined cases: null text is empty text, without words, labels or score; a tag without an expression behind it adds nothing;
places that overlap all count; repeated rows and ids get rows of their own; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.shared import with_text
from tabulon.llm.terms import term_lists

# Phrases that every scan looks for, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Further notices.
NOTICES = {
    "affero general public license": "agpl", "apache license": "apache", "apache license version 2 0": "apache-2.0", "artistic license": "artistic",
    "boost software license": "bsl", "bsd license": "bsd", "cc by nc": "cc-by-nc", "cc by nc nd": "cc-by-nc-nd", "cc by nc sa": "cc-by-nc-sa",
    "cc by nd": "cc-by-nd", "cc by sa": "cc-by-sa", "cc0": "cc0", "creative commons": "cc", "eclipse public license": "epl",
    "general public license version 2": "gpl-2.0", "general public license version 3": "gpl-3.0", "isc license": "isc",
    "lesser general public license": "lgpl", "mit license": "mit", "mozilla public license": "mpl", "permission is hereby granted free of charge": "mit",
    "proprietary and confidential": "proprietary", "public domain": "public-domain",
    "redistribution and use in source and binary forms": "bsd", "zlib license": "zlib",
}
# Words after which a licence expression stands.
TAGS = ("spdx license identifier", "license expression")
# Burdens by identifier; a longer identifier takes that of its longest known beginning (gpl-2.0-only: gpl).
BURDEN = {
    "0bsd": 0.0, "agpl": 0.8, "apache": 0.2, "artistic": 0.3, "bsd": 0.1, "bsl": 0.1, "cc": 0.3, "cc-by": 0.2, "cc-by-nc": 0.8, "cc-by-nd": 0.8,
    "cc-by-sa": 0.5, "cc0": 0.0, "epl": 0.4, "gpl": 0.7, "isc": 0.1, "lgpl": 0.5, "mit": 0.1, "mpl": 0.4, "proprietary": 1.0, "public-domain": 0.0,
    "reserved": 1.0, "unlicense": 0.0, "zlib": 0.1,
}
UNKNOWN_BURDEN = 0.6

_RANK = {"or": 1, "and": 2, "with": 3}
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_LEAD = re.compile(rb"[ \t\"']*[:=]?[ \t\"']*")
_TOKEN = re.compile(rb"[ \t]*([()]|[0-9a-z][0-9a-z.+\-]*)")
_LOWER = bytes(range(256)).lower()

SCAN = """doc_id long, n_words long, notices array<struct<label:string,word:long,words:int,base:boolean,burden:double>>,
          expressions array<struct<word:long,expression:string,labels:array<string>,burden:double>>"""
_NOTICES = pa.list_(pa.struct({"label": pa.string(), "word": pa.int64(), "words": pa.int32(), "base": pa.bool_(), "burden": pa.float64()}))
_EXPRESSIONS = pa.list_(pa.struct({"word": pa.int64(), "expression": pa.string(), "labels": pa.list_(pa.string()), "burden": pa.float64()}))


def burden(name: str) -> float:
    while name not in BURDEN and "-" in name:
        name = name.rpartition("-")[0]
    return BURDEN.get(name, UNKNOWN_BURDEN)


def whole_expression(tokens: list[str]) -> list[str]:
    """The longest beginning of the tokens that is a whole expression."""
    depth, operand, best = 0, True, 0
    for k, t in enumerate(tokens):
        if operand != (t == "(" or t != ")" and t not in _RANK):
            break
        depth += (t == "(") - (t == ")")
        if depth < 0:
            break
        operand = t == "(" or t in _RANK
        if not operand and not depth:
            best = k + 1
    return tokens[:best]


def evaluate(tokens: list[str]) -> tuple[list[str], float]:
    """Labels and burden of a whole expression, operators taken from a stack by rank (shunting yard)."""
    values: list[tuple[set[str], float]] = []
    waiting: list[str] = []

    def apply():
        op, (right, heavy), (left, light) = waiting.pop(), values.pop(), values.pop()
        if op == "with":
            values.append(({f"{x} with {y}" for x in left for y in right}, light / 2))
        else:
            values.append((left | right, (min if op == "or" else max)(light, heavy)))

    for t in tokens:
        if t == "(":
            waiting.append(t)
        elif t == ")":
            while waiting[-1] != "(":
                apply()
            waiting.pop()
        elif t in _RANK:
            while waiting and _RANK.get(waiting[-1], 0) >= _RANK[t]:
                apply()
            waiting.append(t)
        else:
            values.append(({t}, burden(t)))
    while waiting:
        apply()
    return sorted(values[0][0]), values[0][1]


@cache
def _automaton():
    found = ahocorasick.Automaton()
    for phrase in {**BASE, **NOTICES, **dict.fromkeys(TAGS)}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def _expressions(raw: bytes, ends: dict[int, int]) -> list[dict]:
    """Expressions behind the tags; ends: the last word of each tag, by its first."""
    out, last = [], {e: s for s, e in ends.items()}
    text = raw.translate(_LOWER)
    for k, word in enumerate(_WORD.finditer(text)):
        if k not in last:
            continue
        at, tokens = _LEAD.match(text, word.end()).end(), []
        while m := _TOKEN.match(text, at):
            tokens.append(m[1].decode())
            at = m.end()
        if whole := whole_expression(tokens):
            labels, weight = evaluate(whole)
            out.append({"word": last[k], "expression": " ".join(whole), "labels": labels, "burden": weight})
        if len(out) == len(ends):
            break
    return out


def scan_text(words: list[bytes], raw: bytes) -> tuple[list[dict], list[dict]]:
    """(notices, expressions) of a text: its words, and its bytes."""
    text = f" {b' '.join(words).decode(errors='replace')} "
    notices, tags, at, passed = [], {}, 0, -1
    for end, phrase in _automaton().iter(text):
        passed += text.count(" ", at, end)
        at, count = end, phrase.count(" ") + 1
        first = passed - count + 1
        if phrase in TAGS:
            tags[first] = passed
        else:
            label = BASE.get(phrase) or NOTICES[phrase]
            notices.append({"label": label, "word": first, "words": count, "base": phrase in BASE, "burden": burden(label)})
    return notices, _expressions(raw, tags) if tags else []


def _scan(batches):
    for b in batches:
        sizes, notices, expressions = [], [], []
        for words, text in zip(term_lists(b.column("text")), b.column("text"), strict=True):
            found = scan_text(words, text.as_buffer().to_pybytes() if words else b"")
            sizes.append(len(words))
            notices.append(found[0])
            expressions.append(found[1])
        yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").cast(pa.int64()), "n_words": pa.array(sizes, pa.int64()),
                                          "notices": pa.array(notices, _NOTICES), "expressions": pa.array(expressions, _EXPRESSIONS)})


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, notices (label, first word, words, of the base or not, burden) and expressions (first word of the tag,
    tokens, labels, burden) of every document, in one pass without a shuffle."""
    return with_text(docs, id_col, text_col).mapInArrow(_scan, SCAN)


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def summary(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of scanned documents."""
    base = F.filter("notices", lambda x: x["base"])
    at = F.transform(base, lambda x: x["word"])
    every = F.concat(F.transform("notices", lambda x: x["label"]), F.flatten(F.transform("expressions", lambda x: x["labels"])))
    heavy = F.array_max(F.concat(F.array(F.lit(0.0)), F.transform("notices", lambda x: x["burden"]), F.transform("expressions", lambda x: x["burden"])))
    return scanned.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
                          _joined(F.transform(base, lambda x: x["label"])).alias("base_labels"), _joined(every).alias("labels"), heavy.alias("score"))
