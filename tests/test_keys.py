"""Keys from the data against sets and counters in plain Python."""

import random
from collections import Counter

from tabulon.sources import keys as K

DDL = {"long": "long", "int": "int", "string": "string", "date": "date", "double": "double"}


def frames(spark, tables):
    """tables: name -> ({column: type}, rows)."""
    return {t: spark.createDataFrame(rows, ", ".join(f"`{c}` {k}" for c, k in cols.items())) for t, (cols, rows) in tables.items()}


def held(tables):
    """(table, column) -> (kind, counter of its values), for the columns that can be keys."""
    kind = {"long": "n", "int": "n", "string": "s", "date": "d"}
    return {(t, c): (kind[k], Counter(r[i] for r in rows if r[i] is not None)) for t, (cols, rows) in tables.items() for i, (c, k) in enumerate(cols.items()) if k in kind}


def inside(a, b):
    return bool(a[1]) and a[0] == b[0] and set(a[1]) <= set(b[1])


def some_tables(seed, wide=0):
    rng = random.Random(seed)
    keys = rng.sample(range(1000), 40)
    tables = {
        "parent": ({"id": "long", "code": "string", "x": "double"}, [(k, f"c{k}" + "z" * 70 * (k % 2), 0.5) for k in keys]),
        "child": ({"id": "long", "parent_id": "int", "code": "string"}, [(k, rng.choice([*keys[:9], None]), rng.choice([f"c{keys[0]}" + "z" * 70 * (keys[0] % 2), None])) for k in range(80)]),
        "loose": ({"id": "long", "ref": "long"}, [(k, rng.choice([*keys, 5000, 5000, 5001])) for k in range(60)]),
        "none": ({"id": "long", "code": "string"}, []),
        "empty values": ({"a b": "string"}, [(None,), (None,)]),
    }
    if wide:
        tables["wide"] = ({f"w{i}": "int" for i in range(wide)}, [tuple(rng.randint(0, 3 + i % 5) for i in range(wide)) for _ in range(30)])
    return tables


def test_column_keys_equal_sets(spark):
    for seed, wide in ((1, 0), (2, 70)):
        tables = some_tables(seed, wide)
        have = held(tables)
        got = {(r.tbl_name, r.column_name): (r.n_values, r.n_distinct, r.n_repeated, r.is_unique, r.included_in) for r in K.column_keys(frames(spark, tables)).collect()}
        assert got == {name: (sum(v.values()), len(v), sum(n > 1 for n in v.values()), bool(v) and max(v.values()) == 1,
                              sorted(f"{t}.{c}" for (t, c), o in have.items() if (t, c) != name and inside((k, v), o))) for name, (k, v) in have.items()}


def test_references_count_rows_without_a_match(spark):
    tables = some_tables(3)
    have = held(tables)
    declared = [("loose", "ref", "parent", "id"), ("child", "code", "loose", "ref"), ("child", "missing", "parent", "id"), ("parent", "x", "parent", "id")]
    got = K.references(frames(spark, tables), {"parent": ["id"], "child": ["id", "code"], "none": ["id"]}, declared).collect()
    origin = {(r.tbl_name, r.parent_column, r.child_table, r.child_column): r.origin for r in got}
    assert len(origin) == len(got)
    named = {(t, "id", p, "id") for t in ("child", "loose", "none") for p in ("parent", "none") if t != p} | {("parent", "id", "none", "id")}
    unique = {n for n, (_, v) in have.items() if v and max(v.values()) == 1}
    found = {(*a, *b) for a in have for b in unique if a[0] != b[0] and inside(have[a], have[b])}
    want = dict.fromkeys(found, "data") | dict.fromkeys(named, "name") | dict.fromkeys(declared[:2], "declared")
    assert origin == want and ("child", "parent_id", "parent", "id") in found
    for r in got:
        (ka, a), (kb, b) = have[r.tbl_name, r.parent_column], have[r.child_table, r.child_column]
        assert r.n_references == sum(a.values()) and r.n_repeated == sum(n > 1 for n in b.values())
        assert r.n_orphans == sum(n for v, n in a.items() if ka != kb or v not in b)


def test_primary_key_checks(spark):
    tables = {"t": ({"a": "long", "b": "string"}, [(1, "x"), (1, "x"), (1, "y"), (None, "x"), (None, "x"), (2, None)]), "e": ({"a": "long"}, [])}
    got = {tuple(r) for r in K.primary_key_checks(frames(spark, tables), {"t": ["a", "b"], "e": ["a"]}).collect()}
    assert got == {("t", "a,b", 6, 3, 1), ("e", "a", 0, 0, 0)}


def test_the_value_table_goes_by_sets_of_columns_not_by_values(spark):
    tables = {"a": ({"x": "long", "y": "long"}, [(k, k % 50) for k in range(400)]), "b": ({"z": "long"}, [(k // 2,) for k in range(100)])}
    rows = [(tuple(r.held), r.col, r.n_values, r.n_distinct, r.n_repeated) for r in K.value_table(frames(spark, tables)).collect()]
    assert sorted(rows) == [((0,), 0, 350, 350, 0), ((0, 1, 2), 0, 50, 50, 0), ((0, 1, 2), 1, 400, 50, 50), ((0, 1, 2), 2, 100, 50, 50)]
