"""Run a registered query and its SQL on the same files and report differences."""

from __future__ import annotations

import math

import duckdb

NAMES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(directory: str):
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{directory}/{name}.parquet'")
    return con


def _norm(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), v) if v is not None else (True, "", 0) for v in r))


_KINDS = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "long", "string": "text",
          "double": "double", "float": "double", "boolean": "bool", "date": "date"}
_DUCK = {"INTEGER": "int", "BIGINT": "long", "VARCHAR": "text", "DOUBLE": "double",
         "BOOLEAN": "bool", "HUGEINT": "hugeint", "DATE": "date"}


def compare(df, con, sql) -> list[str]:
    problems = []
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    expected = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    for name, kind in df.dtypes:
        if _KINDS.get(kind, kind) != _DUCK.get(kinds[name], kinds[name]):
            problems.append(f"type of {name}: {kind} != {kinds[name]}")
    actual = [tuple(r) for r in df.collect()]
    if len(actual) != len(expected):
        problems.append(f"rows {len(actual)} != {len(expected)}")
        return problems
    left, right = _rows(df.columns, actual), _rows(names, expected)
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    if wrong:
        problems.append(f"{len(wrong)} rows differ of {len(left)}, first {wrong[0]}")
    return problems
