"""The JSON renderer against a Python mirror of the reference's JSON rules."""

import json
import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sluice.sinks.gojson import render


def m_float(f: float) -> str:
    if f == 0:
        return "-0" if math.copysign(1, f) < 0 else "0"
    a = abs(f)
    if a < 1e-6 or a >= 1e21:
        r = repr(f)
        mant, _, exp = r.partition("e")
        if mant.endswith(".0"):
            mant = mant[:-2]
        sign, digits = exp[0], exp[1:].lstrip("0") or "0"
        return f"{mant}e{sign}{digits}"
    s = format(Decimal(repr(f)), "f")
    if "." in s:
        s = s.rstrip("0").rstrip(".")
    return s


def m_string(s: str) -> str:
    out = ['"']
    for ch in s:
        o = ord(ch)
        if ch in '"\\':
            out.append("\\" + ch)
        elif ch == "\n":
            out.append("\\n")
        elif ch == "\r":
            out.append("\\r")
        elif ch == "\t":
            out.append("\\t")
        elif o < 0x20 or ch in "<>&  ":
            out.append("\\u%04x" % o)
        else:
            out.append(ch)
    return "".join(out) + '"'


def m_json(v, indent=None, level=0, in_struct=False):
    inner = "" if indent is None else "\n" + indent * (level + 1)
    outer = "" if indent is None else "\n" + indent * level
    sep = ":" if indent is None else ": "
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return m_float(v)
    if isinstance(v, str):
        return m_string(v)
    if isinstance(v, list):
        if not v:
            return "[]"
        return "[" + inner + ("," + inner).join(m_json(x, indent, level + 1) for x in v) + outer + "]"
    if isinstance(v, dict):
        items = [(k, x) for k, x in sorted(v.items(), key=lambda kv: kv[0].encode()) if x is not None]
        if not items:
            return "{}"
        return "{" + inner + ("," + inner).join(m_string(k) + sep + m_json(x, indent, level + 1)
                                                 for k, x in items) + outer + "}"
    raise TypeError(v)


TEXTS = ["plain", "a<b>&c", "quote\" back\\slash", "line\nbreak\ttab\rcr", "bell\x07 esc\x1b",
         "bs\x08 ff\x0c", "u v ", "literal \\b and \\u000B", "é ü 漢字", ""]
FLOATS = [0.0, -0.0, 1.0, 6.55, 1e6, 1e7, 123456789.0, 1e20, 1e21, 1.5e21, 1e-6, 1.5e-7, 1e-5,
          0.001, 0.0001, 2.5e-4, 12345678.9, 1e100, 3.141592653589793]


@pytest.mark.parametrize("indent", [None, "  "])
def test_render_matches_mirror(spark, indent):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        rows.append((i, rng.choice(TEXTS + [None]), rng.choice(FLOATS + [None, rng.uniform(-1e9, 1e9)]),
                     rng.choice([True, False, None]),
                     [(rng.choice(TEXTS), rng.choice(FLOATS)) for _ in range(rng.randint(0, 3))],
                     {rng.choice(TEXTS): rng.choice(FLOATS) for _ in range(rng.randint(0, 2))}))
    schema = ("z_id bigint, `b<key>` string, a_num double, flag boolean, "
              "list array<struct<t:string, v:double>>, m map<string,double>")
    df = spark.createDataFrame(rows, schema)
    st = df.schema
    got = {r["z_id"]: r["j"] for r in
           df.select("z_id", render(F.struct(*[F.col(f"`{f.name}`") for f in st.fields]),
                                    st, indent).alias("j")).collect()}
    for r in rows:
        obj = {"z_id": r[0], "b<key>": r[1], "a_num": r[2], "flag": r[3],
               "list": [{"t": t, "v": v} for t, v in r[4]], "m": r[5]}
        assert got[r[0]] == m_json(obj, indent), r
        json.loads(got[r[0]])  # and it is valid JSON


def test_expressions_grow_with_the_schema_not_with_its_depth(spark):
    from pyspark.sql import types as T

    def size(depth):
        t = T.StringType()
        for _ in range(depth):
            t = T.StructType([T.StructField("a", t), T.StructField("b", T.StringType())])
        df = spark.createDataFrame([], T.StructType([T.StructField("x", t)]))
        return len(df.select(render(F.col("x"), t).alias("j"))._jdf.queryExecution().analyzed().toString())
    a, b, c = size(2), size(4), size(6)
    assert c - b < 1.6 * (b - a)


def test_each_text_is_made_once_in_every_branch(spark):
    df = spark.createDataFrame([("x",)], "a string")
    plan = df.select(render(F.struct("a"), df.schema).alias("j"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("to_json") + plan.count("toJson") <= 2 or plan.count("StructsToJson") <= 2
