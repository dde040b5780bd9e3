import random

from pyspark.sql import functions as F

from sluice.functions.values import canonical_text, float_text
from sluice.operators.filter import _go_float_text

FIXED = [0.0, -0.0, 1.0, 12.0, 6.55, 1e6, 123456.0, 1234567.0, 1e-4, 1e-5, 0.00012, 1.5e-7,
         12345678.9, 1e21, 1e100, -2.5, 0.1, 100.0, 999999.0, 3.141592653589793, float(2 ** 53)]
# 5e-324 is left out: Java 17 prints the smallest subnormal as 4.9E-324 (not shortest)


def test_go_float_layout_python_mirror():
    assert _go_float_text(1e6) == "1e+06"
    assert _go_float_text(123456.0) == "123456"
    assert _go_float_text(0.0001) == "0.0001"
    assert _go_float_text(0.00001) == "1e-05"
    assert _go_float_text(1234567.0) == "1.234567e+06"
    assert _go_float_text(-0.0) == "-0"
    assert _go_float_text(6.55) == "6.55"


def test_float_text_column_matches_mirror(spark):
    rng = random.Random(7)
    vals = FIXED + [rng.uniform(-1e9, 1e9) for _ in range(200)] + [rng.uniform(0, 1e-3) for _ in range(100)] \
        + [float(rng.randint(-10 ** 8, 10 ** 8)) for _ in range(100)] + [round(rng.uniform(0, 1000), 2) for _ in range(100)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, x double")
    got = {r["i"]: r["t"] for r in df.select("i", float_text(F.col("x")).alias("t")).collect()}
    for i, v in enumerate(vals):
        assert got[i] == _go_float_text(v), (v, got[i])


def test_canonical_text_of_nested_values(spark):
    df = spark.createDataFrame(
        [(["a", "b"], True, {"k": 1.0, "a": 2.5}, (1, None), None)],
        "l array<string>, b boolean, m map<string,double>, s struct<z:int, a:string>, n string")
    sch = df.schema
    row = df.select(*[canonical_text(F.col(f.name), f.dataType).alias(f.name) for f in sch.fields]).first()
    assert row["l"] == "[a b]"
    assert row["b"] == "true"
    assert row["m"] == "map[a:2.5 k:1]"
    assert row["s"] == "map[z:1]"
    assert row["n"] == "<nil>"
