"""Model-based check: a pure-Python list model of the item operators
(written from the survey, not from the engine) against the engine on
seeded random items and random operator chains. Ties, missing values,
multi-byte text and duplicate keys are common by construction."""

import functools
import random

import pytest

from sluice.feed import Feed
from sluice.operators.fields import map_fields, truncate
from sluice.operators.filter import _go_float_text, filter_items
from sluice.operators.limit import limit_items
from sluice.operators.merge import merge
from sluice.operators.sort import sort_items
from test_truncate import model_truncate

SCHEMA = "pos int, a bigint, b double, s string"
WORDS = ["x", "y", "Zed", "é", "naïve café", "10", "9", "", "the cat", "ÉTÉ"]


def canon(v):
    if v is None:
        return "<nil>"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return _go_float_text(v)
    return v


def m_filter(items, field, op, value):
    out = []
    for it in items:
        t = canon(it.get(field))
        ok = {"contains": lambda: value.lower() in t.lower(), "equals": lambda: t == value,
              "not-equals": lambda: t != value}.get(op, lambda: True)()
        if ok:
            out.append(it)
    return out


def m_sort(items, field, desc):
    def cmp(x, y):
        a, b = x.get(field), y.get(field)
        if isinstance(a, (int, float)) and isinstance(b, (int, float)):
            return (a > b) - (a < b)
        ta, tb = canon(a).encode(), canon(b).encode()
        return (ta > tb) - (ta < tb)
    # Python's sort is stable in both directions, like sort.SliceStable
    return sorted(items, key=functools.cmp_to_key(cmp), reverse=desc)


def m_limit(items, n):
    return items if n <= 0 or int(n) >= len(items) else items[:int(n)]


def m_dedupe(items, field):
    seen, out = set(), []
    for it in items:
        k = canon(it.get(field))
        if k not in seen:
            seen.add(k)
            out.append(it)
    return out


def m_map(items, mapping, keep):
    out = []
    for it in items:
        new = dict(it) if keep else {"pos": it["pos"]}
        for t, src in mapping.items():
            if it.get(src) is not None:
                new[t] = it[src]
        out.append(new)
    return out


def gen_items(rng, n):
    items = []
    for i in range(n):
        items.append({"pos": i,
                      "a": rng.choice([None, 0, 1, 2, 10, -3]),
                      "b": rng.choice([None, 0.5, 1.0, 2.25, 1e6, -0.0, 1e-5]),
                      "s": rng.choice([None] + WORDS)})
    return items


def gen_chain(rng):
    ops = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice(["filter", "sort", "limit", "dedupe", "map", "truncate", "merge"])
        f = rng.choice(["a", "b", "s"])
        if kind == "filter":
            ops.append((kind, f, rng.choice(["contains", "equals", "not-equals", "other"]),
                        rng.choice(["1", "x", "é", "<nil>", "1e+06", "0.5", "", "10"])))
        elif kind == "sort":
            ops.append((kind, f, rng.choice([True, False])))
        elif kind == "limit":
            ops.append((kind, rng.choice([0, 1, 3, 7, 2.9, 100])))
        elif kind == "dedupe":
            ops.append((kind, f))
        elif kind == "map":
            ops.append((kind, rng.choice([True, False])))
        elif kind == "merge":
            other = gen_items(rng, rng.randint(0, 15))
            ops.append((kind, other, rng.choice(["", "a", "b", "s"]), rng.choice(["", "a", "b", "s"]),
                        rng.choice(["", "desc", "asc"])))
        else:
            ops.append((kind, rng.choice([1, 3, 6])))
    return ops


def run_model(items, ops):
    for op in ops:
        if op[0] == "filter":
            items = m_filter(items, op[1], op[2], op[3])
        elif op[0] == "sort":
            items = m_sort(items, op[1], op[2])
        elif op[0] == "limit":
            items = m_limit(items, op[1])
        elif op[0] == "dedupe":
            items = m_dedupe(items, op[1])
        elif op[0] == "map":
            items = m_map(items, {"a": "a", "b": "b", "s": "s"}, op[1])
        elif op[0] == "merge":
            _, other, dedupe_f, sort_f, order = op
            items = items + [dict(o) for o in other]
            if dedupe_f:
                items = m_dedupe(items, dedupe_f)
            if sort_f:
                items = m_sort(items, sort_f, order == "desc")
        else:
            items = [{**it, "s": model_truncate(it["s"], op[1])} if isinstance(it.get("s"), str) else it
                     for it in items]
    return items


def run_engine(spark, items, ops):
    df = spark.createDataFrame([(i["pos"], i["a"], i["b"], i["s"]) for i in items], SCHEMA)
    f = Feed.from_table(df, "pos")
    for op in ops:
        if op[0] == "filter":
            f = filter_items(f, op[1], op[2], op[3], spark)
        elif op[0] == "sort":
            f = sort_items(f, op[1], "desc" if op[2] else "asc")
        elif op[0] == "limit":
            f = limit_items(f, op[1])
        elif op[0] == "dedupe":
            f = merge([f], dedupe_field=op[1])
        elif op[0] == "map":
            f = map_fields(f, "a:a, b:b, s:s, pos:pos", op[1])
        elif op[0] == "merge":
            _, other, dedupe_f, sort_f, order = op
            g = Feed.from_table(spark.createDataFrame([(o["pos"], o["a"], o["b"], o["s"]) for o in other],
                                                      SCHEMA), "pos")
            f = merge([f, g], dedupe_field=dedupe_f, sort_field=sort_f, sort_order=order)
        else:
            f = truncate(f, "s", op[1])
    return [r.asDict() for r in f.ordered().select("pos", "a", "b", "s").collect()]


@pytest.mark.parametrize("seed", range(60))
def test_engine_matches_list_model(spark, seed):
    rng = random.Random(seed)
    items = gen_items(rng, rng.randint(0, 40))
    ops = gen_chain(rng)
    want = [{k: it.get(k) for k in ("pos", "a", "b", "s")} for it in run_model(items, ops)]
    got = run_engine(spark, items, ops)
    assert got == want, ops
