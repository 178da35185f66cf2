"""Functions registered for SQL."""

from vellum.functions.sql import register
from vellum.params import Params


def test_sql(spark):
    register(spark, Params(min_length=5))
    a = "transform(sequence(1, 20), x -> cast(x as bigint))"
    r = spark.sql(f"select sw_align({a}, {a}, {a}, {a}) as r, sw_align({a}, null, {a}, {a}) as n, sw_align_weighted({a}, {a}, {a}, {a}, transform({a}, x -> 1.5), transform({a}, x -> 3.0)) as w").first()
    assert (r.r.score, r.r.pairs, r.w.score) == (40, 20, 60) and r.n.score is None
    got = lambda n, *p: [tuple(x)[1:] for x in spark.sql(f"select * from token_windows_of({', '.join(map(str, p))}, {n})").collect()]
    assert got(0, 275, 60, 10) == [] and got(50, 275, 60, 10) == [(0, 50)] and got(275, 275, 60, 10) == [(0, 275), (60, 275)]
    assert got(500, 275, 60, 10) == [(0, 275), (60, 335), (120, 395), (180, 455), (240, 500)] and got(276, 275, 275, 10) == [(0, 275)]
