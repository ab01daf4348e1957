import random

from kohort.llm.graph import components
from kohort.llm.sieve import sifted


def test_components_equal_union_find(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(150)] + [(5000, 5000 + i) for i in range(300)] + [(7, 7), (None, 3)]
    least = {}

    def find(x):
        while least.setdefault(x, x) != x:
            x = least[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            least[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in least}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_sieve_keeps_every_wanted_row(spark):
    rows = spark.range(5000).selectExpr("id", "cast(id % 7 as string) as s")
    wanted = rows.where("id % 50 = 3").select("id")
    kept = {r.id for r in sifted(rows, wanted, ["id"]).collect()}
    assert {r.id for r in wanted.collect()} <= kept
    assert len(kept) < 200
    assert sifted(rows, wanted.limit(0), ["id"]).count() == 0
    assert sifted(rows.limit(0), wanted, ["id"]).count() == 0
