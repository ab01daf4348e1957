import random

import duckdb

from kohort.llm.token_rollup import TokenRollup, change

SIDES = "b_source string, b_lang string, b_version string, b_n_tokens long, a_source string, a_lang string, a_version string, a_n_tokens long, n_docs string, sign int"


def batch(spark, rows, before, after):
    return spark.createDataFrame([(*(b or (None,) * 4), *(a or (None,) * 4), "clash", 1) for b, a in rows], SIDES).select(*change(before and "b_", after and "a_"))


def test_totals_follow_inserts_revisions_deletes_and_replays(spark, tmp_path):
    rng = random.Random(1)
    state, rollup = {}, TokenRollup(spark, f"{tmp_path}/r")
    assert rollup.totals().collect() == []

    def fact():
        return rng.choice(["s1", "s2", None]), rng.choice(["en", "de", None]), rng.choice(["v1", "v2"]), rng.choice([None, 0, 5, 70])

    def check():
        want = {}
        for s, lang, v, n in state.values():
            d, t = want.get((s, lang, v), (0, 0))
            want[s, lang, v] = d + 1, t + (n or 0)
        got = {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}
        assert got == want

    new = {i: fact() for i in range(60)}
    state |= new
    load = batch(spark, [(None, f) for f in new.values()], None, "a_")
    assert rollup.commit("load", load)
    assert not rollup.commit("load", load)
    check()
    revised = {i: fact() for i in range(0, 60, 3)}
    assert rollup.commit("revise", batch(spark, [(state[i], f) for i, f in revised.items()], "b_", "a_"))
    state |= revised
    check()
    gone = [state.pop(i) for i in range(0, 60, 4)]
    assert rollup.commit("delete", batch(spark, [(f, None) for f in gone], "b_", None))
    assert rollup.commit("empty", load.limit(0))
    check()
    rollup.compact()
    check()
    assert not rollup.commit("load", load)
    # another handle on the same folder, and a batch whose delta was written but which never reached the log
    spark.createDataFrame([("x", "y", "z", 9, 9)], "source string, lang string, version string, n_docs long, n_tokens long").write.parquet(f"{tmp_path}/r/deltas/half")
    rollup = TokenRollup(spark, f"{tmp_path}/r")
    check()
    more = {100: ("s1", "en", "v1", 4), 101: ("s1", "en", "v1", 4)}
    state |= more
    assert rollup.commit("half", batch(spark, [(None, f) for f in more.values()], None, "a_"))
    check()
    rollup.compact()
    check()


def test_query_equals_sql(spark, folder):
    from kohort.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    got = QUERIES["op4_token_rollup"](spark, folder)
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({SQL['op4_token_rollup']})").fetchall(), key=key)
