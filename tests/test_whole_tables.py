"""Queries that read a whole table give rows for all of it."""

from quillet.plans import catalog

SF = "/root/testdata/sf0.01"


def test_walk_and_citations_reach_every_part(spark):
    parts = {r.p_partkey for r in catalog.read(spark, SF, "part").select("p_partkey").collect()}
    walked = {int(r.name) for r in catalog.QUERIES["include_walk"](spark, SF).collect()}
    assert walked == {0} | {3 * p + k for p in parts for k in (1, 2, 3)}
    cited = {r.o_orderkey: r.cites for r in catalog.QUERIES["cite_resolve"](spark, SF).collect()}
    assert all(f"[{p + 1}," in cited[p] for p in parts)
    missing = {int(r.key[1:]) for r in catalog.QUERIES["missing_keys"](spark, SF).select("key").collect()}
    assert missing == set(cited) - parts
