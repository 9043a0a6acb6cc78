"""Language-model queries against SQL, on the smallest tables."""

import pytest
from compare import DATA, connect, differences

from tidemark.llm import leakage
from tidemark.llm import queries as Q

SF = "sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_equals_sql(spark, con, name):
    assert differences(Q.QUERIES[name](spark, f"{DATA}/{SF}"), con, Q.ORACLE[name]) == ""


VALID = "len(vector) = 384 and len(list_filter(vector, lambda x: x is null or isnan(x))) = 0 and list_sum(list_transform(vector, lambda x: x * x)) > 0"
# What SQL can say of queries whose rows it can't give: a number of rows.
ROWS = {
    "p1_sources": "select count(distinct kafka_partition) from review_collisions",
    "p2_neighbours": f"""with v as (select distinct embedding_spec_hash s, review_id from review_embeddings where {VALID})
select sum(least(5, n - 1))::bigint from (select count(*) over (partition by s) n from v)""",
    "p8_ids": "select count(*) from documents",
    "p10_levels": "select count(*) from documents",
}


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE)))
def test_query_without_sql(spark, con, name):
    rows = Q.QUERIES[name](spark, f"{DATA}/{SF}").collect()
    if name in ROWS:
        assert len(rows) == con.execute(ROWS[name]).fetchone()[0]
    if name == "p1_merged":
        best = {(r.kafka_partition, r.kafka_offset) for r in Q.QUERIES["p1_found"](spark, f"{DATA}/{SF}").collect()}
        assert {(r.kafka_partition, r.kafka_offset) for r in rows if r.messages >= 2 and not r.rating_conflict} == best
        assert len({r.group for r in rows}) == len(rows)
    if name in ("p9_found", "p9_report"):
        docs, items = (dict(con.execute(f"select {k}, text from {t}").fetchall()) for t, k in (("documents", "doc_id"), ("eval_items", "item_id")))
        grams = {}
        for i, t in items.items():
            w = leakage.words(t)
            for k in range(len(w) - 9):
                grams.setdefault(tuple(w[k : k + 10]), set()).add(i)
        want = {(d, i) for d, t in docs.items() for w in [leakage.words(t)] for k in range(len(w) - 9) for i in grams.get(tuple(w[k : k + 10]), ())}
        got = {(r.doc_id, r.item_id) for r in rows if name == "p9_found" or r.longest >= 10}
        assert got == want and want
    if name == "p8_pieces":
        assert rows
    if name == "p10_found":
        levels = {r.doc_id for r in Q.QUERIES["p10_levels"](spark, f"{DATA}/{SF}").where("level = 4 and english >= 0.5").collect()}
        assert {r.doc_id for r in rows} == levels
