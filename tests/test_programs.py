import random

import pytest
from pyspark.sql import functions as F

from tidemark import plans
from tidemark.plans import programs
from tidemark.plans.program import Program, ProgramError, Read, State, Write
from tidemark.sources import events as ev

SF = "/root/testdata/sf0.001"


def test_popularity_golden(spark):
    views = spark.createDataFrame([(2, 100), (3, 100)], "ts long, sku long")
    run = programs.popularity().run({"views": views})
    assert run.at("all_views", 4).collect()[0].value == 2
    assert sorted((r.ts, r.views, r.total) for r in run.rows["view"].collect()) == [(2, 1, 1), (3, 2, 2)]


@pytest.fixture(scope="module")
def replies(spark):
    rows = [(10, 100, 200), (20, 100, 300), (30, 200, 300), (40, 200, 100)]
    return programs.response_times().run({"messages": spark.createDataFrame(rows, "ts long, sender long, recipient long")})


def test_response_time_golden(replies):
    value = lambda t: {r.user: r.value for r in replies.at("mean_wait", t).collect()}.get(200)
    assert value(35) is None and value(50) == 30.0


def test_response_fraction_golden(replies):
    value = lambda t: {r.user: r.value for r in replies.at("answered", t).collect()}
    assert value(35)[200] == 0.0 and value(50)[200] == 0.5 and value(51)[100] == 0.0 and 300 not in value(51)


def test_programs_equal_the_hand_built_queries(spark):
    tables = {"messages": ev.messages(spark, SF), "friendships": ev.friendships(spark, SF)}
    assert [sorted(p) for p in programs.simple_spam().compile()] == [["befriend"], ["message"], ["spam"]]
    run = programs.address_spam().run(tables)
    ids = lambda df: sorted(r.message_id for r in df.select("message_id").collect())
    assert ids(run.rows["spam"].where("is_spam")) == ids(plans.QUERIES["simple_spam_messages"](spark, SF))
    assert ids(run.rows["address_spam"].where("is_address_spam")) == ids(plans.QUERIES["ip_spam_messages"](spark, SF))
    top = {r.user: r.value for r in run.at("spam_by_user").collect()}
    assert {r.sender: r.cnt for r in plans.QUERIES["simple_top20_spammers"](spark, SF).collect()}.items() <= top.items()
    assert len(run.at("spam_users").first().value) == plans.QUERIES["simple_spam_users"](spark, SF).first().n


def test_order_of_rules_does_not_matter(spark):
    p, q = programs.popularity(), programs.popularity()
    q.rules = dict(reversed(q.rules.items()))
    assert p.compile() == q.compile()


def test_faulty_programs_are_refused():
    loop = Program(State("a", "count"))
    loop.rule("x", "e", reads={"n": Read("a")}, writes=[Write("a")])
    with pytest.raises(ProgramError, match="cyclic"):
        loop.compile()
    ring = Program(State("a", "count"), State("b", "count")).rule("x", "e", {"n": Read("a")}, writes=[Write("b")]).rule("y", "e", {"n": Read("b")}, writes=[Write("a")])
    with pytest.raises(ProgramError, match="cyclic"):
        ring.compile()
    with pytest.raises(ProgramError, match="no rule writes"):
        Program(State("a", "count")).rule("x", "e", {"n": Read("a")}).compile()
    with pytest.raises(ProgramError, match="unknown"):
        Program().rule("x", "e", {"n": Read("a")}).compile()
    with pytest.raises(ProgramError):
        Program().rule("x", "e").rule("x", "e")


def test_limited_states_expire(spark):
    p = Program(State("recent", "count", width_ms=30)).rule("w", "e", writes=[Write("recent")]).rule("r", "e", {"n": Read("recent", default=0)})
    run = p.run({"e": spark.createDataFrame([(t,) for t in (0, 10, 29, 30, 59, 100)], "ts long")})
    assert {r.ts: r.n for r in run.rows["r"].collect()} == {0: 1, 10: 2, 29: 3, 30: 3, 59: 2, 100: 1}
    assert run.at("recent", 59).first().value == 2 and run.at("recent").first().value == 0


def test_replay_one_event_after_another_agrees(spark):
    """A plain sequential replay in Python, over events with ties, against the windows."""
    rng = random.Random(4)
    friends, sent, rows, pairs = [], [], [], {}
    for i in range(600):
        t, a, b = rng.randrange(150), rng.randrange(8), rng.randrange(8)
        (friends if rng.random() < 0.15 else sent).append((t, i, a, b))
    for t, _, a, b in friends:
        pairs.setdefault((min(a, b), max(a, b)), []).append(t)
    for t, i, a, b in sent:
        known = lambda t, a, b: any(u <= t for u in pairs.get((min(a, b), max(a, b)), []))
        mine = [known(u, x, y) for u, _, x, y in sent if x == a and u <= t]
        f, nf = sum(mine), len(mine) - sum(mine)
        rows.append((i, f, nf, nf > 2 * f and f + nf > 5))
    tables = {"messages": spark.createDataFrame(sent, "ts long, message_id long, sender long, recipient long"), "friendships": spark.createDataFrame([(t, a, b) for t, _, a, b in friends], "ts long, user_a long, user_b long")}
    out = programs.simple_spam().run(tables).rows["spam"]
    assert sorted((r.message_id, r.f, r.nf, r.is_spam) for r in out.collect()) == sorted(rows)
    shuffled = {k: v.orderBy(F.rand(3)).repartition(5) for k, v in tables.items()}
    again = programs.simple_spam().run(shuffled).rows["spam"]
    assert sorted((r.message_id, r.f, r.nf, r.is_spam) for r in again.collect()) == sorted(rows)
