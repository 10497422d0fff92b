"""Accounts of entities, search queries, probable people and identity links against lists of expected results."""

from difflib import SequenceMatcher

from millrace.operators import dedupe
from millrace.plans import catalog, map as map_plans
from millrace.sources import pages

SF = "/root/testdata/sf0.001"
OWN = [True, True, True, False, True, True, False, True, False, True, False, True]


def test_accounts_named_after_their_entity(spark):
    got = catalog.QUERIES["accounts_of_entities"](spark, SF).orderBy("i").collect()
    assert [r.own for r in got] == OWN and len(map_plans.ACCOUNTS) == len(OWN)


def test_queries_take_turns(spark):
    got = {r.name: r.queries for r in catalog.QUERIES["search_queries"](spark, SF).collect()}
    assert got["NATION_0"] == ['"NATION_0" hostel fees', '"NATION_0" North hostel fees', '"NATION_0 North"', '"nation_0" North', '"NATION_0" trade', '"NATION_0" school']
    assert got["NATION_1"] == ['"NATION_1" trade', '"NATION_1" school', '"NATION_1" news', '"NATION_1" event', '"NATION_1" fees', '"NATION_1"', '"nation_1"']


def test_probable_people_agree_with_a_plain_version(spark):
    people = [(1, "Ann Lee", "1", "x"), (2, "ann  lee", "2", "x"), (3, "Ann Leigh", "1", "y"), (4, "Bob Ray", "3", ""), (5, "Bob Roy", "3", None), (6, None, "3", "x"), *((10 + i, f"Dan Shared{i}", "9", None) for i in range(300))]
    df = spark.createDataFrame(people, "key long, name string, phone string, dob string")
    want = set()
    for i, a in enumerate(people):
        for b in people[i + 1 :]:
            shared = sum(bool(x) and x == y for x, y in ((a[2], b[2]), (a[3], b[3]))) - (a[2] == b[2] == "9")
            shared += bool(a[1]) and bool(b[1]) and [a[1].lower().split()[j] for j in (0, -1)] == [b[1].lower().split()[j] for j in (0, -1)]
            like = SequenceMatcher(None, a[1].lower(), b[1].lower()).ratio() if a[1] and b[1] else 0
            if shared and like >= 0.9:
                want.add((a[0], b[0], min(1.0, round(like + 0.1 * shared, 4))))
    got = dedupe.probable_people(dedupe.blocked_pairs(df, "key", ["phone", "dob"], "name")).collect()
    assert {(r.key_a, r.key_b, r.score) for r in got} == want and want
    large = dedupe.oversize_blocks(dedupe.block_rows(df, "key", ["phone", "dob"], "name")).collect()
    assert [(r.block, r.members) for r in large] == [("phone:9", 300)]


def test_links_that_identify_a_site(spark, tmp_path):
    html = '<body><header><a href="https://x.com/own">x</a></header><p><a href="https://x.com/other">y</a></p><footer><a href="/about">a</a><a href="https://x.com/own">z</a></footer></body>'
    spark.createDataFrame([(1, "http://own.org/", html), (2, "http://own.org/contact", html), (3, "http://none.org/", None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r.site, r.target, r.area) for r in catalog.QUERIES["identity_links"](spark, str(tmp_path)).collect()}
    assert got == {("own.org", "https://x.com/own", "footer"), ("own.org", "https://x.com/other", "body")}
    assert pages.page_links(spark.read.parquet(f"{tmp_path}/pages.parquet")).where("page_id = 3").count() == 0


def test_what_lies_below_at_any_depth(spark):
    from millrace.operators.entities import claimable
    from millrace.operators.joins import below

    chain = [(i, i - 1 if i else None) for i in range(40)] + [(100, 102), (101, 100), (102, 101)]  # the last three go round
    tree = spark.createDataFrame(chain, "entity_id long, parent_id long").selectExpr("*", "case when entity_id = 20 then 'role' else 'unit' end as kind")
    roots = spark.createDataFrame([(0,), (30,), (100,), (7777,)], "root long")
    got = {(r.node, r.root) for r in below(tree, roots, "entity_id", "parent_id").collect()}
    assert got == {(i, 0) for i in range(40)} | {(i, 30) for i in range(30, 40)} | {(i, 100) for i in (100, 101, 102)}
    assets = spark.createDataFrame([(1, 39), (2, 20), (3, None), (4, 5), (5, 999), (6, 102)], "asset_id long, entity_id long")
    claims = {(r.asset_id, r.owner) for r in claimable(assets, tree, [0, 30], ("role",)).collect()}
    assert claims == {(1, 0), (1, 30), (3, 0), (3, 30), (4, 0)}


def test_the_gate_names_what_speaks_against(spark):
    from millrace.operators.graph import gate

    row = lambda *v: spark.createDataFrame([v], "holdout_recall double, seed_rate double, precision double, canary_leaks array<string>")
    before = row(0.9, 0.8, None, ["a"])
    verdict = lambda *v: tuple(gate(before, row(*v)).first())
    assert verdict(0.89, 0.8, 0.1, ["a"]) == (True, []) and verdict(0.9, 0.8, None, ["b"]) == (False, ["leaks b"]) and verdict(0.85, None, None, []) == (False, ["holdout_recall"])
    assert tuple(gate(row(1.0, 1.0, 0.9, []), row(1.0, 1.0, 0.8, [])).first()) == (False, ["precision"])


def test_ancestors_of_chains_and_circles(spark):
    from millrace.operators.joins import ancestry

    up = {i: i - 1 for i in range(1, 41)} | {100: 101, 101: 102, 102: 100, 103: 100, 104: 104}
    links = [*up.items(), *up.items(), (200, None), (None, 3)]
    want = set()
    for n in up:
        at, d, seen = up[n], 1, {n}
        while at is not None and at not in seen:
            want.add((n, at, d))
            seen.add(at)
            at, d = up.get(at), d + 1
    got = [tuple(r) for r in ancestry(spark.createDataFrame(links, "node long, parent long")).collect()]
    assert set(got) == want and len(got) == len(want) and (40, 0, 40) in want and (103, 102, 3) in want
    assert ancestry(spark.createDataFrame([], "node long, parent long")).count() == 0
