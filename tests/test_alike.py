"""Names that are alike, against all pairs."""

from collections import defaultdict
from difflib import SequenceMatcher
from itertools import combinations

from millrace.operators import alike
from millrace.plans import catalog

SF = "/root/testdata/sf0.001"


def all_pairs(names, least=0.9):
    got = {}
    for a, b in combinations(sorted(set(names)), 2):
        if 2 * min(len(a), len(b)) >= least * (len(a) + len(b)):
            r = SequenceMatcher(None, a, b).ratio()
            if r >= least:
                got[a, b] = round(r, 9)
    return got


ODD = ["", " ", None, "a", "b", "ab", "abc", "abcd", "abcde", "abcdef", "bcdef", "abcdefg", "abdefg", "abcdefgh", "abcdefghi", "aaaaaaaaaaaa", "aaaaaaaaaaa", "aaaaaaaaaaaab", "ann lee", "Ann Lee", "ANN LEES", "anna leest", "annn lee", "na lee", "शर्मा राम कुमार", "शर्मा राम कुमारी", "y" * 79 + "z", "y" * 79 + "zz", "y" * 70 + "qrst uvw xyz abc", "y" * 70 + "qrst uvw xyz abcdefgh", "x" * 900, "x" * 899 + "y", "lee ann", "0123456789abcdefghi", "0123456789abcdefghij", "123456789abcdefghij"]


def test_pairs_of_odd_names_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(alike, "PART", 2)  # frequent grams in parts
    shared = [f"Dan Shared {i:03d} of the House" for i in range(30)]
    df = spark.createDataFrame(list(enumerate(ODD + shared + shared[:7])), "key long, name string")
    got = {(r.name_a, r.name_b): round(r.ratio, 9) for r in alike.alike_classes(alike.name_classes(df, "key", "name")).collect()}
    want = all_pairs([x.lower() for x in ODD + shared if x and x.strip()])
    assert got == want and len(want) > 300
    assert alike.alike_classes(alike.name_classes(df, "key", "name").limit(0)).count() == 0


def test_customers_are_linked_as_by_all_pairs(spark):
    names = {r.key: r.name.lower() for r in _customers(spark).collect()}
    members = defaultdict(list)
    for k, n in names.items():
        members[n].append(k)
    links = defaultdict(int)
    for a, b in all_pairs(names.values()):
        links[a] += len(members[b])
        links[b] += len(members[a])
    got = {(r["key"], r["class"], r.copies, r.links) for r in catalog.QUERIES["alike_people"](spark, SF).collect()}
    assert got == {(k, min(members[n]), len(members[n]), links[n]) for k, n in names.items()} and any(links.values())


def _customers(spark):
    from millrace.plans import ledgers

    return ledgers.customers(spark, SF)


def test_shared_values_however_frequent_corroborate(spark):
    people = [(i, f"Dan Shared {i:03d} of the House", "9", None if i % 2 else "d") for i in range(250)]
    people += [(900, "Ann Lee", "1", "x"), (901, "ann lee", "1", None), (902, "ann leee", "2", " X "), (903, None, "1", "x"), (904, "", "9", "d"), (905, "Zed Only", "7", "")]
    df = spark.createDataFrame(people, "key long, name string, phone string, dob string")
    got = {(r.name_a, r.name_b): set(r.agree) for r in alike.corroborated(df, "key", "name", ["phone", "dob"]).collect()}
    assert got == agreeing(people, ("phone", "dob")) and got["ann lee", "ann lee"] == {"phone"} and len(got) > 1000


def test_customers_corroborate_as_by_all_pairs(spark):
    people = [(r.key, r.name, str(r.balance), r.nation) for r in _customers(spark).collect()]
    got = {(r.name_a, r.name_b): set(r.agree) for r in catalog.QUERIES["corroborated_people"](spark, SF).collect()}
    assert got == agreeing(people, ("balance", "nation")) and got


def agreeing(people, fields):
    want = defaultdict(set)
    for a, b in combinations([p for p in people if p[1]], 2):
        low = sorted((a[1].lower(), b[1].lower()))
        if 2 * min(map(len, low)) >= 0.9 * sum(map(len, low)) and SequenceMatcher(None, *low).ratio() >= 0.9:
            want[tuple(low)] |= {f for i, f in enumerate(fields, 2) if a[i] and b[i] and a[i].strip().lower() == b[i].strip().lower()}
    return {k: v for k, v in want.items() if v}


def test_only_frequent_keys_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(alike, "settled", lambda df: df, raising=False)  # one plan
    df = spark.createDataFrame([(1, "Ann Lee")], "key long, name string")
    for found in (alike.alike_classes(alike.name_classes(df, "key", "name")), alike.alike_people(df, "key", "name"), alike.corroborated(df.selectExpr("*", "'x' as city"), "key", "name", ["city"])):
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("BroadcastHashJoin") == plan.count("BroadcastHashJoin [long#") and "SortMergeJoin" in plan


def test_cells_go_on_over_steps_and_rows_move_once(spark, monkeypatch):
    monkeypatch.setattr(alike, "PART", 3)
    monkeypatch.setattr(alike, "STEP_ROWS", 2, raising=False)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    names = [f"Dan Shared {i:03d} of the House" for i in range(24)] + ODD
    df = spark.createDataFrame(list(enumerate(names)), "key long, name string")
    try:
        got = {(r.name_a, r.name_b): round(r.ratio, 9) for r in alike.alike_classes(alike.name_classes(df, "key", "name")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == all_pairs([x.lower() for x in names if x and x.strip()])
    monkeypatch.setattr(alike, "settled", lambda df: df)  # one plan
    plan = alike.alike_classes(alike.name_classes(df, "key", "name"))._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Exchange hashpartitioning(long") == 1
