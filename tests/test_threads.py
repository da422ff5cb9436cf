from casewell.operators import curate, threads as TH

LOG = "id long, author string, inbound boolean, parent long, created_at string, text string"


def log(spark, rows):
    return spark.createDataFrame([(i, a, inb, p, "t", x) for i, a, inb, p, x in rows], LOG)


def roots(spark, edges):
    return {r.id: r.root for r in TH.thread_roots(log(spark, [(i, "u", True, p, "") for i, p in edges])).collect()}


def test_chain_dangling_and_cycles(spark):
    got = roots(spark, [(1, None), (2, 1), (3, 2), (10, 99), (20, 20), (30, 31), (31, 32), (32, 30), (33, 31), (34, 33)])
    assert (got[1], got[2], got[3]) == (1, 1, 1)
    assert got[10] == 99
    assert got[20] == 20
    assert (got[30], got[31], got[32]) == (30, 31, 32)
    assert (got[33], got[34]) == (31, 31)


def test_deep_chain(spark):
    got = roots(spark, [(i, i - 1 if i else None) for i in range(300)])
    assert set(got.values()) == {0}


def test_members_of_a_cycle_are_its_descendants(spark):
    table = log(spark, [(i, "u", True, p, "") for i, p in [(1, 2), (2, 1), (3, 1), (5, None), (6, 5)]])
    got = {}
    for r in TH.thread_members(table, TH.thread_roots(table)).collect():
        got.setdefault(r.root, set()).add(r.id)
    assert got == {1: {1, 2, 3}, 2: {1, 2, 3}, 5: {5, 6}}


def test_threads_of_two_brands_and_third_parties(spark):
    rows = [
        (1, "u1", True, None, "my parcel is late and nobody answers"), (2, "A", False, 1, "hello"), (3, "u2", True, 2, "same"),
        (4, "b", False, 3, "hi"), (5, "A", False, 4, "again"),
        (10, "A", False, None, "news"), (11, "u", True, 10, "ok"), (12, "A", False, 11, "bye"),
    ]
    got = TH.build_threads(log(spark, rows), ["a", "B"]).collect()
    assert len(got) == 1  # the brand-opened thread is dropped
    t = got[0]
    assert (t.thread_id, t.brand, t.customer_turns) == ("1", "a", 2)
    assert [r.text for r in t.brand_replies] == ["hello", "again"]


def test_last_row_per_id(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "id long, author string, pos int")
    assert TH.last_per_id(rows, "pos").first().author == "b"


def test_leakage_check_finds_violations(spark):
    rows = curate.hash_split(spark.range(200).withColumnRenamed("id", "doc_id"), "doc_id")
    golden = rows.where("split = 'history'").limit(3)
    found = {r.check: r.n for r in curate.leakage_check(rows, golden, "doc_id").collect()}
    assert found == {"shared_ids": 0, "golden_outside_pool": 3, "split_not_reproduced": 0}
