import hashlib

import pytest
from pyspark.sql import functions as F

from compare import duck, same

from tierloom.llm import queries
from tierloom.llm.exact_dedup import DigestIndex, exact_dedup
from tierloom.llm.url_filter import rule_table, url_filter
from tierloom.llm.warc import read_warc, warc_round_trip, write_warc

DOCS = "doc_id long, text string, n int, keep_id string"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_sql(spark, sf_dir, name):
    same(queries.queries()[name](spark, sf_dir), duck(sf_dir), queries.oracle_sql()[name])


def test_exact_dedup_edges(spark):
    rows = [(1, "Ab", 0, "x"), (2, "aB", 0, "x"), (3, None, 0, "x"), (4, "", 0, "x"), (5, "É", 0, "x"), (6, "é", 0, "x"), (7, "dup", 0, "x"), (7, "dup", 0, "x"), (None, "n", 0, "x"), (8, "z" * 300_000, 0, "x")]
    got = sorted(((r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == sorted([(1, 2, 2, False), (2, 2, 2, True), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True), (6, 6, 1, True), (7, 7, 2, False), (7, 7, 2, True), (0, None, 1, True), (8, 8, 1, True)], key=str)
    assert exact_dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_exact_dedup_splits_a_hot_group(spark):
    df = spark.range(5000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same' ELSE concat('t', id) END AS text")
    got = exact_dedup(df)
    assert got.count() == 5000 and got.where("kept").count() == 5000 - 1667 + 1
    assert got.where("group_size = 1667 AND keep_id = 4998").count() == 1667


def test_digest_index_persists(spark, tmp_path):
    at = f"file://{tmp_path}/index"
    first, second = (spark.createDataFrame(r, "doc_id long, text string") for r in ([(1, "a"), (2, "b")], [(3, "A"), (4, "c"), (5, "c")]))
    assert exact_dedup(first, DigestIndex(spark, at, 3)).where("kept").count() == 2
    again = DigestIndex(spark, at)
    assert again.buckets == 3
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup(second, again).collect()}
    assert got == {3: (1, False), 4: (5, False), 5: (5, True)}
    with DigestIndex(spark, at) as index:
        assert index.table().count() == 3


def verdicts(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_batch_that_is_run_again_gets_the_same_verdicts(spark, tmp_path):
    batch = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b"), (3, "b"), (7, "c")], "doc_id long, text string")
    with DigestIndex(spark, f"file://{tmp_path}/index", 3) as index:
        exact_dedup(spark.createDataFrame([(0, "C")], "doc_id long, text string"), index)
        first = verdicts(exact_dedup(batch, index))
        assert sum(r[3] for r in first) == 2 and (7, 0, 1, False, hashlib.sha256(b"c").hexdigest()) in first
        assert verdicts(exact_dedup(batch.repartition(3), index)) == first
        assert index.table().count() == 3
        # a later batch with other rows loses to it, also where it has the same ids
        assert not any(r[3] for r in verdicts(exact_dedup(batch.where("doc_id < 3"), index)))


def test_a_batch_that_failed_within_the_append_gets_the_same_verdicts(spark, tmp_path, monkeypatch):
    batch = spark.createDataFrame([(i, f"t{i // 2}") for i in range(40)], "doc_id long, text string")
    want = verdicts(exact_dedup(batch))
    whole = DigestIndex.append

    def fails(self, groups, name):
        whole(self, groups.where("keep_id % 4 = 1"), name)
        raise RuntimeError("driver lost")

    with DigestIndex(spark, f"file://{tmp_path}/index", 3) as index:
        monkeypatch.setattr(DigestIndex, "append", fails)
        with pytest.raises(RuntimeError):
            exact_dedup(batch, index)
        monkeypatch.setattr(DigestIndex, "append", whole)
        assert 0 < index.table().count() < 20
        assert verdicts(exact_dedup(batch, index)) == want and index.table().count() == 20


def test_exact_dedup_leaves_no_table_names(spark):
    exact_dedup(spark.createDataFrame([(1, "a")], "doc_id long, text string")).collect()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("digest_index")]


RULES = [("block", "com"), ("allow", "a.com/x/"), ("block", "a.com/x/y"), ("allow", "dup.org/"), ("block", "dup.org/"), (None, "q"), ("block", None)]


def test_url_filter_edges(spark):
    urls = ["http://com", "https://b.A.com/x/z?q", "https://a.com/x/y#f", "http://xcom/", "http://z.com.x/", "ftp://dup.org/1", "nothing", None, "http://a.com?x://b.com/x", "http://.com/", "http:///p", "http://a.com/" + "x" * 50_000]
    df = spark.createDataFrame([(i, u, "v") for i, u in enumerate(urls)] + [(0, "http://com", "v")] * 3, "page_id long, url string, verdict string")
    got = url_filter(df, rule_table(spark, RULES)).collect()
    assert len(got) == len(urls) + 3
    by = {r["page_id"]: (r["host"], r["path"][:9], r["rule"], r["verdict"]) for r in got}
    assert by[0] == ("com", "", "com", "block") and by[1] == ("b.a.com", "/x/z", "a.com/x/", "allow") and by[2] == ("a.com", "/x/y", "a.com/x/y", "block")
    assert by[3] == ("xcom", "/", None, "allow") and by[4][2:] == (None, "allow") and by[5][2:] == ("dup.org/", "allow")
    assert by[6] == by[7] == ("", "", None, "allow") and by[8] == ("a.com", "", "com", "block") and by[9][2:] == ("com", "block") and by[10] == ("", "/p", None, "allow")
    assert by[11][3] == "block"
    assert url_filter(df.where("false"), rule_table(spark, RULES)).count() == 0
    assert url_filter(df, rule_table(spark, RULES).where("false"), "block").where("verdict = 'block'").count() == len(urls) + 3


def test_url_filter_many_nested_rules(spark):
    rules = [("block" if i % 2 else "allow", f"h{i % 7}.net/" + "a/" * (i % 5) + f"{i}" * (i % 3)) for i in range(60)]
    urls = [(i, f"http://s.h{i % 7}.net/" + "a/" * (i % 6) + f"{i % 60}/x") for i in range(900)]
    got = {r["page_id"]: r["rule"] for r in url_filter(spark.createDataFrame(urls, "page_id long, url string"), rule_table(spark, rules)).collect()}
    for i, u in urls:
        fit = [r for _, r in rules if u.removeprefix("http://s.").startswith(r)]
        assert got[i] == max(fit, key=len, default=None)


def test_url_filter_of_very_deep_hosts(spark):
    deep = ".".join(f"l{i}" for i in range(500)) + ".org"
    rules = [("block", f"{deep}/a/"), ("allow", "org/"), ("block", "l499.org/")]
    urls = [(1, f"http://{deep}/a/b"), (2, f"http://x.{deep}/a/b"), (3, f"http://{deep}/b"), (4, "http://a.org/"), (5, "http://l498.l499.org/q")]
    got = {r["page_id"]: r["rule"] for r in url_filter(spark.createDataFrame(urls, "page_id long, url string"), rule_table(spark, rules)).collect()}
    assert got == {1: f"{deep}/a/", 2: f"{deep}/a/", 3: "l499.org/", 4: "org/", 5: "l499.org/"}


def test_warc_reader_checks_the_index(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", "x" * 50 + str(i), 0) for i in range(4)], "page_id long, url string, html string, offset int")
    index = write_warc(df, f"file://{tmp_path}/w", f"file://{tmp_path}/i")
    wrong = index.withColumn("payload_digest", F.when(F.col("page_id") == 2, "0" * 40).otherwise(F.col("payload_digest")))
    assert {r["page_id"]: r["verified"] for r in read_warc(wrong).collect()} == {0: True, 1: True, 2: False, 3: True}


PAGES = "page_id long, url string, html string, offset int"


def test_warc_edges(spark, tmp_path):
    big = "<p>é\r\n\r\nWARC/1.1\r\n" * 100
    rows = [(1, "http://a/\r\nX: 1", big, 0), (2, "u", big, 0), (3, None, None, 0), (4, "u", "", 0), (5, "u", "small", 0), (6, "u", "small", 0), (7, "u", big + "!", 0), (7, "u", big + "!", 0), (None, "u", "x" * 2000, 0), (8, "u", "y" * 9_000_000, 0)]
    got = warc_round_trip(spark.createDataFrame(rows, PAGES).repartition(2))
    by = {r["page_id"]: r for r in got.collect()}
    assert got.count() == len(rows)
    assert (by[1]["record_type"], by[1]["refers_to"], by[1]["payload_bytes"]) == ("revisit", 2, len(big.encode()))
    assert by[1]["payload_digest"] == by[2]["payload_digest"] == hashlib.sha1(big.encode()).hexdigest()
    assert all(r["verified"] for r in by.values() if r["record_type"] == "response")
    assert {by[k]["record_type"] for k in (2, 3, 4, 5, 6, 7, 8, None)} == {"response"} and by[3]["payload_bytes"] == 0
    assert warc_round_trip(spark.createDataFrame([], PAGES)).count() == 0
    index = write_warc(spark.createDataFrame(rows, PAGES), f"file://{tmp_path}/w", f"file://{tmp_path}/i")
    assert {r["page_id"] for r in read_warc(index.where("page_id IN (2, 5)")).collect()} == {2, 5}
