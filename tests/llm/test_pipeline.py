import re

import corpus_pipeline
from test_dedup import brute_classes, brute_substring

FIVE = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows):
    """What the first four stages leave, with a language stage that drops texts without letters."""
    rows = [(i, t) for i, t in rows if t and any(map(str.isalpha, t))]
    best = {}
    for i, t in rows:
        key = re.sub("[A-Z]", lambda m: m[0].lower(), t)
        best[key] = max(best.get(key, (-1, "")), (i, t))
    rows = sorted(best.values())
    classes = brute_classes(rows)
    rows = [(i, t) for i, t in rows if classes[i] == i]
    return {i: n - gone for i, n, gone, _ in brute_substring(rows) if gone < n or not n}


def test_stages_are_brute_force(spark, tmp_path):
    line = " ".join(f"shared{k}" for k in range(25))
    rows = [(i, " ".join(f"w{(i * 31 + k) % 997}" for k in range(10 + i))) for i in range(60)]
    rows += [(100, "12 34"), (101, None), (102, ""), (103, rows[3][1].upper()), (104, rows[40][1] + " end"), (105, "alpha " + line), (106, "beta gamma delta epsilon zeta eta theta iota kappa " + line), (107, line)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], FIVE)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.dtypes == df.dtypes, name
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    want = brute(rows)
    assert {r["doc_id"]: len((r["text"] or "").split()) for r in docs.collect()} == want
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == set(want)


def test_stages_on_edges(spark, tmp_path):
    """Null ids, null and empty texts, rows that repeat, ties of one id, extra columns and empty tables: each stage's result is defined."""
    long = " ".join(f"v{k}" for k in range(60))
    rows = [(1, "Same words here", "en", "b", 1), (1, "same words here", "en", "a", 1), (1, "same words here", "en", "a", 1), (None, "same WORDS here", "en", "a", 1), (None, long, None, None, None), (None, long + " x", "en", "a", 1), (2, "", "en", "a", 0), (2, None, "en", "a", 0), (3, "12", "en", "a", 2), (4, "other text é", None, "a", 2)]
    df = spark.createDataFrame([(*r, 7, "y") for r in rows], FIVE + ", kept int, lang_pred string").repartition(3)
    empty = df.where("false")
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
    five = FIVE.replace(",", "").split()[::2]
    got = {name: sorted((tuple(r) for r in stages[name](spark, df, str(tmp_path)).select(*five).collect()), key=repr) for name in ("language", "exact", "near", "substring")}
    assert got["language"] == sorted((r for r in rows if r[1] not in (None, "", "12")), key=repr)
    assert got["exact"] == sorted([rows[0], *rows[4:6], *rows[8:], (2, None, "en", "a", 0)], key=repr)
    # both rows of id 1 and the repeated one are one document; of the two null ids one stays
    near = [r[:2] for r in got["near"]]
    assert sorted(near, key=repr) in [sorted([*((r[0], r[1]) for r in rows[:3]), (None, t), *((r[0], r[1]) for r in rows[6:])], key=repr) for t in (long, long + " x")]
    cut = [r[1] for r in got["substring"] if r[0] is None]  # null ids come first, in the order of a hash of the text
    assert sorted(cut) == sorted(["same WORDS here", long, "x"]) and len(got["substring"]) == len(rows)
    packed = stages["packing"](spark, df, str(tmp_path))
    assert packed.where("start = 0").count() == len(rows)


def test_scratch_tables_are_dropped(spark, tmp_path):
    from tierloom.llm.shared import Scratch, dropping, path_exists

    with dropping():
        work = Scratch(spark, "test")
        work.save(spark.range(3), "a")
        assert path_exists(spark, work.path("a"))
    assert not path_exists(spark, work.root)
