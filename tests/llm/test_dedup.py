import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tierloom.llm import components as components_module
from tierloom.llm import near_dedup
from tierloom.llm.components import components
from tierloom.llm.near_dedup import elements, near_classes, signatures
from tierloom.llm.shared import Scratch
from tierloom.llm.substring import substring_dedup
from tierloom.llm.words import buffers, words


def brute_substring(rows):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: r[0]):
        ws = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(ws)
        for s in range(len(ws) - 19):
            key = tuple(ws[s : s + 20])
            if key in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(key)
        kept = " ".join(w for w, g in zip(ws, gone) if not g)
        out.append((i, len(ws), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def texts(seed, n):
    r = random.Random(seed)
    passages = [[r.choice("abcdefgh") + str(r.randrange(40)) for _ in range(r.randrange(15, 80))] for _ in range(12)]
    out = []
    for i in range(n):
        ws = []
        for _ in range(r.randrange(6)):
            kind = r.random()
            if kind < 0.3:
                a = r.randrange(60)
                ws += r.choice(passages)[max(0, a - 30) : a + 30]
            elif kind < 0.5:
                ws += [r.choice("xyz")] * r.randrange(60)
            elif kind < 0.6:
                ws += list("pqrst")[: r.randrange(1, 6)] * r.randrange(20)
            elif kind < 0.7 and out:
                ws += (r.choice(out)[1] or "").split()[: r.randrange(100)]
            else:
                ws += [f"{r.randrange(10000)}é" for _ in range(r.randrange(50))]
        out.append((i, r.choice([" ", "\n\t", "   "]).join(ws) if i % 17 else r.choice([None, "", " \u00a0"])))
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_substring_dedup_is_brute_force(spark, seed):
    rows = texts(seed, 120)
    got = substring_dedup(spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, n_words string").repartition(3)).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute_substring(rows)
    for r in got:
        assert sum(x["length"] for x in r["repeats"]) == r["n_removed"]
        assert hashlib.sha256(" ".join(re.findall(r"[^\x20\x09-\x0D]+", r["kept_text"])).encode()).hexdigest() == r["kept_sha256"]


def test_substring_dedup_repeated_ids_and_empty(spark):
    line = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(5, line), (5, line), (-3, line), (None, "x"), (7, "a b " * 100_000)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in substring_dedup(df).collect())
    assert got == [(-3, 0), (0, 0), (5, 30), (5, 30), (7, 199_998)]
    assert substring_dedup(df.where("false")).count() == 0


def test_substring_dedup_extends_matches_both_ways(spark):
    """Of an anchor's occurrences the first matches a later one in part; what leaves that match repeats a third."""
    x = [f"x{i}" for i in range(60)]
    a, b, c, d = ([f"{k}{i}" for i in range(40)] for k in "abcd")
    rows = [a + x[18:40] + b, c + x[10:32] + d, x[:60], b[::-1] + x[5:55] + a[::-1], x[20:39] + c, x[20:40] + d, ["z"] * 45, x[20:40]]
    rows = [(i, " ".join(t)) for i, t in enumerate(rows)]
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute_substring(rows)
    assert {r["doc_id"]: [tuple(x) for x in r["repeats"]] for r in got}[2] == [(10, 30)]


def shingles(t):
    w = t.split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 1.0


def test_signatures_estimate_weighted_jaccard():
    r = random.Random(0)
    base = [f"w{r.randrange(99999)}" for _ in range(400)]
    ts = []
    for k in (0, 2, 5, 10, 20, 40):
        x = list(base)
        for i in r.sample(range(400), k):
            x[i] = f"z{r.randrange(10**6)}"
        ts.append(" ".join(x))
    ts += [" ".join(base[:200] * 2), "one", "x y z " * 400]
    data, offsets = buffers(pa.array(ts))
    s = signatures(*elements(words(data, offsets, 0, len(ts)), len(ts)), len(ts), 2048)
    for i, t in enumerate(ts):
        assert np.mean(s[0] == s[i]) == pytest.approx(similarity(shingles(ts[0]), shingles(t)), abs=0.04)


def brute_classes(rows):
    grams = [shingles(t.lower()) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and similarity(grams[i], grams[j]) >= 0.8:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return {r[0]: rows[x][0] for r, x in zip(rows, label)}


def test_near_classes_are_brute_force(spark):
    r, rows = random.Random(4), []
    for i in range(220):
        kind = r.random()
        if kind < 0.5 and rows:
            x = r.choice(rows)[1].split()
            for _ in range(r.randrange(12) if x else 0):
                x[r.randrange(len(x))] = f"q{r.randrange(10**6)}"
            rows.append((i, " ".join(x)))
        else:
            rows.append((i, r.choice(["", "a", "a b c", " ", "A  b C"]) if kind < 0.6 else " ".join(f"w{r.randrange(99999)}" for _ in range(r.randrange(1, 300)))))
    df = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, class_id int").repartition(3)
    got = near_classes(df).collect()
    assert {x["doc_id"]: x["class_id"] for x in got} == brute_classes(rows)
    assert all(x["kept"] == (x["doc_id"] == x["class_id"]) for x in got)


def test_near_classes_of_large_buckets_are_brute_force(spark, monkeypatch):
    """Families around one text, some of whose members are like other members alone, in buckets that are all large."""
    monkeypatch.setattr(near_dedup, "SMALL", 3)
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    r = random.Random(6)
    base = [f"w{i}" for i in range(400)]
    rows = [(0, " ".join(base))]
    for i in range(1, 160):
        x = r.choice(rows)[1].split() if i % 3 else list(base)
        for k in r.sample(range(400), r.randrange(1, 14)):
            x[k] = f"q{r.randrange(10**6)}"
        rows.append((i, " ".join(x)))
    got = near_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    want = brute_classes(rows)
    assert 1 < len(set(want.values())) < 100
    assert {x["doc_id"]: x["class_id"] for x in got.collect()} == want


def test_near_classes_of_large_buckets_without_a_hub_are_brute_force(spark, monkeypatch):
    """Pairs of near copies in large buckets of texts that aren't near each other: each band that a bucket is dealt by may part a pair."""
    monkeypatch.setattr(near_dedup, "SMALL", 3)
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "SIGNATURES", 16, raising=False)
    monkeypatch.setattr(near_dedup, "OFFSETS", ((1,), (2,), (3,)))  # which bands these are must not matter
    r = random.Random(8)
    rows = []
    for i in range(300):
        x = rows[-1][1].split() if i % 2 else [f"w{k}" for k in range(400)]
        for k in r.sample(range(400), 8 if i % 2 else 7):
            x[k] = f"q{r.randrange(10**6)}"
        rows.append((i, " ".join(x)))
    got = near_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    want = brute_classes(rows)
    assert 100 < len(set(want.values())) <= 160
    assert {x["doc_id"]: x["class_id"] for x in got.collect()} == want


def test_near_classes_of_versions_of_one_id(spark):
    one, other = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(1, one), (1, other), (2, one), (3, other), (4, "c d e f g")]
    got = near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x["doc_id"], x["class_id"], x["class_size"]) for x in got) == [(1, 1, 4), (1, 1, 4), (2, 1, 4), (3, 1, 4), (4, 4, 1)]


def test_near_classes_of_all_versions_and_null_ids(spark):
    def near(c):
        return [" ".join(f"{c}{i}" for i in range(n)) for n in (60, 61)]

    (a, a2), (b, b2), (c, c2), (d, d2) = map(near, "abcd")
    rows = [(1, a), (1, b), (2, a2), (3, b2), (4, c), (None, c2), (None, d), (None, d2), (5, a), (5, "e f g h i"), (6, "e f g h i")]
    got = near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(x["doc_id"], x["class_id"], x["class_size"]) for x in got} == {(i, 1, 7) for i in (1, 2, 3, 5, 6)} | {(4, 4, 2), (None, 4, 2), (None, None, 2)}
    assert all(x["kept"] == (x["doc_id"] == x["class_id"]) for x in got if x["class_id"] is not None)
    assert sorted(x["kept"] for x in got if x["class_id"] is None) == [False, True]


def test_near_copies_of_each_version_of_many_ids_are_linked(spark):
    r = random.Random(3)

    def text():
        return [f"w{r.randrange(10**6)}" for _ in range(80)]

    rows = []
    for i in range(40):
        for k, t in enumerate((text(), text())):
            rows += [(i, " ".join(t)), (100 + 2 * i + k, " ".join([*t, "end"]))]
    got = near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {(x["doc_id"], x["class_id"]) for x in got} == {(i, i) for i in range(40)} | {(100 + 2 * i + k, i) for i in range(40) for k in (0, 1)}


def test_near_classes_of_a_hot_repeated_row(spark):
    t = " ".join(f"w{i}" for i in range(60))
    rows = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id + 10 END AS doc_id", f"CASE WHEN id % 3 = 0 THEN '{t}' WHEN id = 1 THEN '{t} end' ELSE concat('t', id) END AS text")
    got = near_classes(rows)
    assert got.where("class_id = 7 AND class_size = 1001").count() == 1001 and got.where("kept").count() == 3000 - 1


def test_near_classes_refuse_thresholds_that_signatures_would_miss(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f g")], "doc_id long, text string")
    for low in (0.6, 0.79, float("nan")):
        with pytest.raises(ValueError):
            near_classes(df, low)
    assert {x["class_id"] for x in near_classes(df, 0.9).collect()} == {1, 2}


@pytest.mark.parametrize("kind", ["chain", "star", "random"])
def test_components(spark, kind):
    r = random.Random(1)
    links = {"chain": [(i, i + 1) for i in range(200)], "star": [(7, i) for i in range(200) if i != 7], "random": [(r.randrange(300), r.randrange(300)) for _ in range(180)]}[kind]
    links = [x for x in links if x[0] != x[1]]
    label = {x: x for e in links for x in e}
    for a, b in links:
        a, b = label[a], label[b]
        label = {k: a if v == b else v for k, v in label.items()}
    got = {x["id"]: x["label"] for x in components(Scratch(spark, "test"), spark.createDataFrame(links, "a long, b long")).collect()}
    assert got.keys() == label.keys() and all(got[v] == v for v in got.values())
    assert len(set(got.values())) == len(set(label.values())) == len({(got[k], label[k]) for k in got})


@pytest.mark.parametrize("most", [0, 60, 1 << 18])
def test_components_are_the_same_wherever_links_are_joined(spark, monkeypatch, most):
    monkeypatch.setattr(components_module, "ON_DRIVER", most, raising=False)
    links = [(i, i + 1) for i in range(150)] + [(200, i) for i in range(201, 260)] + [(300, 301), (301, 300), (2**60, 302)]
    got = {x["id"]: x["label"] for x in components(Scratch(spark, "test"), spark.createDataFrame(links, "a long, b long")).collect()}
    groups = [set(range(151)), set(range(200, 260)), {300, 301}, {302, 2**60}]
    assert got.keys() == set().union(*groups)
    assert all(len({got[x] for x in g}) == 1 and got[min(g)] in g for g in groups)


def test_components_of_few_links_take_few_jobs(spark):
    """Each pass by shuffles is some ten jobs of as many tasks as there are shuffle partitions, however few links there are."""
    sc = spark.sparkContext
    links = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    sc.setJobGroup("few-links", "components of few links")
    try:
        components(Scratch(spark, "test"), links)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(sc.statusTracker().getJobIdsForGroup("few-links")) <= 8


def test_near_classes_of_a_large_group_and_edges(spark):
    r = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 300):
        x = list(base)
        x[r.randrange(300)] = f"q{i}"
        rows.append((i, " ".join(x)))
    rows += [(500, None), (501, ""), (None, "alone in here"), (502, "alone in here"), (502, "alone in here"), (503, "long " * 60_000)]
    got = near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert {x["class_id"] for x in got if x["doc_id"] is not None and x["doc_id"] < 300} == {0}
    assert {x["class_id"] for x in got if x["doc_id"] in (500, 501)} == {500} and {x["class_id"] for x in got if x["doc_id"] in (None, 502)} == {502}
    assert near_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
