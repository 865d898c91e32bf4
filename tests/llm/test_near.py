"""SimHash groups, decontamination and nearest neighbours against brute force."""

import random
import re

import brute
import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from urlsieve.llm import ann, decontamination, simhash
from urlsieve.llm.components import components


def test_groups_match_brute_force(spark):
    r = random.Random(1)
    base = [" ".join(r.choice("ab cd ef gh ij kl".split()) + str(r.randint(0, 99)) for _ in range(80)) for _ in range(8)]
    texts = [None, "", "A b", "a  B", *base, *(b + " extra" for b in base), *(b.upper() for b in base), base[0]]
    docs = spark.createDataFrame([(i + 10, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    prints = [brute.fingerprint(t) for t in texts]
    first = brute.groups(prints)
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in simhash.near_duplicate_components(docs).collect()}
    assert got == {i + 10: (f"{p:016x}", first[i] + 10) for i, p in enumerate(prints)}
    kept = simhash.keep_one_per_group(docs.unionByName(docs.where("doc_id = 10"))).collect()
    assert sorted(x.doc_id for x in kept) == sorted({f + 10 for f in first}) and kept[0].asDict().keys() == set(docs.columns)


def test_one_row_of_each_group_with_repeated_ids(spark):
    r = random.Random(2)
    a, b, c = (" ".join(r.choice("ab cd ef gh ij kl".split()) + str(r.randint(0, 99)) for _ in range(80)) for _ in range(3))
    rows = [(1, a), (1, b), (2, a.upper()), (2, c), (3, b.upper()), (3, c.upper()), (1, a), (None, c), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.keep_one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted((x.doc_id or 0, x.text or "") for x in kept.collect()) == sorted([(0, c), (1, a), (1, b), (2, c), (4, "")])


@pytest.mark.parametrize("hot", [64, 2])
def test_links_connect_a_crowded_family(spark, hot):
    rng, base, family = np.random.default_rng(1), 0x1234567890ABCDEF, set()
    while len(family) < 250:
        x = base
        for b in rng.integers(0, 64, rng.integers(0, 9)):
            x ^= 1 << int(b)
        family.add(x)
    family = sorted(family)
    rows = spark.createDataFrame([(simhash._signed(x),) for x in family], "fp long")
    links = simhash.links(rows, hot=hot)
    assert all(((x.u ^ x.v) & (1 << 64) - 1).bit_count() <= 3 for x in links.collect())
    roots = {x.node: x.root for x in components(links).collect()}
    label = brute.groups(family)
    pairs = {(label[i], roots.get(simhash._signed(x), simhash._signed(x))) for i, x in enumerate(family)}
    assert len(pairs) == len(set(label)) == len({b for _, b in pairs})


def inner_joins(df, *keys) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"(\w+Join) \[%s\], \[[^]]*\], Inner" % ", ".join(rf"{k}#\w+" for k in keys), plan)


def test_links_broadcast_nothing_under_masks(spark, tmp_path):
    """A written table of fingerprints looks small, while its probes and points are many times its rows."""
    spark.createDataFrame([(x,) for x in range(200)], "fp long").write.parquet(f"{tmp_path}/prints")
    links = simhash.links(spark.read.parquet(f"{tmp_path}/prints"))
    assert inner_joins(links, "part") == inner_joins(links, "part", "point") == ["SortMergeJoin"] * simhash.SEGMENTS


def test_near_copies_of_the_pipeline_broadcast_no_probes_nor_all_rows(spark, monkeypatch):
    joins, links, groups = [], simhash.links, simhash.near_duplicate_components

    def linked(*args):
        joins.extend([*inner_joins(links(*args), "part"), *inner_joins(links(*args), "part", "point")])
        return links(*args)

    def grouped(*args):
        joins.extend(inner_joins(out := groups(*args), "fp"))
        return out

    monkeypatch.setattr(simhash, "links", linked)
    monkeypatch.setattr(simhash, "near_duplicate_components", grouped)
    docs = spark.createDataFrame([(i, f"text {i // 2} of some words") for i in range(40)], "doc_id long, text string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted(x.doc_id for x in kept.collect()) == list(range(0, 40, 2))
    assert joins == ["SortMergeJoin"] * (2 * simhash.SEGMENTS + 1)


def test_least_distance_and_matcher():
    r = random.Random(3)
    for _ in range(500):
        p, t = ("".join(r.choice("ab ") for _ in range(n)) for n in (r.randint(1, 12), r.randint(0, 25)))
        assert decontamination.least_distance(p, t) == brute.least_distance(p, t)
    items = [(i, "".join(r.choice("abcdefg ") for _ in range(r.randint(30, 90))).strip()) for i in range(20)]
    matcher = decontamination.Matcher(items, 0.1)
    for _ in range(60):
        _, item = r.choice(items)
        x = list(item)
        for _ in range(r.randint(0, len(item) // 10 + 3)):
            at = r.randrange(len(x))
            x[at:at + r.randint(0, 1)] = r.choice(["", "a", "g"])
        text = "".join(r.choice("abcdefg ") for _ in range(30)) + "".join(x) + "".join(r.choice("abcdefg ") for _ in range(30))
        want = {i: brute.least_distance(t, text)[0] for i, t in items}
        assert {h[0]: h[1] for h in matcher.find(text)} == {i: d for i, d in want.items() if d <= int(len(dict(items)[i]) * 0.1)}


def test_decontamination_cases(spark):
    item = "The quick brown fox jumps over the lazy dog near the river bank"
    bench = spark.createDataFrame([(1, item), (2, item), (3, None), (4, "tiny"), (5, "")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "a " + item.upper().replace(" ", "\n ") + " b", 0), (2, None, 0), (3, "", 0), (None, item, 0), (5, item.replace("quick", "quack"), 0),
         (6, "tiny clean text", 0), (1, "other", 0)], "doc_id long, text string, item_id int")
    for block in (10, 10**6):
        hits = decontamination.benchmark_hits(docs, bench, block_chars=block).collect()
        assert sorted((h.doc_id or 0, h.item_id, h.distance) for h in hits) == [(0, 1, 0), (0, 2, 0), (1, 1, 0), (1, 2, 0), (5, 1, 1), (5, 2, 1)]
    kept = decontamination.drop_contaminated(docs, bench)
    assert sorted((x.doc_id, x.text) for x in kept.where("text is not null").collect()) == [(1, "other"), (3, ""), (6, "tiny clean text")]
    assert kept.columns == docs.columns and kept.count() == 4
    assert decontamination.benchmark_hits(docs, bench.limit(0)).count() == 0


def test_decontamination_short_items_as_lines(spark):
    bench = spark.createDataFrame([(1, "What  is 2+2?"), (2, "What is 2+2?"), (3, "a\nb"), (4, " ")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "what is 2+2? "), (2, "First.\r\n\n\tWhat is\t2+2?\n4"), (3, "So what is 2+2? asked he"), (4, "x\nA\n\nb\nA\nB"),
                                  (5, "a b"), (6, "What is\n2+2?"), (7, "a b c"), (8, None)], "doc_id long, text string")
    hits = decontamination.benchmark_hits(docs, bench).collect()
    assert sorted(tuple(h) for h in hits) == [
        (1, 1, 0, 0, 12), (1, 2, 0, 0, 12), (2, 1, 0, 7, 19), (2, 2, 0, 7, 19), (4, 3, 0, 2, 5), (5, 3, 0, 0, 3), (6, 1, 0, 0, 12), (6, 2, 0, 0, 12)]
    assert sorted(x.doc_id for x in decontamination.drop_contaminated(docs, bench).collect()) == [3, 7, 8]


def test_nearest_recall_and_cases(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(600, 16))
    v[5] = v[6] = v[7]
    rows = [(i, [float(c) for c in x], 0) for i, x in enumerate(v)]
    rows += [(601, None, 0), (602, [0.0] * 16, 0), (603, [None] + [1.0] * 15, 0), (604, [float("nan")] * 16, 0), (605, [1.0], 0), (None, [1.0] * 16, 0), (620, [float("inf")] * 16, 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = ann.nearest(table, F.col("id") % 20 == 0, k=20, block=50).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(range(0, 600, 20))
    found = 0
    for q, near in by.items():
        near.sort(key=lambda r: r.rank)
        s = v @ v[q]
        assert [r.rank for r in near] == list(range(1, 21)) and all(abs(r.score - s[r.vec_id]) < 1e-9 for r in near)
        assert [(-r.score, r.vec_id) for r in near] == sorted((-r.score, r.vec_id) for r in near)
        best = [i for i in np.lexsort((np.arange(600), -s)) if i != q][:20]
        found += len({r.vec_id for r in near} & set(best))
    assert found >= 0.9 * 20 * len(by)
    assert ann.nearest(table.limit(0), F.col("id") % 20 == 0).count() == 0
    assert sorted(r.vec_id for r in ann.nearest(table.where("vec_id in (0, 5, 6, 7)"), F.col("id") == 0).collect()) == [5, 6, 7]


@pytest.mark.parametrize("n", [8, 21, 25])
def test_nearest_of_a_small_table_has_k_rows(spark, n):
    v = np.random.default_rng(n).normal(size=(n, 16))
    table = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    by = {}
    for r in ann.nearest(table, F.col("id") >= 0, k=20).collect():
        by.setdefault(r.query_id, set()).add(r.vec_id)
    assert {q: len(x) for q, x in by.items()} == dict.fromkeys(range(n), min(20, n - 1))
