"""Groups, splits and near duplicates against brute force."""

import random

from pyspark.sql import functions as F

from lodesift.llm import near, splits
from lodesift.llm.components import connected_groups, membership_links
from lodesift.session import star_links


def brute_groups(pairs):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            if x != y:
                up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


def test_groups_of_chains_stars_and_noise(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(0, 120)] + [(1000, 1000 + i) for i in range(1, 60)]
    pairs += [(rng.randrange(2000, 2150), rng.randrange(2000, 2150)) for _ in range(90)]
    pairs += [(b, a) for a, b in pairs[:30]] + [(5, 5), (None, 3), (4, None)]
    links = spark.createDataFrame(pairs, "a long, b long").withColumn("group", F.lit("clash"))
    got = {r["id"]: r["group"] for r in connected_groups(links).collect()}
    assert got == brute_groups(pairs)


def test_groups_of_nothing(spark):
    assert connected_groups(spark.createDataFrame([], "a long, b long")).collect() == []
    assert connected_groups(spark.createDataFrame([("x", "x"), (None, "y")], "a string, b string")).collect() == []


def test_membership_links_need_valid_members(spark):
    rows = spark.createDataFrame(
        [("u", [3, None, 1, 1]), ("u", [7, 99]), (None, [4, 5]), (None, [5, 98]), (None, None), ("w", []), (None, [2])], "component_id string, member_indices array<long>"
    )
    valid = spark.createDataFrame([(i,) for i in range(10)], "id long")
    links = membership_links(rows, "component_id", "member_indices", valid)
    got = {r["id"]: r["group"] for r in connected_groups(links).collect()}
    assert got == {1: 1, 3: 1, 7: 1, 4: 4, 5: 4}


def test_star_links_connect_a_hot_key(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(300)] + [("cold", 5), (None, 1)], "k string, m long")
    links = star_links(rows, "k", "m", salts=4)
    assert set(brute_groups([tuple(r) for r in links.collect()]).values()) == {0}
    assert links.count() <= 300


def test_spanning_forest_is_a_forest_that_connects(spark):
    rng = random.Random(8)
    edges = list({(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(90)) if a < b})
    links = spark.createDataFrame([(f"s{a:02}", f"s{b:02}", rng.randrange(3)) for a, b in edges], "a string, b string, weight int")
    forest, rooted = splits.spanning_forest(links)
    expected = brute_groups([(f"s{a:02}", f"s{b:02}") for a, b in edges])
    assert {r["id"]: r["root"] for r in rooted.collect()} == expected
    kept = [(r["a"], r["b"]) for r in forest.collect()]
    assert brute_groups(kept) == expected
    assert len(kept) == len(expected) - len(set(expected.values()))


def test_dealt_splits_keep_trees_whole_and_proportions(spark):
    ids = spark.range(4000).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("id"))
    rooted = ids.where("cast(substr(id, 2) as int) < 900").select("id", F.concat(F.lit("s"), (F.substring("id", 2, 9).cast("int") % 300).cast("string")).alias("root"))
    out = splits.dealt(ids, rooted)
    assert out.groupBy("root").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    share = {r["split"]: r["count"] / 4000 for r in out.groupBy("split").count().collect()}
    assert abs(share["train"] - 0.8) < 0.02 and abs(share["test"] - 0.1) < 0.02 and out.count() == 4000
    again = splits.dealt(ids.repartition(7), rooted.repartition(3))
    assert out.exceptAll(again).count() == 0


def jaccard(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b)


def near_rows(rng):
    words = [f"w{i}" for i in range(400)] + [f"s{i}" for i in range(4)] * 40
    base = [list(dict.fromkeys(rng.choices(words, k=rng.randrange(1, 22)))) for _ in range(60)]
    rows = [(f"r{i:03}", rng.choice(["x", "y", None]), b) for i, b in enumerate(base)]
    for i in range(200):
        features = list(rng.choice(base))
        for _ in range(rng.randrange(0, 4)):  # words moved, left out, put in and repeated
            k = rng.randrange(len(features))
            features.insert(rng.randrange(len(features)), features.pop(k))
        features = features[: max(1, len(features) - rng.randrange(0, 3))] + rng.sample(words, rng.randrange(0, 3))
        rows.append((f"t{i:03}", rng.choice(["x", "y"]), features + features[:1]))
    rows += [rows[0], (None, "x", ["w1"]), ("empty", "x", []), ("none", "x", None), ("long", "y", [f"w{i}" for i in range(3000)]), ("lonh", "y", [f"w{i}" for i in range(2900)])]
    return rows


def test_near_pairs_match_brute_force(spark):
    rows = near_rows(random.Random(5))
    records = spark.createDataFrame(rows, "id string, block string, words array<string>").withColumn("features", F.lit("clash"))
    pairs, members = near.near_records(records, 0.6)
    got = {tuple(r) for r in near.expanded(pairs, members).collect()}
    held = {i: (b, f) for i, b, f in rows if i and b and f}
    expected = {(a, b) for a in held for b in held if a < b and held[a][0] == held[b][0] and jaccard(held[a][1], held[b][1]) >= 0.6 - 1e-12}
    assert got <= expected and len(got) >= 0.99 * len(expected) and ("long", "lonh") in got
    grouped = {r["id"]: r["group_id"] for r in near.groups(pairs, members).collect()}
    assert grouped == brute_groups(got)
    assert all(0 <= r["edit_similarity"] <= 1 and r["similarity"] >= 0.6 - 1e-12 for r in pairs.collect())


def test_one_sketch_finds_fewer_pairs(spark):
    rows = near_rows(random.Random(6))
    from lodesift.session import Scratch

    scratch = Scratch(spark, "test")
    sets, _ = near.classes(spark.createDataFrame(rows, "id string, block string, words array<string>"), scratch)
    few, many = (near.near_classes(sets, 0.6, scratch, sketches=n).count() for n in (1, near.SKETCHES))
    assert few < many
    assert near.near_classes(sets, 0.6, scratch, k=2).count() <= many


def test_near_of_an_empty_table(spark):
    pairs, members = near.near_records(spark.createDataFrame([], "id string, block string, words array<string>"))
    assert near.expanded(pairs, members).count() == 0


def test_alignment_matches_the_plain_one():
    import numpy as np

    rng = random.Random(7)
    for _ in range(50):
        a, b = ([rng.randrange(8) for _ in range(rng.randrange(1, 15))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        wide = near.aligned_words(np.array([a], np.uint64) + 10, np.array([b], np.uint64) + 10, 20)[0]
        assert wide == row[-1]
        assert near.aligned_words(np.array([a], np.uint64) + 10, np.array([b], np.uint64) + 10, 2)[0] <= wide


def test_occurrence_labels_and_order():
    import numpy as np

    words, sizes = np.array([5, 6, 5, 5, 7], np.uint64), np.array([3, 2])
    mers, kept, number = near.labelled(words, sizes)
    assert number.tolist() == [0, 0, 1, 0, 0] and kept.tolist() == [3, 2] and mers[0] == 5 and mers[2] != 5 and mers[3] == 5
    assert near.labelled(words, sizes, 2)[1].tolist() == [2, 1]
    ones = np.ones(3, np.float32)
    sample = lambda x: near.ordered_samples(np.array(x, np.uint64), np.array([3]), ones, ones > 0, np.array([1], np.uint64), 8, 2)[1].tolist()
    assert sample([1, 2, 3]) == sample([1, 2, 3]) and sample([1, 2, 3]) != sample([3, 2, 1])
