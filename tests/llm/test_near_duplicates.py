import random

from grainstore.llm.near_duplicates import NearDuplicateConfig, near_duplicate_groups, near_duplicate_pairs, near_duplicates


def test_all_pairs_of_a_large_class_and_its_links(spark):
    words = [f"w{i}" for i in range(40)]
    template = [(f"t{i:02}", " ".join(words) + "." * i) for i in range(66)]
    near = [(f"u{i}", " ".join(words + ["more"]) + "!" * i) for i in range(2)]
    df = spark.createDataFrame(template + near, "chunk_id string, text string")
    pairs = {tuple(r) for r in near_duplicate_pairs(near_duplicates([df])).collect()}
    ids = sorted(c for c, _ in template + near)
    assert pairs == {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]}


def _sets(texts, n=3):
    import re

    out = {}
    for c, t in texts:
        w = re.findall(r"\w+", (t or "").lower())
        out.setdefault(c, set()).update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    return out


def test_against_brute_force_in_one_crowded_bucket(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(60)] = f"x{rng.randrange(500)}"
        texts.append((f"c{i:03}", " ".join(w)))
    texts += [("s1", "a b"), ("s2", "a b"), ("n1", None), ("e1", ""), (None, "a b c d"), ("c000", texts[0][1]), ("long1", "q " * 30_000), ("long2", "q " * 20_000)]
    df = spark.createDataFrame([(*t, 1) for t in texts], "chunk_id string, text string, cls int")
    sets = _sets([t for t in texts if t[0]])
    ids = sorted(c for c, s in sets.items() if s)
    want = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b]) - 1e-9}
    for block in (7, 1000):  # compared in many blocks or in one, the links are the same
        found = near_duplicates([df.select("chunk_id", "text")], NearDuplicateConfig(block=block))
        got = {tuple(r) for r in near_duplicate_pairs(found).collect()}
        assert got <= want and len(got) >= 0.999 * len(want) > 1000


def test_groups_and_empty_tables(spark):
    words = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([("a", words), ("b", words + " end"), ("c", words.upper()), ("d", "something else altogether here")], "chunk_id string, text string")
    groups = {r.chunk_id: (r.group_id, r.links) for r in near_duplicate_groups(near_duplicates([df])).collect()}
    assert groups == {"a": ("a", 1), "c": ("a", 1), "b": ("a", 1)}
    empty = near_duplicates([df.where("false")])
    assert near_duplicate_pairs(empty).count() == 0 and near_duplicate_groups(empty).count() == 0
