import random
import re
import unicodedata

from grainstore.llm import leakage as L


def _words(t):
    return re.findall(r"\w+", unicodedata.normalize("NFKC", t).casefold())


def _slow(docs, items, n=12):
    grams = lambda t: {tuple(w[i : i + n]) for w in [_words(t)] for i in range(len(w) - n + 1)}
    held = {d: grams(t) for d, t in docs if t}
    return {(d, i): len(grams(p) & g) for d, g in held.items() for i, p in items if p and grams(p) & g}


def _run(spark, docs, items):
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, windows string")
    i = spark.createDataFrame(items, "item_id long, passage string")
    return {(r.doc_id, r.item_id): r.windows for r in L.leaked_passages(d, i).collect()}


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(5, 60)))) for i in range(30)] + [(90, None), (91, ""), (92, "a " * 40), (1, None)]
    docs = []
    for d in range(200):
        w = [rng.choice(vocab) for _ in range(rng.randrange(0, 300))]
        if d % 2:
            p = (items[rng.randrange(30)][1] or "").split()
            at = rng.randrange(max(1, len(p) - 11))
            cut = p[at : at + rng.randrange(9, 30)]
            place = rng.randrange(len(w) + 1)
            w = w[:place] + cut + w[place:]
        docs.append((d, rng.choice([" ", "\n", ", "]).join(w).upper() if d % 3 else "  ".join(w)))
    docs += [(500, None), (501, ""), (502, "b a a a a a a a a a a a a a c"), (503, "word " * 20_000)]
    want = _slow(docs, items)
    got = _run(spark, docs, items)
    assert got == want and len(want) > 60


def test_words_are_compared_whole(spark):
    passage = "art of the long road and its many turns asks for patience"
    assert len(passage.split()) == 12
    items = [(1, passage)]
    docs = [(1, "the sm" + passage + "fully done"), (2, "So: ART of—the long, road and its many\nturns asks for patience!"), (3, passage.replace(" ", ""))]
    assert _run(spark, docs, items) == {(2, 1): 1}


def test_unicode_forms_and_empty_tables(spark):
    p = "café " + " ".join(f"단어{i}" for i in range(12))
    assert _run(spark, [(1, unicodedata.normalize("NFD", p).upper())], [(1, p)]) == {(1, 1): 2}
    d, i = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, passage string")
    assert L.leaked_passages(d, i).count() == 0
    assert L.leakage_report(L.leaked_passages(d, i), i).count() == 0


def test_sketches_suffice_for_each_size():
    c = L.LeakageConfig()
    for n, k in enumerate(L.sketch_sizes(c)):
        if n > c.least:
            assert (1 - c.least / n) ** k <= c.miss
