import random

from grainstore.llm.splitting import BREAK, split_code, split_oversized, split_text


def test_pieces_cover_the_text_within_the_limits():
    rng = random.Random(1)
    parts = ["word ", "a", ". ", "\n", "\n\n", "\r\n", "longer text here ", "# h\n", "하나 "]
    for _ in range(1500):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 300)))
        chars, overlap, lines = rng.choice([20, 60, 200]), rng.choice([0, 5, 15]), rng.choice([2, 3, 7, 2**31 - 1])
        c = split_text(t, chars, overlap, lines)
        assert c[0][0] == 0 and c[-1][1] == len(t)
        assert all(a <= x <= b < y for (a, b), (x, y) in zip(c, c[1:], strict=False))
        assert all(b - a <= chars and len(BREAK.findall(t[a:b])) < lines for a, b in c)
        if lines > 10**6:
            assert all(b - x == min(overlap, b) for (_, b), (x, _) in zip(c, c[1:], strict=False))
        c = split_code(t, chars, 8, rng.choice([0, 2, 6]))
        assert all(b - a <= chars and l1 - l0 < 8 for a, b, l0, l1 in c)


def test_code_repeats_the_lines_asked_for():
    text = "\n".join(f"line {i}" for i in range(51))
    cut = split_code(text, 6000, 15, 10)
    assert [(a, b) for _, _, a, b in cut][:3] == [(0, 14), (5, 19), (10, 24)]
    wide = "\n".join("x" * 200 for _ in range(60))
    assert all(a2 == b1 - 9 for (_, _, _, b1), (_, _, a2, _) in zip(split_code(wide, 3000, 120, 10), split_code(wide, 3000, 120, 10)[1:], strict=False))


def test_operator(spark):
    text = spark.createDataFrame([("t1", "a b. " * 60, 7), ("t1", "a b. " * 60, 7), ("t2", "ok", 0), ("t3", None, 0), ("t4", "x\n" * 30, None)], "chunk_id string, text string, char_start int")
    code = spark.createDataFrame([("c1", "\n".join(f"l{i}" for i in range(30)), 5), (None, "x" * 900, 1), ("c2", "", 1)], "chunk_id string, text string, start_line int")
    limits = spark.createDataFrame(
        [("text", 100, 10, 20, None), ("code", None, 12, None, 3), ("third", 1, 1, 0, 0), (None, 1, 1, 0, 0)], "chunk_kind string, max_chars int, max_lines int, overlap_chars int, overlap_lines int")
    out = split_oversized(text, code, limits).orderBy("chunk_id", "piece_index").collect()
    assert {r.chunk_id for r in out} == {"t1", "t4", "c1"}
    t1 = [r for r in out if r.chunk_id == "t1"]
    assert t1[0].char_start == 7 and all(len(r.text) <= 100 and r.char_end - r.char_start == len(r.text) for r in t1) and {r.overlap for r in t1[1:]} == {20}
    assert all(r.text.count("\n") < 10 for r in out if r.chunk_id == "t4") and {r.char_start for r in out if r.chunk_id == "t4"} == {None}
    c1 = [r for r in out if r.chunk_id == "c1"]
    assert c1[0].start_line == 5 and c1[-1].end_line == 34 and {r.overlap for r in c1[1:]} == {3}
    assert split_oversized(text.where("false"), code.where("false"), limits).count() == 0
