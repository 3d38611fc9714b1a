import random

import pytest

from grainstore.operators import chunking as C


def test_char_windows_begin_while_text_is_left(spark):
    df = spark.createDataFrame([("d", 1, "x" * 900), ("e", 2, "  "), ("f", 1, None), ("g", 1, "ab")], "doc_id string, page int, text string")
    out = C.char_chunks(df).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.char_start, r.char_end) for r in out] == [("d_p001_c000", 0, 900), ("d_p001_c001", 750, 900), ("g_p001_c000", 0, 2)]


def test_blank_windows_get_no_index(spark):
    df = spark.createDataFrame([("d", 1, "ab\n\ncd")], "doc_id string, page int, text string")
    out = C.char_chunks(df, 2, 0).orderBy("char_start").collect()
    assert [(r.chunk_index, r.text) for r in out] == [(0, "ab"), (1, "cd")]
    with pytest.raises(ValueError):
        C.char_chunks(df, 5, 5)


def _slow(lines, lang, size, overlap):
    """The rule of the line windows, step by step."""
    edges = {0, len(lines)} | {i for i, x in enumerate(lines) if not x.strip() or C.starts_definition(x.strip(), lang)}

    def score(e):
        before, after = (lines[e - 1].strip() if 0 < e else ""), (lines[e].strip() if e < len(lines) else "")
        s = 2.0 * (e in edges) + 1.0 * (not before or not after)
        return s + 0.4 * before.endswith(("}", "];", ");", ")", ":")) + 0.8 * after.startswith(("class ", "def ", "async def ", "public ", "private ", "@", "function "))

    out, start = [], 0
    while start < len(lines):
        target = min(start + size, len(lines))
        end = target
        if target < len(lines):
            best = score(target)
            for e in range(max(start + 1, target - 40), min(len(lines), target + 40) + 1):
                if score(e) - abs(e - target) * 0.03 > best:
                    best, end = score(e) - abs(e - target) * 0.03, e
        if not "\n".join(lines[start:end]).strip():
            start += 1
            continue
        out.append((start, end))
        if end >= len(lines):
            break
        nxt = max(start + size - overlap, end - overlap)
        start = nxt if nxt > start else end
    return out


def test_line_windows_follow_the_rule():
    rng = random.Random(2)
    parts = ["", "  x = 1", "def f():", "}", "class A {", "public void run() {", "    return a(b);", "key: value", "# head"]
    for _ in range(300):
        lines = [rng.choice(parts) for _ in range(rng.randrange(0, 120))]
        lang, size = rng.choice(["python", "java", "yaml", "text"]), rng.choice([3, 4, 10, 50])
        overlap = rng.randrange(size)
        assert C.line_windows(lines, lang, size, overlap) == _slow(lines, lang, size, overlap)


def test_line_chunks(spark):
    df = spark.createDataFrame([("r", "a.py", "a\nb\nc\nd\ne"), ("r", "b.py", ""), ("r", None, "x"), ("r", "c.py", None)], "repo_id string, path string, text string")
    out = C.line_chunks(df, 3, 1).orderBy("start_line").collect()
    assert out[0].chunk_id.startswith("r:a.py:L1-L") and {r.path for r in out} == {"a.py"} and out[-1].end_line == 5


@pytest.mark.parametrize("path, lang", [("a/Dockerfile", "dockerfile"), ("x.TSX", "typescript"), ("y.kt", "kt"), ("Makefile", "text"), ("a.b.yml", "yaml"), (".gitignore", "text")])
def test_language_guess(spark, path, lang):
    from pyspark.sql import functions as F

    assert spark.range(1).select(C.language_guess(F.lit(path)).alias("l")).first().l == lang


def test_files_out_of_overlapping_and_repeated_chunks(spark):
    rows = [("r", "a", 1, "l1\nl2\nl3"), ("r", "a", 3, "l3\r\nl4"), ("r", "a", 1, "l1\nl2\nl3"), ("r", "b\\c", None, "x"), ("r", "n", 1, None)]
    df = spark.createDataFrame(rows, "repo_id string, path string, start_line int, text string")
    assert {(r.path, r.text) for r in C.whole_files(df).collect()} == {("a", "l1\nl2\nl3\nl4"), ("b/c", "x")}


def test_ids(spark):
    from hashlib import sha256

    from pyspark.sql import functions as F

    r = spark.range(1).select(C.document_id(F.lit(b"abc")).alias("d"), C.repository_id(F.lit(b"abc")).alias("r")).first()
    assert (r.d, r.r) == ("doc-" + sha256(b"abc").hexdigest()[:16], sha256(b"abc").hexdigest()[:16])
