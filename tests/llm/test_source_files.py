from grainstore.llm import source_files as S

BODY = "import x\n\n\ndef run(a):\n    value = load(a)\n    if value:\n        return store(value)\n    return None\n"


def _df(spark, rows):
    full = [(f"c{i}", r[0], r[1], r[2], r[3] if len(r) > 3 else 1, "extra") for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "chunk_id string, repo_id string, path string, text string, start_line int, kind string")


def _kinds(spark, rows):
    return {(r.repo_id, r.path): r.kind for r in S.not_hand_written(_df(spark, rows)).collect()}


def test_rules(spark):
    table = "T = [\n" + "".join(f"  [{i}.5, {i}, \"k{i}\"],\n" for i in range(30)) + "]\n"
    rows = [
        ("r", "gen/a.py", "# Code generated by tool 1.2. DO NOT EDIT.\n" + BODY), ("r", "b.py", "# 이 파일은 x 1.0 도구가 자동으로 생성했습니다.\n" + BODY),
        ("r", "deps.lock.yml", "lockVersion: 3\npackages:\n" + "".join(f"  a{i}@1.0:\n    integrity: sha512-x\n    resolved: y\n" for i in range(5))),
        ("r", "R.java", "class R {\n" + "".join(f"  public static final int x{i} = 0x7f00000{i};\n" for i in range(9)) + "}\n"),
        ("r", "node_modules/p/i.js", BODY), ("r", "src\\third_party\\p\\i.js", BODY + "x"), ("r", "src/c.py", "# Copyright (c) 2011 the foo authors. All rights reserved.\n" + BODY + "y"),
        ("r", "d.js", "/*! d */\n" + "function a(t){return t.b(1)}for(var i=0;i<9;i++)x[i]^=2;" * 40 + "\n"), ("r", "e.py", table), ("r", "f.sql", "INSERT INTO t VALUES (1, 'a', 2.5);\n" * 20),
        ("r", "g.js", 'export const x = "data:image/png;base64,' + "Ab1/" * 300 + '";'),
        ("r", "vendor_pay/h.py", BODY + "h"), ("r", "gen/Report.py", "# Generates the nightly report.\n# Do not edit the limits below without asking.\n" + BODY),
        ("r", "own.py", "# Copyright 2024 our own team.\n" + BODY + "o"), ("r", "min_x.py", BODY + "m"), ("r", "vendor/README.py", BODY + "v"), ("r", "app.properties", "".join(f"key{i}.name={i}\n" for i in range(30))),
    ]
    kinds = _kinds(spark, rows)
    assert {p: k for (_, p), k in kinds.items()} == {
        "gen/a.py": "generated", "b.py": "generated", "deps.lock.yml": "generated", "R.java": "generated", "node_modules/p/i.js": "vendored", "src\\third_party\\p\\i.js": "vendored",
        "src/c.py": "vendored", "d.js": "minified", "e.py": "data", "f.sql": "data", "g.js": "data",
    }


def test_a_subtree_of_unrelated_repositories_is_vendored(spark):
    own = lambda r: [(r, f"src/{r}{i}.py", BODY + f"{r}{i}") for i in range(6)]
    lib = lambda r, at: [(r, f"{at}/a.py", BODY + "a"), (r, f"{at}/sub/b.py", BODY + "b")]
    kinds = _kinds(spark, own("r1") + lib("r1", "x/lib") + own("r2") + lib("r2", "deep/y/lib") + [("r2", "deep/y/other.py", BODY + "z")])
    assert {k for k, v in kinds.items() if v == "vendored"} == {("r1", "x/lib/a.py"), ("r1", "x/lib/sub/b.py"), ("r2", "deep/y/lib/a.py"), ("r2", "deep/y/lib/sub/b.py")}


def test_forks_are_not_vendored(spark):
    whole = lambda r: [(r, f"src/{i}.py", BODY + str(i)) for i in range(6)]
    assert _kinds(spark, whole("r1") + whole("r2")) == {}


def test_overlap_and_repeats_leave_the_hash_alone(spark):
    lines = [f"line {i}" for i in range(40)]
    one = _df(spark, [("r", "a", "\n".join(lines))])
    cut = _df(spark, [("r", "a", "\n".join(lines[:25])), ("r", "a", "\r\n".join(lines[20:]) + "  ", 21), ("r", "a", "\n".join(lines[:25]))])
    other = _df(spark, [("r", "a", "\n".join(lines[:39] + ["line x"]))])
    h = [S.files(df).first().hash for df in (one, cut, other)]
    assert h[0] == h[1] != h[2]


def test_nulls_and_empty_tables(spark):
    df = _df(spark, [(None, "a", "x"), ("r", None, "x"), ("r", "a", None), ("r", "b", ""), ("r", "c", "x" * 300_000), ("r", "d", "é\r퟿", None)])
    assert [(r.path, r.kind) for r in S.not_hand_written(df).collect()] == [("c", "data")]  # one run of letters, as a blob is
    assert S.not_hand_written(df.where("false")).count() == 0
