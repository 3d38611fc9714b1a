from grainstore.operators import repo_intel as R

JAVA = "package a;\n{line}\npublic class X {{ }}\n"


def _three(spark):
    files = []
    for repo, line, extra in (("r1", "RestClient client = x; client.send();", "send"), ("r2", "RestTemplate t; ServerSocket s; Queue q;", "recv"), ("r3", "@RequestMapping(\"/x\") class Listener {}", "api")):
        files += [(repo, "pom.xml", f"<project><artifactId>{repo}-app</artifactId></project>"), (repo, f"src/{extra}/Main.java", JAVA.format(line=line)),
                  (repo, "application.yml", "server:\n  port: 80\n  name: x\n# c\nspring:\n  url: http://a\n")]
    return spark.createDataFrame(files, "repo_id string, path string, text string")


def test_pairs():
    text = "a.port=1\n# b.port=2\n- c=3\nserver:\n  port: 80\n  ssl:\n    mode: on\nother: x\nempty.url:\nHOST=h=i\n"
    assert R.pairs_of(text) == [("a.port", "1"), ("server.port", "80"), ("server.ssl.mode", "on"), ("HOST", "h=i")]
    assert len(R.pairs_of("\n".join(f"port{i}=1" for i in range(60)))) == 40 and R.pairs_of("") == []


def test_a_flow_over_three_repositories(spark):
    files = _three(spark)
    repos = spark.createDataFrame([(i, f"{i}.zip") for i in ("r1", "r2", "r3")], "repo_id string, filename string")
    summary = R.summaries(files, repos)
    rows = {r.repo_id: r for r in summary.collect()}
    assert rows["r1"].role == "producer" and rows["r2"].role == "relay" and rows["r3"].role == "receiver"
    assert rows["r1"].display_name == "r1-app" and rows["r1"].entry == "Main.java" and rows["r1"].config_port == 1 and rows["r1"].config_url == 1
    members = spark.createDataFrame([(1, "r1"), (1, "r2"), (1, "r3"), (2, "r1")], "project_id long, repo_id string")
    found = R.repo_relations(members, summary)
    pairs = {(r.from_repo_id, r.to_repo_id) for r in found.collect()}
    assert {("r1", "r2"), ("r2", "r3")} <= pairs and {r.project_id for r in found.collect()} == {1}
    told = {r.project_id: r.overview for r in R.overview(members, summary, found).collect()}
    assert "r1-app -> r2-app" in told[1] and "[관계 요약]" not in told[2]


def test_signals_are_the_first_of_a_file_and_words_overlap(spark):
    many = "\n".join(["Listener x" + "y" * 300] * 20)
    files = spark.createDataFrame([("r", "a.py", many), ("r", "b.txt", "Listener"), ("r", "c.py", None)], "repo_id string, path string, text string")
    out = R.code_signals(files).collect()
    assert len(out) == 12 and {len(r.text) for r in out} == {180} and sorted(r.line for r in out) == list(range(1, 13))
    from pyspark.sql import functions as F

    counts = spark.range(1).select(*[R.count_words(F.lit("sendersend client restclient"), (w,)).alias(w) for w in ("send", "sender", "client", "restclient")]).first()
    assert tuple(counts) == (2, 1, 2, 1)


def test_roles_and_empty_tables(spark):
    files = spark.createDataFrame([("r", "a/UserController.py", "x"), ("r", "a/router/api/handler.py", "x")], "repo_id string, path string, text string")
    out = {(r.role, r.path): r.score for r in R.role_candidates(files, R.code_signals(files)).collect()}
    assert out[("input", "a/router/api/handler.py")] >= 2 and ("input", "a/UserController.py") not in out
    empty = files.where("false")
    assert R.summaries(empty, spark.createDataFrame([], "repo_id string, filename string")).count() == 0
