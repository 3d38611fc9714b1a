"""What repositories do and how they relate, read from paths, settings and marked source lines."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainstore.functions import fixed
from grainstore.functions.text import contains_any, strip

#: Source and settings files by suffix.
CODE = r"(?i)\.(?:java|kt|py|js|ts|tsx|jsx|go|rb|php|cs)$"
SETTINGS = r"(?i)\.(?:ya?ml|properties)$"
_YAML = re.compile(r"^(\s*)([A-Za-z0-9_.\-]+)\s*:\s*(.*)$")


def count_words(text: Column, words: tuple[str, ...]) -> Column:
    """How often the words occur; each word counts for itself, without overlaps."""
    return reduce(lambda a, b: a + b, [((F.length(text) - F.length(F.replace(text, F.lit(w)))) / len(w)).cast("int") for w in words])


def code_signals(files: DataFrame) -> DataFrame:
    """(repo_id, path, line, text): the first marked lines of each source file (repo_id, path, text), stripped and cut."""
    code = files.where(F.col("path").rlike(CODE))
    lines = F.transform(F.split("text", r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85  ]"), lambda x, i: F.struct((i + 1).alias("line"), strip(x).alias("text")))
    marked = F.slice(F.filter(lines, lambda x: contains_any(x["text"], fixed.CODE_MARKERS)), 1, fixed.SIGNALS_PER_FILE)
    return code.select("repo_id", "path", F.explode(marked).alias("s")).select("repo_id", "path", "s.line", F.substring("s.text", 1, fixed.SIGNAL_CHARS).alias("text"))


def pairs_of(text: str) -> list[tuple[str, str]]:
    """Settings of interest in a file: ``key=value`` lines, and ``key: value`` with the keys it is indented under."""
    out, above = [], []
    for raw in text.splitlines():
        raw = raw.rstrip()
        line = raw.strip()
        if not line or line[0] == "#":
            continue
        if "=" in line and line[0] != "-":
            key, _, value = line.partition("=")
            if any(w in key.lower() for w in fixed.CONFIG_WORDS):
                out.append((key.strip(), value.strip()))
            continue
        if not (m := _YAML.match(raw)):
            continue
        level = len(m[1]) // 2
        above = [*above[:level], m[2]]
        full = ".".join(above)
        if m[3].strip() and any(w in full.lower() for w in fixed.CONFIG_WORDS):
            out.append((full, m[3].strip()))
    return out[: fixed.PAIRS_PER_FILE]


def config_pairs(files: DataFrame) -> DataFrame:
    """(repo_id, path, position, key, value) of the settings files; what a key is indented under needs the lines in order,
    so a file is read in one Python pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(r, p, i, k, v) for r, p, t in zip(pdf["repo_id"], pdf["path"], pdf["text"], strict=True) for i, (k, v) in enumerate(pairs_of(t))]
            yield pd.DataFrame(rows, columns=["repo_id", "path", "position", "key", "value"])

    return files.where(F.col("path").rlike(SETTINGS) & F.col("text").isNotNull()).select("repo_id", "path", "text").mapInPandas(
        run, "repo_id string, path string, position int, key string, value string"
    )


def signal_counts(files: DataFrame, pairs: DataFrame, signals: DataFrame) -> DataFrame:
    """(repo_id, outbound, inbound, transform, config_port, config_url, role) over paths, settings and signal lines.

    Words don't span rows, so each row is counted alone and added up; paths count relative to the repository.
    """
    code = files.where(F.col("path").rlike(CODE)).select("repo_id", F.lower("path").alias("x"), F.lit(None).cast("string").alias("key"))
    settings = pairs.select("repo_id", F.lower(F.concat_ws(" ", "key", "value")).alias("x"), F.lower("key").alias("key"))
    marked = signals.select("repo_id", F.lower("text").alias("x"), F.lit(None).cast("string").alias("key"))
    counts = code.unionByName(settings).unionByName(marked).groupBy("repo_id").agg(
        F.sum(count_words(F.col("x"), fixed.OUTBOUND_WORDS)).alias("outbound"),
        F.sum(count_words(F.col("x"), fixed.INBOUND_WORDS)).alias("inbound"),
        F.sum(count_words(F.col("x"), fixed.TRANSFORM_WORDS)).alias("transform"),
        F.count_if(F.col("key").contains("port")).alias("config_port"),
        F.count_if(F.col("key").contains("url")).alias("config_url"),
    )
    sends, takes, changes = F.col("outbound") > 0, F.col("inbound") > 0, F.col("transform") > 0
    role = (
        F.when(sends & takes & changes, "relay").when(sends & takes, "gateway").when(sends, "producer").when(takes, "receiver")
        .when(changes, "processor").otherwise("application")
    )
    return counts.withColumn("role", role)


def role_candidates(files: DataFrame, signals: DataFrame) -> DataFrame:
    """(repo_id, role, position, path, score): the files that score for a part, the four best of each.

    Signal lines go by file name, so files of one name share theirs.
    """
    name = F.substring_index("path", "/", -1)
    said = signals.groupBy("repo_id", name.alias("name")).agg(*[F.sum(count_words(F.lower("text"), words[1])).alias(r) for r, words in fixed.ROLE_WORDS.items()])
    code = files.where(F.col("path").rlike(CODE)).select("repo_id", "path", name.alias("name"))
    joined = code.join(said, ["repo_id", "name"], "left")
    scores = F.array(*[
        F.struct(F.lit(r).alias("role"), (count_words(F.lower("path"), words[0]) + F.coalesce(r, F.lit(0))).alias("score")) for r, words in fixed.ROLE_WORDS.items()
    ])
    rows = joined.select("repo_id", "path", F.explode(scores).alias("s")).select("repo_id", "path", "s.*").where(F.col("score") >= fixed.ROLE_SCORE)
    w = Window.partitionBy("repo_id", "role").orderBy(F.desc("score"), "path")
    return rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= fixed.ROLE_FILES)


def display_name(manifests: DataFrame, repos: DataFrame) -> DataFrame:
    """(repo_id, display_name): the first name or artifact in the manifests (repo_id, text), else the file name or id."""
    blob = manifests.groupBy("repo_id").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("blob"))
    good = lambda tag: F.when(
        (F.length(F.trim(F.regexp_extract("blob", f"<{tag}>([^<]+)</{tag}>", 1))) > 0) & ~F.regexp_extract("blob", f"<{tag}>([^<]+)</{tag}>", 1).contains("spring-boot-starter-parent"),
        F.trim(F.regexp_extract("blob", f"<{tag}>([^<]+)</{tag}>", 1)),
    )
    names = repos.groupBy("repo_id").agg(F.min("filename").alias("filename")).join(blob, "repo_id", "left")
    return names.select("repo_id", F.coalesce(good("name"), good("artifactId"), "filename", "repo_id").alias("display_name"))


def summaries(files: DataFrame, repos: DataFrame) -> DataFrame:
    """One row per repository: counts, role, entry, and texts of packages, settings, signals and parts, six of each."""
    signals, pairs = code_signals(files), config_pairs(files)
    name = F.substring_index("path", "/", -1)
    code = files.where(F.col("path").rlike(CODE))
    parent = F.regexp_extract("path", "^(.*)/[^/]*$", 1)

    def first(rows: DataFrame, shown: Column, order: list, alias: str, n: int = 6) -> DataFrame:
        w = Window.partitionBy("repo_id").orderBy(*order)
        top = rows.withColumns({"_n": F.row_number().over(w), "_x": shown}).where(F.col("_n") <= n)
        return top.groupBy("repo_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_x"))), lambda x: x["_x"]), " | ").alias(alias))

    entry = code.where(name.rlike("(?:Main|Application)\\.java$")).groupBy("repo_id").agg(F.min_by(name, "path").alias("entry"))
    packages = first(code.select("repo_id", parent.alias("p")).where("p <> ''").distinct(), F.col("p"), ["p"], "packages")
    settings = first(pairs, F.concat(name, F.lit(":"), "key", F.lit("="), "value"), ["path", "position"], "settings")
    marked = first(signals, F.concat_ws(":", name, F.col("line").cast("string"), "text"), ["path", "line"], "signals")
    parts = role_candidates(files, signals).where("position <= 3").groupBy("repo_id", "role").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "path"))), lambda x: x["path"]), ", ").alias("paths"))
    order = F.create_map(*[F.lit(x) for i, r in enumerate(fixed.ROLE_WORDS) for x in (r, i)])
    roles = parts.groupBy("repo_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order[F.col("role")].alias("o"), F.concat("role", F.lit("="), "paths").alias("x")))), lambda y: y["x"]), " | ").alias("roles"))
    out = signal_counts(files, pairs, signals).join(display_name(files.where(F.col("path").rlike("(?:^|/)(?:pom\\.xml|build\\.gradle(?:\\.kts)?|settings\\.gradle|README\\.(?:md|MD))$")), repos), "repo_id", "left")
    for part in (entry, packages, settings, marked, roles):
        out = out.join(part, "repo_id", "left")
    texts = [F.coalesce(c, F.lit("-")).alias(c) for c in ("entry", "packages", "settings", "signals", "roles")]
    said = signals.groupBy("repo_id").agg(
        F.max(contains_any(F.lower("text"), fixed.RESEND_WORDS)).alias("resends"),
        F.max(contains_any(F.lower("text"), fixed.SEND_WORDS)).alias("sends"),
        F.max(contains_any(F.lower("text"), fixed.RECEIVE_WORDS)).alias("receives"),
    )
    kept = ["repo_id", F.coalesce("display_name", "repo_id").alias("display_name"), "role", "outbound", "inbound", "transform", "config_port", "config_url", *texts]
    return out.select(*kept).join(said, "repo_id", "left").fillna(False, ["resends", "sends", "receives"])


def repo_relations(members: DataFrame, summary: DataFrame, limit: int = fixed.RELATIONS) -> DataFrame:
    """(project_id, from_repo_id, to_repo_id, rule, position): how repositories of a project (project_id, repo_id) feed each
    other, by the first rule that holds, up to ``limit`` per project.

    1: one sends and another takes in, and the first changes nothing or only produces. 2: it takes in itself and sends on
    what it got. 3: both have ports set, one sends and the other receives.
    """
    rows = members.distinct().join(summary, "repo_id")
    a = rows.select("project_id", *[F.col(c).alias(f"a_{c}") for c in summary.columns])
    b = rows.select("project_id", *[F.col(c).alias(f"b_{c}") for c in summary.columns])
    pairs = a.join(b, "project_id").where("a_repo_id <> b_repo_id")  # few repositories a project
    out, into = F.col("a_outbound") > 0, F.col("b_inbound") > 0
    rule = (
        F.when(out & into & ((F.col("a_transform") == 0) | (F.col("a_role") == "producer")), 1)
        .when(out & into & (F.col("a_inbound") > 0) & F.col("a_resends"), 2)
        .when(out & into & (F.col("a_config_port") > 0) & (F.col("b_config_port") > 0) & F.col("a_sends") & F.col("b_receives"), 3)
    )
    w = Window.partitionBy("project_id").orderBy("a_repo_id", "b_repo_id")
    found = pairs.withColumn("rule", rule).where("rule is not null").withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)
    return found.select("project_id", F.col("a_repo_id").alias("from_repo_id"), F.col("b_repo_id").alias("to_repo_id"), "rule", "position")


def overview(members: DataFrame, summary: DataFrame, relations: DataFrame) -> DataFrame:
    """(project_id, overview): four lines per repository, then the relations; what a question about structure is given."""
    lines = F.concat(
        F.lit("- repo="), "display_name", F.lit(", role="), "role", F.lit(", entry="), "entry", F.lit("\n  packages="), "packages", F.lit(", roles="), "roles",
        F.lit("\n  config="), "settings", F.lit("\n  signals="), "signals",
    )
    repos = members.distinct().join(summary, "repo_id").groupBy("project_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("repo_id", lines.alias("x")))), lambda y: y["x"]), "\n").alias("repos"))
    names = summary.select(F.col("repo_id"), F.col("display_name"))
    told = relations.join(names.toDF("from_repo_id", "a"), "from_repo_id").join(names.toDF("to_repo_id", "b"), "to_repo_id").groupBy("project_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", F.concat(F.lit("- "), "a", F.lit(" -> "), "b").alias("x")))), lambda y: y["x"]), "\n").alias("told"))
    text = F.concat(F.lit("[프로젝트 개요]\n"), "repos", F.coalesce(F.concat(F.lit("\n[관계 요약]\n"), "told"), F.lit("")))
    return repos.join(told, "project_id", "left").select("project_id", text.alias("overview"))
