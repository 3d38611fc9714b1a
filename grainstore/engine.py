"""The engine as one object: ingest files, search, ask and evaluate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainstore.operators import search
from grainstore.operators.store import in_scope
from grainstore.sources import files


class Engine:
    """Chunks of documents and source files, and what is asked of them.

    ``embedder`` turns texts into vectors, ``generator`` a prompt into an answer; both can be put in, and neither needs a
    network by default: vectors are hashed words, and without a generator there are only prompts.
    """

    def __init__(self, spark: SparkSession, text_chunks: DataFrame | None = None, code_chunks: DataFrame | None = None, embedder=None, generator: Callable[[str], str] | None = None):
        self.spark, self.embedder, self.generator = spark, embedder, generator
        self.text_chunks, self.code_chunks = text_chunks, code_chunks

    def ingest(self, uploads: DataFrame, config: files.SourceConfig = files.SourceConfig()) -> DataFrame:
        """Add uploads (filename, content); gives the files that couldn't be read. A chunk that is there is not added."""
        text, code, errors = files.ingest(uploads, config)
        for name, new in (("text_chunks", text), ("code_chunks", code)):
            old = getattr(self, name)
            setattr(self, name, new if old is None else old.unionByName(new.join(old.select("chunk_id"), "chunk_id", "left_anti"), allowMissingColumns=True))
        return errors

    def search(self, questions: DataFrame, scope: DataFrame | None = None, config: search.SearchConfig = search.SearchConfig()) -> DataFrame:
        """Citations of questions (question_id, question), in a scope (kind, ref_id) if one is given."""
        text, code = self.text_chunks, self.code_chunks
        if scope is not None:
            text = in_scope(text.withColumns({"kind": F.lit("doc"), "ref_id": F.col("doc_id")}), scope).drop("kind", "ref_id")
            code = in_scope(code.withColumns({"kind": F.lit("code"), "ref_id": F.col("repo_id")}), scope).drop("kind", "ref_id")
        return search.hybrid_search(code, text, questions, config, self.embedder)

    def prompts(self, questions: DataFrame, scope: DataFrame | None = None) -> DataFrame:
        """(question_id, prompt): the question after the context found for it; without hits the question alone."""
        context = search.context(self.search(questions, scope))
        text = F.concat_ws("\n\n", F.col("context"), F.concat(F.lit("Question: "), F.col("question")))
        return questions.join(context, "question_id", "left").select("question_id", text.alias("prompt"))

    def ask(self, questions: DataFrame, scope: DataFrame | None = None) -> DataFrame:
        """(question_id, answer) by the generator, one call per question."""
        if self.generator is None:
            raise ValueError("no generator")
        answer = F.udf(self.generator, "string")
        return self.prompts(questions, scope).select("question_id", answer("prompt").alias("answer"))

    def evaluate(self, cases: DataFrame) -> DataFrame:
        """(total, passed, accuracy) of cases (question_id, question, expected_top_path): the first citation's path."""
        top = self.search(cases.select("question_id", "question")).where("position = 1").select("question_id", "path")
        passed = F.coalesce(F.col("path") == F.col("expected_top_path"), F.lit(False))
        rows = cases.select("question_id", "expected_top_path").distinct().join(top, "question_id", "left").select(passed.alias("ok"))
        return rows.agg(F.count("*").alias("total"), F.count_if("ok").alias("passed"), F.round(F.coalesce(F.avg(F.col("ok").cast("int")), F.lit(0.0)), 4).alias("accuracy"))
