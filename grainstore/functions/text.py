"""Column builders on questions, paths and texts; all of them built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from grainstore.functions import fixed


def strip(text: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalized(text: Column) -> Column:
    """No-break spaces and runs of blanks as one blank, at most one empty line in a row, no outer white space."""
    text = F.replace(F.coalesce(text, F.lit("")), F.lit(" "), F.lit(" "))
    return strip(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def _quoted(question: Column) -> list[Column]:
    return [F.transform(F.regexp_extract_all(question, F.lit(f"{q}([^{q}]+){q}"), F.lit(1)), strip) for q in ("'", '"', "`")]


def keywords(question: Column) -> Column:
    """Search keywords of a question, longest first, at most eight; an empty array for a blank one.

    In order of first sight: quoted parts by kind of quote; paths, each with its last segment; ASCII identifiers;
    white-space tokens with a particle cut off. Ties in length go by lower case, then by order.
    """
    q = strip(F.coalesce(question, F.lit("")))
    paths = F.flatten(
        F.transform(
            F.regexp_extract_all(q, F.lit(r"/[A-Za-z0-9_\-./{}]+"), F.lit(0)),
            lambda p: F.array(p, F.substring_index(F.regexp_replace(p, "/+$", ""), "/", -1)),
        )
    )
    # a whole word of letters, digits and underscores that is ASCII; a word that goes on in Hangul is none
    words = F.regexp_extract_all(q, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    names = F.filter(
        words,
        lambda w: w.rlike("^[A-Za-z_][A-Za-z0-9_]+$") & ~F.lower(w).isin(*fixed.STOP_WORDS, *fixed.SKIPPED_IDENTIFIERS),
    )
    tokens = F.split(F.regexp_replace(q, r"(?U)[^\w\s/.\-`\"']", " "), r"(?U)\s+")
    cut = F.transform(tokens, lambda t: F.regexp_replace(t, f"({'|'.join(fixed.PARTICLES)})$", ""))
    kept = F.filter(
        cut,
        lambda t: (F.length(t) > 0) & ~t.isin(*fixed.STOP_WORDS) & ~F.lower(t).isin(*fixed.STOP_WORDS)
        & (t.rlike(r"[A-Za-z0-9_/.\-]") | (F.length(t) >= 2)),
    )
    found = F.array_distinct(F.filter(F.concat(*_quoted(q), paths, names, kept), lambda t: F.length(t) > 0))
    found = F.filter(found, lambda t: ~t.isin(*fixed.BANNED_KEYWORDS))
    ranked = F.array_sort(F.transform(found, lambda t, i: F.struct((-F.length(t)).alias("n"), F.lower(t).alias("low"), i.alias("i"), t.alias("t"))))
    return F.slice(F.transform(ranked, lambda r: r["t"]), 1, fixed.MAX_KEYWORDS)


def symbol_hints(found: Column) -> Column:
    """Those keywords that look like a symbol: with an upper-case letter or an underscore."""
    return F.filter(found, lambda t: t.rlike("[A-Z]") | t.contains("_"))


def question_type(question: Column) -> Column:
    """``structure`` or ``general``, by substrings."""
    return F.when(contains_any(F.lower(F.coalesce(question, F.lit(""))), fixed.STRUCTURE_QUESTION), "structure").otherwise("general")


def rerank_limit(kind: Column, repos: Column, default: int = fixed.RERANK_LIMIT) -> Column:
    """More hits for questions about structure when there are repositories."""
    more = F.greatest(F.lit(default), F.least(F.lit(24), default + F.greatest(F.lit(6), 2 * repos)))
    return F.when((kind == "structure") & (repos > 0), more).otherwise(default).cast("int")


def identifier_tokens(value: Column) -> Column:
    """Pieces of an identifier in lower case, split at marks and humps, and the pieces joined."""
    x = F.regexp_replace(value, r"[_\-]+", " ")
    x = F.regexp_replace(x, "([a-z0-9])([A-Z])", "$1 $2")
    x = F.regexp_replace(x, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    pieces = F.filter(F.split(F.lower(F.regexp_replace(x, "[^A-Za-z0-9]+", " ")), " "), lambda p: F.length(p) > 0)
    return F.array_distinct(F.concat(pieces, F.array(F.array_join(pieces, ""))))


def search_tokens(value: Column) -> Column:
    """Tokens of a path or keyword: those of each part between slashes and dots, and all of it without marks; two
    characters at least."""
    raw = F.translate(strip(F.coalesce(value, F.lit(""))), "\\", "/")
    parts = F.flatten(F.transform(F.split(raw, "[/.]+"), identifier_tokens))
    whole = F.lower(F.regexp_replace(raw, "[^A-Za-z0-9]", ""))
    return F.filter(F.array_distinct(F.concat(parts, F.array(whole))), lambda t: F.length(t) >= 2)


def matches_path(keyword: Column, path: Column, path_tokens: Column) -> Column:
    """A keyword is in a path as it stands, or all its tokens are the path's; one without tokens is in every path."""
    return F.lower(path).contains(F.lower(keyword)) | (F.size(F.array_except(search_tokens(keyword), path_tokens)) == 0)


def found_in(words: Column, text: Column) -> Column:
    """Those of the words that a text contains, without regard to case; empty words are none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(words, lambda w: (F.length(w) > 0) & low.contains(F.lower(w)))


# ---------------------------------------------------------------- scores


def path_relevance(kind: Column, question: Column, path: Column) -> Column:
    """0.6 per token of the path in the question, repetitions included, and 1.2 for its file name; weighed and capped."""
    q = F.lower(question)
    low = F.lower(F.translate(F.coalesce(path, F.lit("")), "\\", "/"))
    hits = F.size(F.filter(F.split(low, r"[/_.\-]"), lambda t: (F.length(t) >= 3) & q.contains(t)))
    name = F.lower(F.substring_index(F.regexp_replace(F.coalesce(path, F.lit("")), "/+$", ""), "/", -1))
    score = hits * 0.6 + F.when((F.length(name) > 0) & q.contains(name), 1.2).otherwise(0.0)
    return F.when(kind == "structure", F.least(F.lit(3.0), score * 1.1)).otherwise(F.least(F.lit(2.0), score * 0.85))


def symbol_relevance(kind: Column, there: Column) -> Column:
    """``there``: the hints found on the path or in the text."""
    return F.least(F.when(kind == "structure", 2.0).otherwise(3.0), there.cast("double"))


def phrases_in(question: Column, text: Column) -> Column:
    """Quoted phrases of the question in the text; quotes are read in one pass."""
    quoted = F.regexp_extract_all(question, F.lit("'[^']+'|\"[^\"]+\"|`[^`]+`"), F.lit(0))
    low = F.lower(text)
    return F.size(F.filter(quoted, lambda p: low.contains(F.lower(F.substring(p, F.lit(2), F.length(p) - 2)))))


def phrase_bonus(question: Column, text: Column) -> Column:
    """0.75 per quoted phrase of the question in the text, at most 1.5."""
    return F.least(F.lit(1.5), phrases_in(question, text) * 0.75)


def structure_bonus(question: Column, path: Column, is_path: Column, source: Column) -> Column:
    """Only for questions with a word of structure: for path hits, depth, words of the path and hits on the path itself."""
    depth = F.size(F.filter(F.split(path, "/"), lambda p: F.length(p) > 0))
    low = F.lower(path)
    words = reduce(lambda a, b: a + b, [F.when(low.contains(w), 1).otherwise(0) for w in fixed.PATH_WORDS])
    score = (
        F.when(source == "path", 1.5).otherwise(0.0)
        + F.when(depth >= 2, F.least(F.lit(1.2), depth * 0.15)).otherwise(0.0)
        + words * 0.2
        + F.when(is_path, 0.4).otherwise(0.0)
    )
    return F.when(contains_any(F.lower(question), fixed.STRUCTURE_BONUS), F.least(F.lit(3.0), score)).otherwise(0.0)


def text_marks(source: Column, text: Column, path: Column, question: Column, words: Column, hints: Column) -> Column:
    """All that the score of a hit takes from its text, as a few numbers; where they are, the text need not go along."""
    lexical = source.isin("keyword", "path")
    return F.struct(
        F.size(found_in(hints, F.concat(F.coalesce(path, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit(""))))).alias("symbols"),
        F.when(lexical, phrases_in(question, text)).alias("phrases"),
        F.when(~lexical, F.size(found_in(words, text))).alias("overlap"),
        (text == path).alias("is_path"),
    )


def hit_score(hit: dict[str, Column], question: Column, kind: Column, words: Column, hints: Column) -> Column:
    """The score of a hit, rounded once: keyword and path hits by matches, others by distance and overlap.

    ``hit`` has source, path, text or instead the ``marks`` of it, matched (array), distance and is_code (code with a
    start line).
    """
    marks = hit["marks"] if "marks" in hit else text_marks(hit["source"], hit["text"], hit["path"], question, words, hints)
    related = path_relevance(kind, question, hit["path"]) + symbol_relevance(kind, marks["symbols"])
    lexical = (
        F.when(hit["source"] == "keyword", 2.0).otherwise(1.2)
        + F.least(F.lit(2.5), F.size(F.coalesce(hit["matched"], F.array().cast("array<string>"))) * 0.9)
        + related
        + F.least(F.lit(1.5), marks["phrases"] * 0.75)
        + structure_bonus(question, hit["path"], marks["is_path"], hit["source"])
    )
    overlap = marks["overlap"]
    general = kind == "general"
    near = (
        F.greatest(F.lit(0.0), 1.6 - hit["distance"]) * F.when(general, 1.2).otherwise(0.8)
        + F.when(general, F.least(F.lit(2.4), overlap * 0.45)).otherwise(F.least(F.lit(2.0), overlap * 0.3))
        + related
        + F.when(hit["is_code"], 0.2).otherwise(0.0)
    )
    return F.round(F.when(hit["source"].isin("keyword", "path"), lexical).otherwise(near), 4)
