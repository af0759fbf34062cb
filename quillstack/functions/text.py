"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of an excerpt, of a judged text and of an answer's sources; bytes a token is taken to have.
EXCERPT, JUDGED, BYTES_PER_TOKEN = 200, 16_000, 3


def tokens(text: Column) -> Column:
    """Lower-cased runs of a-z, 0-9 and underscore, with repeats; the simple analyzer."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))


def token_set(heading: Column, text: Column) -> Column:
    """Distinct tokens of a chunk for exact identifier matches: 64 characters or more are no token, outer underscores go."""
    joined = F.lower(F.concat_ws(" ", heading, text))
    short = F.regexp_replace(joined, "[a-z0-9_]{64,}", " ")
    return F.array_distinct(F.filter(F.split(short, "_*[^a-z0-9_]+_*|^_+|_+$"), lambda t: t != ""))


def identifier_terms(question: Column) -> Column:
    """Identifiers of a question, sorted: words with a letter and an underscore or a digit, under 64 characters."""
    odd = F.filter(F.split(question, "[^A-Za-z0-9_]+"), lambda w: w.rlike("[_0-9]") & w.rlike("[A-Za-z]"))  # few words: only they are trimmed
    trimmed = F.transform(odd, lambda w: F.regexp_replace(w, "^_+|_+$", ""))
    kept = F.filter(trimmed, lambda w: (F.length(w) < 64) & w.rlike("[A-Za-z]") & w.rlike("[_0-9]"))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda w: F.lower(w))))


def embedding_input(title: Column, heading: Column, text: Column) -> Column:
    return F.concat(title, F.when(heading.isNotNull(), F.concat(F.lit("\n"), heading)).otherwise(F.lit("")), F.lit("\n\n"), text)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.octet_length(text) / BYTES_PER_TOKEN).cast("long")


def excerpt(text: Column) -> Column:
    cut = F.rtrim(F.left(F.trim(text), F.lit(EXCERPT)))
    return F.when(F.char_length(F.trim(text)) > EXCERPT, F.concat(cut, F.lit("…"))).otherwise(F.trim(text))


def judged_text(title: Column, heading: Column, text: Column) -> Column:
    path = F.when(heading.isNotNull(), F.concat(title, F.lit(" > "), heading)).otherwise(title)
    return F.concat(path, F.lit("\n\n"), F.left(text, F.lit(JUDGED)))


def normalized(text: Column) -> Column:
    """For quote checks: lower case, without white space and quotation marks."""
    return F.regexp_replace(F.lower(text), "[\\s`\"'“”‘’]+", "")


def quoted_spans(text: Column) -> Column:
    """Texts between backticks, straight or curly double quotes; blank ones are skipped."""
    found = F.regexp_extract_all(text, F.lit("`[^`]*`|\"[^\"]*\"|“[^”]*”"), F.lit(0))
    inner = F.transform(found, lambda q: F.substring(q, F.lit(2), F.char_length(q) - 2))
    return F.filter(inner, lambda q: F.trim(q) != "")


def quotes_found(claim: Column, sources: Column) -> Column:
    """Does each quoted span of a claim stand in one of the sources (array<string>)?"""
    return F.forall(quoted_spans(claim), lambda q: F.exists(sources, lambda s: F.contains(normalized(s), normalized(q))))


def same_text(a: Column, b: Column) -> Column:
    return F.lower(F.trim(a)) == F.lower(F.trim(b))


def escape_markup(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


#: White space of any script, as a part of a character class.
WHITE = r"\s\p{Z}\x85"


def github_anchor(heading: Column) -> Column:
    """URL fragment of a heading: lower case, ASCII letters, digits, hyphens and underscores; white space, of any script, is
    a hyphen, but not after one; hyphens at the ends go."""
    kept = F.regexp_replace(F.lower(heading), f"[^a-z0-9_{WHITE}-]", "")
    return F.btrim(F.regexp_replace(F.regexp_replace(kept, f"(?<=-)[{WHITE}]+", ""), f"[{WHITE}]+", "-"), F.lit("-"))


def chunk_version(title: Column, heading: Column, url: Column, text: Column, authoritative: Column, acl: Column, sensitivity: Column, model: Column, model_version: Column) -> Column:
    """SHA-256 of all that a chunk's version depends on."""
    content = F.struct(
        title.alias("title"), heading.alias("heading"), url.alias("url"), text.alias("text"), authoritative.alias("authoritative"),
        F.struct(acl.alias("acl"), sensitivity.alias("sensitivity")).alias("labels"), F.struct(model.alias("id"), model_version.alias("version")).alias("embedding_model"),
    )
    return F.sha2(F.to_json(content, {"ignoreNullFields": "false"}), 256)
