"""Text, path and number functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accented letters and the letters they are searched as.
ACCENTS, PLAIN = "àâäáãåéèêëíìîïóòôöõúùûüýÿçñ", "aaaaaaeeeeiiiiooooouuuuyycn"
#: Words left out of queries.
STOPWORDS = ["the", "and", "for", "with", "from", "that", "this", "are", "was", "not", "but", "all", "can", "its", "use", "via", "per", "than", "into"]
#: Words of a hint that don't count for recall.
HINT_SKIP = ["any", "file", "importing", "or", "similar"]
CHARS_PER_TOKEN, MAX_NODE_TOKENS = 4, 1024


def fts_tokens(c: Column) -> Column:
    """Full-text tokens: case-folded, accents stripped, runs of letters and digits. Null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(F.translate(F.lower(c), ACCENTS, PLAIN), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


def vector_terms(c: Column) -> Column:
    """Terms of the sparse vectors: lower-cased runs of letters, digits and underscores of at least three, not beginning with a digit."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.coalesce(F.filter(runs, lambda t: t.rlike(r"^[a-z_][\p{L}\p{N}_]{2,}$")), F.array().cast("array<string>"))


def _once(c: Column, use) -> Column:
    """``use`` of a value that is computed once for each row. Written out, it is computed again at each mention, and within a lambda for each element."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def _first_of_case(words: Column) -> Column:
    """The words without those that differ from an earlier one in case only. By sorting, so in n log n steps for any number of words."""
    keyed = F.sort_array(F.transform(words, lambda t, i: F.struct(F.lower(t).alias("folded"), i.alias("at"))))
    kept = _once(keyed, lambda k: F.filter(k, lambda x, i: (i == 0) | (x.folded != F.get(k, i - 1).folded)))
    return F.transform(F.sort_array(F.transform(kept, lambda x: x["at"])), lambda i: F.get(words, i))


def query_terms(c: Column) -> Column:
    """Identifier-like words of a query in order: at least three characters, no stop words, each once whatever its case."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit("[A-Za-z][A-Za-z0-9_]{2,}"), F.lit(0)))
    return _once(F.filter(found, lambda t: ~F.lower(t).isin(STOPWORDS)), _first_of_case)


def fts_query(c: Column) -> Column:
    """Query terms joined by OR; a query without terms is its own first 50 characters."""
    return _once(query_terms(c), lambda t: F.when(F.size(t) > 0, F.array_join(t, " OR ")).otherwise(F.substring(c, 1, 50)))


def approx_tokens(c: Column) -> Column:
    """A quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / CHARS_PER_TOKEN)).cast("int")


def shorten(c: Column, width: int = MAX_NODE_TOKENS * CHARS_PER_TOKEN) -> Column:
    """White space collapsed; a longer text is cut at a word so that it has at most ``width`` characters with its closing ellipsis."""
    t = F.trim(F.regexp_replace(c, r"\s+", " "))
    head = F.substring(t, 1, width - 1)
    whole = F.substring(t, width, 1) == " "
    cut = F.when(whole, F.rtrim(head)).otherwise(F.regexp_extract(head, r"^(.*\S)\s", 1))
    return F.when(F.length(t) > width, F.concat(F.when(cut == "", head).otherwise(cut), F.lit("…"))).otherwise(t)


def node_text(kind: Column, fqn: Column, signature: Column, docstring: Column | None = None) -> Column:
    """What a node costs in a context: kind and FQN, signature and, if given, docstring, on lines of their own."""
    lines = [F.concat_ws(" ", kind, fqn), F.coalesce(signature, F.lit(""))] + ([] if docstring is None else [F.coalesce(docstring, F.lit(""))])
    return F.concat_ws("\n", *lines)


def heading_slug(c: Column) -> Column:
    """A heading as an identifier: letters, digits, blanks and underscores, 60 characters, blanks to underscores."""
    return F.replace(F.substring(F.trim(F.regexp_replace(c, r"[^A-Za-z0-9_\s]", "")), 1, 60), F.lit(" "), F.lit("_"))


def diagram_id(c: Column) -> Column:
    """An FQN as a diagram identifier."""
    return F.translate(F.replace(c, F.lit("::"), F.lit("__")), "./-", "___")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def hint_parts(hint: Column) -> Column:
    """Words of a hint that count for recall."""
    return F.filter(F.split(F.lower(hint), r"[/\\._ ]"), lambda t: (F.length(t) >= 3) & ~t.isin(HINT_SKIP))


def recalled(hint: Column, found: Column) -> Column:
    """Whether at least half of the hint's words, and at least one, occur in a text. A hint without words is never recalled."""
    p = hint_parts(hint)
    hits = F.size(F.filter(p, lambda t: F.contains(F.lower(found), t)))
    return F.coalesce((F.size(p) > 0) & (hits >= F.greatest(F.lit(1), F.floor(F.size(p) / 2))), F.lit(False))


def savings_ratio(baseline: Column, ours: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(baseline.cast("double"), ours.cast("double")), F.lit(0.0)), 2)


def percent_saved(baseline: Column, ours: Column) -> Column:
    return F.round(F.coalesce(100 * (1 - F.try_divide(ours.cast("double"), baseline.cast("double"))), F.lit(0.0)), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def savings_summary(t: DataFrame) -> DataFrame:
    """One row over ours, base: average ratio and percentage, wins, totals, overall percentage."""
    t = t.select("ours", "base", savings_ratio(F.col("base"), F.col("ours")).alias("ratio"), percent_saved(F.col("base"), F.col("ours")).alias("pct"))
    overall = 100 * (1 - F.try_divide(F.sum("ours").cast("double"), F.sum("base").cast("double")))
    return t.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ratio"), 6).alias("avg_ratio"), F.round(F.avg("pct"), 6).alias("avg_pct"), F.count_if(F.col("ours") < F.col("base")).alias("wins"), F.sum("ours").alias("ours"), F.sum("base").alias("base"), F.round(overall, 6).alias("overall_pct"))
