"""Review-text expressions. All are built-in functions, so they stay in codegen."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewmill.schema import MAX_TOKENS, MIN_TOKENS

# Unicode whitespace as a regex class body; the JVM's `\s` covers less.
WS_NOT_SPACE = (
    r"\t-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WS = " " + WS_NOT_SPACE
HTML_TAG = "<[^>]+>"
URL = rf"(?i)https?://[^{WS}]+|www\.[^{WS}]+"
# A keyword is a Cyrillic or Latin word of three or more letters or hyphens.
LETTER = "а-яёa-zA-Z"
WORD_CHAR = r"\p{L}\p{N}_"
KEYWORD = (
    rf"(?<![{WORD_CHAR}])[{LETTER}][{LETTER}\-]{{2,}}"
    rf"(?:(?<=-)(?=[{WORD_CHAR}])|(?<!-)(?![{WORD_CHAR}]))"
)


def strip_nul(df: DataFrame) -> DataFrame:
    """Remove NUL characters from every string column; values without one are not rewritten."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({
        n: F.when(F.contains(F.col(n), F.lit("\x00")), F.translate(F.col(n), "\x00", "")).otherwise(F.col(n))
        for n in names})


def _bound(value: Column, made: Callable[[Column], Column]) -> Column:
    """`made` of a value that it uses several times; a lambda's argument is computed once."""
    return F.transform(F.array(value), made)[0]


def strip_html(text: Column) -> Column:
    """Tags become a space; texts without a `<` are not searched by the pattern."""
    return _bound(text, lambda t: F.when(
        F.contains(t, F.lit("<")), F.regexp_replace(t, HTML_TAG, " ")).otherwise(t))


def strip_urls(text: Column) -> Column:
    """Links become a space; texts that hold no beginning of one are not searched by the pattern."""
    return _bound(text, lambda t: F.when(
        F.contains(t, F.lit("://")) | F.contains(F.lower(t), F.lit("www.")),
        F.regexp_replace(t, URL, " ")).otherwise(t))


def tokens(text: Column) -> Column:
    """The parts of a text between whitespace.

    Other whitespace becomes a space first. Splitting at a literal space is several times
    cheaper than at the class, whose many ranges are tried for non-ASCII characters only here.
    """
    spaced = F.regexp_replace(text, f"[^ -~](?<=[{WS_NOT_SPACE}])", " ")
    return F.array_remove(F.split(spaced, " "), "")


def collapse_ws(text: Column) -> Column:
    """Every whitespace run becomes one space; none at either end."""
    return F.array_join(tokens(text), " ")


def truncate_tokens(text: Column, limit: int = MAX_TOKENS) -> Column:
    """The first `limit` tokens of a text whose tokens are single-space separated."""
    return F.substring_index(text, " ", limit)


def clean_text(text: Column) -> Column:
    """Drop tags and links, lower, collapse whitespace, keep the first 512 tokens.

    Of a long text only the part before a space is cleaned if it holds enough tokens, as no
    token or link reaches over a space. A text with a `<`, whose tag may have any length, is
    cleaned as a whole.
    """
    def found(part: Column) -> Column:
        lowered = F.lower(F.when(F.contains(part, F.lit("<")), F.regexp_replace(part, HTML_TAG, " ")).otherwise(part))
        return tokens(_bound(lowered, lambda t: F.when(
            F.contains(t, F.lit("://")) | F.contains(t, F.lit("www.")), F.regexp_replace(t, URL, " ")).otherwise(t)))

    def joined(part: Column, whole: Column) -> Column:
        return _bound(found(part), lambda first: F.array_join(F.slice(F.when(
            (F.size(first) >= MAX_TOKENS) | (F.octet_length(part) == F.octet_length(whole)), first,
        ).otherwise(found(whole)), 1, MAX_TOKENS), " "))

    def cleaned(whole: Column) -> Column:
        head = F.substring_index(whole, " ", MAX_TOKENS + MAX_TOKENS // 8)
        part = F.when(F.contains(whole, F.lit("<")), whole).otherwise(head)
        return _bound(part, lambda p: joined(p, whole))

    return _bound(F.coalesce(text, F.lit("")), cleaned)


def token_count(text: Column) -> Column:
    """Number of whitespace-separated tokens of a raw text; null counts as empty."""
    return F.size(tokens(F.coalesce(text, F.lit(""))))


def has_enough_tokens(clean: Column, least: int = MIN_TOKENS) -> Column:
    """Whether a single-space separated text has `least` tokens; reads no further than that."""
    return clean.rlike(f"^(?:[^ ]+ ){{{least - 1}}}[^ ]")


def computed_once(value: Column) -> Column:
    """A column that filters on it will not compute again.

    Catalyst pushes a filter below a projection by repeating the expression in
    it, but it cannot move one below the generator that this makes.
    """
    return F.explode(F.array(value))


def is_not_blank(text: Column) -> Column:
    """True when the text holds any non-whitespace character; false for null."""
    return F.coalesce(text.rlike(f"[^{WS}]"), F.lit(False))


def review_key(nm_id: Column, text: Column) -> Column:
    """Stable review identity: 32 hex digits of the digest of product number and text."""
    return F.substring(F.sha2(F.concat_ws(":", nm_id.cast("string"), text), 256), 1, 32)


def keyword_tokens(text: Column) -> Column:
    """Keyword tokens of the lowered text, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(KEYWORD), 0)


def ngrams(text: Column) -> Column:
    """Keyword tokens followed by the pairs of neighbouring tokens.

    The tokens are bound as a lambda's argument, so the text is matched once.
    """
    return F.transform(F.array(keyword_tokens(text)), lambda tokens: F.concat(tokens, _pairs(tokens)))[0]


def ngram_counts(text: Column) -> Column:
    """Distinct `term`s of `ngrams` with their number `n`, counted inside the row.

    The sorted terms and the places where a new term starts are bound as lambdas' arguments.
    """
    def counts(terms: Column, starts: Column) -> Column:
        return F.transform(starts, lambda i, k: F.struct(
            F.get(terms, i).alias("term"),
            (F.coalesce(F.get(starts, k + 1), F.size(terms)) - i).cast("long").alias("n")))

    def of_sorted(terms: Column) -> Column:
        places = F.when(F.size(terms) > 0, F.sequence(F.lit(0), F.size(terms) - 1))
        starts = F.filter(places, lambda i: (i == 0) | (F.get(terms, i) != F.get(terms, i - 1)))
        return F.transform(F.array(starts), lambda found: counts(terms, found))[0]

    return F.transform(F.array(F.sort_array(ngrams(text))), of_sorted)[0]


def neighbours(tokens: Column) -> Column:
    """Structs `a`, `b` of each token and the next."""
    return F.arrays_zip(
        F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))).alias("a"),
        F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))).alias("b"),
    )


def _pairs(tokens: Column) -> Column:
    return F.transform(neighbours(tokens), lambda p: F.concat_ws(" ", p["a"], p["b"]))
