"""Text expressions: HTML cleaning, sentences, tokens, quoted words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word characters are Unicode letters, digits and underscore; a token is a whole run of
# two or more ASCII letters. `\b` is avoided because its meaning differs between regex engines.
TOKEN_PATTERN = r"(?<![\p{L}\p{N}_])[a-z]{2,}(?![\p{L}\p{N}_])"

# Removed with their content, in this order, then all remaining tags.
HTML_BLOCKS = [r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?s)<!--.*?-->", r"(?s)<[^>]+>"]

# Entities decoded after the tags are gone; &amp; last, so that it is decoded once.
HTML_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]

SPACE_RUN = r"[ \t\r\n\f]+"
SENTENCE_END = r"[.!?]+[ \t\r\n\f]+|[\r\n]+"

# The literal pattern allows one letter after the underscore; the intended one whole words.
QUOTED_WORD_LITERAL = r"'([A-Za-z]+_?[A-Za-z])'"
QUOTED_WORD_INTENDED = r"'([A-Za-z]+(?:_[A-Za-z]+)*)'"

# Common English words left out of word-cloud counts.
STOPWORDS = (
    "a about after all also an and any are as at be been but by can could did do does for from had has have he "
    "her his how if in into is it its may more no not of on only or other our out over she so some such than "
    "that the their them then there these they this to under up was we were what when which who will with would "
    "you your"
).split()


def tokenize(text: Column) -> Column:
    """Lower-cased words of two or more ASCII letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def html_to_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles, comments and tags out, entities decoded, blanks folded."""
    out = html
    for pattern in HTML_BLOCKS:
        out = F.regexp_replace(out, pattern, " ")
    for entity, char in HTML_ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, SPACE_RUN, " "))


def sentences(text: Column, min_words: int = 6) -> Column:
    """Sentences with at least `min_words` blank-separated words."""
    parts = F.transform(F.split(text, SENTENCE_END), lambda s: F.trim(F.regexp_replace(s, SPACE_RUN, " ")))
    return F.filter(parts, lambda s: F.size(F.filter(F.split(s, " "), lambda w: w != "")) >= min_words)


def join_tokens(tokens: Column) -> Column:
    """Tokens joined by one blank."""
    return F.array_join(tokens, " ")


def join_documents(documents: Column) -> Column:
    """Array of token arrays, flattened and joined by one blank."""
    return F.array_join(F.flatten(documents), " ")


def glue_documents(documents: Column) -> Column:
    """Array of token arrays joined without a separator."""
    return F.array_join(F.flatten(documents), "")


def split_blank(text: Column) -> Column:
    return F.split(text, " ")


def keep_letters(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z]", "")


def words_in_double_quotes(topic: Column) -> Column:
    """Words of a printed topic such as 0.1*"health" + 0.2*"data"."""
    return F.regexp_extract_all(topic, F.lit('"(.*?)"'), F.lit(1))


def words_in_single_quotes(topwords: Column, literal: bool = False) -> Column:
    """Words of a printed list of lists, joined by blanks."""
    pattern = QUOTED_WORD_LITERAL if literal else QUOTED_WORD_INTENDED
    return F.array_join(F.regexp_extract_all(topwords, F.lit(pattern), F.lit(1)), " ")


def printed_word_lists(words: Column) -> Column:
    """array<array<string>> printed as [['a', 'b'], ['c']]."""
    inner = F.transform(words, lambda ws: F.concat(F.lit("['"), F.array_join(ws, "', '"), F.lit("']")))
    return F.concat(F.lit("["), F.array_join(inner, ", "), F.lit("]"))
