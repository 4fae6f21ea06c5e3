"""Line-first quality rules, in DataFrame functions only.

Each line with a word is judged by itself: symbols and exclamation marks in place of punctuation, long lines without any sentence end,
separators and words of menus, shouting, and stock phrases of sites and licences in four languages. Lines that fail are removed; a document that loses too much of its text is rejected.
Before that, a document fails on its own counts: too few words, or mostly repeated three-word windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the rules.
SYMBOLS = "#*$%&|<>"  # as a class of a pattern, like the next
SEPARATORS = "|»›•·"
BOILERPLATE = (
    r"(all rights reserved|terms of (use|service)|privacy policy|we use cookies|enable javascript|subscribe to our|"
    r"sign up for our|click here to|(licensed|released) under|this work is licensed|lorem ipsum|powered by|"
    r"share on (facebook|twitter)|skip to (main )?content|"
    r"alle rechte vorbehalten|wir verwenden cookies|javascript aktivieren|newsletter abonnieren|zum inhalt springen|"
    r"tous droits réservés|nous utilisons des cookies|activer javascript|aller au contenu|"
    r"todos los derechos reservados|utilizamos cookies|active javascript|saltar al contenido)"
)
BOILERPLATE_CHARS = 200  # longer lines are prose that mentions such a phrase
MENU_WORDS = (
    r"\b(home|about( us)?|contact( us)?|log ?in|sign ?(in|up)|search|menu|sitemap|faq|help|"
    r"startseite|kontakt|anmelden|suche|impressum|datenschutz|hilfe|"
    r"accueil|connexion|recherche|aide|mentions légales|"
    r"inicio|contacto|iniciar sesión|buscar|ayuda|aviso legal)\b"
)
MENU_SEPARATORS = "[ /|>»·,-]"
ENDS = "[.!?…。．！？؟۔।॥]"  # of sentences
NO_ENDS = "[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF]"  # Thai, Lao, Burmese, Khmer: scripts without marks for them
PLAIN_WORDS = 25  # so many words without a sentence end are no running text
MIN_WORDS = 50
REPEAT_PERCENT = 50
LOST_PERCENT = 30

BLANKS = "[\\x20\\x09-\\x0D]+"


def count_chars(text: Column, chars: str) -> Column:
    return F.regexp_count(text, F.lit(f"[{chars}]"))


def line_fails(line: Column) -> Column:
    """Whether one line is no running text."""
    words = count_chars(line, " ") + 1
    separators, marks = count_chars(line, SEPARATORS), count_chars(line, "!")
    symbols = count_chars(line, SYMBOLS) * 10 > F.length(line)
    endless = (words >= PLAIN_WORDS) & ~line.rlike(ENDS) & ~line.rlike(NO_ENDS)
    # Menu words are taken out one by one: a pattern for the whole line would need a stack as deep as the line is long.
    of_menu = ~line.rlike("[.!?;:]") & line.rlike("(?iu)" + MENU_WORDS)  # none of these marks is part of a menu; prose is told by them early
    only_menu = of_menu & (F.length(F.regexp_replace(line, f"(?iu){MENU_WORDS}|{MENU_SEPARATORS}", "")) == 0)
    navigation = ((separators >= 3) & (separators * 5 >= words)) | only_menu
    capitals, letters = (F.regexp_count(line, F.lit(x)) for x in (r"\p{Lu}", r"\p{L}"))  # a script without case is no shouting
    shouting = (F.length(line) >= 20) & line.rlike(r"\p{Lu}\p{Lu}") & ~line.rlike(r"\p{Ll}") & (capitals * 2 > letters)
    exclaiming = (marks >= 3) & (marks * 4 > words)
    stock = (F.length(line) < BOILERPLATE_CHARS) & line.rlike("(?iu)" + BOILERPLATE)
    return symbols | endless | navigation | shouting | exclaiming | stock


def _windows(words: Column) -> tuple[Column, Column]:
    """Windows of three words, and their hashes."""
    n = F.size(words)
    windows = F.slice(F.arrays_zip(words.alias("a"), F.slice(words, 2, n).alias("b"), F.slice(words, 3, n).alias("c")), 1, F.greatest(n - 2, F.lit(0)))
    return windows, F.transform(windows, lambda x: F.xxhash64(x["a"], x["b"], x["c"]))


def _repeated_words(words: Column, windows: Column, hashes: Column) -> Column:
    """Words in windows that occur twice or more: sort the windows with their places and look at neighbours."""
    n = F.size(words)
    placed = F.sort_array(F.arrays_zip(hashes.alias("h"), windows.alias("w"), F.sequence(F.lit(0), n - 3).alias("i")))
    following = F.arrays_zip(placed.alias("x"), F.slice(placed, 2, n).alias("y"))
    same = F.filter(following, lambda p: (p["x"]["h"] == p["y"]["h"]) & (p["x"]["w"] == p["y"]["w"]))
    starts = F.flatten(F.transform(same, lambda p: F.array(p["x"]["i"], p["y"]["i"])))
    covered = F.array_distinct(F.flatten(F.transform(F.array_distinct(starts), lambda i: F.array(i, i + 1, i + 2))))
    some = F.size(F.array_distinct(hashes)) < n - 2
    return F.when((n >= 4) & some, F.size(covered)).otherwise(0)


def line_quality(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """All columns of `docs` and a struct `quality`, one row per row.

    quality has n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_chars, line_chars, kept and
    clean_text (the lines that pass; blank lines stay). A null text is taken as having no words: it fails, and clean_text is null.
    An empty text fails and stays empty. Lines are cut at \\n; other columns are carried along untouched, whatever
    their names; a column named `quality` is replaced. Equal rows get equal results.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "quality"])
    read = docs.select(row.alias("row"), F.col(text_column).alias("text"))
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    every = F.split("text", "\n", -1)
    passing = F.filter(every, lambda x: ~line_fails(x) | ~x.rlike("[^\\x20\\x09-\\x0D]"))
    read = read.withColumn("_words", F.array_remove(F.split(text, BLANKS, -1), "")).withColumn("_lines", lines)
    windows, hashes = _windows(F.col("_words"))
    read = read.withColumns({"_windows": windows, "_hashes": hashes, "_passing": passing})
    repeated = _repeated_words(F.col("_words"), F.col("_windows"), F.col("_hashes"))
    read = read.withColumns({"_repeat": repeated, "_clean": F.array_join("_passing", "\n")})

    def long(x: Column) -> Column:
        return x.cast("long")

    n_words, repeat = long(F.size("_words")), long(F.col("_repeat"))
    total = long(F.length(text) - F.size(F.split(text, "\n", -1)) + 1)
    lost = F.coalesce(total - long(F.length("_clean") - F.greatest(F.size("_passing") - 1, F.lit(0))), F.lit(0).cast("long"))
    failed = (n_words < MIN_WORDS) | (repeat * 100 > n_words * REPEAT_PERCENT)
    quality = F.struct(
        n_words.alias("n_words"),
        long(F.length(F.array_join("_words", ""))).alias("word_chars"),
        long(count_chars(text, SYMBOLS)).alias("n_symbols"),
        long(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        repeat.alias("n_repeat_words"),
        failed.alias("base_failed"),
        lost.alias("lost_chars"),
        total.alias("line_chars"),
        (~failed & (lost * 100 <= total * LOST_PERCENT)).alias("kept"),
        F.col("_clean").alias("clean_text"),
    )
    return read.withColumn("quality", quality).select("row.*", "quality")
