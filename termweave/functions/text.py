"""Text functions as Column expressions; nothing here runs Python on executors.

Regular expressions carry (?U) where Python's classes are Unicode-aware.  A
null text counts as an empty one.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.functions import profiles as P

READABLE = "[\\x{0400}-\\x{04FF}a-zA-Z0-9 \\t\\n\\r.,;:!?()\\-\"'/\\[\\]{}+=<>@#$%&*_~\\\\]"
TITLE_CHARS = "[\\x{0400}-\\x{04FF}a-zA-Z0-9 .,;:!?()\\-\"'/]"


def some(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row; in a higher-order function an expression is computed where it stands."""
    return F.element_at(F.transform(F.array(value), use), 1)


def matching_chars(text: Column, char_class: str) -> Column:
    """How many characters of text the class has.

    The others go in runs, as a match costs more than a character, and ASCII letters and digits are
    named one by one: the engine looks single characters up in a table, but tries range after range.
    """
    for span, single in (("a-z", string.ascii_lowercase), ("A-Z", string.ascii_uppercase), ("0-9", string.digits)):
        char_class = char_class.replace(span, single)
    inverse = char_class.replace("[", "[^", 1) + "+"
    return F.length(F.regexp_replace(some(text), inverse, ""))


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def readable_share(text: Column) -> Column:
    return share(matching_chars(text, READABLE), F.length(some(text)))


def is_readable(text: Column, threshold: float = 0.75, least: int = 100) -> Column:
    return (F.length(some(text)) >= least) & (readable_share(text) >= threshold)


def is_valid_title(title: Column) -> Column:
    t = some(title)
    return (F.length(t) >= 3) & t.rlike("[а-яёА-ЯЁ]{3,}|[a-zA-Z]{3,}") & (share(matching_chars(t, TITLE_CHARS), F.length(t)) >= 0.7)


def script_share(text: Column, script: str = "[\\x{0400}-\\x{04FF}]", other: str = "[a-zA-Z]") -> Column:
    mine, theirs = matching_chars(text, script), matching_chars(text, other)
    return bound(F.array(mine, theirs), lambda n: share(n[0], n[0] + n[1]))


def is_in_script(text: Column, threshold: float = 0.5, script: str = "[\\x{0400}-\\x{04FF}]", other: str = "[a-zA-Z]") -> Column:
    both = F.array(matching_chars(text, script), matching_chars(text, other))
    return bound(both, lambda n: (n[0] + n[1] > 0) & (share(n[0], n[0] + n[1]) >= threshold))


def join_hyphens(text: Column) -> Column:
    """Rejoins words broken by a hyphen at a line's end; some compounds keep theirs.

    The first three patterns mark the hyphens to keep, the last one joins the
    other words; the mark becomes a hyphen again.
    """
    gap, mark = "-\\s*\\n\\s*", "\u0001"
    ru, word = "[а-яёА-ЯЁ]", "[а-яёА-ЯЁa-zA-Z]"
    left = f"(?<!{word})"
    t = F.regexp_replace(some(text), f"(?U){left}({ru}{{3,}}[оеОЕ]){gap}({ru}{{5,}}(?!{word}))", f"$1{mark}$2")
    for before, after, prefixes in ((ru, f"{ru}+(?!{word})", P.RUSSIAN_HYPHEN_PREFIXES), (word, f"{word}+", P.ENGLISH_HYPHEN_PREFIXES)):
        t = F.regexp_replace(t, f"(?iuU){left}({'|'.join(prefixes)}){gap}({after})", f"$1{mark}$2")
    t = F.regexp_replace(t, f"(?U){left}({word}+){gap}({word}+)", "$1$2")
    broken = some(text).rlike(f"(?U){gap}")  # few texts are, and only they need the patterns
    return F.replace(F.when(broken, t).otherwise(some(text)), F.lit(mark), F.lit("-"))


def squeeze_spacing(text: Column) -> Column:
    """One space between words, paragraphs apart by an empty line, bullets removed."""
    t = F.regexp_replace(some(text), "(?U)\\n\\s*\\n", "\u0001")
    t = F.regexp_replace(t, "(?U)[\\s&&[^\u0001]]+", " ")
    t = F.regexp_replace(t, "[¶]", "")
    parts = F.transform(F.split(t, "\u0001"), strip)
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def words(text: Column, letters: str = "\\p{L}\\p{N}") -> Column:
    return F.regexp_extract_all(F.lower(some(text)), F.lit(f"([{letters}]+)"), F.lit(1))


def blank_separated(text: Column) -> Column:
    return F.filter(F.split(some(text), "(?U)\\s+"), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Cuts after . ! ? and space unless a lower-case letter or a digit follows; the mark goes."""
    parts = F.split(some(text), "(?U)[.!?]\\s++(?![\\p{Ll}\\p{Lo}\\p{N}])")
    return F.filter(F.transform(parts, lambda s: strip(F.regexp_replace(s, "(?U)\\s+", " "))), lambda s: s != "")


def numbered_sentences(parts: Column, letters: str = "\\p{L}\\p{N}", least: int = 8, most: int = 60) -> Column:
    """(idx, text) of the sentences of 8 to 60 words that don't open like a caption or heading."""
    numbered = F.transform(parts, lambda s, i: F.struct(i.alias("idx"), s.alias("text")))
    fits = lambda s: bound(F.size(words(s, letters)), lambda n: n.between(least, most))
    return F.filter(numbered, lambda x: fits(x["text"]) & ~F.lower(strip(x["text"])).rlike(f"(?U)^({P.SENTENCE_OPENERS})"))


def keyword_list(text: Column) -> Column:
    """The keywords of a comma- or semicolon-separated line, lower-cased, without noise."""
    line = F.regexp_replace(strip(F.replace(some(text), F.lit("\n"), F.lit(" "))), "\\.+$", "")
    parts = F.transform(F.split(line, "(?U)[,;]\\s*"), lambda k: F.regexp_replace(F.lower(strip(k)), "(?U)\\s+", " "))
    return F.filter(parts, lambda k: (k != "") & (F.length(k) <= 60) & (F.size(F.split(strip(k), " ")) <= 6) & ~noisy(k, P.KEYWORD_NOISE))


def noisy(text: Column, marks: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for m in marks:
        found = found | F.contains(text, F.lit(m))
    return found


def phrase_id(phrase: Column, keep_digits: bool = True, letters: str = "а-яёa-z") -> Column:
    """The words of a phrase in alphabetical order."""
    return F.array_join(F.array_sort(words(phrase, letters + ("0-9" if keep_digits else ""))), " ")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if one is empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / either).otherwise(F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / F.when(p + r > 0, p + r).otherwise(F.lit(1.0))).otherwise(F.lit(0.0))


def exact_metrics(found: Column, wanted: Column, k: int) -> Column:
    """Precision, recall and F1 of the first k; repeated hits all count, so recall may pass 1."""
    first = F.slice(found, 1, k)
    hits = F.size(F.filter(first, lambda x: F.array_contains(wanted, x))).cast("double")
    p, r = share(hits, F.size(first)), share(hits, F.size(F.array_distinct(wanted)))
    ok = (F.size(first) > 0) & (F.size(wanted) > 0)
    zero = F.lit(0.0)
    return F.struct(F.when(ok, p).otherwise(zero).alias("precision"), F.when(ok, r).otherwise(zero).alias("recall"), F.when(ok, f1(p, r)).otherwise(zero).alias("f1"))


def soft_metrics(found: Column, wanted: Column, k: int) -> Column:
    """The same with the best word-set similarity in place of equality."""
    first = F.slice(found, 1, k)

    def mean_best(xs: Column, ys: Column) -> Column:
        best = F.transform(xs, lambda x: F.array_max(F.transform(ys, lambda y: jaccard(x, y))))
        return share(F.aggregate(best, F.lit(0.0), lambda acc, v: acc + v), F.size(xs))

    ok = (F.size(first) > 0) & (F.size(wanted) > 0)
    split = lambda phrases: F.transform(phrases, blank_separated)  # noqa: E731  once, not for every pair
    both = lambda use: bound(split(first), lambda a: bound(split(wanted), lambda b: use(a, b)))
    p, r = both(mean_best), both(lambda a, b: mean_best(b, a))
    zero = F.lit(0.0)
    return F.struct(F.when(ok, p).otherwise(zero).alias("precision"), F.when(ok, r).otherwise(zero).alias("recall"), F.when(ok, f1(p, r)).otherwise(zero).alias("f1"))


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined n-grams of an array of words."""
    last = F.size(tokens) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(0)) + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def upper_first(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.greatest(F.length(text) - 1, F.lit(0))))


def stem_of(filename: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(filename, "(?<=.)\\.[^.]*$", ""), "_", " ")


def last_segment(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def tooltip(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(some(text))


def percent(score: Column, digits: int = 0) -> Column:
    return F.format_string(f"%.{digits}f%%", score * 100)


def first_and_more(items: Column, n: int = 5) -> Column:
    """The first n items, and how many more there are."""
    shown = F.array_join(F.slice(items, 1, n), ", ")
    return F.when(F.size(items) > n, F.concat(shown, F.lit(" (+"), (F.size(items) - n).cast("string"), F.lit(")"))).otherwise(shown)


def method_style(methods: Column, default: str = "#94a3b8") -> Column:
    style = F.lit(default)
    for name, colour in reversed(P.METHOD_STYLE):
        style = F.when(F.array_contains(methods, name), F.lit(colour)).otherwise(style)
    return style


def display_text(annotation: Column, summary: Column) -> Column:
    """The annotation, or if it is blank the summary."""
    return F.coalesce(F.when(strip(annotation) != "", annotation), F.when(strip(summary) != "", summary), F.lit(""))


def badges(author: Column, other: Column, n: int = 5) -> Column:
    return F.when(F.size(author) > 0, F.slice(author, 1, n)).otherwise(F.slice(other, 1, n))


def held(df: DataFrame, *keep: str, **columns: Column) -> DataFrame:
    """df with computed columns that later steps read rather than compute again.

    They come out of a one-row generator, which the optimizer neither merges with
    later projections nor pushes filters through; otherwise each use of a place
    would copy the search for it, and the plan would grow with every step.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
