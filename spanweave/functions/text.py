"""Text cleaning and comparison as column functions."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType


def unquote(s: Column) -> Column:
    """Percent-decoding that leaves ``+`` and malformed escapes alone, each by itself."""
    sound = F.regexp_replace(F.replace(s, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(sound), s)


def entity_name(url: Column, base: str = "http://en.wikipedia.org/wiki/") -> Column:
    return unquote(F.replace(url, F.lit(base), F.lit("")))


def split_words(s: Column) -> Column:
    """Words between white space of any script, without empty ones."""
    return F.filter(F.split(s, r"(?U)\s+"), lambda t: t != "")


def soft_fix(s: Column) -> Column:
    """Apostrophes to blanks, single s words to a blank (from either side too), marks dropped, trimmed, lower-cased."""
    s = F.replace(s, F.lit("'"), F.lit(" "))
    for x in (" s ", " s", "s "):
        s = F.replace(s, F.lit(x), F.lit(" "))
    return F.lower(F.trim(F.translate(s, "!:,'\"?", "")))


#: Rules for the end of a phrase, the first that fits: pattern and replacement.
TO_SINGULAR = [(r"(ss)$", "$1"), (r"(n)ews$", "$1ews"), (r"([^aeiouy])ies$", "$1y"), (r"(x|ch|sh|ss)es$", "$1"), (r"([lr])ves$", "$1f"), (r"(o)es$", "$1"), (r"s$", "")]
TO_PLURAL = [(r"([^aeiouy])y$", "$1ies"), (r"(x|ch|sh|ss)$", "$1es"), (r"([lr])f$", "$1ves"), (r"s$", "s"), (r"$", "s")]


def by_rules(s: Column, rules: list[tuple[str, str]]) -> Column:
    out = s
    for pattern, new in reversed(rules):
        out = F.when(s.rlike(pattern), F.regexp_replace(s, pattern, new)).otherwise(out)
    return F.when(s == "", s).otherwise(out)


def singularize(s: Column) -> Column:
    return by_rules(s, TO_SINGULAR)


def pluralize(s: Column) -> Column:
    return by_rules(s, TO_PLURAL)


#: A small tagger: word lists and endings; every other word is a noun.
ADJECTIVES = ("blue", "cold", "hot", "large", "new", "old", "red", "small")
FUNCTION_WORDS = {"a": "DT", "the": "DT", "of": "IN", "in": "IN", "with": "IN", "to": "IN", "for": "IN", "by": "IN", "and": "CC", "or": "CC", "is": "VB", "was": "VB", "be": "VB"}
#: Nouns derived from adjectives and verbs, best first.
NOUNS = {"cold": "coldness", "hot": "heat", "new": "news", "red": "redness", "small": "smallness", "is": "being"}


def tag(word: Column) -> Column:
    out = F.when(word.isin(*ADJECTIVES), "JJ")
    for w, t in FUNCTION_WORDS.items():
        out = out.when(word == w, t)
    return out.when(word.rlike("(ed|ing)$"), "VB").when(word.rlike("[^s]s$"), "NNS").otherwise("NN")


def nounify(word: Column) -> Column:
    out = word
    for w, noun in NOUNS.items():
        out = F.when(word == w, noun).otherwise(out)
    return out


def noun_phrases(words: Column) -> Column:
    """Noun phrases of tagged words, each joined by a blank: adjectives and nouns that end in a noun, and two of them around a preposition.

    Words must hold neither blanks nor slashes.  The words are written with one letter for their tag, and a pattern finds the phrases.
    """
    kind = lambda w: F.when(tag(w) == "JJ", "J").when(tag(w).startswith("NN"), "N").when(tag(w) == "IN", "I").otherwise("O")
    line = F.array_join(F.transform(words, lambda w: F.concat(w, F.lit("/"), kind(w), F.lit(" "))), "")
    bar = "(?:[^ /]+/[JN] )*[^ /]+/N "
    found = F.regexp_extract_all(line, F.lit(f"{bar}(?:[^ /]+/I {bar})?"), F.lit(0))
    return F.transform(found, lambda p: F.trim(F.regexp_replace(p, "/[JNI] ", " ")))


def chunks(words: Column) -> Column:
    """Runs of words between prepositions and determiners, each joined by a blank."""
    cut = F.transform(words, lambda w: F.when(tag(w).isin("IN", "DT"), "\n").otherwise(w))
    return F.filter(F.transform(F.split(F.array_join(cut, " "), "\n"), lambda p: F.trim(p)), lambda p: p != "")


def hard_fix(s: Column) -> Column:
    """Soft-fixed words: nouns to singular, adjectives and verbs to their noun if there is one."""
    words = split_words(soft_fix(s))
    fix = lambda w: F.when(tag(w).startswith("NN"), singularize(w)).when(tag(w).isin("JJ", "VB"), nounify(w)).otherwise(w)
    return F.lower(F.trim(F.array_join(F.transform(words, fix), " ")))


def strip_punctuation(s: Column) -> Column:
    return F.regexp_replace(s, r"\p{Punct}", "")


@arrow_udf(StringType())
def _decomposed(s: pa.Array) -> pa.Array:
    return pc.utf8_normalize(s, "NFKD")


def remove_accents(s: Column) -> Column:
    """Plain ASCII: compatibility decomposition, then what is beyond ASCII dropped; ASCII texts stay in the JVM."""
    wide = s.rlike(r"[^\x00-\x7F]")
    return F.when(wide, F.regexp_replace(_decomposed(F.when(wide, s)), r"[^\x00-\x7F]", "")).otherwise(s)


def acceptable(word: Column, stop: tuple[str, ...] = tuple(FUNCTION_WORDS)) -> Column:
    return F.length(word).between(2, 40) & ~F.lower(word).isin(*stop)


def match_score(sub: Column, words: Column) -> Column:
    """First word of ``words`` that equals (length + 1), starts with (length) or, for 3 letters or more, contains (length - 2) ``sub``; else -1."""
    n = F.length(sub)
    each = F.transform(words, lambda w: F.when(w == sub, n + 1).when(F.startswith(w, sub), n).when((n >= 3) & (F.instr(w, sub) > 0), n - 2))
    return F.coalesce(F.try_element_at(F.filter(each, lambda x: x.isNotNull()), F.lit(1)), F.lit(-1))


def longest_common(a: Column, b: Column) -> Column:
    """Longest common run of characters, the leftmost in ``a`` of equals; for words, not long texts."""
    n = F.length(a)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.transform(F.sequence(F.lit(1), F.greatest(n - i + 1, F.lit(1))), lambda k: F.substr(a, i, k))))
    return F.aggregate(runs, F.lit(""), lambda best, r: F.when((F.length(r) > F.length(best)) & (F.instr(b, r) > 0), r).otherwise(best))


def share_run(a: Column, b: Column, length: int = 4) -> Column:
    """Whether ``length`` characters in a row of ``a`` stand in ``b``."""
    starts = F.when(F.length(a) >= length, F.sequence(F.lit(1), F.length(a) - (length - 1))).otherwise(F.array().cast("array<int>"))
    return F.exists(starts, lambda i: F.instr(b, F.substr(a, i, F.lit(length))) > 0)


def insert_check(a: Column, b: Column) -> Column:
    """Mismatches when ``a`` is read along ``b`` and skipped letters count one each; 1000 if ``a`` is longer."""
    state = "struct<i:int,miss:int>"
    chars = F.split(b, "")
    hit = lambda s, c: F.substr(a, s["i"] + 1, F.lit(1)) == c
    step = lambda s, c: F.struct(F.when(hit(s, c), s["i"] + 1).otherwise(s["i"]).alias("i"), F.when(hit(s, c), s["miss"]).otherwise(s["miss"] + 1).alias("miss")).cast(state)
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("miss")).cast(state)
    return F.when(F.length(a) > F.length(b), 1000).otherwise(F.aggregate(chars, start, step, lambda s: s["miss"] + F.length(a) - s["i"]))


def token_at(text: Column, start: Column, compat: bool = False) -> Column:
    """Token that holds a character offset; ``compat``: the last token, for any offset."""
    if compat:
        return F.size(split_words(text)) - 1
    return F.size(split_words(F.substr(text, F.lit(1), start + 1))) - 1


def subsets(words: Column) -> Column:
    """All non-empty choices of words, in order, joined by blanks."""
    n = F.size(words)
    masks = F.sequence(F.lit(1), F.pow(F.lit(2), n).cast("int") - 1)
    pick = lambda m: F.array_join(F.filter(words, lambda w, i: F.floor(m / F.pow(F.lit(2), i)) % 2 == 1), " ")
    return F.when(n > 0, F.transform(masks, pick)).otherwise(F.array().cast("array<string>"))


def segmentations(words: Column) -> Column:
    """All 2^(n-1) ways to cut the words into runs; runs are joined by ``|``."""
    n = F.size(words)
    glue = lambda m: F.array_join(F.transform(words, lambda w, i: F.when(i == 0, w).otherwise(F.concat(F.when(F.floor(m / F.pow(F.lit(2), i - 1)) % 2 == 1, "|").otherwise(" "), w))), "")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.pow(F.lit(2), F.greatest(n - 1, F.lit(0))).cast("int") - 1), glue)).otherwise(F.array().cast("array<string>"))
