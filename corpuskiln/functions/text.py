"""Text functions on columns: all of them stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ends a line, as str.splitlines() has it.
LINE_END = "[\\n\\r\\x0B\\f\\x1C\\x1D\\x1E\\x85\\u2028-\\u2029](?:(?<=\\r)\\n)?"
_RARE_ENDS = "\r\x0b\f\x1c\x1d\x1e\x85\u2028\u2029"
#: White space as str.strip() has it.
SPACE = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters that mean something in a regular expression.
_META = ".$|()[{^?*+\\"


def no_lines() -> Column:
    return F.array().cast("array<string>")


def split_lines(text: Column) -> Column:
    """Lines without their ends; a final line end adds no empty line; the empty text has no lines."""
    other = reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in _RARE_ENDS])  # far cheaper than a regular expression
    body = F.when(F.endswith(text, F.lit("\n")), F.left(text, F.length(text) - 1)).otherwise(text)
    rest = F.split(F.regexp_replace(text, f"{LINE_END}\\z", ""), LINE_END, -1)
    return F.when(text == "", no_lines()).when(other, rest).otherwise(F.split(body, "\n", -1))


def strip(x: Column) -> Column:
    """Without white space (Unicode) at either end."""
    return F.btrim(x, F.lit(SPACE))


def simple_tokenize(text: Column, splitter: str = " ") -> Column:
    """Lines as sentences; tokens between occurrences of splitter, empty ones dropped; empty lines stay."""
    plain = len(splitter) == 1 and splitter not in _META  # needs no regular expression
    quoted = splitter if plain else "\\Q" + splitter.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.transform(split_lines(text), lambda line: F.array_remove(F.split(strip(line), quoted, -1), ""))


def char_tokenize(text: Column) -> Column:
    """Lines as lists of characters (code points)."""
    return F.transform(split_lines(text), lambda line: F.when(line == "", no_lines()).otherwise(F.filter(F.split(line, ""), lambda c: c != "")))


def text_normalize(text: Column, *, case: str | None = None, strip_lines: bool = False, drop_blank: bool = False) -> Column:
    """Per line: case ('upper' or 'lower'), strip; then blank lines dropped; joined by newlines."""
    lines = split_lines(_cased(text, case))
    if strip_lines:
        lines = F.transform(lines, strip)
    if drop_blank:
        lines = F.filter(lines, lambda x: x != "")
    return F.array_join(lines, "\n")


def _cased(x: Column, case: str | None) -> Column:
    if case not in (None, "", "lower", "upper"):
        raise ValueError(f"case must be lower or upper, not {case}")
    return F.lower(x) if case == "lower" else F.upper(x) if case == "upper" else x


def token_normalize(
    sentences: Column, *, case: str | None = None, remove_empty: bool = False, remove_only_punct: bool = False, remove_punct: bool = False, remove_nums: bool = False, min_word_length: int | None = None, strict_compat: bool = False
) -> Column:
    """Normalises tokens in this order: case, punctuation out of tokens, sentences of punctuation only, digits out
    of tokens, short tokens, empty tokens (always), empty sentences.

    By default as documented: tokens shorter than min_word_length go; sentences of only punctuation go. With
    strict_compat tokens of exactly that length go too, and it is the sentences of only plain words that go.
    """

    def tokens(words: Column) -> Column:
        words = F.transform(words, lambda w: _cased(w, case)) if case else words
        return F.transform(words, lambda w: strip(F.regexp_replace(w, "(?U)[\\W_]", ""))) if remove_punct else words

    def rest(words: Column) -> Column:
        words = F.transform(words, lambda w: F.regexp_replace(w, "[0-9]", "")) if remove_nums else words
        if min_word_length is not None:
            words = F.filter(words, lambda w: F.length(w) > min_word_length if strict_compat else F.length(w) >= min_word_length)
        return F.filter(words, lambda w: w != "")

    out = F.transform(sentences, tokens)
    if remove_only_punct:
        odd = "(?U)^[^\\W_]*$" if strict_compat else "(?U)^[\\W_]*$"
        out = F.filter(out, lambda s: F.exists(s, lambda w: ~w.rlike(odd)))
    out = F.transform(out, rest)
    return F.filter(out, lambda s: F.size(s) > 0) if remove_empty else out


def join_sentences(sentences: Column, between: str = " ") -> Column:
    """Sentences as lines of tokens: the raw form of a tokenised document."""
    return F.array_join(F.transform(sentences, lambda s: F.array_join(s, between)), "\n")


def europarl_lines(text: Column) -> Column:
    """Cleaned lines of a proceedings text: markup lines go; a speaker's name up to the first '. - ' goes; dashes and
    spaces at the start go; lines in brackets go; language marks such as (DE) go; empty lines go."""

    def clean(line: Column) -> Column:
        at = F.locate(". - ", line)
        line = F.when(at > 0, F.substring(line, at + 4, F.length(line))).otherwise(line)
        return strip(F.regexp_replace(F.regexp_replace(line, "^[- ]+", ""), "\\([A-Z][A-Z]\\) ", ""))

    lines = F.transform(F.filter(split_lines(text), lambda x: ~x.startswith("<")), clean)
    return F.filter(lines, lambda x: (x != "") & ~(x.startswith("(") & x.endswith(")")))


#: What a formatter shows of each document type.
def format_document(kind: str, value: Column) -> Column:
    """A document as text to look at."""
    if kind in ("tokenized", "lemmatized", "char_tokenized"):
        return join_sentences(value)
    if kind == "segmented_lines":
        return join_sentences(value, "/")
    if kind == "vector":
        return F.array_join(F.transform(value, lambda x, i: F.format_string("%d: %.3f", i, x)), "\n")
    if kind == "float_lists":
        return F.array_join(F.transform(value, lambda s: F.array_join(F.transform(s, lambda x: F.format_string("%.4f", x)), " ")), "\n")
    if kind == "integer_lists":
        return F.array_join(F.transform(value, lambda s: F.array_join(F.transform(s, lambda x: x.cast("string")), " ")), "\n")
    return value.cast("string")


def truncate(x: Column, length: int, end: str = "...") -> Column:
    """The string, cut to length with end in place of the rest."""
    return F.when(F.length(x) > length, F.concat(F.substring(x, 1, max(0, length - len(end))), F.lit(end))).otherwise(x)


def strip_punctuation(x: Column, split_words: bool = True) -> Column:
    """Without punctuation; split_words puts a space in its place."""
    out = F.regexp_replace(x, "(?U)[^\\w\\s]|_", " " if split_words else "")
    return strip(F.regexp_replace(out, "(?U)\\s+", " ")) if split_words else out


def coarse_pos(tag: Column) -> Column:
    """A Penn Treebank tag as noun (n), verb (v), adjective (j), adverb (r) or other (o), by its first letter."""
    first = F.lower(F.substring(tag, 1, 1))
    return F.when(first.isin("n", "v", "j", "r"), first).otherwise(F.lit("o"))


def nist_tokenize(text: Column, lowercase: bool = False) -> Column:
    """International NIST tokenisation of each line: space around punctuation that digits don't enclose, around
    symbols, and around dashes after digits."""

    def line(x: Column) -> Column:
        x = F.lower(x) if lowercase else x
        for pattern, into in (
            ("([\\{-\\~\\[-\\` -\\&\\(-\\+\\:-\\@\\/])", " $1 "),
            ("([^0-9])([\\.,])", "$1 $2 "),
            ("([\\.,])([^0-9])", " $1 $2"),
            ("([0-9])(-)", "$1 $2 "),
        ):
            x = F.regexp_replace(x, pattern, into)
        return F.filter(F.split(strip(x), "(?U)\\s+"), lambda w: w != "")

    return F.transform(split_lines(text), line)


def relevance(p_word_topic: Column, p_word: Column, weight: float = 0.6) -> Column:
    """Relevance of a word to a topic: weight * log p(w|t) + (1 - weight) * log(p(w|t) / p(w))."""
    return weight * F.log(p_word_topic) + (1 - weight) * F.log(p_word_topic / p_word)
