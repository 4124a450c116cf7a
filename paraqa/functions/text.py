"""Text expressions. Every function takes and gives Columns; null in, null out unless it says otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a placeholder, a number, an English word, a CJK character, and prompt markers.
# Spaces and digits are those of Unicode, named so that Java and RE2 read them alike (their own \s and \d are ASCII).
SPACES = r"\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACE, DIGIT = f"[{SPACES}]+", r"\p{Nd}"
PLACEHOLDER = r"\{\s*v\s*\d+\s*\}|<\s*style\s+id\s*=\s*'\s*\d+\s*'\s*>|<\s*/\s*style\s*>|<\s*/?\s*b\d+\s*>".replace(r"\s", f"[{SPACES}]").replace(r"\d", DIGIT)
NUMBER = rf"{DIGIT}+(?:[.,]{DIGIT}+)*"
ENGLISH_WORD = r"[A-Za-z][A-Za-z'’-]+"
CJK = r"[\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}]"
BATCH_MARKER = "## Here is the input:"
SINGLE_MARKER = "Now translate the following text:"
GLOSSARY_HEADER = "Source Term"

#: SPACES as Java tests them fastest: Latin ones as a table, and a range around the others. RE2 can't read it.
JAVA_SPACES = r"\x09\x0A\x0B\x0C\x0D\x1C\x1D\x1E\x1F\x20\x85\xA0[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]"
#: The characters of SPACES.
WHITE = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once a row. A column that is used in several places, or inside a lambda, is
    computed in each of them, and for each element there; a lambda's variable is not."""
    return F.transform(F.array(value), body)[0]


def every(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def strip(text: Column) -> Column:
    """Looks at the ends only; a pattern would try every place."""
    return F.trim(text, F.lit(WHITE))


def without_space(text: Column) -> Column:
    """Blanks go first, by bytes; the pattern then meets the rare other spaces."""
    return F.regexp_replace(F.replace(text, F.lit(" "), F.lit("")), f"[{JAVA_SPACES}]+", "")


def collapse(text: Column) -> Column:
    """A text that has only single blanks stays as it is."""
    other = F.contains(text, F.lit("  ")) | F.rlike(F.replace(text, F.lit(" "), F.lit("")), F.lit(f"[{JAVA_SPACES}]"))
    return F.when(other, F.regexp_replace(text, f"[{JAVA_SPACES}]+", " ")).otherwise(text)


def _marked(text: Column) -> Column:
    """Whether there can be a placeholder; a search for characters, so most texts never meet the pattern."""
    return F.contains(text, F.lit("{")) | F.contains(text, F.lit("<"))


def placeholders(text: Column) -> Column:
    """All placeholders, duplicates kept, without inner space."""
    found = F.transform(every(text, PLACEHOLDER), lambda p: F.regexp_replace(p, SPACE, ""))
    return F.when(~_marked(text), F.array().cast("array<string>")).otherwise(found)


def plain(text: Column) -> Column:
    """Placeholders become one space each."""
    return F.when(_marked(text), F.regexp_replace(text, PLACEHOLDER, " ")).otherwise(text)


def numbers(text: Column) -> Column:
    """Numbers outside placeholders; a comma before exactly three digits is a separator and goes."""
    return numbers_in(plain(text))


def numbers_in(bare: Column) -> Column:
    """Of a text without placeholders."""
    return F.transform(every(bare, NUMBER), lambda n: F.when(F.contains(n, F.lit(",")), F.regexp_replace(n, rf",(?={DIGIT}{{3}}(?!{DIGIT}))", "")).otherwise(n))


def english_runs(text: Column, least: int = 4) -> Column:
    """Runs of at least so many English words. Possessive: the words are joined by what can't be in a word, so giving back
    never helps, and long runs need no stack."""
    return english_runs_in(plain(text), least)


def english_runs_in(bare: Column, least: int = 4) -> Column:
    """Of a text without placeholders."""
    word = r"[A-Za-z][A-Za-z'’-]*+"
    return F.transform(every(bare, rf"{word}(?:[{JAVA_SPACES},;:]++{word}){{{least - 1},}}+"), strip)


def count_cjk(text: Column) -> Column:
    """CJK characters; runs of them are taken out at once instead of listing each. A text of ASCII has none."""
    return F.when(F.octet_length(text) == F.length(text), 0).otherwise(F.length(text) - F.length(F.regexp_replace(text, CJK + "+", "")))


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def has_words(text: Column, least: int) -> Column:
    """Whether there are so many English words. Most texts show it at their start; a word cut there counts no more than whole."""
    return (count_matches(F.substring(text, 1, 12 * least), ENGLISH_WORD) >= least) | (count_matches(text, ENGLISH_WORD) >= least)


def has_run(text: Column, least: int) -> Column:
    """Whether english_runs() finds any; the search ends at the first."""
    word = r"[A-Za-z][A-Za-z'’-]*+"
    return F.rlike(plain(text), F.lit(rf"{word}(?:[{JAVA_SPACES},;:]++{word}){{{least - 1}}}"))


def squash(text: Column) -> Column:
    """Without placeholders, tags and white space: what texts are compared by."""
    tagless = F.regexp_replace(F.regexp_replace(text, PLACEHOLDER, ""), r"<[^>]+>", "")
    return without_space(F.when(_marked(text), tagless).otherwise(text))


def squashed_start(text: Column, most: int) -> Column:
    """The first characters of squash(text). A text that shows them at its start, before any mark, is read no further."""
    start = F.substring(text, 1, 4 * most)
    tight = F.substring(without_space(start), 1, most)
    return F.when(~_marked(start) & (F.length(tight) == most), tight).otherwise(F.substring(squash(text), 1, most))


def key(text: Column) -> Column:
    """Key of notes and corrections."""
    return F.sha2(strip(text), 256)


def surplus(a: Column, b: Column) -> Column:
    """Tokens that a has more often than b, each once, sorted. array_except would forget how often.

    One pass over the sorted tokens of both, b's first: a token is in surplus when its balance gets to one.
    """
    signed = lambda c, sign: F.transform(c, lambda x: F.struct(x.alias("t"), F.lit(sign).alias("n")))
    start = F.struct(F.lit(None).cast("string").alias("t"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("found"))

    def step(s: Column, x: Column) -> Column:
        balance = F.when(s.t.eqNullSafe(x.t), s.n).otherwise(F.lit(0)) + x.n
        return F.struct(x.t.alias("t"), balance.alias("n"), F.when(balance == 1, F.concat(s.found, F.array(x.t))).otherwise(s.found).alias("found"))

    return F.aggregate(F.sort_array(F.concat(signed(a, 1), signed(b, -1))), start, step, lambda s: s.found)


def pseudo_translation(text: Column) -> Column:
    """A stand-in for a translator: each English word becomes two fixed characters, so results can be foretold."""
    return F.regexp_replace(text, "[A-Za-z][A-Za-z'’-]*", "译文")


def progress_text(text: Column) -> Column:
    """A progress line without its counter and its remaining time."""
    return F.regexp_replace(F.regexp_replace(text, r"（\d+/\d+）", ""), r"，?\s*预计.*$", "")


def eta_minutes(pace: Column, remaining: Column, batch: Column, percent: Column) -> Column:
    return F.greatest(F.lit(0.0), pace * (remaining - batch * percent / 100)) / 60


def overall_progress(done: Column, percent: Column, total: Column) -> Column:
    return (done + percent / 100) / total * 100
