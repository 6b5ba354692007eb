"""Text functions as Column expressions; no Python runs on the executors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, with the four ASCII separators.
_SPACE = r"[\s\x1c-\x1f]"
#: What ends a line, besides \n: \r, \r\n, \v, \f, the ASCII separators, NEL and the Unicode ones.
_LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
_RARE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
NEWLINE = "\n"


def filled(c: Column, other: Column | str = "") -> Column:
    """``c``, or the other if it is null or empty: an empty string counts as missing."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(other) if isinstance(other, str) else other)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{_SPACE}+|{_SPACE}+\z", "")


def title(c: Column) -> Column:
    """Upper case after every character that isn't a letter, lower case after a letter."""
    # beside each character the one before it: nothing outside the element is looked at, so time is linear
    before = F.concat(F.array(F.lit("")), F.split(c, ""))
    return F.array_join(F.zip_with(F.split(c, ""), before, lambda x, b: F.when(b.rlike(r"\p{L}"), F.lower(x)).otherwise(F.upper(x))), "")


def spaced_title(c: Column) -> Column:
    """Title case of a name with hyphens for spaces."""
    return title(F.replace(c, F.lit("-"), F.lit(" ")))


def lines(c: Column) -> Column:
    return F.split(c, NEWLINE)


def head_lines(c: Column, n: int, marker: str = "") -> Column:
    """The first n lines, and the marker if there are more."""
    all_lines = lines(c)
    return F.when(F.size(all_lines) > n, F.concat(F.array_join(F.slice(all_lines, 1, n), NEWLINE), F.lit(marker))).otherwise(c)


def extract_body(c: Column) -> Column:
    """A document without its front matter and first heading.

    Front matter begins if the first line is ``---`` once stripped, and ends with the next
    such line; if there is none, only the first line goes. What is left is stripped, a first
    line that begins with ``#`` goes, and the rest is stripped again. Null gives ''.
    """
    c = F.coalesce(c, F.lit(""))
    all_lines = lines(c)
    rest = F.slice(all_lines, 2, F.size(all_lines))
    close = F.array_position(F.transform(rest, strip), "---").cast("int")
    after = F.slice(rest, close + 1, F.size(all_lines))
    content = strip(F.when(strip(F.get(all_lines, F.lit(0))) == "---", F.array_join(after, NEWLINE)).otherwise(c))
    newline = F.locate(NEWLINE, content)
    below = F.when(newline > 0, F.substring(content, newline + 1, F.length(content))).otherwise("")
    return F.when(content.startswith("#"), strip(below)).otherwise(content)


def line_count(c: Column) -> Column:
    """Lines as ``splitlines`` counts them: every kind of line end, none for a trailing one."""
    # without line ends but \n, which contains() tells far faster than a pattern, they are the bytes that go without it
    plain = ~reduce(Column.__or__, [F.contains(c, F.lit(end)) for end in _RARE_ENDS])
    ends = F.octet_length(c) - F.octet_length(F.replace(c, F.lit(NEWLINE), F.lit("")))
    n = F.when(plain, ends + 1).otherwise(F.size(F.split(c, _LINE_END)))
    trailing = F.when(plain, F.endswith(c, F.lit(NEWLINE))).otherwise(c.rlike(f"(?:{_LINE_END})\\z")).cast("int")
    return F.when(c == "", 0).otherwise(n - trailing)


def comma_split(c: Column) -> Column:
    return F.transform(F.split(c, ","), strip)


def before_glob(c: Column) -> Column:
    return F.substring_index(c, "/*", 1)


def joined_or(c: Column, other: str) -> Column:
    return F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0, F.array_join(c, ", ")).otherwise(other)


def yes_no(c: Column) -> Column:
    return F.when(c, "Yes").otherwise("No")


def true_false(c: Column) -> Column:
    return F.lower(c.cast("string"))


def parse_flag(c: Column, words: tuple[str, ...] = ("y", "yes", "true", "1")) -> Column:
    return F.lower(strip(c)).isin(*words)


def parse_int(c: Column) -> Column:
    """The integer, or null; single underscores between digits are allowed."""
    s = strip(c)
    return F.when(s.rlike(r"^[+-]?\d+(_\d+)*$"), F.replace(s, F.lit("_"), F.lit("")).try_cast("int"))


def mask(c: Column) -> Column:
    """All but the last four characters hidden; short and missing keys wholly."""
    return F.when(F.length(F.coalesce(c, F.lit(""))) < 8, "****").otherwise(F.concat(F.repeat(F.lit("*"), 10), F.right(c, F.lit(4))))


def relative(path: Column, root: Column, other: Column) -> Column:
    """The path below the root with forward slashes, or the other if it isn't below it."""
    p, r = F.replace(path, F.lit("\\"), F.lit("/")), F.rtrim(F.replace(root, F.lit("\\"), F.lit("/")), F.lit("/"))
    return F.when(F.startswith(p, F.concat(r, F.lit("/"))), F.substring(p, F.length(r) + 2, F.length(p))).otherwise(other)


def keyword_hits(c: Column, keywords: list[str]) -> Column:
    """Keywords that occur anywhere in the text, case aside, in the list's order; null has none."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(low, k))


#: A line that opens a list of globs, and one that begins with a hyphen; neither reaches beyond its line.
_OPENS, _BULLET = r"[^\n]*globs:", r"(?U)[\s\x1c-\x1f&&[^\n]]*-"


def rewrite_glob(c: Column, pattern: Column) -> Column:
    """After a line that holds ``globs:``, the next line that begins with a hyphen becomes the pattern's.

    The flag outlives the list: a later bullet or the closing delimiter is overwritten if
    no list entry comes first. The text is cut before every line of the two kinds; a bullet
    is overwritten if the piece before its own begins with an opening line. Each piece is
    looked at with its neighbour only, so time is linear in the text.
    """
    entry = F.concat(F.lit('  - "'), pattern, F.lit('"'))
    cut = F.split(c, rf"(?dm)^(?={_OPENS}|{_BULLET})")
    before = F.concat(F.array(F.lit("")), cut)

    def opens(piece: Column) -> Column:
        return F.contains(F.substring_index(piece, NEWLINE, 1), F.lit("globs:"))

    def rewritten(piece: Column, previous: Column) -> Column:
        first = F.substring_index(piece, NEWLINE, 1)
        hit = opens(previous) & ~opens(piece) & F.startswith(strip(first), F.lit("-"))
        return F.when(hit, F.concat(entry, F.substring(piece, F.length(first) + 1, F.length(piece)))).otherwise(piece)

    # one piece more before than there are: the last has none after it
    return F.array_join(F.zip_with(cut, before, lambda x, b: F.when(x.isNotNull(), rewritten(x, b))), "")


def rewrite_lines(c: Column, token: str, line: str) -> Column:
    """Every line that holds the token becomes the given one."""
    return F.array_join(F.transform(lines(c), lambda x: F.when(F.contains(x, F.lit(token)), line).otherwise(x)), NEWLINE)
