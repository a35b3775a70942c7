"""Texts of calls as columns: shell text, one-line summaries, shortened outputs, test names and counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bodies of here-documents and programs given in place, and what stands for them (fixed values).
HEREDOC, HEREDOC_MARK = r"(?dms)<<-?\s*['\"]?(\w+)['\"]?[^\n]*\n.*?^\1$", "<<heredoc>"
INLINE, INLINE_MARK = r"(?s)(\s-c)\s+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')", "$1 <code>"
#: Characters of a summary; of an output's head and tail (fixed values).
SUMMARY, HEAD, TAIL = 160, 2000, 2000
#: Arguments that name what a call is about, the first that is there (fixed values).
SUBJECTS = ("file_path", "notebook_path", "pattern", "path", "url", "description")
#: Counts in the last line of a test run (fixed value).
COUNTS = r"(\d+) (passed|failed|errors?|skipped|xfailed|xpassed)\b"


def shell_text(command: Column) -> Column:
    """A command without what is not the shell's own text."""
    return F.regexp_replace(F.regexp_replace(command, HEREDOC, HEREDOC_MARK), INLINE, INLINE_MARK)


def one_line(text: Column, most: int = SUMMARY) -> Column:
    """Blanks as single ones, cut to `most` characters, the last an ellipsis."""
    line = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(line) <= most, line).otherwise(F.concat(F.left(line, F.lit(most - 1)), F.lit("…")))


def summary(tool: Column, args_json: Column) -> Column:
    """One line naming what a call did: its command, or the first argument of SUBJECTS, or all arguments."""
    named = F.coalesce(*[F.nullif(F.get_json_object(args_json, f"$.{s}"), F.lit("")) for s in SUBJECTS], F.nullif(args_json, F.lit("{}")), F.lit(""))
    return one_line(F.when(tool == "Bash", F.coalesce(F.get_json_object(args_json, "$.command"), F.lit(""))).otherwise(named))


def shortened(text: Column, head: int = HEAD, tail: int = TAIL) -> Column:
    """Struct (text, cut): a text over head + tail characters as its two ends, with a note of how many are left out."""
    over = F.length(text) - (head + tail)
    note = F.concat(F.lit("\n[... "), F.format_number(over, 0), F.lit(" characters cut ...]\n"))
    return F.struct(F.when(over > 0, F.concat(F.left(text, F.lit(head)), note, F.right(text, F.lit(tail)))).otherwise(text).alias("text"), (over > 0).alias("cut"))


def node_id(rest: Column) -> Column:
    """The test's name at the start of a summary line: up to the first " - " before which brackets balance, or all of it."""
    parts = F.split(rest, " - ", -1)
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), " - "))
    count = lambda x, c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
    whole = F.get(F.filter(heads, lambda x, i: (count(x, "[") == count(x, "]")) & (i < F.size(parts) - 1)), F.lit(0))
    return F.rtrim(F.coalesce(whole, rest))


def test_counts(output: Column) -> Column:
    """Map of outcome to count of the last line of an output that has any; `error` and `errors` are one."""
    lines = F.filter(F.split(F.coalesce(output, F.lit("")), "\n", -1), lambda x: x.rlike(COUNTS))
    last = F.coalesce(F.element_at(F.when(F.size(lines) > 0, lines), -1), F.lit(""))
    kinds = F.transform(F.regexp_extract_all(last, F.lit(COUNTS), F.lit(2)), lambda k: F.when(k == "errors", "error").otherwise(k))
    pairs = F.arrays_zip(kinds.alias("k"), F.transform(F.regexp_extract_all(last, F.lit(COUNTS), F.lit(1)), lambda n: n.cast("int")).alias("n"))
    first = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, F.lit(1), i), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(first)


def surely(lo: Column, hi: Column, n: int) -> Column:
    """'1' for a count in [lo, hi] that is at most n, '0' for one that is over it, '' where that is open."""
    return F.when(lo.isNull(), "").when(hi <= n, "1").when(lo > n, "0").otherwise("")
