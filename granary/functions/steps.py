"""Parts of prompts and answers by their markers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line starts that open a step, marks before an answer, words of system prompts, marks of a user's part.
STEP_MARKS = ("Step", "1.", "2.", "3.", "First", "Then", "Finally")
ANSWER_MARKS = ("Answer:", "Final answer:", "Answer is:", "Result:")
SYSTEM_WORDS = ("assistant", "helpful", "tool", "capable", "careful", "policy")
USER_MARKS = ("User:", "Human:", "Question:")

_EDGES = r"^[ \t\r\n\f\x0B]+|[ \t\r\n\f\x0B]+$"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, _EDGES, "")


def steps(text: Column) -> Column:
    """Steps of an answer: blank lines and lines that open a step cut it; lines of a step are joined by a blank. Without any, the text."""
    lines = F.array_join(F.transform(F.split(text, "\n", -1), _strip), "\n")
    marks = "|".join(re.escape(m) for m in STEP_MARKS)
    cut = F.regexp_replace(F.regexp_replace(lines, r"\n{2,}", "\x01"), rf"\n(?={marks})", "\x01")
    parts = F.filter(F.transform(F.split(cut, "\x01", -1), lambda s: _strip(F.replace(s, F.lit("\n"), F.lit(" ")))), lambda s: s != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(text))


def answer(text: Column) -> Column:
    """What follows the first kind of mark that a text has; without one, its last line."""
    out = None
    for mark in ANSWER_MARKS:
        at = F.instr(text, mark)
        said = _strip(F.substring(text, at + len(mark), F.length(text)))
        out = F.when(at > 0, said) if out is None else out.when(at > 0, said)
    return out.otherwise(_strip(F.element_at(F.split(text, "\n", -1), -1)))


def system_prompt(text: Column) -> Column:
    """The `System:` line among the first five, else a first line of more than 20 characters with a usual word, else what stands before
    the first line with a user's mark; null otherwise."""
    lines = F.split(text, "\n", -1)
    stripped = F.transform(F.slice(lines, 1, 5), _strip)
    marked = F.get(F.filter(stripped, lambda x: x.startswith("System:")), 0)
    first = _strip(F.get(lines, 0))
    low = F.lower(first)
    usual = F.when((F.length(first) > 20) & low.rlike("|".join(SYSTEM_WORDS)), first)
    before = F.when(text.rlike("|".join(USER_MARKS)), _strip(F.regexp_extract(text, rf"(?s)^(.*?)[^\n]*?(?:{'|'.join(USER_MARKS)})", 1)))
    return F.when(F.coalesce(text, F.lit("")) != "", F.coalesce(marked, usual, before))


def prompt_parts(text: Column) -> Column:
    """(system, user): the system prompt, and the text without its first occurrence."""
    s = F.coalesce(system_prompt(text), F.lit(""))
    at = F.position(s, text)
    rest = F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(s), F.length(text)))
    return F.struct(s.alias("system"), F.when(s != "", _strip(rest)).otherwise(text).alias("user"))


def label_placeholders(text: Column, names: dict[str, str], ids: dict[int, str]) -> Column:
    """Names and `<token_N>` placeholders replaced by their labels; unknown placeholders go, blanks become single."""
    for name, label in names.items():
        text = F.replace(text, F.lit(name), F.lit(label))
    for i, label in ids.items():
        text = F.replace(text, F.lit(f"<token_{i}>"), F.lit(label))
    return _strip(F.regexp_replace(F.regexp_replace(text, r"<token_[0-9]+>", ""), r"[ \t\r\n\f\x0B]+", " "))
