"""Findings of the regex categories of a rule pack, as word ranges of pages.

Spark has no function for the offsets of all matches. A text is the matches with the pieces
between them, so that offsets are sums of lengths: regexp_extract_all gives the matches, split
the pieces. No Python runs, and no row is exploded that has no match. Packs of very many patterns
are the exception: there an index of what their matches must hold chooses the few to run.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import fresh
from ..sources.corpus import page_text
from ..sources.rulepacks import Category, RulePack

FINDING_COLUMNS = ("doc_id", "page", "word_start", "word_end", "kind", "confidence", "source", "seq")


def java_pattern(pattern: str) -> str:
    """The pattern with Unicode word boundaries and digits."""
    return f"(?U){pattern}"


def any_pattern(pack: RulePack) -> str:
    """One pattern that a text has a match of if any regex category has; nothing matches that of a pack without one."""
    return "(?U)" + ("|".join(f"(?:{c.pattern})" for c in pack.categories if c.detection == "regex" and c.pattern) or "(?!)")


def may_match(text: Column, pack: RulePack) -> Column:
    """False for most texts without a match, by one scan for the characters that matches need; null texts have none."""
    cats = [c for c in pack.categories if c.detection == "regex" and c.pattern]
    if not cats or any(c.needs is None for c in cats):
        return F.lit(True)
    return text.rlike("|".join(sorted({c.needs for c in cats})))


def match_ranges(text: Column, pattern: str) -> Column:
    """array<struct<word_start, word_end>> of the matches in a text of words with one space between; a space belongs to the word before it."""
    p = F.lit(java_pattern(pattern))
    found = F.regexp_extract_all(text, p, F.lit(0))
    between = F.split(text, java_pattern(pattern), -1)
    spaces = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))

    def add(acc: Column, x: Column) -> Column:
        # Spaces before the match, then those before its last character.
        start = acc["spaces"] + spaces(x["b"])
        end = start + spaces(F.substring(x["m"], F.lit(1), F.length(x["m"]) - 1))
        after = start + spaces(x["m"])
        span = F.struct(start.cast("int").alias("word_start"), end.cast("int").alias("word_end"))
        return F.struct(after.cast("int").alias("spaces"), F.array_append(acc["out"], span).alias("out"))

    zero = F.struct(F.lit(0).alias("spaces"), F.array().cast("array<struct<word_start:int,word_end:int>>").alias("out"))
    both = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("b"), found.alias("m"))
    return F.aggregate(both, zero, add, lambda acc: acc["out"])


#: Regex categories from which on an index chooses those that a text is searched for.
MANY = 32
#: Characters that a literal has at least to be looked for in the index.
LEAST_LITERAL = 3


def required_literal(pattern: str) -> str | None:
    """The longest text that every match of a pattern holds for certain, as far as can be seen: outside of groups, classes and alternatives."""
    if "(?i" in pattern.lower() or "(?x" in pattern.lower():
        return None
    best, run, i, n = "", "", 0, len(pattern)

    def skip(at: int, opened: str, closed: str) -> int:
        """The place after a group or class that begins there."""
        depth, at = 1, at + 1
        if opened == "[":
            at += pattern[at : at + 1] == "^"
            at += pattern[at : at + 1] == "]"
        while at < n and depth:
            c = pattern[at]
            if c == "\\":
                at += 1
            elif opened == "(" and c == "[":
                at = skip(at, "[", "]") - 1
            elif c == opened and opened == "(":
                depth += 1
            elif c == closed:
                depth -= 1
            at += 1
        return at

    while i < n:
        c, literal = pattern[i], None
        if c == "|":
            return None
        if c == "\\":
            e = pattern[i + 1 : i + 2]
            literal, i = (e if e and not e.isalnum() else None), i + 2
        elif c in "([":
            i = skip(i, c, ")" if c == "(" else "]")
        else:
            literal, i = (None if c in ".^$" else c), i + 1
        quantifier = re.match(r"[?*+]|\{[0-9,]*\}", pattern[i:])
        needed = quantifier is None or quantifier[0] == "+" or re.match(r"\{0*[1-9]", quantifier[0])
        run = run + literal if literal and needed else ""
        best = max(best, run, key=len)
        if quantifier or literal is None:
            run = ""
        if quantifier:
            i += len(quantifier[0])
            i += pattern[i : i + 1] in ("?", "+") and pattern[i : i + 1] != ""
    return best if len(best) >= LEAST_LITERAL else None


class PatternIndex:
    """The patterns of a pack by the literals that their matches hold: a text is scanned once for all literals, and only the patterns of those found, and those without one, are run."""

    def __init__(self, categories: list[tuple[int, Category]]):
        import ahocorasick

        self.patterns = [(order, c, re.compile(c.pattern)) for order, c in categories]
        by_literal: dict[str, list[int]] = {}
        self.always = []
        for k, (_, c, _) in enumerate(self.patterns):
            literal = required_literal(c.pattern)
            by_literal.setdefault(literal, []).append(k) if literal else self.always.append(k)
        self.literals = ahocorasick.Automaton()
        for literal, ks in by_literal.items():
            self.literals.add_word(literal, ks)
        if by_literal:
            self.literals.make_automaton()

    def chosen(self, text: str) -> list[int]:
        """The patterns that may match, in their order."""
        found = set(self.always)
        if len(self.literals):
            for _, ks in self.literals.iter(text):
                found.update(ks)
        return sorted(found)

    def found(self, text: str | None) -> list[dict]:
        """The matches of all patterns as ranges of words, by pattern and place; a space belongs to the word before it."""
        out: list[dict] = []
        for k in self.chosen(text) if text else ():
            order, c, pattern = self.patterns[k]
            spaces, at = 0, 0
            for nth, m in enumerate(pattern.finditer(text)):
                start = spaces + text.count(" ", at, m.start())
                out.append({"word_start": start, "word_end": start + text.count(" ", m.start(), m.end() - 1), "kind": c.id, "confidence": c.confidence, "ord": order, "nth": nth})
                spaces, at = start + text.count(" ", m.start(), m.end()), m.end()
        return out


def _indexed(text: Column, categories: list[tuple[int, Category]]) -> Column:
    """The same for a column of texts, in Arrow batches; no other column leaves the JVM."""

    def run(parts):
        index = PatternIndex(categories)
        for part in parts:
            yield part.map(index.found)

    return F.pandas_udf(run, FOUND, F.PandasUDFType.SCALAR_ITER)(text)


FOUND = "array<struct<word_start:int,word_end:int,kind:string,confidence:string,ord:int,nth:int>>"


def annotate(pages: DataFrame, pack: RulePack) -> DataFrame:
    """Pages with a column found: the findings of the regex categories, in the order of category and place.

    All of it happens inside the row of the page: nothing is exploded, joined or shuffled, and
    what needs the words of a finding (its text, its box, the redacted page) is another
    projection of the same row. With MANY categories or more, an index of literals chooses the
    patterns for each page. Patterns must not match the empty string.
    """
    cats = [(o, c) for o, c in enumerate(c for c in pack.categories if c.detection == "regex" and c.pattern)]
    if not cats:
        return pages.withColumn("found", F.array().cast(FOUND))
    if len(cats) >= MANY:
        return pages.withColumn("found", _indexed(page_text(F.col("words")), cats))

    def labelled(order: int, c: Category):
        return lambda s, i: F.struct(
            s["word_start"].alias("word_start"), s["word_end"].alias("word_end"), F.lit(c.id).alias("kind"), F.lit(c.confidence).alias("confidence"), F.lit(order).alias("ord"), i.alias("nth")
        )

    none = F.array().cast("array<struct<word_start:int,word_end:int>>")
    name = fresh("text", pages)
    text = F.col(name)
    one = lambda c: F.lit(True) if c.needs is None else text.rlike(c.needs)
    hits = [F.transform(F.when(one(c) & text.rlike(java_pattern(c.pattern)), match_ranges(text, c.pattern)).otherwise(none), labelled(o, c)) for o, c in cats]
    found = F.when(may_match(text, pack) & text.rlike(any_pattern(pack)), F.concat(*hits)).otherwise(F.array().cast(FOUND))
    return pages.withColumn(name, page_text(F.col("words"))).withColumn("found", found).drop(name)


def sequence(ord_: Column, page: Column, nth: Column) -> Column:
    """The order of a document's findings by category, page and place."""
    return ord_.cast("long") * F.lit(1 << 50) + page.cast("long") * F.lit(1 << 20) + nth


def regex_findings(pages: DataFrame, pack: RulePack, with_words: bool = False) -> DataFrame:
    """One finding for each match of each regex category on each page: FINDING_COLUMNS, and the page's words if asked for.

    seq orders the findings of a document by category, page and place.
    """
    keep = ["doc_id", "page", *["words"] * with_words]
    # Pages without a match go by one test of their text. The inline is an outer one, as Spark would
    # infer a filter from any other, push it down and search every page twice.
    text = page_text(F.col("words"))
    many = sum(c.detection == "regex" and bool(c.pattern) for c in pack.categories) >= MANY
    some = pages if many else pages.where(may_match(text, pack) & text.rlike(any_pattern(pack)))
    found = annotate(some, pack).select(*keep, F.inline_outer("found")).where("word_start IS NOT NULL")
    seq = sequence(F.col("ord"), F.col("page"), F.col("nth"))
    return found.select(*keep, "word_start", "word_end", "kind", "confidence", F.lit(f"rules:{pack.name}").alias("source"), seq.alias("seq"))


def model_categories(table: DataFrame) -> DataFrame:
    """The categories of a pack table that a model detects."""
    return table.where("detection = 'llm'")
