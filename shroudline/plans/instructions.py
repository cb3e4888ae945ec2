"""Instructions taken apart into rules, by their form or, where they are long, by a model."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_instruction

#: Characters that an instruction without parts has at least before a model is asked. Fixed value.
LONG = 300

Splitter = Callable[[str], list[str] | None]


def decompose(instructions: DataFrame, splitter: Splitter | None = None, threshold: int = LONG) -> DataFrame:
    """instructions (ord, text) with rules array<string>, source and detail.

    source is parser where the form gives two rules or more, llm_fallback where the splitter was
    asked (its answer counts if it has two rules or more), original otherwise.
    """
    parsed = instructions.withColumn("rules", split_instruction(F.col("text")))
    form = F.size("rules") >= 2
    ask = ~form & (F.length(F.trim("text")) > threshold) & F.lit(splitter is not None)
    done = parsed.where(~ask).select(*instructions.columns, F.when(form, F.col("rules")).otherwise(F.array("text")).alias("rules"), F.when(form, "parser").otherwise("original").alias("source"), F.when(form, F.concat(F.size("rules").cast("string"), F.lit(" rules by form"))).otherwise("one rule").alias("detail"))
    if splitter is None:
        return done

    def run(parts):
        for part in parts:
            answers = [splitter(t) for t in part["text"]]
            good = [a is not None and len(a) >= 2 for a in answers]
            yield part.assign(
                rules=pd.Series([list(a) if g else [t] for a, g, t in zip(answers, good, part["text"])], index=part.index, dtype=object), source="llm_fallback",
                detail=pd.Series([f"{len(a)} rules by the model" if g else "the model gave no use" for a, g in zip(answers, good)], index=part.index, dtype=object),
            )

    return done.unionByName(parsed.where(ask).select(*instructions.columns).mapInPandas(run, done.schema))
