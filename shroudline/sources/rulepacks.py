"""Rule packs: categories of sensitive data that a pattern or a model detects."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

ALIASES = {"pii": "pii-en"}


@dataclass(frozen=True)
class Category:
    """A kind of sensitive data. needs is a character class that every match has a character of, if there is
    one: texts without such a character are then passed over by a scan that costs far less than the pattern."""

    id: str
    label: str
    detection: str
    confidence: str
    pattern: str | None = None
    model: str | None = None
    needs: str | None = None

    def __post_init__(self):
        if self.detection not in ("regex", "llm"):
            raise ValueError(f"category {self.id}: detection is regex or llm")
        if self.confidence not in ("high", "medium", "low"):
            raise ValueError(f"category {self.id}: confidence is high, medium or low")


@dataclass(frozen=True)
class RulePack:
    name: str
    display_name: str
    description: str
    version: int
    categories: tuple[Category, ...] = field(default_factory=tuple)


# The identifiers, confidences and patterns of the English pack.
PII_EN = RulePack(
    "pii-en",
    "PII (English)",
    "Personal identifiers in English texts",
    1,
    (
        Category("email", "email address", "regex", "high", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", needs="[@]"),
        Category("ssn_us", "US SSN", "regex", "high", r"\b\d{3}-\d{2}-\d{4}\b", needs=r"[\p{Nd}]"),
        Category("phone_us", "US phone number", "regex", "medium", r"\b(?:\+1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", needs=r"[\p{Nd}]"),
        Category("iban", "IBAN", "regex", "high", r"\b[A-Z]{2}\d{2}(?:\s?[A-Z0-9]{4}){2,7}\b", needs=r"[\p{Nd}]"),
        Category("person_name", "person name", "llm", "medium"),
        Category("street_address", "street address", "llm", "medium"),
    ),
)

PACKS = {PII_EN.name: PII_EN}


def load(name: str) -> RulePack:
    """A built-in pack by its name or alias; KeyError for an unknown one."""
    return PACKS[ALIASES.get(name, name)]


def from_json(text: str) -> RulePack:
    """A pack from JSON with the fields of RulePack; a missing field raises KeyError."""
    raw = json.loads(text)
    cats = tuple(Category(c["id"], c["label"], c["detection"], c["confidence"], c.get("pattern"), c.get("model")) for c in raw["categories"])
    return RulePack(raw["name"], raw["display_name"], raw["description"], int(raw["version"]), cats)


def as_table(spark: SparkSession, pack: RulePack) -> DataFrame:
    """The pack as a dimension table; as small as the pack."""
    rows = [{"rule_set": pack.name, "ord": i, **{k: v for k, v in asdict(c).items() if k != "needs"}} for i, c in enumerate(pack.categories)]
    return spark.createDataFrame(rows, "rule_set string, ord int, id string, label string, detection string, confidence string, pattern string, model string")
