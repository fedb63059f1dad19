"""Names that a reader sees: labels, sources, categories, windows, editions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display names that no rule gives.
LABELS = {
    "models-apis": "Models & APIs",
    "api-change": "API change",
    "agents-orchestration": "Agents & orchestration",
    "evaluation-observability": "Evaluation & observability",
    "inference-serving": "Inference & serving",
    "infrastructure-hardware": "Infrastructure & hardware",
    "retrieval-data": "Retrieval & data",
    "safety-security": "Safety & security",
    "training-fine-tuning": "Training & fine-tuning",
}
CATEGORIES = {
    "agentic-generative-ai": "AI Agents & Generative AI",
    "machine-learning-classical-ai": "Machine Learning",
    "vision-speech-robotics": "Vision, Voice & Robotics",
    "data-search-retrieval": "Data, Search & Retrieval",
    "ai-products-engineering-infrastructure": "AI Products & Infrastructure",
    "safety-evaluation-governance": "AI Safety & Evaluation",
}
SOURCES = {
    "anthropic-engineering": "Anthropic Engineering",
    "aws-machine-learning": "AWS Machine Learning",
    "crewai-blog": "CrewAI",
    "github-changelog": "GitHub Changelog",
    "google-developers": "Google Developers",
    "langchain-blog": "LangChain",
    "letta-blog": "Letta",
    "mcp-blog": "MCP",
    "microsoft-foundry": "Microsoft Foundry",
    "simon-agentic-engineering": "Simon Willison",
}
WINDOWS = {"day": "Today", "week": "This week", "month": "This month", "all": "All time"}


def _named(value: Column, names: dict[str, str], rest: Column) -> Column:
    return reduce(lambda out, n: F.when(value == n[0], F.lit(n[1])).otherwise(out), names.items(), rest)


def _capitals(value: Column) -> Column:
    """Hyphens as blanks; the first letter, digit or underscore of each run of them as a capital."""
    words = F.split(F.replace(value, F.lit("-"), F.lit(" ")), r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])", -1)
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), "")


def labelize(value: Column) -> Column:
    return _named(value, LABELS, _capitals(value))


def source_display_name(value: Column, names: dict[str, str] | None = None) -> Column:
    """A given name, else the slug without its kind of publication."""
    return _named(value, SOURCES if names is None else names, _capitals(F.regexp_replace(value, "-(?:blog|news|changelog|technical-blog)$", "")))


def category_label(value: Column) -> Column:
    return _named(value, CATEGORIES, labelize(value))


def edition(window: str, as_of: Column) -> Column:
    """The edition's label for a window."""
    if window == "day":
        return F.lit("Daily Brief")
    if window == "month":
        return F.date_format(as_of, "MMMM yyyy")
    return F.lit("Archive") if window == "all" else F.concat(F.lit("Week "), F.weekofyear(as_of).cast("string"))
