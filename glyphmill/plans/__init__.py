"""Plans by name: SQL texts over the corpus relations of glyphmill.sources.corpus."""

from __future__ import annotations

from collections.abc import Callable

from glyphmill.functions.dialect import DUCK, SPARK, Spark

#: name -> (text by dialect, relations it reads)
PLANS: dict[str, tuple[Callable[[Spark], str], tuple[str, ...]]] = {}


def plan(*relations: str, name: str | None = None):
    """Registers a function from a dialect to SQL. Relations stand in braces in the text."""

    def keep(f: Callable[[Spark], str]) -> Callable[[Spark], str]:
        PLANS[name or f.__name__] = (f, relations)
        return f

    return keep


def spark_text(name: str) -> str:
    return PLANS[name][0](SPARK)


def duck_text(name: str) -> str:
    from glyphmill.sources.corpus import DEFINITIONS, TABLES, closure

    f, relations = PLANS[name]
    needed = closure(relations)
    names = {r: r for r in (*needed, *TABLES)}
    defined = ",\n".join(f"{r} as materialized ({DEFINITIONS[r](DUCK).format(**names)})" for r in needed)
    return (f"with {defined}\n" if needed else "") + f"select * from (\n{f(DUCK).format(**names)}\n) answer"


def load() -> None:
    """Import all modules of plans."""
    from glyphmill.plans import distances, drift, edits, inference, information, joins, models, profile, recency, replication, texts, words  # noqa: F401
