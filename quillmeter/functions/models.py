"""Model names: the ordered keys under which a model may be priced."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Routing prefixes; the family pattern and what it stands for
ROUTES = ("us.", "eu.", "apac.", "global.")
FAMILY = r"^anthropic\.(claude-[a-z]+)-(\d+)-(\d+)(?:-\d{8})?-v\d+(?::\d+)?$"


def _widened(variants: Column, derive: Callable[[Column], Column]) -> Column:
    """All variants, then what each derives, first occurrences in order; nulls are no variants."""
    # bound to a lambda variable: the plan holds the variants' expression once
    both = F.transform(F.array(variants), lambda v: F.array_distinct(F.array_compact(F.concat(v, F.flatten(F.transform(v, derive))))))
    return F.get(both, F.lit(0))


def candidate_keys(model: Column) -> Column:
    """Distinct keys in decreasing confidence, as an array."""
    parts = F.split(model, "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    v = F.array_distinct(F.array(model, F.element_at(parts, -1)))
    v = _widened(v, lambda x: F.array(*[F.when(x.startswith(r), x.substr(len(r) + 1, 1 << 20)) for r in ROUTES]))
    v = _widened(v, lambda x: F.array(F.when(x.rlike(FAMILY), F.regexp_replace(x, FAMILY, "$1-$2.$3"))))
    v = _widened(v, lambda x: F.array(F.replace(x, F.lit("."), F.lit("-")), F.regexp_replace(x, r"(\d)-(\d)", "$1.$2")))
    v = _widened(v, lambda x: F.array(F.regexp_replace(F.regexp_replace(x, r"-\d{8}$", ""), r"-\d{4}-\d{2}-\d{2}$", "")))
    v = _widened(v, lambda x: F.array(F.when(x.startswith("claude-"), F.concat(F.lit("anthropic/"), x))))
    return F.filter(F.array_distinct(F.concat(tails, v)), lambda k: k != "")


def estimate_tokens(text: Column) -> Column:
    """Tokens of a text whose store counts none: a quarter of its UTF-8 bytes, to the nearest ten."""
    return F.floor((F.floor(F.octet_length(text) / 4) + 5) / 10) * 10
