"""Relevance: an additive score of components, and reciprocal-rank terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The components of the score.
EXACT_NAME, NAME_PART = 100.0, 50.0
DEFINITION, IMPLEMENTS = 80.0, 70.0
USE, REFERENCES = -20.0, 40.0
CALLER, TEST = 60.0, 50.0
SEMANTIC_LINE, SEMANTIC = 150.0, 100.0
#: Rank constant of the reciprocal-rank terms.
RANK_CONSTANT = 60


def components(name: Column, kind: Column, relationship: Column, query: Column, similarity: Column) -> dict[str, Column]:
    """Each component of a candidate's score. Null relationships and similarities add nothing."""
    tie = F.coalesce(relationship, F.lit(""))
    use = kind.isin("Import", "Call")
    return {
        "symbol_match": F.when(name == query, EXACT_NAME).when(F.contains(F.lower(name), F.lower(query)), NAME_PART).otherwise(0.0),
        "definition": F.when(tie.isin("Implements", "ExtendedBy"), IMPLEMENTS).when(~use, DEFINITION).otherwise(0.0),
        "reference": F.when(tie == "References", REFERENCES).when(use, USE).otherwise(0.0),
        "caller": F.when(tie.isin("Calls", "CalleeOf"), CALLER).otherwise(0.0),
        "test": F.when(tie.isin("Tests", "TestFor"), TEST).otherwise(0.0),
        "semantic": F.coalesce(similarity, F.lit(0.0)) * F.when(name.startswith("semantic:"), SEMANTIC_LINE).otherwise(SEMANTIC),
    }


def total(parts: dict[str, Column]) -> Column:
    """Sum of the components."""
    out = F.lit(0.0)
    for part in parts.values():
        out = out + part
    return out


def reciprocal_rank(position: Column, weight: float) -> Column:
    """Weight over the rank constant plus a position from 0."""
    return F.lit(weight) / (F.lit(RANK_CONSTANT) + position)


def combine_scores(similarities: Column, lexical_count: Column, semantic_weight: float = 0.5, lexical_weight: float = 0.5, min_score: float = 0.1) -> Column:
    """Weighted mean similarity plus the lexical weight if anything matched, at least `min_score`; 0 if both are empty."""
    size = F.size(F.coalesce(similarities, F.array().cast("array<double>")))
    mean = F.when(size > 0, F.aggregate(similarities, F.lit(0.0), lambda a, x: a + x) / size).otherwise(0.0)
    score = semantic_weight * mean + F.when(lexical_count > 0, lexical_weight).otherwise(0.0)
    return F.when((size == 0) & (lexical_count == 0), 0.0).otherwise(F.greatest(F.lit(min_score), score))
