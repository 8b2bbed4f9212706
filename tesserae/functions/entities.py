"""Entity extraction as column expressions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.constants import ACRONYM_STOPWORDS, HOT_FLOOR, HOT_SHARE, MAX_ENTITIES, TECH_DICTIONARY

from .text import word_list

# Word bounds are ASCII only: a letter outside ASCII does bound a word.
_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
CAMEL = rf"{_B}([A-Z][a-z]+(?:[A-Z][a-z]+)+){_E}"
CAPS = rf"{_B}([A-Z]{{2,6}}){_E}"
PATH = r"""(?U:(?:^|[\s"'(]))([.A-Za-z0-9_/-]+\.[A-Za-z0-9_]{1,10})(?=[\s"'),.]|\z)"""
URL = r"""(https?://[^\s"'<>)]+)"""
MENTION = r"@([a-zA-Z_][A-Za-z0-9_]+)"
TITLE = r"(?s)《(.*?)》"
QUOTE = r"(?s)「(.*?)」"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("([a-zA-Z0-9]+)"), F.lit(1))


def looks_like_path(s: Column) -> Column:
    return s.rlike("[A-Za-z]") & F.exists(F.split(s, r"\."), lambda p: F.length(p) > 1)


def extract(text: Column, cap: int | None = MAX_ENTITIES) -> Column:
    """Camel case, capitals, paths, links, mentions, titles, then dictionary words; distinct, in this order."""
    first = F.concat(_all(text, CAMEL), _all(text, CAPS), F.filter(_all(text, PATH), looks_like_path), _all(text, URL), _all(text, MENTION), _all(text, TITLE), _all(text, QUOTE))
    first = F.filter(F.array_except(first, word_list(ACRONYM_STOPWORDS)), lambda x: x != "")
    got = F.array_distinct(F.concat(first, F.array_intersect(words(text), word_list(TECH_DICTIONARY))))
    return got if cap is None else F.slice(got, 1, cap)


def candidate_words(text: Column) -> Column:
    return F.array_except(words(text), word_list(ACRONYM_STOPWORDS))


def merge(provided: Column, extracted: Column) -> Column:
    return F.slice(F.array_distinct(F.concat(provided, extracted)), 1, MAX_ENTITIES)


def extract_indexed(text: Column, known: Column) -> Column:
    """Known entities that are words of the text come first."""
    return merge(F.array_intersect(candidate_words(text), known), extract(text, None))


def hot_limit(n: Column) -> Column:
    return F.greatest(F.lit(float(HOT_FLOOR)), n * HOT_SHARE)


def document_frequency(insights: DataFrame) -> DataFrame:
    """(entity, df): in how many rows an entity stands."""
    return insights.select(F.explode(F.array_distinct("entities")).alias("entity")).groupBy("entity").agg(F.count("*").alias("df"))


def admitted(insights: DataFrame, texts: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(id, word): words of the texts that are stored entities and not too common. The count of rows
    joins as a single row; words meet entities in one equality join."""
    n = insights.agg(F.count("*").alias("n"))
    words_ = texts.select(F.col(id_col), F.explode(F.array_distinct(candidate_words(F.col(text_col)))).alias("entity"))
    limited = document_frequency(insights).join(F.broadcast(n), F.col("df") <= hot_limit(F.col("n"))).select("entity")
    return words_.join(limited, "entity").select(id_col, F.col("entity").alias("word"))
