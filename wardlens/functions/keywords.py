"""Many keywords over a large dictionary of descriptions, by an index of character trigrams.

A keyword is a fragment that a description must contain, as ``ILIKE
'%keyword%'`` says; ``%``, ``_`` and ``\\`` keep their meaning.  Comparing
every description with every keyword costs their product.  Here descriptions
are posted under their trigrams, a keyword is looked up by its rarest ones,
and only descriptions found under all of these are compared.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a gram; a keyword without so many in a row is looked up by its longest grams.
GRAM = 3
#: Grams by which a keyword is looked up, the rarest first.  More of them cost postings, fewer cost comparisons; the result is the same.
RAREST = 3


def _grams(text: Column, size: int) -> Column:
    cut = F.transform(F.sequence(F.lit(1), F.length(text) - (size - 1)), lambda i: F.substring(text, i, F.lit(size)))
    return F.when(F.length(text) >= size, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def _text_grams(text: Column) -> Column:
    """All grams up to :data:`GRAM` characters, and the empty one, under which every description is found."""
    return F.concat(F.array(F.lit("")), *[_grams(text, n) for n in range(1, GRAM + 1)])


def _keyword_grams(keyword: Column) -> Column:
    """Grams of the greatest size that a piece between wildcards has."""
    pieces = F.split(F.regexp_replace(keyword, r"\\.?|[%_]", "\u0000"), "\u0000")
    sizes = [F.array_distinct(F.flatten(F.transform(pieces, lambda p, n=n: _grams(p, n)))) for n in range(GRAM, 0, -1)]
    return F.coalesce(*[F.when(F.size(g) > 0, g) for g in sizes], F.array(F.lit("")))


def match_keywords(texts: DataFrame, text_col: str, keywords: DataFrame, keyword_col: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct ``by, keyword_col, text_col`` where the text contains the keyword, in any case.

    ``by`` names columns of both sides that must be equal too.  Null texts,
    keywords and ``by`` values match nothing; an empty keyword matches every
    text.  Postings are shuffled by ``by`` and gram; a frequent gram is read
    only for keywords that have no rarer ones.
    """
    by = list(by)
    rare = [*by, "_gram"]
    t = texts.select(*by, text_col).where(F.col(text_col).isNotNull()).distinct()
    k = keywords.select(*by, keyword_col).where(F.col(keyword_col).isNotNull()).distinct()
    wanted = k.withColumn("_low", F.lower(keyword_col)).select(*by, keyword_col, F.explode(_keyword_grams(F.col("_low"))).alias("_gram"))
    posts = t.withColumn("_low", F.lower(text_col)).select(*by, text_col, F.explode(_text_grams(F.col("_low"))).alias("_gram"))
    sizes = posts.groupBy(*rare).agg(F.count(F.lit(1)).alias("_n"))
    # A gram that no text has stays, with size 0, so that its keyword finds nothing.
    ranked = (wanted.join(sizes, rare, "left")
              .groupBy(*by, keyword_col)
              .agg(F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("g")))), 1, RAREST).alias("_rarest")))
    seeks = ranked.select(*by, keyword_col, F.size("_rarest").alias("_need"), F.explode("_rarest.g").alias("_gram"))
    found = seeks.join(posts, rare).groupBy(*by, keyword_col, text_col).agg(F.count(F.lit(1)).alias("_got"), F.first("_need").alias("_need"))
    candidates = found.where(F.col("_got") == F.col("_need"))
    return candidates.where(F.ilike(F.col(text_col), F.concat(F.lit("%"), F.col(keyword_col), F.lit("%")))).select(*by, keyword_col, text_col)
