"""Text mining over one text column."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from oreline.functions.core import single
from oreline.operators.aggregates import histogram
from oreline.session import stage

# Words left out of every count, in Portuguese and English.
STOPWORDS_PT = (
    "a", "o", "e", "é", "de", "do", "da", "dos", "das", "em", "no", "na", "nos", "nas", "um", "uma", "uns", "umas", "para",
    "por", "com", "sem", "que", "se", "os", "as", "ao", "aos", "à", "às", "ou", "como", "mas", "mais", "menos", "já", "não",
    "sim", "ser", "ter", "foi", "são", "está", "estão", "seu", "sua", "seus", "suas", "meu", "minha", "este", "esta", "isso",
    "isto", "aquele", "aquela", "entre", "sobre", "até", "depois", "antes", "quando", "onde", "porque", "muito", "muita",
    "pouco", "todo", "toda", "todos", "todas", "me", "te", "lhe", "nós", "eles", "elas", "ele", "ela", "eu", "tu", "você",
    "vocês", "nem", "também", "só", "pela", "pelo", "num", "numa", "dele", "dela",
)
STOPWORDS_EN = (
    "the", "a", "an", "and", "or", "but", "of", "to", "in", "on", "at", "for", "with", "without", "is", "are", "was", "were",
    "be", "been", "being", "this", "that", "these", "those", "it", "its", "as", "by", "from", "up", "down", "out", "so", "than",
    "then", "too", "very", "can", "will", "just", "not", "no", "yes", "i", "you", "he", "she", "we", "they", "them", "his",
    "her", "their", "my", "your", "our", "if", "about", "into", "over", "after", "before", "more", "most", "some", "any", "all",
    "each", "do", "does", "did", "has", "have", "had",
)
# Words with a good and a bad tone.
POSITIVE = (
    "bom", "ótimo", "otimo", "excelente", "maravilhoso", "adorei", "gostei", "recomendo", "perfeito", "incrível", "incrivel",
    "satisfeito", "rápido", "rapido", "eficiente", "positivo", "feliz", "good", "great", "excellent", "awesome", "love",
    "happy", "best", "wonderful", "perfect", "fast", "nice",
)
NEGATIVE = (
    "ruim", "péssimo", "pessimo", "horrível", "horrivel", "odiei", "detestei", "lento", "caro", "problema", "defeito",
    "insatisfeito", "negativo", "triste", "terrível", "terrivel", "bad", "terrible", "awful", "hate", "worst", "slow",
    "expensive", "problem", "broken", "sad", "poor",
)


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def composed(df: DataFrame, text: str) -> DataFrame:
    """Letters followed by combining marks become one letter.

    Only texts with letters beyond Latin-1, which alone can combine, travel to Python; for all others a NULL does, and the
    text stays in the JVM.
    """
    marked = F.when(F.col(text).rlike(r"[^\x{00}-\x{FF}]"), F.col(text))
    return df.withColumn(text, F.coalesce(_composed(marked), F.col(text)))


def word_list(text: Column, stopwords: list[str] | None = None) -> Column:
    """Lower-case runs of at least three letters or digits, no stopwords, not digits alone."""
    stop = STOPWORDS_PT + STOPWORDS_EN if stopwords is None else stopwords
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]{3,}"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*stop) & ~w.rlike(r"^\d+$"))


def tokenize(df: DataFrame, text: str, name: str = "tokens", stopwords=None, compose: bool = True) -> DataFrame:
    """Add the words of each row that has text; rows without any are left out."""
    some = df.filter(F.col(text).isNotNull() & (F.trim(text) != ""))
    if compose:
        some = composed(some, text)
    return some.withColumn(name, word_list(F.col(text), stopwords))


def term_counts(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Occurrences and documents per term in one shuffle that is combined before it moves.

    The words of a row are sorted, so the first of equal ones can stand for the document. The outer form of
    explode keeps the optimizer from adding a filter on the array, which would split every text twice.
    """
    rows = docs.select(F.sort_array(tokens).alias("_w"))
    before = F.concat(F.array(F.lit("")), F.slice("_w", 1, F.greatest(F.size("_w") - 1, F.lit(0))))
    marks = F.zip_with("_w", before, lambda w, b: F.struct(w.alias("term"), (w != b).cast("bigint").alias("first")))
    words = rows.select(F.explode_outer(marks).alias("_m")).filter(F.col("_m.term").isNotNull())
    return words.groupBy("_m.term").agg(F.count(F.lit(1)).alias("tf"), F.sum("_m.first").alias("df"))


def tfidf(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``tf * ln(documents / df)`` over the corpus."""
    n = docs.agg(F.count(F.lit(1))).scalar()
    return term_counts(docs, tokens).withColumn("tfidf", F.round(F.col("tf") * F.ln(n / F.col("df")), 3))


def top_terms(terms: DataFrame, by: str = "tf", k: int = 40) -> DataFrame:
    return terms.orderBy(F.desc(by), "term").limit(k)


def cloud(terms: DataFrame, k: int = 40) -> DataFrame:
    """Font size 12 to 44 by frequency among the top terms."""
    top = top_terms(terms, "tf", k)
    most = top.agg(F.max("tf")).scalar()
    return top.select("term", "tf", F.round(12 + 32 * F.col("tf") / most, 0).cast("bigint").alias("size"))


def corpus_stats(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    words = single(term_counts(docs, tokens).agg(F.count(F.lit(1)).alias("v")))
    return docs.agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.size(tokens).cast("bigint")).alias("total_tokens"),
        F.round(F.avg(F.size(tokens)), 1).alias("avg_tokens_per_doc"),
    ).withColumn("vocabulary", words["v"])


def length_histogram(docs: DataFrame, tokens: str = "tokens", bins: int = 12) -> DataFrame:
    return histogram(docs.select(F.size(tokens).alias("n_tokens")), "n_tokens", bins)


def sentiment(docs: DataFrame, tokens: str = "tokens", positive=None, negative=None) -> DataFrame:
    """Label of each document by which kind of word is in the majority; no shuffle."""
    good, bad = positive or POSITIVE, negative or NEGATIVE
    p = F.size(F.filter(tokens, lambda w: w.isin(*good)))
    n = F.size(F.filter(tokens, lambda w: w.isin(*bad)))
    return docs.withColumns({"n_positive": p, "n_negative": n}).withColumn(
        "sentiment",
        F.when(F.col("n_positive") > F.col("n_negative"), "positive")
        .when(F.col("n_negative") > F.col("n_positive"), "negative").otherwise("neutral"),
    )


def _runs(words: str) -> Column:
    """Distinct words of a sorted list as structs ``(_term, _n)``."""
    places = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1))
    starts = F.filter(places, lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))
    ends = F.concat(F.slice(starts, 2, F.size(words)), F.array(F.size(words)))
    return F.zip_with(starts, ends, lambda i, j: F.struct(F.get(words, i).alias("_term"), (j - i).alias("_n")))


#: The most bytes of a lexicon that is sent to every task.
LEXICON_BYTES = 32 << 20


def lexicon_sentiment(docs: DataFrame, lexicon: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """As ``sentiment``, with a lexicon of one's own: a table ``(term, polarity)`` of any size.

    A term's polarities are added up; above 0 it is good, below 0 bad, at 0 or NULL it counts for nothing. Distinct terms of a document meet
    the lexicon, which is broadcast only if its measured size allows it. ``key`` names a document; rows that share it are one.
    """
    terms = lexicon.filter(F.col("term").isNotNull()).groupBy(F.lower(F.trim("term")).alias("_term")).agg(F.sum(F.col("polarity").cast("double")).alias("_p"))
    terms = stage(terms.filter("_p != 0").select("_term", (F.col("_p") > 0).alias("_good")), "lexicon")
    size = terms.agg(F.sum(F.octet_length("_term") + 32)).first()[0] or 0
    # the outer form of explode keeps the optimizer from adding a filter that splits every text twice
    if size <= LEXICON_BYTES:  # words meet the lexicon where they are, and a document leaves its task as one row
        words = docs.select(F.col(key).alias("_key"), F.explode_outer(tokens).alias("_term"), F.lit(1).alias("_n"))
        met = words.join(F.broadcast(terms), "_term")
    else:  # the words of a row are counted in place, so that only its distinct ones move to the lexicon
        sorted_words = docs.select(F.col(key).alias("_key"), F.sort_array(F.array_compact(tokens)).alias("_w"))
        words = sorted_words.select("_key", F.explode_outer(_runs("_w")).alias("_r")).select("_key", "_r.*").filter("_term IS NOT NULL")
        met = words.join(terms.hint("shuffle_merge"), "_term")
    found = met.groupBy("_key").agg(F.sum(F.when(F.col("_good"), F.col("_n"))).alias("_g"), F.sum(F.when(~F.col("_good"), F.col("_n"))).alias("_b"))
    good, bad = F.coalesce("_g", F.lit(0)).cast("int"), F.coalesce("_b", F.lit(0)).cast("int")
    mood = F.when(good > bad, "positive").when(bad > good, "negative").otherwise("neutral")
    return docs.join(found, F.col(key).eqNullSafe(F.col("_key")), "left").select(*docs.columns, good.alias("n_positive"), bad.alias("n_negative"), mood.alias("sentiment"))


def sentiment_summary(docs: DataFrame, tokens: str = "tokens", positive=None, negative=None) -> DataFrame:
    mood = F.col("sentiment")
    n = F.count(F.lit(1))
    return sentiment(docs, tokens, positive, negative).agg(
        F.count_if(mood == "positive").alias("positive"), F.count_if(mood == "negative").alias("negative"),
        F.count_if(mood == "neutral").alias("neutral"),
        F.round(F.try_divide(100.0 * F.count_if(mood == "positive"), n), 1).alias("positive_pct"),
        F.round(F.try_divide(100.0 * F.count_if(mood == "negative"), n), 1).alias("negative_pct"),
    )
