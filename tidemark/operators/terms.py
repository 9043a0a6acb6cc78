"""Terms of texts: candidates, corpus frequency, owners by theme, matches, and term scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import tokens
from ..session import scratch

# Words that carry no theme by themselves.
STOPWORDS = [
    "a", "about", "after", "all", "also", "am", "an", "and", "any", "are", "as", "at", "be", "because", "been", "before", "being", "but", "by", "can", "cant",
    "could", "did", "didnt", "do", "does", "doesnt", "doing", "dont", "for", "from", "get", "got", "had", "has", "have", "having", "he", "her", "here", "hers",
    "him", "his", "how", "i", "if", "in", "into", "is", "it", "its", "just", "me", "more", "most", "my", "no", "nor", "not", "now", "of", "off", "on", "once",
    "one", "only", "or", "other", "our", "out", "over", "own", "same", "she", "should", "so", "some", "such", "than", "that", "the", "their", "them", "then",
    "there", "these", "they", "this", "those", "through", "to", "too", "under", "until", "up", "very", "was", "we", "were", "what", "when", "where", "which",
    "while", "who", "whom", "why", "will", "with", "would", "you", "your", "it's", "i've", "i'd", "don't", "didn't",
]


def _candidate(term: Column) -> Column:
    """Whether a word has three letters or more and is no stopword, or a pair isn't of two stopwords; null for null."""
    pair = ~(F.substring_index(term, " ", 1).isin(STOPWORDS) & F.substring_index(term, " ", -1).isin(STOPWORDS))
    return F.when(F.contains(term, F.lit(" ")), pair).otherwise((F.length(term) >= 3) & ~term.isin(STOPWORDS))


def document_terms(docs: DataFrame, identifier: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, term): the distinct candidate terms of every document, single words and adjacent pairs."""
    worded = docs.select(identifier, *keep, tokens(F.col(text)).alias("words"))
    pairs = F.zip_with("words", F.slice("words", 2, 1_000_000_000), lambda a, b: F.concat(a, F.lit(" "), b))  # null behind the last word
    held = worded.select(identifier, *keep, F.array_distinct(F.concat("words", pairs)).alias("terms"))
    # outer: else the array is made once more, for a filter on its size
    return held.select(identifier, *keep, F.explode_outer("terms").alias("term")).where(_candidate(F.col("term")))


def term_places(docs: DataFrame, identifier: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, term): the terms of ``document_terms``, as often as each stands in the document; no array of them is built."""
    worded = docs.select(identifier, tokens(F.col(text)).alias("words"))
    following = F.slice("words", 2, 1_000_000_000).alias("b")
    a, b = F.col("a"), F.col("b")
    single = F.when((F.length(a) >= 3) & ~a.isin(STOPWORDS), a)
    pair = F.when(b.isNotNull() & ~(a.isin(STOPWORDS) & b.isin(STOPWORDS)), F.concat_ws(" ", a, b))
    rows = worded.select(identifier, F.inline(F.arrays_zip(F.col("words").alias("a"), following)))
    return rows.select(identifier, F.explode(F.array(single, pair)).alias("term")).where("term is not null")


def frequency(doc_terms: DataFrame) -> DataFrame:
    """(term, documents)."""
    return doc_terms.groupBy("term").agg(F.count(F.lit(1)).alias("documents"))


def mine(doc_terms: DataFrame, themes: DataFrame, corpus: int | Column, least: int = 2, odds: float = 3.0, common: float = 0.1, most: int | None = None) -> DataFrame:
    """Terms owned by a theme: (theme, term, in_theme, odds, rank).

    ``doc_terms`` is (doc_id, term), ``themes`` (doc_id, theme), one each; where
    ``doc_terms`` has the document's theme too, nothing is joined for it.  A term
    counts for a theme when ``least`` of its documents hold it, its rate
    there is ``odds`` times the rate in other themes' documents (any number of
    times where those don't hold it: infinity), and at most ``common`` of the
    corpus holds it.  The theme with the highest odds owns it; ties go to the
    last by name.  All owned terms come out, or the first ``most`` of each theme.
    """
    if least < 1 or odds <= 1 or not 0 < common <= 1:
        raise ValueError("least must be 1 or more, odds above 1, common in (0, 1]")
    sizes = themes.groupBy("theme").agg(F.count(F.lit(1)).alias("theme_docs"))
    total = themes.agg(F.count(F.lit(1))).scalar()
    corpus = F.lit(corpus) if isinstance(corpus, int) else corpus
    # one pass over the terms: a document without theme counts for the corpus only
    themed = doc_terms if "theme" in doc_terms.columns else doc_terms.join(themes, "doc_id", "left")
    counts = themed.groupBy("term", "theme").agg(F.count(F.lit(1)).alias("in_theme"))
    term = Window.partitionBy("term")
    counts = counts.withColumn("documents", F.sum("in_theme").over(term)).withColumn("everywhere", F.sum(F.when(F.col("theme").isNotNull(), F.col("in_theme"))).over(term))
    rest = (F.col("everywhere") - F.col("in_theme")) / (total - F.col("theme_docs"))
    scored = (
        counts.where((F.col("in_theme") >= least) & (F.col("documents") <= corpus * common))
        .join(sizes, "theme")
        .withColumn("odds", F.when(F.col("everywhere") > F.col("in_theme"), (F.col("in_theme") / F.col("theme_docs")) / rest).otherwise(float("inf")))
        .where(F.col("odds") >= odds)
    )
    owner = Window.partitionBy("term").orderBy(F.desc("odds"), F.desc("theme"))
    place = Window.partitionBy("theme").orderBy(F.desc("odds"), F.desc("in_theme"), "term")
    owned = scored.withColumn("o", F.row_number().over(owner)).where("o = 1")
    ranked = owned.withColumn("rank", F.row_number().over(place)).select("theme", "term", "in_theme", "odds", "rank")
    return ranked if most is None else ranked.where(F.col("rank") <= most)


def _places(term: Column, bits: int) -> tuple[Column, Column]:
    """Two places of a term among ``bits``, a power of two up to 2**32."""
    h = F.xxhash64(term)
    return h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1))


def possible(doc_terms: DataFrame, owned: DataFrame, bits: int) -> DataFrame:
    """Rows whose term may be owned: all that are, and few others while there are 8 ``bits`` or more for each owned term."""
    words = owned.select(F.explode(F.array(*_places(F.col("term"), bits))).alias("p"))
    words = words.groupBy((F.col("p") / 64).cast("long").alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("word"))
    spread = owned.sparkSession.range(bits // 64).join(words, "id", "left").select("id", F.coalesce("word", F.lit(0)).alias("word"))
    table = spread.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "word"))), lambda x: x["word"])).scalar()
    is_set = [F.getbit(F.get(table, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1 for p in _places(F.col("term"), bits)]
    return doc_terms.where(is_set[0] & is_set[1])


def matched(doc_terms: DataFrame, owned: DataFrame, most_bits: int = 2**24) -> DataFrame:
    """(doc_id, theme, terms): distinct owned terms of each theme in each document; ``doc_terms`` may repeat.

    Owned terms are written once.  A bitmap of them, of 2 MB at most, keeps most
    other terms out of the shuffle; the join with the terms themselves decides.
    """
    spark = owned.sparkSession
    where = scratch(spark, "owned")
    owned.select("term", "theme").write.parquet(where)
    owned = spark.read.schema("term string, theme string").parquet(where)
    bits = min(most_bits, max(64, 1 << (16 * owned.count()).bit_length()))
    held = possible(doc_terms, owned, bits).join(owned, "term").select("doc_id", "theme", "term").distinct()
    return held.groupBy("doc_id", "theme").agg(F.count(F.lit(1)).alias("terms"))


def scan(df: DataFrame, text: Column, lists: dict[str, list[str]]) -> DataFrame:
    """A column per list: how many of its terms stand in the text as whole words, ignoring case."""
    plain = F.lower(F.coalesce(text, F.lit("")))
    hits = [sum((F.when(plain.rlike(rf"(?<![a-z0-9]){t}(?![a-z0-9])"), 1).otherwise(0) for t in terms), F.lit(0)).alias(f"{name}_terms") for name, terms in lists.items()]
    return df.select("*", *hits)


def windowed_matches(scanned: DataFrame, windows: DataFrame, columns: list[str], least: int) -> DataFrame:
    """Per product and window: reviews, and those with a term of each list; ``enough`` if every window has ``least``.

    ``windows`` is (parent_asin, window, lo, hi) in month indices, inclusive.
    """
    w = windows.select(F.col("parent_asin").alias("w_asin"), "window", "lo", "hi")
    inside = (F.col("parent_asin") == F.col("w_asin")) & F.col("ix").between(F.col("lo"), F.col("hi"))
    joined = scanned.join(w, inside)
    per = joined.groupBy("parent_asin", "window").agg(F.count(F.lit(1)).alias("reviews"), *(F.count(F.when(F.col(c) > 0, 1)).alias(c) for c in columns))
    low = per.groupBy("parent_asin").agg(*(F.min(c).alias(f"low_{c}") for c in columns), F.count(F.lit(1)).alias("windows"))
    enough = (F.col("windows") >= 2) & (F.greatest(*(F.col(f"low_{c}") for c in columns), F.lit(0)) >= least)
    return per.join(low.select("parent_asin", enough.alias("enough")), "parent_asin")


def empty_windows(months: DataFrame, length: int = 6) -> DataFrame:
    """Non-overlapping spans of ``length`` empty months inside a product's life: (parent_asin, lo, hi).

    Taken greedily from the start of each gap, so a gap of n months gives n // length spans.
    """
    w = Window.partitionBy("parent_asin").orderBy("ix")
    gaps = months.select("parent_asin", (F.col("ix") + 1).alias("g0"), (F.lead("ix").over(w) - 1).alias("g1"))
    spans = gaps.where(F.col("g1") - F.col("g0") + 1 >= length)
    return spans.select("parent_asin", F.explode(F.sequence("g0", F.col("g1") - (length - 1), F.lit(length))).alias("lo")).withColumn("hi", F.col("lo") + (length - 1))


def answerability(per_window: DataFrame, column: str, enough: int = 3) -> DataFrame:
    """(parent_asin, verdict): ``answerable`` when every window has ``enough`` hits, ``unanswerable`` when none has any, else ``excluded``."""
    v = F.when(F.min(column) >= enough, "answerable").when(F.max(column) == 0, "unanswerable").otherwise("excluded")
    return per_window.groupBy("parent_asin").agg(v.alias("verdict"))
