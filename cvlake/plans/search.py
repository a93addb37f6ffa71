"""Query parsing, scores, and the ranking of candidates."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cvlake.config import CONFIG, POSTCODE, QUERY_STOP, Config
from cvlake.functions.text import clip01, cosine, first_spellings, let, postcode, strip
from cvlake.functions.terms import counted_terms, search_terms
from cvlake.operators.catalogue import Catalogue, canonicalise
from cvlake.plans.weights import BATCH, n_parts, of_texts, size_of, weighed
from cvlake.sources.store import scratch, settings, written

if TYPE_CHECKING:
    from cvlake.plans.index import View

YEARS = r"(?i)\b([0-9]{1,2})\s*\+?\s*(?:years|yrs|year)\b"
SKILL_TOKEN = r"[A-Za-z0-9][A-Za-z0-9\-+/& ]{1,40}"


def query_years(q: Column) -> Column:
    """Q2."""
    return F.nullif(F.regexp_extract(q, YEARS, 1), F.lit("")).cast("int")


def query_postcodes(q: Column) -> Column:
    """Q3."""
    part = lambda i: F.regexp_extract_all(q, F.lit(POSTCODE), F.lit(i))
    return first_spellings(F.zip_with(part(1), part(2), postcode))


def query_skills(q: Column, catalogue: Catalogue) -> Column:
    """Q4."""
    tokens = F.filter(F.transform(F.regexp_extract_all(q, F.lit(SKILL_TOKEN), F.lit(0)), strip), lambda t: t != "")
    found = F.transform(tokens, lambda t: canonicalise(t, catalogue))
    sure = F.filter(found, lambda c: (c["canonical"] != "") & (c["confidence"] >= 0.70) & (c["method"] != "passthrough"))
    return first_spellings(F.transform(sure, lambda c: c["canonical"]))


def query_terms(q: Column) -> Column:
    """Q5: words of a-z and 0-9 that border on no other letter, digit or underscore."""
    runs = F.regexp_extract_all(F.lower(q), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.slice(first_spellings(F.filter(runs, lambda w: w.rlike("^[a-z0-9]{2,}$") & ~w.isin(*QUERY_STOP))), 1, 30)


def parse_query(q: Column, catalogue: Catalogue | None = None) -> Column:
    """Q1: struct<raw, years_min, postcodes, skills, must_terms>."""
    parsed = lambda t: F.struct(t.alias("raw"), query_years(t).alias("years_min"), query_postcodes(t).alias("postcodes"), query_skills(t, catalogue or Catalogue()).alias("skills"), query_terms(t).alias("must_terms"))
    return let(strip(F.coalesce(q, F.lit(""))), parsed)


def query_counts(spark: SparkSession, query: str, stop: tuple[str, ...]) -> DataFrame:
    """(term, qtf) of a query: a string of the user's, so a few rows."""
    one = spark.range(1).select(F.explode(search_terms(F.lit(query), stop)).alias("term"))
    return one.groupBy("term").agg(F.count(F.lit(1)).alias("qtf"))


#: Letters of a text for each of its postings, at least.
LETTERS_OF_A_POSTING = 3


def idf(n: Column, df: Column) -> Column:
    return F.log((1 + n) / (1 + df)) + 1.0


def tfidf_scores(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text", config: Config = CONFIG) -> DataFrame:
    """H1: (key, tfidf) of every document: cosine of its terms' weights with the query's, which counts as a document.

    key must name a row. Texts are counted once; arrays of postings are exchanged by term, and sums for each text back (see weights).
    """
    spark, counts = docs.sparkSession, query_counts(docs.sparkSession, query, config.search_stop)
    n, letters = size_of(docs, F.octet_length(text))
    asked = {r.term: r.qtf for r in counts.collect()}  # a handful
    counted = counted_terms(docs, text, F.col(key).alias("key"), stop=config.search_stop)
    met = weighed(counted, n_parts(docs, letters // LETTERS_OF_A_POSTING), n + 1, config.max_df, asked, keep=False)
    with settings(spark, **BATCH):
        met = written(met, scratch(spark, "weights"))  # read twice
    # a term of the query that no text has is there with the query's own frequency
    known = met.where("term IS NOT NULL").select("term", "df").unionByName(counts.select("term", F.lit(1).cast("bigint").alias("df"))).groupBy("term").agg(F.max("df").alias("df"))
    vocabulary = counts.hint("merge").join(known.where(F.col("df") <= config.max_df * (n + 1)), "term")
    whole = vocabulary.agg(F.sum((F.col("qtf") * idf(F.lit(n + 1), F.col("df"))) ** 2).alias("qq"))
    cosine = clip01(F.col("wq") / F.sqrt(F.col("ww") * F.col("qq")))
    return of_texts(met).join(F.broadcast(whole)).select(F.col("key").alias(key), F.when(F.col("wq") > 0, cosine).otherwise(0.0).alias("tfidf"))


def embed_score(query_vector: Column, vector: Column) -> Column:
    """H2: cosine moved to 0..1; 0 where there is no vector at all."""
    return F.when(vector.isNull() | query_vector.isNull(), 0.0).otherwise(clip01((cosine(query_vector, vector) + 1.0) / 2.0))


def keyword_overlap(terms: Column, text: Column) -> Column:
    """H3: share of the terms that occur anywhere in the text, of six at least."""
    hits = let(F.lower(text), lambda low: F.size(F.filter(terms, lambda t: F.contains(low, t))))
    return F.when(F.size(terms) > 0, clip01(hits / F.greatest(F.lit(6), F.size(terms)))).otherwise(0.0)


def skill_bonus(asked: Column, held: Column) -> Column:
    """H4: share of the asked skills that a candidate holds, of two at least."""
    low = lambda a: F.transform(a, F.lower)
    matched = let(low(held), lambda h: F.size(F.filter(low(asked), lambda s: F.array_contains(h, s))))
    return F.when(F.size(asked) > 0, clip01(matched / F.greatest(F.lit(2), F.size(asked)))).otherwise(0.0)


def postcode_ok(asked: Column, own: Column) -> Column:
    """H5."""
    return (F.size(asked) == 0) | F.coalesce(F.array_contains(F.transform(asked, F.upper), F.upper(own)), F.lit(False))


def years_ok(years_min: Column, months: Column) -> Column:
    """H6."""
    return years_min.isNull() | (F.coalesce(months, F.lit(0)) / 12.0 + 0.01 >= years_min)


def hybrid(tfidf: Column, embed: Column, overlap: Column, bonus: Column, config: Config = CONFIG) -> Column:
    """H7."""
    w = config.weights
    return clip01(F.lit(w["tfidf"]) * tfidf + F.lit(w["embed"]) * embed + F.lit(w["overlap"]) * overlap + F.lit(w["skill_bonus"]) * bonus)


def in_sectors(candidates: DataFrame, sectors: tuple[str, ...]) -> DataFrame:
    """Goes before the scores, as it decides what the term frequencies are counted on."""
    return candidates.where(F.col("sector").isin(*sectors))


def _best_first(config: Config) -> list[Column]:
    """Scores that differ by less than 1e-9 are ties, as sums come in any order."""
    sector = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in config.sectors]), F.col("sector")), F.lit(0))
    return [F.round("score", 9).desc(), sector, F.lower("file_name"), F.col("file_id")]


def _scored(candidates: DataFrame, scores: DataFrame, on: list[str], asked: DataFrame, config: Config, query_vector: list[float] | None) -> DataFrame:
    """Candidates that pass the hard filters, with score and explain; those that scores lacks have no TF-IDF."""
    vector = F.array(*[F.lit(float(x)) for x in query_vector]) if query_vector is not None else None
    rows = candidates.join(scores, on, "left").withColumn("tfidf", F.coalesce("tfidf", F.lit(0.0))).join(F.broadcast(asked))
    own = F.col("parsed.contact_information.postcode.value")
    years = F.coalesce(F.col("total_experience_months"), F.lit(0)) / 12.0
    rows = rows.where(postcode_ok(F.col("q.postcodes"), own) & years_ok(F.col("q.years_min"), F.col("total_experience_months")))
    rows = rows.withColumns({
        "_embed": embed_score(vector, F.col("vector")) if vector is not None else F.lit(0.0),
        "_overlap": keyword_overlap(F.col("q.must_terms"), F.col("_search_text")),
        "_bonus": skill_bonus(F.col("q.skills"), F.col("parsed.skills.all_skills")),
    })
    score = hybrid(F.col("tfidf"), F.col("_embed"), F.col("_overlap"), F.col("_bonus"), config)
    explain = F.struct("tfidf", F.col("_embed").alias("embed"), F.col("_overlap").alias("overlap"), F.col("_bonus").alias("skill_bonus"), F.round(years, 2).alias("years"), own.alias("postcode"), F.col("q.skills").alias("query_skills"))
    return rows.select(score.alias("score"), explain.alias("explain"), *[F.col(c) for c in candidates.columns])


def rank(candidates: DataFrame, query: str, top_k: int = CONFIG.top_k, catalogue: Catalogue | None = None, config: Config = CONFIG, min_score: float | None = None, query_vector: list[float] | None = None, index: View | None = None) -> DataFrame:
    """H8, H9: the best candidates with score and explain; ties by sector order, then file name, then id.

    candidates should be a stored table, as it is read for the term counts and for the result. Term statistics are of all
    candidates given; hard filters come after. min_score (H11) is applied before the limit, which gives the same rows and
    sorts fewer. A column vector (array<float>) takes part if query_vector is given.

    With index (a view of the same candidates) no text is tokenised: the postings of the query's terms are read, and blocks of
    candidates that can't have one of the best are skipped (see best_blocks). The rows are the same.
    """
    if not (query or "").strip():
        return candidates.limit(0).select(F.lit(0.0).alias("score"), "*")
    asked = candidates.sparkSession.range(1).select(parse_query(F.lit(query), catalogue).alias("q"))
    if index is None:
        ranked = _scored(candidates, tfidf_scores(candidates, query, "file_id", "_search_text", config), ["file_id"], asked, config, query_vector)
    else:
        terms, keep = index.asked(query), best_blocks(candidates, query, top_k, asked, config, min_score, query_vector, index)
        if keep is not None:
            candidates = candidates.withColumn("block", index.block()).join(keep, "block", "left_semi").drop("block")
        ranked = _scored(candidates, index.scores(terms, keep), ["sector", "file_id"], asked, config, query_vector)
    if min_score is not None:
        ranked = ranked.where(F.col("score") >= min_score)
    return ranked.orderBy(*_best_first(config)).limit(top_k)


def best_blocks(candidates: DataFrame, query: str, top_k: int, asked: DataFrame, config: Config, min_score: float | None, query_vector: list[float] | None, index: View) -> DataFrame | None:
    """The blocks (column block) that can hold one of the best; None if it takes all of them.

    A block's bound is its largest TF-IDF by the maxima of the query's terms, and what keyword overlap, skills and vector can
    add at most. The blocks with the best bounds are scored first; the score of the last of the best found there, which
    is a true candidate's, is what the bound of any other block must reach.
    """
    terms, w, q = index.asked(query), config.weights, asked.first().q
    share = lambda xs, least: min(1.0, len(xs) / max(least, len(xs))) if xs else 0.0
    rest = w["embed"] * (query_vector is not None) + w["overlap"] * share(q.must_terms, 6) + w["skill_bonus"] * share(q.skills, 2)
    bounds = index.bounds(terms).withColumn("bound", w["tfidf"] * F.col("bound") + F.lit(rest))
    first = [r.block for r in bounds.orderBy(F.desc("bound"), "block").limit(FIRST_BLOCKS).collect()]
    mine = candidates.where(index.block().isin(*first)) if first else candidates.limit(0)
    best = _scored(mine, index.scores(terms, first), ["sector", "file_id"], asked, config, query_vector).select("score").orderBy(F.desc("score")).limit(top_k).collect()
    least = max(best[-1].score if len(best) == top_k else -1.0, -1.0 if min_score is None else min_score) - 1e-9
    return None if rest >= least else bounds.where(F.col("bound") >= least).select("block")


#: Blocks that a search scores before it knows which others it can skip.
FIRST_BLOCKS = 16


def result_table(ranked: DataFrame) -> DataFrame:
    """The ten columns shown."""
    who, where, skills = F.col("parsed.personal_information"), F.col("parsed.contact_information"), F.col("parsed.skills.all_skills")
    return ranked.select(
        F.round("score", 4).alias("score"), "sector", who["full_name"].alias("name"), where["email"]["value"].alias("email"),
        where["phone"]["value"].alias("phone"), where["postcode"]["value"].alias("postcode"), F.round(F.col("total_experience_months") / 12.0, 2).alias("years_est"),
        F.array_join(F.slice(skills, 1, 12), ", ").alias("top_skills"), F.col("file_name").alias("file"), F.col("file_url").alias("resume_url"),
    )


def result_details(ranked: DataFrame, config: Config = CONFIG) -> DataFrame:
    """Of the best ten, more skills, the summary and the explanation."""
    best = ranked.orderBy(*_best_first(config)).limit(10)
    name = F.coalesce(F.col("parsed.personal_information.full_name"), F.col("file_name"))
    return best.select(name.alias("name"), F.round("score", 3).alias("score"), "sector", F.col("file_url").alias("resume_url"), F.array_join(F.slice("parsed.skills.all_skills", 1, 25), ", ").alias("top_skills"), F.col("parsed.summary").alias("summary"), "explain")
