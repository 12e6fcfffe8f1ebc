"""Ranked name search and batch resolution of identifiers to candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starledger.operators.links import union_all
from starledger.operators.picks import top_k
from starledger.session import cut_lineage, many_tasks


def match_rank(text: Column, query: str) -> Column:
    """0 exact, 1 prefix, 2 otherwise; ``%`` and ``_`` in the query stay live wildcards."""
    return (F.when(F.lower(text) == F.lit(query.lower()), 0)
            .when(text.ilike(query + "%"), 1).otherwise(2))


def search(candidates: DataFrame, stars: DataFrame, crosswalk: DataFrame, query: str,
           limit: int | None = 50) -> DataFrame:
    """(candidate_id, target, disposition, host, tic_id, rank): exact, prefix, then substring hits.

    A hit on a star, by name or identifier, stands for all of its candidates.  An empty query
    finds nothing.
    """
    query = query.strip()
    contains = f"%{query}%"

    def hits(text: str) -> Column:
        return F.col(text).ilike(contains) if query else F.lit(False)

    by_name = candidates.filter(hits("canonical_name")).select(
        "candidate_id", match_rank(F.col("canonical_name"), query).alias("rank"))
    by_id = crosswalk.filter(F.col("candidate_id").isNotNull() & hits("id_value")).select(
        "candidate_id", match_rank(F.col("id_value"), query).alias("rank"))
    host_hits = union_all([
        stars.filter(hits("canonical_name")).select("star_id", F.lit(2).alias("rank")),
        crosswalk.filter(F.col("star_id").isNotNull() & hits("id_value")).select(
            "star_id", match_rank(F.col("id_value"), query).alias("rank")),
    ]).groupBy("star_id").agg(F.min("rank").alias("rank"))
    by_host = candidates.select("candidate_id", "star_id").join(host_hits, "star_id").select(
        "candidate_id", "rank")
    best = union_all([by_name, by_id, by_host]).groupBy("candidate_id").agg(
        F.min("rank").cast("bigint").alias("rank"))
    hosts = stars.select("star_id", F.col("canonical_name").alias("host"), "tic_id")
    found = (candidates.join(best, "candidate_id").join(hosts, "star_id")
             .select("candidate_id", F.col("canonical_name").alias("target"), "disposition",
                     "host", "tic_id", "rank"))
    if limit is None:
        return found
    return found.orderBy("rank", "target", "candidate_id").limit(limit)


def resolve_idents(idents: DataFrame, candidates: DataFrame, stars: DataFrame,
                   crosswalk: DataFrame) -> DataFrame:
    """(ident, candidate_id) for a whole table of tokens; unresolved tokens drop out.

    Tier 0: a candidate id.  Tier 1: a candidate's identifier or name.  Tier 2: a host's name or
    identifier, standing for its first candidate.  Within a tier the lowest candidate id wins.
    """
    asked = idents.select("ident", F.lower(F.trim("ident")).alias("token")).distinct()
    own_id = candidates.select(
        F.col("candidate_id").cast("string").alias("token"), F.lit(0).alias("tier"),
        "candidate_id")
    own_name = union_all([
        candidates.select(F.lower("canonical_name").alias("token"), "candidate_id"),
        crosswalk.filter(F.col("candidate_id").isNotNull()).select(
            F.lower("id_value").alias("token"), "candidate_id"),
    ]).withColumn("tier", F.lit(1))
    first = candidates.groupBy("star_id").agg(F.min("candidate_id").alias("candidate_id"))
    host = union_all([
        stars.select(F.lower("canonical_name").alias("token"), "star_id"),
        crosswalk.filter(F.col("star_id").isNotNull()).select(
            F.lower("id_value").alias("token"), "star_id"),
    ]).join(first, "star_id").select("token", F.lit(2).alias("tier"), "candidate_id")
    # Digits such as 007 name candidate 7: drop leading zeros for the id tier only.
    id_token = F.when(F.col("token").rlike("^[0-9]+$"),
                      F.regexp_replace("token", "^0+(?=.)", ""))
    by_id = asked.withColumn("token", id_token).join(own_id, "token")
    by_name = asked.join(union_all([own_name, host]), "token")
    return (by_id.unionByName(by_name)
            .groupBy("ident").agg(F.min(F.struct("tier", "candidate_id")).alias("_hit"))
            .select("ident", "_hit.candidate_id"))


# --- many searches at once -------------------------------------------------------------------------------

_GRAM = 3
_LONGER = (5, 7)             # lengths of the grams beside: lists of three characters grow with the texts


def _pieces(text: Column, size: int) -> Column:
    """All runs of ``size`` characters."""
    last = F.length(text) - F.lit(size - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(size)))
                  ).otherwise(F.array().cast("array<string>"))


def postings(texts: DataFrame) -> DataFrame:
    """(gram, text): the texts that hold a run of one to three, five or seven characters, case aside.

    Every text holds ''.
    """
    low = F.lower("text")
    sizes = [*range(1, _GRAM + 1), *_LONGER]
    grams = F.array_union(F.array(F.lit("")), F.concat(*[_pieces(low, size) for size in sizes]))
    return texts.select("text", F.explode(F.array_distinct(grams)).alias("gram"))


def needed_grams(queries: DataFrame) -> DataFrame:
    """(query, gram): what every hit must hold: the literal runs between a query's wildcards.

    A run gives its pieces of the greatest indexed length that it has.
    """
    runs = F.split(F.lower("query"), "[%_]")

    def cut(run: Column) -> Column:
        pieces = F.when(F.length(run) <= _GRAM, F.array(run))
        for size, next_size in zip((_GRAM, *_LONGER), _LONGER):
            pieces = pieces.when(F.length(run) < next_size, _pieces(run, size))
        return pieces.otherwise(_pieces(run, _LONGER[-1]))

    grams = F.flatten(F.transform(runs, cut))
    return queries.select("query", F.explode(F.array_distinct(grams)).alias("gram"))


def search_many(queries: DataFrame, candidates: DataFrame, stars: DataFrame, crosswalk: DataFrame,
                limit: int = 50) -> DataFrame:
    """:func:`search` for a whole table of strings (column ``query``): its rows with the query and their place.

    A query meets only the texts in the posting list of its rarest gram, and ``ilike`` with its live
    wildcards confirms them.  A query without a literal character meets every text, as it must.
    """
    asked = queries.select(F.trim("query").alias("query")).filter(F.col("query") != "").distinct()
    named = union_all([
        candidates.select(F.col("canonical_name").alias("text"), "candidate_id", F.lit(0).alias("least")),
        crosswalk.select(F.col("id_value").alias("text"), "candidate_id", "star_id", F.lit(0).alias("least")),
        stars.select(F.col("canonical_name").alias("text"), "star_id", F.lit(2).alias("least")),
    ]).filter(F.col("text").isNotNull())
    # A count of tasks of its own: a text makes a hundred rows, so tasks must not follow from the texts' bytes.
    index = cut_lineage(postings(named.select("text").repartition(many_tasks(queries.sparkSession), "text").distinct()),
                        "postings")
    lengths = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # A gram that no text holds has the shortest list of all, and leads to none.
    rarest = (needed_grams(asked).join(lengths, "gram", "left").groupBy("query")
              .agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), -F.length("gram"), "gram")).alias("gram")))
    literal = F.replace(F.col("query"), F.lit("\\"), F.lit("\\\\"))
    met = rarest.join(index, "gram").withColumn("_like", literal)
    confirmed = met.filter(F.expr("text ILIKE concat('%', _like, '%')"))
    rank = (F.when(F.lower("text") == F.lower("query"), 0)
            .when(F.expr("text ILIKE concat(_like, '%')"), 1).otherwise(2))
    hits = (confirmed.select("query", "text", rank.alias("rank")).join(named, "text")
            .select("query", "candidate_id", "star_id", F.greatest("rank", "least").alias("rank")))
    by_host = (hits.filter(F.col("candidate_id").isNull()).groupBy("query", "star_id").agg(F.min("rank").alias("rank"))
               .join(candidates.select("candidate_id", "star_id"), "star_id"))
    best = union_all([hits.filter(F.col("candidate_id").isNotNull()).select("query", "candidate_id", "rank"),
                      by_host.select("query", "candidate_id", "rank")]).groupBy("query", "candidate_id").agg(
        F.min("rank").cast("bigint").alias("rank"))
    hosts = stars.select("star_id", F.col("canonical_name").alias("host"), "tic_id")
    found = best.join(candidates.select("candidate_id", "star_id", F.col("canonical_name").alias("target"),
                                        "disposition"), "candidate_id").join(hosts, "star_id")
    listed = top_k(found, ["query"], [F.col("rank"), F.col("target"), F.col("candidate_id")], limit, rank="place")
    return listed.select("query", "place", "candidate_id", "target", "disposition", "host", "tic_id", "rank")
