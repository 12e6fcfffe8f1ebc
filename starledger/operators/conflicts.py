"""Who disagrees about what: numeric spreads, disposition fights, paged lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starledger import specs
from starledger.functions.text import matched_exact, matched_number


def numeric_by_source(claims: DataFrame, eid: str, attribute: str,
                      pattern: str = specs.NUMBER_PATTERN) -> DataFrame:
    """(eid, source, mn, mx, low, high, n): one row per entity and source, text that is no number left out.

    ``low`` and ``high`` are the ends as (v, exact): the double, and the decimal where one holds it.
    """
    return (_numbers(claims.filter((F.col("attribute") == attribute) & F.col(eid).isNotNull()), eid, pattern)
            .groupBy("eid", "source")
            .agg(F.min("number").alias("low"), F.max("number").alias("high"), F.count(F.lit(1)).alias("n"))
            .select("eid", "source", F.col("low.v").alias("mn"), F.col("high.v").alias("mx"), "low", "high", "n"))


def _numbers(claims: DataFrame, eid: str, pattern: str, *more: str) -> DataFrame:
    """(eid, source, more, number) of the claims whose text is a number."""
    number = F.struct(matched_number(F.col("value"), pattern).alias("v"),
                      matched_exact(F.col("value"), pattern).alias("exact"))
    return (claims.select(F.col(eid).alias("eid"), "source", *more, number.alias("number"))
            .filter(F.col("number.v").isNotNull()))


def numeric_conflicts(claims: DataFrame, eid: str, attribute: str, threshold: str) -> DataFrame:
    """(eid, mn, mx, n_sources, spread): spread beyond ``threshold`` across two or more sources.

    Built on the per-source rows, so no ``count(distinct)``: two distinct values exist exactly
    when min and max differ.
    """
    return _disagreeing(numeric_by_source(claims, eid, attribute), threshold)


def _disagreeing(by_source: DataFrame, threshold: str) -> DataFrame:
    """Entities of per-source ranges whose spread is beyond ``threshold``.

    The test multiplies instead of dividing, exactly, in decimal; in floating point only where an
    end has more digits than a decimal holds.
    """
    rolled = by_source.groupBy("eid").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.count(F.lit(1)).alias("n_sources"))
    beyond, spread = _beyond(threshold)
    return rolled.filter(beyond).select("eid", F.col("low.v").alias("mn"), F.col("high.v").alias("mx"), "n_sources",
                                        spread.alias("spread"))


def _beyond(threshold: str) -> tuple[Column, Column]:
    """(test, spread) of an entity's ends ``low`` and ``high`` and its ``n_sources``."""
    mn, mx = F.col("low.v"), F.col("high.v")
    low, high = F.col("low.exact"), F.col("high.exact")
    over = F.coalesce((high - low) > F.lit(threshold).cast("decimal(3,2)") * high,
                      (mx - mn) > F.lit(float(threshold)) * mx)
    differ = F.coalesce(low != high, mn != mx)
    return ((F.col("n_sources") >= 2) & differ & (mx > 0) & over,
            F.coalesce((high - low).cast("double"), mx - mn) / mx)


def mapped_dispositions(claims: DataFrame, vocabulary: DataFrame,
                        eid: str = "candidate_id") -> DataFrame:
    """(eid, source, canon): disposition claims whose word the vocabulary knows, exactly."""
    words = vocabulary.select("source", F.col("source_value").alias("value"),
                              F.col("canonical").alias("canon"))
    return (claims.filter((F.col("attribute") == "disposition") & F.col(eid).isNotNull())
            .join(words, ["source", "value"])
            .select(F.col(eid).alias("eid"), "source", "canon"))


def _is_confirmed(canon: Column) -> Column:
    return canon.isin("CONFIRMED", "KNOWN_PLANET")


def disposition_conflicts(mapped: DataFrame) -> DataFrame:
    """(eid, dispositions, dramatic) of entities with two or more canonical dispositions.

    The set per entity is no larger than the canonical vocabulary.
    """
    sets = mapped.groupBy("eid").agg(F.collect_set("canon").alias("dispositions"))
    held = F.col("dispositions")
    dramatic = (F.array_contains(held, "FALSE_POSITIVE")
                & F.exists(held, _is_confirmed))
    return (sets.filter(F.size(held) >= 2)
            .select("eid", F.array_sort(held).alias("dispositions"), dramatic.alias("dramatic")))


def disposition_fights(mapped: DataFrame) -> DataFrame:
    """(eid, n_dispo, has_fp, has_confirmed, detail): the same conflicts with who says what."""
    distinct = mapped.distinct()  # at most sources x vocabulary rows per entity from here on
    said = F.concat_ws("=", "source", "canon")
    grouped = distinct.groupBy("eid").agg(
        F.size(F.collect_set("canon")).cast("bigint").alias("n_dispo"),
        F.bool_or(F.col("canon") == "FALSE_POSITIVE").alias("has_fp"),
        F.bool_or(_is_confirmed(F.col("canon"))).alias("has_confirmed"),
        F.array_join(F.array_sort(F.collect_set(said)), "; ").alias("detail"))
    return grouped.filter(F.col("n_dispo") >= 2)


def report_conflicts(claims: DataFrame, eid: str, attribute: str, tolerance: float) -> DataFrame:
    """The report's flavour: stricter number pattern, spread in floating point, detail per source."""
    return _reported(numeric_by_source(claims, eid, attribute, specs.REPORT_NUMBER_PATTERN), tolerance)


def _reported(per_source: DataFrame, tolerance: float | Column, *more: str) -> DataFrame:
    low, high = short_number(F.col("mn")), short_number(F.col("mx"))
    said = F.concat(F.col("source"), F.lit(": "), F.when(F.col("mn") == F.col("mx"), low).otherwise(
        F.concat(low, F.lit("–"), high, F.lit(" ("), F.col("n").cast("string"), F.lit(")"))))
    rolled = per_source.groupBy(*more, "eid").agg(
        F.count(F.lit(1)).alias("n_src"), F.min("mn").alias("min"), F.max("mx").alias("max"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", said.alias("s")))),
                                 lambda x: x["s"]), "; ").alias("detail"))
    spread = (F.col("max") - F.col("min")) / F.col("max")
    return (rolled.filter((F.col("n_src") >= 2) & (F.col("max") > 0))
            .withColumn("spread", spread)
            .filter(F.col("spread") > (tolerance if isinstance(tolerance, Column) else F.lit(tolerance))))


def short_number(value: Column) -> Column:
    """A double with four significant digits, as ``%.4g`` prints it (no trailing zeros).

    Between 0.001 and 10000 the number is rounded as a number, far cheaper than formatting it.
    """
    magnitude = F.floor(F.log10(F.abs(value)))
    scale = F.pow(F.lit(10.0), F.lit(3) - magnitude)
    plain = F.regexp_replace((F.rint(value * scale) / scale).cast("string"), r"\.0$", "")
    text = F.format_string("%.3e", value)
    mantissa = F.regexp_replace(F.substring_index(text, "e", 1), r"\.?0+$", "")
    exponent = F.substring_index(text, "e", -1)
    tiny = F.regexp_replace(F.format_string("%.7f", value), r"\.?0+$", "")
    return (F.when(value == 0, F.lit("0"))
            .when((magnitude >= -3) & (magnitude < 4) & (F.abs(value) < 9999.5), plain)
            .when(exponent == "-04", tiny)
            .otherwise(F.concat(mantissa, F.lit("e"), exponent)))


def label_candidates(conflicts: DataFrame, candidates: DataFrame, stars: DataFrame) -> DataFrame:
    """Conflict rows with the candidate's name and disposition and its host's name and TIC."""
    return conflicts.join(_labels(candidates, stars).withColumnRenamed("candidate_id", "eid"), "eid")


def label_few(conflicts: DataFrame, candidates: DataFrame, stars: DataFrame) -> DataFrame:
    """:func:`label_candidates` of a list with a fixed limit: the tables are filtered by it, not joined whole."""
    named = candidates.select(F.col("candidate_id").alias("eid"), "star_id", F.col("canonical_name").alias("target"),
                              "disposition").join(F.broadcast(conflicts), "eid")
    hosts = stars.select("star_id", F.col("canonical_name").alias("host"), "tic_id")
    return hosts.join(F.broadcast(named), "star_id")        # a candidate's id names one candidate


def _labels(candidates: DataFrame, stars: DataFrame) -> DataFrame:
    hosts = stars.select("star_id", F.col("canonical_name").alias("host"), "tic_id")
    return (candidates.select("candidate_id", "star_id", F.col("canonical_name").alias("target"),
                              "disposition")
            .join(hosts, "star_id"))


def first_candidate(candidates: DataFrame) -> DataFrame:
    """Each star's representative: its candidate with the lowest id."""
    return candidates.groupBy("star_id").agg(
        F.min_by(F.struct("candidate_id", F.col("canonical_name").alias("target"), "disposition"),
                 "candidate_id").alias("_rep")).select("star_id", "_rep.*")


def label_stars(conflicts: DataFrame, candidates: DataFrame, stars: DataFrame) -> DataFrame:
    """Star-level conflict rows with the host label and the representative candidate."""
    hosts = stars.select(F.col("star_id").alias("eid"), F.col("canonical_name").alias("host"),
                         "tic_id")
    reps = first_candidate(candidates).withColumnRenamed("star_id", "eid")
    return conflicts.join(hosts, "eid").join(reps, "eid")


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of a totally ordered list."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def conflict_list(claims: DataFrame, candidates: DataFrame, stars: DataFrame, vocabulary: DataFrame,
                  kind: str) -> tuple[DataFrame, list[Column]]:
    """The disposition, radius or teff conflict list and its total order, largest disagreements first."""
    if kind == "disposition":
        found = disposition_conflicts(mapped_dispositions(claims, vocabulary))
        rows = label_candidates(found, candidates, stars)
        order = [F.col("dramatic").desc(), F.col("target"), F.col("eid")]
        return rows.withColumn("attribute", F.lit("disposition")), order
    if kind not in specs.CONFLICT_LISTS:
        raise ValueError(f"unknown conflict type: {kind!r}")
    spec = specs.CONFLICT_LISTS[kind]
    eid = f"{spec['level']}_id"
    found = numeric_conflicts(claims, eid, spec["attribute"], spec["threshold"])
    if spec["level"] == "candidate":
        rows, name = label_candidates(found, candidates, stars), "target"
        rows = rows.withColumn("candidate_id", F.col("eid"))
    else:
        rows, name = label_stars(found, candidates, stars), "host"
    rows = rows.withColumns({"attribute": F.lit(spec["attribute"]), "unit": F.lit(spec["unit"]),
                             "spread_pct": F.round(F.col("spread") * 100, 1)})
    return rows, [F.col("spread").desc(), F.col(name), F.col("eid")]


def conflict_page(claims: DataFrame, candidates: DataFrame, stars: DataFrame,
                  vocabulary: DataFrame, kind: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """One of the first pages; for deep ones store the list (:mod:`starledger.sources.paged`)."""
    rows, order = conflict_list(claims, candidates, stars, vocabulary, kind)
    return page(rows, order, limit, offset)


def conflict_total(claims: DataFrame, vocabulary: DataFrame, kind: str) -> DataFrame:
    """One row (n): the length of the whole list a page is taken from."""
    if kind == "disposition":
        found = disposition_conflicts(mapped_dispositions(claims, vocabulary))
    else:
        spec = specs.CONFLICT_LISTS[kind]
        found = numeric_conflicts(claims, f"{spec['level']}_id", spec["attribute"],
                                  spec["threshold"])
    return found.agg(F.count(F.lit(1)).alias("n"))


def numeric_ranges(claims: DataFrame, eid: str, attributes: list[str],
                   pattern: str = specs.NUMBER_PATTERN) -> DataFrame:
    """:func:`numeric_by_source` of several attributes in one pass, with the attribute."""
    wanted = claims.filter(F.col("attribute").isin(*attributes) & F.col(eid).isNotNull())
    return (_numbers(wanted, eid, pattern, "attribute").groupBy("attribute", "eid", "source")
            .agg(F.min("number").alias("low"), F.max("number").alias("high"), F.count(F.lit(1)).alias("n"))
            .select("attribute", "eid", "source", F.col("low.v").alias("mn"), F.col("high.v").alias("mx"),
                    "low", "high", "n"))


def _level_of(levels: dict[str, str]) -> Column:
    """The entity id that a claim's attribute is about: ``levels`` names its column."""
    stars = [a for a, level in levels.items() if level == "star_id"]
    return F.when(F.col("attribute").isin(*stars), F.col("star_id")).otherwise(F.col("candidate_id"))


def claim_digest(claims: DataFrame, vocabulary: DataFrame, levels: dict[str, str]) -> DataFrame:
    """(attribute, eid, source, mn, mx, n, canons): one scan and one exchange for all attributes.

    ``levels`` gives the id column of every numeric attribute; dispositions are about candidates.  Numbers
    follow the report's stricter pattern; ``canons`` are the canonical words of the disposition rows.
    """
    words = vocabulary.select(F.lit("disposition").alias("attribute"), "source",
                              F.col("source_value").alias("value"), F.col("canonical").alias("canon"))
    eid = _level_of(levels)
    wanted = claims.filter(F.col("attribute").isin("disposition", *levels) & eid.isNotNull())
    number = F.when(F.col("attribute") != "disposition", matched_number(F.col("value"), specs.REPORT_NUMBER_PATTERN))
    return (wanted.join(words, ["attribute", "source", "value"], "left")
            .select("attribute", eid.alias("eid"), "source", number.alias("v"), "canon")
            .filter(F.col("v").isNotNull() | F.col("canon").isNotNull())
            .groupBy("attribute", "eid", "source")
            .agg(F.min("v").alias("mn"), F.max("v").alias("mx"), F.count("v").alias("n"),
                 F.collect_set("canon").alias("canons")))


def report_tables(digest: DataFrame, tolerances: dict[str, float]) -> DataFrame:
    """:func:`report_conflicts` of every attribute of a :func:`claim_digest`, with the attribute."""
    limit = F.element_at(F.create_map(*[F.lit(x) for item in tolerances.items() for x in item]), F.col("attribute"))
    return _reported(digest.filter(F.col("attribute") != "disposition"), limit, "attribute")


def conflict_counts(claims: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """One row: disposition conflicts, the dramatic ones, radius and Teff conflicts.

    One scan and one exchange: a claim is about one entity of one list, whose ends, sources and
    canonical words are collected together (sources and words are few), then the lists are told apart.
    """
    lists = {spec["attribute"]: (kind, spec) for kind, spec in specs.CONFLICT_LISTS.items()}
    eid = _level_of({a: f"{spec['level']}_id" for a, (_, spec) in lists.items()})
    words = vocabulary.select(F.lit("disposition").alias("attribute"), "source",
                              F.col("source_value").alias("value"), F.col("canonical").alias("canon"))
    numeric = F.col("attribute") != "disposition"
    number = F.when(numeric, F.struct(matched_number(F.col("value"), specs.NUMBER_PATTERN).alias("v"),
                                      matched_exact(F.col("value"), specs.NUMBER_PATTERN).alias("exact")))
    rows = (claims.filter(F.col("attribute").isin("disposition", *lists) & eid.isNotNull())
            .join(words, ["attribute", "source", "value"], "left")
            .select("attribute", eid.alias("eid"), "source", number.alias("number"), "canon"))
    known = F.col("number.v").isNotNull()
    entities = rows.groupBy("attribute", "eid").agg(
        F.min(F.when(known, F.col("number"))).alias("low"), F.max(F.when(known, F.col("number"))).alias("high"),
        F.size(F.collect_set(F.when(known, F.col("source")))).alias("n_sources"),
        F.collect_set("canon").alias("held"))
    fights = (F.col("attribute") == "disposition") & (F.size("held") >= 2)
    counts = [F.count(F.when(fights, 1)).alias("disposition"),
              F.count(F.when(fights & F.array_contains("held", "FALSE_POSITIVE")
                             & F.exists("held", _is_confirmed), 1)).alias("disposition_dramatic")]
    for attribute, (kind, spec) in lists.items():
        beyond, _ = _beyond(spec["threshold"])
        counts.append(F.count(F.when((F.col("attribute") == attribute) & beyond, 1)).alias(kind))
    return entities.agg(*counts)


def _counts(frames: list[DataFrame], names: list[str]) -> DataFrame:
    rows = frames[0]
    for frame in frames[1:]:
        rows = rows.unionByName(frame)
    return rows.agg(*[F.count(F.when(F.col("kind") == name, 1)).alias(name) for name in names])


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row with the row count of each table."""
    return _counts([df.select(F.lit(name).alias("kind")) for name, df in tables.items()],
                   list(tables))


def provenance_numeric(claims: DataFrame, eid: str, attribute: str, page_rows: DataFrame) -> DataFrame:
    """Per-source ranges, only for the entities on a page."""
    wanted = page_rows.select("eid").distinct()
    on_page = claims.join(wanted, F.col(eid) == F.col("eid"), "left_semi")
    return numeric_by_source(on_page, eid, attribute)


def provenance_dispositions(claims: DataFrame, vocabulary: DataFrame,
                            page_rows: DataFrame) -> DataFrame:
    """Distinct (eid, source, canon), only for the entities on a page."""
    wanted = page_rows.select("eid").distinct()
    on_page = claims.join(wanted, F.col("candidate_id") == F.col("eid"), "left_semi")
    return mapped_dispositions(on_page, vocabulary).distinct()


def count_by(df: DataFrame, key: str, out: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(out))


def identifier_breadth(crosswalk: DataFrame) -> DataFrame:
    """(n_types, stars): how many stars carry how many kinds of identifier."""
    kinds = crosswalk.filter(F.col("star_id").isNotNull()).select("star_id", "id_type").distinct()
    return (kinds.groupBy("star_id").agg(F.count(F.lit(1)).alias("n_types"))
            .groupBy("n_types").agg(F.count(F.lit(1)).alias("stars")))
