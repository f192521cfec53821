"""One surviving record for each group of duplicates, its fields judged by a latent two-sided quality model.

Each source has a sensitivity (it states a value that is true) and a specificity (it does not state one that is false).
Both, and the chance that each claimed value is true, are inferred by expectation-maximisation over all claims. Claims
with the same votes share one weighted pattern, so a round costs the patterns, not the records.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.ids import base_id, version
from quillspark.storage import dropped, written

#: Stand-ins for "no value", compared trimmed and in lower case.
STAND_INS = ("", "-", "--", "n/a", "na", "none", "null", "nil", "nan", "unknown", "undefined", "tbd", "?", "??")


@dataclass(frozen=True)
class SurvivorColumns:
    raw_id: str = "raw_id"
    rec_id: str = "rec_id"
    source: str = "origin"
    fetched_at: str = "fetched_at"
    single: tuple[str, ...] = ("title", "abstract", "license", "doi", "updated_at")
    multi: tuple[str, ...] = ("authors",)


def _told(x: Column) -> Column:
    bare = F.lower(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.when(x.isNotNull() & ~bare.isin(*STAND_INS), x)


def filled(df: DataFrame, columns: tuple[str, ...]) -> dict[str, Column]:
    """Each column, null where it is not filled: blank texts, stand-ins, and lists of nothing else."""
    kinds = dict(df.dtypes)
    out = {}
    for c in columns:
        if kinds[c] == "string":
            out[c] = _told(F.col(c))
        elif kinds[c].startswith("array"):
            kept = F.filter(F.col(c), lambda x: _told(x).isNotNull())
            out[c] = F.when(F.size(kept) > 0, kept)
        else:
            out[c] = F.col(c)
    return out


def _normal(x: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(x.cast("string"), r"(?U)\s+", " "), "^ | $", ""))


def judged_claims(records: DataFrame, rounds: int = 20, prior: float = 0.5, tolerance: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """(claims, sources). records: base, source, field, value (array of strings, null where not filled).

    claims: base, field, normal (normalised value), truth, votes. sources: source, sensitivity, specificity. A record
    of the group whose field is filled votes for its own values and against every other value claimed there; a
    record without the field does not vote. Counts are smoothed by two imagined votes each, so no rate is 0 or 1. Rounds
    end when no rate moves by more than `tolerance`, at the latest after `rounds`.

    That all sources of a field were silent on a value is one sum for the field, which each value corrects for those that said it.
    So a round costs the votes cast, not values times sources, and of alike votes only one pattern.
    """
    voices = records.where(F.col("value").isNotNull()).groupBy("base", "field", "source").agg(F.count("*").alias("voices"))
    said = (
        records.select("base", "field", "source", F.explode(F.array_distinct(F.transform("value", _normal))).alias("normal"))
        .groupBy("base", "field", "normal", "source").agg(F.count("*").alias("yes"))
    )
    listed = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    fields = voices.groupBy("base", "field").agg(listed("source", "voices").alias("heard")).withColumn("field_id", F.sha2(F.to_json("heard"), 256))
    fields = written(fields, "fields")
    claims = said.groupBy("base", "field", "normal").agg(F.sum("yes").alias("votes"), listed("source", "yes").alias("said"))
    claims = claims.join(fields.select("base", "field", "field_id"), ["base", "field"]).withColumn("pattern_id", F.sha2(F.concat("field_id", F.to_json("said")), 256))
    claims = written(claims, "claims")
    heard = written(fields.groupBy("field_id").agg(F.first("heard").alias("heard")).select("field_id", F.explode("heard").alias("v")).select("field_id", "v.*"), "heard")
    patterned = claims.groupBy("pattern_id", "field_id").agg(F.count("*").alias("weight"), F.first("said").alias("said"))
    patterned = written(patterned, "patterns")
    patterns, spoken = patterned.select("pattern_id", "field_id", "weight"), patterned.select("pattern_id", "weight", F.explode("said").alias("v")).select("pattern_id", "weight", "v.*")
    sources = heard.select("source").distinct().select("source", F.lit(0.8).alias("sensitivity"), F.lit(0.8).alias("specificity"))
    logit = F.log(F.lit(prior / (1 - prior)))
    against = F.log((1 - F.col("sensitivity")) / F.col("specificity"))

    def truths(by: DataFrame) -> DataFrame:
        silent = heard.join(by, "source").groupBy("field_id").agg(F.sum(F.col("voices") * against).alias("silent"))
        more = spoken.join(by, "source").groupBy("pattern_id").agg(F.sum(F.col("yes") * (F.log(F.col("sensitivity") / (1 - F.col("specificity"))) - against)).alias("more"))
        odds = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("silent") + F.col("more") + logit))
        return patterns.join(silent, "field_id").join(more, "pattern_id").select("pattern_id", "field_id", "weight", (1 / (1 + F.exp(-odds))).alias("truth"))

    for _ in range(rounds):
        judged = written(truths(sources), "truths")
        by_field = judged.groupBy("field_id").agg(F.sum(F.col("weight") * F.col("truth")).alias("true"), F.sum(F.col("weight") * (1 - F.col("truth"))).alias("false"))
        chances = heard.join(by_field, "field_id").groupBy("source").agg(F.sum(F.col("voices") * F.col("true")).alias("true"), F.sum(F.col("voices") * F.col("false")).alias("false"))
        taken = spoken.join(judged.select("pattern_id", "truth"), "pattern_id").groupBy("source").agg(F.sum(F.col("weight") * F.col("yes") * F.col("truth")).alias("right"), F.sum(F.col("weight") * F.col("yes") * (1 - F.col("truth"))).alias("wrong"))
        rates = chances.join(taken, "source", "left").na.fill(0.0, ["right", "wrong"])
        rates = rates.select("source", ((F.col("right") + 1.6) / (F.col("true") + 2)).alias("sensitivity"), ((F.col("false") - F.col("wrong") + 1.6) / (F.col("false") + 2)).alias("specificity"))
        before, sources = sources, written(rates, "sources")
        was = before.select("source", F.col("sensitivity").alias("a"), F.col("specificity").alias("b"))
        moved = sources.join(was, "source").agg(F.max(F.greatest(F.abs(F.col("sensitivity") - F.col("a")), F.abs(F.col("specificity") - F.col("b"))))).first()[0]
        dropped(judged)
        if hasattr(before, "_written_at"):
            dropped(before)
        if moved is None or moved <= tolerance:
            break
    judged = claims.join(truths(sources).select("pattern_id", "truth"), "pattern_id").select("base", "field", "normal", "truth", "votes")
    return judged, sources


def survivors(df: DataFrame, how: SurvivorColumns = SurvivorColumns(), rounds: int = 20, truth: float = 0.5) -> DataFrame:
    """One row for each paper id with two or more records.

    base_id; the surviving record's id (highest version, none lowest; then most fields filled; then latest fetched; then
    lowest id); version; versions_seen; n_records; and each field: the survivor's own value where filled, else the value
    judged likeliest true (ties: most votes, then the smallest). A multi-valued field holds the survivor's values, then
    every other value whose chance of being true is above `truth`, in order of text. Ids that name no paper are left
    out, repeated rows of a record id count once (the row first in the order above), empty tables give no rows.
    """
    fields = how.single + how.multi
    kinds = dict(df.dtypes)
    full = filled(df, fields)
    rows = df.select(
        base_id(F.col(how.raw_id)).alias("base"), version(F.col(how.raw_id)).alias("version"), F.col(how.rec_id).alias("rec"), F.col(how.source).cast("string").alias("source"),
        F.col(how.fetched_at).alias("fetched"), *[full[c].alias(f"f_{c}") for c in fields],
    ).where(F.col("base").isNotNull() & F.col("rec").isNotNull()).withColumn("n_filled", sum((F.col(f"f_{c}").isNotNull().cast("int") for c in fields), F.lit(0)))
    #: Order of preference as a struct whose maximum wins; nulls are smallest there.
    rank = F.struct("version", "n_filled", "fetched", (-F.col("rec")).alias("low"))
    rows = rows.groupBy("base", "rec").agg(F.max_by(F.struct("version", "source", "fetched", "n_filled", *[f"f_{c}" for c in fields]), rank).alias("r")).select("base", "rec", "r.*")
    rows = written(rows, "records")
    groups = rows.groupBy("base").agg(F.count("*").alias("n_records"), F.sort_array(F.collect_set("version")).alias("versions_seen"), F.max_by(F.struct("rec", "version", *[f"f_{c}" for c in fields]), rank).alias("best")).where("n_records > 1")
    groups = written(groups, "survivors")
    several = rows.join(groups.select("base"), "base", "left_semi")
    listed = lambda c: F.col(f"f_{c}") if c in how.multi else F.when(F.col(f"f_{c}").isNotNull(), F.array(F.col(f"f_{c}").cast("string")))
    claims = several.select("base", F.coalesce("source", F.lit("")).alias("source"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), listed(c).alias("value")) for c in fields])).alias("c")).select("base", "source", "c.*")
    judged, _ = judged_claims(claims, rounds)
    spelled = claims.select("base", "field", F.explode("value").alias("value")).groupBy("base", "field", _normal(F.col("value")).alias("normal")).agg(F.min("value").alias("value"))
    known = judged.join(spelled, ["base", "field", "normal"])
    # A minimum of structs, combined before the shuffle: a paper that holds a third of the claims is no hot group.
    order = F.struct((-F.col("truth")).alias("t"), (-F.col("votes")).alias("n"), "value")
    likeliest = known.where(F.col("field").isin(*how.single)).groupBy("base").agg(*[F.min(F.when(F.col("field") == c, order))["value"].alias(f"t_{c}") for c in how.single])
    true_lists = known.where(F.col("field").isin(*how.multi) & (F.col("truth") > truth)).groupBy("base").agg(*[F.array_sort(F.collect_set(F.when(F.col("field") == c, F.col("value")))).alias(f"t_{c}") for c in how.multi])
    joined = groups.join(likeliest, "base", "left").join(true_lists, "base", "left")
    out = [F.coalesce(F.col(f"best.f_{c}"), F.col(f"t_{c}").cast(kinds[c])).alias(c) for c in how.single]
    for c in how.multi:
        own, more = F.coalesce(F.col(f"best.f_{c}"), F.array().cast(kinds[c])), F.coalesce(F.col(f"t_{c}"), F.array().cast(kinds[c]))
        out.append(F.concat(own, F.filter(more, lambda x: ~F.exists(own, lambda y: _normal(x) == _normal(y)))).alias(c))
    return joined.select(F.col("base").alias("base_id"), F.col("best.rec").alias(how.rec_id), F.col("best.version").alias("version"), "versions_seen", "n_records", *out)
