"""Facts from JSON payloads, rule suggestions and a cache-first entity lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from ..sources.tables import scratch, staged

SUGGESTION = "struct<value:string,reasoning:string,based_on_facts:array<string>>"


def fact_keys(with_tradition: bool) -> tuple[str, ...]:
    return V.FACT_KEYS + (V.TRADITION_FACT_KEYS if with_tradition else ())


def _json(value: Column) -> Column:
    """A variant as JSON text: strings keep their quotes, so that false and "false" differ. JSON null is null."""
    return F.nullif(F.to_json(value), F.lit("null"))


def facts_of(v: Column, has: Column) -> Column:
    """Map of JSON values of a variant, null where missing; null for a null variant. The two tradition facts are there with `has`."""
    entry = lambda k: F.struct(F.lit(k).alias("key"), _json(F.try_variant_get(v, F.lit(f"$.{k}"), "variant")).alias("value"))
    plain, more = F.array(*map(entry, V.FACT_KEYS)), F.array(*map(entry, V.TRADITION_FACT_KEYS))
    return F.when(v.isNotNull(), F.map_from_entries(F.when(has, F.concat(plain, more)).otherwise(plain)))


def extract_facts(rows: DataFrame, key: str, payload: str, tradition: str | None = None) -> DataFrame:
    """key, facts (map of JSON values, null where missing), error. The two tradition facts are there when a tradition is."""
    has = F.coalesce(F.col(tradition) != "", F.lit(False)) if tradition else F.lit(False)
    parsed = rows.select(key, F.try_parse_json(F.col(payload)).alias("v"), has.alias("has"))
    return parsed.select(key, facts_of(F.col("v"), F.col("has")).alias("facts"), F.when(F.col("v").isNull(), "not valid JSON").alias("error"))


def extract_attributed_facts(payloads: DataFrame, results: DataFrame, key: str, payload: str, with_tradition: bool = False) -> DataFrame:
    """key, fact, value (JSON), url: one row for each expected fact. A fact without a value, or whose source isn't the
    whole number of a result (from 1), has a null value and url.

    results: key, idx, url.
    """
    v = payloads.select(key, F.try_parse_json(F.col(payload)).alias("v"))
    one = lambda k: F.struct(F.lit(k).alias("fact"), F.try_variant_get("v", F.lit(f"$.facts.{k}.value"), "variant").alias("value"), F.try_variant_get("v", F.lit(f"$.facts.{k}.source"), "variant").alias("source"))
    rows = v.select(key, F.explode(F.array(*map(one, fact_keys(with_tradition)))).alias("f")).select(key, "f.*")
    kind = F.schema_of_variant("source")
    index = F.when(kind == "BIGINT", F.try_variant_get("source", F.lit("$"), "bigint")).when(kind == "BOOLEAN", F.try_variant_get("source", F.lit("$"), "boolean").cast("bigint"))
    found = rows.select(key, "fact", _json(F.col("value")).alias("value"), index.alias("idx")).join(results.select(key, F.col("idx").cast("bigint").alias("idx"), "url"), [key, "idx"], "left")
    ok = F.col("value").isNotNull() & F.col("url").isNotNull()
    return found.select(key, "fact", F.when(ok, F.col("value")).alias("value"), F.when(ok, F.col("url")).alias("url"))


def pasted_provenance(facts: Column) -> Column:
    """Every fact with a value comes from the admin's text."""
    return F.transform_values(F.map_filter(facts, lambda _, v: v.isNotNull()), lambda _k, _v: F.lit("admin_text"))


def _truthy(json: Column) -> Column:
    """Python's truth of a JSON value; empty values, false, zero and null have none."""
    zero = F.coalesce(json.try_cast("double") == 0, F.lit(False))
    return json.isNotNull() & ~json.isin("false", '""', "[]", "{}") & ~zero


def _suggestion(value: str, reasoning: str, based_on: Column) -> Column:
    return F.struct(F.lit(value).alias("value"), F.lit(reasoning).alias("reasoning"), based_on.alias("based_on_facts"))


def _names(*names: str) -> Column:
    return F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")


def suggest_epistemic_basis(facts: Column) -> Column:
    lineage, engaged = F.try_element_at(facts, F.lit("practice_lineage")), F.try_element_at(facts, F.lit("tradition_engagement"))
    both = F.when(_truthy(engaged), _names("practice_lineage", "tradition_engagement")).otherwise(_names("practice_lineage"))
    return (
        F.when(engaged == "false", _suggestion("textual_study_only", V.REASON_NO_ENGAGEMENT, _names("tradition_engagement")))
        .when(_truthy(lineage), _suggestion("lived_practice", V.REASON_LINEAGE, both))
        .when(_truthy(engaged), _suggestion("mixed", V.REASON_ENGAGEMENT, _names("tradition_engagement")))
        .otherwise(_suggestion("unknown", V.REASON_NO_BASIS, _names()))
    )


def suggest_origin(facts: Column) -> Column:
    born = F.try_element_at(facts, F.lit("born_within_tradition_context"))
    return (
        F.when(born == "true", _suggestion("indigenous_born", V.REASON_BORN_INSIDE, _names("born_within_tradition_context")))
        .when(born == "false", _suggestion("foreign_born", V.REASON_BORN_OUTSIDE, _names("born_within_tradition_context")))
        .otherwise(_suggestion("unknown", V.REASON_NO_ORIGIN, _names()))
    )


def suggested_values(entity_type: Column, facts: Column, tradition: Column) -> Column:
    """Map of suggestions: none but for authors; an origin only with a tradition."""
    basis = F.struct(F.lit("author_epistemic_basis").alias("key"), suggest_epistemic_basis(facts).cast(SUGGESTION).alias("value"))
    origin = F.struct(F.lit("author_origin").alias("key"), suggest_origin(facts).cast(SUGGESTION).alias("value"))
    none = F.array().cast(f"array<struct<key:string,value:{SUGGESTION}>>")
    both = F.when(F.coalesce(tradition != "", F.lit(False)), F.array(basis, origin)).otherwise(F.array(basis))
    return F.map_from_entries(F.when(entity_type == "author", both).otherwise(none))


ENTITY = ("entity_type", "display_name", "normalized_key", "facts", "fact_provenance", "suggested_values")


def lookup_entities(requests: DataFrame, cache: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """request_id, cached and the ENTITY columns: for a hit the stored row as it is, whatever type or tradition is asked
    for; for the first request of each key that is not stored, a computed row.

    requests: request_id, entity_type, display_name, tradition, pasted (JSON of facts in an admin's text) and found (JSON of
    attributed facts in search results). A request with a pasted text uses that one. results: request_id, idx, url of the
    search results that attributed facts name. cache: the ENTITY columns, a row for each key. Columns of requests that are
    missing are null; stored columns that the cache doesn't have are the request's.

    Requests with their keys, and the first ones of new keys, are stored once for what reads them. No side of a join is
    broadcast: Spark takes its size from files, however many rows come out of them.
    """
    folder, asked = scratch(requests.sparkSession), ("entity_type", "tradition", "pasted", "found")
    requests = requests.select("request_id", "display_name", *[c if c in requests.columns else F.lit(None).cast("string").alias(c) for c in asked])
    keyed = staged(T.with_entity_key(requests), f"{folder}/requests")
    stored = cache.select(*[c for c in ENTITY if c in cache.columns]).hint("merge")
    own = ["request_id", "normalized_key", *[c for c in ("entity_type", "display_name") if c not in stored.columns]]
    hits = keyed.select(*own).join(stored, "normalized_key").withColumn("cached", F.lit(True))
    hits = hits.withColumns({c: F.lit(None).cast(kind) for c, kind in (("facts", "map<string,string>"), ("fact_provenance", "map<string,string>"), ("suggested_values", f"map<string,{SUGGESTION}>")) if c not in hits.columns}).select("request_id", "cached", *ENTITY)
    missed = keyed.join(stored.select("normalized_key"), "normalized_key", "left_anti")
    first = missed.groupBy("normalized_key").agg(F.min_by(F.struct(*missed.columns), "request_id").alias("r")).select("r.*")
    first = staged(first, f"{folder}/first")
    return hits.unionByName(new_entities(first, results).select("request_id", F.lit(False).alias("cached"), *ENTITY))


def new_entities(requests: DataFrame, results: DataFrame | None) -> DataFrame:
    """Adds facts, their provenance and suggestions to requests with a key; see lookup_entities()."""
    with_text = F.coalesce(F.col("pasted") != "", F.lit(False))
    parsed = requests.withColumn("v", F.when(with_text, F.try_parse_json("pasted")))
    out = parsed.withColumn("of_text", facts_of(F.col("v"), F.coalesce(F.col("tradition") != "", F.lit(False)))).drop("v")
    none = F.lit(None).cast("map<string,string>")
    if results is None:
        out = out.withColumn("of_search", none).withColumn("urls", none)
    else:
        asked = requests.where(~with_text)
        rows = extract_attributed_facts(asked, results.hint("merge"), "request_id", "found", True)
        pair = lambda c: F.map_from_entries(F.collect_list(F.struct("fact", c)))
        search = rows.groupBy("request_id").agg(pair("value").alias("of_search"), pair("url").alias("urls")).hint("merge")
        # without a tradition, the two facts that are about one are not asked for
        plain = lambda c: F.when(F.col("tradition") != "", F.col(c)).otherwise(F.map_filter(c, lambda k, _: k.isin(*V.FACT_KEYS)))
        out = out.join(search, "request_id", "left").withColumns({c: plain(c) for c in ("of_search", "urls")})
    out = out.withColumn("facts", F.coalesce("of_text", "of_search"))
    provenance = F.when(F.col("of_text").isNotNull(), pasted_provenance(F.col("facts"))).otherwise(F.map_filter("urls", lambda _, v: v.isNotNull()))
    out = out.withColumn("fact_provenance", provenance)
    return out.withColumn("suggested_values", suggested_values(F.col("entity_type"), F.col("facts"), F.col("tradition"))).drop("of_text", "of_search", "urls")


def search_results(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """key, idx (from 1), url, title, content, error; no results are one error row."""
    kind = "struct<results:array<struct<url:string,title:string,content:string>>>"
    parsed = rows.select(key, F.posexplode_outer(F.from_json(F.col(payload), kind)["results"]).alias("at", "r"))
    blank = lambda c: F.when(F.col("at").isNotNull(), F.coalesce(F.col(c), F.lit("")))
    return parsed.select(key, (F.col("at") + 1).alias("idx"), "r.url", blank("r.title").alias("title"), blank("r.content").alias("content"), F.when(F.col("at").isNull(), "no search results").alias("error"))


def excerpt_block(results: DataFrame, key: str) -> DataFrame:
    """key, excerpts: numbered results joined by blank lines."""
    one = F.concat(F.lit("[Result "), F.col("idx").cast("string"), F.lit("] URL: "), F.col("url"), F.lit("\n"), F.col("content"))
    rows = results.where("error is null").select(key, F.struct("idx", one.alias("text")).alias("r"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["text"]), "\n\n").alias("excerpts"))


def lookup_prompt(entity_type: Column, name: Column, tradition: Column, body: Column, heading: str = "Text") -> Column:
    lines = [F.concat(F.lit("Entity type: "), entity_type), F.concat(F.lit("Entity name: "), name), F.concat(F.lit("Tradition being classified: "), F.nullif(tradition, F.lit("")))]
    return F.concat_ws("\n", *lines, F.concat(F.lit(f"\n{heading}:\n"), body))
