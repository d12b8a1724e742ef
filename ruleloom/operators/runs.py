"""Requests to a verifier, their repeats and capacity; results, findings and what repeated runs add."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleloom import schema
from ruleloom.functions import text as T

#: What a finding looks like to schema_of_variant: exactly the four fields with their types.
_SHAPE = "OBJECT<context_resolution: STRING, rule_ids: ARRAY<STRING>, unsat_reason: STRING, witness: STRING>"
EFFORTS = ["low", "medium", "high", "xhigh", "max"]
#: Where none is asked for, of a model that takes one.
DEFAULT_EFFORT = "xhigh"
HEADROOM = 2048


def custom_id(authority: Column, key: Column) -> Column:
    return F.concat(authority, F.lit("-"), F.regexp_replace(key, "[^A-Za-z0-9_-]", "-"))


def request_problems(requests: DataFrame) -> DataFrame:
    """custom_id, problem: repeated ids, ids longer than 64 characters or with other characters."""
    n = requests.groupBy("custom_id").agg(F.count("*").alias("n"))
    problem = F.when(F.col("n") > 1, "repeated").when(F.length("custom_id") > 64, "too long").when(~F.col("custom_id").rlike("^[A-Za-z0-9_-]+$"), "unsafe")
    return n.withColumn("problem", problem).where("problem is not null").select("custom_id", "problem")


def repeated(requests: DataFrame, count: int = 5, start: int = 1) -> DataFrame:
    """Every request `count` times with pass and an id that ends in -pass-NNN."""
    df = requests.withColumn("pass", F.explode(F.sequence(F.lit(start), F.lit(start + count - 1))))
    return df.withColumn("custom_id", F.format_string("%s-pass-%03d", "custom_id", "pass"))


def with_suffix(prompt: Column, suffix: str) -> Column:
    """Prompts with a saved suffix; one with placeholders is refused."""
    if "$" in suffix:
        raise ValueError("a suffix holds no placeholders")
    return F.concat(prompt, F.lit("\n\n"), F.lit(suffix)) if suffix else prompt


def effort(value: Column) -> Column:
    return F.when(value.isin(*EFFORTS), value)


def only(requests: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The requests of the keys (group_key), and keys that no request has."""
    return requests.join(keys, "group_key", "left_semi"), keys.join(requests, "group_key", "left_anti")


def capacity(requests: DataFrame, limits: DataFrame, fallback: DataFrame) -> DataFrame:
    """requests (custom_id, model, input_tokens, output_tokens) with headroom, remaining and fits.

    Limits (model, context, most_output) come from the service, else from the fallback table; a model in neither doesn't fit."""
    known = fallback.select("model", F.col("context").alias("c"), F.col("most_output").alias("o")).join(limits, "model", "full").select("model", F.coalesce("context", "c").alias("context"), F.coalesce("most_output", "o").alias("most_output"))
    headroom = F.greatest(F.lit(HEADROOM).cast("long"), F.floor((F.col("input_tokens") + 99) / 100))
    df = requests.join(known, "model", "left").withColumn("headroom", headroom)
    df = df.withColumn("remaining", F.col("context") - F.col("input_tokens") - F.col("output_tokens") - F.col("headroom"))
    fits = (F.col("output_tokens") > 0) & (F.col("output_tokens") <= F.col("most_output")) & (F.col("remaining") >= 0)
    return df.withColumn("fits", F.coalesce(fits, F.lit(False)))


def distinct_payloads(requests: DataFrame, payload: str = "params") -> DataFrame:
    """digest, payload, requests: equal payloads are counted once."""
    return requests.groupBy(F.sha2(F.to_json(F.col(payload)), 256).alias("digest")).agg(F.first(payload).alias(payload), F.array_sort(F.collect_list("custom_id")).alias("requests"))


def message_text(result: Column) -> Column:
    return F.array_join(F.transform(F.filter(result["message"]["content"], lambda b: b["type"] == "text"), lambda b: b["text"]), "")


def parsed(text: Column, allowed: Column) -> dict[str, Column]:
    """findings, error and repaired of model output: an array of findings with exactly the four fields, two different known
    rules and no blank text. Commas before a closing bracket are repaired and counted only if the text isn't JSON as it is."""
    fixed = T.without_trailing_commas(text)
    plain = F.try_parse_json(text)
    value = F.coalesce(plain, F.try_parse_json(fixed))
    is_list = F.schema_of_variant(value).startswith("ARRAY")
    items = F.try_variant_get(value, "$", "array<variant>")
    findings = F.from_json(F.when(plain.isNotNull(), text).otherwise(fixed), schema.FINDING)
    shaped = F.forall(items, lambda x: F.coalesce(F.schema_of_variant(x) == _SHAPE, F.lit(False)))
    ends = F.forall(findings, lambda f: F.coalesce((F.size(f["rule_ids"]) == 2) & (F.size(F.array_distinct(f["rule_ids"])) == 2) & (F.size(F.array_except(f["rule_ids"], allowed)) == 0), F.lit(False)))
    full = F.forall(findings, lambda f: F.coalesce((T.strip(f["witness"]) != "") & (T.strip(f["unsat_reason"]) != "") & (T.strip(f["context_resolution"]) != ""), F.lit(False)))
    error = (
        F.when(value.isNull(), "not a complete JSON array").when(~F.coalesce(is_list, F.lit(False)), "not an array")
        .when(~F.coalesce(shaped, F.lit(False)), "not exactly the four fields").when(~F.coalesce(ends, F.lit(False)), "not two different rules of the group").when(~F.coalesce(full, F.lit(False)), "an empty text")
    )
    return {"findings": F.when(error.isNull(), findings), "error": error, "repaired": F.when(plain.isNull() & value.isNotNull(), T.removed_commas(text)).otherwise(F.lit(0).cast("long"))}


def outcomes(groups: DataFrame, raw: DataFrame) -> DataFrame:
    """custom_id, status, error, findings, repaired for every expected request (custom_id, rule_ids); a missing result failed."""
    df = groups.join(raw, "custom_id", "left")
    kind, stop = F.col("result.type"), F.col("result.message.stop_reason")
    got = parsed(message_text(F.col("result")), F.col("rule_ids"))
    error = F.when(F.col("result").isNull(), "missing").when(kind != "succeeded", kind).when(~F.coalesce(stop == "end_turn", F.lit(False)), F.concat(F.lit("not finished: "), F.coalesce(stop, F.lit("none")))).otherwise(got["error"])
    df = df.withColumn("error", error).withColumn("status", F.when(F.col("error").isNull(), "succeeded").otherwise("failed"))
    return df.withColumn("findings", F.when(F.col("error").isNull(), got["findings"])).withColumn("repaired", F.when(F.col("error").isNull(), got["repaired"]).otherwise(F.lit(0).cast("long"))).drop("result")


def unexpected(groups: DataFrame, raw: DataFrame) -> DataFrame:
    """custom_id, problem: results of no request, and several of one."""
    n = raw.groupBy("custom_id").agg(F.count("*").alias("n")).join(groups.select("custom_id", F.lit(True).alias("k")), "custom_id", "left")
    return n.withColumn("problem", F.when(F.col("k").isNull(), "unexpected").when(F.col("n") > 1, "repeated")).where("problem is not null").select("custom_id", "problem")


def finding_key(finding: Column) -> Column:
    """What makes two findings the same: the pair in order and the texts with single spaces."""
    one = lambda c: F.regexp_replace(T.strip(c), r"(?U)\s+", " ")
    return F.struct(F.array_sort(finding["rule_ids"]).alias("pair"), one(finding["witness"]).alias("witness"), one(finding["unsat_reason"]).alias("unsat_reason"), one(finding["context_resolution"]).alias("context_resolution"))


def new_by_pass(found: DataFrame) -> DataFrame:
    """group_key, pass, returned, new_pairs, new_variants of findings (group_key, pass, pair, variant): first seen in that pass."""
    seen = found.withColumn("fp", F.min("pass").over(Window.partitionBy("group_key", "pair"))).withColumn("fv", F.min("pass").over(Window.partitionBy("group_key", "pair", "variant")))
    new = lambda first, what: F.countDistinct(F.when(F.col(first) == F.col("pass"), F.struct(*what)))
    return seen.groupBy("group_key", "pass").agg(F.count("*").alias("returned"), new("fp", ["pair"]).alias("new_pairs"), new("fv", ["pair", "variant"]).alias("new_variants"))


def run_totals(results: DataFrame, found: DataFrame) -> DataFrame:
    """One row: attempted, succeeded, failed, pairs, variants; pairs are summed over groups, so one in two groups counts twice."""
    runs = results.agg(F.count("*").alias("attempted"), F.count_if(F.col("status") == "succeeded").alias("succeeded"), F.count_if(F.col("status") != "succeeded").alias("failed"))
    sums = found.groupBy("group_key").agg(F.countDistinct("pair").alias("p"), F.countDistinct(F.struct("pair", "variant")).alias("v")).agg(F.coalesce(F.sum("p"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("v"), F.lit(0)).alias("variants"))
    return runs.crossJoin(sums)


def incomplete_groups(results: DataFrame, count: int = 5) -> DataFrame:
    """group_key, passes: groups whose passes aren't exactly 1..count."""
    df = results.groupBy("group_key").agg(F.array_sort(F.collect_list("pass")).alias("passes"))
    return df.where(F.col("passes") != F.sequence(F.lit(1), F.lit(count)))
