"""From a split's manifest to the requests of its test prompts, copies of training code, and audits of what came back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import ascii_json, json_text, ones
from .validate import require_empty

#: The splits that a manifest may name, and the families of request bodies; any other family is a chat.
SPLITS = ("train", "validation", "test")
RESPONSES, MESSAGES, CONTENTS, COMPLETION = "openai_responses", "anthropic_messages", "gemini_generate_content", "openai_compatible_completion"
#: Lines around an instruction.
ABOVE, BELOW = "Instruction:", "Return only executable Python code."
#: Digests that a response repeats.
DIGESTS = ("request_sha256", "model_input_sha256", "prompt_record_sha256")


def manifest_faults(rows: DataFrame, manifest: DataFrame, key: str, group: str) -> DataFrame:
    """(key, fault) where rows(key, group) and manifest(key, split, group, pos) don't fit; an empty frame means that they do.

    Faults: no key or no such split; a key listed twice; a row that isn't listed; a listed row that isn't there; another group than
    the row's, where the manifest states one; a group in several splits; a place outside the test split, a test row without one
    where others have one, or a place taken twice.
    """
    name = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    listed = manifest.select(name(key).alias(key), name(group).alias("stated"), F.col("split"), F.col("pos"))
    own = rows.select(F.col(key).cast("string").alias(key), F.col(group).cast("string").alias("own"), F.lit(True).alias("there"))
    odd = F.col(key).isNull() | ~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False))
    each = lambda df, fault: df.select(key, F.lit(fault).alias("fault"))
    both = own.join(listed.where(~odd).withColumn("listed", F.lit(True)), key, "full_outer")
    pairs = F.when(F.col("listed").isNull(), "not listed").when(F.col("there").isNull(), "not a row").when(F.col("stated") != F.col("own"), "other group")
    parted = both.where("there and listed").groupBy(F.col("own").alias(key)).agg(F.count_distinct("split").alias("n")).where("n > 1")
    test = listed.where(F.col("split") == "test")
    ordered = listed.where("pos is not null").select(F.lit(True).alias("ordered")).limit(1)
    lacking = test.where("pos is null").join(F.broadcast(ordered), F.lit(True), "left_semi")
    out = each(listed.where(odd), "no such split").unionByName(each(listed.where(~odd).groupBy(key).agg(F.count("*").alias("n")).where("n > 1"), "listed twice"))
    out = out.unionByName(both.select(key, pairs.alias("fault")).where("fault is not null")).unionByName(each(parted, "group in several splits"))
    out = out.unionByName(each(listed.where("pos is not null and split <> 'test'"), "place outside test")).unionByName(each(lacking, "no place"))
    return out.unionByName(each(test.where("pos is not null").groupBy("pos").agg(F.min(key).alias(key), F.count("*").alias("n")).where("n > 1"), "place taken twice"))


def split_by_manifest(rows: DataFrame, manifest: DataFrame, key: str, group: str) -> DataFrame:
    """Rows with the split and the place (pos, null but for test rows) that a manifest gives them. Raises with examples on faults."""
    require_empty(manifest_faults(rows, manifest, key, group), "rows and manifest differ")
    return rows.join(manifest.select(F.col(key), "split", "pos"), key)


def prompt_records(test: DataFrame, system: str, prefix: str) -> DataFrame:
    """Prompts of test(row_id, label, instruction, pos): numbered from 1 by place; the text to complete, and canonical JSON of what a
    model is shown and of the whole record, with their digests."""
    lines = F.concat_ws("\n", F.lit(system), F.lit(""), F.lit(ABOVE), F.regexp_replace("instruction", r"\A\s+|\s+\z", ""), F.lit(""), F.lit(BELOW))
    say = lambda role, text: F.struct(text.alias("content"), F.lit(role).alias("role"))
    out = test.withColumns({"prompt_id": F.format_string(f"{prefix}_%04d", F.col("pos") + 1), "prompt": lines, "system": F.lit(system), "messages": F.array(say("system", F.lit(system)), say("user", F.col("instruction")))})
    shown = ascii_json(F.struct("messages", "prompt", "prompt_id", "row_id"))
    record = ascii_json(F.struct("instruction", "label", "messages", "prompt", "prompt_id", "row_id", F.lit("test").alias("split")))
    return out.withColumns({"model_input": shown, "model_input_sha256": F.sha2(shown, 256), "prompt_record_sha256": F.sha2(record, 256)})


def request_body(temperature: float, top_p: float, max_tokens: int, effort: str | None = None, seed: int | None = None) -> Column:
    """Canonical JSON of the body for a row with the columns of prompt_records() and model, family, sampling (whether it takes controls)."""
    model, system, user = F.col("model").alias("model"), F.col("system"), F.col("instruction")
    warm, cut, most = F.lit(float(temperature)), F.lit(float(top_p)), F.lit(max_tokens)
    part = lambda text: F.array(F.struct(text.alias("text")))
    if_ = lambda c: F.when(F.col("sampling"), c)  # noqa: E731  a null field is left out
    optional = [] if effort is None else [F.struct(F.lit(effort).alias("effort")).alias("output_config")]
    seeded = [] if seed is None else [F.lit(seed).alias("seed")]
    bodies = {
        RESPONSES: F.struct(F.col("messages").alias("input"), most.alias("max_output_tokens"), model),
        MESSAGES: F.struct(most.alias("max_tokens"), F.array(F.struct(user.alias("content"), F.lit("user").alias("role"))).alias("messages"), model, *optional, system.alias("system"), if_(warm).alias("temperature"), if_(cut).alias("top_p")),
        CONTENTS: F.struct(
            F.array(F.struct(part(user).alias("parts"), F.lit("user").alias("role"))).alias("contents"), F.struct(most.alias("max_output_tokens"), warm.alias("temperature"), cut.alias("top_p")).alias("generation_config"),
            model, F.struct(part(system).alias("parts")).alias("system_instruction"),
        ),
        COMPLETION: F.struct(most.alias("max_tokens"), model, F.col("prompt").alias("prompt"), warm.alias("temperature"), cut.alias("top_p")),
    }
    chat = F.struct(most.alias("max_tokens"), F.col("messages").alias("messages"), model, *seeded, warm.alias("temperature"), cut.alias("top_p"))
    out = F
    for family, body in bodies.items():
        out = out.when(F.col("family") == family, ascii_json(body))
    return out.otherwise(ascii_json(chat))


def model_requests(prompts: DataFrame, targets: DataFrame, **settings) -> DataFrame:
    """A request for each prompt of prompt_records() and each of targets(provider, model, family, sampling), a few rows: body and the
    digest of provider, model, family and body beside those of the prompt."""
    both = prompts.crossJoin(F.broadcast(targets)).withColumn("body", request_body(**settings))
    whole = F.concat(F.lit('{"api_model_id":'), json_text(F.col("model")), F.lit(',"body":'), F.col("body"), F.lit(',"provider":'), json_text(F.col("provider")), F.lit(',"request_family":'), json_text(F.col("family")), F.lit("}"))
    return both.withColumn("request_sha256", F.sha2(whole, 256))


def audit_runs(requests: DataFrame, responses: DataFrame, evaluated: DataFrame, expected: int) -> DataFrame:
    """Of each model: how its requests(model, prompt_id, digests) were answered by responses(model, prompt_id, at, finish, resolved, digests).

    Every response is counted for repeats and held to its request's digests (mismatches counts wrong digests; a response to no
    request is one); of a prompt's responses the last counts for finishes and resolved models. evaluated(model, rows) says how many
    were evaluated. A run is complete if requests, answered prompts and evaluated rows are as many as expected and nothing is
    missing, repeated, an error or different; else it is pending.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    want = requests.select("model", "prompt_id", F.lit(True).alias("asked"), *[text(d).alias(f"w_{d}") for d in DIGESTS])
    wrong = sum(((text(d) != F.col(f"w_{d}")).cast("long") for d in DIGESTS), F.lit(0))
    said = responses.join(want, ["model", "prompt_id"], "left").withColumn("wrong", F.when(F.col("asked"), wrong).otherwise(1))
    last = said.groupBy("model", "prompt_id").agg(F.count("*").alias("n"), F.sum("wrong").alias("wrong"), F.first("asked").alias("asked"), F.max_by(F.struct("finish", "resolved"), "at").alias("last"))
    each = last.select("model", "n", "wrong", "asked", F.coalesce(F.nullif(F.col("last.finish"), F.lit("")), F.lit("<missing>")).alias("finish"), F.nullif(F.col("last.resolved"), F.lit("")).alias("resolved"))
    sums = each.groupBy("model").agg(
        F.sum("n").alias("response_rows"), F.count("*").alias("answered"), F.sum(F.col("n") - 1).alias("repeats"), F.sum("wrong").alias("mismatches"), ones(F.lower("finish") == "error").alias("errors"),
        ones(F.col("asked")).alias("known"), F.array_join(F.array_sort(F.collect_set("resolved")), ",").alias("resolved"),
    )
    finishes = each.groupBy("model", "finish").agg(F.count("*").alias("n")).groupBy("model").agg(F.array_sort(F.collect_list(F.struct("finish", "n"))).alias("f"))
    finishes = finishes.select("model", F.array_join(F.transform("f", lambda x: F.concat_ws(":", x["finish"], x["n"])), ",").alias("finishes"))
    out = requests.groupBy("model").agg(F.count("*").alias("request_rows"), F.count_distinct("prompt_id").alias("asked"))
    out = out.join(sums, "model", "left").join(finishes, "model", "left").join(evaluated.withColumnRenamed("rows", "evaluated"), "model", "left")
    out = out.na.fill(0, ["response_rows", "answered", "repeats", "mismatches", "errors", "known", "evaluated"]).na.fill("", ["resolved", "finishes"])
    out = out.withColumn("missing", F.col("asked") - F.col("known"))
    whole = (F.col("request_rows") == expected) & (F.col("answered") == expected) & (F.col("evaluated") == expected) & (F.col("repeats") + F.col("mismatches") + F.col("errors") + F.col("missing") == 0)
    return out.withColumn("status", F.when(whole, "complete").otherwise("pending")).drop("asked", "known")


def majority_code(train: DataFrame, code: str, key: str) -> DataFrame:
    """One row (key, code, copies): the training row of least key among those of the most frequent code; ties go to the code that
    sorts first. Codes are counted by their digests, so texts don't travel."""
    counts = train.where(F.col(code).isNotNull()).groupBy(F.sha2(code, 256).alias("digest")).agg(F.count("*").alias("copies"), F.min(key).alias(key))
    most = counts.agg(F.max("copies").alias("copies"))
    tied = counts.join(F.broadcast(most), "copies").select(key, "copies")
    return tied.join(train.select(key, code), key).agg(F.min_by(F.struct(key, code, "copies"), F.struct(code, key)).alias("x")).where("x is not null").select("x.*")


def copied(test: DataFrame, code: str, majority: DataFrame) -> DataFrame:
    """Test rows with the code that the majority generator gives for all of them, and whether it is theirs."""
    said = majority.select(F.col(code).alias("said"))
    return test.crossJoin(F.broadcast(said)).withColumn("exact", F.col("said").eqNullSafe(F.col(code)))
