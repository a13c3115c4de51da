"""The model catalogue: matching names, listings, candidates, readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

c = F.col

_SCHEMA = "ord int, key string, display_name string, priority int, ollama_tag string, ollama_gb double, hf_repo string, quant string, llamacpp_gb double, default_install boolean"
#: The models that are known, best first.
MODELS = [
    (1, "qwen3-vl", "Qwen3-VL", 1, "", 0.0, "Qwen/Qwen3-VL-8B-Instruct-GGUF", "Q4_K_M", 6.5, False),
    (2, "qwen2.5-vl", "Qwen2.5-VL 3B", 2, "qwen2.5vl:3b", 3.2, "ggml-org/Qwen2.5-VL-3B-Instruct-GGUF", "Q4_K_M", 3.0, True),
    (3, "minicpm-v", "MiniCPM-V", 3, "minicpm-v:latest", 5.5, "openbmb/MiniCPM-V-2_6-gguf", "Q4_K_M", 5.5, False),
    (4, "moondream", "moondream2", 4, "moondream:latest", 1.7, "ggml-org/moondream2-20250414-GGUF", "text-model-f16", 1.9, False),
    (5, "llava", "LLaVA", 5, "llava:7b", 4.7, "ggml-org/llava-1.6-mistral-7b-gguf", "Q4_K_M", 4.4, False),
    (6, "smolvlm-500m", "SmolVLM 500M (ultra-light)", 9, "", 0.0, "ggml-org/SmolVLM-500M-Instruct-GGUF", "Q8_0", 0.6, False),
]
UNKNOWN_PRIORITY = 500
#: What is said of each model that is known, and of others.
RECOMMENDATIONS = {
    "qwen3-vl": "Newest and strongest vision model for this app: excellent icon understanding with clean short labels.",
    "qwen2.5-vl": "Lightweight, reliable balance of icon understanding, stable short labels, and local speed.",
    "minicpm-v": "Great backup when you want a second opinion on hand-drawn marks and ambiguous symbols.",
    "moondream": "Fastest lightweight option for quick local naming passes.",
    "llava": "General fallback vision model when the preferred local icon models are unavailable.",
    "smolvlm-500m": "Tiny footprint for constrained machines or a fast smoke test; lower accuracy on ambiguous marks.",
}
UNKNOWN_RECOMMENDATION = "Available locally, but not one of the app's primary icon-focused recommendations."


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODELS, _SCHEMA)


def recommendation(key: Column) -> Column:
    """What is said of a model of the catalogue, by its key; a null key is that of an unknown one."""
    known = F.create_map(*[F.lit(v) for pair in RECOMMENDATIONS.items() for v in pair])
    return F.coalesce(F.try_element_at(known, key), F.lit(UNKNOWN_RECOMMENDATION))


def normal_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "")


def aliases(models: DataFrame) -> DataFrame:
    """ord, key, priority, alias: key, key without hyphens and tag family, in normal form, none empty."""
    names = F.array(c("key"), F.replace(c("key"), F.lit("-"), F.lit("")), F.get(F.split("ollama_tag", ":"), F.lit(0)))
    rows = models.select("ord", "key", "priority", F.explode(names).alias("alias"))
    return rows.withColumn("alias", normal_name(c("alias"))).where("alias <> ''").distinct()


def match_catalogue(names: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """Adds key, priority, vision, recommendation: the first entry (least ord) with an alias within the name; else null, 500, false and
    what is said of unknown ones.

    The aliases are a dimension of a few rows, folded into one array, so each name is matched where it
    lies and no row is multiplied.
    """
    folded = known.agg(F.array_sort(F.collect_list(F.struct("ord", "key", "priority", "alias"))).alias("_known"))
    hit = F.get(F.filter("_known", lambda k: F.contains(normal_name(c(name)), k["alias"])), F.lit(0))
    out = names.crossJoin(F.broadcast(folded)).withColumn("_hit", hit)
    return out.withColumns({"key": c("_hit.key"), "priority": F.coalesce("_hit.priority", F.lit(UNKNOWN_PRIORITY)), "vision": c("_hit").isNotNull(), "recommendation": recommendation(c("_hit.key"))}).drop("_known", "_hit")


def best_model(models: DataFrame, keys: list[str], name: str, ties: str) -> DataFrame:
    """The best name of each key: vision models before others, then priority, then lower-case name."""
    order = F.struct(~c("vision"), c("priority"), F.lower(name), c(ties))
    return models.groupBy(*keys).agg(F.min_by(name, order).alias("best"))


def tag_family(tag: Column) -> Column:
    return F.get(F.split(tag, ":"), F.lit(0))


def present_tags(wanted: DataFrame, have: DataFrame, tag: str) -> DataFrame:
    """Rows whose tag, up to its colon, is that of some tag in ``have``; empty tags never are."""
    families = have.select(tag_family(c(tag)).alias("_family")).distinct()
    return wanted.where(c(tag) != "").join(families, tag_family(c(tag)) == c("_family"), "left_semi")


def first_of_key(matched: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return matched.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def startable(downloaded: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Downloaded rows and the cached ones whose key isn't among them; adds origin."""
    rest = cached.join(downloaded.select(key), key, "left_anti")
    return downloaded.withColumn("origin", F.lit("downloaded")).unionByName(rest.withColumn("origin", F.lit("cache")))


def candidates(models: DataFrame, ollama: Column, llamacpp: Column) -> DataFrame:
    """A row for each model and backend that can install it; the default model is chosen on the first backend that is up."""
    offer = lambda name, gb, up, chosen: F.when(up, F.struct(F.lit(name).alias("backend"), gb.alias("approx_gb"), (c("default_install") & chosen).alias("default_selected")))
    offers = F.filter(F.array(offer("ollama", c("ollama_gb"), ollama & (c("ollama_tag") != ""), ollama), offer("llamacpp", c("llamacpp_gb"), llamacpp, ~ollama)), lambda o: o.isNotNull())
    return models.withColumn("_offer", F.explode(offers)).select(*models.columns, "_offer.*")


def install_selection(rows: DataFrame, everything: bool) -> DataFrame:
    left = rows.where(~c("installed"))
    return left if everything else left.where("default_selected")


def candidate_label(display: Column, backend: Column, gb: Column, installed: Column) -> Column:
    size = F.when(gb > 0, F.concat(F.format_string("%.1f", F.bround(gb, 1)), F.lit(" GB"))).otherwise("small")
    where = F.when(backend == "ollama", "Ollama").otherwise("llama.cpp")
    return F.concat_ws(" · ", display, where, F.when(installed, F.lit("installed")).otherwise(F.concat(F.lit("~"), size, F.lit(" download"))))


def listing_names(lines: DataFrame, line: str, number: str) -> DataFrame:
    """Names of a text listing: its first line (the least ``number``, from 0) and blank lines skipped, first word, no cloud models."""
    name = F.get(F.split(F.trim(c(line)), r"\s+"), F.lit(0))
    return lines.withColumn("name", name).where((c(number) > 0) & (c("name") != "") & ~c("name").endswith(":cloud"))


def _entries(answer: Column, path: str) -> Column:
    """The list under a path of a JSON answer, as variants; null if there is none."""
    return F.try_variant_get(F.try_parse_json(answer), path, "array<variant>")


def served_models(payload: DataFrame, col: str) -> DataFrame:
    """Names of a server's JSON listing: id, or else model, of each object under data; those without are dropped, and a broken answer has none."""
    node = payload.select("*", F.explode(F.coalesce(_entries(c(col), "$.data"), F.array().cast("array<variant>"))).alias("_v"))
    text = lambda path: F.nullif(F.trim(F.try_variant_get("_v", path, "string")), F.lit(""))
    return node.withColumn("name", F.coalesce(text("$.id"), text("$.model"))).where("name is not null").drop("_v")


def loaded_model(answer: Column) -> Column:
    """struct<loaded, model, capabilities> of a server's JSON listing: whether it lists any, under models or, if that is empty, under data, and what
    the first of them is and says it can do (null if it has no such list)."""
    some = lambda path: F.when(F.size(_entries(answer, path)) > 0, _entries(answer, path))
    first = F.get(F.coalesce(some("$.models"), some("$.data")), F.lit(0))
    text = lambda path: F.nullif(F.try_variant_get(first, path, "string"), F.lit(""))
    return F.struct(first.isNotNull().alias("loaded"), F.coalesce(text("$.id"), text("$.name")).alias("model"), F.try_variant_get(first, "$.capabilities", "array<string>").alias("capabilities"))


def listed(names: DataFrame, known: DataFrame, *, served: bool = False) -> DataFrame:
    """Names with their catalogue entry, best first: by priority, then lower-case name. What a server has loaded counts as able to see."""
    out = match_catalogue(names, known, "name")
    return (out.withColumn("vision", F.lit(True)) if served else out).orderBy("priority", F.lower("name"), "name")


def installed_tags(payload: DataFrame, col: str) -> DataFrame:
    """Distinct tags of a server's JSON listing of what it has; a broken answer has none."""
    rows = F.explode(F.coalesce(F.try_variant_get(F.try_parse_json(col), "$.models", "array<variant>"), F.array().cast("array<variant>")))
    node = payload.select(rows.alias("_v"))
    return node.select(F.nullif(F.try_variant_get("_v", "$.name", "string"), F.lit("")).alias("tag")).where("tag is not null").distinct()


def cache_refs(lines: DataFrame, line: str) -> DataFrame:
    """Numbered lines of a cache listing: their second word."""
    return lines.withColumn("ref", F.regexp_extract(line, r"^\s*\d+\.\s+(\S+)\s*$", 1)).where("ref <> ''")


def weights_and_projector(files: DataFrame, repo: list[str], file: str, order: str, quant: Column) -> DataFrame:
    """Of each repository's .gguf files: the first projector, and the first weights with the quant, or else the
    shortest name; a repository that lacks one has null there."""
    gguf = files.where(F.lower(file).endswith(".gguf")).withColumn("_p", F.contains(F.lower(file), F.lit("mmproj")))
    fits = F.contains(F.lower(file), F.lower(quant))
    rank = F.when(fits, F.struct(F.lit(0), c(order).cast("long"), F.lit(""))).otherwise(F.struct(F.lit(1), F.length(file).cast("long"), F.lower(file)))
    return gguf.groupBy(*repo).agg(F.min_by(file, F.when(~c("_p"), rank)).alias("weights"), F.min_by(file, F.when(c("_p"), c(order))).alias("projector"))


def complete_pairs(files: DataFrame, keys: list[str], file: str) -> DataFrame:
    """Keys that have both a projector and weights among their .gguf files."""
    is_projector = F.contains(F.lower(file), F.lit("mmproj"))
    both = files.where(F.lower(file).endswith(".gguf")).groupBy(*keys).agg(F.bool_or(is_projector).alias("p"), F.bool_or(~is_projector).alias("w"))
    return both.where("p and w").select(*keys)


def preflight(provider: Column, local: Column, answer: Column, model: Column, known_vision: Column) -> Column:
    """Readiness of a provider: struct<ok, vision_capable, reason, model>.

    ``answer`` is what the provider's listing gave (null or broken if it can't be reached), ``model`` the one that is chosen, ``known_vision``
    whether the catalogue has that. A tag counts as pulled if one of its family (up to the colon) is.
    """
    row = lambda ok, vision, reason, name=F.lit(None): F.struct(F.lit(ok).alias("ok"), F.lit(vision).cast("boolean").alias("vision_capable"), F.lit(reason).alias("reason"), name.cast("string").alias("model"))
    reachable = F.coalesce(F.try_parse_json(answer).isNotNull(), F.lit(False))
    chosen = F.coalesce(model, F.lit(""))
    tags = F.transform(F.coalesce(_entries(answer, "$.models"), F.array().cast("array<variant>")), lambda v: F.coalesce(F.try_variant_get(v, "$.name", "string"), F.lit("")))
    pulled = F.exists(tags, lambda t: tag_family(t) == tag_family(chosen))
    ollama = F.when(~reachable, row(False, None, "not reachable")).when(chosen == "", row(False, None, "no model selected")).when(~pulled, row(False, None, "model not pulled", chosen))
    ollama = ollama.when(~known_vision, row(True, False, "not a known vision model", chosen)).otherwise(row(True, True, "ready", chosen))
    first = loaded_model(answer)
    name, skills = F.coalesce(first["model"], F.nullif(chosen, F.lit("")), F.lit("loaded model")), first["capabilities"]
    able = F.array_contains(skills, "multimodal") | F.array_contains(skills, "vision")
    llama = F.when(~reachable, row(False, None, "not reachable")).when(~first["loaded"], row(False, None, "no model loaded")).when(skills.isNull(), row(True, None, "ready", name))
    llama = llama.when(able, row(True, True, "ready", name)).otherwise(row(False, False, "not multimodal", name))
    return F.when(~provider.isin("ollama", "llamacpp"), row(True, None, "no model needed")).when(~local, row(False, None, "url not local")).when(provider == "ollama", ollama).otherwise(llama)


def advice(selected: Column, best: Column) -> Column:
    """struct<best, selected, same>: the best model and the one in use, with what the catalogue says of either (nulls where there is none)."""
    said = lambda m: F.when(m.isNotNull(), F.struct(m["name"].alias("name"), recommendation(m["key"]).alias("recommendation")))
    return F.struct(said(best).alias("best"), said(selected).alias("selected"), F.coalesce(selected["name"] == best["name"], F.lit(False)).alias("same"))


def choices(running: Column, startable: Column) -> Column:
    """Names that run, then those that could be started; each once, in that order."""
    return F.array_distinct(F.concat(running, startable))


def first_run_needed(models: DataFrame, keys: list[str]) -> DataFrame:
    """keys, needed: whether setup should be offered, that is if it isn't marked as done and no vision model is there."""
    return models.groupBy(*keys).agg((~F.coalesce(F.bool_or("vision"), F.lit(False)) & ~F.coalesce(F.bool_or("marked"), F.lit(False))).alias("needed"))
