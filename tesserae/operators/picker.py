"""Rule-scored choice of models: classes by pattern, points by rules, constrained argmax with fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (family, pattern on the lower-cased id, points) of each task.
CHAT_RULES = (
    ("meta-llama-3.3", r"^meta/llama-3\.3-", 30),
    ("meta-llama-3.1-70b-8b", r"^meta/llama-3\.1-(70b|8b)", 25),
    ("mistral-large-2", r"^mistralai/mistral-large-2", 28),
    ("mistral-7b", r"^mistralai/mistral-7b", 22),
    ("nemotron-3-super-ultra", r"^nvidia/nemotron-3-(super|ultra)", 40),
    ("nemotron-4", r"^nvidia/nemotron-4-", 35),
    ("llama-3.1-nemotron-70b", r"^nvidia/llama-3\.1-nemotron-(70b|ultra|super)", 30),
    ("llama-3.1-nemotron-nano", r"^nvidia/llama-3\.1-nemotron-nano", 22),
    ("gpt-oss", r"^openai/gpt-oss-", 30),
    ("palmyra", r"^writer/palmyra", 20),
    ("stepfun", r"^stepfun-ai/step-", 18),
    ("kimi", r"^moonshotai/kimi-", 25),
    ("glm", r"^z-ai/glm-", 22),
    ("deepseek-v", r"^deepseek-ai/deepseek-v", 28),
    ("gemma-3", r"^google/gemma-3-(12b|4b)", 18),
    ("gemma-4", r"^google/gemma-4-", 22),
    ("granite-3.0", r"^ibm/granite-3\.0-", 15),
    ("laguna", r"^poolside/laguna", 18),
    ("zamba", r"^zyphra/zamba", 12),
)
CODE_RULES = (
    ("codestral-22b", "codestral-22b", 50),
    ("codestral", "codestral", 45),
    ("codellama-70b", "codellama-70b", 35),
    ("codellama", "codellama", 30),
    ("codegemma", "codegemma", 25),
    ("deepseek-coder", "deepseek-coder", 28),
    ("granite-code", "granite.*code", 25),
    ("starcoder2", "starcoder2", 20),
    ("nemotron-code", "nemotron.*code", 22),
    ("size-8b", "8b", 3),
    ("size-15b", "15b", 5),
    ("size-22b", "22b", 8),
    ("size-34b", "34b", 10),
    ("size-70b", "70b", 12),
)
EMBEDDING_RULES = (
    ("nv-embedqa-e5", "nv-embedqa-e5", 50),
    ("nv-embedqa-mistral", "nv-embedqa-mistral", 35),
    ("embedqa", "embedqa", 30),
    ("nv-embedcode", "nv-embedcode", 25),
    ("nv-embed-v1", "nv-embed-v1", 20),
    ("llama-nemotron-embed", "llama-nemotron-embed", 25),
    ("nemotron-3-embed", "nemotron-3-embed", 22),
    ("nemoretriever", "nemoretriever", 18),
    ("arctic-embed", "arctic-embed", 15),
    ("bge-m3", "bge-m3", 12),
    ("embed-qa-4", "embed-qa-4", 5),
)
# Class patterns, size patterns in order, and models that tell queries from passages.
EMBEDDING_CLASS = "embed|embedqa"
CODE_CLASS = "codestral|codellama|codegemma|granite.*code|deepseek-coder|nemotron.*code|starcoder|embedcode"
SAFETY_CLASS = "guard|safety|content-safety|topic-control|reward|parse|translate|detector|calibration|neva|vila|ai-synthetic|cosmo"
VISION_CLASS = "vision|vl$|clip|video|diffusion|deplot|recurrent|cosmos"
CHAT_CLASS = "instruct|chat|^.*/gpt-|it$|nemotron|moe|reasoning|creative|magistral|laguna|kimi|step-|glm|inkling|palmyra|sea-lion|yi-|zamba|granite|gemma"
SIZES = (
    ("huge", "ultra|550b|340b|253b|122b"),
    ("large", "120b|90b|72b|70b|^.*large"),
    ("medium", "49b|51b|34b|30b|22b|15b|14b|13b|12b|11b"),
    ("small", "8b|7b|nano"),
    ("tiny", "mini|4b|3b|2b|1b"),
)
ASYMMETRIC = "nv-embedqa-e5|nv-embedqa-mistral"


def classify(models: DataFrame) -> DataFrame:
    """Adds is_embedding, is_code, is_safety, is_vision, is_chat and size_class."""
    low = F.lower("id")
    flags = {n: low.rlike(p) for n, p in (("is_embedding", EMBEDDING_CLASS), ("is_code", CODE_CLASS), ("is_safety", SAFETY_CLASS), ("is_vision", VISION_CLASS))}
    other = flags["is_embedding"] | flags["is_code"] | flags["is_safety"] | flags["is_vision"]
    return models.withColumns(flags | {"is_chat": low.rlike(CHAT_CLASS) & ~other, "size_class": size_class(low)})


def size_class(low: Column) -> Column:
    out = F.when(low.rlike(SIZES[0][1]), SIZES[0][0])
    for name, pattern in SIZES[1:]:
        out = out.when(low.rlike(pattern), name)
    return out.otherwise("medium")


def rules_table(spark: SparkSession) -> DataFrame:
    sets = (("chat", CHAT_RULES), ("code", CODE_RULES), ("embedding", EMBEDDING_RULES))
    return spark.createDataFrame([(task, *r) for task, rules in sets for r in rules], "task string, family string, pattern string, points int")


def matching_rules(models: DataFrame, rules: DataFrame) -> DataFrame:
    """Theta join: a row for each rule whose pattern the id matches. The rules are a fixed short table."""
    return models.join(F.broadcast(rules), F.expr("lower(id) RLIKE pattern"))


def rule_points(models: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, task, points): the sum of matching rules, 0 without any."""
    tasks = rules.select("task").distinct()
    sums = matching_rules(models, rules).groupBy("id", "task").agg(F.sum("points").alias("points"))
    return models.select("id").distinct().crossJoin(F.broadcast(tasks)).join(sums, ["id", "task"], "left").na.fill(0, ["points"])


def pick(models: DataFrame, rules: DataFrame) -> DataFrame:
    """One row: routing, eval, code_gen, answer, embedding. Ties go to the model that stands first (`seq`)."""
    points = rule_points(models, rules).groupBy("id").pivot("task", ["chat", "code", "embedding"]).agg(F.first("points"))
    m = classify(models).join(points, "id")

    def best(cond: Column, points_col: str) -> Column:
        return F.max_by(F.when(cond, F.col("id")), F.when(cond, F.struct(F.col(points_col), F.negative("seq"))))

    first = lambda cond: F.min_by(F.when(cond, F.col("id")), F.when(cond, F.col("seq")))
    size = lambda *names: F.col("size_class").isin(*names)
    chat, code, embedding = F.col("is_chat"), F.col("is_code"), F.col("is_embedding")
    # a best of a non-empty class always exists, so the classes' first members never come into play
    routing = m.agg(F.coalesce(best(chat & size("small"), "chat"), best(chat & size("tiny"), "chat"), first(chat)).alias("routing"))
    rest = m.join(F.broadcast(routing), F.col("id") == F.col("routing"), "left")
    others = chat & size("small") & F.col("routing").isNull()
    return rest.agg(
        F.max("routing").alias("routing"),
        F.coalesce(best(others, "chat"), best(chat & size("small"), "chat"), first(chat)).alias("eval"),
        F.coalesce(best(code & size("medium", "large", "huge", "small"), "code"), first(code)).alias("code_gen"),
        F.coalesce(best(chat & size("huge"), "chat"), best(chat & size("large"), "chat"), first(chat)).alias("answer"),
        best(embedding, "embedding").alias("embedding"),
    )


def missing_models(picked: DataFrame, catalog: DataFrame, col: str = "id") -> DataFrame:
    """Picked models that the catalog does not have."""
    return picked.join(catalog.select(col), col, "left_anti")


def input_type(model_id: Column, is_query: Column) -> Column:
    """query or passage for models that tell them apart, else null."""
    return F.when(F.lower(model_id).rlike(ASYMMETRIC), F.when(is_query, "query").otherwise("passage"))


def migrate_local(models: DataFrame) -> DataFrame:
    """(chat, embeddings) of legacy slots: the first that is not blank of answer, routing, codeGen, eval; migrated rows stay."""
    some = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c))
    done = F.col("chat").isNotNull() & F.col("embeddings").isNotNull()
    chat = F.when(done, F.col("chat")).otherwise(F.coalesce(some("answer"), some("routing"), some("codeGen"), some("eval"), F.col("chat"), F.lit("")))
    emb = F.when(done, F.col("embeddings")).otherwise(F.coalesce("embedding", "embeddings", F.lit("")))
    return models.select(*[c for c in models.columns if c == "id"], chat.alias("chat"), emb.alias("embeddings"))


def validate_settings(settings: DataFrame) -> DataFrame:
    """(id, valid, errors, warnings) of rows of settings, by rules in order."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    nim, local = F.col("provider") == "nim", F.col("provider") == "local"
    unknown = lambda c: local & ~blank(c) & (F.size("catalog") > 0) & ~F.array_contains("catalog", F.col(c))
    rules = (
        (nim & blank("api_key"), "NO_PROVIDER_CONFIGURED"),
        (nim & blank("embedding_api_key"), "EMBEDDING_MODEL_MISSING"),
        (local & blank("local_server_url"), "LOCAL_SERVER_URL_MISSING"),
        (local & blank("chat"), "MODEL_NOT_FOUND"),
        (local & blank("embeddings"), "EMBEDDING_MODEL_MISSING"),
        (unknown("chat"), "MODEL_NOT_FOUND"),
        (unknown("embeddings"), "MODEL_NOT_FOUND"),
    )
    hints = ((local & (F.coalesce(F.size("catalog"), F.lit(0)) <= 0), "MODEL_CATALOG_EMPTY"), ((F.col("web_search") == "serper") & blank("serper_key"), "SERPER_KEY_MISSING"))
    found = lambda pairs: F.array_compact(F.array(*[F.when(c, code) for c, code in pairs]))
    return settings.select("id", (F.size(found(rules)) == 0).alias("valid"), found(rules).alias("errors"), found(hints).alias("warnings"))
