"""The entity plane: evidence sites, identities, occurrences and edges, and traversal across entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X

#: What a call pattern says about an entity: plane, type, role and edge kind (fixed values).
SITES = [
    (r"process\.env(?:\.|\[['\"])([A-Z][A-Z0-9_]*)", "general", "environment_variable", "environment_read", "reads_env"),
    (r"\b(?:config|[A-Za-z]*[cC]onfigService)\.(?:get|getOrThrow|require)\(\s*['\"]([^'\"\n]+)['\"]", "general", "config_key", "config_read", "reads_config"),
    (r"\b(?:fetch|axios(?:\.[a-z]+)?|got(?:\.[a-z]+)?|request)\(\s*['\"][a-z]+://([^'\"/\n]+)", "general", "external_host", "external_host_call", "calls_host"),
    (r"\b(?:app|[a-zA-Z]*[rR]outer|server|fastify)\.(?:get|post|put|patch|delete|head|options|all)\(\s*['\"]([^'\"\n]+)['\"]", "general", "route", "route_handler", "handles_route"),
    (r"@(?:Controller|Get|Post|Put|Patch|Delete|Head|Options|All)\(\s*['\"]([^'\"\n]*)['\"]", "general", "route", "route_handler", "handles_route"),
    (r"\bpath:\s*'([^'\n]+)'", "general", "route", "route_handler", "handles_route"),
    (r"\b[a-zA-Z]*[cC]lient\.(?:query|mutation|subscription)\(\s*\{\s*([A-Za-z_$][\w$]*)", "general", "graphql_operation", "graphql_operation", "invokes_graphql"),
    (r"@(?:Query|Mutation|Subscription)\((?:[^()]|\([^()]*\))*\)\s*(?:async\s+)?([A-Za-z_$][\w$]*)\s*\(", "general", "graphql_operation", "graphql_handler", "handles_graphql"),
    (r"\b(?:isEnabled|isFeatureEnabled|getFlag|hasFeature|useFeatureFlag|variation)\(\s*['\"]([^'\"\n]+)['\"]", "general", "feature_flag", "feature_flag_check", "checks_flag"),
    (r"\b([a-zA-Z]*(?:[rR]epository|[mM]odel|prisma\.[a-zA-Z]+))\.(?:find|findOne|findMany|findUnique|findFirst|count|aggregate)\(", "general", "database_resource", "database_read", "reads_resource"),
    (r"\b([a-zA-Z]*(?:[rR]epository|[mM]odel|prisma\.[a-zA-Z]+))\.(?:save|insert|create|update|upsert|delete|remove|createMany|updateMany|deleteMany)\(", "general", "database_resource", "database_write", "writes_resource"),
    (r"\bgetRepository\(\s*([A-Za-z_$][\w$]*)", "general", "database_resource", "database_acquire", "acquires_resource"),
    (r"\b[a-zA-Z]*(?:[qQ]ueue|[jJ]obs?|[wW]orker|[cC]ron|[sS]chedul\w*|[pP]roducer)\.(?:add|addBulk|addCron|enqueue|publish|schedule)\(\s*['\"]([^'\"\n]+)['\"]", "runtime", "job", "job_producer", "produces_job"),
    (r"\bnew Worker\(\s*['\"]([^'\"\n]+)['\"]", "runtime", "job", "job_handler", "job_handler"),
    (r"@(?:Cron|Interval|Timeout|Process|Processor|Job)\(\s*['\"]([^'\"\n]+)['\"]", "runtime", "job", "job_handler", "job_handler"),
    (r"\bdefineLogicFunction\(\s*\{\s*universalIdentifier:\s*['\"]([^'\"\n]+)['\"]", "runtime", "registry", "registered_handler", "registered_handler"),
    (r"\btargetLogicFunctionUniversalIdentifier:\s*['\"]([^'\"\n]+)['\"]", "runtime", "registry", "dispatch_site", "dispatches"),
    (r"\bdatabaseEventTriggerSettings:\s*\{\s*eventName:\s*['\"]([^'\"\n]+)['\"]", "runtime", "data_lifecycle", "lifecycle_listener", "lifecycle_listener"),
    (r"\.mutation\(\s*\{\s*((?:create|update|delete)[A-Z]\w*)", "runtime", "data_lifecycle", "lifecycle_producer", "produces_lifecycle"),
    (r"\bprovide:\s*['\"]?([A-Za-z_$][\w$.]*)['\"]?\s*,\s*use(?:Class|Factory|Existing|Value)\b", "runtime", "di_token", "provider", "provides"),
    (r"@Inject\(\s*['\"]?([A-Za-z_$][\w$.]*)", "runtime", "di_token", "injection_site", "injects"),
    (r"\binterface ([A-Z]\w*)", "contract", "interface", "contract_declaration", "declares_contract"),
    (r"\btype ([A-Z]\w*)\s*=", "contract", "type_alias", "contract_declaration", "declares_contract"),
    (r"\benum ([A-Z]\w*)", "contract", "enum", "contract_declaration", "declares_contract"),
    (r"\b(?:const|let)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:z|yup|joi|Joi|t|v)\.object\(", "contract", "schema", "contract_declaration", "declares_contract"),
    (r"\bclass ([A-Z]\w*(?:Dto|DTO|Input|Payload))\b", "contract", "schema", "contract_declaration", "declares_contract"),
    (r"\)\s*:\s*([A-Z]\w*)\b", "contract", "reference", "return_contract", "returns_contract"),
    (r"[(,)]\s*[A-Za-z_$][\w$]*\??\s*:\s*([A-Z]\w*)\b", "contract", "reference", "parameter_contract", "accepts_contract"),
    (r"\b(?:const|let|var)\s+[A-Za-z_$][\w$]*\s*:\s*([A-Z]\w*)\b", "contract", "reference", "contract_reference", "references_contract"),
    (r"@([A-Z]\w*)\b", "contract", "decorator", "decorator_use", "decorated_by"),
]
#: Roles that produce for the other side of a runtime boundary, and those that consume (fixed values).
PRODUCERS = ["dispatch_site", "job_producer", "lifecycle_producer", "injection_site"]
CONSUMERS = ["registered_handler", "job_handler", "lifecycle_listener", "provider"]
#: Entities with more occurrences than this are hubs and are not crossed.
HUB_LIMIT = 12


def _found(pattern: str, plane: str, type_: str, role: str, kind: str) -> Column:
    """Array of what one pattern finds in a text."""
    fixed = [F.lit(plane).alias("plane"), F.lit(type_).alias("entity_type"), F.lit(role).alias("role"), F.lit(kind).alias("kind")]
    return F.transform(F.regexp_extract_all("content", F.lit(pattern), 1), lambda name: F.struct(*fixed, name.alias("name")))


def sites(sources: DataFrame, key: str = "file_id") -> DataFrame:
    """(file_id, plane, entity_type, role, name, kind, n) of every pattern of SITES in each text, in one scan."""
    every = F.flatten(F.array(*[_found(*site) for site in SITES]))
    rows = sources.select(F.col(key).alias("file_id"), F.explode(every).alias("_s")).select("file_id", "_s.*")
    return rows.groupBy("file_id", "plane", "entity_type", "role", "name", "kind").agg(F.count(F.lit(1)).alias("n"))


def entities(site_rows: DataFrame) -> DataFrame:
    """(entity_key, plane, entity_type, name, n_files, n_occurrences): one identity per plane, type and name."""
    key = F.concat_ws(":", F.lit("entity"), "entity_type", X.encoded_key(F.col("name")))
    return site_rows.groupBy("plane", "entity_type", "name").agg(F.count_distinct("file_id").alias("n_files"), F.sum("n").alias("n_occurrences")).select(
        key.alias("entity_key"), "plane", "entity_type", "name", "n_files", "n_occurrences"
    )


def entity_edges(site_rows: DataFrame, files: DataFrame) -> DataFrame:
    """One edge per file, entity and kind; consumers are the target's side, so their edge points from the entity."""
    at = files.select(F.col("id").alias("_f"), F.concat(F.lit("file:"), "path").alias("file_key"))
    key = F.concat_ws(":", F.lit("entity"), "entity_type", X.encoded_key(F.col("name")))
    rows = site_rows.join(at, F.col("file_id") == F.col("_f")).withColumn("entity_key", key)
    takes = F.col("role").isin(CONSUMERS)
    certain = F.when(F.col("plane") == "contract", "certain").otherwise("likely")
    return rows.select(
        F.when(takes, F.col("entity_key")).otherwise(F.col("file_key")).alias("src_key"),
        F.when(takes, F.col("file_key")).otherwise(F.col("entity_key")).alias("dst_key"), "kind", certain.alias("confidence"),
    ).distinct()


def crossings(site_rows: DataFrame) -> DataFrame:
    """(entity_type, name, from_file, to_file): one logical hop across an entity that is no hub.

    On the runtime plane from producers to consumers; on the general plane between any two files. Hubs are left
    out before the self-join, so its size is bounded by the limit times the occurrences.
    """
    per = site_rows.filter("plane <> 'contract'").select("entity_type", "name", "plane", "role", "file_id").distinct()
    few = per.groupBy("entity_type", "name").agg(F.count_distinct("file_id").alias("_n")).filter((F.col("_n") > 1) & (F.col("_n") <= HUB_LIMIT)).drop("_n")
    use = per.join(few, ["entity_type", "name"], "left_semi")
    a = use.select("entity_type", "name", "plane", F.col("role").alias("_ra"), F.col("file_id").alias("from_file"))
    b = use.select("entity_type", "name", F.col("role").alias("_rb"), F.col("file_id").alias("to_file"))
    both = a.join(b, ["entity_type", "name"]).filter("from_file <> to_file")
    ok = (F.col("plane") == "general") | (F.col("_ra").isin(PRODUCERS) & F.col("_rb").isin(CONSUMERS))
    return both.filter(ok).select("entity_type", "name", "from_file", "to_file").distinct()


def diverse(df: DataFrame, group: list[str], order: list, kind: str) -> DataFrame:
    """``df`` with ``pick``: within each group the first of each kind before the seconds, then by the order."""
    within = Window.partitionBy(*group, kind).orderBy(*order)
    turn = F.row_number().over(within)
    return df.withColumn("_turn", turn).withColumn("pick", F.row_number().over(Window.partitionBy(*group).orderBy("_turn", *order)).cast("long")).drop("_turn")
