"""Queries over the driver's tables, one or more for each operator of the engine, and their SQL.

Few of the tables' texts hold anything to find, so most queries build theirs from keys with
``md5``, in an expression that both engines read; token formats are then matched in SQL by
regular expressions with captured neighbours.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.functions import text as T
from saltmarsh.operators import compare, evidence
from saltmarsh.operators.policy import decide, default_action_column, parse_policy, rule_hits
from saltmarsh.operators.registry import ALPHABETS, Detector, detectors
from saltmarsh.operators.scan import ScanConfig, explode_findings, redact, scan, scan_and_redact
from saltmarsh.sources.boundary import sanitize_json

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


#: Bytes of a batch that goes to a Python worker, unless the session says otherwise: a worker holds a batch several
#: times over, as Arrow and as strings, and an executor has a worker for each core.
BATCH_BYTES = 4 << 20


def _small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == f"{64 << 20}b":  # Spark's default
        spark.conf.set(key, str(BATCH_BYTES))


def _read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """Columns of a table. A small one is a single split: its rows are dealt out, so that all cores take part."""
    _small_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    df = df.select(*columns) if columns else df
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Keys whose texts a task makes and works on in Python.
TASK_KEYS = 100_000


def _keys(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """Columns of keys for work in Python, dealt out evenly: a split is whole row groups, which can hold millions of keys."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)
    return df.repartition(max(spark.sparkContext.defaultParallelism, -(-df.count() // TASK_KEYS)))


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


# --- texts of keys ---------------------------------------------------------


def hexes(n: int, key: str = "o_orderkey") -> str:
    """An expression of ``n`` hex digits by key, in both engines."""
    parts = [f"md5(concat('{k}-', cast({key} as string)))" for k in range(-(-n // 32))]
    return f"substr(concat({', '.join(parts)}), 1, {n})" if len(parts) > 1 else f"substr({parts[0]}, 1, {n})"


def body_of(alphabet: str, n: int) -> str:
    made = hexes(n)
    if alphabet == "U":
        return f"upper({made})"
    return f"replace({made}, '0', '1')" if alphabet == "S" else made


# --- detectors by format ---------------------------------------------------

PLAIN = [d for d in detectors() if d.formats and d.check in ("", "varied", "most128", "most36")]
GROUP = 8


def sample_of(d: Detector) -> tuple[str, str]:
    """SQL of a token of a detector's first format, and its pattern for SQL."""
    f = d.formats[0]
    n = f.lengths[0]
    cls = f"[{ALPHABETS[f.alphabet]}]"
    several = "(?:" + "|".join(f"{cls}{{{k}}}" for k in sorted(f.lengths, reverse=True)) + ")"
    pattern = f.prefix.replace(".", "[.]") + (several if len(f.lengths) > 1 else f"{cls}{{{n},}}" if f.open == "+" else f"{cls}{{{n}}}")
    return f"concat('{f.prefix}', {body_of(f.alphabet, n)})", pattern


def _group_text(group: list[Detector]) -> str:
    """Every seventh row has a character more, glued to the token: no finding of an exact format."""
    cases = " ".join(f"WHEN {k} THEN {sample_of(d)[0]}" for k, d in enumerate(group))
    return f"concat('row ', cast(o_orderkey as string), ' = ', CASE o_orderkey % {len(group)} {cases} END, CASE WHEN o_orderkey % 7 = 0 THEN 'a' ELSE '' END, ' end')"


def _group_query(group: list[Detector]):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        texts = _keys(spark, sf_dir, "orders", "o_orderkey").withColumn("text", F.expr(_group_text(group)))
        found = scan(texts, config=ScanConfig(include=tuple(d.id for d in group)))
        return explode_findings(found, "o_orderkey").select("o_orderkey", "type", "detector", "confidence", "specificity", "action", "start", "end")

    return query


def _group_sql(group: list[Detector]) -> str:
    parts = []
    for d in group:
        pattern = sample_of(d)[1]
        edge = d.edge
        match = f"regexp_extract(text, '(^|[^{edge}])({pattern})($|[^{edge}])', 2)"
        parts.append(f"SELECT o_orderkey, '{d.formats[0].type}' AS type, '{d.id}' AS detector, {match} AS m, text FROM t")
    union = " UNION ALL ".join(parts)
    return (
        f"WITH t AS (SELECT o_orderkey, {_group_text(group)} AS text FROM orders) "
        f"SELECT o_orderkey, type, detector, 'high' AS confidence, 'provider' AS specificity, 'redact' AS action, (strpos(text, m) - 1)::INT AS start, (strpos(text, m) - 1 + length(m))::INT AS \"end\" "
        f"FROM ({union}) WHERE m <> ''"
    )


for _k in range(0, len(PLAIN), GROUP):
    _g = PLAIN[_k : _k + GROUP]
    _add(f"detect_formats_{_k // GROUP + 1:02d}", _group_query(_g), _group_sql(_g))


# --- detectors that need more than a format: text, SQL of the value, type, confidence, specificity ---

UUID = f"concat(substr({hexes(32)},1,8),'-',substr({hexes(32)},9,4),'-4',substr({hexes(32)},14,3),'-a',substr({hexes(32)},18,3),'-',substr({hexes(32)},21,12))"
STRUCTURED = {
    # detector: (text before, value, text after, type, confidence, specificity)
    "openai-token": ("key ", f"concat('sk-', {hexes(20)}, 'T3BlbkFJ', {hexes(20)})", " end", "openai_api_key", "high", "provider"),
    "stripe-token": ("key ", f"concat('sk_live_', {hexes(24)})", " end", "stripe_credential", "high", "provider"),
    "slack-token": ("key ", f"concat('xoxb-1234567890-1234567890-', {hexes(24)})", " end", "slack_token", "high", "provider"),
    "cloudflare-token": ("key ", f"concat('cfut_', {hexes(48)})", " end", "cloudflare_api_token", "high", "provider"),
    "supabase-token": ("key ", f"concat('sb_secret_', {hexes(22)}, '_', {hexes(8)})", " end", "supabase_secret_key", "high", "provider"),
    "github-token": ("key ", f"concat('github_pat_', {hexes(22)}, '_', {hexes(59)})", " end", "github_fine_grained_personal_access_token", "high", "provider"),
    "sendgrid-token": ("key ", f"concat('SG.', {hexes(22)}, '.', {hexes(43)})", " end", "sendgrid_api_key", "high", "provider"),
    "telegram-bot-token": ("key ", f"concat('123456789:', {hexes(35)})", " end", "telegram_bot_token", "high", "provider"),
    "databricks-personal-access-token": ("key ", f"concat('dapi', {hexes(32)})", " end", "databricks_personal_access_token", "high", "provider"),
    "langfuse-secret-key": ("key ", f"concat('sk-lf-', {UUID})", " end", "langfuse_secret_key", "high", "provider"),
    "postman-api-key": ("key ", f"concat('PMAK-', {hexes(24)}, '-', {hexes(34)})", " end", "postman_api_key", "high", "provider"),
    "doppler-token": ("key ", f"concat('dp.st.', {hexes(42)})", " end", "doppler_service_token", "high", "provider"),
    "jwt": ("jwt ", f"concat('eyJ', {hexes(20)}, '.eyJ', {hexes(20)}, '.', {hexes(32)})", " end", "jwt", "high", "structural"),
    "bearer-token": ("Authorization: Bearer ", hexes(32), "", "bearer_token", "high", "structural"),
    "connection-string": ("dsn postgresql://app:", hexes(20), "@db.internal:5432/main", "connection_string_password", "high", "structural"),
    "otpauth-uri": ("uri otpauth://totp/acme:joe?secret=", f"translate(upper({hexes(32)}), '0189', 'GHIJ')", "&issuer=acme", "otpauth_secret", "high", "structural"),
    "twilio-auth-token": ("twilio_auth_token = ", hexes(32), " end", "twilio_auth_token", "high", "provider"),
    "datadog-api-key": ("datadog_api_key = ", hexes(32), " end", "datadog_api_key", "high", "provider"),
    "mistral-api-key": ("mistral call with ", hexes(32), " end", "mistral_api_key", "medium", "provider"),
    "cohere-api-key": ("cohere call with ", hexes(40), " end", "cohere_api_key", "medium", "provider"),
    "heroku-api-key-legacy": ("heroku login ", UUID, " end", "heroku_api_key_legacy", "medium", "provider"),
    "aws-secret-access-key": ("aws_secret_access_key = ", hexes(40), " end", "aws_secret_access_key", "high", "provider"),
    "generic-token": ("API_KEY=", hexes(32), "", "contextual_secret", "high", "contextual"),
    "private-key": ("pem -----BEGIN PRIVATE KEY-----\n", None, None, "private_key", "high", "private_key"),
}
PEM_VALUE = f"concat('-----BEGIN PRIVATE KEY-----', chr(10), {hexes(64)}, chr(10), '-----END PRIVATE KEY-----')"
STRUCTURED["private-key"] = ("pem ", PEM_VALUE, " end", "private_key", "high", "private_key")


BASE32 = "translate(upper({}), '0189', 'GHIJ')"
SEVENS = ", '-', ".join(f"substr({hexes(32)}, {1 + 7 * k}, 7)" for k in range(4))


def _key(value: str, kind: str, specificity: str = "provider") -> tuple:
    return "key ", value, " end", kind, "high", specificity


CHECKED = {
    "aws-bedrock-long-term-api-key": _key(f"concat('ABSKQmVkcm9j', {hexes(110)})", "aws_bedrock_long_term_api_key"),
    "slack-token": _key(f"concat('xapp-1-', {hexes(11)}, '-123456-', {hexes(32)})", "slack_app_level_token"),
    "microsoft-entra-client-secret": _key(f"concat({hexes(3)}, '1Q~', {hexes(31)})", "microsoft_entra_client_secret"),
    "azure-devops-personal-access-token": _key(f"concat({hexes(76)}, 'AZDO', {hexes(4)})", "azure_devops_personal_access_token"),
    "notion-token": _key(f"concat('ntn_12345678901', {hexes(35)})", "notion_integration_token"),
    "atlassian-api-token": _key(f"concat('ATAT', {hexes(100)})", "atlassian_api_token"),
    "discord-bot-token": _key(f"concat({hexes(24)}, '.abcdef.', {hexes(27)})", "discord_bot_token"),
    "sentry-org-auth-token": _key(f"concat('sntrys_eyJ', {hexes(30)}, '_', {hexes(43)})", "sentry_org_auth_token"),
    "grafana-service-account-token": _key(f"concat('glsa_', {hexes(32)}, '_', {hexes(8)})", "grafana_service_account_token"),
    "firebase-server-key": _key(f"concat('AAAA', {hexes(7)}, ':', {hexes(140)})", "firebase_server_key"),
    "terraform-cloud-token": _key(f"concat({hexes(14)}, '.atlasv1.', {hexes(67)})", "terraform_cloud_token"),
    "elevenlabs-api-key": _key(f"concat('sk_', {hexes(48)})", "elevenlabs_api_key"),
    "langsmith-api-key": _key(f"concat('lsv2_pt_', {hexes(32)}, '_', {hexes(10)})", "langsmith_api_key"),
    "firecrawl-api-key": _key(f"concat('fc-', {hexes(12)}, '4', {hexes(3)}, 'a', {hexes(15)})", "firecrawl_api_key"),
    "composio-api-key": _key(f"concat('oak_', {hexes(20)})", "composio_org_api_key"),
    "convex-deployment-key": _key(f"concat('prod:happy-cat-1|01', {hexes(74)})", "convex_deployment_key"),
    "onepassword-service-account-token": _key(f"concat('ops_eyJ', {hexes(250)})", "onepassword_service_account_token"),
    "resend-api-key": _key(f"concat('re_Ab', {hexes(6)}, '_', {hexes(24)})", "resend_api_key"),
    "wandb-api-key": _key(f"concat('wandb_v1_', {hexes(64)})", "wandb_api_key"),
    "clickhouse-cloud-api-secret": _key(f"concat('4b1dZ', {hexes(37)})", "clickhouse_cloud_api_secret"),
    "bitwarden-secrets-manager-access-token": _key(f"concat('0.', {UUID}, '.', {hexes(30)}, ':', {hexes(22)}, '==')", "bitwarden_secrets_manager_access_token"),
    "dynatrace-token": _key(f"concat('dt0c01.', {BASE32.format(hexes(24))}, '.', {BASE32.format(hexes(64))})", "dynatrace_token"),
    "paddle-api-key": _key(f"concat('pdl_live_apikey_', {hexes(26)}, '_', {hexes(22)}, '_', {hexes(3)})", "paddle_api_key"),
    "honeycomb-api-key": _key(f"concat('hcaik_', {hexes(58)})", "honeycomb_ingest_key"),
    "axiom-token": _key(f"concat('xaat-', {UUID})", "axiom_api_token"),
    "sourcegraph-token": _key(f"concat('sgp_', {hexes(40)})", "sourcegraph_access_token"),
    "unkey-root-key": _key(f"concat('unkey_3Z', {body_of('S', 22)})", "unkey_root_key"),
    "buildkite-token": _key(f"concat('bkua_', {hexes(40)})", "buildkite_api_access_token"),
    "pydantic-logfire-token": _key(f"concat('pylf_v1_us_', {hexes(43)})", "pydantic_logfire_token"),
    "mapbox-token": _key(f"concat('sk.eyJ', {hexes(30)}, '.', {hexes(22)})", "mapbox_secret_access_token"),
    "fly-token": _key(f"concat('fm2_', {hexes(64)})", "fly_access_token"),
    "ory-token": _key(f"concat('ory_at_', {hexes(43)}, '.', {hexes(43)})", "ory_oauth2_token"),
    "baseten-api-key": _key(f"concat('b10_', {hexes(8)}, '.', {hexes(32)})", "baseten_api_key"),
    "gitlab-runner-authentication-token": _key(f"concat('glrt-', {hexes(20)})", "gitlab_runner_authentication_token"),
    "heroku-api-key": _key(f"concat('HRKU-', {UUID})", "heroku_api_key"),
    "helicone-api-key": _key(f"concat('sk-helicone-', {SEVENS})", "helicone_api_key"),
    "vercel-token": _key(f"concat('vcp_', {hexes(56)})", "vercel_personal_access_token"),
    "okta-api-token": ("okta_token = ", f"concat('00', {hexes(40)})", " end", "okta_api_token", "high", "provider"),
    "mailchimp-api-key": _key(f"concat({hexes(32)}, '-us12')", "mailchimp_api_key"),
    "mailgun-api-key": ("mailgun_key = ", f"concat('key-', {hexes(32)})", " end", "mailgun_api_key", "high", "provider"),
    "new-relic-license-key": _key(f"concat({hexes(32)}, 'FFFFNRAL')", "new_relic_license_key"),
    "pinecone-api-key": _key(f"concat('pcsk_', {hexes(5)}, '_', {hexes(63)})", "pinecone_api_key"),
    "confluent-cloud-api-secret-legacy": ("confluent value ", hexes(64), " end", "confluent_cloud_api_secret_legacy", "medium", "provider"),
    "travisci-api-token": ("travis_token: ", f"concat('A1', {hexes(20)})", " end", "travisci_api_token", "high", "provider"),
    "ai21-api-key": ("ai21 call with ", hexes(32), " end", "ai21_api_key", "medium", "provider"),
    "deepgram-api-key": ("deepgram call with ", hexes(40), " end", "deepgram_api_key", "medium", "provider"),
    "twilio-api-key-secret": ("twilio call with ", f"concat('Z', {hexes(31)})", " end", "twilio_api_key_secret", "medium", "provider"),
    "datadog-application-key-legacy": ("dd_app_key = ", hexes(40), " end", "datadog_application_key_legacy", "high", "provider"),
}


def _structured_text(group: dict) -> str:
    cases = " ".join(f"WHEN {k} THEN concat('{before}', {value}, '{after}')" for k, (before, value, after, *_) in enumerate(group.values()))
    return f"CASE o_orderkey % {len(group)} {cases} END"


def _structured(spark: SparkSession, sf_dir: str, group: dict = STRUCTURED) -> DataFrame:
    return _keys(spark, sf_dir, "orders", "o_orderkey").withColumn("text", F.expr(_structured_text(group)))


def _structured_sql(columns: str, group: dict = STRUCTURED) -> str:
    row = lambda k, d, v: (
        f"SELECT o_orderkey, concat('{v[0]}', {v[1]}, '{v[2]}') AS text, {v[1]} AS value, '{d}' AS detector, '{v[3]}' AS type, '{v[4]}' AS confidence, '{v[5]}' AS specificity, "
        f"CASE WHEN '{v[3]}' = 'private_key' THEN 'block' WHEN '{v[4]}' = 'medium' THEN 'warn' ELSE 'redact' END AS action, length('{v[0]}')::INT AS start, (length('{v[0]}') + length({v[1]}))::INT AS \"end\" FROM orders WHERE o_orderkey % {len(group)} = {k}"
    )
    union = " UNION ALL ".join(row(k, d, v) for k, (d, v) in enumerate(group.items()))
    return f"SELECT {columns} FROM ({union})"


FOUND = "o_orderkey, type, detector, confidence, specificity, action, start, \"end\""
_add(
    "detect_structured",
    lambda spark, d: explode_findings(scan(_structured(spark, d)), "o_orderkey").select("o_orderkey", "type", "detector", "confidence", "specificity", "action", "start", "end"),
    _structured_sql(FOUND),
)
for _k in range(0, len(CHECKED), 12):
    _c = dict(list(CHECKED.items())[_k : _k + 12])
    _add(
        f"detect_checked_{_k // 12 + 1}",
        lambda spark, d, c=_c: explode_findings(scan(_structured(spark, d, c)), "o_orderkey").select("o_orderkey", "type", "detector", "confidence", "specificity", "action", "start", "end"),
        _structured_sql(FOUND, _c),
    )
_add(
    "redact_default",
    lambda spark, d: scan_and_redact(_structured(spark, d)).select("o_orderkey", "text", F.size("findings").alias("n")),
    _structured_sql("o_orderkey, CASE WHEN action IN ('redact', 'block') THEN replace(text, value, '<SECRET_1>') ELSE text END AS text, 1 AS n"),
)
_add(
    "redact_typed",
    lambda spark, d: scan_and_redact(_structured(spark, d), typed=True).select("o_orderkey", "text"),
    _structured_sql("o_orderkey, CASE WHEN action IN ('redact', 'block') THEN replace(text, value, concat('<', upper(translate(type, '.-', '__')), '_1>')) ELSE text END AS text"),
)
_add(
    "action_cube",
    lambda spark, d: explode_findings(scan(_structured(spark, d)), "o_orderkey").cube("type", "action").agg(F.count(F.lit(1)).alias("n")),
    f"SELECT type, action, count(*) AS n FROM ({_structured_sql('type, action')}) GROUP BY CUBE (type, action)",
)
_add(
    "profile_common",
    lambda spark, d: explode_findings(scan(_structured(spark, d), config=ScanConfig(profile="common")), "o_orderkey").groupBy("detector").agg(F.count(F.lit(1)).alias("n")),
    # in the common profile other tokens are still seen where a header, URL or assignment names them
    None,
)

# --- policies --------------------------------------------------------------

POLICY_A = '{"actionPolicyRevision": 1, "base": "default", "rules": [{"id": "keep-jwt", "match": {"type": ["jwt"]}, "action": "default"}, {"id": "medium", "match": {"confidence": ["medium"]}, "action": "redact"}, {"id": "quiet", "match": {"type": ["bearer_token", "otpauth_secret"], "confidence": ["high"]}, "action": "allow"}]}'
POLICY_B = '{"actionPolicyRevision": 1, "base": "default", "rules": [{"id": "block-aws", "match": {"detector": ["aws-secret-access-key"]}, "action": "block"}, {"id": "all-high", "match": {"confidence": ["high"]}, "action": "warn"}]}'


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_findings(scan(_structured(spark, sf_dir)), "o_orderkey").select("o_orderkey", "type", "detector", "confidence", "obfuscation")


_BASE = _structured_sql("o_orderkey, type, detector, confidence, action AS base, 'none' AS obfuscation")
_A = "CASE WHEN type = 'jwt' THEN base WHEN confidence = 'medium' THEN 'redact' WHEN type IN ('bearer_token', 'otpauth_secret') AND confidence = 'high' THEN 'allow' ELSE base END"
_A_BASIS = "CASE WHEN type = 'jwt' THEN 'rule-default' WHEN confidence = 'medium' OR (type IN ('bearer_token', 'otpauth_secret') AND confidence = 'high') THEN 'rule' ELSE 'no-rule-matched' END"
_A_RULE = "CASE WHEN type = 'jwt' THEN 0 WHEN confidence = 'medium' THEN 1 WHEN type IN ('bearer_token', 'otpauth_secret') AND confidence = 'high' THEN 2 END"
_B = "CASE WHEN detector = 'aws-secret-access-key' THEN 'block' WHEN confidence = 'high' THEN 'warn' ELSE base END"


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.compare_policies(_findings(spark, sf_dir), {"default": None, "a": parse_policy(POLICY_A), "b": parse_policy(POLICY_B)})


_add(
    "action_policy",
    lambda spark, d: _findings(spark, d).withColumn("_d", decide(parse_policy(POLICY_A), F.struct("*"))).select("o_orderkey", "type", "_d.action", "_d.basis", F.coalesce("_d.rule_index", F.lit(-1)).alias("rule_index")),
    f"SELECT o_orderkey, type, {_A} AS action, {_A_BASIS} AS basis, coalesce({_A_RULE}, -1) AS rule_index FROM ({_BASE})",
)
_add(
    "policy_rule_hits",
    lambda spark, d: rule_hits(_findings(spark, d), parse_policy(POLICY_A)),
    f"SELECT r.i AS rule_index, r.id AS rule_id, count(f.rule_index) AS hits FROM (VALUES (0, 'keep-jwt'), (1, 'medium'), (2, 'quiet')) r(i, id) LEFT JOIN (SELECT {_A_RULE} AS rule_index FROM ({_BASE})) f ON f.rule_index = r.i GROUP BY ALL",
)
_add(
    "compare_policies",
    lambda spark, d: compare.action_counts(_compared(spark, d)),
    f"SELECT policy, action, count(*) AS n FROM (SELECT 'default' AS policy, base AS action FROM ({_BASE}) UNION ALL SELECT 'a', {_A} FROM ({_BASE}) UNION ALL SELECT 'b', {_B} FROM ({_BASE})) GROUP BY ALL",
)
_add(
    "compare_policies_changed",
    lambda spark, d: compare.changed(_compared(spark, d), ["o_orderkey", "type"], "default"),
    f"SELECT policy, sum(c)::BIGINT AS changed FROM (SELECT 'a' AS policy, ({_A} <> base)::INT AS c FROM ({_BASE}) UNION ALL SELECT 'b', ({_B} <> base)::INT FROM ({_BASE})) GROUP BY policy",
)
_add(
    "default_policy",
    lambda spark, d: _read(spark, d, "orders", "o_orderkey").select(
        "o_orderkey",
        F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'private_key' WHEN 1 THEN 'npm_access_token' WHEN 2 THEN 'contextual_secret' ELSE 'acme-token' END").alias("type"),
        F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END").alias("confidence"),
    ).withColumn("action", default_action_column(F.col("type"), F.col("confidence"))),
    "SELECT *, CASE WHEN type = 'private_key' THEN 'block' WHEN type = 'npm_access_token' OR confidence = 'high' THEN 'redact' ELSE 'warn' END AS action FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'private_key' WHEN 1 THEN 'npm_access_token' WHEN 2 THEN 'contextual_secret' ELSE 'acme-token' END AS type, CASE o_orderkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence FROM orders)",
)

# --- rulesets --------------------------------------------------------------

RULESET = 'ruleset-revision: 1\ndetector: acme-internal-token\nspecificity: entropy\nprefix: "acme_"\nalphabet: lower-hex\nrun: exact 24\nvalidator: trailing-lower-hex\nnames: ambiguous\nname: token\n'
_add(
    "ruleset_values",
    lambda spark, d: explode_findings(scan(_keys(spark, d, "orders", "o_orderkey").withColumn("text", F.expr(f"concat('a acme_', {hexes(24)}, CASE WHEN o_orderkey % 5 = 0 THEN 'b' ELSE ' b' END)")), config=ScanConfig(ruleset=RULESET)), "o_orderkey").select("o_orderkey", "type", "confidence", "action", "start", "end"),
    "SELECT o_orderkey, 'acme-internal-token' AS type, 'medium' AS confidence, 'warn' AS action, 2 AS start, 31 AS \"end\" FROM orders WHERE o_orderkey % 5 <> 0",
)
_add(
    "ruleset_names_documents",
    lambda spark, d: explode_findings(scan(_read(spark, d, "documents", "doc_id", "text"), config=ScanConfig(ruleset=RULESET)), "doc_id").where("detector = 'ruleset-names'").select("doc_id", "type", "confidence", F.col("end") - F.col("start")).toDF("doc_id", "type", "confidence", "n"),
    """WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '(^|[\\s{,;"''\\[(?&#])token = "([0-9a-f]{40})"', 2)) AS v FROM documents),
        k AS (SELECT *, row_number() OVER () AS k FROM m),
        c AS (SELECT doc_id, k, count(*) AS n FROM (SELECT doc_id, k, unnest(string_split(v, '')) AS ch FROM k) WHERE ch <> '' GROUP BY doc_id, k, ch)
        SELECT doc_id, 'contextual_secret' AS type, 'medium' AS confidence, 40 AS n FROM (SELECT doc_id, k, -sum(n / 40.0 * log2(n / 40.0)) AS h FROM c GROUP BY doc_id, k) WHERE h >= 3.5""",
)

# --- text functions --------------------------------------------------------

_add(
    "normalize_invisible",
    lambda spark, d: _read(spark, d, "documents", "doc_id", "text").select("doc_id", F.md5(T.normalize(F.concat(F.substring("text", 1, 7), F.lit("​­"), F.expr("substring(text, 8)")))).alias("digest")),
    "SELECT doc_id, md5(regexp_replace(text, '[​­‍﻿]', '', 'g')) AS digest FROM documents",
)
_add(
    "entropy",
    lambda spark, d: _read(spark, d, "orders", "o_orderkey").select("o_orderkey", F.round(T.entropy_column(F.expr(hexes(32))), 6).alias("bits")),
    f"WITH t AS (SELECT o_orderkey, unnest(string_split({hexes(32)}, '')) AS ch FROM orders), c AS (SELECT o_orderkey, count(*) / 32.0 AS p FROM t GROUP BY o_orderkey, ch) SELECT o_orderkey, round(-sum(p * log2(p)), 6) AS bits FROM c GROUP BY o_orderkey",
)
_add(
    "identifier",
    lambda spark, d: _read(spark, d, "part", "p_partkey", "p_name").select("p_partkey", T.is_identifier(F.translate("p_name", " ", "-")).alias("ok")),
    "SELECT p_partkey, regexp_matches(translate(p_name, ' ', '-'), '^[a-z][a-z0-9]*([._-][a-z0-9]+)*$') AND strlen(p_name) <= 64 AS ok FROM part",
)
_DIGITS = "concat('4', lpad(cast(o_orderkey * 7919 % 1000000000 as string), 9, '0'), lpad(cast(o_custkey * 104729 % 1000000 as string), 6, '0'))"
_add(
    "luhn",
    lambda spark, d: _read(spark, d, "orders", "o_orderkey", "o_custkey").select("o_orderkey", F.expr(f"luhn_check({_DIGITS})").alias("ok")),
    f"""WITH t AS (SELECT o_orderkey, {_DIGITS} AS v FROM orders), d AS (SELECT o_orderkey, (ord(v[17 - i]) - 48) * (2 - i % 2) AS x FROM t, range(1, 17) r(i))
        SELECT o_orderkey, sum(x - CASE WHEN x > 9 THEN 9 ELSE 0 END) % 10 = 0 AS ok FROM d GROUP BY o_orderkey""",
)
_add(
    "us_ssn_allocation",
    lambda spark, d: _read(spark, d, "orders", "o_orderkey").select("o_orderkey", T.ssn_column(F.expr("lpad(cast(o_orderkey * 99991 % 1000000000 as string), 9, '0')")).alias("ok")),
    "SELECT o_orderkey, substr(v, 1, 3) NOT IN ('000', '666') AND v[1] <> '9' AND substr(v, 4, 2) <> '00' AND substr(v, 6, 4) <> '0000' AS ok FROM (SELECT o_orderkey, lpad(cast(o_orderkey * 99991 % 1000000000 as string), 9, '0') AS v FROM orders)",
)
_IBAN = "concat('GB', lpad(cast(98 - cast(concat(lpad(cast(o_orderkey % 10000 as string), 4, '0'), '161100') as bigint) % 97 as string), 2, '0'), lpad(cast(o_orderkey % 10000 as string), 4, '0'))"
_add(
    "iban_mod97",
    lambda spark, d: _read(spark, d, "orders", "o_orderkey").select("o_orderkey", T.iban_column(F.expr(_IBAN)).alias("ok"), T.iban_column(F.concat(F.expr(_IBAN), F.lit("7"))).alias("other")),
    f"SELECT o_orderkey, cast(concat(substr(v, 5), '1611', substr(v, 3, 2)) as bigint) % 97 = 1 AS ok, cast(concat(substr(v, 5), '7', '1611', substr(v, 3, 2)) as bigint) % 97 = 1 AS other FROM (SELECT o_orderkey, {_IBAN} AS v FROM orders)",
)
_add(
    "offsets_code_points",
    lambda spark, d: _read(spark, d, "documents", "doc_id", "text").withColumn("b", T.byte_start(F.col("text"), F.lit("é"))).where("b is not null").select("doc_id", F.col("b").alias("bytes"), T.code_points(F.col("text"), F.col("b")).alias("points")),
    "SELECT doc_id, strlen(substr(text, 1, strpos(text, 'é') - 1)) AS bytes, strpos(text, 'é') - 1 AS points FROM documents WHERE strpos(text, 'é') > 0",
)

# --- personal data ---------------------------------------------------------


def _identities(spark: SparkSession, sf_dir: str, families: tuple[str, ...]) -> DataFrame:

    from saltmarsh.operators import pii

    @F.pandas_udf("array<struct<family: string, start: int, end: int, value: string>>")
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"family": i.family, "start": i.start, "end": i.end, "value": t[i.start : i.end]} for i in pii.identities(t or "", families)])

    return _read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.explode(find("text")).alias("f")).select("doc_id", "f.*")


_add(
    "pii_identity_cards",
    lambda spark, d: _identities(spark, d, ("payment-card",)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")),
    None,
)
_add(
    "pii_identity_addresses",
    lambda spark, d: _identities(spark, d, ("network-address", "email")).groupBy("doc_id", "family").agg(F.count(F.lit(1)).alias("n")),
    None,
)
_PII_TEXT = (
    "CASE o_orderkey % 5 WHEN 0 THEN concat('ssn: 219-09-', lpad(cast(o_orderkey % 9000 + 1000 as string), 4, '0')) WHEN 1 THEN concat('client ip = 10.', cast(o_orderkey % 200 as string), '.7.9') "
    "WHEN 2 THEN concat('email: user', cast(o_orderkey as string), '@mail-host.dev') WHEN 3 THEN concat('note 219-09-', lpad(cast(o_orderkey % 9000 + 1000 as string), 4, '0')) ELSE concat('phone: 415-234-', lpad(cast(o_orderkey % 9000 + 1000 as string), 4, '0')) END"
)
_add(
    "pii_sensitive",
    lambda spark, d: scan_and_redact(_keys(spark, d, "orders", "o_orderkey").withColumn("text", F.expr(_PII_TEXT)), config=ScanConfig(profile="common", pii=("pii:us",)), typed=True).select("o_orderkey", "text"),
    "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'ssn: <PII_JURISDICTION_US_SSN_1>' WHEN 1 THEN 'client ip = <PII_GLOBAL_NETWORK_ADDRESS_1>' WHEN 2 THEN 'email: <PII_GLOBAL_EMAIL_1>' WHEN 3 THEN concat('note 219-09-', lpad(cast(o_orderkey % 9000 + 1000 as string), 4, '0')) ELSE 'phone: <PII_GLOBAL_PHONE_1>' END AS text FROM orders",
)

# --- comparison, numbering, evidence --------------------------------------


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").select("l_orderkey", F.expr("cast(l_linenumber * 20 as int)").alias("start"), F.expr("cast(l_linenumber * 20 + l_quantity as int)").alias("end"))


_add(
    "overlap_clusters",
    lambda spark, d: compare.clusters(_ranges(spark, d), "l_orderkey").groupBy("l_orderkey").agg(F.max("cluster").alias("clusters")),
    """WITH r AS (SELECT l_orderkey, (l_linenumber * 20)::INT AS s, (l_linenumber * 20 + l_quantity)::INT AS e FROM lineitem),
        o AS (SELECT l_orderkey, CASE WHEN coalesce(max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) <= s THEN 1 ELSE 0 END AS o FROM r)
        SELECT l_orderkey, sum(o)::BIGINT AS clusters FROM o GROUP BY l_orderkey""",
)


def _configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _structured(spark, sf_dir)
    both = [explode_findings(scan(texts, config=c), "o_orderkey") for c in (ScanConfig(exclude=("jwt",)), ScanConfig(exclude=("sendgrid-token", "doppler-token")))]
    return compare.compare_configurations(both[0], both[1], "o_orderkey").select("o_orderkey", "start", "end", "n_base", "n_other", "relation", "changes")


_add(
    "compare_configurations",
    _configurations,
    f"""SELECT o_orderkey, start, "end", (detector <> 'jwt')::BIGINT AS n_base, (detector NOT IN ('sendgrid-token', 'doppler-token'))::BIGINT AS n_other,
        CASE WHEN detector = 'jwt' THEN 'added' WHEN detector IN ('sendgrid-token', 'doppler-token') THEN 'removed' ELSE 'unchanged' END AS relation, '' AS changes FROM ({_structured_sql(FOUND)})""",
)
_add(
    "request_numbering",
    lambda spark, d: compare.number_request(_read(spark, d, "conversations", "conv_id", "turn", "text").withColumn("n", F.length("text") % 4), "conv_id", "turn", "n").select("conv_id", "turn", F.col("offset").cast("long").alias("offset")),
    "SELECT conv_id, turn, coalesce(sum(length(text) % 4) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM conversations",
)


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _keys(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", F.expr(f"concat('Aa-', {hexes(32)})").alias("v"))
    f = values.select("o_orderkey", evidence.features_column(F.col("v")).alias("f"))
    return f.select("o_orderkey", *[F.col(f"f.{c}").alias(c) for c in ("byte_len", "distinct_symbols", "class_lower", "class_digit", "class_count", "longest_run", "adjacent_repeat_permille")])


_CHARS = f"(SELECT o_orderkey, i, v[i] AS c FROM (SELECT o_orderkey, concat('Aa-', {hexes(32)}) AS v FROM orders), range(1, 36) r(i))"
_add(
    "evidence_features",
    _evidence,
    f"""WITH c AS {_CHARS}, p AS (SELECT *, lag(c) OVER (PARTITION BY o_orderkey ORDER BY i) = c AS same FROM c), g AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY o_orderkey ORDER BY i) AS run FROM p),
        l AS (SELECT o_orderkey, max(n) AS longest FROM (SELECT o_orderkey, run, count(*) AS n FROM g GROUP BY ALL) GROUP BY ALL)
        SELECT o_orderkey, 35::BIGINT AS byte_len, count(DISTINCT c) AS distinct_symbols, count(*) FILTER (c BETWEEN 'a' AND 'z') AS class_lower, count(*) FILTER (c BETWEEN '0' AND '9') AS class_digit,
        (2 + (count(*) FILTER (c BETWEEN 'a' AND 'z') > 0)::INT + (count(*) FILTER (c BETWEEN '0' AND '9') > 0)::INT)::BIGINT AS class_count, any_value(longest) AS longest_run, (1000 * count(*) FILTER (same) // 34)::BIGINT AS adjacent_repeat_permille
        FROM p JOIN l USING (o_orderkey) GROUP BY o_orderkey""",
)
_add(
    "evidence_bands",
    lambda spark, d: _read(spark, d, "orders", "o_orderkey").select(
        "o_orderkey",
        evidence.score(F.col("o_orderkey") * 37 % 60000 + 220000, F.when(F.col("o_orderkey") % 2 == 0, "credential-name").otherwise("none"), F.col("o_orderkey") % 11 == 0).alias("score"),
    ).withColumn("band", evidence.band(F.col("score"))).select("o_orderkey", "score", "band"),
    """SELECT o_orderkey, score, CASE WHEN score >= 51 THEN 'high' WHEN score >= 40 THEN 'medium' WHEN score >= 35 THEN 'low' ELSE 'none' END AS band FROM (SELECT o_orderkey, greatest(0,
        least(30, greatest(0, floor(30.0 * (o_orderkey * 37 % 60000 + 220000 - 234123) / 29439)::INT)) + CASE WHEN o_orderkey % 2 = 0 THEN 50 ELSE 0 END - CASE WHEN o_orderkey % 11 = 0 THEN 130 ELSE 0 END)::INT AS score FROM orders)""",
)

# --- whole tables ----------------------------------------------------------


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents scanned and redacted with every detector, personal data and a ruleset."""
    config = ScanConfig(pii=("pii:us",), ruleset=RULESET)
    clean = scan_and_redact(_read(spark, sf_dir, "documents", "doc_id", "text"), config=config)
    return clean.select("doc_id", "text", F.size("findings").alias("findings"), F.col("error.code").alias("error"))


_add("scan_documents", flagship)
_add("scan_pages", lambda spark, d: scan(_read(spark, d, "pages", "page_id", "html"), "html").select("page_id", F.size("findings").alias("findings")))
_add("scan_conversations", lambda spark, d: scan(_read(spark, d, "conversations", "conv_id", "turn", "text")).select("conv_id", "turn", F.size("findings").alias("findings")))
_add(
    "limits",
    lambda spark, d: scan(_read(spark, d, "documents", "doc_id", "text"), config=ScanConfig(most_bytes=4000)).select("doc_id", F.col("error.code").alias("error")),
    "SELECT doc_id, CASE WHEN strlen(text) > 4000 THEN 'INPUT_TOO_LARGE' END AS error FROM documents",
)


def _streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a token, cut into three chunks wherever they fall, and put together again by sessions."""
    from saltmarsh.streaming.session import sanitize_batch

    texts = _read(spark, sf_dir, "customer", "c_custkey").withColumn("text", F.expr(f"concat('line one', chr(10), 'key npm_', {hexes(36, 'c_custkey')}, ' end', chr(10), 'tail')"))
    at = F.col("c_custkey") % 40 + 10
    cut = F.array(
        F.struct(F.lit(0).alias("seq"), F.lit("append").alias("op"), F.substring("text", F.lit(1), at).alias("chunk")),
        F.struct(F.lit(1).alias("seq"), F.lit("append").alias("op"), F.substring("text", at + 1, F.lit(5)).alias("chunk")),
        F.struct(F.lit(2).alias("seq"), F.lit("append").alias("op"), F.substring("text", at + 6, F.lit(1000)).alias("chunk")),
        F.struct(F.lit(3).alias("seq"), F.lit("finalize").alias("op"), F.lit("").alias("chunk")),
    )
    chunks = texts.select(F.col("c_custkey").cast("string").alias("stream_id"), F.inline(cut))
    return sanitize_batch(chunks).select("stream_id", "text", "state", "findings")


_add("stream_sessions", _streams, "SELECT c_custkey::VARCHAR AS stream_id, concat('line one', chr(10), 'key <SECRET_1> end', chr(10), 'tail') AS text, 'finalized' AS state, 1::BIGINT AS findings FROM customer")


_NESTED = f"concat('{{\"api_key\": \"', {hexes(32, 'c_custkey')}, '\", \"list\": [\"n ', cast(c_custkey as string), '\", null]}}')"
_add(
    "nested_values",
    lambda spark, d: _keys(spark, d, "customer", "c_custkey").select("c_custkey", sanitize_json(F.expr(_NESTED)).alias("s")).select("c_custkey", "s.outcome", "s.value", "s.findings"),
    "SELECT c_custkey, 'ok' AS outcome, concat('{\"api_key\": \"<SECRET_1>\", \"list\": [\"n ', cast(c_custkey as string), '\", null]}') AS value, 1 AS findings FROM customer",
)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


__all__ = ["flagship", "oracle_sql", "queries", "redact"]
