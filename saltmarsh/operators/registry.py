"""The built-in detectors, in order: their ids, finding types and token formats.

The formats are fixed values. A format is a literal prefix and a body: a letter for its
alphabet, then its length. ``36`` is exact, ``22|24`` one of several (longest first),
``20+`` that many or more, ``20~`` the same but cut at 20 where a dash or underscore follows
there. Detectors that need more than a format have a function of ``contextual`` or a check
of ``checks`` by name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

ALPHABETS = {
    "A": "A-Za-z0-9",
    "W": "A-Za-z0-9_-",
    "h": "0-9a-f",
    "x": "0-9A-Fa-f-",
    "l": "a-z0-9",
    "U": "A-Z0-9",
    "B": "A-Za-z0-9+/",
    "D": "A-Za-z0-9_.-",
    "_": "A-Za-z0-9_",
    "P": "A-Za-z0-9.",
    "F": "A-Za-z0-9_+/-",
    "S": "1-9A-HJ-NP-Za-km-z",
}
EDGE = "A-Za-z0-9_-"

# id; type (or "by prefix": type for the prefixes in order); formats; then edge= alphabet that may
# not stand beside a match, check= a further condition, regex= for formats of several parts.
TABLE = """
private-key; private_key; ; reader=private_key
aws-access-key; aws_access_key_id; AKIA U16, ASIA U16; edge=A-Za-z0-9
aws-secret-access-key; aws_secret_access_key; ; reader=aws_secret
aws-bedrock-long-term-api-key; aws_bedrock_long_term_api_key; ; regex=ABSK[A-Za-z0-9+/]{109,269}={0,2}; edge=A-Za-z0-9+/=; check=bedrock_head
aws-bedrock-short-term-api-key; aws_bedrock_short_term_api_key; bedrock-api-key-YmVkcm9jay5hbWF6b25hd3MuY29t B64+; edge=A-Za-z0-9+/_-
github-token; github_token, github_oauth_token, github_app_user_to_server_token, github_app_installation_token, github_app_refresh_token, github_fine_grained_personal_access_token; ghp_ A36, gho_ A36, ghu_ A36, ghs_ D36+, ghr_ A36, github_pat_ _82; edge=A-Za-z0-9_; check=github
gitlab-token; gitlab_token; glpat- W20+, gloas- W20+, gldt- W20+, glrtr- W20+, glcbt- W20+, glptt- W20+, glft- W20+, glimt- W20+, glagent- W20+, glsoat- W20+, glffct- W20+, glwt- W20+
openai-token; openai_admin_api_key, openai_api_key; ; regex=(?:sk-[A-Za-z0-9]{20}T3BlbkFJ[A-Za-z0-9]{20}|sk-(?:proj|svcacct|admin)-(?:[A-Za-z0-9_-]{74}T3BlbkFJ[A-Za-z0-9_-]{74}|[A-Za-z0-9_-]{58}T3BlbkFJ[A-Za-z0-9_-]{58})); check=openai
anthropic-token; anthropic_api_key, anthropic_enterprise_api_key, anthropic_admin_api_key; sk-ant-api03- W20+, sk-ant-api01- W20+, sk-ant-admin01- W20+
shopify-token; shopify_access_token; shpat_ W20+, shppa_ W20+
vault-token; vault_token; hvs. W24+, hvb. W24+, hvr. W24+; edge=A-Za-z0-9_.-
stripe-token; stripe_credential, stripe_webhook_signing_secret; ; regex=(?:(?:sk|rk)_(?:test|live)_[A-Za-z0-9]{20,}|sk_org_(?:live_|test_)?[A-Za-z0-9]{20,}|whsec_[A-Za-z0-9+/]{32,}={0,2}); check=stripe
slack-token; slack_token, slack_user_token, slack_app_level_token; ; regex=(?:xoxb-[0-9]{10,13}-[0-9]{10,13}-[A-Za-z0-9]{18,}|xoxp-[0-9]+-[0-9]+-[0-9]+-[A-Za-z0-9]+|(?:xoxe\\.xoxb|xoxe\\.xoxp|xoxe)-[0-9]-[A-Za-z0-9_-]{20,}|xapp-[0-9]+-[A-Za-z0-9]+-[0-9]+-[A-Za-z0-9]+|xwfp-[A-Za-z0-9_-]{20,}); check=slack
pypi-token; pypi_api_token; pypi- W85+
huggingface-token; huggingface_token; hf_ A34, api_org_ A34
docker-token; docker_token; dckr_pat_ W27, dckr_oat_ W27|32
cloudflare-token; cloudflare_api_token; cfut_ A48, cfat_ A48; check=cloudflare
digitalocean-token; digitalocean_token; dop_v1_ h64, doo_v1_ h64, dor_v1_ h64
linear-token; linear_token; lin_api_ A40, lin_oauth_ W20~
supabase-token; supabase_secret_key; sb_secret_ W31; check=supabase
supabase-management-token; supabase_personal_access_token; sbp_v0_ l40, sbp_ l40
vercel-token; vercel_token; vcp_ W20+, vci_ W20+, vca_ W20+, vcr_ W20+, vck_ W20+; check=vercel
npm-token; npm_access_token; npm_ A36
google-api-key; google_api_key; AIza W35
google-oauth-client-secret; google_oauth_client_secret; GOCSPX- W28
sendgrid-token; sendgrid_api_key; ; regex=SG\\.[A-Za-z0-9_-]{22}\\.[A-Za-z0-9_-]{43}
microsoft-entra-client-secret; microsoft_entra_client_secret; ; regex=[A-Za-z0-9_~.-]{3}[0-9]Q~[A-Za-z0-9_~.-]{31,34}; edge=A-Za-z0-9_~.-
azure-devops-personal-access-token; azure_devops_personal_access_token; ; regex=[A-Za-z0-9]{76}AZDO[A-Za-z0-9]{4}
notion-token; notion_integration_token; ; regex=(?:secret_[A-Za-z0-9]{43}|ntn_[0-9]{11}[A-Za-z0-9]{35})
atlassian-api-token; atlassian_api_token; ; regex=ATAT[A-Za-z0-9_-]{100,}(?:=[0-9A-F]{8}(?![A-Za-z0-9_-]))?
twilio-auth-token; twilio_auth_token; ; reader=twilio_auth
twilio-api-key-secret; twilio_api_key_secret; ; reader=twilio_secret
telegram-bot-token; telegram_bot_token; ; regex=(?:(?<=/bot)|(?<![A-Za-z0-9_-]))[0-9]{5,}+:[A-Za-z0-9_-]{34,}; edge=; check=telegram
discord-bot-token; discord_bot_token; ; reader=discord
sentry-user-auth-token; sentry_user_auth_token; sntryu_ h64; edge=A-Za-z0-9_
sentry-org-auth-token; sentry_org_auth_token; ; regex=sntrys_eyJ[A-Za-z0-9+/]{23,}={0,2}_[A-Za-z0-9+/]{43}
datadog-api-key; datadog_api_key; ; reader=datadog_api
datadog-application-key; datadog_application_key; ddapp_ A34
datadog-application-key-legacy; datadog_application_key_legacy; ; reader=datadog_app
grafana-service-account-token; grafana_service_account_token; ; regex=glsa_[A-Za-z0-9]{32}_[0-9A-Fa-f]{8}
grafana-cloud-access-policy-token; grafana_cloud_access_policy_token; glc_ B32+
new-relic-user-api-key; new_relic_user_api_key; NRAK- U27; edge=A-Za-z0-9
new-relic-license-key; new_relic_license_key; ; reader=new_relic_license
mailchimp-api-key; mailchimp_api_key; ; reader=mailchimp
mailgun-api-key; mailgun_api_key; ; reader=mailgun
okta-api-token; okta_api_token; ; reader=okta
firebase-server-key; firebase_server_key; ; regex=AAAA[A-Za-z0-9_-]{7}:[A-Za-z0-9_-]{140}
terraform-cloud-token; terraform_cloud_token; ; regex=[A-Za-z0-9]{14}\\.atlasv1\\.[A-Za-z0-9_=-]{67}
pulumi-access-token; pulumi_access_token; pul- h40
replicate-api-token; replicate_api_token; r8_ W37
groq-api-key; groq_api_key; gsk_ A52
xai-api-key; xai_api_key; xai- W80
openrouter-api-key; openrouter_api_key; sk-or-v1- h64
perplexity-api-key; perplexity_api_key; pplx- A48
fireworks-ai-api-key; fireworks_ai_api_key; fw_ A22|24
elevenlabs-api-key; elevenlabs_api_key; ; regex=sk_[0-9a-f]{48}(?:_residency_[a-z0-9]+)?
together-ai-api-key; together_ai_api_key; tgp_v1_ W43
tavily-api-key; tavily_api_key; tvly-dev- A32, tvly- A32
pinecone-api-key; pinecone_api_key; ; reader=pinecone
gitlab-runner-authentication-token; gitlab_runner_authentication_token; glrt- W20+; check=gitlab_runner
databricks-personal-access-token; databricks_personal_access_token; dapi x32+; check=databricks
confluent-cloud-api-secret; confluent_cloud_api_secret; cflt B60; check=confluent; edge=A-Za-z0-9+/_-
confluent-cloud-api-secret-legacy; confluent_cloud_api_secret_legacy; ; reader=confluent_legacy
netlify-token; netlify_personal_access_token; nfp_ _36; check=varied
neon-api-key; neon_api_key; napi_ A64+; check=varied; edge=A-Za-z0-9_-
langsmith-api-key; langsmith_api_key; ; regex=lsv2_(?:pt|sk)_[0-9a-f]{32}_[0-9a-f]{10}
langfuse-secret-key; langfuse_secret_key; ; regex=sk-lf-[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}
postman-api-key; postman_api_key; PMAK- x59; check=postman
postman-collection-access-key; postman_collection_access_key; PMAT- A26; check=varied
heroku-api-key; heroku_api_key; HRKU-AA W58, HRKU- x36; check=heroku
heroku-api-key-legacy; heroku_api_key_legacy; ; reader=heroku_legacy
travisci-api-token; travisci_api_token; ; reader=travis
mistral-api-key; mistral_api_key; ; reader=mistral
cohere-api-key; cohere_api_key; ; reader=cohere
ai21-api-key; ai21_api_key; ; reader=ai21
deepgram-api-key; deepgram_api_key; ; reader=deepgram
doppler-token; doppler_service_token, doppler_personal_token, doppler_cli_token, doppler_service_account_token, doppler_service_account_identity_token, doppler_scim_token, doppler_audit_token; ; regex=dp\\.(?:st\\.(?:[a-z0-9_-]{2,35}\\.)?|pt\\.|ct\\.|said\\.|sa\\.|scim\\.|audit\\.)[A-Za-z0-9]{40,44}; check=doppler
trigger-dev-token; trigger_dev_secret_api_key, trigger_dev_secret_api_key, trigger_dev_secret_api_key, trigger_dev_secret_api_key, trigger_dev_personal_access_token; tr_dev_sk_ A24, tr_stg_sk_ A24, tr_prod_sk_ A24, tr_preview_sk_ A24, tr_pat_ A40
e2b-api-key; e2b_api_key; e2b_ h40
posthog-token; posthog_personal_api_key, posthog_project_secret_api_key; phx_ A42|43|44|45|46|47|48|49, phs_ A42|43|44|45|46|47|48|49
helicone-api-key; helicone_api_key, helicone_write_api_key; ; regex=(?:sk|pk)-helicone-(?:proxy-[a-z0-9]{7}(?:-[a-z0-9]{7}){3}-[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|(?:eu-)?(?:rl-)?[a-z0-9]{7}(?:-[a-z0-9]{7}){3}); check=helicone
firecrawl-api-key; firecrawl_api_key; fc- h32; check=firecrawl
composio-api-key; composio_project_api_key, composio_org_api_key, composio_user_api_key; ak_ W20, oak_ W20, uak_ W43; check=composio
convex-deployment-key; convex_deployment_key; ; regex=(?:(?:dev|prod|preview|project):)?[a-z0-9-]+(?::[a-z0-9-]+)?\\|01[0-9a-f]{74,96}; check=convex
onepassword-service-account-token; onepassword_service_account_token; ; regex=ops_eyJ[A-Za-z0-9_-]{250,}={0,2}
inngest-signing-key; inngest_signing_key; signkey-prod- h64, signkey-test- h64, signkey-branch- h64
resend-api-key; resend_api_key; re_ _33; check=resend
apify-api-token; apify_api_token; apify_api_ A20+; check=most128
wandb-api-key; wandb_api_key; wandb_v1_ _64+; edge=A-Za-z0-9_; check=wandb
daytona-api-key; daytona_api_key; dtn_ h64
clickhouse-cloud-api-secret; clickhouse_cloud_api_secret; 4b1d A38; check=has_upper
nvidia-api-key; nvidia_api_key; nvapi- W60+; check=most128
browserbase-api-key; browserbase_api_key; bb_live_ A20+; check=most128
runpod-api-key; runpod_api_key; rpa_ A31+; check=most128
cerebras-api-key; cerebras_api_key; csk- W48, csk_ W48
bitwarden-secrets-manager-access-token; bitwarden_secrets_manager_access_token; ; regex=0\\.[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\\.[A-Za-z0-9]{30}:[A-Za-z0-9+/]{22}==
polar-token; polar_organization_access_token, polar_api_credential; polar_oat_ A43, polar_pat_ W43, polar_at_u_ W43, polar_at_o_ W43, polar_rt_u_ W43, polar_rt_o_ W43, polar_cs_ W43, polar_crt_ W43
sonarqube-token; sonarqube_user_token, sonarqube_analysis_token; squ_ h40, sqa_ h40, sqp_ h40
rubygems-api-key; rubygems_api_key; rubygems_ h48
clojars-deploy-token; clojars_deploy_token; CLOJARS_ h60
crates-io-token; crates_io_trusted_publishing_token, crates_io_api_token; cio_tp_ A32, cio A32
dynatrace-token; dynatrace_token; ; regex=dt0[cs][0-9]{2}\\.[A-Z2-7]{24}\\.[A-Z2-7]{64}
paddle-api-key; paddle_api_key; pdl_live_apikey_ _53, pdl_sdbx_apikey_ _53; check=paddle
honeycomb-api-key; honeycomb_ingest_key; hc _62; check=honeycomb
axiom-token; axiom_api_token, axiom_personal_token; xaat- x36, xapt- x36; check=uuid_body
xata-api-key; xata_user_api_key, xata_organization_api_key; xau_ A32+, xao_ A32+; check=most36
sourcegraph-token; sourcegraph_access_token; sgp_ _40+; check=sourcegraph
unkey-root-key; unkey_root_key; unkey_ S24|57; check=unkey
buildkite-token; by prefix; ; regex=(?:bkua|bkur|bktx|bkaa|bkar|bkct|bkcqt|bkaj|bkjat|bkpt|bkrt|bktr|bkat|bkpat|bkps)_[A-Za-z0-9_.-]{24,2048}; check=buildkite
pydantic-logfire-token; pydantic_logfire_token; pylf_v W25+; check=logfire
square-token; square_access_token, square_oauth_application_secret, square_oauth_application_secret; EAAA W60, sq0csp- W43|44, sandbox-sq0csb- W43
mapbox-token; mapbox_secret_access_token; ; regex=sk\\.eyJ[A-Za-z0-9_-]{20,}\\.[A-Za-z0-9_-]{22}
fly-token; fly_access_token; ; regex=(?:fm1r|fm1a|fm2)_[A-Za-z0-9_+/-]{64,}={0,2}(?:,(?:fm1r|fm1a|fm2|fo1)_[A-Za-z0-9_+/-]{64,}={0,2})*
ory-token; ory_session_token, ory_oauth2_token; ; regex=(?:ory_st_[A-Za-z0-9]{32}|ory_(?:at|rt|ac)_[A-Za-z0-9_-]{43,}\\.[A-Za-z0-9_-]{43}); check=ory
baseten-api-key; baseten_api_key; b10_ P41; check=baseten
jwt; jwt; ; regex=eyJ[A-Za-z0-9_-]{5,}\\.eyJ[A-Za-z0-9_-]{5,}\\.[A-Za-z0-9_-]{16,}; check=jwt
bearer-token; bearer_token; ; reader=bearer
connection-string; connection_string_password; ; reader=connection_string
otpauth-uri; otpauth_secret; ; reader=otpauth
generic-token; contextual_secret; ; reader=generic
"""

#: Only these run in the ``common`` profile.
COMMON = ("private-key", "jwt", "bearer-token", "connection-string", "otpauth-uri", "generic-token")

SPECIFICITIES = ("entropy", "contextual", "structural", "provider", "private_key")
CONFIDENCES = ("low", "medium", "high")


@dataclass(frozen=True)
class Format:
    """A literal prefix and what follows it."""

    prefix: str
    alphabet: str
    lengths: tuple[int, ...]
    open: str  # "", "+" or "~"
    type: str

    def pattern(self, edge: str, longer: tuple[str, ...] = ()) -> str:
        """Regular expression of the prefix, unless a longer one starts there, and its body."""
        cls = f"[{ALPHABETS[self.alphabet]}]"
        ahead = "".join(f"(?!{re.escape(p[len(self.prefix) :])})" for p in longer)
        n = self.lengths[0]
        if self.open == "+":
            body = f"{cls}{{{n},}}"
        elif self.open == "~":
            body = f"(?:{cls}{{{n}}}(?=[-_])|{cls}{{{n},}})"
        elif len(self.lengths) > 1:
            body = "(?:" + "|".join(f"{cls}{{{k}}}(?![{edge}])" for k in sorted(self.lengths, reverse=True)) + ")"
        else:
            body = f"{cls}{{{n}}}"
        return re.escape(self.prefix) + ahead + body


@dataclass(frozen=True)
class Detector:
    id: str
    types: tuple[str, ...]
    formats: tuple[Format, ...]
    regex: str
    edge: str
    check: str
    reader: str
    order: int

    @property
    def pattern(self) -> str:
        """What finds candidates, before checks and edges; none for readers."""
        if self.regex:
            return self.regex
        by_length = sorted(self.formats, key=lambda f: -len(f.prefix))
        parts = [f.pattern(self.edge, tuple(o.prefix for o in by_length if o.prefix != f.prefix and o.prefix.startswith(f.prefix))) for f in by_length]
        return "|".join(parts)

    @property
    def literals(self) -> tuple[str, ...]:
        """Strings of which a text with a match has one; none: any text may have a match."""
        if self.formats:
            return tuple(f.prefix for f in self.formats)
        return LITERALS.get(self.id, ())


# What the detectors without plain prefixes need in a text, as fixed values. Lower case: in any case.
LITERALS = {
    "private-key": ("-----BEGIN ",),
    "aws-secret-access-key": ("secret", "akia", "asia"),
    "aws-bedrock-long-term-api-key": ("ABSK",),
    "openai-token": ("T3BlbkFJ",),
    "stripe-token": ("sk_test_", "sk_live_", "rk_test_", "rk_live_", "sk_org_", "whsec_"),
    "slack-token": ("xoxb-", "xoxp-", "xoxe", "xapp-", "xwfp-"),
    "sendgrid-token": ("SG.",),
    "microsoft-entra-client-secret": ("Q~",),
    "azure-devops-personal-access-token": ("AZDO",),
    "notion-token": ("secret_", "ntn_"),
    "atlassian-api-token": ("ATAT",),
    "twilio-auth-token": ("twilio", "AC"),
    "twilio-api-key-secret": ("twilio", "SK"),
    "telegram-bot-token": (":",),
    "discord-bot-token": (".",),
    "sentry-org-auth-token": ("sntrys_",),
    "datadog-api-key": ("datadog", "dd_api_key", "dd-api-key"),
    "datadog-application-key-legacy": ("datadog", "dd_app", "dd-app"),
    "grafana-service-account-token": ("glsa_",),
    "new-relic-license-key": ("FFFFNRAL", "relic"),
    "mailchimp-api-key": ("-us",),
    "mailgun-api-key": ("mailgun", "key-"),
    "okta-api-token": ("okta", "ssws"),
    "firebase-server-key": ("AAAA",),
    "terraform-cloud-token": (".atlasv1.",),
    "elevenlabs-api-key": ("sk_",),
    "pinecone-api-key": ("pcsk_", "pinecone"),
    "confluent-cloud-api-secret-legacy": ("confluent",),
    "langsmith-api-key": ("lsv2_",),
    "langfuse-secret-key": ("sk-lf-",),
    "heroku-api-key-legacy": ("heroku",),
    "travisci-api-token": ("travis",),
    "mistral-api-key": ("mistral",),
    "cohere-api-key": ("cohere", "co_api_key"),
    "ai21-api-key": ("ai21",),
    "deepgram-api-key": ("deepgram",),
    "doppler-token": ("dp.",),
    "helicone-api-key": ("-helicone-",),
    "convex-deployment-key": ("|01",),
    "onepassword-service-account-token": ("ops_eyJ",),
    "bitwarden-secrets-manager-access-token": ("==",),
    "dynatrace-token": ("dt0c", "dt0s"),
    "buildkite-token": ("bkua_", "bkur_", "bktx_", "bkaa_", "bkar_", "bkct_", "bkcqt_", "bkaj_", "bkjat_", "bkpt_", "bkrt_", "bktr_", "bkat_", "bkpat_", "bkps_"),
    "mapbox-token": ("sk.eyJ",),
    "fly-token": ("fm1r_", "fm1a_", "fm2_"),
    "ory-token": ("ory_",),
    "jwt": ("eyJ",),
    "bearer-token": ("bearer", "authorization", "secret-token:"),
    "connection-string": ("://", "AccountKey="),
    "otpauth-uri": ("otpauth://",),
    "generic-token": ("key", "secret", "passw", "token", "pass", "auth", "credential", "verifier", "code=", "_art_api", "curl", "sk-"),
}
#: Detectors whose lower-case literals count in any case.
FOLDED = frozenset(
    "aws-secret-access-key twilio-auth-token twilio-api-key-secret datadog-api-key datadog-application-key-legacy new-relic-license-key mailgun-api-key okta-api-token pinecone-api-key confluent-cloud-api-secret-legacy "
    "heroku-api-key-legacy travisci-api-token mistral-api-key cohere-api-key ai21-api-key deepgram-api-key bearer-token generic-token".split()
)


def _parse(line: str, order: int) -> Detector:
    name, types, formats, *extra = (x.strip() for x in line.split("; ") if x is not None)
    options = dict(x.rstrip(";").split("=", 1) for x in extra)
    names = tuple(t.strip() for t in types.split(","))
    made = []
    for k, item in enumerate(f.strip() for f in formats.rstrip(";").split(",") if f.strip()):
        prefix, body = item.split(" ")
        lengths, mark = body[1:].rstrip("+~"), body[-1] if body[-1] in "+~" else ""
        made.append(Format(prefix, body[0], tuple(int(n) for n in lengths.split("|")), mark, names[min(k, len(names) - 1)]))
    return Detector(name, names, tuple(made), options.get("regex", ""), options.get("edge", EDGE), options.get("check", ""), options.get("reader", ""), order)


@cache
def detectors() -> tuple[Detector, ...]:
    lines = [x.replace(";  ;", "; ;") for x in TABLE.strip().split("\n")]
    return tuple(_parse(re.sub(r"; ;", "; ; ", line).replace("; ;  ", "; ; "), k) for k, line in enumerate(lines))


def by_id() -> dict[str, Detector]:
    return {d.id: d for d in detectors()}
