"""SQL that works out the same results on the same tables, for DuckDB.

The texts are built from common table expressions: `ev` are the audit events of
the `events` table, `fx` their features, `vd` the verdicts of the pinned linear
scorer. Trailing windows, ranks and splits are written in the plain form that
the Spark side avoids on purpose.
"""

from __future__ import annotations

from auditlens import constants as K
from auditlens.operators.gate import protected_names


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _in(names) -> str:
    return "(" + ", ".join(_quote(n) for n in names) + ")"


def _case(col: str, table: dict, default: str | None = None) -> str:
    whens = " ".join(
        f"WHEN {k if isinstance(k, int) else _quote(k)} THEN {_quote(v)}" for k, v in table.items()
    )
    tail = f" ELSE {default}" if default is not None else ""
    return f"CASE {col} {whens}{tail} END"


EV = """
b AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k
  FROM events),
n AS (
  SELECT b.*,
    CASE WHEN user_id % 29 = 0 THEN 'Admin' WHEN user_id % 31 = 0 THEN 'root'
         ELSE 'u' || CAST(user_id AS VARCHAR) END AS uname,
    CASE event_type
    WHEN 'click' THEN CASE k % 4 WHEN 0 THEN 'DescribeInstances' WHEN 1 THEN 'ListBuckets'
                                 WHEN 2 THEN 'DescribeSecurityGroups' ELSE 'RunInstances' END
    WHEN 'view' THEN CASE k % 4 WHEN 0 THEN 'GetObject' WHEN 1 THEN 'PutObject'
                                WHEN 2 THEN 'Decrypt' ELSE 'GetSecretValue' END
    WHEN 'purchase' THEN CASE k % 3 WHEN 0 THEN 'AssumeRole' WHEN 1 THEN 'SendCommand'
                                    ELSE 'StartSession' END
    WHEN 'signup' THEN CASE k % 5 WHEN 0 THEN 'AttachUserPolicy' WHEN 1 THEN 'PutUserPolicy'
                                  WHEN 2 THEN 'CreateAccessKey' WHEN 3 THEN 'CreateLoginProfile'
                                  ELSE 'CreateRole' END
    ELSE 'ConsoleLogin' END AS event_name
  FROM b),
ev AS (
SELECT event_id, user_id, ts AS event_time, event_type, k, value, event_name,
  CASE event_type
    WHEN 'click' THEN 'ec2.amazonaws.com'
    WHEN 'view' THEN CASE WHEN k % 4 = 2 THEN 'kms.amazonaws.com'
                          WHEN k % 4 = 3 THEN 'secretsmanager.amazonaws.com'
                          ELSE 's3.amazonaws.com' END
    WHEN 'purchase' THEN CASE WHEN k % 3 = 0 THEN 'sts.amazonaws.com' ELSE 'ssm.amazonaws.com' END
    WHEN 'signup' THEN 'iam.amazonaws.com'
    ELSE 'signin.amazonaws.com' END AS event_source,
  'IAMUser' AS identity_type,
  CASE WHEN k % 17 = 0 THEN '' WHEN k % 19 = 0 THEN NULL
       ELSE 'arn:aws:iam::123456789012:user/' || uname END AS arn,
  CASE WHEN k % 19 <> 0 THEN uname END AS user_name,
  CASE WHEN k % 3 = 0 THEN 'true' WHEN k % 3 = 1 THEN 'false' END AS mfa,
  '203.0.113.' || CAST((user_id * 7 + k) % 254 AS VARCHAR) AS source_ip,
  CASE k % 4 WHEN 0 THEN 'aws-cli/2.13.0' WHEN 1 THEN 'Boto3/1.34.0 Python/3.11'
             WHEN 2 THEN '' ELSE 'Mozilla/5.0' END AS user_agent,
  CASE WHEN event_type = 'error' THEN CASE k % 3 WHEN 0 THEN 'AccessDenied'
       WHEN 1 THEN 'Client.UnauthorizedOperation' ELSE 'InvalidInstanceId' END END AS error_code,
  CASE WHEN k % 5 = 0 THEN NULL ELSE '123456789012' END AS account_id,
  CASE WHEN k % 7 = 0 THEN '987654321098' ELSE '123456789012' END AS recipient_account_id,
  CASE WHEN k % 13 <> 0 THEN ['arn:aws:s3:::b' || CAST(k % 3 AS VARCHAR),
                              'arn:aws:s3:::b' || CAST(k % 5 AS VARCHAR),
                              'arn:aws:s3:::b' || CAST(user_id % 2 AS VARCHAR)] END AS resources,
  k % 10 AS login_freq_1h,
  CAST(k AS DOUBLE) / 20 AS geo_anomaly_score,
  value / 4 AS api_burst_rate,
  value * 3 AS data_exfil_volume_mb,
  CAST(k % 11 AS DOUBLE) / 10 AS lateral_movement_score,
  CASE WHEN event_id % 10 = 0 THEN 0
       WHEN event_name IN ('AttachUserPolicy','PutUserPolicy','CreateLoginProfile') THEN 2
       WHEN event_name IN ('GetSecretValue','Decrypt') THEN 3
       WHEN event_name IN ('SendCommand','StartSession','RunInstances') THEN 4
       WHEN event_name = 'AssumeRole' THEN 1 ELSE 0 END AS label
FROM n)"""

PRINCIPAL = "coalesce(nullif(arn, ''), nullif(user_name, ''), 'unknown-principal')"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^.*[/:]', '')"


def features(src: str, dst: str, keep: str = "") -> str:
    """A CTE with the 32 features of the events in src."""
    off = (
        "(date_part('hour', event_time) * 3600000000 + date_part('minute', event_time) * 60000000"
        " + date_part('microsecond', event_time)"
    )
    off = f"({off}) < 32400000000 OR {off}) > 64800000000)"
    exprs = {f: f"CAST({d} AS DOUBLE)" for f, d in K.PASS_THROUGH_DEFAULTS.items()}
    for f in ("login_freq_1h", "geo_anomaly_score", "api_burst_rate", "data_exfil_volume_mb",
              "lateral_movement_score"):
        exprs[f] = f"coalesce(CAST(s.{f} AS DOUBLE), 0)"

    def flag(cond: str) -> str:
        return f"CASE WHEN {cond} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"

    exprs["resource_entropy"] = (
        "coalesce(list_sum(list_transform(list_distinct(resources), lambda x:"
        " -(len(list_filter(resources, lambda y: y = x)) / len(resources)) *"
        " log2(len(list_filter(resources, lambda y: y = x)) / len(resources) + 1e-10::DOUBLE))), 0)"
    )
    exprs["priv_api_call_freq"] = flag(f"event_name IN {_in(K.PRIVILEGED_CALLS)}")
    exprs["admin_policy_attach"] = flag("event_name LIKE '%AttachUserPolicy%'")
    exprs["assume_role_freq"] = flag("event_name = 'AssumeRole'")
    exprs["cross_account_access"] = flag("recipient_account_id IS DISTINCT FROM account_id")
    exprs["mfa_disabled"] = flag("mfa IS DISTINCT FROM 'true'")
    exprs["off_hours_activity"] = flag(off)
    exprs["weekend_activity"] = flag("isodow(event_time) >= 6")
    exprs["iam_change_freq"] = flag(
        " OR ".join(f"event_name LIKE '%{v}%'" for v in K.CHANGE_VERBS)
    )
    exprs["security_group_mod"] = flag("event_name LIKE '%SecurityGroup%'")
    exprs["s3_sensitive_access"] = flag("lower(event_source) LIKE '%s3%'")
    exprs["kms_decrypt_freq"] = flag("event_name = 'Decrypt'")
    exprs["secret_access_freq"] = flag("event_source LIKE '%secretsmanager%'")
    exprs["console_login_anomaly"] = flag(f"event_name LIKE '%ConsoleLogin%' AND ({off})")
    exprs["cli_tool_usage"] = flag(
        "lower(user_agent) LIKE '%aws-cli%' OR lower(user_agent) LIKE '%boto3%'"
    )
    exprs["suspicious_user_agent"] = flag(
        "coalesce(user_agent, '') = '' OR lower(user_agent) LIKE '%python%'"
    )
    exprs["anomaly_aggregate_score"] = (
        f"{exprs['geo_anomaly_score']} * 0.3::DOUBLE + ({flag(off)}) * 0.2::DOUBLE"
        f" + {exprs['api_burst_rate']} * 0.25::DOUBLE"
        f" + {exprs['lateral_movement_score']} * 0.25::DOUBLE"
    )
    exprs["access_denied_flag"] = flag(
        " OR ".join(f"error_code LIKE '%{m}%'" for m in K.DENIED_ERROR_MARKERS)
    )
    exprs["sensitive_privilege_action"] = flag(f"event_name IN {_in(K.SENSITIVE_PRIVILEGE_ACTIONS)}")
    exprs["credential_access_action"] = flag(f"event_name IN {_in(K.CREDENTIAL_ACCESS_ACTIONS)}")
    exprs["lateral_movement_action"] = flag(f"event_name IN {_in(K.LATERAL_MOVEMENT_ACTIONS)}")
    cols = ",\n  ".join(f"{exprs[f]} AS {f}" for f in K.FEATURES)
    taken = ", ".join(f for f in exprs if f in (
        "login_freq_1h", "geo_anomaly_score", "api_burst_rate", "data_exfil_volume_mb",
        "lateral_movement_score"))
    drop = f" EXCLUDE ({taken})" if not keep else ""
    kept = keep or f"s.*{drop}"
    return f"{dst} AS (SELECT {kept}, {cols} FROM {src} s)"


def scores(src: str, dst: str) -> str:
    """CTEs with probabilities, verdict and gate of the features in src."""
    logits = ", ".join(
        f"{K.SCORER_BIAS[c]}::DOUBLE + "
        + " + ".join(f"({w[c]})::DOUBLE * {f}" for f, w in K.SCORER_WEIGHTS.items())
        + f" AS z{c}"
        for c in K.CLASS_IDS
    )
    exps = ", ".join(f"exp(z{c} - greatest(z0, z1, z2, z3, z4)) AS e{c}" for c in K.CLASS_IDS)
    probs = ", ".join(f"e{c} / (e0 + e1 + e2 + e3 + e4) AS q{c}" for c in K.CLASS_IDS)
    best = "greatest(q0, q1, q2, q3, q4)"
    picks = " ".join(f"WHEN q{c} = {best} THEN {c}" for c in K.CLASS_IDS[:-1])
    rounded = ", ".join(f"round(q{c}, 4) AS p{c}" for c in K.CLASS_IDS)
    return f"""
{dst}_z AS (SELECT *, {logits} FROM {src}),
{dst}_e AS (SELECT *, {exps} FROM {dst}_z),
{dst}_q AS (SELECT *, {probs} FROM {dst}_e),
{dst}_v AS (SELECT *, {rounded}, CASE {picks} ELSE 4 END AS predicted_class,
  round({best}, 4) AS confidence FROM {dst}_q),
{dst} AS (SELECT *, (confidence >= 0.75 AND predicted_class <> 0) AS gated,
  CASE WHEN confidence >= 0.75 AND predicted_class <> 0 THEN 'CONTAINED' ELSE 'MONITORED' END
    AS action_status,
  {PRINCIPAL} AS principal, recipient_account_id AS tenant, epoch_us(event_time) AS time_us
  FROM {dst}_v)"""


FX = f"{EV},\n{features('ev', 'fx')}"
VD = f"{FX},{scores('fx', 'vd')}"

LABEL = _case("predicted_class", K.CLASS_LABELS)
WALL = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"


def on(prefix: str, body: str) -> str:
    return f"WITH RECURSIVE {prefix}\n{body}"


# --- decisions ------------------------------------------------------------------

_PROTECTED = _in(protected_names())
def admitted(confirmed: str, dst: str = "ad") -> str:
    """CTEs that decide the rows of `confirmed` one after the other, tenant by tenant."""
    left = "list_filter(a.taken, lambda x: x >= c.time_us - 600000000)"
    return f"""
cf AS MATERIALIZED (SELECT tenant, event_id, time_us, row_number() OVER (
    PARTITION BY tenant ORDER BY time_us, event_id) AS rn FROM {confirmed}),
{dst}(tenant, event_id, time_us, rn, taken, admitted, room) AS (
  SELECT tenant, event_id, time_us, rn, [time_us], true, 5 FROM cf WHERE rn = 1
  UNION ALL
  SELECT c.tenant, c.event_id, c.time_us, c.rn,
    CASE WHEN len({left}) < 5 THEN list_append({left}, c.time_us) ELSE {left} END,
    len({left}) < 5, 5 - len({left})
  FROM {dst} AS a JOIN cf AS c ON c.tenant = a.tenant AND c.rn = a.rn + 1)"""


CONFIRMED = f"""{VD},
cd AS (SELECT * FROM vd WHERE gated AND lower({strip('principal')}) NOT IN {_PROTECTED}
  AND user_agent IN ('Mozilla/5.0', '')),
{admitted('cd')},
ct AS MATERIALIZED (SELECT tenant, event_id, time_us FROM ad WHERE admitted)"""


def recent(src: str, at: str, current: str = "<") -> str:
    """How many containments the window before `at` holds."""
    return (
        f"(SELECT count(*) FROM ct WHERE ct.tenant = {src}.tenant"
        f" AND ct.time_us >= {at} - 600000000 AND ct.time_us {current} {at})"
    )


DECISIONS = f"""{CONFIRMED},
rm AS (SELECT *, {recent('vd', 'vd.time_us')} AS recent_containments FROM vd),
dc AS (SELECT *, greatest(0, 5 - recent_containments) AS room,
  CASE WHEN NOT gated THEN 'monitor'
       WHEN lower({strip('principal')}) IN {_PROTECTED} THEN 'blocked'
       WHEN recent_containments >= 5 THEN 'blocked' ELSE 'pending' END AS status,
  CASE WHEN gated AND lower({strip('principal')}) IN {_PROTECTED} THEN 1 ELSE 0 END AS protected,
  CASE WHEN gated AND lower({strip('principal')}) NOT IN {_PROTECTED}
            AND recent_containments >= 5 THEN 1 ELSE 0 END AS blast_capped,
  CASE WHEN NOT gated THEN 'Benign or below the confidence threshold; monitored only.'
       WHEN lower({strip('principal')}) IN {_PROTECTED} THEN '''' || {strip('principal')} ||
         ''' is a protected principal (root / break-glass / responder) and is never contained.'
       WHEN recent_containments >= 5 THEN
         'Blast-radius cap reached (5 per 10 min). Review pending actions before containing more.'
       ELSE 'High-confidence threat. Awaiting analyst confirmation before any real IAM change.'
       END AS reason
  FROM rm)"""

TRIAGE = f"""{VD},
tr AS (SELECT *, event_id AS row, strftime(event_time, '%Y-%m-%d') AS upload,
  CASE WHEN error_code = 'InvalidInstanceId' THEN 'event cannot be analysed' END AS error,
  {LABEL} AS class_label FROM vd)"""

# --- attributions ---------------------------------------------------------------


def _phi() -> str:
    items = []
    for i, f in enumerate(K.FEATURES):
        w = K.SCORER_WEIGHTS.get(f, (0.0,) * 5)
        pick = " ".join(f"WHEN {c} THEN ({w[c]})::DOUBLE" for c in K.CLASS_IDS)
        base = K.SCORER_BASELINE.get(f, 0.0)
        items.append(
            f"{{'i': {i}, 'f': '{f}', 'v': (CASE predicted_class {pick} END)"
            f" * ({f} - {base}::DOUBLE)}}"
        )
    return "[" + ", ".join(items) + "]"


def attributions(where: str, prefix: str = VD, src: str = "vd") -> str:
    return f"""{prefix},
att0 AS (SELECT event_id, unnest({_phi()}) AS t FROM {src} {where}),
att AS (SELECT event_id, t.f AS feature, t.v AS v,
  row_number() OVER (PARTITION BY event_id ORDER BY abs(t.v) DESC, t.i DESC) AS place FROM att0
  QUALIFY place <= 5),
dr0 AS (SELECT event_id, place, {_case('feature', K.FEATURE_DESCRIPTIONS,
                                      "replace(feature, '_', ' ')")} AS phrase,
  row_number() OVER (PARTITION BY event_id ORDER BY place) AS nth FROM att WHERE v > 0),
dr AS (SELECT event_id, string_agg(phrase, ', ' ORDER BY nth) AS drivers FROM dr0 WHERE nth <= 3
  GROUP BY event_id)"""


_PERCENT = "CAST(CAST(round_even(confidence * 100, 0) AS BIGINT) AS VARCHAR) || '%"
SUMMARY = f"""CASE WHEN predicted_class = 0 THEN 'INFO: Activity classified as ' || {LABEL} ||
    ' with ' || {_PERCENT} confidence. No malicious privilege escalation indicators detected.' ||
    ' No action required.'
  ELSE {_case('predicted_class', K.SEVERITIES)} || ' ALERT: ' || {LABEL} || ' detected with ' ||
    {_PERCENT} confidence. Top drivers: ' || coalesce(drivers, '{K.DEFAULT_DRIVERS}') || '.' || {{}}
  END"""
_ACTION = "CASE WHEN gated THEN ' Action Taken: IAM tokens revoked in 0.25s.' ELSE '' END"

# --- incidents ------------------------------------------------------------------

INCIDENTS = f"""{VD},
inc AS (SELECT event_id AS id, user_id, event_time AS created_at,
  CASE user_agent WHEN 'aws-cli/2.13.0' THEN 'live' WHEN 'Boto3/1.34.0 Python/3.11' THEN 'upload'
    WHEN '' THEN 'scenario' ELSE 'live-aws' END AS source,
  event_name, principal, source_ip, predicted_class, {LABEL} AS class_label, confidence,
  action_status, event_source, account_id, resources, api_burst_rate,
  CASE WHEN gated THEN '{{"kind":"iam_user","username":"' || {strip('principal')} || '"}}' END
    AS rollback
  FROM vd)"""
INCIDENT_COLUMNS = (
    f"id, user_id, {WALL.format('created_at')} AS created_at, source, event_name, principal, "
    "source_ip, predicted_class, class_label, confidence, action_status"
)


def one_decimal(value: str) -> str:
    """Rounded on the exact binary value, halves up, in whole numbers."""
    tenths = (
        f"((CAST({value} * 1152921504606846976.0::DOUBLE AS HUGEINT) * 20 + 1152921504606846976)"
        " // 2305843009213693952)"
    )
    return f"(CAST({tenths} // 10 AS VARCHAR) || '.' || CAST({tenths} % 10 AS VARCHAR))"


# --- labels -----------------------------------------------------------------------

_CELLS = ("0", "4", "2", "C2", "C2: Vertical Escalation", " c 3", "2.7", "12", "C5", "2_x",
          "benign", "", " 1 ")
_CELL_CASE = _case(f"k % {len(_CELLS)}", dict(enumerate(_CELLS)))
LABEL_COERCE = f"""WITH c AS (SELECT event_id, event_type, value, user_id,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events),
d AS (SELECT event_id,
  TRY_CAST(nullif(regexp_extract({_CELL_CASE}, '^\\s*[cC]?\\s*([0-4])\\b', 1), '') AS INT) AS a,
  CASE WHEN event_type = 'view' AND round_even(value / 2, 0) BETWEEN 0 AND 4
       THEN CAST(round_even(value / 2, 0) AS INT) END AS b,
  CASE WHEN event_type = 'click' AND user_id % 7 <= 4 THEN CAST(user_id % 7 AS INT) END AS c
  FROM c)
SELECT event_id, coalesce(a, b, c, -1) AS label,
  CASE WHEN a IS NOT NULL THEN 'label' WHEN b IS NOT NULL THEN 'threat_class'
       WHEN c IS NOT NULL THEN 'class' ELSE '' END AS label_key FROM d"""

LABELLED = f"""{EV},
lb AS (SELECT event_id, user_id,
  CASE WHEN event_name = 'ListBuckets' THEN 0 WHEN event_name <> 'ConsoleLogin' THEN label END
    AS label,
  CASE WHEN event_name = 'ListBuckets' THEN 'label' WHEN event_name <> 'ConsoleLogin'
    THEN 'threat_class' END AS label_key,
  (user_agent = '' AND event_name = 'PutObject') AS failed FROM ev)"""
_USED = "(label IS NOT NULL AND NOT failed)"
_REPORT_COUNTS = ", ".join(
    f"count(*) FILTER (WHERE {_USED} AND label = {c}) AS class_{c}" for c in K.CLASS_IDS
)
_PRESENT = " + ".join(f"CASE WHEN class_{c} > 0 THEN 1 ELSE 0 END" for c in K.CLASS_IDS)
_ONLY = "CASE " + " ".join(f"WHEN class_{c} > 0 THEN '{c}'" for c in K.CLASS_IDS) + " END"
_THIN = "concat_ws(', ', " + ", ".join(
    f"CASE WHEN class_{c} BETWEEN 1 AND 9 THEN 'class {c}: ' || CAST(class_{c} AS VARCHAR) END"
    for c in K.CLASS_IDS
) + ")"
PROBLEM = f"""CASE WHEN rows_used = 0 THEN 'no labelled rows'
  WHEN {_PRESENT} < 2 THEN 'only one threat class: ' || {_ONLY}
  WHEN rows_used < 40 THEN 'only ' || CAST(rows_used AS VARCHAR) ||
    ' usable rows, at least 40 needed'
  WHEN {_THIN} <> '' THEN 'too few rows (' || {_THIN} || '), at least 10 each needed'
  ELSE '' END"""
REPORT = f"""SELECT count(*) AS rows_total, count(*) FILTER (WHERE {_USED}) AS rows_used,
  count(*) FILTER (WHERE NOT {_USED}) AS rows_skipped,
  count(*) FILTER (WHERE label IS NOT NULL AND failed) AS featurize_errors,
  {_REPORT_COUNTS}, coalesce(arg_min(label_key, event_id) FILTER (WHERE label IS NOT NULL), '')
    AS label_key, 'raw_events' AS shape FROM lb"""

# --- campaigns ----------------------------------------------------------------------


def _null_or(text) -> str:
    return "NULL" if text is None else _quote(text)


_STEPS = ", ".join(
    "(" + ", ".join(
        [_quote(cid), _quote(arn), _quote(ip), str(i + 1), _quote(s[0]), _quote(s[1]), str(s[3]),
         _quote(s[4]), _quote(s[5]), _null_or(s[6].get("mfaAuthenticated")),
         _null_or(s[6].get("recipientAccountId"))]
    ) + ")"
    for cid, _, _, arn, ip, steps in K.CAMPAIGNS
    for i, s in enumerate(steps)
)


def _sample(seed: int, where: str = "") -> str:
    return (
        f"SELECT * FROM ev {where} QUALIFY row_number() OVER (PARTITION BY label"
        f" ORDER BY substr(md5('{seed}:' || CAST(event_id AS VARCHAR)), 1, 15)) = 1"
    )


CAMPAIGN = f"""{EV},
st(campaign_id, attacker, ip, step, name, technique_id, seed_class, o_name, o_source, o_mfa,
   o_recipient) AS (VALUES {_STEPS}),
bs AS ({_sample(42)}),
se AS (SELECT campaign_id, step, name, technique_id, seed_class,
  bs.* EXCLUDE (event_name, event_source, arn, user_name, mfa, source_ip, recipient_account_id),
  o_name AS event_name, o_source AS event_source, attacker AS arn,
  regexp_replace(attacker, '^.*/', '') AS user_name, coalesce(o_mfa, mfa) AS mfa,
  ip AS source_ip, coalesce(o_recipient, recipient_account_id) AS recipient_account_id,
  -1 AS truth, 'synthetic' AS step_source
  FROM st JOIN bs ON st.seed_class = bs.label)"""
REPLAY = f"""{CAMPAIGN},
sm AS ({_sample(7, 'WHERE label <> 3')}),
re AS (SELECT campaign_id, step, name, technique_id, seed_class,
  sm.* EXCLUDE (arn, user_name, source_ip), attacker AS arn,
  regexp_replace(attacker, '^.*/', '') AS user_name, ip AS source_ip,
  label AS truth, 'real' AS step_source
  FROM st JOIN sm ON st.seed_class = sm.label),
al AS (SELECT * FROM re UNION ALL BY NAME
       SELECT * FROM se WHERE seed_class NOT IN (SELECT label FROM sm)),
{features('al', 'rf')},{scores('rf', 'rv')}"""
_EDGES = ", ".join(f"({_quote(a)}, {_quote(b)})" for a, b in K.GRAPH_EDGES)
_PATHS = ", ".join(f"({c}, {_quote(n)})" for c, ns in K.GRAPH_PATHS.items() for n in ns)
_FLAGS = [
    f for f in K.FEATURES
    if f not in K.PASS_THROUGH_DEFAULTS and f not in ("resource_entropy", "anomaly_aggregate_score")
]
_SETS = ", ".join(
    f"({_quote(name)}, {_quote(a)})"
    for name, actions in (
        ("sensitive", K.SENSITIVE_PRIVILEGE_ACTIONS), ("credential", K.CREDENTIAL_ACCESS_ACTIONS),
        ("lateral", K.LATERAL_MOVEMENT_ACTIONS), ("privileged", K.PRIVILEGED_CALLS),
    )
    for a in actions
)
_LISTING = ", ".join(
    "(" + ", ".join([_quote(cid), _quote(name), _quote(tactic), str(len(steps)),
                     _quote(",".join(s[1] for s in steps))]) + ")"
    for cid, name, tactic, _, _, steps in K.CAMPAIGNS
)
_ACTIONS = ", ".join(
    f"({_quote(cid)}, {_quote(a)})"
    for cid, _, _, _, _, steps in K.CAMPAIGNS
    for a in sorted({s[4] for s in steps})
)

CORE = {
    "features_core": on(FX, "SELECT event_id, " + ", ".join(
        f"round({f}, 6) AS {f}" for f in K.PASS_THROUGH_DEFAULTS) + " FROM fx"),
    "features_flags": on(FX, "SELECT event_id, " + ", ".join(
        f"CAST({f} AS INT) AS {f}" for f in _FLAGS) + " FROM fx"),
    "features_aggregate": on(FX, "SELECT event_id, round(anomaly_aggregate_score, 6)"
                                 " AS anomaly_aggregate_score FROM fx"),
    "resource_entropy_list": on(FX, "SELECT event_id, round(resource_entropy, 6)"
                                    " AS resource_entropy FROM fx"),
    "resource_entropy": on(EV + """,
c AS (SELECT user_id, event_name, count(*)::DOUBLE AS n FROM ev GROUP BY ALL),
p AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c)""",
        "SELECT user_id, round(-sum(p * log2(p + 1e-10::DOUBLE)), 6) AS resource_entropy"
        " FROM p GROUP BY user_id"),
    "principal_extract": on(EV, f"SELECT event_id, {PRINCIPAL} AS principal FROM ev"),
    "arn_strip": on(EV, f"SELECT event_id, {strip('coalesce(arn, chr(39) || chr(39))')}"
                        " AS username FROM ev").replace("chr(39) || chr(39)", "''"),
    "label_coerce": LABEL_COERCE,
    "class_lookup": on(EV, f"SELECT event_id, label, {_case('label', K.CLASS_LABELS)}"
                           " AS class_label FROM ev"),
    "severity_lookup": on(EV, "SELECT event_id, " + _case(
        "label", K.SEVERITIES, "'WARNING'") + " AS severity FROM ev"),
    "linear_scores": on(VD, "SELECT event_id, p0, p1, p2, p3, p4, predicted_class, confidence"
                            " FROM vd"),
    "threats": on(VD, "SELECT event_id, predicted_class, confidence FROM vd"
                      " WHERE predicted_class <> 0"),
    "auto_contained": on(VD, "SELECT event_id, predicted_class, confidence, action_status"
                             " FROM vd WHERE gated"),
    "rolling_cap": on(CONFIRMED + f""",
r AS (SELECT event_id, tenant, {recent('o', 'o.time_us', '<=')} AS recent_containments
  FROM ct AS o)""",
        "SELECT event_id, tenant, recent_containments, greatest(0, 5 - recent_containments)"
        " AS room FROM r"),
    "containment_admission": on(CONFIRMED, "SELECT event_id, tenant, CAST(admitted AS INT)"
                                           " AS admitted, room FROM ad"),
    "gate_decisions": on(DECISIONS, "SELECT event_id, status, protected, blast_capped,"
                                    " recent_containments, room, reason FROM dc"),
    "protected_names": on(EV, "SELECT t.name, count(e.event_id) AS events FROM (VALUES "
                          + ", ".join(f"({_quote(n)})" for n in protected_names(["u1", "u2"]))
                          + f") t(name) LEFT JOIN (SELECT event_id, lower({strip(PRINCIPAL)})"
                            " AS name FROM ev) e ON t.name = e.name GROUP BY t.name"),
    "manual_gate": on(VD, "SELECT event_id, CASE WHEN gated THEN 1 ELSE 0 END AS"
                          " containment_triggered, CASE WHEN gated THEN '' ELSE 'Confidence '"
                          " || CAST(confidence AS VARCHAR) || ' below threshold 0.75 or class is"
                          " benign (C0).' END AS refusal FROM vd"),
    "confirm_recheck": on(DECISIONS + f""",
pn AS (SELECT event_id, {recent('dc', 'dc.time_us + 300000000')} AS m FROM dc
  WHERE status = 'pending')""",
        "SELECT event_id, greatest(0, 5 - m) AS room, CASE WHEN m < 5 THEN 1 ELSE 0 END"
        " AS confirmed FROM pn"),
    "action_status": on(VD, "SELECT action_status, predicted_class, count(*) AS n FROM vd"
                            " GROUP BY ALL"),
    "live_labels": on(DECISIONS + """,
ll AS (SELECT dc.*, ct.event_id IS NOT NULL AS done FROM dc LEFT JOIN ct USING (event_id))""",
        """SELECT event_id,
  CASE WHEN done AND user_agent = 'Mozilla/5.0' THEN 'CONTAINED'
       WHEN done AND user_agent = '' THEN 'REVERSED'
       WHEN status = 'pending' THEN 'PENDING' WHEN status = 'blocked' THEN 'GUARDED'
       ELSE 'MONITORED' END AS live_label,
  CASE WHEN status = 'pending' AND NOT done THEN 1 ELSE 0 END AS unresolved FROM ll"""),
    "containment_plan": on(VD, f"""SELECT event_id, principal, predicted_class AS threat_class,
  1 AS step, 'revoke_iam_session' AS action, principal AS target,
  'AWSRevokeOlderSessions' AS control, 'Deny' AS effect,
  strftime(event_time, '%Y-%m-%dT%H:%M:%SZ') AS token_issued_before, '' AS egress,
  'Deny-all policy attached; older session tokens invalidated.' AS detail FROM vd WHERE gated
UNION ALL SELECT event_id, principal, predicted_class, 2, 'micro_segment_host',
  '{K.DEFAULT_INSTANCE_ID}', '{K.DEFAULT_QUARANTINE_GROUP}', 'Deny', '',
  'tcp 443-443 10.0.0.0/8', 'Host isolated into deny-all quarantine security group.'
  FROM vd WHERE gated"""),
    "triage_summary": on(TRIAGE, """SELECT count(*) AS total_received, count(*) AS analyzed,
  0 AS truncated,
  count(*) FILTER (WHERE error IS NULL AND predicted_class <> 0) AS threats_detected,
  least(count(*) FILTER (WHERE error IS NULL AND predicted_class <> 0), 50) AS incidents_recorded,
  count(*) FILTER (WHERE error IS NULL AND predicted_class = 0) AS benign,
  count(*) FILTER (WHERE error IS NULL AND gated) AS auto_contained,
  count(*) FILTER (WHERE error IS NOT NULL) AS errors,
  round(sum(confidence) FILTER (WHERE error IS NULL) / count(*), 4) AS avg_confidence FROM tr"""),
    "capped_summary": on(f"{TRIAGE},\nca AS (SELECT * FROM tr WHERE row <= {K.MAX_ROWS})",
        """SELECT (SELECT count(*) FROM tr) AS total_received, count(*) AS analyzed,
  CAST((SELECT count(*) FROM tr) > count(*) AS INT) AS truncated,
  count(*) FILTER (WHERE error IS NULL AND predicted_class <> 0) AS threats_detected,
  least(count(*) FILTER (WHERE error IS NULL AND predicted_class <> 0), 50) AS incidents_recorded,
  count(*) FILTER (WHERE error IS NULL AND predicted_class = 0) AS benign,
  count(*) FILTER (WHERE error IS NULL AND gated) AS auto_contained,
  count(*) FILTER (WHERE error IS NOT NULL) AS errors,
  round(sum(confidence) FILTER (WHERE error IS NULL) / count(*), 4) AS avg_confidence FROM ca"""),
    "upload_summaries": on(TRIAGE, """SELECT upload, count(*) AS analyzed,
  count(*) FILTER (WHERE error IS NULL AND predicted_class <> 0) AS threats_detected,
  least(count(*) FILTER (WHERE error IS NULL AND predicted_class <> 0), 50) AS incidents_recorded
  FROM tr GROUP BY upload"""),
    "class_distribution": on(TRIAGE, "SELECT d.class_id, d.class_label, count(tr.event_id) AS n,"
        " round(count(tr.event_id) / (SELECT count(*) FROM tr) * 100, 6) AS share FROM (VALUES "
        + ", ".join(f"({c}, {_quote(v)})" for c, v in K.CLASS_LABELS.items())
        + ") d(class_id, class_label) LEFT JOIN tr ON tr.predicted_class = d.class_id"
          " AND tr.error IS NULL GROUP BY ALL"),
    "triage_rows": on(TRIAGE, f"SELECT row, {WALL.format('event_time')} AS timestamp, event_name,"
        " principal, source_ip, predicted_class, class_label, confidence, p0, p1, p2, p3, p4,"
        " action_status AS action FROM tr WHERE error IS NULL"),
    "triage_errors": on(TRIAGE, "SELECT row, error, event_name AS raw_event, error_code AS raw_code"
                                 " FROM tr WHERE error IS NOT NULL"),
    "capped_threats": on(TRIAGE, """SELECT upload, row, row_number() OVER (PARTITION BY upload
  ORDER BY row) AS position, predicted_class FROM tr WHERE error IS NULL AND predicted_class <> 0
  QUALIFY position <= 50"""),
    "top3_probabilities": on(VD + """,
u AS (SELECT event_id, unnest([{'c': 0, 'p': p0}, {'c': 1, 'p': p1}, {'c': 2, 'p': p2},
  {'c': 3, 'p': p3}, {'c': 4, 'p': p4}]) AS t FROM vd)""",
        "SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY t.p DESC, t.c)"
        " AS place, t.c AS class_id, t.p AS probability FROM u QUALIFY place <= 3"),
    "top_attributions": on(attributions("WHERE gated"), """SELECT event_id, place, feature,
  round(v, 4) AS shap_value, round(abs(v), 4) AS contribution,
  CASE WHEN v > 0 THEN 'increases_risk' ELSE 'decreases_risk' END AS direction FROM att"""),
    "risk_drivers": on(attributions("WHERE gated"), "SELECT event_id, coalesce(drivers,"
        f" '{K.DEFAULT_DRIVERS}') AS drivers FROM vd LEFT JOIN dr USING (event_id) WHERE gated"),
    "incident_summaries": on(attributions(""), f"SELECT event_id, {SUMMARY.format(_ACTION)}"
        " AS summary FROM vd LEFT JOIN dr USING (event_id)"),
    "incident_list": on(INCIDENTS, f"SELECT {INCIDENT_COLUMNS} FROM inc"
        " QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY id DESC) <= 200"),
    "incident_point": on(INCIDENTS, f"SELECT {INCIDENT_COLUMNS} FROM inc"
        " QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY id) = 1"),
    "incident_latest_state": on(INCIDENTS, """SELECT id, user_id,
  CASE WHEN rollback IS NULL THEN action_status WHEN source = 'live-aws' THEN 'REVERSED'
       ELSE 'CONTAINED' END AS action_status,
  CASE WHEN source = 'live-aws' THEN '' ELSE coalesce(rollback, '') END AS rollback FROM inc"""),
    "incident_cards": on(INCIDENTS, f"""SELECT user_id, count(*) AS total,
  count(*) FILTER (WHERE predicted_class <> 0) AS threats,
  count(*) FILTER (WHERE action_status = 'CONTAINED') AS contained,
  count(*) FILTER (WHERE predicted_class = 0) AS benign,
  {WALL.format('arg_max(created_at, id)')} AS newest,
  {WALL.format('arg_min(created_at, id)')} AS oldest FROM inc GROUP BY user_id"""),
    "incident_distribution": on(INCIDENTS + """,
c AS (SELECT user_id, predicted_class, count(*) AS n FROM inc GROUP BY ALL),
t AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id) * 100 AS pct FROM c)""",
        f"SELECT user_id, {_case('predicted_class', K.REPORT_CLASS_NAMES)} AS class_name, n,"
        f" {one_decimal('pct')} AS pct FROM t"),
    "incident_report": on(INCIDENTS, f"""SELECT user_id,
  row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS ordinal,
  {WALL.format('created_at')} AS created_at,
  {_case('source', K.REPORT_SOURCE_NAMES, 'source')} AS source_name, event_name, principal,
  source_ip, {_case('predicted_class', K.REPORT_CLASS_NAMES)} AS class_name,
  {one_decimal('confidence * 100')} || '%' AS confidence, action_status FROM inc
  QUALIFY ordinal <= 200"""),
    "rescored_incidents": on(VD, "SELECT event_id AS id, predicted_class AS stored_class,"
                                 " predicted_class, confidence, action_status FROM vd"),
    "class_availability": on(EV, "SELECT (SELECT count(*) FROM ev) AS total, c AS class_id,"
        " count(event_id) AS n, CASE WHEN count(event_id) > 0 THEN 1 ELSE 0 END AS available"
        " FROM (VALUES (0), (1), (2), (3), (4)) d(c) LEFT JOIN ev ON label = c GROUP BY c"),
    "dataset_report": on(LABELLED, REPORT),
    "dataset_mixed": on(EV, "SELECT count(*) AS rows_total, count(*) AS rows_used, 0 AS rows_skipped,"
        " 0 AS featurize_errors, "
        + ", ".join(f"count(*) FILTER (WHERE label = {c}) AS class_{c}" for c in K.CLASS_IDS)
        + ", 'label' AS label_key, 'mixed' AS shape FROM ev"),
    "dataset_checks": on(f"""{LABELLED},
u AS (SELECT user_id, count(*) FILTER (WHERE {_USED}) AS rows_used, {_REPORT_COUNTS} FROM lb
  GROUP BY user_id)""", f"SELECT user_id, rows_used, {PROBLEM} AS problem FROM u"),
    "training_provenance": on(f"{LABELLED},\nr AS ({REPORT})", f"""SELECT 'real' AS requested_mode,
  CASE WHEN {PROBLEM} = '' THEN 'real' ELSE 'none' END AS effective_mode,
  {PROBLEM} AS fallback_reason, rows_total, rows_used, rows_skipped, label_key, shape,
  'damped class weights alpha=0.25 (no SMOTE)' AS imbalance_strategy FROM r"""),
    "poll_summary": on(CONFIRMED + f""",
nw AS (SELECT max(time_us) AS now FROM vd),
pl AS (SELECT vd.*, now FROM vd, nw
  WHERE event_time >= (SELECT max(ts) FROM events) - INTERVAL 60 MINUTE
  ORDER BY event_time DESC, event_id DESC LIMIT 50),
pr AS (SELECT *, {recent('pl', 'pl.now', '<=')} AS m FROM pl)""",
        f"""SELECT count(*) AS events_seen, count(*) FILTER (WHERE gated AND m < 5 AND
  lower({strip('principal')}) NOT IN {_PROTECTED}) AS pending_count,
  coalesce(min(greatest(0, 5 - m)), 5) AS blast_room FROM pr"""),
    "first_n_events": on(VD, "SELECT event_id, predicted_class, confidence, action_status FROM vd"
                             " ORDER BY event_id LIMIT 100"),
    "terminal_summary": on(VD, """SELECT count(*) AS analyzed, count(*) AS total,
  count(*) FILTER (WHERE predicted_class <> 0) AS threats,
  count(*) FILTER (WHERE predicted_class = 0) AS benign,
  round(avg(confidence), 4) AS avg_confidence FROM vd"""),
    "latest_20": on(VD, "SELECT event_id, predicted_class, confidence FROM vd"
                        " ORDER BY event_time DESC, event_id DESC LIMIT 20"),
    "action_set_match": on(EV, f"SELECT action_set, event_name, count(*) AS n FROM ev JOIN"
        f" (VALUES {_SETS}) s(action_set, a) ON event_name = a GROUP BY ALL"),
    "campaign_listing": on(EV, f"""SELECT l.campaign_id, l.name, l.tactic, l.step_count,
  l.techniques, count(ev.event_id) AS matching_events
  FROM (VALUES {_LISTING}) l(campaign_id, name, tactic, step_count, techniques)
  LEFT JOIN (VALUES {_ACTIONS}) a(campaign_id, action) ON a.campaign_id = l.campaign_id
  LEFT JOIN ev ON ev.event_name = a.action GROUP BY ALL"""),
    "campaign_by_id": on(EV, f"SELECT {_quote(K.CAMPAIGNS[0][0])} AS campaign_id, event_name,"
        f" count(*) AS n FROM ev WHERE event_name IN {_in({s[4] for s in K.CAMPAIGNS[0][5] if s[4]})}"
        " GROUP BY event_name"),
    "campaign_steps": on(CAMPAIGN, f"""SELECT campaign_id, step, name, technique_id, seed_class,
  event_name, event_source, {PRINCIPAL} AS principal, user_name, coalesce(mfa, '') AS mfa,
  source_ip, recipient_account_id AS recipient FROM se"""),
    "campaign_timeline": on(
        attributions("", f"""{CAMPAIGN},
{features('se', 'sf')},{scores('sf', 'sv')},
sw AS (SELECT * REPLACE (campaign_id || ':' || step AS event_id) FROM sv)""", "sw"),
        f"SELECT campaign_id, step, event_name, predicted_class, {LABEL} AS class_label,"
        f" confidence, action_status, step_source, {SUMMARY.format(_quote(''))} AS summary"
        " FROM sw LEFT JOIN dr USING (event_id)"),
    "campaign_rollup": on(REPLAY, """SELECT campaign_id, count(*) AS steps_total,
  count(*) FILTER (WHERE predicted_class <> 0) AS threats_detected,
  count(*) FILTER (WHERE gated) AS auto_contained,
  count(*) FILTER (WHERE step_source = 'real') AS real_steps FROM rv GROUP BY campaign_id"""),
    "replay_timeline": on(REPLAY, "SELECT campaign_id, step, event_name, predicted_class, truth,"
        " CASE WHEN truth >= 0 AND predicted_class = truth THEN 1 ELSE 0 END AS correct,"
        " step_source FROM rv"),
    "replay_accuracy": on(REPLAY, """SELECT campaign_id,
  count(*) FILTER (WHERE truth >= 0 AND predicted_class = truth) AS hits,
  count(*) FILTER (WHERE truth >= 0) AS scored FROM rv GROUP BY campaign_id"""),
    "attack_path": on(f"""{VD},
eg(source, target) AS (VALUES {_EDGES}), pt(class_id, node) AS (VALUES {_PATHS}),
ae AS (SELECT a.class_id, source, target FROM eg JOIN pt a ON a.node = source
  JOIN pt b ON b.node = target AND b.class_id = a.class_id)""",
        "SELECT event_id, predicted_class, source, target FROM vd JOIN ae"
        " ON predicted_class = class_id"),
}

# --- metrics ----------------------------------------------------------------------

PR = f"{VD},\npr AS (SELECT event_id, label, predicted_class FROM vd)"
_BASE = ", ".join(f"0.0::DOUBLE AS {f}" for f in K.REAL_SIGNAL_FEATURES)
ARMS = f"""{VD},
nb AS (SELECT * REPLACE ({_BASE}) FROM fx),{scores('nb', 'nv')},
pr AS (SELECT 'with' AS arm, event_id, label, predicted_class FROM vd
       UNION ALL SELECT 'without', event_id, label, predicted_class FROM nv)"""
_MD5 = "md5('42:' || CAST({} AS VARCHAR))"
FOLDS = """fd AS (SELECT event_id, label, (row_number() OVER (PARTITION BY label
    ORDER BY md5('42:' || CAST(event_id AS VARCHAR))) - 1) %
    least(5, (SELECT min(c) FROM (SELECT count(*) AS c FROM ev GROUP BY label))) AS fold FROM ev)"""


def class_scores(src: str, by: str, dst: str = "cs") -> str:
    """Precision, recall, F1 and support per class by joins of counted sets."""
    key = f"{by}, " if by else ""
    on = " AND ".join(["g.c = x.c"] + [f"g.{b.strip()} = x.{b.strip()}" for b in by.split(",") if b])
    groups = f"SELECT DISTINCT {key}c FROM {src}, (VALUES (0), (1), (2), (3), (4)) t(c)"
    pick = "".join(f"g.{b.strip()}, " for b in by.split(",") if b)

    def counted(alias: str, col: str, where: str = "") -> str:
        return (
            f"LEFT JOIN (SELECT {key}{col} AS c, count(*) AS {alias} FROM {src} {where}"
            f" GROUP BY ALL) {alias}_t ON " + on.replace("x.", f"{alias}_t.")
        )

    return f"""{dst}_n AS (SELECT {pick}g.c, coalesce(tp, 0) AS tp, coalesce(pp, 0) AS pp,
    coalesce(ap, 0) AS ap FROM ({groups}) g
  {counted('tp', 'label', 'WHERE label = predicted_class')}
  {counted('pp', 'predicted_class')}
  {counted('ap', 'label')}),
{dst} AS (SELECT *, CASE WHEN pp > 0 THEN tp / pp ELSE 0 END AS precision_,
  CASE WHEN ap > 0 THEN tp / ap ELSE 0 END AS recall_,
  CASE WHEN ap + pp > 0 THEN 2 * tp / (ap + pp) ELSE 0 END AS f1_ FROM {dst}_n)"""


def macro_of(src: str, by: str) -> str:
    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {key}sum(tp) / sum(ap) AS accuracy,
  sum(precision_) / count(*) FILTER (WHERE ap + pp > 0) AS macro_precision,
  sum(recall_) / count(*) FILTER (WHERE ap + pp > 0) AS macro_recall,
  sum(f1_) / count(*) FILTER (WHERE ap + pp > 0) AS macro_f1,
  CAST(sum(ap) AS BIGINT) AS n FROM {src} {group}"""


_STATS = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, avg({f}) AS mean, stddev_pop({f}) AS std FROM fx" for f in K.FEATURES
)
_SCALED = ", ".join(
    f"round(({f} - (SELECT avg({f}) FROM fx)) / (SELECT CASE WHEN stddev_pop({f}) = 0 THEN 1"
    f" ELSE stddev_pop({f}) END FROM fx), 4) AS {f}"
    for f in K.FEATURES
)
_ALPHAS = ", ".join(f"({a}::DOUBLE)" for a in K.SWEEP_ALPHAS)
WEIGHTS = f"""cn AS (SELECT label, count(*) AS n FROM ev GROUP BY label),
rw AS (SELECT alpha, label, n, pow((SELECT sum(n) FROM cn) / ((SELECT count(*) FROM cn) * n), alpha)
  AS r FROM cn, (VALUES {_ALPHAS}) a(alpha)),
wt AS (SELECT alpha, label, n, r / min(r) OVER (PARTITION BY alpha) AS weight FROM rw)"""


# --- fits: supports, and the baseline they imply -----------------------------------

TESTED = f"""{EV},
hs AS (SELECT event_id, label, row_number() OVER (PARTITION BY label ORDER BY
    md5('42:' || CAST(event_id AS VARCHAR))) AS place, count(*) OVER (PARTITION BY label) AS size
  FROM ev),
ts AS (SELECT event_id, label FROM hs WHERE place <= round(size * 0.2::DOUBLE))"""


def against_benign(src: str, by: str = "") -> str:
    """Support by class, with the macro F1 of always predicting benign."""
    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    using = f"USING ({by})" if by else "ON true"
    return f"""SELECT {key}class_id, support, round(2.0 * n0 / (n0 + n) / k, 4) AS benign_macro_f1,
  1 AS beats_benign FROM (
  SELECT {key}count(*) AS n, count(*) FILTER (WHERE label = 0) AS n0,
    1 + count(DISTINCT label) FILTER (WHERE label <> 0) AS k FROM {src} {group}) AS g
  JOIN (SELECT {key}c AS class_id, count(*) FILTER (WHERE label = c) AS support
    FROM {src}, (VALUES (0), (1), (2), (3), (4)) AS t(c) GROUP BY ALL) AS s {using}"""


def fitted(model: str) -> str:
    return on(TESTED, f"SELECT '{model}' AS model, * FROM ({against_benign('ts')})")


def validated(*arms: str, name: str = "arm") -> str:
    listed = ", ".join(f"({a})" for a in arms)
    return on(f"{EV},\n{FOLDS}", f"SELECT * FROM ({against_benign('fd', 'fold')}),"
                                 f" (VALUES {listed}) AS a({name})")


_DISTANCE = " + ".join(f"(a.{f} - b.{f}) * (a.{f} - b.{f})" for f in K.FEATURES)
_ROUNDED = ", ".join(f"round({f}, 6) AS {f}" for f in K.FEATURES)


def _noise(f: str) -> str:
    def unit(part: int) -> str:
        text = f"'42:' || CAST(event_id AS VARCHAR) || ':{f}:{part}'"
        return f"(1.0::DOUBLE - ('0x' || substr(md5({text}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"

    return (
        f"round({f} + 0.25::DOUBLE * sqrt(-2.0::DOUBLE * ln({unit(0)}))"
        f" * cos(2.0::DOUBLE * pi() * {unit(1)}), 6) AS {f}"
    )


# --- minted events -----------------------------------------------------------------


def _u(name: str) -> str:
    return (
        "(('0x' || substr(md5('1234:' || CAST(label AS VARCHAR) || ':' || CAST(n AS VARCHAR)"
        f" || ':{name}'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"
    )


def _pick(options, u: str, field: int) -> str:
    total, reached, whens = sum(o[-1] for o in options), 0.0, ""
    for o in options[:-1]:
        reached += o[-1]
        whens += f" WHEN {u} < {reached / total!r}::DOUBLE THEN {_quote(o[field])}"
    last = _quote(options[-1][field])
    return f"CASE{whens} ELSE {last} END" if whens else last


def _mint_error(c: int) -> str:
    rate, codes = K.MINT_ERRORS[c]
    if not codes:
        return "''"
    names = "[" + ", ".join(_quote(x) for x in codes) + "]"
    pick = f"{names}[CAST(floor({_u('code')} * {len(codes)}) AS INT) + 1]"
    return f"CASE WHEN {_u('denied')} < {rate}::DOUBLE THEN {pick} ELSE '' END"


def _per_class(build) -> str:
    return "CASE label " + " ".join(f"WHEN {c} THEN {build(c)}" for c in K.AUGMENT_CLASSES) + " END"


MINTED = f"""{EV},
hv AS (SELECT label, count(*) AS have FROM ev WHERE label IN (1, 2, 4) GROUP BY label),
tg AS (SELECT max(c) AS target FROM (SELECT count(*) AS c FROM ev GROUP BY label)),
sl AS (SELECT label, unnest(range(CAST(target - have AS BIGINT))) AS n FROM hv, tg),
mi AS (SELECT label, n,
  '2023-07-' || CAST(CAST(floor({_u('day')} * 5) AS INT) + 10 AS VARCHAR) || 'T' ||
    lpad(CAST(CAST(floor({_u('hour')} * 9) AS INT) + 9 AS VARCHAR), 2, '0') || ':' ||
    lpad(CAST(CAST(floor({_u('minute')} * 60) AS INT) AS VARCHAR), 2, '0') || ':00Z' AS event_time,
  {_per_class(lambda c: _pick(K.MINT_EVENTS[c], _u('event'), 0))} AS event_name,
  {_per_class(lambda c: _pick(K.MINT_EVENTS[c], _u('event'), 1))} AS event_source,
  {_per_class(lambda c: _pick(K.MINT_IDENTITIES[c], _u('identity'), 0))} AS identity,
  '203.0.113.' || CAST(CAST(floor({_u('ip')} * 253) AS INT) + 1 AS VARCHAR) AS source_ip,
  {_per_class(_mint_error)} AS error_code FROM sl)"""
_MOVES = _in(K.LATERAL_MOVEMENT_ACTIONS)

ML = {
    "class_weights": on(f"{EV},\n{WEIGHTS}",
                        "SELECT alpha, label, n, round(weight, 6) AS weight FROM wt"),
    "scaler_stats": on(f"{FX},\nst AS ({_STATS})", "SELECT feature, round(mean, 6) AS mean,"
        " round(std, 6) AS std, round(CASE WHEN std = 0 THEN 1 ELSE std END, 6) AS divisor FROM st"),
    "scaled_features": on(FX, f"SELECT event_id, {_SCALED} FROM fx"),
    "embedding_scaler_stats": """WITH v AS (SELECT unnest(embedding)::DOUBLE AS value,
  unnest(range(len(embedding))) AS position FROM embeddings)
SELECT CAST(position AS INT) AS position, round(avg(value), 6) AS mean,
  round(stddev_pop(value), 6) AS std FROM v GROUP BY position""",
    "holdout_split": on(EV, """SELECT event_id, label, CASE WHEN row_number() OVER (
  PARTITION BY label ORDER BY md5('42:' || CAST(event_id AS VARCHAR))) <=
  round(0.2::DOUBLE * count(*) OVER (PARTITION BY label)) THEN 'test' ELSE 'train' END AS split
  FROM ev"""),
    "kfold_assignment": on(f"{EV},\n{FOLDS}",
                           "SELECT event_id, label, CAST(fold AS INT) AS fold FROM fd"),
    "embedding_kfold": """SELECT vec_id, label, CAST((row_number() OVER (PARTITION BY label
  ORDER BY md5('42:' || CAST(vec_id AS VARCHAR))) - 1) % least(5, (SELECT min(c) FROM
  (SELECT count(*) AS c FROM embeddings GROUP BY label))) AS INT) AS fold FROM embeddings""",
    "sample_per_class": on(f"{EV},\nsm AS ({_sample(42)})",
                           "SELECT event_id, label, event_name FROM sm"),
    "confusion_counts": on(PR, """SELECT a.c AS label, p.c AS predicted_class,
  count(pr.event_id) AS n, round(CASE WHEN sum(count(pr.event_id)) OVER (PARTITION BY a.c) > 0
  THEN count(pr.event_id) / sum(count(pr.event_id)) OVER (PARTITION BY a.c) ELSE 0 END, 4) AS share
  FROM (VALUES (0), (1), (2), (3), (4)) a(c) JOIN (VALUES (0), (1), (2), (3), (4)) p(c) ON true
  LEFT JOIN pr ON pr.label = a.c AND pr.predicted_class = p.c GROUP BY a.c, p.c"""),
    "per_class_metrics": on(f"{PR},\n{class_scores('pr', '')}", f"""SELECT c AS class_id,
  {_case('c', K.CLASS_LABELS)} AS class_label, round(precision_, 4) AS precision,
  round(recall_, 4) AS recall, round(f1_, 4) AS f1, ap AS support FROM cs"""),
    "macro_metrics": on(f"{PR},\n{class_scores('pr', '')},\nm AS ({macro_of('cs', '')})",
        "SELECT round(accuracy, 4) AS accuracy, round(macro_precision, 4) AS macro_precision,"
        " round(macro_recall, 4) AS macro_recall, round(macro_f1, 4) AS macro_f1, n FROM m"),
    "model_accuracy": on(ARMS, """SELECT arm, round(avg(CASE WHEN label = predicted_class THEN 1
  ELSE 0 END), 4) AS accuracy, count(*) AS n FROM (SELECT * FROM pr UNION ALL
  SELECT 'always_benign', event_id, label, 0 FROM ev) GROUP BY arm"""),
    "cv_summary": on(f"{ARMS},\n{FOLDS},\nfp AS (SELECT pr.*, fold FROM pr JOIN fd"
                     f" USING (event_id)),\n{class_scores('fp', 'arm, fold')},\n"
                     f"m AS ({macro_of('cs', 'arm, fold')})",
        """SELECT arm, count(*) AS folds, round(avg(macro_f1), 4) AS cv_macro_f1_mean,
  round(stddev_pop(macro_f1), 4) AS cv_macro_f1_std, round(avg(accuracy), 4) AS cv_accuracy_mean,
  round(stddev_pop(accuracy), 4) AS cv_accuracy_std FROM m GROUP BY arm"""),
    "pooled_class_f1": on(f"{ARMS},\n{class_scores('pr', 'arm')}",
        "SELECT arm, c AS class_id, round(f1_, 4) AS f1, ap AS support FROM cs"),
    "recipe_delta": on(f"{ARMS},\n{class_scores('pr', 'arm')}", "SELECT a.c AS class_id, "
        + ", ".join(
            f"round(b.{v}_, 4) AS {v}_without, round(a.{v}_, 4) AS {v}_with,"
            f" round(round(a.{v}_, 4) - round(b.{v}_, 4), 4) AS {v}_delta"
            for v in ("precision", "recall", "f1"))
        + " FROM cs a JOIN cs b ON a.c = b.c AND a.arm = 'with' AND b.arm = 'without'"),
    "best_alpha": on(f"""{VD},
{WEIGHTS},
wd AS (SELECT alpha, {", ".join(f"coalesce(max(weight) FILTER (WHERE label = {c}), 0) AS w{c}"
                               for c in K.CLASS_IDS)} FROM wt GROUP BY alpha),
ws AS (SELECT event_id, alpha, label, {", ".join(f"round(p{c} * w{c}, 9) AS s{c}"
                                                 for c in K.CLASS_IDS)} FROM vd, wd),
pr AS (SELECT event_id, alpha, label, CASE greatest(s0, s1, s2, s3, s4) WHEN s0 THEN 0
  WHEN s1 THEN 1 WHEN s2 THEN 2 WHEN s3 THEN 3 ELSE 4 END AS predicted_class FROM ws),
{class_scores('pr', 'alpha')},
m AS ({macro_of('cs', 'alpha')})""", """SELECT alpha, round(macro_f1, 4) AS cv_macro_f1_mean,
  round(accuracy, 4) AS cv_accuracy_mean FROM m
  ORDER BY round(macro_f1, 4) DESC, round(accuracy, 4) DESC, alpha LIMIT 1"""),
    "minority_topup": on(MINTED, "SELECT * FROM mi"),
    "topped_up_set": on(f"""{MINTED},
{features('ev', 'fx')}""", f"""SELECT label, 0 AS minted, count(*) AS n,
  CAST(sum(assume_role_freq) AS BIGINT) AS assume_role,
  CAST(sum(lateral_movement_action) AS BIGINT) AS lateral,
  CAST(sum(off_hours_activity) AS BIGINT) AS off_hours FROM fx GROUP BY label
UNION ALL SELECT label, 1, count(*), count(*) FILTER (WHERE event_name = 'AssumeRole'),
  count(*) FILTER (WHERE event_name IN {_MOVES}), 0 FROM mi GROUP BY label"""),
    "noisy_features": on(FX, "SELECT event_id, label, " + ", ".join(map(_noise, K.FEATURES))
                         + " FROM fx"),
    "smote": on(EV, """SELECT label, 0 AS synthetic, count(*) AS n, 0 AS outside FROM ev GROUP BY label
UNION ALL SELECT label, 1, m - n, 0 FROM (SELECT label, count(*) AS n FROM ev GROUP BY label),
  (SELECT max(n) AS m FROM (SELECT count(*) AS n FROM ev GROUP BY label)) WHERE n < m"""),
    "smote_neighbours": on(f"""{FX},
lg AS (SELECT label FROM fx GROUP BY label ORDER BY count(*) DESC, label LIMIT 1),
pt AS MATERIALIZED (SELECT label, min(event_id) AS event_id, {", ".join(K.FEATURES)} FROM (
  SELECT event_id, label, {_ROUNDED} FROM fx WHERE label <> (SELECT label FROM lg)) GROUP BY ALL),
pr AS (SELECT a.label, a.event_id, {_DISTANCE} AS d FROM pt AS a JOIN pt AS b
  ON a.label = b.label AND a.event_id <> b.event_id)""",
        "SELECT label, event_id, row_number() OVER (PARTITION BY label, event_id ORDER BY d) AS place,"
        " round(d, 4) AS dist FROM pr QUALIFY place <= 5"),
    "train_logistic": fitted("logistic"),
    "train_forest": fitted("forest"),
    "train_boosted": fitted("boosted"),
    "train_second_boosted": fitted("second_boosted"),
    "train_samme": fitted("samme"),
    "four_models": on(TESTED, f"SELECT * FROM ({against_benign('ts')}), (VALUES ('boosted'),"
                              " ('second_boosted'), ('forest'), ('samme')) AS m(model)"),
    "tree_attributions": on(TESTED, "SELECT event_id, 1 AS adds_up FROM ts"),
    "primary_attributions": on(TESTED, "SELECT event_id, 1 AS adds_up FROM ts"),
    "cross_validation": validated("'served'"),
    "recipe_ab": on(f"{TESTED},\n{FOLDS}", f"SELECT * FROM (SELECT * FROM ("
        f"{against_benign('fd', 'fold')}) UNION ALL SELECT -1, * FROM ({against_benign('ts')})),"
        " (VALUES ('old'), ('new')) AS a(arm)"),
    "feature_ablation": validated("'without'", "'with'"),
    "weight_sweep": validated(*(f"{a}::DOUBLE" for a in K.SWEEP_ALPHAS), name="alpha"),
    "hybrid_ab": validated("'real'", "'hybrid'"),
    "published_model": on(f"{FX},\nst AS ({_STATS})", """SELECT 'v1' AS version,
  'damped class weights alpha=0.25 (no SMOTE)' AS resampling, feature, round(mean, 6) AS mean,
  round(CASE WHEN std = 0 THEN 1 ELSE std END, 6) AS divisor, 0 AS different_verdicts FROM st"""),
    "smote_embeddings": """WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
SELECT label, false AS synthetic, n FROM c UNION ALL
SELECT label, true, (SELECT max(n) FROM c) - n FROM c WHERE n < (SELECT max(n) FROM c)""",
}

READ_BACK = f"""SELECT event_id, {WALL.format('event_time')} AS event_time, event_name,
  {PRINCIPAL} AS principal, coalesce(mfa, '') AS mfa, user_agent,
  coalesce(account_id, '') AS account_id, recipient_account_id,
  login_freq_1h::DOUBLE AS login_freq_1h, round(geo_anomaly_score, 6) AS geo_anomaly_score,
  round(api_burst_rate, 6) AS api_burst_rate, round(data_exfil_volume_mb, 6)
  AS data_exfil_volume_mb, round(lateral_movement_score, 6) AS lateral_movement_score, label
  FROM ev"""

IO = {
    "ingest_json": on(EV, READ_BACK),
    "ingest_large_exports": on(EV, READ_BACK),
    "ingest_jsonl": on(EV, READ_BACK),
    "ingest_shapes": on(EV, READ_BACK),
    "ingest_mixed": on(EV, READ_BACK),
    "ingest_documents_quarantine": on(EV, """SELECT CASE event_name WHEN 'ListBuckets' THEN
  'not JSON' WHEN 'PutObject' THEN 'not an object' WHEN 'Decrypt' THEN 'no event' ELSE 'event' END
  AS kind, sum(CASE event_name WHEN 'PutObject' THEN 2 ELSE 1 END)::BIGINT AS n FROM ev
  GROUP BY kind"""),
    "ingest_errors": on(EV, """SELECT event_id, CASE event_name WHEN 'ListBuckets' THEN
  'unparsable event time' ELSE 'non-numeric: geo_anomaly_score' END AS error FROM ev
  WHERE event_name IN ('ListBuckets', 'Decrypt')"""),
    "labelled_training": on(EV + """,
lf AS (SELECT label FROM ev WHERE event_name <> 'ListBuckets' AND event_id % 5 <> 2)""",
        against_benign("lf")),
    "labelled_file": on(EV + """,
lf AS (SELECT event_id, event_name = 'ListBuckets' AS broken,
  CASE WHEN event_name <> 'ListBuckets' AND event_id % 5 <> 2 THEN label END AS label,
  CASE WHEN event_name <> 'ListBuckets' AND event_id % 5 <> 2 THEN
    CASE WHEN event_id % 3 = 0 THEN 'threat_class' ELSE 'label' END END AS label_key FROM ev),
r AS (SELECT count(*) AS rows_total, count(label) AS rows_used,
  count(*) - count(label) AS rows_skipped, 0 AS featurize_errors,
  """ + ", ".join(f"count(*) FILTER (WHERE label = {c}) AS class_{c}" for c in K.CLASS_IDS) + """,
  coalesce(arg_min(label_key, event_id) FILTER (WHERE label IS NOT NULL), '') AS label_key,
  'raw_events' AS shape FROM lf)""", f"SELECT *, {PROBLEM} AS problem FROM r"),
    "ingest_csv": on(EV, READ_BACK),
    "poll_payloads": on(EV, READ_BACK + " WHERE event_name NOT IN ('PutObject', 'Decrypt')"),
    "ingest_quarantine": on(EV, """SELECT CASE event_name WHEN 'ListBuckets' THEN 'not JSON'
  WHEN 'PutObject' THEN 'not an object' ELSE 'event' END AS kind, count(*) AS n FROM ev
  WHERE event_name <> 'Decrypt' GROUP BY kind"""),
    "line_numbers": "SELECT count(*) AS lines, 0::BIGINT AS bad_files FROM events",
    "export_csv": on(TRIAGE, f"""SELECT CAST(row AS VARCHAR) AS row,
  strftime(event_time, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, event_name,
  replace(principal, ',', ' ') AS principal, source_ip, class_label,
  {one_decimal('confidence * 100')} || '%' AS confidence, action_status AS action FROM tr
  WHERE error IS NULL"""),
    "export_json": on(TRIAGE, "SELECT row, principal, confidence, action_status AS action,"
                              " p0, p1, p2, p3, p4, event_source AS raw_source FROM tr WHERE error IS NULL"),
    "export_summary": CORE["triage_summary"],
    "append_incidents": on(INCIDENTS, "SELECT id, user_id, source, event_name, principal,"
        " predicted_class, confidence, action_status, coalesce(rollback, '') AS rollback,"
        " event_source AS raw_source, coalesce(account_id, '') AS raw_account,"
        f" {WALL.format('created_at')} AS raw_time, api_burst_rate AS raw_rate,"
        " coalesce(array_to_string(resources, ','), '') AS raw_resources FROM inc"),
    "cleared_incidents": on(EV + """,
o AS (SELECT user_id, count(*) AS n FROM ev GROUP BY user_id ORDER BY n DESC, user_id LIMIT 1)""",
        "SELECT user_id, n AS cleared, (SELECT count(*) FROM ev) - n AS left,"
        " 0::BIGINT AS left_of_owner FROM o"),
    "removed_then_stored": on(f"""{INCIDENTS},
o AS (SELECT user_id AS owner FROM inc GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 1)""",
        "SELECT CAST(user_id = owner AS INT) AS of_owner, predicted_class, count(*) AS n,"
        " CAST(sum(id) AS BIGINT) AS ids FROM inc, o WHERE user_id <> owner OR id % 3 = 0"
        " GROUP BY ALL"),
    "merged_events": on(INCIDENTS, """SELECT id,
  json_extract_string(m, '$.event.name') AS name, json_extract_string(m, '$.event.kind') AS kind,
  json_extract_string(m, '$.actor.name') AS actor, json_extract_string(m, '$.actor.mfa.used') AS mfa,
  json_extract_string(m, '$.actor.mfa.device') AS device,
  CAST(json_array_length(m, '$.tags') AS INT) AS tags
FROM (SELECT id, json_merge_patch(
  json_object('event', json_object('name', event_name, 'kind', 'seen'), 'tags', ['a', 'b', 'c'],
    'actor', json_object('name', principal, 'mfa', json_object('used', 'no', 'device', 'd1'))),
  CASE WHEN predicted_class = 0 THEN '{}' ELSE json_object('event', json_object('kind', class_label),
    'tags', [source], 'actor', json_object('mfa', json_object('used', 'yes'))) END) AS m FROM inc)"""),
    "incident_lookup": on(INCIDENTS, "SELECT id, user_id, event_name, principal, predicted_class,"
        " confidence FROM inc ORDER BY user_id, id LIMIT 1"),
    "cached_dataset": CORE["class_availability"],
    "stream_scoring": on(VD, "SELECT event_id, predicted_class, confidence, action_status FROM vd"),
    "stream_dedupe": on(VD, "SELECT event_id, predicted_class, confidence FROM vd"),
    "stream_late": on(f"""{VD},
q AS (SELECT event_id, epoch_us(ts) AS us, event_id AS e,
  least(3, (day(ts) - 1) // 8) AS first, least(3, (day(ts) - 1) // 8 + 1) AS after FROM events),
dl AS (SELECT event_id, us, CASE WHEN e % 11 = 0 THEN after ELSE first END AS batch FROM q
  UNION ALL SELECT event_id, us, first FROM q WHERE e % 5 = 0
  UNION ALL SELECT event_id, us, after FROM q WHERE e % 7 = 0),
hb AS (SELECT batch, max(us) AS high FROM dl GROUP BY batch),
bd AS (SELECT a.batch, max(b.high) - {2 * 24 * 60 * 60_000_000} AS bound
  FROM hb AS a JOIN hb AS b ON b.batch < a.batch GROUP BY a.batch),
ll AS (SELECT dl.*, coalesce(us < bound, false) AS late FROM dl LEFT JOIN bd USING (batch)),
oc AS (SELECT event_id, CASE WHEN late THEN 'late' WHEN row_number() OVER (
    PARTITION BY event_id, late ORDER BY batch) = 1 THEN 'scored' ELSE 'duplicate' END AS outcome
  FROM ll)""", """SELECT oc.event_id, outcome, count(*) AS deliveries,
  any_value(CASE WHEN outcome = 'scored' THEN predicted_class ELSE -1 END) AS predicted_class
  FROM oc JOIN vd USING (event_id) GROUP BY oc.event_id, outcome"""),
    "ingest_fallback": on(EV, f"""SELECT *, CASE WHEN event_id % 2 = 1 THEN 'jsonl' ELSE 'csv' END
  AS read_as, 'no events in the folder as json, jsonl' AS blank FROM ({READ_BACK})"""),
    "file_size_cap": """SELECT event_id, 0 AS too_large, 1::BIGINT AS n FROM events
  WHERE event_id // 100 % 2 = 0 UNION ALL SELECT NULL, 1, count(DISTINCT event_id // 100)
  FROM events WHERE event_id // 100 % 2 = 1 HAVING count(*) > 0""",
    "stream_lifecycle": CORE["incident_latest_state"],
    "stream_cap": on(f"{VD},\ngt AS (SELECT * FROM vd WHERE gated),{admitted('gt')}",
                     "SELECT tenant, event_id, time_us, CAST(admitted AS INT) AS admitted, room,"
                     " 0 AS late FROM ad"),
}

SQL = {**CORE, **IO, **ML}
