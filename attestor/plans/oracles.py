"""DuckDB SQL giving the same results as the registered queries."""

from __future__ import annotations

from attestor.plans.derived import NOW_MS

# Fixed values, written out here so that the SQL doesn't lean on the code it checks.
PRIVILEGED = ("admin", "root", "superuser", "owner", "global_admin", "domain_admin", "system", "privileged")
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v", "phd", "md", "dds", "esq", "cpa")
HEADER_WORDS = {
    "email": "email emailaddress mail userprincipalname upn",
    "userId": "userid username samaccountname login uid account accountname",
    "employeeId": "employeeid personnelnumber",
    "displayName": "displayname fullname name cn",
    "department": "department dept division org organizationalunit ou",
    "manager": "manager managername supervisor reportsto",
    "accountStatus": "status accountstatus enabled active",
    "employmentStatus": "employmentstatus empstatus",
    "role": "role rolename group groupname memberof",
    "entitlement": "entitlement permission access accesslevel privilege",
    "lastLogin": "lastlogin lastlogon lastlogontimestamp lastsignin lastactivity",
}
PARTS = (
    ("email mail upn", "email"), ("employeeid empid", "employeeId"), ("userid username login", "userId"),
    ("displayname fullname name", "displayName"), ("department dept division", "department"),
    ("manager supervisor reportsto", "manager"), ("employmentstatus empstatus", "employmentStatus"),
    ("accountstatus status enabled", "accountStatus"), ("entitlement permission privilege accesslevel", "entitlement"),
    ("role group memberof", "role"), ("lastlogin lastlogon lastsignin lastactivity", "lastLogin"),
)


def _word(prefix: str, key: str, size: int) -> str:
    w = f"translate(substr(md5('{prefix}' || {key}::varchar), 1, {size}), '0123456789', 'ghijklmnop')"
    return f"upper(substr({w}, 1, 1)) || substr({w}, 2)"


def _person(key: str) -> str:
    k = f"(case when {key} % 40 = 7 then {key} - 1 else {key} end)"
    return f"({_word('f', k, 6)} || ' ' || {_word('l', k, 9)})"


IDENT = f"""ident as (
 select c_custkey sot_ord, 'E' || c_custkey employee_id, {_person('c_custkey')} display_name,
  case when c_custkey % 17 = 0 then '' else 'u' || c_custkey || '@acme.com' end email,
  c_mktsegment department, 'E' || (c_custkey // 10) manager,
  case c_custkey % 20 when 0 then 'terminated' when 1 then 'contractor' when 2 then 'leave' else 'active' end employment_status,
  case when c_custkey % 23 = 0 then 'Domain Admin' else '' end admin_info,
  case when c_custkey % 17 = 0 then 'E' || c_custkey else 'u' || c_custkey || '@acme.com' end canonical_id,
  lower({_person('c_custkey')}) normalized_name
 from customer)"""
OKTA = f"""okta as (
 select case when o_orderkey % 10 < 7 then 'u' || o_custkey || '@acme.com'
   when o_orderkey % 10 = 9 then 'x' || o_orderkey || '@other.org' else '' end email,
  case when o_orderkey % 10 = 7 then 'E' || o_custkey else '' end user_id,
  case when o_orderkey % 50 = 9 then 'Ghost Account' when o_orderkey % 3 = 0 then person
   when o_orderkey % 3 = 1 then person || 'q' else substr(person, 1, 3) || 'z' || substr(person, 5) end display_name,
  o_orderpriority as role,
  case when o_orderkey % 11 = 0 then 'Admin Console' when o_orderkey % 13 = 0 then 'Reader, Writer' else 'Reader' end entitlement,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') last_login,
  case o_orderstatus when 'O' then 'active' when 'F' then 'disabled' else 'locked' end account_status,
  'okta' as system, o_orderkey + 1 source_row
 from (select *, {_person('o_custkey')} person from orders))"""
AWS = f"""aws as (
 select case when user_id % 9 = 8 then '' else 'u' || user_id || '@acme.com' end email, 'E' || user_id user_id,
  {_person('user_id')} display_name,
  case when event_id % 7 = 0 then event_type || '; Root, ' || upper(event_type) else event_type end as role,
  case when event_id % 5 = 0 then 'Billing Owner' else '' end entitlement,
  strftime(ts, '%Y-%m-%dT%H:%M:%SZ') last_login,
  case when event_id % 4 = 0 then 'active' else 'true' end account_status, 'aws' as system, event_id + 1 source_row
 from events)"""
SAP = """sap as (
 select '' email, case when s_suppkey % 2 = 0 then 'E' || s_suppkey else '' end user_id, s_name display_name,
  case when s_nationkey < 5 then 'System Owner' else 'Clerk' end as role, '' entitlement, '' last_login,
  '' account_status, 'sap' as system, s_suppkey + 1 source_row from supplier)"""
ACCOUNTS = f"{IDENT}, {OKTA}, {AWS}, {SAP}, acc as (select * from okta union all by name select * from aws union all by name select * from sap)"
OKTA_ONLY = f"{IDENT}, {OKTA}, acc as (select * from okta)"

NAMES = "names as (select normalized_name name_key, count(*) holders, min(sot_ord) sot_ord from ident group by 1)"
SIM = "case when {a} = {b} then 1.0::double else 1.0::double - levenshtein({a}, {b})::double / greatest(length({a}), length({b}))::double end"


def _resolve(probes: str) -> str:
    """names, pairs, best and res(name_key, match_type, sot_ord) for a CTE ``probes`` (name_key)."""
    return f"""{NAMES}, probes as ({probes}),
 pairs as (select p.name_key probe, n.name_key, n.holders, n.sot_ord, {SIM.format(a='p.name_key', b='n.name_key')} score
  from probes p join names n on abs(length(p.name_key) - length(n.name_key)) <= 4 and p.name_key <> n.name_key
  where {SIM.format(a='p.name_key', b='n.name_key')} >= 0.85),
 ranked as (select p.probe, p.name_key, p.score, i.sot_ord,
   row_number() over (partition by probe order by score desc, i.sot_ord) rn
  from pairs p join ident i on i.normalized_name = p.name_key),
 best as (select a.probe, a.name_key, a.score, a.sot_ord,
   case when b.probe is null or a.score - b.score >= 0.10 then 'fuzzy_name' else 'fuzzy_ambiguous' end match_type
  from ranked a left join ranked b on a.probe = b.probe and b.rn = 2 where a.rn = 1),
 res as (select p.name_key, case when n.holders = 1 then 'fuzzy_name' else 'fuzzy_ambiguous' end match_type, n.sot_ord
   from probes p join names n using (name_key)
  union all select b.probe, b.match_type, b.sot_ord from best b where b.probe not in (select name_key from names))"""


OPEN = """open as (select a.*, e.sot_ord mail_ord, i.sot_ord id_ord from acc a
  left join ident e on a.email <> '' and a.email = e.email
  left join ident i on a.user_id <> '' and a.user_id = i.employee_id)"""
MATCHED = f"""{OPEN},
 {_resolve("select distinct lower(display_name) name_key from open where mail_ord is null and id_ord is null and display_name <> ''")},
 typed as (select o.* exclude (mail_ord, id_ord),
   case when mail_ord is not null then 'exact_email' when id_ord is not null then 'exact_id'
    else coalesce(r.match_type, 'orphan') end match_type,
   coalesce(mail_ord, id_ord, r.sot_ord) sot_ord
  from open o left join res r on o.mail_ord is null and o.id_ord is null and r.name_key = lower(o.display_name)),
 matched as (select t.*, coalesce(i.canonical_id, '') s_canonical, coalesce(i.employee_id, '') s_employee,
   coalesce(i.display_name, '') s_name, coalesce(i.email, '') s_email, coalesce(i.department, '') s_department,
   coalesce(i.manager, '') s_manager, coalesce(i.employment_status, '') s_status, coalesce(i.admin_info, '') s_admin,
   case when i.display_name <> '' and t.display_name <> '' and lower(i.display_name) <> lower(t.display_name) then 1 else 0 end n_conflicts,
   concat_ws('; ', case when t.email <> '' then 'email:' || t.email end,
    case when t.match_type <> 'exact_email' and t.user_id <> '' then 'employeeId:' || t.user_id end,
    case when t.match_type not in ('exact_email', 'exact_id') and t.display_name <> '' then 'name:' || lower(t.display_name) end) attempted
  from typed t left join ident i on i.sot_ord = t.sot_ord)"""


def _any(text: str, words=PRIVILEGED) -> str:
    return "(" + " or ".join(f"contains(lower({text}), '{w.lower()}')" for w in words) + ")"


LIVE_LEVEL = """case when match_type = 'orphan' then {orphan} when s_status = 'terminated' and account_status = 'active' then {leaver}
 when match_type = 'fuzzy_ambiguous' then {amb} when match_type = 'fuzzy_name' then {fuzzy} when match_type = 'exact_id' then {id} else {mail} end"""
LEVEL = LIVE_LEVEL.format(orphan="'HIGH'", leaver="'CRITICAL'", amb="'HIGH'", fuzzy="'MEDIUM'", id="'LOW'", mail="'INFO'")
SCORE = LIVE_LEVEL.format(orphan="75", leaver="95", amb="70", fuzzy="50", id="25", mail="10")
LIVE = f"""live as (select (case when match_type = 'orphan' then 'orphan' else s_canonical end) || '::' || system || '::' || source_row record_id,
  case when match_type = 'orphan' then user_id else s_employee end employee_id,
  case when match_type = 'orphan' then display_name else s_name end display_name,
  case when match_type = 'orphan' then email else s_email end email, s_status employment_status, s_manager manager,
  s_department department, system,
  concat_ws('; ', nullif(role, ''), nullif(s_admin, '')) as role, entitlement, last_login, account_status, match_type,
  {LEVEL} risk_level, {SCORE} risk_score, source_row from matched)"""


def _tokens(source: str, key: str, order: str, field: str) -> str:
    """(key, value): united list of ``field`` per key."""
    return f"""(select {key}, string_agg(tok, ', ' order by o) u from (
   select {key}, arg_min(tok, o) tok, min(o) o from (
    select {key}, trim(t) tok, {order} * 1000 + pos o from (
     select {key}, {order}, unnest(string_split_regex({field}, '[,;]')) t,
      generate_subscripts(string_split_regex({field}, '[,;]'), 1) pos from {source}))
   where tok <> '' group by {key}, lower(tok)) group by {key})"""


def _set(field: str) -> str:
    return (
        f"array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split_regex({field}, '[,;]'),"
        f" lambda x: lower(trim(x))), lambda x: x <> ''))), ',')"
    )


KEY = "(case when email <> '' then lower(email) else 'name:' || lower(display_name) end) || '::' || system"
REPORT = f"""{LIVE},
 keyed as (select *, {KEY} k, {_set('role')} roleset from live),
 grp as (select k, count(*) n, max(risk_score) mx, arg_max(risk_level, risk_score) lv, max(nullif(last_login, '')) ll,
   min(source_row) first_row, count(distinct roleset) sets from keyed group by k),
 ru as {_tokens('keyed', 'k', 'source_row', 'role')}, eu as {_tokens('keyed', 'k', 'source_row', 'entitlement')},
 report as (select r.record_id, r.employee_id, r.display_name, r.email, r.employment_status, r.manager, r.department, r.system,
   case when n = 1 then r.role else coalesce(ru.u, '') end as role,
   case when n = 1 then r.entitlement else coalesce(eu.u, '') end entitlement,
   coalesce(g.ll, '') last_login, r.account_status, r.match_type, g.lv risk_level, g.mx risk_score, r.source_row,
   case when g.sets > 1 then 'flag' else '' end review_action,
   case when g.sets > 1 then 'Duplicate entries found with different roles (' || n || ' rows merged)' else '' end review_note
  from grp g join keyed r on r.k = g.k and r.source_row = g.first_row
  left join ru on ru.k = g.k left join eu on eu.k = g.k)"""
REPORT_VIEW = (
    "record_id, employee_id, display_name, email, employment_status, system, role, entitlement, last_login,"
    " account_status, match_type, risk_level, risk_score, source_row"
)
M = f"with {ACCOUNTS}, {MATCHED}"
RPT = f"{M}, {REPORT}"

DORMANT = f"coalesce(try_strptime(last_login, '%Y-%m-%dT%H:%M:%SZ') < make_timestamp({NOW_MS - 90 * 86_400_000}::bigint * 1000), false)"
PRIV = f"({_any('role')} or {_any('entitlement')})"
POLICY_CASE = f"""case when match_type = 'orphan' then {{o}} when s_status = 'terminated' and account_status in ('active', 'enabled', '') then {{c}}
 when {PRIV} and {DORMANT} then {{h}} when {PRIV} or {DORMANT} then {{m}} when match_type = 'fuzzy_ambiguous' then {{l}} else {{i}} end"""
ENTRIES = f"""entries as (select s_canonical canonical_id, s_employee employee_id,
  case when match_type = 'orphan' then display_name else s_name end display_name,
  case when match_type = 'orphan' then email else s_email end email, s_department department, s_manager manager,
  s_status employment_status, system, role, entitlement, last_login, account_status, match_type,
  {POLICY_CASE.format(o="'HIGH'", c="'CRITICAL'", h="'HIGH'", m="'MEDIUM'", l="'LOW'", i="'INFO'")} risk_level,
  {POLICY_CASE.format(o=80, c=100, h=80, m=50, l=20, i=0)} risk_score, system source_file, source_row, n_conflicts::bigint n_conflicts
  from matched
  union all
  select canonical_id, employee_id, display_name, email, department, manager, employment_status, '', '', '', '', '', 'no_access',
   'INFO', 0, '', 0, 0::bigint from ident where canonical_id not in (select s_canonical from matched where match_type <> 'orphan'))"""
ENT = f"{M}, {ENTRIES}"

CROWD = f"""{IDENT}, raw as (select sot_ord, case when sot_ord % 5 = 0 then '' else 'd' || (sot_ord % 97) || '@acme.com' end email,
  case when sot_ord % 3 = 0 then '' else 'E' || (sot_ord // 2) end employee_id,
  case when sot_ord % 2 = 0 then '' else normalized_name end normalized_name from ident),
 crowd as (select *, case when email <> '' then email else employee_id end canonical_id from raw)"""

_BLANK = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _normalize(c: str) -> str:
    s = f"strip_accents(lower(regexp_replace({c}, '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g')))"
    for suffix in SUFFIXES:
        s = f"regexp_replace(regexp_replace({s}, ' {suffix}$', ''), ',{suffix}$', '')"
    s = rf"regexp_replace({s}, '\b[a-z]\.?[\t\n\f\r ]', '', 'g')"
    s = rf"regexp_replace({s}, '[\t\n\f\r ]+', ' ', 'g')"
    s = (
        rf"regexp_replace({s}, '(?s)^[{_BLANK}]*([^,{_BLANK}](?:[^,]*[^,{_BLANK}])?)[{_BLANK}]*,"
        rf"[{_BLANK}]*([^{_BLANK}](?:.*[^{_BLANK}])?)[{_BLANK}]*$', '\2 \1')"
    )
    return f"regexp_replace({s}, '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g')"


# Review ---------------------------------------------------------------------------------------
LOG = """log0 as (select event_id seq, cast(event_id % 7 as varchar) review_id,
  case when event_id % 5 < 2 then 'record' when event_id % 5 < 4 then 'role' else 'name' end kind, 'r' || user_id record_id,
  case when event_id % 5 in (2, 3) then event_type end as role,
  case event_id % 4 when 0 then 'approve' when 1 then 'revoke' when 2 then 'flag' end action,
  case when event_id % 3 = 0 then '' else 'n' || event_id end note,
  case when event_id % 5 = 4 then 'Name ' || event_id end display_name,
  case when event_id % 2 = 0 then 'b' || (event_id // 20) end batch_id from events)"""


def _folded(log: str, extra: str = "", action: str = "agreed", select: str | None = None) -> str:
    """Fold of a log query by looking at each record's last record event and later role events."""
    out = select or """select b.record_id, coalesce(n.display_name, b.c_name) display_name, coalesce(case
   when lr.seq > coalesce(rec.seq, -1) then ag.agreed when rec.seq is not null then rec.action end, '') review_action,
  coalesce(case when rn.seq > coalesce(rec.seq, -1) then rn.note when rec.seq is not null then rec.note end, '') review_note,
  coalesce(ag.txt, '') role_actions"""
    return f"""with {LOG}{extra}, log as ({log}),
 base as (select 'r' || c_custkey record_id, c_name, c_mktsegment from customer),
 rec as (select record_id, max(seq) seq, arg_max(coalesce(action, '?'), seq) a0, arg_max(note, seq) note from log where kind in ('record', 'note') group by 1),
 rec2 as (select record_id, seq, nullif(a0, '?') action, note from rec),
 roles as (select l.record_id, l.role, max(l.seq) seq, arg_max(coalesce(action, '?'), l.seq) a0, min(l.seq) first_seq from log l where kind = 'role' group by 1, 2),
 vals as (select r.record_id, r.role, r.seq, r.first_seq, case when r.seq > coalesce(c.seq, -1) then nullif(a0, '?') else c.action end v
  from roles r left join rec2 c using (record_id)),
 ag as (select record_id, case when count(*) = count(v) and count(distinct v) = 1 then min(v) end agreed,
   string_agg(role || ':' || coalesce(v, '-'), '; ' order by role || ':' || coalesce(v, '-')) txt,
   string_agg(role || ':' || v, '; ' order by first_seq) filter (v is not null) txt2 from vals group by 1),
 lr as (select record_id, max(seq) seq from roles group by 1),
 rn as (select record_id, max(seq) seq, arg_max(note, seq) note from log where kind = 'role' and note <> '' group by 1),
 n as (select record_id, arg_max(display_name, seq) display_name from log where kind = 'name' group by 1)
 {out}
 from base b left join rec2 rec using (record_id) left join ag using (record_id) left join lr using (record_id)
 left join rn using (record_id) left join n using (record_id)"""


ACTION_NOW = """coalesce(case when lr.seq > coalesce(rec.seq, -1) then ag.agreed when rec.seq is not null then rec.action end, '')"""
EROWS = f"""erows as (select 'e' || event_id record_id, 'Person ' || user_id display_name,
  case when user_id % 9 = 8 then '' else 'u' || user_id || '@acme.com' end email, user_id,
  case when event_id % 2 = 0 then 'aws' else 'gcp' end as system,
  case when user_id % 4 = 0 then 'Viewer' when event_id % 7 = 0 then event_type || '; Root' else event_type end as role,
  case when event_id % 5 = 0 then 'Billing, Owner' else '' end entitlement, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') last_login,
  case when event_id % 11 = 0 then 'approve' when event_id % 13 = 0 then 'revoke' end review_action,
  case when event_id % 17 = 0 then 'note ' || event_id else '' end review_note, event_id,
  ['INFO', 'LOW', 'MEDIUM', 'HIGH'][event_id % 4 + 1] risk_level, [10, 25, 50, 70][event_id % 4 + 1] risk_score from events)"""

HEADERS = [
    "Email Address", "user_id", "Full-Name", "emp_id", "last_login_date", "Group Name", "Status",
    "Access Level", "mail", "Dept", "Reports To", "notes", "Employee ID", "UPN", "name", "loginName",
    "EmpStatus", "memberOf", "lastlogon", "permissions",
]
_TARGET = "case " + " ".join(
    f"when n = '{h}' then '{t}'" for t, hs in HEADER_WORDS.items() for h in hs.split()
) + " end"
_PARTS = "list_filter([" + ", ".join(
    f"case when contains(n, '{p}') then '{t}' end" for ps, t in PARTS for p in ps.split()
) + "], lambda x: x is not null)"


def sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["match_cascade"] = f"with {OKTA_ONLY}, {MATCHED} select source_row, match_type, s_canonical canonical_id, n_conflicts::bigint n_conflicts from matched"
    q["exact_email_join"] = f"with {ACCOUNTS} select a.system, a.source_row, i.employee_id from acc a join ident i on a.email <> '' and a.email = i.email"
    q["exact_id_join"] = f"with {ACCOUNTS} select a.system, a.source_row, i.employee_id from acc a join ident i on a.user_id <> '' and a.user_id = i.employee_id"
    probes = _resolve("select distinct lower(display_name) name_key from okta where display_name <> ''")
    q["exact_name_lookup"] = f"with {IDENT}, {OKTA}, {NAMES} select n.name_key, n.holders, 'E' || n.sot_ord first_holder from names n where n.name_key in (select lower(display_name) from okta)"
    q["fuzzy_broad_join"] = f"with {IDENT}, {OKTA}, {probes} select probe, name_key, round(score, 9) score from pairs"
    q["name_index_update"] = f"with {IDENT}, {OKTA}, {probes} select p.probe, p.name_key, n.holders::bigint holders, round(p.score, 9) score from pairs p join names n using (name_key)"
    q["fuzzy_top2_decision"] = f"with {IDENT}, {OKTA}, {probes} select probe, name_key, round(score, 9) score, match_type from best"
    q["name_resolution"] = f"with {IDENT}, {OKTA}, {probes} select name_key, match_type, 'E' || sot_ord employee_id from res"
    q["orphans"] = f"{M} select system source_file, system source_system, user_id, display_name, role, account_status, last_login, attempted attempted_keys from matched where match_type = 'orphan'"
    sap = f"with {IDENT}, {SAP}, acc as (select * from sap), {MATCHED}, {ENTRIES}"
    q["no_access_users"] = f"{sap} select canonical_id, employee_id, display_name, email from entries where match_type = 'no_access'"
    hired = IDENT.replace("ident as (", "everyone as (", 1) + ", ident as (select * from everyone where sot_ord % 41 <> 5)"
    assert IDENT in M and hired != IDENT
    q["identity_update"] = f"{M.replace(IDENT, hired)} select system, source_row, match_type, coalesce(s_canonical, '') canonical_id, attempted, n_conflicts::bigint n_conflicts from matched"
    q["match_all_systems"] = f"{M} select system, source_row, match_type, coalesce(s_canonical, '') canonical_id, n_conflicts::bigint n_conflicts from matched"
    q["user_entry_rows"] = f"{ENT} select * from entries where match_type <> 'orphan'"
    fields = "['email', 'userId', 'employeeId', 'displayName', 'department', 'manager', 'employmentStatus', 'accountStatus', 'role', 'entitlement', 'lastLogin', 'salary']"
    q["rejected_mappings"] = f"""with e as (select l_orderkey unit, l_linenumber::bigint pos, 'h' || l_linenumber as source, {fields}[l_suppkey % 12 + 1] target from lineitem),
      o as (select *, first_value(source) over w owner, row_number() over w n from e window w as (partition by unit, target order by pos))
      select unit, pos, source, target, case when target = 'salary' then 'unknown field salary' else target || ' already mapped to ' || owner end problem
      from o where target = 'salary' or n > 1"""
    q["snapshot_clear"] = f"{RPT} select record_id, system, role, risk_level, risk_score, source_row from report where risk_level = 'HIGH'"
    q["review_folders"] = f"{RPT} select {REPORT_VIEW.replace('record_id, ', '').replace(', source_row', '')} from report"
    q["file_sheet"] = "select url as name, case when page_id % 10 = 0 then 'Source of Truth' else 'Satellite' end as type, sha256(html) as hash from pages"
    q["attempted_keys"] = f"{M} select system, source_row, attempted from matched"
    q["field_conflicts"] = f"{M} select s_canonical canonical_id, 'displayName' field, s_name sot_value, display_name satellite_value, 'sot_wins' resolution from matched where n_conflicts = 1"
    q["similarity"] = f"{M} select system, source_row, round({SIM.format(a='lower(display_name)', b='lower(s_name)')}, 9) score from matched where match_type <> 'orphan'"
    q["join_stats"] = f"""{M} select system, count(*) total_processed, count(*) filter (match_type = 'exact_email') exact_email,
      count(*) filter (match_type = 'exact_id') exact_id, count(*) filter (match_type = 'fuzzy_name') fuzzy_name,
      count(*) filter (match_type = 'fuzzy_ambiguous') ambiguous, count(*) filter (match_type = 'orphan') orphans from matched group by 1"""
    q["identity_first_wins"] = f"""with {CROWD} select 'email' kind, email as key, min(sot_ord) winner from crowd where email <> '' group by 2
      union all select 'id', employee_id, min(sot_ord) from crowd where employee_id <> '' group by 2"""
    q["people_reachable"] = f"""with {CROWD}, w as (select sot_ord, min(rank) rank from (
       select min(sot_ord) sot_ord, 0 rank from crowd where email <> '' group by email
       union all select min(sot_ord), 1 from crowd where employee_id <> '' group by employee_id
       union all select sot_ord, 2 from crowd where normalized_name <> '') group by 1)
      select canonical_id, arg_min(c.sot_ord, rank * 100000000 + c.sot_ord) sot_ord from crowd c join w using (sot_ord) group by 1"""
    q["identity_stats"] = f"""with {IDENT} select count(*) total_records, count(*) filter (employment_status <> 'terminated') active_count,
      count(*) filter (employment_status = 'terminated') terminated_count, count(distinct nullif(email, '')) unique_emails from ident"""
    q["risk_live"] = f"{M} select system, source_row, match_type, {LEVEL} risk_level, {SCORE} risk_score from matched"
    q["risk_policy"] = f"{ENT} select canonical_id, system, source_row, match_type, risk_level, risk_score from entries"
    q["dormant_accounts"] = f"with {ACCOUNTS} select system, source_row, last_login from acc where {DORMANT}"
    q["parse_login_formats"] = """with t as (select o_orderkey, case o_orderkey % 12
        when 0 then strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') when 1 then strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+02:00'
        when 2 then strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') when 3 then strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
        when 4 then strftime(o_orderdate, '%Y-%m-%d') when 5 then strftime(o_orderdate, '%m/%d/%Y') when 6 then strftime(o_orderdate, '%-m/%-d/%Y')
        when 7 then strftime(o_orderdate, '%b %-d, %Y') when 8 then strftime(o_orderdate, '%B %-d, %Y') when 9 then strftime(o_orderdate, '%d-%b-%Y')
        when 10 then strftime(o_orderdate, '%Y%m%d') else 'never' end login, o_orderdate d from orders)
      select o_orderkey, login, case when o_orderkey % 12 >= 10 then -1 when o_orderkey % 12 = 1 then epoch(d)::bigint - 7200
        else epoch(d)::bigint end epoch from t"""
    q["privileged_accounts"] = f"with {ACCOUNTS} select system, source_row, role, entitlement from acc where {PRIV}"
    w = ("URGENT", "purchase")
    q["privileged_custom_keywords"] = f"with {ACCOUNTS} select system, source_row, role from acc where {_any('role', w)} or {_any('entitlement', w)}"
    q["normalize_name"] = f"""with s as (select doc_id, unnest(string_split_regex(text, '[.\\n]')) as name, generate_subscripts(string_split_regex(text, '[.\\n]'), 1) - 1 pos from documents)
      select doc_id, pos, {_normalize('name')} normalized from s"""
    q["strip_diacritics"] = "select word, strip_accents(word) stripped from (select distinct unnest(string_split_regex(text, '[ \\n]')) word from documents)"
    q["token_union"] = f"""with {AWS}, r as {_tokens('aws', 'user_id', 'source_row', 'role')}, e as {_tokens('aws', 'user_id', 'source_row', 'entitlement')}
      select user_id, r.u role_union, coalesce(e.u, '') entitlement_union from r left join e using (user_id)"""
    q["live_report_rows"] = f"{M}, {LIVE} select {REPORT_VIEW} from live"
    q["dedupe_identity"] = f"{RPT} select {REPORT_VIEW}, review_action, review_note from report"
    q["role_difference_flag"] = f"{RPT} select record_id, review_note from report where review_action = 'flag'"
    q["policy_report"] = f"{ENT} select * from entries"
    levels = "(values ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW'), ('INFO')) v(risk_level)"
    q["risk_summary"] = f"{RPT} select v.risk_level, count(r.record_id) records from {levels} left join report r using (risk_level) group by 1"
    q["live_pipeline"] = q["risk_summary"]
    order = "system || lpad(source_row::varchar, 12, '0')"
    q["user_summary"] = f"""{ENT} select canonical_id, coalesce(arg_min(nullif(display_name, ''), {order}), '') display_name,
      coalesce(arg_min(nullif(email, ''), {order}), '') email, arg_max(risk_level, risk_score) max_risk_level, max(risk_score) max_risk_score,
      count(*) entries from entries where match_type <> 'orphan' group by 1"""
    q["user_entries"] = f"{ENT} select canonical_id, count(*) entries from entries where match_type <> 'orphan' group by 1"
    q["report_totals"] = f"""{ENT} select count(distinct case when match_type <> 'orphan' then canonical_id end) users,
      count(*) filter (match_type not in ('orphan', 'no_access')) matched, count(*) filter (match_type = 'orphan') orphans,
      count(*) filter (match_type = 'no_access') no_access from entries"""
    q["kept_totals"], q["kept_join_stats"] = q["report_totals"], q["join_stats"]
    q["kept_risk_summary"] = f"{ENT} select v.risk_level, count(e.risk_level) records from {levels} left join (select * from entries where match_type <> 'no_access') e using (risk_level) group by 1"
    q["kept_user_summary"] = q["user_summary"].replace("match_type <> 'orphan'", "match_type not in ('orphan', 'no_access')")
    totals = """(select count(*) filter (match_type <> 'orphan') from report) total_matched,
      (select count(*) filter (match_type = 'orphan') from report) total_orphans,
      (select count(*) filter (risk_level = 'CRITICAL') from report) critical_findings,
      (select sum(n_conflicts)::bigint from matched) total_conflicts"""
    q["export_totals"] = f"{RPT} select {totals}"
    q["run_metadata"] = f"{RPT} select (select count(*) from ident) total_sot_users, {totals}"
    q["systems"] = f"{RPT} select distinct system from report where system <> ''"
    admin = f"""adm as (select lower(email) email, system || ': ' || tok entry, system || lpad(source_row::varchar, 12, '0') || record_id || lpad(pos::varchar, 6, '0') o from (
       select email, system, source_row, record_id, trim(t) tok, pos from (select *, unnest(string_split_regex(role, '[,;]')) t,
         generate_subscripts(string_split_regex(role, '[,;]'), 1) pos from report)) where {_any('tok')}),
      adm2 as (select email, string_agg(entry, ' | ' order by o) admin_roles from (select email, entry, min(o) o from adm group by 1, 2) group by 1)"""
    q["admin_roles"] = f"{RPT}, {admin} select * from adm2"
    entries = admin.replace("select lower(email) email,", "select system, source_row, record_id, lower(email) email,", 1)
    q["admin_role_entries"] = f"{RPT}, {entries} select email, entry, system, source_row, record_id from (select *, row_number() over (partition by email, entry order by o) rn from adm) where rn = 1"
    cell = "role || case when entitlement <> '' then ' (' || entitlement || ')' else '' end"
    user = "case when email <> '' then lower(email) else 'name:' || lower(display_name) end"
    q["access_matrix"] = f"{RPT} select {user} as user, " + ", ".join(
        f"coalesce(string_agg(distinct {cell}, ' | ' order by {cell}) filter (system = '{s}'), '-') as {s}" for s in ("aws", "okta", "sap")
    ) + " from report group by 1"
    q["access_cells"] = f"{RPT} select {user} as user, system, string_agg(distinct {cell}, ' | ' order by {cell}) as cell from report where {cell} <> '' group by 1, 2"
    own = ", ".join(f"case when system = '{s}' then {cell} else '-' end as {s}" for s in ("aws", "okta", "sap"))
    q["access_matrix_rows"] = f"{RPT} select record_id, display_name, email, {own} from report"
    row_priv = _any("role || ' ' || entitlement")
    q["filter_presets"] = f"""{RPT} select count(*) as all, count(*) filter (match_type = 'orphan') orphans, count(*) filter (match_type = 'fuzzy_ambiguous') conflicts,
      count(*) filter (employment_status = 'terminated' and account_status = 'active') terminated_active, count(*) filter ({row_priv}) admins from report"""
    q["filter_admins"] = f"{RPT} select record_id, role, entitlement from report where {row_priv}"
    q["search"] = f"{RPT} select record_id, display_name, email from report where " + " or ".join(
        f"contains(lower({c}), 'u12')" for c in ("display_name", "email", "system", "role", "entitlement")
    )
    q["indexed_search"] = q["search"]
    q["indexed_search_words"] = q["search"].replace("'u12'", "'billing own'")
    q["filter_combined"] = f"""{RPT} select record_id, risk_level, system from report where system = 'okta' and risk_level = 'HIGH' and (
      contains(lower(display_name), 'reader') or contains(lower(email), 'reader') or contains(lower(role), 'reader') or contains(lower(entitlement), 'reader'))"""
    q["sort_topk"] = f"{RPT} select record_id, risk_score, row_number() over (order by risk_score desc, record_id) as position from report"
    q["sort_by_name"] = f"{RPT} select display_name, record_id, row_number() over (order by lower(display_name), record_id) as position from report"
    q["select_filtered"] = f"{RPT} select record_id, match_type from report where match_type = 'orphan' and source_row % 3 <> 0"
    q["select_by_ids"] = f"{RPT} select record_id, risk_level from report where employee_id in (select 'E' || c_custkey from customer where c_nationkey = 3)"
    q["column_projection"] = f"""{RPT}, {admin} select record_id, display_name, r.email, coalesce(a.admin_roles, '') admin_roles, department, employment_status,
      {own}, risk_level, risk_score, manager from report r left join adm2 a on lower(r.email) = a.email"""
    q["review_fold_record"] = _folded("select * from log0 where kind <> 'role'")
    q["review_fold_role"] = _folded("select * from log0")
    q["role_action_text"] = _folded(
        "select * from log0 where kind = 'record' or role = 'click'",
        select=f"select b.record_id, coalesce(nullif(ag.txt2, ''), {ACTION_NOW}) review_action",
    )
    q["bulk_action"] = _folded(
        "select 1 seq, '' review_id, 'record' kind, 'r' || c_custkey record_id, null::varchar as role, 'approve' action, '' note, null::varchar display_name, 'bulk-1' batch_id from customer where c_mktsegment = 'MACHINERY'"
    )
    q["undo_batch"] = _folded("select * from log0 where batch_id is null or batch_n % 3 <> 0 or batch_n % 9 = 0".replace("batch_n", "substr(batch_id, 2)::bigint"))
    q["folded_log"] = q["undo_batch"]
    q["undo_redo_last"] = _folded("select * from log0 where coalesce(batch_id, '#' || seq) <> (select arg_max(coalesce(batch_id, '#' || seq), seq) from log0)")
    q["toggle_role"] = _folded(
        "select * from log0",
        select="select b.record_id, case when (select v from vals where vals.record_id = b.record_id and vals.role = 'click') = 'approve' then '' else 'approve' end action",
    )
    q["note_edits"] = _folded(
        "select * from log0 where kind = 'record'",
        select=f"select b.record_id, b.c_name display_name, {ACTION_NOW} review_action, 'see ' || substr(b.record_id, 2) review_note, '' role_actions",
    )
    q["name_edits"] = "select 'r' || c_custkey record_id, case when c_custkey % 3 = 2 then 'New ' || c_custkey else c_name end display_name, '' review_action, '' review_note, '' role_actions from customer"
    q["history_retention"] = f"""with {LOG}, r as (select *, row_number() over (partition by review_id order by seq desc) rn from log0),
      edge as (select review_id, batch_id eb from r where rn = 101),
      j as (select r.*, eb from r left join edge using (review_id) where rn <= 100),
      o as (select review_id, coalesce(max(rn) filter (batch_id is distinct from eb), 0) last_rn from j group by 1)
      select review_id, seq, record_id from j join o using (review_id) where eb is null or rn <= last_rn"""
    q["manual_merge"] = f"""with {EROWS}, mem as (select *, max(event_id) over (partition by user_id) top,
        case when event_id = max(event_id) over (partition by user_id) then 0 else 1 end sec from erows where user_id % 2 = 0),
      mo as (select *, row_number() over (partition by user_id order by sec, system, event_id, record_id) o from mem),
      ru as {_tokens('mo', 'user_id', 'o', 'role')}, eu as {_tokens('mo', 'user_id', 'o', 'entitlement')},
      g as (select user_id, count(*) n, max(risk_score) rs, arg_max(risk_level, risk_score) rl, max(nullif(last_login, '')) ll from mem group by 1)
      select m.record_id, case when n > 1 then coalesce(ru.u, '') else m.role end as role, case when n > 1 then coalesce(eu.u, '') else m.entitlement end entitlement,
       g.ll last_login, g.rl risk_level, g.rs risk_score, coalesce(m.review_action, '') review_action
      from mem m join g using (user_id) left join ru using (user_id) left join eu using (user_id) where m.event_id = m.top
      union all select record_id, role, entitlement, last_login, risk_level, risk_score, coalesce(review_action, '') from erows where user_id % 2 = 1"""
    q["upsert_preserve_review"] = f"""with {EROWS} select record_id, case when event_id % 3 = 1 then 'Old' else role end as role,
      case when event_id % 3 = 1 then 'active' else 'locked' end account_status,
      case when event_id % 3 = 0 then '' else coalesce(review_action, '') end review_action, case when event_id % 3 = 0 then '' else review_note end review_note from erows"""
    q["employee_file"] = f"with {IDENT} select canonical_id, employee_id, display_name, email, department, manager, employment_status, admin_info, normalized_name from ident"
    q["json_mapping"] = """select 'crm' as system, s_suppkey::varchar user_id, s_name display_name, 'x/' || s_name as role, lower(s_name) || '@x.example' email from supplier"""
    q["file_errors"] = """select 'nation=' || s_nationkey as name, case when s_nationkey % 2 = 1 then 'error' else 'pending' end as status,
      case when s_nationkey % 2 = 1 then 'file contains no data rows' else '' end as error,
      case when s_nationkey % 2 = 1 then 0 else count(*) end as rows_read from supplier group by s_nationkey"""
    q["snapshot_round_trip"] = f"{RPT} select record_id, system, role, risk_level, risk_score, source_row from report"
    q["file_fingerprint"] = """with r as (select o_custkey % 6 g, c, o_orderkey k, o_totalprice p from orders, unnest([0, 1, 2]) t(c)),
      u as (select 'unit=' || g || '-' || c as name, string_agg(k || ',' || p, chr(10) order by case when c = 2 then -k else k end) as content from r group by g, c)
      select name, min(name) over (partition by content) as first_name, name = min(name) over (partition by content) as registered from u"""
    # The ordered fold, one row per step; seen = the united role set so far.
    rs = "list_distinct(list_filter(list_transform(string_split_regex({r}, '[,;]'), lambda x: lower(trim(x))), lambda x: x <> ''))"
    differ = "(len(f.seen) <> len(c.rs) or len(list_filter(c.rs, lambda x: not list_contains(f.seen, x))) > 0)"
    lead = "f.risk_score >= c.risk_score"
    q["cross_batch_merge"] = f"""with recursive {EROWS}, o as (select *, {KEY} k, {rs.format(r='role')} rs,
        row_number() over (partition by {KEY} order by case when event_id % 3 = 0 then 1 else 0 end, system, event_id) step from erows),
      f as (select k, step, record_id, risk_level, risk_score, rs seen, review_action, review_note from o where step = 1
       union all select c.k, c.step, case when {lead} then f.record_id else c.record_id end,
        case when {lead} then f.risk_level else c.risk_level end, case when {lead} then f.risk_score else c.risk_score end,
        list_distinct(list_concat(f.seen, c.rs)),
        case when {differ} then 'flag' when {lead} then coalesce(f.review_action, c.review_action) else coalesce(c.review_action, f.review_action) end,
        case when {lead} then case when f.review_note <> '' then f.review_note when {differ} then 'Duplicate entries found with different roles' else c.review_note end
         else case when c.review_note <> '' then c.review_note when {differ} then 'Duplicate entries found with different roles' else f.review_note end end
       from f join o c on c.k = f.k and c.step = f.step + 1),
      last as (select * from f where (k, step) in (select k, max(step) from o group by k)),
      ru as {_tokens('o', 'k', 'step', 'role')}, eu as {_tokens('o', 'k', 'step', 'entitlement')},
      ll as (select k, count(*) n, max(nullif(last_login, '')) ll, min(role) raw_role, min(entitlement) raw_ent from o group by k)
      select record_id, case when n = 1 then raw_role else coalesce(ru.u, '') end as role, case when n = 1 then raw_ent else coalesce(eu.u, '') end entitlement,
       coalesce(ll.ll, '') last_login, risk_level, risk_score, coalesce(review_action, '') review_action, review_note
      from last join ll using (k) left join ru using (k) left join eu using (k)"""
    q["unprocessed_files"] = "with p as (select page_id, sha256(html) hash from pages) select * from p where hash not in (select hash from p where page_id % 2 = 0)"
    hs = "[" + ", ".join(f"'{h}'" for h in HEADERS) + "]"
    q["header_inference"] = f"""with recursive li as (select l_orderkey, {hs}[(l_partkey * 7 + l_linenumber) % {len(HEADERS)} + 1] h,
        row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) pos from lineitem),
      c as (select l_orderkey, pos, h, list_filter([{_TARGET}], lambda x: x is not null) || {_PARTS} cand from
        (select *, replace(replace(replace(lower(trim(h)), ' ', ''), '_', ''), '-', '') n from li)),
      t as (select l_orderkey, 0::bigint pos, ['']::varchar[] done from (select distinct l_orderkey from li)
        union all select t.l_orderkey, c.pos, list_append(t.done, coalesce(list_filter(c.cand, lambda x: not list_contains(t.done, x))[1], ''))
        from t join c on c.l_orderkey = t.l_orderkey and c.pos = t.pos + 1)
      select l_orderkey, (select string_agg(h, '|' order by pos) from li where li.l_orderkey = z.l_orderkey) headers,
       array_to_string(done[2:], '|') targets from (select l_orderkey, arg_max(done, pos) done from t group by 1) z"""
    q["concat_mapping"] = """select c_custkey, c_mktsegment || ' - ' || c_name display_name, c_mktsegment department,
      split_part(c_name, '#', 2) employee_id, c_name || '@' || c_mktsegment || '.example' email from customer"""
    q["auto_mapping"] = """select 'u' || s_suppkey || '@acme.com' email, '' user_id, s_name display_name,
      concat_ws('; ', 'Clerk', case when s_nationkey < 5 then 'Root' end, case when s_nationkey < 9 then 'Ops' end) as role,
      'enabled' account_status, s_suppkey + 1 source_row from supplier"""
    q["system_name"] = r"""with p as (select page_id, list_extract(string_split_regex(url, '[/.]'), -2) || ['_export', ' Users', '-ROLES', '_feed', 'accounts', ''][page_id % 6 + 1] || '.csv' file_name from pages),
      s as (select *, regexp_replace(file_name, '\.[^.]+$', '') stem from p)
      select page_id, file_name, coalesce(nullif(regexp_replace(stem, '[_\s-]?(export|users|roles|accounts|access|report|data|dump|extract)$', '', 'i'), ''), stem) as system from s"""
    q["csv_ingest"] = f"with {ACCOUNTS} select system, email, user_id, display_name, role, entitlement, last_login, account_status from acc"
    q["row_numbers"] = "select o_orderkey + 1 as ref, true in_place from orders"
    q["ragged_rows"] = """select case when s_suppkey % 3 <> 0 and s_suppkey % 5 = 0 then 'a, ' || s_name else s_name end as name, s_suppkey::varchar uid,
      case when s_suppkey % 3 = 0 then '' else 'x' end as role,
      case when s_suppkey % 3 = 0 then 'row has 2 columns, expected 3; padding with empty values'
       when s_suppkey % 5 = 0 then 'row has 5 columns, expected 3; truncating extra columns' else '' end message from supplier"""
    q["lenient_quotes"] = """select c_custkey as key, '5" disk ' || c_custkey as size,
      case c_custkey % 3 when 0 then 'first line of ' || c_custkey || chr(10) || 'second, with 6" and "seven"' || chr(10)
        when 1 then 'a "bare" quote, ' || c_custkey else 'plain' end as note, 'end' as "last" from customer"""
    q["many_layouts"] = """select 'unit=' || (c_custkey % 300) as system, c_custkey::varchar as user_id, 'u' || c_custkey || '@acme.com' as email,
      c_name as display_name, case when c_custkey % 2 = 0 then 'Root' else '' end as role from customer"""
    q["encoding_routing"] = "select doc_id, md5(text) md5, length(text)::bigint chars from documents"
    q["master_csv"] = f"{RPT} select record_id, employee_id, display_name, email, department, manager, employment_status, system, role, entitlement, last_login, account_status, match_type, risk_level, risk_score, review_action, review_note, system source_file, source_row from report"
    two = f"with {IDENT}, {OKTA}, {AWS}, acc as (select * from okta union all by name select * from aws), {MATCHED}, {REPORT}"
    q["incremental_add"] = f"{two} select {REPORT_VIEW} from report"
    q["stream_ingest"] = q["incremental_add"]
    return q
