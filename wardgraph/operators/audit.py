"""Audit rules: each is a function from a context to (object_id, name) rows, registered with its finding id and severity.

A rule sees ``nodes`` (with the property columns it names; rules whose columns are missing don't run), ``edges``, ``tiered`` and the
collection's clock. Missing booleans stay null: a rule that asks for false doesn't take null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import registry, scalars
from . import access
from .tiering import group_members

DAY = 86400


@dataclass
class Context:
    """tiered: nodes with tier and whatever property columns were collected. clock: epoch seconds, the latest stamp unless given.

    facts: tables beside the graph, by name; a rule names the one it needs as ``fact:name``. credentials, activations (role, mfa, approval), shadow (id,
    reason), unevaluated (definition), unresolved (who, role, scope), neutralized (src, dst, edge_type), policies (as ``access.policies``).
    """

    tiered: DataFrame
    edges: DataFrame
    clock: float | None = None
    facts: dict[str, DataFrame] = field(default_factory=dict)
    columns: set[str] = field(init=False)

    def __post_init__(self):
        self.columns = {*self.tiered.columns, *(f"fact:{name}" for name in self.facts)}
        stamps = [c for c in ("lastlogontimestamp", "lastlogon", "pwdlastset", "whencreated") if c in self.columns]
        if self.clock is None and stamps:
            self.clock = self.tiered.agg(F.max(F.greatest(*stamps) if len(stamps) > 1 else F.col(stamps[0]))).first()[0]

    def of(self, *types: str) -> DataFrame:
        return self.tiered.where(F.col("node_type").isin(list(types)) & F.coalesce("enabled", F.lit(True)))

    def older(self, column: str, days: int):
        return scalars.age_days(F.col(column), F.lit(self.clock)) > days


@dataclass(frozen=True)
class Rule:
    finding: str
    severity: str
    needs: tuple[str, ...]
    query: Callable[[Context], DataFrame]


RULES: dict[str, Rule] = {}


def rule(finding: str, severity: str, *needs: str):
    """Registers a rule; others may register their own."""

    def add(query):
        RULES[finding] = Rule(finding, severity, needs, query)
        return query

    return add


def _privileged():
    return (F.col("tier") == 0) | F.coalesce("admin_count", F.lit(False))


def _simple(finding: str, severity: str, needs: str, types: tuple[str, ...], condition: Callable[[], F.Column]) -> None:
    rule(finding, severity, *needs.split())(lambda c: c.of(*types).where(condition()))


_yes = lambda c: F.coalesce(F.col(c), F.lit(False))
_no = lambda c: F.coalesce(~F.col(c), F.lit(False))  # noqa: E731  false, not missing
_USER, _HOST, _DOMAIN = ("User",), ("Computer",), ("Domain",)
_spn = lambda: _yes("hasspn") & ~F.upper(scalars.display_name(F.col("name"))).isin("KRBTGT")

_simple("kerberoast-privileged", "critical", "hasspn", _USER, lambda: _spn() & _privileged())
_simple("kerberoast", "medium", "hasspn", _USER, lambda: _spn() & ~_privileged())
_simple("asrep-privileged", "critical", "dontreqpreauth", _USER, lambda: _yes("dontreqpreauth") & _privileged())
_simple("asrep", "high", "dontreqpreauth", _USER, lambda: _yes("dontreqpreauth") & ~_privileged())
_simple("passwd-notreqd", "high", "passwordnotreqd", _USER, lambda: _yes("passwordnotreqd"))
_simple("priv-pwd-never-expires", "medium", "pwdneverexpires", _USER, lambda: _yes("pwdneverexpires") & _privileged())
_simple("pwd-in-description", "critical", "description", ("User", "Computer"), lambda: F.col("description").rlike(r"(?i)\b(pass(word|wd)?|pwd|kennwort)\b\s*[:=]"))
_simple("sid-history", "medium", "sidhistory", ("User", "Group", "Computer"), lambda: F.size("sidhistory") > 0)
_simple("unconstrained-delegation", "high", "unconstraineddelegation isdc", ("User", "Computer"), lambda: _yes("unconstraineddelegation") & ~_yes("isdc"))
_simple("protocol-transition", "medium", "trustedtoauth", ("User", "Computer"), lambda: _yes("trustedtoauth"))
_simple("old-os", "high", "operatingsystem", _HOST, lambda: F.col("operatingsystem").rlike(r"(?i)\b(2000|2003|2008|2012|xp|vista|windows 7|windows 8)\b"))
_simple("no-laps", "medium", "haslaps isdc", _HOST, lambda: _no("haslaps") & ~_yes("isdc"))
_simple("old-functional-level", "medium", "functionallevel", _DOMAIN, lambda: F.col("functionallevel").rlike(r"2000|2003|2008|2012"))
_simple("machine-account-quota", "medium", "machineaccountquota", _DOMAIN, lambda: F.col("machineaccountquota") > 0)
_simple("guest-enabled", "medium", "", _USER, lambda: F.col("object_id").endswith("-501"))
_simple("svc-privileged", "high", "", _USER, lambda: (F.col("tier") == 0) & scalars.is_service_account(F.col("name")))
_simple("smb-signing-dc", "critical", "smbsigning isdc", _HOST, lambda: _no("smbsigning") & _yes("isdc"))
_simple("smb-signing", "medium", "smbsigning isdc", _HOST, lambda: _no("smbsigning") & ~_yes("isdc"))
_simple("ldap-signing", "high", "ldapsigning", _HOST, lambda: _no("ldapsigning"))
_simple("webclient", "medium", "webclientrunning", _HOST, lambda: _yes("webclientrunning"))


@rule("stale-privileged", "medium", "lastlogontimestamp")
def _stale_privileged(c: Context) -> DataFrame:
    return c.of("User").where(_privileged() & c.older("lastlogontimestamp", 90))


@rule("stale-computers", "low", "lastlogontimestamp")
def _stale_computers(c: Context) -> DataFrame:
    return c.of("Computer").where(c.older("lastlogontimestamp", 90))


@rule("krbtgt-old", "high", "pwdlastset")
def _krbtgt(c: Context) -> DataFrame:
    return c.tiered.where(F.col("object_id").endswith("-502") & c.older("pwdlastset", 180))


@rule("recent-privileged-object", "medium", "whencreated")
def _recent(c: Context) -> DataFrame:
    return c.of("User", "Group", "Computer").where(_privileged() & (scalars.age_days(F.col("whencreated"), F.lit(c.clock)) <= 30))


@rule("priv-not-protected", "medium", "sensitive")
def _not_protected(c: Context) -> DataFrame:
    groups = c.tiered.where(F.col("object_id").endswith("-525")).select(F.col("object_id").alias("id"))
    inside = group_members(groups, c.edges).select(F.col("member_id").alias("object_id"))
    return c.of("User").where((F.col("tier") == 0) & ~_yes("sensitive")).join(inside, "object_id", "left_anti")


@rule("admincount-orphan", "low")
def _orphan(c: Context) -> DataFrame:
    return c.of("User").where(_yes("admin_count") & (F.col("tier") != 0))


@rule("many-domain-admins", "medium")
def _many(c: Context) -> DataFrame:
    groups = c.tiered.where(F.col("object_id").endswith("-512")).select(F.col("object_id").alias("id"))
    members = group_members(groups, c.edges).join(c.of("User").select(F.col("object_id").alias("member_id")), "member_id", "left_semi")
    large = members.groupBy("group_id").agg(F.count_distinct("member_id").alias("n")).where("n > 5").select(F.col("group_id").alias("object_id"))
    return c.tiered.join(large, "object_id", "left_semi")


@rule("ea-sa-populated", "high")
def _enterprise(c: Context) -> DataFrame:
    groups = c.tiered.where(F.col("object_id").rlike("-(518|519)$")).select(F.col("object_id").alias("id"))
    inside = group_members(groups, c.edges).select(F.col("member_id").alias("object_id"))
    return c.of("User").join(inside, "object_id", "left_semi")


@rule("dnsadmins", "high")
def _dns(c: Context) -> DataFrame:
    groups = c.tiered.where(F.upper(scalars.display_name(F.col("name"))) == "DNSADMINS").select(F.col("object_id").alias("id"))
    return c.of("User").join(group_members(groups, c.edges).select(F.col("member_id").alias("object_id")), "object_id", "left_semi")


def _control(finding: str, kinds: list[str], target) -> None:
    @rule(finding, "critical")
    def query(c: Context) -> DataFrame:
        goals = c.tiered.where(target()).select(F.col("object_id").alias("dst"))
        held = c.edges.where(F.col("edge_type").isin(kinds)).join(goals, "dst", "left_semi").select(F.col("src").alias("object_id"))
        return c.tiered.where("tier <> 0").join(held, "object_id", "left_semi")


_control("dcsync-nonpriv", ["DCSync"], lambda: F.col("node_type") == "Domain")
_control("domain-control-nonpriv", ["GenericAll", "WriteDacl", "WriteOwner", "Owns"], lambda: F.col("node_type") == "Domain")
_control("adminsdholder-nonpriv", ["GenericAll", "WriteDacl", "WriteOwner", "Owns", "GenericWrite"], lambda: F.upper(scalars.display_name(F.col("name"))) == "ADMINSDHOLDER")


@rule("tier0-exposed-on-lower-tier", "critical")
def _tier0_session(c: Context) -> DataFrame:
    """Hosts below tier 0 with a session of a tier-0 user."""
    top = c.tiered.where("tier = 0 and node_type = 'User'").select(F.col("object_id").alias("dst"))
    hosts = c.edges.where("edge_type = 'HasSession'").join(top, "dst", "left_semi").select(F.col("src").alias("object_id"))
    return c.tiered.where("tier <> 0 and node_type = 'Computer'").join(hosts, "object_id", "left_semi")


@rule("broad-rights", "high")
def _broad(c: Context) -> DataFrame:
    """Everyone, authenticated users and domain users or computers, if they hold a right that is an attack step."""
    held = c.edges.where(F.col("edge_type").isin(registry.ATTACK)).select(F.col("src").alias("object_id"))
    return c.tiered.where(F.col("object_id").rlike(_EVERYONE) & (F.col("tier") != 0)).join(held, "object_id", "left_semi")


@rule("trust-no-sid-filtering", "high")
def _trusts(c: Context) -> DataFrame:
    if "sid_filtering" not in c.edges.columns:
        return c.tiered.limit(0)
    open_ = c.edges.where("edge_type = 'TrustedBy' and sid_filtering = false").select(F.col("src").alias("object_id"))
    return c.tiered.join(open_, "object_id", "left_semi")


def _subject(pattern: str) -> F.Column:
    return F.coalesce(F.col("subject").rlike(pattern), F.lit(False))


def _credential(finding: str, severity: str, condition: Callable[[], F.Column]) -> None:
    rule(finding, severity, "fact:credentials")(lambda c: c.facts["credentials"].where(condition()).select(F.col("credential").alias("object_id"), "name"))


_pull = lambda: _subject(r"(?i)^repo:[^:]+:pull_request$")
_credential("fic-wildcard-subject", "high", lambda: F.coalesce(F.col("subject").contains("*"), F.lit(False)))
_credential("fic-pull-request-trigger", "high", _pull)
_credential("fic-no-ref-pin", "medium", lambda: _subject(r"(?i)^repo:") & ~_subject(r"(?i)(?:^|:)(?:ref:refs/|environment:)|\*") & ~_pull())
_credential("fic-external-issuer", "info", lambda: (F.col("issuer") != "") & ~F.col("issuer").contains("login.microsoftonline.com"))


def _named(rows: DataFrame, context: Context) -> DataFrame:
    """(object_id, name) of ids (object_id); an id that wasn't collected is its own name."""
    return rows.select("object_id").distinct().join(context.tiered.select("object_id", "name"), "object_id", "left").select("object_id", F.coalesce("name", "object_id").alias("name"))


def _shadow(finding: str, severity: str, derived: bool) -> None:
    rule(finding, severity, "fact:shadow")(lambda c: _named(c.facts["shadow"].where((F.col("reason") == "derived") == derived).select(F.col("id").alias("object_id")), c))


_shadow("shadow-tier0-derived", "high", True)
_shadow("shadow-tier0-by-name", "medium", False)


def _activation(finding: str, severity: str, mfa: bool) -> None:
    def query(c: Context) -> DataFrame:
        eligible = c.edges.where("edge_type = 'AZEligibleRole'").select(F.col("dst").alias("role")).distinct()
        weak = c.facts["activations"].where(~_yes("approval") & (_yes("mfa") == mfa)).join(eligible, "role", "left_semi")
        return _named(weak.select(F.col("role").alias("object_id")), c)

    rule(finding, severity, "fact:activations")(query)


_activation("pim-activation-no-mfa", "high", False)
_activation("pim-activation-no-approval", "medium", True)


@rule("keyvault-secret-readers", "info")
def _vaults(c: Context) -> DataFrame:
    return _named(c.edges.where("edge_type = 'AZGetSecrets'").select(F.col("dst").alias("object_id")), c)


@rule("azure-roles-unevaluated", "info", "fact:unevaluated")
def _unevaluated(c: Context) -> DataFrame:
    return c.facts["unevaluated"].select(F.col("definition").alias("object_id"), F.col("definition").alias("name"))


@rule("entra-scoped-roles-unresolved", "info", "fact:unresolved")
def _unresolved(c: Context) -> DataFrame:
    return _named(c.facts["unresolved"].select(F.col("who").alias("object_id")), c)


@rule("protected-users-neutralizes-delegation", "info", "fact:neutralized")
def _neutralized(c: Context) -> DataFrame:
    return _named(c.facts["neutralized"].select(F.col("dst").alias("object_id")), c)


@rule("pwd-attributes", "critical", "password_attributes")
def _stored(c: Context) -> DataFrame:
    """password_attributes: how many attributes of an account hold password material."""
    return c.tiered.where("node_type = 'User' and password_attributes > 0")


def _encryption(finding: str, severity: str, which: str) -> None:
    def query(c: Context) -> DataFrame:
        """supportedencryptiontypes: the bit mask; 0 is not defined, bits 8 and 16 are AES. The ticket-granting account counts where not defined, too."""
        kinds = F.col("supportedencryptiontypes").cast("int")
        granting = (F.col("node_type") == "User") & (F.upper(scalars.display_name(F.col("name"))) == "KRBTGT") & (kinds.bitwiseAND(24) == 0)
        weak = (kinds != 0) & (kinds.bitwiseAND(24) == 0) & F.coalesce("enabled", F.lit(True))
        spn = F.col("hasspn") if "hasspn" in c.columns else F.lit(False)
        group = F.when(granting | (weak & _privileged()), "privileged").when(weak & F.coalesce(spn, F.lit(False)), "spn").when(weak, "other")
        return c.tiered.where(F.col("node_type").isin("User", "Computer")).where(group == which)

    rule(finding, severity, "supportedencryptiontypes")(query)


_encryption("weak-kerberos-enc-privileged", "high", "privileged")
_encryption("weak-kerberos-enc-spn", "medium", "spn")
_encryption("weak-kerberos-enc", "low", "other")

_EVERYONE = r"(S-1-1-0|S-1-5-11|-513|-515)$"


@rule("adcs-everyone", "critical")
def _certificates_for_all(c: Context) -> DataFrame:
    held = c.edges.where(F.col("edge_type").startswith("ADCS") | (F.col("edge_type") == "GoldenCert")).select(F.col("src").alias("object_id"))
    return c.tiered.where(F.col("object_id").rlike(_EVERYONE)).join(held, "object_id", "left_semi")


def _access(finding: str, severity: str) -> None:
    rule(finding, severity, "fact:policies")(lambda c: access.gaps(c.tiered, c.edges, c.facts["policies"]).where(F.col("finding") == finding))


for _finding, _severity in (("ca-no-admin-mfa", "critical"), ("ca-admin-uncovered", "high"), ("ca-admin-excluded", "high"), ("ca-report-only", "medium"), ("ca-legacy-auth", "high")):
    _access(_finding, _severity)


@rule("ca-not-collected", "info")
def _no_policies(c: Context) -> DataFrame:
    """A row if there are cloud users but no sign-in policies."""
    users = c.tiered.where("node_type = 'AZUser'").limit(0 if "fact:policies" in c.columns else 1)
    return users.select(F.lit("tenant").alias("object_id"), F.lit("tenant").alias("name"))


def found(context: Context, only: list[str] | None = None) -> DataFrame:
    """(finding, severity, object_id, name) of all rules whose columns were collected."""
    spark = context.tiered.sparkSession
    out = None
    for r in RULES.values():
        if (only is None or r.finding in only) and set(r.needs) <= context.columns:
            rows = r.query(context).select(F.lit(r.finding).alias("finding"), F.lit(r.severity).alias("severity"), "object_id", "name")
            out = rows if out is None else out.union(rows)
    return out if out is not None else spark.createDataFrame([], "finding string, severity string, object_id string, name string")


def findings(rows: DataFrame, most: int = 25) -> DataFrame:
    """(finding, severity, total, names): distinct display names, the first ``most`` in order."""
    shown = rows.withColumn("shown", scalars.display_name(F.col("name"))).select("finding", "severity", "shown").distinct()
    ranked = shown.withColumn("r", F.row_number().over(Window.partitionBy("finding", "severity").orderBy("shown"))).where(F.col("r") <= most)
    totals = shown.groupBy("finding", "severity").agg(F.count("*").alias("total"))
    names = ranked.groupBy("finding", "severity").agg(F.array_join(F.array_sort(F.collect_list("shown")), ",").alias("names"))
    return totals.join(names, ["finding", "severity"])


def posture_counts(rows: DataFrame) -> DataFrame:
    """(severity, n): findings by severity."""
    return rows.groupBy("severity").agg(F.count_distinct("finding").alias("n"))


#: Controls that findings bear on. Framework, control, findings.
CONTROLS = [
    ("nist", "AC-2", "stale-privileged stale-computers recent-privileged-object guest-enabled"),
    ("nist", "AC-3", "broad-rights adcs-everyone dcsync-nonpriv domain-control-nonpriv dnsadmins"),
    ("nist", "AC-5", "tier0-exposed-on-lower-tier ea-sa-populated many-domain-admins svc-privileged"),
    ("nist", "AC-6", "machine-account-quota tier0-exposed-on-lower-tier sid-history admincount-orphan unconstrained-delegation protocol-transition no-laps trust-no-sid-filtering broad-rights adminsdholder-nonpriv"),
    ("nist", "AC-6(5)", "kerberoast-privileged asrep-privileged priv-pwd-never-expires priv-not-protected tier0-exposed-on-lower-tier dcsync-nonpriv domain-control-nonpriv ea-sa-populated many-domain-admins dnsadmins svc-privileged adminsdholder-nonpriv"),
    ("nist", "CM-6", "machine-account-quota old-os old-functional-level"),
    ("nist", "IA-2", "asrep asrep-privileged"),
    ("nist", "IA-5", "kerberoast kerberoast-privileged asrep asrep-privileged passwd-notreqd priv-pwd-never-expires pwd-in-description krbtgt-old priv-not-protected unconstrained-delegation protocol-transition no-laps"),
    ("nist", "SC-8", "smb-signing smb-signing-dc ldap-signing webclient"),
    ("nist", "SI-2", "old-os"),
    ("nist", "SI-4", "recent-privileged-object"),
]


def compliance(rows: DataFrame) -> DataFrame:
    """(framework, control, n_findings): distinct findings by control."""
    spark = rows.sparkSession
    controls = spark.createDataFrame([(f, c, x) for f, c, xs in CONTROLS for x in xs.split()], "framework string, control string, finding string")
    return rows.select("finding").distinct().join(F.broadcast(controls), "finding").groupBy("framework", "control").agg(F.count_distinct("finding").alias("n_findings"))


def accept(rows: DataFrame, acceptances: DataFrame, today: str) -> DataFrame:
    """``rows`` with accepted: whether an acceptance (finding, pattern: a glob on the name, expires) that hasn't run out covers it."""
    live = acceptances.where(F.col("expires").isNull() | (F.col("expires") >= F.lit(today).cast("date"))).select(F.col("finding").alias("f"), scalars.glob_to_regex(F.col("pattern")).alias("p"))
    keyed = rows.withColumn("_k", F.xxhash64(*rows.columns))
    hit = keyed.join(live, (F.col("finding") == F.col("f")) & F.expr("name rlike p")).select("_k").distinct().withColumn("accepted", F.lit(True))
    return keyed.join(hit, "_k", "left").select(*rows.columns, F.coalesce("accepted", F.lit(False)).alias("accepted"))


def doctor(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of collection rates: objects, edges, edges of unknown kinds and with unknown ends, hosts with a session or an administrator, in percent."""
    known = [e[0] for e in registry.EDGES]
    ends = edges.select(F.explode(F.array("src", "dst")).alias("object_id")).distinct()
    ghosts = ends.join(nodes, "object_id", "left_anti").agg(F.count("*").alias("unknown_ends"))
    e = edges.agg(F.count("*").alias("n_edges"), F.count(F.when(~F.col("edge_type").isin(known), 1)).alias("unknown_kinds"), F.count_distinct(F.when(F.col("edge_type") == "HasSession", F.col("src"))).alias("with_session"), F.count_distinct(F.when(F.col("edge_type") == "AdminTo", F.col("dst"))).alias("with_admin"))
    n = nodes.agg(F.count("*").alias("n_nodes"), F.count(F.when(F.col("node_type") == "Computer", 1)).alias("n_hosts"))
    rate = lambda x: F.round(F.coalesce(F.try_divide(F.col(x) * 100.0, F.col("n_hosts")), F.lit(0.0)), 1)
    return n.crossJoin(e).crossJoin(ghosts).select("n_nodes", "n_edges", "unknown_kinds", "unknown_ends", rate("with_session").alias("session_pct"), rate("with_admin").alias("admin_pct"))
