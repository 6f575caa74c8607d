"""C. Users and permissions: roles, access lists."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope import SCOPE
from fleetscope.operators.closure import shortest_paths
from fleetscope.operators.scope import sort_if
from fleetscope.workspace import Workspace

# PostgreSQL access-privilege letters and the privilege names
# that aclexplode reports for them.
ACL_PRIVILEGES = [
    ("a", "INSERT"),
    ("r", "SELECT"),
    ("w", "UPDATE"),
    ("d", "DELETE"),
    ("D", "TRUNCATE"),
    ("x", "REFERENCES"),
    ("t", "TRIGGER"),
    ("X", "EXECUTE"),
    ("U", "USAGE"),
    ("C", "CREATE"),
    ("T", "TEMPORARY"),
    ("c", "CONNECT"),
    ("s", "SET"),
    ("A", "ALTER SYSTEM"),
    ("m", "MAINTAIN"),
]

# How a grantee of oid 0 (PUBLIC, the empty name in the text form) prints
# as a role.
PUBLIC_ROLE = "-"

NL = "\n"


def role_attributes() -> F.Column:
    """Newline-joined attribute labels of a role; NULL when it has none."""
    labels = F.array(
        F.when(~F.col("rolcanlogin"), F.lit("no login")),
        F.when(~F.col("rolinherit"), F.lit("no inheritance")),
        F.when(F.col("rolsuper"), F.lit("superuser")),
        F.when(F.col("rolcreaterole"), F.lit("create role")),
        F.when(F.col("rolcreatedb"), F.lit("create db")),
        F.when(F.col("rolreplication"), F.lit("replication")),
        F.when(F.col("rolbypassrls"), F.lit("bypass rls")),
        F.when(F.col("rolconnlimit") >= 0,
               F.concat(F.lit("connection limit: "), F.col("rolconnlimit").cast("string"))),
        F.when(F.col("rolvaliduntil").isNotNull(),
               F.concat(F.lit("valid until: "), F.to_date("rolvaliduntil").cast("string"))),
    )
    present = F.array_compact(labels)
    return F.when(F.size(present) > 0, F.array_join(present, NL))


def role_list(roles: DataFrame, auth_members: DataFrame, ordered: bool = False) -> DataFrame:
    """Per role its attributes, the roles it is a member of (sorted;
    ``none`` if none) and its configuration items (``none`` if none)."""
    groups = (auth_members
              .join(roles.select(*SCOPE, F.col("oid").alias("roleid"), F.col("rolname").alias("group_name")),
                    on=SCOPE + ["roleid"], how="inner")
              .groupBy(*SCOPE, F.col("member").alias("oid"))
              .agg(F.array_join(F.array_sort(F.collect_list("group_name")), NL).alias("member_of")))
    settings = F.when(F.size("rolconfig") > 0, F.array_join("rolconfig", NL))
    rows = (roles.join(groups, on=SCOPE + ["oid"], how="left")
            .select(*SCOPE, F.col("rolname").alias("username"), role_attributes().alias("attributes"),
                    F.coalesce("member_of", F.lit("none")).alias("member_of"),
                    F.coalesce(settings, F.lit("none")).alias("settings")))
    return sort_if(rows, ordered, *SCOPE, "username")


def acl_grants(acls: DataFrame, ordered: bool = False) -> DataFrame:
    """Access lists exploded to one row per grantee and privilege, with
    grantor and grant option. Objects with a NULL list yield no rows."""
    letters = F.create_map(*[F.lit(x) for x in chain.from_iterable(ACL_PRIVILEGES)])
    items = acls.select(*SCOPE, F.col("object_name").alias("schema_name"), "owner",
                        F.explode("acl").alias("item"))
    parsed = items.select(
        *SCOPE, "schema_name", "owner",
        F.regexp_extract("item", r"^([^=]*)=", 1).alias("grantee"),
        F.regexp_extract("item", r"/(.*)$", 1).alias("grantor"),
        F.regexp_extract("item", r"=([^/]*)/", 1).alias("privs"))
    privs = parsed.select(*SCOPE, "schema_name", "owner", "grantee", "grantor",
                          F.explode(F.regexp_extract_all("privs", F.lit(r"([A-Za-z]\*?)"), F.lit(1))).alias("p"))
    rows = (privs.select(
        *SCOPE, "schema_name", "owner",
        F.when(F.col("grantee") == "", F.lit(PUBLIC_ROLE)).otherwise(F.col("grantee")).alias("role_name"),
        F.element_at(letters, F.substring("p", 1, 1)).alias("privilege"),
        F.col("p").endswith("*").alias("is_grantable"),
        "grantor"))
    return sort_if(rows, ordered, *SCOPE, "schema_name", "owner", "role_name", "privilege")


def effective_privileges(acls: DataFrame, roles: DataFrame, auth_members: DataFrame, ordered: bool = False) -> DataFrame:
    """What every role may do, directly or through the roles it is
    a member of: one row per role, object and privilege with the shortest
    grant path (``depth`` memberships, names from the role to the one granted;
    ties by name), whether any path brings the grant option, and the number of
    paths' ends that grant it. A role without ``rolinherit`` passes nothing on
    to itself and its members; cycles of memberships are allowed. PUBLIC is a
    role of its own (``-``), whose rights all roles have."""
    run = Workspace(acls.sparkSession, "privileges")
    names = roles.select(*SCOPE, "oid", "rolname", "rolinherit")
    member = names.where("rolinherit").select(*SCOPE, F.col("oid").alias("member"), F.col("rolname").alias("role_name"))
    group = names.select(*SCOPE, F.col("oid").alias("roleid"), F.col("rolname").alias("granted_role"))
    edges = auth_members.join(member, on=[*SCOPE, "member"], how="inner").join(group, on=[*SCOPE, "roleid"], how="inner")
    through = shortest_paths(edges, run, SCOPE, "role_name", "granted_role")
    grants = run.table(acl_grants(acls).select(*SCOPE, F.col("schema_name").alias("object_name"), F.col("role_name").alias("granted_role"),
                                               "privilege", "is_grantable").distinct(), "grants")
    direct = grants.select(*SCOPE, F.col("granted_role").alias("role_name"), "object_name", "privilege", "is_grantable",
                           F.lit(0).alias("depth"), F.array("granted_role").alias("path"))
    inherited = grants.join(through, on=[*SCOPE, "granted_role"], how="inner").select(direct.columns)
    rows = (direct.unionByName(inherited).groupBy(*SCOPE, "role_name", "object_name", "privilege")
            .agg(F.min(F.struct("depth", "path")).alias("best"), F.bool_or("is_grantable").alias("is_grantable"),
                 F.count_distinct(F.element_at("path", -1)).alias("grants"))
            .select(*SCOPE, "role_name", "object_name", "privilege", "is_grantable", "grants", F.col("best.depth").alias("depth"),
                    F.array_join("best.path", " > ").alias("grant_path")))
    return sort_if(rows, ordered, *SCOPE, "role_name", "object_name", "privilege")


def database_access(databases: DataFrame, ordered: bool = False) -> DataFrame:
    """Each database's access list, one item per line (NULL kept)."""
    rows = (databases.select(*SCOPE, F.col("datname").alias("database"),
                             F.array_join("acl", NL).alias("access")))
    return sort_if(rows, ordered, *SCOPE, "database")
