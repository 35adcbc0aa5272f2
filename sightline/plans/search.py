"""Search: filters, wildcard indexes, paging and visible indexes."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import ranks

META = ("_indexes", "_schema")


def filter_dict(df: DataFrame, filters: dict) -> Column:
    """AND over fields of equality or membership; unknown fields are skipped. Literals are cast to the field's type,
    so the predicate reaches the scan; one that can't be cast matches nothing."""
    kinds = dict(df.dtypes)
    parts = []
    for field, value in filters.items():
        if field in kinds:
            values = value if isinstance(value, (list, tuple, set)) else [value]
            parts.append(reduce(lambda a, b: a | b, [F.col(f"`{field}`") == F.lit(v).try_cast(kinds[field]) for v in values], F.lit(False)))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def filtered(df: DataFrame, filters: dict, order: list[str] | None = None, limit: int | None = None) -> DataFrame:
    out = df.where(filter_dict(df, filters))
    out = out.orderBy(*[F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order]) if order else out
    return out.limit(limit) if limit is not None else out


def matching(names: list[str], token: str) -> list[str]:
    pattern = re.compile(re.escape(token).replace(r"\*", ".*"), re.I)
    return [n for n in names if pattern.fullmatch(n) and n not in META]


_APART = re.compile(r"'(?:[^'\\\\]|\\\\.|'')*'|--[^\n]*|/\*.*?\*/", re.S)
_TOKEN = re.compile(r"`(?:[^`]|``)*`|\"[^\"]*\"|[\w*]+(?:\.[\w*]+)*|[(),]|[^\s\w]")
#: Words that end a list of tables; behind ON and USING a comma goes on with it.
_AFTER = set("select where group having order limit offset union intersect except window cluster distribute sort values".split())
# Nodes of the parser's plan that a search may consist of; what isn't here is refused.
_ALLOWED = set(
    """Project Filter Aggregate UnresolvedHaving Sort GlobalLimit LocalLimit Offset Distinct Union Intersect Except Join AsOfJoin LateralJoin SubqueryAlias
    UnresolvedSubqueryColumnAliases UnresolvedWith WithWindowDefinition UnresolvedRelation UnresolvedInlineTable OneRowRelation Generate Pivot UnresolvedPivot UnresolvedUnpivot Unpivot
    LocalRelation Sample UnresolvedHint""".split()
)
# Functions that reach beyond the rows of a search.
_REFUSED = {"reflect", "java_method", "try_reflect", "read_files", "input_file_name", "current_database", "current_schema", "current_catalog", "version", "assert_true", "raise_error"}


def code_of(sql: str) -> tuple[str, list[str]]:
    """The statement with string literals and comments taken out, each leaving a mark, and what was taken."""
    taken = []

    def out(m: re.Match) -> str:
        taken.append(m[0])
        return f"\0{len(taken) - 1}\0"

    return _APART.sub(out, sql), taken


def quoted_tables(sql: str) -> str:
    """The statement with wildcards and double-quoted names in the place of tables put into back quotes, which the parser takes."""
    code, taken = code_of(sql)
    out, at, stack = [], 0, [[False, False]]  # in a list of tables, a table is next
    for m in _TOKEN.finditer(code):
        word, state = m[0].lower(), stack[-1]
        text = m[0]
        if word in ("from", "join"):
            state[:] = [True, True]
        elif word == "(":
            state[1] = False
            stack.append([False, False])
        elif word == ")":
            if len(stack) > 1:
                stack.pop()
        elif word == ",":
            state[1] = state[0]
        elif word in _AFTER:
            state[:] = [False, False]
        elif word in ("on", "using", "lateral", "as"):
            state[1] = False
        elif state[1]:
            state[1] = False
            if text[0] == '"':
                text = f"`{text[1:-1]}`"
            elif "*" in text:
                text = f"`{text}`"
        out += [code[at : m.start()], text]
        at = m.end()
    return re.sub(r"\0(\d+)\0", lambda m: taken[int(m[1])], "".join([*out, code[at:]]))


def _items(seq) -> Iterator:
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def _functions(e) -> Iterator[str]:
    if e.getClass().getSimpleName() == "UnresolvedFunction":
        yield from _items(e.nameParts())
    for c in _items(e.children()):
        yield from _functions(c)


def tables_of(spark: SparkSession, sql: str) -> list[tuple[int, int, list[str], bool]]:
    """Start, end, parts of the name, and whether an alias follows, of every table that a query names, also in subqueries and
    common table expressions, whose own names are none. Spark's parser decides; statements that aren't plain queries, table
    functions and functions that reach out are refused."""
    if "${" in sql:
        raise PermissionError("no variables")
    found = []

    def walk(node, scope: frozenset, above: str) -> None:
        kind = node.getClass().getSimpleName().rstrip("$")
        if kind not in _ALLOWED:
            raise PermissionError(f"{kind} is not part of a search")
        for e in _items(node.expressions()):
            if bad := _REFUSED & {n.lower() for n in _functions(e)}:
                raise PermissionError(f"{min(bad)} is not part of a search")
        if kind == "UnresolvedRelation":
            name = list(_items(node.multipartIdentifier()))
            if len(name) > 1 or name[0].lower() not in scope:
                origin = node.origin()
                found.append((origin.startIndex().get(), origin.stopIndex().get() + 1, name, above == "SubqueryAlias"))
        for c in _items(node.innerChildren()):
            # expressions of WITH see those before them; those of other nodes are subqueries
            walk(c, scope, kind)
            if kind == "UnresolvedWith":
                scope = scope | {c.alias().lower()}
        for c in _items(node.children()):
            walk(c, scope, kind)

    walk(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql), frozenset(), "")
    return sorted({(a, z): (a, z, n, x) for a, z, n, x in found}.values())


def search(spark: SparkSession, sql: str, store: DataFrame | Callable[[list[str]], DataFrame], names: list[str], meta: dict[str, DataFrame] | None = None, known: list[str] | None = None) -> DataFrame:
    """SQL over index names, quoted or not and in any case; names with * scan all matching indexes. store: one table of
    all indexes, or a function of index names. Only indexes and meta tables can be named: paths, tables of the session and
    other statements than queries are a PermissionError, as are indexes of `known` that aren't among `names`; a name that nothing
    bears is a ValueError, and so is a query of no index. The views are made for this statement and dropped once Spark has resolved it."""
    meta, views = meta or {}, []
    rows = store if callable(store) else lambda which: store.where(F.lower("_index").isin(which))
    by_name = {n.lower(): n for n in names if n not in META}
    sql = quoted_tables(sql)

    def view(frame: DataFrame) -> str:
        views.append(f"_index_{uuid.uuid4().hex}")
        frame.createOrReplaceTempView(views[-1])
        return views[-1]

    def frame_of(parts: list[str]) -> DataFrame:
        token = parts[0]
        if len(parts) > 1:
            raise PermissionError(f"{'.'.join(parts)} is no index")
        if "*" in token:
            found = matching(names, token)
            if not found:
                raise ValueError(f"no index matches {token}")
            return rows([n.lower() for n in found])
        if token.lower() in meta:
            return meta[token.lower()]
        if token.lower() in by_name:
            return rows([token.lower()])
        if token.lower() in {n.lower() for n in known or []}:
            restricted([token], names)
        raise ValueError(f"unknown index {token}")

    try:
        tables = tables_of(spark, sql)
        if not tables:
            raise ValueError("no known index")
        out, at = [], 0
        for start, end, parts, aliased in tables:
            alias = "" if aliased or "*" in parts[0] else f" AS `{parts[0]}`"
            out += [sql[at:start], view(frame_of(parts)), alias]
            at = end
        return spark.sql("".join([*out, sql[at:]]))
    finally:
        for v in views:
            spark.catalog.dropTempView(v)


def search_as(spark: SparkSession, sql: str, store, user, access: DataFrame, low=None, high=None, number: int | None = None, size: int = 100) -> DataFrame:
    """search for one user: over the indexes that the user may read and that have events in the range, pruned to the
    files of the range; meta tables show those indexes only. An index that the user may not read is a PermissionError. number: page, from 0."""
    names = readable_indexes(access, store, user, low, high)
    meta = {m: store.meta(m, names) for m in META}
    return search(spark, sql if number is None else paged_sql(sql, number, size), lambda which: store.rows(which, low, high), names, meta, store.indexes())


def page(df: DataFrame, number: int, size: int, order: list[Column]) -> DataFrame:
    """A page, from 0, of a total order. Far pages are found by counts of range partitions, so that no task takes all rows before."""
    if number * size > ranks.PART_ROWS:
        return ranks.skipped(df, order, number * size, size)
    return df.orderBy(*order).offset(number * size).limit(size)


def paged_sql(sql: str, number: int, size: int) -> str:
    """The statement with LIMIT and OFFSET, each added where the statement itself (not a subquery of it) has none."""
    sql = sql.rstrip().rstrip(";")
    outer, before = code_of(sql)[0], None
    while outer != before:
        before, outer = outer, re.sub(r"\([^()]*\)", " ", outer)
    if not re.search(r"(?i)\blimit\s+\w+", outer):
        sql += f"\nLIMIT {size}"
    return sql if re.search(r"(?i)\boffset\s+\d+", outer) else f"{sql} OFFSET {number * size}"


def last_records(df: DataFrame, *ties: str, n: int = 5) -> DataFrame:
    """The newest n events; columns that decide ties."""
    return df.orderBy(F.desc("_time"), *[F.desc(c) for c in ties]).limit(n)


def effective_access(spark: SparkSession, users: DataFrame, roles: DataFrame, user_roles: DataFrame, user_permissions: DataFrame, role_permissions: DataFrame, as_of=None) -> DataFrame:
    """user_id, index_name, can_read, can_write, can_delete: OR of own grants and those of roles and all roles above them."""
    if as_of is not None:
        now = F.lit(as_of).cast("timestamp")
        live = F.coalesce(F.col("effective_date") <= now, F.lit(True)) & F.coalesce(F.col("expiration_date") > now, F.lit(True))
        user_permissions, role_permissions = user_permissions.where(live), role_permissions.where(live)
    own = user_roles.select("user_id", "role_id").distinct()
    reach = own.unionByName(own.join(above(roles), "role_id").select("user_id", F.col("ancestor").alias("role_id")))
    grants = reach.distinct().join(role_permissions, "role_id").select("user_id", "index_name", "read_permission", "write_permission", "delete_permission")
    grants = grants.unionByName(user_permissions.select(grants.columns))
    return grants.groupBy("user_id", "index_name").agg(*[F.bool_or(F.coalesce(f"{k}_permission", F.lit(False))).alias(f"can_{k}") for k in ("read", "write", "delete")])


def above(roles: DataFrame) -> DataFrame:
    """role_id, ancestor: each role (id, parent_id) with itself and all above it. Paths double with every round until nothing new
    comes, so a chain of n takes about log n rounds and cycles end."""
    from ..sources.store import fresh_dir

    def kept(df: DataFrame) -> DataFrame:
        df.write.parquet(to := fresh_dir(df.sparkSession))
        return df.sparkSession.read.parquet(to)

    links = roles.where("parent_id is not null").select(F.col("id").alias("role_id"), F.col("parent_id").alias("ancestor"))
    ids = roles.select(F.col("id").alias("role_id")).unionByName(links.select(F.col("ancestor").alias("role_id")))
    out = kept(links.unionByName(ids.select("role_id", F.col("role_id").alias("ancestor"))).distinct())
    n = out.count()
    while True:
        more = kept(out.join(out.select(F.col("role_id").alias("ancestor"), F.col("ancestor").alias("top")), "ancestor").select("role_id", F.col("top").alias("ancestor")).distinct())
        if (m := more.count()) == n:
            return more
        out, n = more, m


def full_access(access: DataFrame, users: DataFrame, admins: DataFrame, indexes: list[str]) -> DataFrame:
    """effective_access with its two rules for all: admins (user_id) may do everything on the indexes, and every user may
    read the meta tables. indexes: the names of the catalog."""
    names = lambda x: F.explode(F.array(*[F.lit(n) for n in x]).cast("array<string>")).alias("index_name")
    grant = lambda yes: [F.lit(yes).alias(f"can_{k}") for k in ("write", "delete")]
    every = admins.select("user_id", names(indexes)).select("*", F.lit(True).alias("can_read"), *grant(True))
    meta = users.select("user_id", names(META)).select("*", F.lit(True).alias("can_read"), *grant(False))
    both = access.unionByName(every).unionByName(meta)
    return both.groupBy("user_id", "index_name").agg(*[F.bool_or(f"can_{k}").alias(f"can_{k}") for k in ("read", "write", "delete")])


def readable_indexes(access: DataFrame, store, user, low=None, high=None) -> list[str]:
    """Indexes with events in the range that the user may read."""
    mine = {r[0].lower() for r in access.where((F.col("user_id") == F.lit(user)) & F.col("can_read")).select("index_name").distinct().collect()}
    return [n for n in store.indexes(low, high) if n in mine]


def restricted(requested: list[str], readable: list[str]) -> list[str]:
    """The requested indexes that are readable, all of those where none is requested; none at all is an error."""
    wanted = {r.lower() for r in requested}
    out = [n for n in readable if not wanted or n.lower() in wanted]
    if not out:
        raise PermissionError("no readable index")
    return out


def permitted(requests: DataFrame, access: DataFrame) -> DataFrame:
    """user_id, index_name: for all users at once what restricted gives: the indexes of requests (user_id, index_name) that the user
    may read, all of those for users without requests. Users without a row may read nothing of what they ask for."""
    readable = access.where("can_read").select("user_id", F.lower("index_name").alias("index_name")).distinct()
    wanted = requests.where("index_name is not null").select("user_id", F.lower("index_name").alias("index_name"))
    some = readable.join(wanted, ["user_id", "index_name"], "left_semi")
    return some.unionByName(readable.join(wanted, "user_id", "left_anti"))


def existing_permissions(permissions: DataFrame, catalog: DataFrame) -> DataFrame:
    """Permissions that name an index of the catalog."""
    return permissions.join(catalog.select(F.col("index").alias("_n")).distinct(), F.lower("index_name") == F.col("_n"), "left_semi")


def audit_rows(requests: DataFrame) -> DataFrame:
    """Request log (time, user_id, method, path, status_code, real_ip, forwarded, host) -> audit events: _index, _time,
    user_id, action, success, ip_address, details."""
    return requests.select(
        F.lit("_audit").alias("_index"), F.col("time").alias("_time"), "user_id", F.concat_ws(" ", F.upper("method"), "path").alias("action"),
        (F.col("status_code") < 400).alias("success"), client_ip(F.col("real_ip"), F.col("forwarded"), F.col("host")).alias("ip_address"),
        F.to_json(F.struct("status_code", "path")).alias("details"),
    )


def client_ip(real_ip: Column, forwarded: Column, host: Column) -> Column:
    return F.coalesce(F.nullif(real_ip, F.lit("")), F.nullif(F.trim(F.split(forwarded, ",")[0]), F.lit("")), host, F.lit("unknown"))


def merged_history(old: DataFrame, usage: DataFrame) -> DataFrame:
    """A history (user_id, query, last_used, times_used) with a log of uses (user_id, query, used_at) taken in."""
    new = usage.groupBy("user_id", "query").agg(F.max("used_at").alias("last_used"), F.count("*").alias("times_used"))
    return old.select(new.columns).unionByName(new).groupBy("user_id", "query").agg(F.max("last_used").alias("last_used"), F.sum("times_used").alias("times_used"))


def without_null_fields(df: DataFrame) -> Column:
    """Each record as JSON, without its null fields."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "true"})


def newest(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")
