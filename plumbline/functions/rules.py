"""Row rules as boolean expressions, and splitting a table into valid and quarantined rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits and allow lists.
MAX_FILE_BYTES = 100 * 1024 * 1024
MAX_PATH_LENGTH = 4096
MAX_NAME_LENGTH = 100
CONTENT_TYPES = [
    "text/csv",
    "text/plain",
    "application/json",
    "application/octet-stream",
    "application/x-parquet",
    "application/vnd.apache.parquet",
    "application/vnd.ms-excel",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
]
EXTENSIONS = [
    ".csv",
    ".parquet",
    ".json",
    ".jsonl",
    ".xlsx",
    ".xls",
    ".feather",
    ".arrow",
    ".pkl",
    ".pickle",
    ".txt",
    ".tsv",
]
URL_SCHEMES = ["http", "https", "s3", "gs", "az", "file"]
LOCAL_HOSTS = ["localhost", "127.0.0.1", "0.0.0.0", "::1"]
UNSAFE_PATHS = [
    r"\.\./",
    r"\.\.\\",
    r"^/etc/",
    r"^/var/",
    r"^/proc/",
    r"^/sys/",
    r"^/dev/",
    r"^C:\\Windows",
    r"^C:\\System",
    r"\\\\",
]
BANNED_SQL = [
    "DROP ",
    "DELETE ",
    "TRUNCATE ",
    "ALTER ",
    "CREATE ",
    "INSERT ",
    "UPDATE ",
    "GRANT ",
    "REVOKE ",
    "EXEC ",
    "EXECUTE ",
    "XP_",
    "SP_",
    "--",
    ";--",
    "/*",
    "*/",
]


def sql_is_select_only(query: str) -> bool:
    """The ``select_only`` rule for one query text, used before it is handed to a database."""
    upper = query.upper()
    return upper.strip().startswith("SELECT") and not any(word in upper for word in BANNED_SQL)


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def url_netloc(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1)


def url_host(url: Column) -> Column:
    """Host without user, port or brackets, in lower case."""
    place = F.regexp_replace(url_netloc(url), r"^.*@", "")
    bare = F.regexp_replace(place, r"^\[([^\]]*)\].*$", "$1")
    return F.lower(F.when(place.startswith("["), bare).otherwise(F.regexp_replace(place, r":[0-9]*$", "")))


def is_private_ip(host: Column) -> Column:
    """A literal IPv4 address in 10/8, 172.16/12, 192.168/16 or 169.254/16."""
    parts = F.split(host, r"\.")
    first, second = parts[0].try_cast("int"), parts[1].try_cast("int")
    private = (
        (first == 10)
        | ((first == 172) & second.between(16, 31))
        | ((first == 192) & (second == 168))
        | ((first == 169) & (second == 254))
    )
    return F.when(host.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), private).otherwise(False)


def url_ok(url: Column, schemes: list[str] | None = None, allow_localhost: bool = False) -> Column:
    """Scheme present and allowed, host present for web addresses, not local or private."""
    scheme = url_scheme(url)
    allowed = scheme.isin([s.lower() for s in schemes or URL_SCHEMES])
    ok = allowed & (~scheme.isin("http", "https") | (url_netloc(url) != ""))
    if not allow_localhost:
        host = url_host(url)
        ok = ok & ~host.isin(LOCAL_HOSTS) & ~is_private_ip(host)
    return ok


def path_ok(path: Column, base_dir: str | None = None, allow_absolute: bool = False) -> Column:
    """No unsafe pattern, not too long, relative unless allowed, and inside ``base_dir`` if given.

    Relative paths are taken to start in ``base_dir``.
    """
    ok = ~path.rlike("(?i)" + "|".join(f"(?:{p})" for p in UNSAFE_PATHS)) & (F.length(path) <= MAX_PATH_LENGTH)
    if base_dir is not None:
        root = base_dir.rstrip("/")
        inside = (path == root) | path.startswith(root + "/") | ~path.startswith("/")
        ok = ok & inside & ~path.rlike(r"(^|/)\.\.(/|$)")
    if not allow_absolute:
        ok = ok & ~path.startswith("/")
    return ok


def extension_of(path: Column) -> Column:
    """Last suffix of the file name in lower case, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)/*$", 1))


def extension_ok(path: Column, allowed: list[str] | None = None) -> Column:
    return extension_of(path).isin([e.lower() for e in allowed or EXTENSIONS])


def content_type_ok(value: Column, allowed: list[str] | None = None) -> Column:
    base = F.lower(F.trim(F.split_part(value, F.lit(";"), F.lit(1))))
    return base.isin([t.lower() for t in allowed or CONTENT_TYPES])


def size_ok(size: Column, max_bytes: int = MAX_FILE_BYTES) -> Column:
    return size <= max_bytes


def select_only(query: Column) -> Column:
    """Starts with SELECT and holds none of the banned fragments (also inside quotes)."""
    upper = F.upper(query)
    ok = F.trim(upper).startswith("SELECT")
    for word in BANNED_SQL:
        ok = ok & ~F.contains(upper, F.lit(word))
    return ok


def uuid_ok(value: Column) -> Column:
    return F.lower(value).rlike(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


def name_ok(value: Column) -> Column:
    return value.rlike(r"^[A-Za-z][A-Za-z0-9_]*$") & (F.length(value) <= MAX_NAME_LENGTH)


def file_rules(
    path: Column, size: Column, max_bytes: int = MAX_FILE_BYTES, extensions: list[str] | None = None,
    base_dir: str | None = None, allow_absolute: bool = False,
) -> dict[str, Column]:
    """The rule set for a table of files."""
    return {
        "path": path_ok(path, base_dir, allow_absolute),
        "size": size_ok(size, max_bytes),
        "extension": extension_ok(path, extensions),
    }


def failed_rules(rules: dict[str, Column]) -> Column:
    """Array of the names of rules a row fails; a rule that gives null fails."""
    named = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    return F.filter(F.array(*named), lambda x: x.isNotNull())


def validate_rows(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass every rule, and the others with ``failed_rules``."""
    checked = df.withColumn("failed_rules", failed_rules(rules))
    empty = F.size("failed_rules") == 0
    return checked.filter(empty).drop("failed_rules"), checked.filter(~empty)
