"""Native column expressions: hashes, names, dates, statuses, sketches and routes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Names of release branches, any case; the default branch never counts.
RELEASE_NAMES = (
    r"release[/_-].+",
    r"releases?[/_-].+",
    r"v\d+(\.\d+)*(\.x)?",
    r"v\d+(\.\d+)*-stable",
    r"stable",
    r"stable[/_-].+",
    r"maint(enance)?[/_-].+",
    r"maint(enance)?",
    r"\d+(\.\d+)*(\.x)?",
    r"[\d.x]+-stable",
    r"lts",
    r"lts[/_-].+",
    r"support[/_-].+",
)
RELEASE_PATTERN = f"(?i)^({'|'.join(RELEASE_NAMES)})$"

#: Forms of a list element in a path and what stands for them, in the order of their replacement.
PATH_FORMS = (
    (r"~\d+\]", "]"),
    (r"\[id=[^\]]+\]", "[id=*]"),
    (r"\[name=[^\]]+\]", "[name=*]"),
    (r"\[run=[0-9a-f]+\]", "[run=*]"),
    (r"\[#\d+\]", "[#*]"),
    (r"\['[^']*'\]", "[str=*]"),
    (r"\[(-?\d+(\.\d+)?|True|False|None)\]", "[num=*]"),
    (r"\[\d+\]", "[*]"),
)

#: Words that name a permission.
PERMISSIONS = ("read", "write", "none", "read-all", "write-all", "inherit")
SHA = r"^[0-9a-f]{40}$"
TAG = r"^v?\d+(\.\d+){0,2}$"

#: Upper ends of the lag buckets in days; each includes its upper end.
LAG_BUCKETS = ((1, 7, "1-7 d"), (7, 30, "1-4 w"), (30, 90, "1-3 mo"), (90, 365, "3-12 mo"), (365, 10**9, ">1 y"))
SAME_DAY = 1.0


def sample_hash(key: Column, seed: int = 42) -> Column:
    """The rank of a key in a deterministic sample: SHA-256, which any SQL engine can repeat."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def template_digest(lines: Column) -> Column:
    """One digest of a sorted array of lines, each ended by a newline; of none, that of the empty string."""
    return F.sha2(F.when(F.size(lines) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit("")), 256)


def cache_key(*parts: Column, length: int = 32) -> Column:
    """A content key: the first hexadecimal digits of the SHA-256 of the parts, joined by NUL."""
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, length)


def shard_path(key: Column, depth: int = 2) -> Column:
    return F.concat_ws("/", *[F.substring(key, 2 * i + 1, 2) for i in range(depth)], key)


def set_key(items: Column) -> Column:
    """A set as a grouping key: its sorted distinct members, joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(items)), ",")


def is_release_branch(name: Column, default_branch: Column) -> Column:
    return name.rlike(RELEASE_PATTERN) & (name != default_branch)


def generalise_path(path: Column) -> Column:
    for pattern, replacement in PATH_FORMS:
        path = F.regexp_replace(path, pattern, replacement)
    return path


def value_sketch(kind: Column, leaf: Column) -> Column:
    """The shape of a leaf of kind null, bool, int, float or str, given as text."""
    action, ref = split_action(leaf)
    form = F.when(ref.rlike(SHA), "sha").when(ref.rlike(TAG), "tag").otherwise("ref")
    uses = leaf.contains("@") & F.substring_index(leaf, "@", 1).contains("/")
    text = (
        F.when(uses, F.concat(F.lit("uses:"), action, F.lit("@<"), form, F.lit(">")))
        .when(leaf.contains("${{"), "expr")
        .when(leaf.isin(*PERMISSIONS), F.concat(F.lit("perm:"), leaf))
        .otherwise("str")
    )
    size = lambda name, n: F.concat(F.lit(f"{name}["), F.coalesce(n, F.lit(0)).cast("string"), F.lit("]"))
    return (
        F.when(kind == "bool", F.concat(F.lit("bool:"), leaf)).when(kind == "null", "null").when(kind.isin("int", "float"), "num").when(kind == "str", text)
        .when(kind == "list", size("list", F.json_array_length(leaf))).when(kind == "map", size("obj", F.size(F.json_object_keys(leaf)))).otherwise(kind)
    )


def split_action(value: Column) -> tuple[Column, Column]:
    """What stands before and after the last ``@``."""
    ref = F.substring_index(value, "@", -1)
    return value.substr(F.lit(1), F.char_length(value) - F.char_length(ref) - 1), ref


def edit_line(op: Column, path: Column, sketch: Column, old_sketch: Column) -> Column:
    """The canonical line of one edit: what is added, removed or changed where."""
    plain = generalise_path(path)
    return (
        F.when(op == "added", F.concat(F.lit("+ "), plain, F.lit(" = "), sketch))
        .when(op == "removed", F.concat(F.lit("- "), plain, F.lit(" = "), sketch))
        .otherwise(F.concat(F.lit("~ "), plain, F.lit(" : "), old_sketch, F.lit(" -> "), sketch))
    )


def route_of(segments: Column) -> Column:
    """Keys joined by dots, list positions in brackets, from an array of strings such as ``jobs`` or ``[2]``."""
    return F.replace(F.array_join(segments, "."), F.lit(".["), F.lit("["))


def host_of_route(route: Column) -> Column:
    """struct(kind, job, service, step): which construct a finding's route lies in."""
    step = F.regexp_extract(route, r"^jobs\.([^.\[]+)\.steps\[(\d+)\]", 2)
    service = F.regexp_extract(route, r"^jobs\.([^.\[]+)\.services\.([^.\[]+)", 2)
    job = F.regexp_extract(route, r"^jobs\.([^.\[]+)", 1)
    kind = F.when(step != "", "step").when(service != "", "service").when(job != "", "job").otherwise("root")
    return F.struct(kind.alias("kind"), F.nullif(job, F.lit("")).alias("job"), F.nullif(service, F.lit("")).alias("service"), F.nullif(step, F.lit("")).cast("int").alias("step"))


def scope_of_route(route: Column) -> Column:
    """The step, service or job that a route lies in; the root is the empty string."""
    return F.coalesce(*[F.nullif(F.regexp_extract(route, p, 1), F.lit("")) for p in (r"^(.*?\.steps\[\d+\])", r"^(jobs\.[^.\[]+\.services\.[^.\[]+)", r"^(jobs\.[^.\[]+)")], F.lit(""))


def flat_file_name(path: Column) -> Column:
    """A path as a file name: its ending off, slashes as two underscores."""
    return F.replace(F.regexp_replace(F.regexp_replace(path, r"\.yml$", ""), r"\.yaml$", ""), F.lit("/"), F.lit("__"))


def commit_folder(repository: Column, commit_hash: Column) -> Column:
    return F.concat(F.replace(repository, F.lit("/"), F.lit("__")), F.lit("__"), F.substring(commit_hash, 1, 10))


def days_between(start: Column, end: Column) -> Column:
    """Fractional days; of timestamps without zone, so that no session's zone moves them."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(86_400_000_000.0)


def refined_status(status: Column, lag_days: Column, same_day: float = SAME_DAY) -> Column:
    """A confirmed back-port by the sign of its lag; other statuses stay."""
    by_lag = F.when(lag_days.isNull(), "confirmed_backport_no_lag").when(lag_days > same_day, "true_backport").when(lag_days < -same_day, "independent_prior_fix").otherwise("same_day_fix")
    return F.when(status == "confirmed_backport", by_lag).otherwise(F.coalesce(status, F.lit("missing")))


def lag_bucket(lag_days: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for low, high, name in LAG_BUCKETS:
        out = out.when((lag_days > low) & (lag_days <= high), name)
    return out


def percent(n: Column, total: Column) -> Column:
    return F.coalesce(F.concat(F.format_number(100.0 * n / F.nullif(total, F.lit(0)), 1), F.lit("%")), F.lit("—"))


def pinned_hashes(text: Column) -> Column:
    """The 40-digit hashes after ``@`` in a text."""
    return F.regexp_extract_all(text, F.lit(r"@([0-9a-f]{40})\b"), F.lit(1))


def equality_step(byte: Column, tree: Column, effect: Column) -> Column:
    """The first comparison that two patched texts pass."""
    return F.when(byte, "byte_equal").when(tree, "ast_equal").when(effect, "effect_equal").otherwise("divergent")
