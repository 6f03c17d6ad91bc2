"""Semantic patches as text, by DataFrame functions alone.

    @@
    # source: owner/name@sha path
    fixes rule-a, rule-b
    metavariable job $JOB
    @@

    jobs.$JOB.steps[uses=acme/fetch]
    - uses: acme/fetch@<tag>
    + uses: acme/fetch@<sha: pin target_ref>

    jobs.$JOB
    + timeout-minutes: 10
    - secrets

An anchor's line is followed by its edits: ``+`` alone ensures a key, ``-`` alone ensures it's absent, both rewrite
it. Values are JSON where bare text would read back as something else. Edits to be reviewed are comments, so the
round trip keeps those that can be run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Marks in the text of a pin.
PIN_MARK, TAG_MARK = "<sha: pin target_ref>", "<tag>"
def path_segments(path: Column) -> Column:
    """A path's keys and bracketed list identities, in order; brackets inside an identity are balanced at any depth.

    The path is folded over its pieces that are one bracket or have none.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("depth"))

    def step(at: Column, piece: Column) -> Column:
        deeper = at["depth"] + F.when(piece == "[", 1).when(piece == "]", -1).otherwise(0)
        whole = F.concat(at["open"], piece)
        keys = F.filter(F.split(piece, r"\."), lambda k: k != "")
        return (
            F.when((at["depth"] == 0) & ~piece.isin("[", "]"), F.struct(F.concat(at["done"], keys).alias("done"), F.lit("").alias("open"), F.lit(0).alias("depth")))
            .when((piece == "]") & (deeper <= 0), F.struct(F.concat(at["done"], F.array(whole)).alias("done"), F.lit("").alias("open"), F.lit(0).alias("depth")))
            .otherwise(F.struct(at["done"].alias("done"), whole.alias("open"), deeper.alias("depth")))
        )

    return F.aggregate(F.regexp_extract_all(path, F.lit(r"[\[\]]|[^\[\]]+"), F.lit(0)), start, step)["done"]


def segment_parts(segment: Column) -> Column:
    """struct(kind, list_kind, value) of a segment: key, keyvar, or list with what identifies its element."""
    inner = F.regexp_replace(F.substr(segment, F.lit(2)), r"(~\d+)?\]$", "")
    named = F.regexp_extract(inner, r"^(uses|id|name|key)=", 1)
    list_kind = F.when(named != "", named).when(inner == "run", "run").when(inner == "anon", "anon").when(inner.rlike("^'.*'$"), "str").when(inner.rlike(r"^#\d+$"), "index").otherwise("scalar")
    bare = F.when(named != "", F.regexp_replace(inner, r"^[a-z]+=", "")).when(inner.rlike("^'.*'$"), F.regexp_replace(inner, "^'|'$", "")).when(inner.isin("run", "anon"), "").otherwise(inner)
    is_list, is_var = segment.startswith("["), segment.startswith("$")
    return F.struct(F.when(is_list, "list").when(is_var, "keyvar").otherwise("key").alias("kind"), F.when(is_list, list_kind).alias("list_kind"), F.when(is_list, bare).when(is_var, F.substr(segment, F.lit(2))).otherwise(segment).alias("value"))


def anchor_text(anchor: Column) -> Column:
    return F.when(F.size(anchor) == 0, ".").otherwise(F.replace(F.array_join(anchor, "."), F.lit(".["), F.lit("[")))


def bare_value(value: Column) -> Column:
    """JSON as it stands in a line: plain words without their quotes where they read back as the same string."""
    inner = F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")
    plain = value.startswith('"') & inner.rlike(r"^[A-Za-z_./][\w ./@-]*\w$") & ~F.lower(inner).isin("true", "false", "null", "nan", "infinity")
    return F.when(plain, inner).otherwise(value)


def json_value(text: Column) -> Column:
    """What a line's value is as JSON: itself if it is JSON, else a string."""
    is_json = F.try_parse_json(text).isNotNull() & text.rlike(r'^(".*"|\[.*\]|\{.*\}|-?\d+(\.\d+)?([eE][-+]?\d+)?|true|false|null)$')
    return F.when(is_json, text).otherwise(F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))


def render(programs: DataFrame, edits: DataFrame, key: str = "program") -> DataFrame:
    """(key, text): programs (key, repository, commit_hash, source_file, target_idents) and their edits."""
    pin = F.col("pin_action").isNotNull()
    name = F.concat("key", F.lit(": "))
    minus = F.concat(F.lit("- "), name, F.when(pin, F.concat("pin_action", F.lit(f"@{TAG_MARK}"))).otherwise(F.coalesce("expected_old", F.lit("null"))))
    plus = F.concat(F.lit("+ "), name, F.when(pin, F.concat("pin_action", F.lit(f"@{PIN_MARK}"))).otherwise(bare_value(F.col("value"))))
    line = F.when(F.col("op") == "ensure_present", plus).when(F.col("op") == "ensure_absent", F.concat(F.lit("- "), "key")).otherwise(F.concat_ws("\n", minus, plus))
    run = edits.filter("review is null").select(key, "ordinal", anchor_text(F.col("anchor")).alias("_a"), line.alias("_line"), F.array_contains("anchor", "$JOB").alias("_job"))
    blocks = run.groupBy(key, "_a").agg(F.min("ordinal").alias("_o"), F.bool_or("_job").alias("_job"), F.sort_array(F.collect_list(F.struct("ordinal", "_line"))).alias("_l"))
    blocks = blocks.withColumn("_block", F.concat_ws("\n", "_a", F.array_join(F.transform("_l", lambda x: x["_line"]), "\n")))
    bodies = blocks.groupBy(key).agg(F.bool_or("_job").alias("_job"), F.sort_array(F.collect_list(F.struct("_o", "_block"))).alias("_b"))
    note = F.concat(F.lit("#   "), anchor_text(F.col("anchor")), F.lit("."), "key", F.lit("  ->  "), "review")
    notes = edits.filter("review is not null").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ordinal", note.alias("_n")))).alias("_notes"))
    whole = programs.join(bodies, key, "left").join(notes, key, "left")
    head = F.concat_ws(
        "\n", F.lit("@@"), F.when(F.col("repository") != "", F.concat(F.lit("# source: "), "repository", F.lit("@"), "commit_hash", F.lit(" "), "source_file")),
        F.when(F.size("target_idents") > 0, F.concat(F.lit("fixes "), F.array_join("target_idents", ", "))), F.when(F.col("_job"), "metavariable job $JOB"), F.lit("@@"),
    )
    review = F.when(F.size("_notes") > 0, F.concat(F.lit("# --- needs review (not auto-applied) ---\n"), F.array_join(F.transform("_notes", lambda n: n["_n"]), "\n")))
    text = F.concat(F.concat_ws("\n\n", head, F.when(F.size("_b") > 0, F.array_join(F.transform("_b", lambda b: b["_block"]), "\n\n")), review), F.lit("\n"))
    return whole.select(key, text.alias("text"))


def read(texts: DataFrame, key: str = "program") -> tuple[DataFrame, DataFrame]:
    """(programs, edits) from (key, text). A text's lines are numbered; an edit's anchor is the last line that isn't one."""
    lines = texts.select(key, F.posexplode(F.split("text", "\n")).alias("_n", "_raw")).withColumn("_line", F.trim("_raw"))
    upto = Window.partitionBy(key).orderBy("_n")
    lines = lines.withColumn("_part", F.count_if(F.col("_line") == "@@").over(upto))
    head = lines.filter("_part = 1")
    source = r"^# source:\s+(\S+)@(\S+)\s+(.+)$"
    part = lambda i: F.coalesce(F.max(F.nullif(F.regexp_extract("_line", source, i), F.lit(""))), F.lit(""))
    fixes = F.max(F.when(F.col("_line").startswith("fixes "), F.split(F.substr("_line", F.lit(7)), r"\s*,\s*")))
    programs = head.groupBy(key).agg(part(1).alias("repository"), part(2).alias("commit_hash"), part(3).alias("source_file"), F.coalesce(fixes, F.array().cast("array<string>")).alias("target_idents"))

    body = lines.filter("_part >= 2").filter("_line not in ('', '@@') and not _line like '#%'")
    is_edit = F.col("_line").rlike("^[+-]")
    body = body.withColumn("_a", F.last(F.when(~is_edit, F.col("_line")), ignorenulls=True).over(upto)).withColumn("_block", F.count_if(~is_edit).over(upto)).filter(is_edit & F.col("_a").isNotNull())
    rest = F.trim(F.substr("_line", F.lit(2)))
    keyed = body.select(key, "_n", "_a", "_block", F.substring("_line", 1, 1).alias("_sign"), F.trim(F.regexp_extract(rest, r"^([^:]*)", 1)).alias("key"), F.trim(F.regexp_extract(rest, r"^[^:]*:(.*)$", 1)).alias("_value"))
    of = lambda sign: F.max(F.when(F.col("_sign") == sign, F.col("_value")))
    met = keyed.groupBy(key, "_block", "_a", "key").agg(F.min("_n").alias("_n"), of("+").alias("_plus"), of("-").alias("_minus"))
    both = F.col("_plus").isNotNull() & F.col("_minus").isNotNull()
    pinned = both & F.col("_plus").contains(PIN_MARK)
    op = F.when(both, "rewrite_value").when(F.col("_plus").isNotNull(), "ensure_present").otherwise("ensure_absent")
    anchor = F.when(F.col("_a") == ".", F.array().cast("array<string>")).otherwise(path_segments(F.col("_a")))
    edits = met.select(
        key, F.row_number().over(Window.partitionBy(key).orderBy("_n", "key")).alias("ordinal"), op.alias("op"), anchor.alias("anchor"), "key",
        F.when(F.col("_plus").isNotNull() & ~pinned, json_value(F.col("_plus"))).alias("value"), F.when(pinned, F.trim(F.substring_index("_plus", "@", 1))).alias("pin_action"),
        F.when(both, F.nullif(F.col("_minus"), F.lit(""))).alias("expected_old"), F.lit(None).cast("string").alias("review"),
    )
    return programs, edits
