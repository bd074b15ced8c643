"""Layered and nested configuration, settings, answers, packages and the registry."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions.text import REGISTRY_STAMP, stem, strip
from runloom.session import stored

# Question types a typed leaf may have.
QUESTION_TYPES = ["text", "path", "confirm", "list", "checkbox", "password"]

# Setting keys and their options; the first option is the default.
SETTINGS = {
    "no_parsl_config_behavior": ["use_package_default", "fail"],
    "delete_temporary_files": ["yes", "no"],
}

# Names of built-in run configurations.
BUILT_IN_CONFIGS = [
    "basic-threads-8", "basic-threads-4", "basic-threads-2", "basic-threads-1", "sequential-local",
]

def parse_config(files: DataFrame, strict: bool = False) -> DataFrame:
    """Parse ``json`` into the variant ``tree``; ``valid`` tells whether it was JSON.

    A missing or malformed text becomes ``{}``; with ``strict`` it fails the query instead.
    """
    if strict:
        return files.withColumn("tree", F.parse_json("json")).withColumn("valid", F.lit(True))
    tree = F.try_parse_json("json")
    return files.withColumn("valid", tree.isNotNull()).withColumn(
        "tree", F.coalesce(tree, F.parse_json(F.lit("{}")))
    )


#: How deep the braces of ``tree`` are nested; texts, which may hold braces, are taken out first.
DEPTH = r"""aggregate(split(regexp_replace(regexp_replace(to_json(tree), '"(?:[^"\\\\]|\\\\.)*+"', ''), '[^{}]', ''), ''),
    named_struct('d', 0, 'm', 0),
    (a, c) -> named_struct('d', a.d + CASE c WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END, 'm', greatest(a.m, a.d + CASE c WHEN '{' THEN 1 ELSE 0 END)),
    a -> a.m)"""


def _nodes(configs: DataFrame) -> DataFrame:
    """``config_id, path, value, members`` of every leaf of each configuration (config_id, tree).

    A leaf is a text or an object with ``q_type``; other objects are descended into, within the
    row and without a shuffle, and so is the outermost one whatever its keys.  Anything else is a leaf as well.  The
    number of steps is the depth to which braces are nested.
    """
    node = "named_struct('path', {0}, 'value', {1}, 'members', TRY_CAST({1} AS MAP<STRING, VARIANT>))"
    start = "array(" + node.format("CAST(array() AS ARRAY<STRING>)", "tree") + ")"
    member = node.format("array_append(n.path, e.key)", "e.value")
    inner = "n.members IS NOT NULL AND (size(n.path) = 0 OR NOT map_contains_key(n.members, 'q_type'))"
    step = f"""flatten(transform(acc, n -> CASE WHEN {inner}
        THEN transform(map_entries(n.members), e -> {member}) ELSE array(n) END))"""
    kind = "ARRAY<STRUCT<path: ARRAY<STRING>, value: VARIANT, members: MAP<STRING, VARIANT>>>"
    nodes = configs.select("config_id", F.expr(
        f"""reduce(sequence(1, 1 + {DEPTH}), CAST({start} AS {kind}),
            (acc, i) -> CASE WHEN exists(acc, n -> {inner}) THEN CAST({step} AS {kind}) ELSE acc END)"""
    ).alias("nodes"))
    # The outer form, because the optimizer would compute the whole array a second time in a
    # filter for empty ones; an empty configuration gives one null, dropped here.
    return nodes.select("config_id", F.explode_outer("nodes").alias("n")).where("n IS NOT NULL").select("config_id", "n.*")


def config_flatten(configs: DataFrame) -> DataFrame:
    """Leaves of each configuration (config_id, tree) and what they ask for; what is neither text nor question has an ``error``."""
    leaves = _nodes(configs).select(
        "config_id", "path",
        F.expr("schema_of_variant(value)").alias("shape"),
        F.expr("try_variant_get(value, '$', 'string')").alias("text"),
        F.expr("try_variant_get(value, '$.q_type', 'string')").alias("q_type"),
        F.expr("try_variant_get(value, '$.default', 'string')").alias("default_value"),
        F.expr("try_variant_get(value, '$.always_default', 'variant') IS NOT NULL").alias("always_default"),
    )
    key = F.element_at("path", -1)
    is_text = F.col("shape") == "STRING"
    is_object = F.col("shape").startswith("OBJECT")
    asked = F.lower(strip(F.col("q_type")))
    error = (
        F.when(F.size("path") == 0, "outermost is not an object")
        .when(~is_text & ~is_object, "unknown object")
        .when(is_object & (asked.isNull() | ~asked.isin(QUESTION_TYPES)), "bad q_type")
    )
    return leaves.select(
        "config_id", "path", F.concat_ws("__", F.lit("root"), "path").alias("name"),
        F.when(error.isNull(), F.when(is_text, F.when(F.lower(key).contains("path"), "Path").otherwise("Text"))
               .otherwise(F.initcap(asked))).alias("leaf_type"),
        F.when(is_text, F.col("text")).alias("value"),
        F.when(is_object, F.col("default_value")).alias("default_value"),
        "always_default", error.alias("error"),
    )


def question_attributes(configs: DataFrame) -> DataFrame:
    """Everything that the questions of each configuration (config_id, tree) say: ``config_id, name, attribute, json``, a row each.

    ``json`` keeps the type: a message is a quoted text, choices are an array.
    """
    asked = _nodes(configs).where("map_contains_key(members, 'q_type') AND size(path) > 0")
    each = asked.select("config_id", F.concat_ws("__", F.lit("root"), "path").alias("name"), F.explode("members").alias("attribute", "v"))
    return each.select("config_id", "name", "attribute", F.expr("to_json(v)").alias("json"))


def question_rules(attributes: DataFrame) -> DataFrame:
    """``config_id, question, choices`` of the questions that have a list of choices, from :func:`question_attributes`."""
    return attributes.where("attribute = 'choices'").select(
        "config_id", F.col("name").alias("question"), F.from_json("json", "array<string>").alias("choices")).where("choices IS NOT NULL")


def typed_leaves(configs: DataFrame) -> DataFrame:
    """``config_id, path, json``: every leaf as it is, numbers, truth values, arrays, nulls and whole questions included.

    ``config_inflate`` of these gives the configuration back; only objects without a member leave no trace.
    """
    return _nodes(configs).where("size(path) > 0").select("config_id", "path", F.expr("to_json(value)").alias("json"))


def config_errors(leaves: DataFrame) -> DataFrame:
    return leaves.where("error IS NOT NULL").select("config_id", "name", "error")


def config_inflate(leaves: DataFrame) -> DataFrame:
    """Nested JSON per configuration from leaves (config_id, path, value), deepest level first.

    ``value`` is a text; leaves with a column ``json`` in its place (:func:`typed_leaves`) keep their type.

    Paths stay arrays, so a key may contain ``__``.  Only the depth comes to the driver; the
    leaves are written once because every level reads them.
    """
    def text(c: Column) -> Column:
        quoted = F.to_json(F.array(c))
        return F.substring(quoted, F.lit(2), F.length(quoted) - 2)

    rows, (depth,) = stored(
        leaves.where(F.size("path") > 0).select("config_id", "path", text(F.col("value")).alias("json") if "value" in leaves.columns else "json"),
        "leaves", F.max(F.size("path")),
    )
    folded = None
    for level in range(depth or 0, 0, -1):
        here = rows.where(F.size("path") == level)
        here = here if folded is None else here.unionByName(folded)
        folded = here.select(
            "config_id", F.slice("path", 1, level - 1).alias("path"), F.element_at("path", -1).alias("key"),
            F.concat(text(F.element_at("path", -1)), F.lit(":"), "json").alias("member"),
        ).groupBy("config_id", "path").agg(
            F.concat(F.lit("{"), F.expr("listagg(member, ',') WITHIN GROUP (ORDER BY key)"), F.lit("}")).alias("json")
        )
    return (rows if folded is None else folded).select("config_id", "json")


def config_overlay(leaves: DataFrame, prior: DataFrame) -> DataFrame:
    """Default of each question: the prior answer (config_id, name, value) unless it is empty
    or the leaf always keeps its own default."""
    before = prior.select("config_id", "name", F.nullif(F.col("value"), F.lit("")).alias("prior"))
    return leaves.where("error IS NULL").join(before, ["config_id", "name"], "left").select(
        "config_id", "name", "leaf_type",
        F.when(F.col("always_default"), F.col("default_value"))
        .otherwise(F.coalesce("prior", "default_value")).alias("default_value"),
    )


def software_path_inject(packages: DataFrame, env_root: str, stored: DataFrame) -> DataFrame:
    """Program paths from installed packages, which replace the stored ones.

    ``packages`` (pipeline_id, seq, tag, config_key, executable_path); the last package of a
    key wins.  ``stored`` (pipeline_id, config_key, path).
    """
    env = F.concat(F.lit(env_root + "/"), F.col("pipeline_id").cast("string"), F.lit("/"))
    inside = F.coalesce(
        F.nullif("executable_path", F.lit("")), F.concat(F.lit("bin/"), F.substring_index("tag", "=", 1))
    )
    injected = packages.groupBy("pipeline_id", "config_key").agg(
        F.max_by(F.concat(env, inside), "seq").alias("injected")
    )
    old = stored.select("pipeline_id", "config_key", F.col("path").alias("stored"))
    return injected.join(old, ["pipeline_id", "config_key"], "full").select(
        "pipeline_id", "config_key", F.coalesce("injected", "stored").alias("path"), "stored"
    )


def tag_inventory(packages: DataFrame) -> DataFrame:
    """Distinct package tags of each pipeline, in order."""
    return packages.groupBy("pipeline_id", "tag").agg(F.count(F.lit(1)).alias("n_packages")).orderBy(
        "pipeline_id", "tag"
    )


def config_cascade(candidates: DataFrame, loadable: DataFrame | None = None) -> DataFrame:
    """First usable run configuration: command line, pipeline configuration, pipeline default,
    package default if the setting allows it, else failure.

    A candidate on the first two levels is usable if built in or among ``loadable`` (name: files that
    load); the pipeline default is taken as it is.
    """
    for column in ("cmd_line", "pipeline_config"):
        mark = F.lit(False)
        if loadable is not None:
            known = loadable.select(F.col("name").alias(column)).distinct().withColumn(f"_{column}", F.lit(True))
            candidates = candidates.join(known, column, "left")
            mark = F.coalesce(f"_{column}", F.lit(False))
        candidates = candidates.withColumn(f"_{column}", F.coalesce(F.col(column).isin(list(BUILT_IN_CONFIGS)), F.lit(False)) | mark)

    def usable(column: str) -> Column:
        return F.col(f"_{column}")

    default = F.coalesce(F.col("pipeline_default") != "", F.lit(False))
    package = F.col("no_config_behavior") == "use_package_default"
    return candidates.select(
        "pipeline_id",
        F.when(usable("cmd_line"), F.col("cmd_line"))
        .when(usable("pipeline_config"), F.col("pipeline_config"))
        .when(default, F.col("pipeline_default"))
        .when(package, "basic-threads-2").alias("chosen"),
        F.when(usable("cmd_line"), "command line").when(usable("pipeline_config"), "pipeline config")
        .when(default, "pipeline default").when(package, "package default").otherwise("fail").alias("level"),
    )


def setting_validate(changes: DataFrame, schema: Mapping[str, Sequence[str]] = SETTINGS) -> DataFrame:
    """Outcome of each settings change: 'set', 'bad key' or 'bad value'."""
    outcome = F.lit("bad key")
    for key, options in schema.items():
        outcome = F.when(
            F.col("setting_key") == key,
            F.when(F.coalesce(F.col("setting_value").isin(list(options)), F.lit(False)), "set").otherwise("bad value"),
        ).otherwise(outcome)
    return changes.select("change_id", "setting_key", "setting_value", outcome.alias("outcome"))


def settings_current(changes: DataFrame, schema: Mapping[str, Sequence[str]] = SETTINGS) -> DataFrame:
    """Value of every setting that was ever set: the last accepted change."""
    return setting_validate(changes, schema).where("outcome = 'set'").groupBy("setting_key").agg(
        F.max_by("setting_value", "change_id").alias("setting_value")
    )


def setting_value(changes: DataFrame, key: str, schema: Mapping[str, Sequence[str]] = SETTINGS) -> str:
    """The value of one setting in force; the first of its options if it was never set."""
    row = settings_current(changes, schema).where(F.col("setting_key") == key).first()
    return row["setting_value"] if row else schema[key][0]


def answer_validate(answers: DataFrame, rules: DataFrame) -> DataFrame:
    """Value and standing of each answer (answer_id, question, q_type, answer, default_value, ignored).

    An ignored question takes its default unasked; an empty answer takes the default.  ``rules`` has the ``choices`` (an array) of
    those questions that accept nothing else; with a ``config_id`` on both sides they hold for the question of that configuration
    alone.  Rules that repeat are one; choices given in several rules are all allowed.
    """
    kind = F.lower(strip(F.col("q_type")))
    value = F.when(F.col("ignored") | (F.coalesce("answer", F.lit("")) == ""), F.col("default_value")).otherwise(F.col("answer"))
    keys = [c for c in ("config_id", "question") if c in rules.columns and c in answers.columns]
    one = rules.where("choices IS NOT NULL").groupBy(*keys).agg(F.flatten(F.collect_set("choices")).alias("choices"))
    answers = answers.join(one, keys, "left")
    allowed = F.when(F.col("choices").isNull(), F.lit(True)).otherwise(F.array_contains("choices", value))
    status = (
        F.when(~kind.isin(QUESTION_TYPES), "bad q_type")
        .when(F.col("ignored"), "ignored")
        .when(~F.coalesce(allowed, F.lit(False)), "not a choice")
        .when(F.coalesce("answer", F.lit("")) == "", "default")
        .otherwise("answered")
    )
    return answers.select("answer_id", value.alias("value"), status.alias("status"))


#: Fixed value: the type of a registry record that stands for a pipeline.
PIPELINE_RECORD = "pipeline_record"


def registry_current(changes: DataFrame) -> DataFrame:
    """What is installed now, from changes (type, name, op, changed_at, seq); only pipeline records count.

    A name is installed if its last install is later than its last uninstall, and configured
    if a configure came after that install.  One aggregate, no ordering of the history.
    """
    at = F.struct("changed_at", "seq")

    def last(op: str) -> Column:
        return F.max(F.when(F.col("op") == op, at)).alias(op)

    changes = changes.where(F.col("type") == PIPELINE_RECORD)
    state = changes.groupBy("name").agg(last("install"), last("configure"), last("uninstall"))
    return state.where("install IS NOT NULL AND (uninstall IS NULL OR install > uninstall)").select(
        "name", F.col("install.changed_at").alias("installed_at"),
        F.coalesce(F.col("configure") > F.col("install"), F.lit(False)).alias("configured"),
    )


def registry_list(changes: DataFrame) -> DataFrame:
    """Listing of installed names with Yes / No, in order of installation."""
    return registry_current(changes).orderBy("installed_at", "name").select(
        "name", F.when(F.col("configured"), "Yes").otherwise("No").alias("configured"),
        F.date_format("installed_at", REGISTRY_STAMP).alias("installed_date"),
    )


def installed_lookup(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Files (path) whose base name is an installed name."""
    return files.withColumn("name", stem(F.col("path"))).join(registry.select("name"), "name", "left_semi")
