"""Column expressions over lineage records: ids, scopes, windows, categories, presentation values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that mark tables made by the platform itself.
INTERNAL = r"^(__materialization_mat_|event_log_|__apply_changes)"
INTERNAL_FULL = r"[.](__materialization_mat_|event_log_|__apply_changes)"
SYSTEM_CATALOGS = ("system", "__databricks_internal")
SYSTEM_SCHEMAS = ("information_schema", "default")

# Transformation categories in order of priority; the first pattern that occurs decides.
CATEGORY_PATTERNS = (
    ("window", r"\bover\s*\("),
    ("window", r"\.over\(\s*Window"),
    ("aggregation", r"\b(sum|avg|mean|count|min|max|stddev(_pop|_samp)?|variance|var_pop|var_samp|collect_list|collect_set|first|last|approx_count_distinct|percentile(_approx)?)\s*\("),
    ("case", r"\bcase\s+when\b"),
    ("case", r"\b(iff|if|when)\s*\("),
    ("null_handling", r"\b(coalesce|ifnull|nvl|nullif)\s*\("),
    ("cast", r"\bcast\s*\("),
    ("cast", r"::\s*[\w()]+"),
    ("cast", r"\.cast\("),
    ("string_fn", r"\b(concat(_ws)?|substr(ing)?|upper|lower|trim|ltrim|rtrim|replace|regexp_replace|regexp_extract|split|lpad|rpad|initcap|length)\s*\("),
    ("date_fn", r"\b(date_trunc|date_add|date_sub|datediff|to_date|to_timestamp|current_date|current_timestamp|year|month|dayofmonth|dayofweek|hour|minute|second|unix_timestamp|from_unixtime)\s*\("),
    ("arithmetic", r"[+\-*/%]"),
)
PROJECTION_PATTERNS = (r"^[\w.\"'` ]+$", r"(?i)^(col|F\.col)\(\s*[\"'][\w]+[\"']\s*\)$")

# Colours of categories and of levels.
DEFAULT_COLOUR = "#6B7280"
CATEGORY_COLOURS = {
    "ARITHMETIC": "#FF4433",
    "WINDOW": "#A855F7",
    "TYPE CAST": "#10B981",
    "CAST": "#10B981",
    "AGGREGATE": "#3B82F6",
    "AGGREGATION": "#3B82F6",
    "STATISTICAL": "#F59E0B",
    "PROJECTION": "#6366F1",
    "PASSTHROUGH": "#6B7280",
    "FILTER": "#EC4899",
    "JOIN": "#06B6D4",
    "CONDITIONAL": "#F472B6",
    "OTHER": "#9CA3AF",
    "UNKNOWN": "#6B7280",
}
LEVEL_COLOURS = ("#FF4433", "#3B82F6", "#A855F7", "#10B981", "#F59E0B", "#6366F1", "#EC4899", "#06B6D4")


def ref_id(table: Column, path: Column) -> Column:
    """Stable node id of one end of a lineage record: the table's name wins; a volume path becomes its volume, a store path its
    bucket, any other path its first 80 characters; null if both are null or empty."""
    clean = F.when(path.startswith("dbfs:/Volumes/"), F.substr(path, F.lit(6))).otherwise(path)
    parts = F.split(clean, "/")
    volume = F.when(F.size(parts) >= 5, F.concat_ws(".", parts[2], parts[3], parts[4])).otherwise(F.concat(F.lit("volume:"), clean))
    protocol = F.substring_index(clean, "://", 1)
    bucket = F.split(F.substr(clean, F.length(protocol) + 4), "/")[0]
    other = F.when(F.instr(clean, "://") > 0, F.concat(F.lit("path:"), protocol, F.lit("://"), bucket)).otherwise(F.concat(F.lit("path:"), F.substring(clean, 1, 80)))
    return F.when(F.coalesce(table, F.lit("")) != "", table).when(F.coalesce(path, F.lit("")) != "", F.when(clean.startswith("/Volumes/"), volume).otherwise(other))


def ref_type(table: Column, path: Column, kind: Column) -> Column:
    """Display type of one end of a lineage record; a table without a type is a TABLE."""
    on_volume = path.startswith("/Volumes/") | path.startswith("dbfs:/Volumes/")
    return F.when(F.coalesce(table, F.lit("")) != "", F.coalesce(F.when(kind != "", kind), F.lit("TABLE"))).when(F.coalesce(path, F.lit("")) != "", F.when(on_volume, "VOLUME").otherwise("PATH"))


def entity_key(kind: Column, ident: Column) -> Column:
    """``entity:{type}:{id}``, null unless both are there."""
    return F.when((F.coalesce(kind, F.lit("")) != "") & (F.coalesce(ident, F.lit("")) != ""), F.concat(F.lit("entity:"), kind, F.lit(":"), ident))


def display_name(node: Column) -> Column:
    """Last part of a table's or volume's id; the bucket of a store path."""
    raw = F.regexp_replace(node, "^path:", "")
    stored = F.when(F.instr(raw, "://") > 0, F.split(F.substring_index(raw, "://", -1), "/")[0]).otherwise(raw)
    return F.when(node.startswith("path:"), stored).otherwise(F.substring_index(node, ".", -1))


def not_internal(name: Column) -> Column:
    return ~name.rlike(INTERNAL)


def not_internal_lineage(source: Column, target: Column) -> Column:
    return (source.isNull() | ~source.rlike(INTERNAL_FULL)) & (target.isNull() | ~target.rlike(INTERNAL_FULL))


def in_window(event_time: Column, as_of: Column, days: int) -> Column:
    """Strictly after midnight ``days`` days before ``as_of``."""
    return event_time > F.date_sub(F.to_date(as_of), days).cast("timestamp")


def in_scope(source: Column, target: Column, source_path: Column, target_path: Column, catalog: str, schema: str | None = None) -> Column:
    """Either end lies in the catalog (and schema), by name or on one of its volumes."""
    prefix = f"{catalog}.{schema}." if schema else f"{catalog}."
    folder = f"/Volumes/{catalog}/{schema}/" if schema else f"/Volumes/{catalog}/"
    hit = F.lit(False)
    for end, starts in ((source, (prefix,)), (target, (prefix,)), (source_path, (folder, "dbfs:" + folder)), (target_path, (folder, "dbfs:" + folder))):
        for start in starts:
            hit = hit | F.coalesce(end.startswith(start), F.lit(False))
    return hit


def schema_filter(schema: Column, wanted: str | None = None) -> Column:
    return schema == wanted if wanted else ~schema.isin(*SYSTEM_SCHEMAS)


def category(expr: Column) -> Column:
    """Category of a transformation expression; unknown if null or empty, other if nothing fits."""
    out = F.lit("other")
    for name, pattern in reversed(CATEGORY_PATTERNS):
        out = F.when(expr.rlike(f"(?i){pattern}"), name).otherwise(out)
    bare = F.trim(expr)
    return F.when(F.coalesce(expr, F.lit("")) == "", "unknown").when(bare.rlike(PROJECTION_PATTERNS[0]) | bare.rlike(PROJECTION_PATTERNS[1]), "projection").otherwise(out)


def category_colour(kind: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in CATEGORY_COLOURS.items() for x in pair))
    return F.coalesce(table[kind], F.lit(DEFAULT_COLOUR))


def level_label(depth: Column) -> Column:
    return F.when(depth == 0, "Target Column").otherwise(F.concat(F.lit("Upstream Layer "), depth.cast("string")))


def level_colour(depth: Column) -> Column:
    """One colour a level; all levels from the eighth on share the last."""
    return F.element_at(F.array(*map(F.lit, LEVEL_COLOURS)), F.least(depth, F.lit(7)).cast("int") + 1)


def discounted(cost: Column, percent: float) -> Column:
    """Cost less a discount, which is held between 0 and 99 per cent, to two places."""
    held = min(99.0, max(0.0, float(percent)))
    return F.round(cost.cast("decimal(18,4)") * F.lit(1 - held / 100).cast("decimal(9,6)"), 2).cast("double")


def column_node(table: Column, column: Column) -> Column:
    return F.concat(F.lit("col:"), table, F.lit("::"), column)


def node_table(node: Column) -> Column:
    return F.nullif(F.regexp_extract(node, "^col:([^:]+)::(.+)$", 1), F.lit(""))


def node_column(node: Column) -> Column:
    own = F.regexp_extract(node, "^col:([^:]+)::(.+)$", 2)
    return F.when(own != "", own).otherwise(F.substring_index(node, ":", -1))


def edge_id(*parts: Column) -> Column:
    return F.concat(F.lit("e_"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16))


def extraction_id(path_tag: Column) -> Column:
    return F.concat(F.lit("ext_"), F.substring(F.sha2(path_tag, 256), 1, 24))


def version_token(source: Column, parser: str) -> Column:
    """Changes with the source and with the parser's version."""
    return F.sha2(F.concat(F.lit(parser), F.lit("\u0000"), source), 256)


def age_text(seconds: Column) -> Column:
    """Whole minutes under an hour, hours under a day, else days."""

    def said(unit: int, letter: str) -> Column:
        return F.concat(F.floor(seconds / unit).cast("string"), F.lit(f"{letter} ago"))

    return F.when(seconds < 3600, said(60, "m")).when(seconds < 86400, said(3600, "h")).otherwise(said(86400, "d"))
