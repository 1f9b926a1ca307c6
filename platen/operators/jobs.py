"""Job building: defaults, templates, overrides, requests, routing, signatures and reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from platen.functions import gates
from platen.functions.numbers import MASK32, mix32

# A job's defaults, those of a service request, and the print templates.
DEFAULTS = {
    "template_id": 0, "photo_w_cm": 4.5, "photo_h_cm": 3.5, "dpi": 300, "cols": 2, "rows": 3, "gap": 15, "padding": 20, "border_px": 2,
    "bleed_px": 10, "crop_mark_px": 20, "crop_thickness": 2, "crop_offset_px": 8, "mode": 1, "bg_r": 255, "bg_g": 255, "bg_b": 255,
}
SERVICE_DEFAULTS = {"cols": 6, "rows": 6, "gap": 15, "dpi": 300, "border_px": 2, "padding": 20, "crop_mark_px": 15, "crop_thickness": 2, "bleed_px": 0, "crop_offset_px": 8, "photo_w_cm": 4.5, "photo_h_cm": 3.5}
_SHEET = {"cols": 6, "rows": 6, "gap": 15, "padding": 20, "border_px": 2, "bleed_px": 1, "crop_mark_px": 5, "crop_thickness": 10, "crop_offset_px": 5, "mode": 1}
TEMPLATES = [
    (1, "passport-45x35", "passport-45x35-printready", "4.5 x 3.5 cm, 6x6 grid, border 2px, bleed 1px, crop 5px", 4.5, 3.5),
    (2, "passport-38x35", "passport-38x35-printready", "3.8 x 3.5 cm, 6x6 grid, border 2px, bleed 1px, crop 5px", 3.8, 3.5),
    (3, "printready-6x6", None, "6x6 print sheet, border 2px, bleed 1px, crop 5px", None, None),
]
LAYOUT = ("cols", "rows", "gap", "padding", "border_px", "bleed_px", "crop_mark_px", "crop_thickness", "crop_offset_px", "mode")
#: The values that a render signature covers, in its order.
SIGNED = ("template_id", "abi_version", "photo_w_cm", "photo_h_cm", "dpi", "cols", "rows", "gap", "padding", "border_px", "bleed_px", "crop_mark_px", "crop_thickness", "crop_offset_px", "mode")


def templates(spark: SparkSession) -> DataFrame:
    """The catalog: three rows, so any join may broadcast it."""
    schema = "template_id int, name string, alias string, description string, photo_w_cm float, photo_h_cm float, " + ", ".join(f"{c} long" for c in LAYOUT)
    return spark.createDataFrame([(*t, *(_SHEET[c] for c in LAYOUT)) for t in TEMPLATES], schema)


def template_names(catalog: DataFrame) -> DataFrame:
    """(name, template_id) with the aliases."""
    return catalog.select("name", "template_id").unionByName(catalog.where("alias is not null").select(F.col("alias").alias("name"), "template_id"))


def default_column(name: str) -> Column:
    value = DEFAULTS[name]
    return F.lit(value).cast("float" if name.endswith("_cm") else "long")


def with_defaults(jobs: DataFrame) -> DataFrame:
    """Nulls and missing columns become the defaults."""
    for name in DEFAULTS:
        jobs = jobs.withColumn(name, F.coalesce(F.col(name), default_column(name)) if name in jobs.columns else default_column(name))
    return jobs


def apply_template(jobs: DataFrame, catalog: DataFrame) -> DataFrame:
    """A known template replaces layout, background and (if it has one) photo size; others make a job custom."""
    own = F.broadcast(catalog.select(F.col("template_id").alias("t_id"), *(F.col(c).alias(f"t_{c}") for c in ("photo_w_cm", "photo_h_cm", *LAYOUT))))
    joined = jobs.join(own, jobs["template_id"] == own["t_id"], "left")
    known = F.col("t_id").isNotNull()
    out = {c: F.coalesce(F.col(f"t_{c}"), F.col(c)).cast(dict(jobs.dtypes)[c]) for c in ("photo_w_cm", "photo_h_cm", *LAYOUT)}
    out |= {c: F.when(known, F.lit(255)).otherwise(F.col(c)).cast(dict(jobs.dtypes)[c]) for c in ("bg_r", "bg_g", "bg_b")}
    out["template_id"] = F.coalesce(F.col("t_id"), F.lit(0)).cast(dict(jobs.dtypes)["template_id"])
    return joined.select(*(out[c].alias(c) if c in out else F.col(c) for c in jobs.columns))


def lookup_template(df: DataFrame, catalog: DataFrame, on: str) -> DataFrame:
    """Adds template_id by name or alias, null if there is none."""
    names = F.broadcast(template_names(catalog).withColumnRenamed("name", "_name"))
    return df.join(names, df[on] == names["_name"], "left").drop("_name")


def describe_template(df: DataFrame, catalog: DataFrame) -> DataFrame:
    own = F.broadcast(catalog.select(F.col("template_id").alias("t_id"), "name", "description"))
    joined = df.join(own, df["template_id"] == own["t_id"], "left")
    return joined.withColumns({"name": F.coalesce("name", F.lit("custom")), "description": F.coalesce("description", F.lit("user-defined layout"))}).drop("t_id")


def option_cross_check(options: DataFrame) -> DataFrame:
    """Adds ``error`` (null if none): unreadable values first, then sizes that don't go with the input format."""
    kind, width, stride = gates.parse_format(F.col("input_format")), gates.parse_u32(F.col("input_width")), gates.parse_u32(F.col("input_stride"))
    unread = F.lit(False)
    for column, parser in (("opt_cols", gates.parse_u32), ("opt_gap", gates.parse_u32), ("opt_width", gates.parse_float), ("opt_mode", gates.parse_mode), ("input_width", gates.parse_u32), ("input_stride", gates.parse_u32)):
        unread = unread | (F.col(column).isNotNull() & parser(F.col(column)).isNull())
    error = (
        F.when(unread, "bad_value")
        .when(kind.isNull(), "bad_format")
        .when((kind == 1) & (F.coalesce(width, F.lit(0)) == 0), "raw_needs_dimensions")
        .when((kind == 1) & stride.isNotNull() & (stride != 0) & (stride < 3 * width), "stride_too_small")
        .when((kind == 0) & (F.col("input_width").isNotNull() | F.col("input_stride").isNotNull()), "dimensions_without_raw")
    )
    return options.withColumn("error", error)


def build_jobs(options: DataFrame, catalog: DataFrame) -> DataFrame:
    """A given option wins over the template, that over the defaults; what can't be read counts as not given."""
    base = lookup_template(options, catalog, "preset").withColumnRenamed("template_id", "_template")
    base = base.select("*", F.coalesce("_template", F.lit(0)).alias("template_id"))
    jobs = apply_template(with_defaults(base), catalog)
    given = {"cols": gates.parse_u32(F.col("opt_cols")), "gap": gates.parse_u32(F.col("opt_gap")), "photo_w_cm": gates.parse_float(F.col("opt_width")), "mode": gates.parse_mode(F.col("opt_mode"))}
    return jobs.select("job_id", *(F.coalesce(given[c], F.col(c)).cast("float" if c.endswith("_cm") else "long").alias(c) if c in given else F.col(c) for c in DEFAULTS))


def resolve_template(jobs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds ``result``: custom and known templates resolve, others are a format error."""
    own = F.broadcast(catalog.select(F.col("template_id").alias("t_id")))
    joined = jobs.join(own, jobs["template_id"] == own["t_id"], "left")
    return joined.withColumn("result", F.when((F.col("template_id") == 0) | F.col("t_id").isNotNull(), gates.SUCCESS).otherwise(gates.FORMAT)).drop("t_id")


def service_payload(requests: DataFrame) -> DataFrame:
    """A service request over the service's own defaults."""
    return requests.select(
        *(c for c in requests.columns if c not in SERVICE_DEFAULTS),
        *(F.coalesce(F.col(c) if c in requests.columns else F.lit(None), F.lit(v)).cast("float" if c.endswith("_cm") else "long").alias(c) for c, v in SERVICE_DEFAULTS.items()),
    )


def job_paths(df: DataFrame) -> DataFrame:
    """Where a service job's upload and sheet lie, by its id and file name."""
    return df.select("job_id", F.format_string("/data/uploads/%s_%s", F.col("job_id").cast("string"), "file_name").alias("input_path"), F.format_string("/data/outputs/%s.png", F.col("job_id").cast("string")).alias("output_path"))


def render_signature() -> Column:
    """The 32-bit signature of frame, job and cell: floats by thousandths of a cm, the frame by its id."""

    def value(c: str) -> Column:
        return F.round(F.col(c).cast("double") * 1000).cast("long") if c.endswith("_cm") else F.col(c).cast("long")

    values = F.array(*(value(c) for c in SIGNED), gates.bg_signature(F.col("bg_r"), F.col("bg_g"), F.col("bg_b")), F.col("cell_w"), F.col("cell_h"))
    return F.aggregate(values, F.col("frame_id").cast("long").bitwiseAND(F.lit(MASK32)), mix32)


def dedupe_tiles(jobs: DataFrame) -> DataFrame:
    """One row for each tile that must be rendered, and how many jobs share it: keys are aggregated, never joined in pairs.

    A tile depends on the background only where it is letterboxed (mode 0).
    """
    bg = F.when(F.col("mode") == 0, gates.bg_signature(F.col("bg_r"), F.col("bg_g"), F.col("bg_b"))).otherwise(F.lit(-1).cast("long"))
    return jobs.select("job_id", "frame_id", "cell_w", "cell_h", "mode", bg.alias("bg")).groupBy("frame_id", "cell_w", "cell_h", "mode", "bg").agg(F.count("*").alias("jobs"), F.min("job_id").alias("first_job"))


def job_status(ids: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """The latest status of each id, null if it has none; ties on the time go to the later event."""
    latest = lifecycle.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))
    return ids.join(latest, "job_id", "left")


def append_ops(ops: DataFrame, limit: int = 32) -> DataFrame:
    """Adds ``accepted``: operations beyond the limit of a pipeline are rejected."""
    order = Window.partitionBy("pipeline_id").orderBy("op_index")
    return ops.withColumn("accepted", F.row_number().over(order) <= limit)
