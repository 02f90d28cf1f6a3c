"""Device inventories: nested JSON dumps, one per machine, as flat device rows.

Dumps are parsed once into variants and unfolded level by level inside the JVM, each where it lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hoardlens import schemas
from hoardlens.functions import paths
from hoardlens.workspace import materialize

FIELDS = schemas.DEVICES.fieldNames()
NOTHING = ["null", "false", "0", '""', "{}"]  # what stands for no devices where a list is expected


LEVELS = 4  # of nesting that one pass unfolds; deeper dumps take further passes


SHAPE = f"struct<{', '.join(f'{f}: string' for f in FIELDS)}, children: array<variant>>"


def _text(plain: Column, device: Column, field: str) -> Column:
    """A field as text: '' where it is missing, null or false, other values as JSON."""
    json = F.to_json(F.variant_get(device, f"$.{field}", "variant"))
    # Only values that are no text, and the word false, have to be looked at again.
    other = F.when(json.isNull() | json.isin("null", "false"), F.lit("")).when(
        json == '"false"', F.lit("false")
    )
    return F.coalesce(F.nullif(plain, F.lit("false")), other.otherwise(json))


def _list(listed: Column, parent: Column, field: str) -> Column:
    """Devices listed in a field; NULL where it is something else, empty where there are none."""
    json = F.to_json(F.variant_get(parent, f"$.{field}", "variant"))
    none = F.when(json.isNull() | json.isin(NOTHING), F.expr("cast(array() as array<variant>)"))
    return F.coalesce(listed, none)


def _named(parent: Column, devices: Column) -> Column:
    return F.transform(devices, lambda d: F.struct(parent.alias("parent"), d.alias("device")))


def _read(item: Column) -> Column:
    """A device and its fields by name, NULL where it is no device at all."""
    shape = F.try_variant_get(item["device"], "$", SHAPE)
    return F.struct(item["parent"].alias("parent"), item["device"].alias("device"), shape.alias("shape"))


def _made(item: Column) -> Column:
    """Row of one device, its children and whether it is a device."""
    shape = item["shape"]
    texts = {f: _text(shape[f], item["device"], f) for f in FIELDS}
    above = F.when(item["parent"] != "", F.concat(item["parent"], F.lit("/"))).otherwise(F.lit(""))
    texts["name"] = F.concat(above, texts["name"])
    return F.struct(
        F.struct(*[texts[f].alias(f) for f in FIELDS]).alias("row"),
        _list(shape["children"], item["device"], "children").alias("children"),
        shape.isNotNull().alias("fits"),
    )


def _down(dumps: DataFrame, keep: list[str]) -> DataFrame:
    """One level further: devices in ``_open`` go to ``_rows``, their children to ``_open``."""
    level = dumps.withColumn("_made", F.transform(F.transform("_open", _read), _made))
    fault = F.when(F.exists("_made", lambda m: ~m["fits"]), F.lit("not a device")).when(
        F.exists("_made", lambda m: m["children"].isNull()), F.lit("children is not a list")
    )
    below = F.flatten(F.transform("_made", lambda m: _named(m["row"]["name"], m["children"])))
    return level.select(
        *keep,
        F.concat("_rows", F.transform("_made", lambda m: m["row"])).alias("_rows"),
        F.coalesce("_error", fault).alias("_error"),
        F.when(F.coalesce("_error", fault).isNull(), below).otherwise(F.slice("_open", 1, 0)).alias("_open"),
    )


def _unfold(dumps: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Dumps with ``_rows``, their devices, and ``_error``, the first fault found in them.

    All levels of a dump are unfolded where it lies, so nothing is shuffled or joined.
    """
    given = F.coalesce(F.col(text) != "", F.lit(False))
    parsed = dumps.where(given).select(*keep, F.try_parse_json(F.col(text)).alias("_dump"))
    listed = F.try_variant_get("_dump", "$.blockdevices", "array<variant>")
    is_object = F.try_variant_get("_dump", "$", "map<string,variant>").isNotNull()
    top = parsed.select(
        *keep, "_dump", _list(listed, F.col("_dump"), "blockdevices").alias("_devices"), is_object.alias("_fits")
    )
    fault = (
        F.when(F.col("_dump").isNull(), F.lit("not valid JSON"))
        .when(~F.col("_fits"), F.lit("not a JSON object"))
        .when(F.col("_devices").isNull(), F.lit("blockdevices is not a list"))
    )
    rows = F.array().cast(T.ArrayType(schemas.DEVICES))
    devices = F.when(fault.isNull(), F.col("_devices")).otherwise(F.expr("cast(array() as array<variant>)"))
    open_ = top.select(
        *keep, rows.alias("_rows"), fault.alias("_error"), _named(F.lit(""), devices).alias("_open")
    )
    done = None
    while True:
        for _ in range(LEVELS):
            open_ = _down(open_, keep)
        stored = materialize(open_, "devices")
        finished = stored.where(F.size("_open") == 0).drop("_open")
        done = finished if done is None else done.unionByName(finished)
        open_ = stored.where(F.size("_open") > 0)
        if open_.isEmpty():
            return done


def flatten_inventory(dumps: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row per device of every JSON dump in column ``text``; missing fields become ''.

    A dump that cannot be read, or holds something else where a device is expected, has no rows
    here; ``bad_dumps`` lists it with its fault.
    """
    whole = _unfold(dumps, text, keep).where(F.col("_error").isNull())
    return whole.select(*keep, F.explode("_rows").alias("_row")).select(*keep, "_row.*")


def bad_dumps(dumps: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The dumps that cannot be read, with the first ``error`` found in each."""
    faulty = _unfold(dumps, text, keep).where(F.col("_error").isNotNull())
    return faulty.select(*keep, F.col("_error").alias("error"))


def scan_plan(devices: DataFrame) -> DataFrame:
    """Where each device is scanned and what its manifest is called."""
    return devices.withColumn(
        "scan_root", paths.scan_root(F.col("mountpoint"), F.col("name"))
    ).withColumn("manifest_name", paths.manifest_name(F.col("uuid"), F.col("name")))
