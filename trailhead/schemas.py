"""Columns each input table must have, and the check that it has them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_TYPES = {"string": T.StringType, "int": T.IntegerType, "long": T.LongType, "date": T.DateType}


def _struct(spec: str) -> T.StructType:
    fields = (part.split(":") for part in spec.split())
    return T.StructType([T.StructField(name, _TYPES[kind]()) for name, kind in fields])


INPUTS = {
    "hits": _struct(
        "destination:string dt:string cookie_id:string visit_id:string event_position:long container:string "
        "attribute:string placement:string result:string is_click:int is_impression:int"
    ),
    "activity": _struct("destination:string dt:string visit_id:string app_type:string"),
    "visits": _struct("destination:string dt:string cookie_id:string visit_id:string audience_id:string"),
    "url_events": _struct(
        "destination:string dt:string cookie_id:string visit_id:string event_position:long url:string"
    ),
    "profile": _struct("hid:string age:int"),
    "weekly_frequency": _struct("hid:string frequency_band:string date_of_segmentation:date"),
    "catalogue": _struct(
        "master_brand_name:string master_brand_id:string brand_title:string brand_id:string series_title:string "
        "series_id:string episode_id:string episode_title:string genre:string"
    ),
    "arm_assignments": _struct("hid:string exp_group:string"),
    "frequency_groups": _struct("frequency_band:string frequency_group:string valid_from:date valid_to:date"),
    "page_journeys": _struct(
        "destination:string app_type:string dt:string visit_id:string hid:string page_name_sequence:string "
        "page_sequence:string content_id_sequence:string"
    ),
    "content_outcomes": _struct(
        "dt:string visit_id:string content_id:string page_count:int start_flag:string watched_flag:string"
    ),
}


def assert_schema(df: DataFrame, table: str) -> DataFrame:
    """Return `df` narrowed to the declared columns; raise if one is missing or of another type."""
    actual = {f.name: f.dataType for f in df.schema.fields}
    wrong = [
        f"{f.name}: expected {f.dataType.simpleString()}, "
        f"got {actual[f.name].simpleString() if f.name in actual else 'nothing'}"
        for f in INPUTS[table].fields
        if actual.get(f.name) != f.dataType
    ]
    if wrong:
        raise ValueError(f"{table}: " + "; ".join(wrong))
    return df.select(*INPUTS[table].fieldNames())
