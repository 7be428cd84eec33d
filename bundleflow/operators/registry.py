"""Registry sheet to typed records: header mapping at plan time, one narrow select at run time."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cleaning as C
from ..schemas import FIELDS_NORM, REGISTRY_DATA

# --- Fixed values: header spellings accepted for each registry column -----------------
HEADER_SPELLINGS = {
    "app_no": ("app_no", "appno", "application_no", "application_number"),
    "app_date": ("app_date", "appdate", "application_date"),
    "registration_no": ("registration_no", "registrationno", "regno", "reg_no"),
    "registration_date": ("registration_date", "registrationdate", "reg_date"),
    "f_name": ("f_name", "fname", "first_name", "firstname"),
    "m_name": ("m_name", "mname", "middle_name", "middlename"),
    "l_name": ("l_name", "lname", "last_name", "lastname", "surname"),
    "f_name_change": ("f_name_change", "fname_change", "fnamechange", "first_name_change"),
    "m_name_change": ("m_name_change", "mname_change", "mnamechange", "middle_name_change"),
    "l_name_change": ("l_name_change", "lname_change", "lnamechange", "last_name_change"),
    "gender": ("gender", "sex"),
    "date_of_birth": ("date_of_birth", "dateofbirth", "dob", "birth_date", "birthdate"),
    "place_of_birth": ("place_of_birth", "placeofbirth", "pob"),
    "nationality": ("nationality",),
    "qualification": ("qualification", "qual"),
    "exam_month": ("exam_month", "exammonth"),
    "exam_year": ("exam_year", "examyear"),
    "roll_no": ("roll_no", "rollno"),
    "university": ("university",),
    "college": ("college",),
    "address": ("address",),
    "district": ("district", "distrinct"),
    "taluka": ("taluka",),
    "pin_no": ("pin_no", "pinno", "pincode", "pin"),
    "prof_add": ("prof_add", "profadd", "professional_address", "prof_address"),
    "prof_district": ("prof_district", "profdistrict"),
    "prof_taluka": ("prof_taluka", "proftaluka"),
    "prof_pin_no": ("prof_pin_no", "profpinno", "prof_pincode", "prof_pin"),
    "mobile_no": ("mobile_no", "mobile", "mobileno"),
    "telephone_no": ("telephone_no", "telephoneno", "telephone", "tel_no"),
    "prof_telephone_no": ("prof_telephone_no", "prof_telephoneno", "prof_telephone", "prof_tel"),
    "email_id": ("email_id", "emailid", "email"),
    "cr_dt": ("cr_dt", "created_date"),
    "status": ("status",),
    "valid_upto_date": ("valid_upto_date", "validupto_date", "valid_upto"),
    "doctor_status": ("doctor_status", "doctorstatus"),
}
MISSPELT, CORRECT = "distrinct", "district"
DATE_TEXT_COLUMNS = ("app_date", "registration_date", "date_of_birth", "valid_upto_date")
# -------------------------------------------------------------------------------------

KEY = "registration_no"
_TARGET_OF = {spelling: target for target, spellings in HEADER_SPELLINGS.items() for spelling in spellings}


class HeaderPlan(NamedTuple):
    source_of: dict[str, str]  # target column -> sheet column
    unmapped: tuple[str, ...]  # sheet columns nobody asked for


def plan_headers(columns: Sequence[str]) -> HeaderPlan:
    """Resolve sheet headers.

    The misspelt district is ignored when the correct one is present.  Of several columns for
    one target the last wins outright, even where its cells are null.
    """
    normal = [(c, C.norm_header_name(c)) for c in columns]
    present = {n for _, n in normal}
    if {MISSPELT, CORRECT} <= present:
        normal = [(c, n) for c, n in normal if n != MISSPELT]
    source_of, unmapped = {}, []
    for column, name in normal:
        target = _TARGET_OF.get(name)
        if target is None:
            unmapped.append(column)
        else:
            source_of[target] = column
    if KEY not in source_of:
        raise ValueError(f"no column maps to {KEY}; headers seen: {list(columns)}")
    return HeaderPlan(source_of, tuple(unmapped))


def map_aliases(df: DataFrame, order: str | None = None) -> DataFrame:
    """All 36 registry columns as strings, absent ones null; ``order`` is carried along."""
    plan = plan_headers([c for c in df.columns if c != order])
    return df.select(
        *[
            (F.col(f"`{plan.source_of[t]}`").cast("string") if t in plan.source_of else F.lit(None).cast("string")).alias(t)
            for t in REGISTRY_DATA.fieldNames()
        ],
        *([] if order is None else [order]),
    )


def _clean_cell(field: T.StructField, cell: Column) -> Column:
    if field.name in DATE_TEXT_COLUMNS:
        return C.parse_date_text(cell)
    if isinstance(field.dataType, T.TimestampType):
        return C.parse_timestamp(cell)
    if isinstance(field.dataType, T.LongType):
        return C.to_int8(cell)
    if isinstance(field.dataType, T.IntegerType):
        return C.to_int4(cell)
    if isinstance(field.dataType, T.FloatType):
        return C.to_float(cell)
    return C.strip_text(cell)


def fields_norm() -> Column:
    """Typed search record over cleaned columns; missing parts are '' and never null."""
    def text(name: str) -> Column:
        return C.lower_or_empty(F.col(name))

    values = {
        "registration_no": F.coalesce(F.col(KEY).cast("string"), F.lit("")),
        "full_name": C.full_name(F.col("f_name"), F.col("m_name"), F.col("l_name")),
        "name_change": C.full_name(F.col("f_name_change"), F.col("m_name_change"), F.col("l_name_change")),
        "dob": text("date_of_birth"),
        "qualification": text("qualification"),
        "college": text("college"),
        "university": text("university"),
        "district": text("district"),
    }
    return F.struct(*[values[n].alias(n) for n in FIELDS_NORM.fieldNames()])


def typed_registry(df: DataFrame, order: str | None = None) -> DataFrame:
    """Mapped and typed, rows without a key still present."""
    mapped = map_aliases(df, order)
    cells = [_clean_cell(f, F.col(f.name)).alias(f.name) for f in REGISTRY_DATA.fields]
    return mapped.select(*cells, *([] if order is None else [order]))


def drop_missing_key(df: DataFrame, key: str = KEY, observe: Observation | None = None) -> DataFrame:
    """Drops rows without a key; with ``observe`` the counts come for free with the next action."""
    if observe is not None:
        df = df.observe(
            observe, F.count_if(F.col(key).isNotNull()).alias("loaded"), F.count_if(F.col(key).isNull()).alias("skipped_no_key")
        )
    return df.filter(F.col(key).isNotNull())


def clean_registry(df: DataFrame, observe: Observation | None = None, order: str | None = None) -> DataFrame:
    """The whole load: 36 typed columns and ``fields_norm``.  No shuffle, no Python."""
    typed = drop_missing_key(typed_registry(df, order), observe=observe)
    return typed.withColumn("fields_norm", fields_norm())
