"""Listing schema, column roles and the fixed names of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

# --- fixed values: column names of the listing data model -------------------
KEY = "sku"
SEGMENT = "colonia"
TARGET = "price"
CODE = "endocer_colonia"

CATEGORY_COLUMNS = ["tipo_inmueble", "sub_category", "tipo_oferta", "colonia", "estado", "ciudad"]
COUNT_COLUMNS = ["habitaciones", "banos", "autos"]
DROPPED_COLUMNS = ["divisa", "total_habitaciones", "link", "link_img", "agent"]
OUTLIER_COLUMNS = ["price", "m2_const", "m2_terreno", "habitaciones", "banos", "autos"]
HOUSE_FEATURES = ["m2_const", "m2_terreno", "habitaciones", "banos", "autos", "endocer_colonia"]
APARTMENT_FEATURES = ["m2_const", "habitaciones", "banos", "autos", "endocer_colonia"]

HOUSE = "Casa"
APARTMENT = "Departamento"
SALE = "Venta"
RENT = "Renta"
# ----------------------------------------------------------------------------

_S, _D = T.StringType(), T.DoubleType()

LISTING_SCHEMA = T.StructType(
    [
        T.StructField("sku", _S),
        T.StructField("tipo_inmueble", _S),
        T.StructField("tipo_oferta", _S),
        T.StructField("sub_category", _S),
        T.StructField("colonia", _S),
        T.StructField("ciudad", _S),
        T.StructField("estado", _S),
        T.StructField("price", _D),
        T.StructField("m2_terreno", _D),
        T.StructField("m2_const", _D),
        T.StructField("habitaciones", _D),
        T.StructField("banos", _D),
        T.StructField("autos", _D),
        T.StructField("total_habitaciones", _D),
        T.StructField("antiguedad", _D),
        T.StructField("link", _S),
        T.StructField("link_img", _S),
        T.StructField("agent", _S),
        T.StructField("divisa", _S),
        T.StructField("fecha_pub", _S),
        T.StructField("descripcion", _S),
        T.StructField("amenidades", T.ArrayType(_S)),
        T.StructField("lat", _D),
        T.StructField("lng", _D),
    ]
)

RESULT_SCHEMA = T.StructType(
    [
        T.StructField("colonia", _S),
        T.StructField("score", _D),
        T.StructField("error", _D),
        T.StructField("diff_score", _D),
        T.StructField("Good", T.BooleanType()),
    ]
)

_ROLE = "role"
_CATEGORY = "category"


def as_category(name: str):
    """A STRING column whose field metadata marks it as a category."""
    return F.col(name).cast("string").alias(name, metadata={_ROLE: _CATEGORY})


def require_columns(df: DataFrame, columns) -> list[str]:
    """Return ``columns`` as a list, raising KeyError for names ``df`` does not have."""
    columns = list(columns)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"columns not in the table: {missing}; it has {df.columns}")
    return columns


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def category_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.metadata.get(_ROLE) == _CATEGORY]


def column_role(field: T.StructField) -> str:
    if field.metadata.get(_ROLE) == _CATEGORY:
        return _CATEGORY
    return "numeric" if isinstance(field.dataType, T.NumericType) else "other"
