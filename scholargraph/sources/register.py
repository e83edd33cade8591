"""The structure register (a JSON array file) and its statements."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholargraph import schemas
from scholargraph.functions.text import strip_ws
from scholargraph.session import spread

KEY = "numero_national_de_structure"

# Register field -> (property, value type).
FIELD_MAP = [
    ("sigle", "foaf:surname", "literal"),
    ("annee_de_creation", "dcterms:created", "literal"),
    ("site_web", "foaf:workplaceHomepage", "uri"),
    ("adresse", "schema:address", "literal"),
    ("code_postal", "schema:postalCode", "literal"),
    ("commune", "schema:addressLocality", "literal"),
]


def read_register(spark: SparkSession, path: str) -> DataFrame:
    """Read a JSON array file; ``pos`` keeps file order (one file is one split)."""
    df = spark.read.schema(schemas.REGISTER).option("multiLine", True).json(path)
    df = df.withColumn(
        "pos",
        F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row")),
    )
    # a JSON array file is read whole by one task; spread it before the work
    return spread(df)


def scan_register(register: DataFrame, key: str = KEY, pos: str = "pos") -> DataFrame:
    """Drop null/empty keys; the last record of a key wins.

    ``max_by(struct(*), pos)`` is a partial aggregate: a key repeated
    many times is combined map-side before the shuffle on the key.
    """
    r = register.where(F.col(key).isNotNull() & (F.col(key) != ""))
    cols = [c for c in r.columns if c != key]
    return r.groupBy(key).agg(F.max_by(F.struct(*cols), pos).alias("_r")).select(key, "_r.*")


def register_statements(register: DataFrame, key: str = KEY) -> DataFrame:
    """The six register fields as typed statements ``(key, property, type, value)``.

    Null, empty and array-valued fields are skipped; values are trimmed
    and skipped if nothing is left.
    """
    pairs = F.array(
        *[
            F.struct(F.lit(p).alias("property"), F.lit(t).alias("type"), F.col(f).cast("string").alias("raw"))
            for f, p, t in FIELD_MAP
        ]
    )
    long = register.select(key, F.inline(pairs))
    raw = F.col("raw")
    is_array = strip_ws(raw).startswith("[") & F.try_parse_json(raw).isNotNull()
    return long.where(raw.isNotNull() & (raw != "") & ~is_array).select(
        key, "property", "type", strip_ws(raw).alias("value")
    ).where(F.col("value") != "")
