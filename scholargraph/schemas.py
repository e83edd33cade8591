"""Input schemas (Spark DDL) of the person dump, registry documents and register."""
from __future__ import annotations

from pyspark.sql import types as T

LABEL = "STRUCT<`default`: STRING>"
DOMAIN = f"STRUCT<label: {LABEL}, code: STRING, type: STRING, count: BIGINT>"
EXTERNAL_ID = "STRUCT<type: STRING, id: STRING, url: STRING>"
CO_CONTRIBUTOR = "STRUCT<person: STRING, fullname: STRING>"
AFFILIATION = (
    f"STRUCT<structure: STRUCT<id: STRING, label: {LABEL}, kind: ARRAY<STRING>>, "
    "publicationsCount: BIGINT, startDate: STRING, endDate: STRING>"
)
PUBLICATION = f"STRUCT<publication: STRING, title: {LABEL}, role: STRING, year: STRING>"

PERSON_FIELDS = (
    "id: STRING, firstName: STRING, lastName: STRING, fullName: STRING, "
    f"domains: ARRAY<{DOMAIN}>, topDomains: ARRAY<{DOMAIN}>, top_domains: ARRAY<{DOMAIN}>, "
    f"externalIds: ARRAY<{EXTERNAL_ID}>, coContributors: ARRAY<{CO_CONTRIBUTOR}>, "
    f"affiliations: ARRAY<{AFFILIATION}>, publications: ARRAY<{PUBLICATION}>, "
    "publicationsCount: BIGINT, awards: STRING"
)
# DDL strings: from_json and the readers take them as schemas directly.
PERSON = f"STRUCT<{PERSON_FIELDS}>"

# A person, possibly wrapped in a search-engine envelope.
PERSON_OR_ENVELOPE = f"STRUCT<{PERSON_FIELDS}, _source: {PERSON}, _score: DOUBLE>"

REGISTRY_PERSON = (
    "STRUCT<name: STRUCT<`given-names`: STRUCT<value: STRING>, `family-name`: STRUCT<value: STRING>>, "
    "`external-identifiers`: STRUCT<`external-identifier`: ARRAY<STRUCT<`external-id-type`: STRING, "
    "`external-id-value`: STRING, `external-id-url`: STRUCT<value: STRING>>>>, "
    "keywords: STRUCT<keyword: ARRAY<STRUCT<content: STRING>>>>"
)

REGISTER_FIELDS = [
    "numero_national_de_structure", "libelle", "sigle", "annee_de_creation",
    "site_web", "adresse", "code_postal", "commune",
]
REGISTER = T.StructType([T.StructField(f, T.StringType()) for f in REGISTER_FIELDS])

# Graph tables.
ITEMS = (
    "item_id BIGINT, class STRING, template STRING, title STRING, owner_id BIGINT, "
    "owner_name STRING, created TIMESTAMP, modified TIMESTAMP"
)
STATEMENTS = (
    "value_id BIGINT, item_id BIGINT, property STRING, type STRING, value STRING, uri STRING, "
    "label STRING, lang STRING, target_id BIGINT"
)
