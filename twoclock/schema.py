"""Fixed shapes of the claim log, and how a declared range becomes a Spark type."""

from pyspark.sql import types as T

_S, _TS, _L = T.StringType(), T.TimestampType(), T.LongType()


def _table(*fields):
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


INTENT = _table(
    ("id", _S, False), ("occurred_at", _TS, False), ("actor_id", _S, False),
    ("agent_id", _S, True), ("action_name", _S, False),
    ("reason_code", _S, True), ("note", _S, True),
)

ENTITY = _table(("id", _S, False), ("minted_at", _TS, False), ("intent_id", _S, False))

ASSERTION = _table(
    ("id", _S, False), ("seq", _L, False),
    ("subject_id", _S, False), ("predicate_id", _S, False),
    ("value_literal", _S, True), ("value_ref", _S, True),
    ("valid_from", _TS, False), ("recorded_at", _TS, False), ("revokes", _S, True),
    ("intent_id", _S, False), ("source", _S, False), ("confidence", _S, True),
    ("authority", _S, True), ("ontology_version", _S, False), ("subject_key_id", _S, True),
)

# The compact form: identities already written as their URIs, one text value.
CLAIM = _table(
    ("id", _S, False), ("seq", _L, False), ("subject", _S, False), ("slot", _S, False),
    ("value", _S, True), ("valid_from", _TS, False), ("recorded_at", _TS, False),
    ("revokes", _S, True),
)

# The closed vocabularies of the log.
CONFIDENCE = ["high", "medium", "low"]
SOURCES = [
    "human_stated", "human_confirmed", "document_extracted", "imported",
    "llm_inferred", "llm_recommended", "model_inferred", "system_derived",
]

# Column type per declared range. Anything else is text.
RANGE_TYPES = {
    "string": "string",
    "uri": "string",
    "uriorcurie": "string",
    "curie": "string",
    "ncname": "string",
    "time": "string",
    "date": "date",
    "datetime": "timestamp",
    "integer": "bigint",
    "decimal": "decimal(18,6)",
    "double": "double",
    "float": "double",
    "boolean": "boolean",
}


def range_type(range_):
    """Spark type of a declared range; class and enum ranges are names, so text."""
    return RANGE_TYPES.get(range_, "string")
