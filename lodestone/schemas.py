"""Fixed schemas of the index: nothing is inferred, unknown fields are errors."""

from pyspark.sql import types as T

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(*required, **optional) -> T.StructType:
    return T.StructType([T.StructField(n, t, False) for n, t in required] + [T.StructField(n, t, True) for n, t in optional.items()])


LOCATION = _struct(("kind", _S), ("file", _S), ("start_line", _I), ("start_column", _I), ("end_line", _I), ("end_column", _I))
SYMBOL = _struct(
    ("stable_usr", _S), ("qualified_name", _S), ("name", _S), ("display_name", _S), ("kind", _S), ("type_spelling", _S), ("result_type", _S),
    ("locations", T.ArrayType(LOCATION, False)), owner_usr=_S, documentation=_S,
)
SYMBOL_EDGE = _struct(("edge_type", _S), ("src_usr", _S), ("dst_usr", _S), ("confidence", _D), file=_S, line=_I, column=_I)
FILE_EDGE = _struct(("edge_type", _S), ("src_file", _S), ("dst_file", _S), ("line", _I), ("column", _I))
CHUNK = _struct(
    ("stable_key", _S), ("content_hash", _S), ("file", _S), ("chunk_kind", _S), ("text", _S), ("token_count", _I), ("part_index", _I), ("part_count", _I),
    symbol_usr=_S, start_line=_I, start_column=_I, end_line=_I, end_column=_I,
)
EMBEDDING = _struct(("content_hash", _S), ("provider", _S), ("model", _S), ("dimensions", _I), ("embedding", T.ArrayType(T.FloatType(), False)))
FILE = _struct(("file_id", _S), ("repository_id", _S), ("path", _S), ("language", _S), ("content_hash", _S), ("line_count", _I))
GENERATION = _struct(
    ("id", _S), ("project_id", _S), ("status", _S), ("publication_version", _L), ("created_at", T.TimestampType()), ("updated_at", T.TimestampType()),
    published_at=T.TimestampType(), validated_at=T.TimestampType(), gc_claim_hash=_S, counts=T.MapType(_S, _L),
)
ACL = _struct(("repository_id", _S), ("path_prefix", _S))
CANDIDATE = _struct(("source", _S), ("chunk_key", _S), ("file_key", _S), ("score", _D), symbol_key=_S)
JOB_EVENT = _struct(("job_id", _S), ("attempt", _I), ("lease_token", _S), ("sequence", _L), ("level", _S), ("event_type", _S), fields=_S)
#: One line of an extraction stream: a manifest, a symbol, a symbol edge or a file edge, told apart by ``type``.
EXTRACTION = _struct(
    ("type", _S), schema_version=_I, libclang=_S, diagnostic_count=_L, error_count=_L, kind=_S, usr=_S, name=_S, display_name=_S, qualified_name=_S,
    owner_usr=_S, is_definition=_B, file=_S, start_line=_I, start_column=_I, end_line=_I, end_column=_I, type_spelling=_S, result_type=_S,
    documentation=_S, edge_type=_S, src_usr=_S, dst_usr=_S, line=_I, column=_I, confidence=_D, src_file=_S, dst_file=_S,
)

#: The closed sets of the schema.
SYMBOL_EDGE_TYPES = ("calls", "references", "inherits", "overrides", "owns", "instantiates", "aliases")
EXTRACTED_EDGE_TYPES = ("calls", "references", "inherits", "overrides")
CHUNK_KINDS = ("declaration", "definition", "documentation", "file_context")
SOURCES = ("exact", "fts", "vector", "graph")
ROLES = ("none", "viewer", "operator", "maintainer", "admin")
