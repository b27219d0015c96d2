"""Schemas of the streams that agent runtimes emit and of the graph that is built from them."""

from pyspark.sql import types as T

_S, _L, _B = T.StringType(), T.LongType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: One host event a line; payloads stay open.
EVENT = _struct(
    atof_version=_S, kind=_S, category=_S, scope_category=_S, name=_S, uuid=_S, parent_uuid=_S, timestamp=_S,
    attributes=T.ArrayType(_S), data=T.VariantType(), data_schema=T.VariantType(), category_profile=T.VariantType(), metadata=T.VariantType(),
)
#: One framework callback a line.
CALLBACK = _struct(callback=_S, run_id=_S, parent_run_id=_S, name=_S, tags=T.ArrayType(_S), metadata=T.MapType(_S, _S), error_mro=T.ArrayType(_S), payload=T.VariantType(), seq=_L)
HUNK = _struct(old=_S, new=_S)
OBSERVATION = _struct(path=_S, content=_S, mode=_S, user_modified=_B, hunks=T.ArrayType(HUNK), replace_all=_B, line_oriented=_B, replay_from=_S)
"""What one tool result or patch block says about one file."""
