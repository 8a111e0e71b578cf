"""Table schemas."""

from pyspark.sql import types as T

_text = T.ArrayType(T.StringType())

CSS_RULE = T.StructType(
    [
        T.StructField("selector", T.StringType()),
        T.StructField("classes", _text),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
        T.StructField("media_query", T.StringType()),
    ]
)

CHUNKS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("scope", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("class_name", T.StringType()),
        T.StructField("method_name", T.StringType()),
        T.StructField("imports", _text),
        T.StructField("dependencies", _text),
        T.StructField("tags", _text),
        T.StructField("title", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("models", _text),
        T.StructField("directives", _text),
        T.StructField("lines_code", T.IntegerType()),
        T.StructField("css_rules", T.ArrayType(CSS_RULE)),
    ]
)

RELATIONSHIPS = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "source_file", "target_symbol", "relationship_type")])
FILE_STATE = T.StructType([T.StructField("rel_path", T.StringType()), T.StructField("sha256", T.StringType()), T.StructField("mtime", T.TimestampType()), T.StructField("size", T.LongType())])
