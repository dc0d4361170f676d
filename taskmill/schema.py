"""Explicit record schemas; ids and labels are strings and are never inferred."""

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


INSTRUCTION = _strings(
    "id", "original_id", "input", "output", "dataset", "task", "lang", "instruction"
)
TRAINING = T.StructType(
    INSTRUCTION.fields + _strings("native_instruction", "output_en").fields
)
RESULT = T.StructType(INSTRUCTION.fields + _strings("response").fields)
PREPARED = T.StructType(TRAINING.fields + _strings("text").fields)

MESSAGES = T.ArrayType(_strings("role", "content"))

RECORD_KEY = ["lang", "dataset", "id"]
DATASET_KEY = ["lang", "dataset"]
