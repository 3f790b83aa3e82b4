"""Declared schemas; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


STRING, LONG, INT, DOUBLE, BOOL, BINARY = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.BinaryType()

#: Files of an image tree.
LISTING = _struct(path=STRING, length=LONG, category=STRING)
#: A training record without decoded images.
RECORD = _struct(row_id=LONG, path=STRING, problem=STRING, solution=STRING)
#: The JSON object that travels with a record as text.
METADATA = _struct(
    type=STRING,
    category=STRING,
    original_category=STRING,
    ood_split=STRING,
    difficulty=STRING,
    confidence_target=DOUBLE,
    pseudo_ood_score=DOUBLE,
    closest_id=STRING,
    max_similarity=DOUBLE,
    split=STRING,
)
#: COCO document.
COCO = _struct(
    images=T.ArrayType(_struct(id=LONG, file_name=STRING, width=LONG, height=LONG)),
    annotations=T.ArrayType(_struct(id=LONG, image_id=LONG, category_id=LONG, bbox=T.ArrayType(DOUBLE), area=DOUBLE, iscrowd=INT)),
    categories=T.ArrayType(_struct(id=LONG, name=STRING)),
)
#: One entry of a COCO result file.
PREDICTION = _struct(image_id=LONG, category_id=LONG, bbox=T.ArrayType(DOUBLE), score=DOUBLE)
#: Annotation of one image.
VOC = _struct(
    filename=STRING,
    size=_struct(width=STRING, height=STRING, depth=STRING),
    object=T.ArrayType(_struct(name=STRING, bndbox=_struct(xmin=STRING, ymin=STRING, xmax=STRING, ymax=STRING))),
)
#: Box of a detection answer.
ANSWER_BOXES = T.ArrayType(_struct(Position=T.ArrayType(INT), Confidence=DOUBLE))
#: Distances keyed by row number.
DISTANCES = T.MapType(STRING, _struct(distance=DOUBLE, nearest_id=STRING, true_category=STRING, error=STRING))
#: Evaluation manifest: path -> label id.
MANIFEST = T.MapType(STRING, LONG)
#: Array of records in one JSON file.
RECORD_JSON = _struct(image=STRING, problem=STRING, solution=STRING, metadata=STRING)
