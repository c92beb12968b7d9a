"""Failure classes as a small table, so failure rows can be rolled up to any ancestor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Error class -> the class it belongs to. The root belongs to none.
ROOT = "DocumentError"
GROUPS = {
    "OCRException": ["DetectionException", "RecognitionException", "PreprocessingException",
                     "ModelLoadException", "InferenceException"],
    "DocumentException": ["DocumentLoadException", "DocumentRenderException",
                          "DocumentConversionException", "InvalidDocumentException",
                          "CorruptedDocumentException"],
    "StorageException": ["FileNotFoundException", "InsufficientStorageException", "DatabaseException"],
    "SecurityException": ["ValidationException", "FileSizeException", "UnsupportedFormatException",
                          "MalwareDetectedException", "RateLimitException"],
    "APIException": ["BadRequestException", "NotFoundException", "ServerException"],
    "ProcessingException": ["LayoutAnalysisException", "TableExtractionException",
                            "KeyValueExtractionException", "ExportException"],
    "ConfigurationException": ["InvalidConfigException"],
}


def ancestor_pairs() -> list[tuple[str, str, int]]:
    """(class, ancestor, distance) for every class and each of its ancestors, itself included."""
    pairs = [(ROOT, ROOT, 0)]
    for group, members in GROUPS.items():
        pairs += [(group, group, 0), (group, ROOT, 1)]
        for member in members:
            pairs += [(member, member, 0), (member, group, 1), (member, ROOT, 2)]
    return pairs


def error_taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ancestor_pairs(), "error_class string, ancestor string, distance int")


class ExportError(ValueError):
    """An export was asked for that no writer can do."""
