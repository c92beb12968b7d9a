"""Options with defaults, and a dict round trip. Plain values on the driver, not tables."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields
from typing import Any

#: File types, export formats and languages by name.
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".tiff", ".bmp", ".webp")
PDF_EXTENSIONS = (".pdf",)
SUPPORTED_EXTENSIONS = PDF_EXTENSIONS + IMAGE_EXTENSIONS
EXPORT_FORMATS = ("txt", "json", "csv", "docx", "pdf", "searchable_pdf")
SUPPORTED_LANGUAGES = ("en", "es", "fr", "de", "zh", "ja", "ko", "ar")
DEFAULT_LANGUAGE = "en"


# The defaults of the sections below. Every option is read by an operator that ``Engine`` calls.
@dataclass(frozen=True)
class OcrConfig:
    batch_size: int = 8
    recognition_threshold: float = 0.5
    max_image_dimension: int = 2048

    def __post_init__(self):
        if self.batch_size < 1:
            raise ValueError(f"batch_size must be at least 1: {self.batch_size}")


@dataclass(frozen=True)
class DocumentConfig:
    max_file_size_mb: int = 100
    dpi_for_pdf_render: int = 300
    enable_table_detection: bool = True
    enable_kv_extraction: bool = True


@dataclass(frozen=True)
class SecurityConfig:
    validate_file_types: bool = True
    allowed_extensions: tuple[str, ...] = SUPPORTED_EXTENSIONS
    rate_limit_per_minute: int = 60


@dataclass(frozen=True)
class Config:
    ocr: OcrConfig = field(default_factory=OcrConfig)
    document: DocumentConfig = field(default_factory=DocumentConfig)
    security: SecurityConfig = field(default_factory=SecurityConfig)

    @classmethod
    def from_dict(cls, values: dict[str, Any]) -> "Config":
        """Absent sections and keys keep their defaults; unknown sections and keys are errors."""
        unknown = sorted(set(values) - {f.name for f in fields(cls)})
        if unknown:
            raise TypeError(f"unknown configuration: {', '.join(unknown)}")
        made = {}
        for f in fields(cls):
            if f.name not in values:
                continue
            given = values[f.name]
            made[f.name] = f.default_factory(**given) if isinstance(given, dict) else given
        return cls(**made)

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)
