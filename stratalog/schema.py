"""Schemas of the engine's tables; order of fields is the order of report columns."""

from __future__ import annotations

from .fixed import COVERAGE_COLUMNS, FILE_FINDING_COLUMNS, HIT_COLUMNS, RULE_FINDING_COLUMNS  # noqa: F401

#: Artifacts as sources give them: ``policy`` rows have no content and carry their own status.
#: Of archives only the head is kept as content; ``size`` is that of the file, null where it is that of the content.
ARTIFACT_SCHEMA = (
    "artifact_ord string, artifact_path string, original_input_path string, extracted_from string, content binary, is_zip boolean, is_tar boolean, is_json boolean, "
    "marker_text string, utf16_text string, utf16_error string, policy struct<family:string,identified_by:string,review_mode:string,status:string,limitations:string>, "
    "decoder struct<used:string,status:string,limitations:string,fallback:boolean>, archive_limitations array<string>, size long"
)
