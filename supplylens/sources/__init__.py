"""Readers for delimited text, preamble CSVs, JSON envelopes, XML items,
GeoJSON features, page elements, catalog picks and the catalog itself."""

from supplylens.sources.readers import (
    extract_elements, flatten_feature_text, flatten_features, json_records_from_text, list_tables, page_tables, pick_resource, preamble_headers,
    read_coded_records, read_delimited, read_first, read_json_records, read_preamble_csv,
    read_tagged, read_tagged_files, read_xml_items, reference_tables, table, table_exists,
)

__all__ = [
    "extract_elements", "flatten_feature_text", "flatten_features", "json_records_from_text", "list_tables", "page_tables", "pick_resource",
    "preamble_headers",
    "read_coded_records", "read_delimited", "read_first", "read_json_records",
    "read_preamble_csv", "read_tagged", "read_tagged_files", "read_xml_items", "reference_tables", "table", "table_exists",
]
