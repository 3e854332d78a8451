"""Schemas of the catalogue's records as Spark DDL."""

from __future__ import annotations

TECHNOLOGY = (
    "id string, title string, summary string, sector string, language string, keywords array<string>, country string, source_id string, source_name string, url string, fetched_at timestamp, "
    "org_name string, transfer_type string, dev_status string, reg_date string, sub_sector string, record_type string, reference_id string, patent_type string, priority_date string, "
    "source_sector string, sector_codes array<string>, sector_labels array<string>, taxonomy_scheme string, taxonomy_version string, classification_method string, classification_confidence string"
)
SOURCE = "id string, name string, country string, institution string, status string, url string, ttl_seconds bigint, transfer_type string, sector_filter_supported boolean, multi_country boolean, access_method string, last_indexed string"
SNAPSHOT = (
    "id string, tech_id string, title string, summary string, sector string, sector_code string, sector_codes array<string>, classification_method string, classification_confidence string, keywords array<string>, "
    "institute string, trl string, url string, patent_no string, programme string, title_original string, summary_original string, title_translation_status string, summary_translation_status string, sector_reason string"
)
#: A record of a node-based REST API: every field is an array of values or references.
_V = "array<struct<value:string>>"
NODE = f"nid {_V}, status {_V}, langcode {_V}, title {_V}, created {_V}, path array<struct<alias:string>>, body {_V}, description {_V}, applications {_V}, benefits {_V}, cooperation {_V}, countries array<struct<target_id:string>>, sectors array<struct<target_id:string>>, keywords {_V}, organization {_V}, readiness {_V}"
#: An item of an XML feed of technologies.
ITEM = "stechNum string, techName string, tcateCodep string, tcateCodem string, tcateNamep string, tcateNamem string, summary string, keyword string, appFld string, orgName string, transType string, devStatusName string, regDate string"
#: A hit of a patent search API.
HIT = "identifier string, auApplicationNumber string, inventionTitle string, patentType string, filingDate string, earliestPriorityDate string, applicationStatus string, applicants string"
