"""Schemas of the frames that the verification plan reads and makes. Null is absent; the empty text is a value."""

from __future__ import annotations

SOURCES = "source_id string, label string, url string, type string, part_of string, language string, title string, date string, license string, isbn string, doi string, publisher string, edition string"
FRAGMENTS = "urn string, source_id string, label string, snippet string, selector string, section string, lines string, location string, page_start string, page_end string"
TERMS = "urn string, label string, url string, type string, location string, lines string, section string, selector string, snippet string"
CITE_SITES = "urn string, file string, line int"
DOCUMENTS = "url string, body string"
FETCHES = "url string, final_url string, chain array<struct<status:int,url:string>>"
REPO_FILES = "repo string, key string, name string, title string, number int, body string"
CRAWLS = "repo string, key string, status string, reason string"
SUPERSESSIONS = "repo string, key string, status string, superseded_by array<string>, reason string"
TRIPLES = "s string, p string, o string, o_kind string, datatype string, lang string"
HINT = "struct<source_text:string,ratio:double,kind:string,missing:array<string>,extra:array<string>,where:string,percent:int>"
FINDINGS = f"check string, severity string, source string, label string, url string, urn string, reason string, hint {HINT}, cited_by array<struct<file:string,line:int>>, ord long"
CHECKS = "name string, status string, ok long, total long, failures long, warnings long, structural boolean, ord int"
