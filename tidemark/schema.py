"""Schemas of observations, signals and events; absent values are null."""

from __future__ import annotations

CHANGE = "struct<type: string, version: string, summary: string>"
LOG = "struct<raw: string, message: string, level: string, template_id: string, template: string, parameters: array<string>>"
METRIC = "struct<name: string, value: double, labels: map<string, string>>"

OBSERVATION = (
    "id string, source string, service string, environment string, modality string, timestamp timestamp, ingested_at timestamp, "
    f"attributes map<string, string>, log {LOG}, metric {METRIC}, change {CHANGE}"
)
SIGNAL = "kind string, modality string, source string, timestamp timestamp, score double, summary string, attributes map<string, string>"
RELATED_CHANGE = f"struct<source: string, change: {CHANGE}, timestamp: timestamp, offset_seconds: double>"
EVENT = (
    "id string, kind string, source string, service string, environment string, timestamp timestamp, severity string, confidence double, "
    f"summary string, signals array<struct<{SIGNAL.replace(' string', ': string').replace(' timestamp', ': timestamp').replace(' double', ': double').replace(' map', ': map')}>>, "
    f"related_changes array<{RELATED_CHANGE}>, attributes map<string, string>"
)
