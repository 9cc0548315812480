"""Metadata documents: JSON versions 0 and 1, PSV, and the reader of either JSON."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from factloom.plans.features import Metadata, MetadataSet
from factloom.ranges import MinMaxRange


def _text(v: Any) -> str | None:
    if v is None or isinstance(v, str):
        return v
    return str(v).lower() if isinstance(v, bool) else str(v)


def _range(m: Metadata) -> dict[str, Any]:
    r = m.value_range
    if r is None:
        return {}
    if isinstance(r, MinMaxRange):
        return {"range": {"min": _text(r.min), "max": _text(r.max)}}
    return {"range": [_text(v) for v in r.values]}


def _feature(m: Metadata, source: str) -> dict[str, Any]:
    own = {"namespace": m.namespace, "name": m.name, "description": m.description, source: m.source_type}
    return own | {"typesConform": m.types_conform, "valueType": m.value_type.json_name, "featureType": m.feature_type.json_name} | _range(m)


class MetadataWriter:
    version: int

    @staticmethod
    def output(sets: Sequence[MetadataSet]) -> Any:
        raise NotImplementedError

    @staticmethod
    def stringify(document: Any) -> str:
        return json.dumps(document, indent=2, ensure_ascii=False)


class Json0(MetadataWriter):
    """A flat list of features."""

    version = 0

    @staticmethod
    def output(sets: Sequence[MetadataSet]) -> list:
        return [_feature(m, "source") for s in sets for m in s.metadata]


class Json1(MetadataWriter):
    """Features by set, under a version number."""

    version = 1

    @staticmethod
    def output(sets: Sequence[MetadataSet]) -> dict:
        return {"version": 1, "featureSets": [{"featureSet": s.name, "features": [_feature(m, "sourceType") for m in s.metadata]} for s in sets]}


class Psv(MetadataWriter):
    """``namespace.name|valuetype|featuretype`` per line, in lower case."""

    version = 0

    @staticmethod
    def output(sets: Sequence[MetadataSet]) -> str:
        return "\n".join(f"{m.namespace}.{m.name}|{m.value_type.psv_name}|{m.feature_type.psv_name}".lower() for s in sets for m in s.metadata)

    @staticmethod
    def stringify(document: str) -> str:
        return document


@dataclass(frozen=True)
class Document:
    version: int
    sets: tuple[tuple[str | None, tuple[dict, ...]], ...]

    def write(self) -> Any:
        if self.version == 0:
            return [f for _, features in self.sets for f in features]
        return {"version": self.version, "featureSets": [{"featureSet": name, "features": list(features)} for name, features in self.sets]}


_FIELDS = ("namespace", "name", "description", "typesConform", "valueType", "featureType")


def _read_feature(x: Any, source: str) -> dict | None:
    if not isinstance(x, dict) or any(k not in x for k in (*_FIELDS, source)):
        return None
    r = x.get("range")
    if r is not None and not isinstance(r, (list, dict)):
        return None
    order = ("namespace", "name", "description", source, "typesConform", "valueType", "featureType")
    return {k: x[k] for k in order} | ({"range": r} if r is not None else {})


def read(text: str) -> Document:
    """Parses either version; raises on any other. Features that don't parse are left out."""
    x = json.loads(text)
    if isinstance(x, list):
        return Document(0, ((None, tuple(f for y in x if (f := _read_feature(y, "source")))),))
    if isinstance(x, dict) and x.get("version") == 1:
        sets = tuple((s["featureSet"], tuple(f for y in s["features"] if (f := _read_feature(y, "sourceType")))) for s in x.get("featureSets", []))
        return Document(1, sets)
    raise ValueError(f"unknown metadata version {x.get('version') if isinstance(x, dict) else type(x).__name__}")
