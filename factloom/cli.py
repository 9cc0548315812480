"""Command line: export the metadata of the feature sets in a package, or write a module of stubs
or of jobs.

    python -m factloom.cli metadata [--json | --psv] [--version 0|1] PACKAGE
    python -m factloom.cli bootstrap SOURCE_TYPE FILE [--separator CHAR]
    python -m factloom.cli jobs PACKAGE DATABASE PATH
"""

from __future__ import annotations

import argparse
import importlib
import inspect
import pkgutil
import re
import sys
from collections.abc import Iterable
from dataclasses import dataclass
from types import ModuleType

from factloom.metadata import Json0, Json1, Psv
from factloom.plans.features import AggregationFeatureSet, FeatureSet, MetadataSet
from factloom.types import FeatureType, ValueType


def modules(package: str) -> list[ModuleType]:
    root = importlib.import_module(package)
    found = [root]
    for m in pkgutil.walk_packages(getattr(root, "__path__", []), f"{package}."):
        found.append(importlib.import_module(m.name))
    return found


def find_sets(package: str) -> list[MetadataSet]:
    """One instance of every concrete metadata or feature set that the package's modules define."""
    found: dict[type, MetadataSet] = {}
    for m in modules(package):
        for x in [*vars(m).values()]:
            for c in [x, *[y for y in vars(x).values() if inspect.isclass(y)]] if inspect.isclass(x) else []:
                if issubclass(c, MetadataSet) and c.__module__ == m.__name__ and not c.__module__.startswith("factloom.plans"):
                    abstract = issubclass(c, (FeatureSet, AggregationFeatureSet)) and not hasattr(c, "source")
                    if not abstract:
                        found.setdefault(c, c())
    return sorted(found.values(), key=lambda s: s.name)


# The combinations the stub format allows, and what each declares.
STUB_KINDS = {
    "double continuous": (ValueType.DECIMAL, FeatureType.CONTINUOUS),
    "int continuous": (ValueType.INTEGRAL, FeatureType.DISCRETE),
    "int categorical": (ValueType.INTEGRAL, FeatureType.ORDINAL),
    "string categorical": (ValueType.STR, FeatureType.NOMINAL),
}


@dataclass(frozen=True)
class Stub:
    """One declared feature: a line ``namespace.name|type|kind[|description]``."""

    namespace: str
    name: str
    kind: str
    description: str

    @staticmethod
    def grammar(separator: str) -> re.Pattern[str]:
        s, plain = re.escape(separator), f"[^{re.escape(separator)}]"
        return re.compile(rf"(?P<namespace>[^.{re.escape(separator)}]*)\.(?P<name>[^.{re.escape(separator)}]*){s}(?P<type>{plain}*){s}(?P<kind>{plain}+)(?P<more>(?:{s}{plain}*)*)", re.S)

    def source(self, record: str) -> str:
        value_type, feature_type = STUB_KINDS[self.kind]
        return f"        FeatureStub({record!r}, ValueType.{value_type.name}).as_feature_metadata(FeatureType.{feature_type.name}, {self.namespace!r}, {self.name!r}, {self.description!r}),"


def read_stubs(lines: Iterable[str], separator: str = "|") -> list[Stub]:
    """The stubs of all lines; raises with every line that is none, and why."""
    stubs, faults, grammar = [], [], Stub.grammar(separator)
    for n, line in enumerate(lines, 1):
        m = grammar.fullmatch(line)
        kind = f"{m['type']} {m['kind']}".lower() if m else ""
        if kind in STUB_KINDS:
            more = m["more"].rstrip(separator).split(separator)
            stubs.append(Stub(m["namespace"], m["name"], kind, more[1] if len(more) == 2 else f"Description for {m['name']}"))
        else:
            faults.append(f"line {n}: " + (f"'{kind}' is none of {', '.join(STUB_KINDS)}" if m else f"'{line}' does not read namespace.name{separator}type{separator}kind"))
    if faults:
        raise ValueError("; ".join(faults))
    return stubs


def bootstrap(lines: Iterable[str], record: str, separator: str = "|") -> str:
    """A Python module with a metadata set of stubs, the last line's feature first."""
    declared = [stub.source(record) for stub in read_stubs(lines, separator)]
    head = f"from factloom.plans.features import FeatureStub, MetadataSet\nfrom factloom.types import FeatureType, ValueType\n\n\nclass {record}FeatureSet(MetadataSet):\n    metadata = [\n"
    return head + "".join(f"{d}\n" for d in reversed(declared)) + "    ]\n"


def jobs(sets: Iterable[MetadataSet], database: str, path: str) -> str:
    """A Python module with a job for every feature set: its sources in order, text by day."""
    made = [s for s in sets if isinstance(s, (FeatureSet, AggregationFeatureSet))]
    out = ["from factloom import FeatureContext, join_multi", "from factloom.job import FeatureJobConfig, SimpleFeatureJob", "from factloom.sinks import DerivedSinkPartition, TextSink"]
    out += sorted({f"from {type(s).__module__} import {s.name}" for s in made})
    for s in made:
        table = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", s.name).lower()
        out += ["", "", f"def {table}(*data, context: FeatureContext) -> int:", f'    """Facts of {s.source.type_info}, into the table {database}.{table}; the exit status."""']
        out += [f"    sink = TextSink({database!r}, {path.rstrip('/') + '/' + table!r}, {table!r}, DerivedSinkPartition.eavt_by_day())"]
        out += [f"    return SimpleFeatureJob.generate(FeatureJobConfig({s.name}.source.bind(join_multi(*data)), sink, context), {s.name}())"]
    return "\n".join([*out, ""])


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="factloom")
    commands = parser.add_subparsers(dest="command", required=True)
    m = commands.add_parser("metadata")
    form = m.add_mutually_exclusive_group()
    form.add_argument("--json", action="store_true")
    form.add_argument("--psv", action="store_true")
    m.add_argument("--version", type=int, choices=(0, 1), default=0)
    m.add_argument("package")
    b = commands.add_parser("bootstrap")
    b.add_argument("source_type")
    b.add_argument("file")
    b.add_argument("--separator", default="|")
    j = commands.add_parser("jobs")
    for name in ("package", "database", "path"):
        j.add_argument(name)
    args = parser.parse_args(argv)
    if args.command == "jobs":
        print(jobs(find_sets(args.package), args.database, args.path))
        return 0
    if args.command == "bootstrap":
        with open(args.file) as f:
            print(bootstrap(f.read().splitlines(), args.source_type, args.separator))
        return 0
    writer = Psv if args.psv else (Json1 if args.version == 1 else Json0)
    print(writer.stringify(writer.output(find_sets(args.package))))
    return 0


if __name__ == "__main__":
    sys.exit(main())
