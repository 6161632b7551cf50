"""Record formats that need a parser of their own: XML, PSI-MI, GenBank, EMBL. Whole files or records go to one task each."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lattica.dataset import Dataset, Slice


def _texts(spark: SparkSession, path: str):
    return spark.read.text(path, wholetext=True)


def read_xml(spark: SparkSession, path: str) -> Dataset:
    """Every node of the documents: file, node number, parent's number, name, text, attributes (a map)."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xml.etree.ElementTree as tree

        for frame in frames:
            rows: list[tuple[Any, ...]] = []
            for k, text in enumerate(frame["value"]):
                todo, number = [(tree.fromstring(text), -1)], 0
                while todo:
                    node, parent = todo.pop()
                    rows.append((number, parent, node.tag.rpartition("}")[2], (node.text or "").strip() or None, dict(node.attrib)))
                    todo += [(child, number) for child in reversed(node)]
                    number += 1
            yield pd.DataFrame(rows, columns=["node", "parent", "node_name", "node_value", "attrs"])

    return Dataset.of(_texts(spark, path).mapInPandas(parse, "node long, parent long, node_name string, node_value string, attrs map<string,string>"), "nodes")


def read_psimi(spark: SparkSession, path: str) -> dict[str, Dataset]:
    """Three datasets of molecular interaction files: experiments, interactors, interactions with their participants."""
    kinds = {
        "experiment": "id string, name string, pubmed string, method string",
        "interactor": "id string, name string, fullname string, taxid string",
        "interaction": "id string, name string, type string, participants array<string>, experiments array<string>",
    }
    texts = _texts(spark, path)
    out = {}
    for kind, schema in kinds.items():

        def parse(frames: Iterator[pd.DataFrame], kind: str = kind, names: tuple = tuple(x.split()[0] for x in schema.split(", "))) -> Iterator[pd.DataFrame]:
            import xml.etree.ElementTree as tree

            def text(node: Any, *path: str) -> str | None:
                for step in path:
                    node = next((c for c in (node if node is not None else ()) if c.tag.rpartition("}")[2] == step), None)
                return node.text if node is not None else None

            def every(node: Any, name: str) -> list:
                return [x for x in node.iter() if x.tag.rpartition("}")[2] == name]

            for frame in frames:
                rows = []
                for value in frame["value"]:
                    root = tree.fromstring(value)
                    for node in every(root, {"experiment": "experimentDescription"}.get(kind, kind)):
                        own = (node.get("id"), text(node, "names", "shortLabel"))
                        if kind == "experiment":
                            ref = next((x.get("id") for x in every(node, "primaryRef")), None)
                            rows.append((*own, ref, text(node, "interactionDetectionMethod", "names", "shortLabel")))
                        elif kind == "interactor":
                            rows.append((*own, text(node, "names", "fullName"), next((x.get("ncbiTaxId") for x in every(node, "organism")), None)))
                        else:
                            refs = [x.text or "" for x in every(node, "interactorRef")] or [x.get("id") for x in every(node, "interactor")]
                            rows.append((*own, text(node, "interactionType", "names", "shortLabel"), refs, [x.text or "" for x in every(node, "experimentRef")]))
                yield pd.DataFrame(rows, columns=list(names))

        out[f"{kind}s"] = Dataset.of(texts.mapInPandas(parse, schema), f"{kind}s")
    return out


_RECORD = "accession string, name string, description string, organism string, length long, seq string, contig string, feat_type array<string>, feat_loc array<string>, feat_attr array<map<string,string>>, feat_spans array<array<struct<ref:string,start:bigint,end:bigint,strand:string,partial:boolean>>>"
_SPAN = re.compile(r"(complement|join|order|bond|one-of)?\(|\)|(?:([\w.|-]+):)?([<>]?)(\d+)(?:(?:\.\.|\.|\^)([<>]?)(\d+))?")


def spans(location: str) -> list[dict]:
    """The stretches of a location in the order of the text, from 1 on, both ends included: "complement(join(3..5,<9))"."""
    out, turned = [], [False]
    for m in _SPAN.finditer(location.replace(" ", "")):
        if m[0].endswith("("):
            turned.append(turned[-1] != (m[1] == "complement"))
        elif m[0] == ")":
            if len(turned) > 1:
                turned.pop()
        else:
            out.append({"ref": m[2], "start": int(m[4]), "end": int(m[6] or m[4]), "strand": "-" if turned[-1] else "+", "partial": bool(m[3] or m[5])})
    return out


def _feature_table(lines: list[str], indent: int) -> tuple[list[str], list[str], list[dict[str, str]], list[list[dict]]]:
    """Types, locations, attributes and spans of feature lines whose qualifiers begin at a column."""
    types, locations, attributes = [], [], []
    last = None
    for line in lines:
        key, rest = line[:indent].strip(), line[indent:].strip()
        if key:
            types.append(key)
            locations.append(rest)
            attributes.append({})
            last = None
        elif rest.startswith("/"):
            last, _, value = rest[1:].partition("=")
            attributes[-1][last] = value.strip('"')
        elif last is not None:
            attributes[-1][last] = (attributes[-1][last] + " " * (last != "translation") + rest).strip('"')
        elif locations:
            locations[-1] += rest
    return types, locations, attributes, list(map(spans, locations))


def _genbank(text: str) -> tuple | None:
    def value(key: str) -> str | None:
        m = re.search(rf"^ *{key} +(.*(?:\n {{12}}.*)*)", text, re.M)
        return re.sub(r"\s+", " ", m[1]).strip() if m else None

    if not value("LOCUS"):
        return None
    features = re.search(r"^FEATURES.*\n((?: .*\n?)*)", text, re.M)
    origin = re.search(r"^ORIGIN.*\n((?:[ \d].*\n?)*)", text, re.M)
    seq = re.sub(r"[^A-Za-z]", "", origin[1]) if origin else ""
    return (value("ACCESSION"), value("LOCUS").split()[0], value("DEFINITION"), value("ORGANISM"), len(seq), seq, value("CONTIG"), *_feature_table(features[1].splitlines() if features else [], 21))


def _embl(text: str) -> tuple | None:
    lines = text.splitlines()
    of = lambda code: [x[5:].strip() for x in lines if x.startswith(code)]
    if not of("ID"):
        return None
    seq = "".join(re.sub(r"[^A-Za-z]", "", x) for x in lines if x.startswith("     "))
    features = [x[2:].ljust(3) and "  " + x[2:] for x in lines if x.startswith("FT")]
    return (";".join(of("AC")).strip(";").split(";")[0] or None, re.split(r"[;\s]", of("ID")[0])[0], " ".join(of("DE")), " ".join(of("OS")), len(seq), seq, "".join(of("CO")) or None, *_feature_table(features, 21))


def _read_flat(spark: SparkSession, path: str, parse_one: Any) -> Dataset:
    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [r for r in map(parse_one, frame["value"]) if r]
            yield pd.DataFrame(found, columns=[x.split()[0] for x in re.split(r", (?=\w+ )", _RECORD)])

    records = spark.read.option("lineSep", "\n//").text(path).select(F.ltrim("value").alias("value") if parse_one is _embl else "value")
    df = records.mapInPandas(parse, _RECORD)
    dims = lambda n: ("records", *["feats"] * n.startswith("feat_"), *["spans"] * (n == "feat_spans"))
    return Dataset(df, [Slice(n, n, dims(n)) for n in df.columns], "records")


def read_genbank(spark: SparkSession, path: str) -> Dataset:
    """Records with accession, name, description, organism, sequence or contig, and features along an inner dim, their spans along one more."""
    return _read_flat(spark, path, _genbank)


def read_embl(spark: SparkSession, path: str) -> Dataset:
    """As read_genbank, of EMBL files."""
    return _read_flat(spark, path, _embl)
