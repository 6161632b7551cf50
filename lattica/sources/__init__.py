"""Readers and writers by format. read() goes by file extension, the last known one: x.tsv.gz is tsv."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

from lattica.dataset import Dataset
from lattica.sources import annotation, database, delimited, records, sequence_files

READERS: dict[str, Callable[..., Any]] = {
    "tsv": delimited.read_tsv, "csv": delimited.read_tsv, "tsv2": delimited.read_tsv, "txt": delimited.read_tsv, "tab": delimited.read_tsv, "tsv1": delimited.read_plain, "bed": delimited.read_plain,
    "tsv_matrix": delimited.read_matrix, "xml": records.read_xml, "psimi": records.read_psimi, "fasta": sequence_files.read_fasta, "fa": sequence_files.read_fasta, "fas": sequence_files.read_fasta,
    "fastq": sequence_files.read_fastq, "sam": sequence_files.read_sam, "gff": annotation.read_gff, "gff3": annotation.read_gff, "maf": annotation.read_maf, "vcf": annotation.read_vcf,
    "genbank": records.read_genbank, "gb": records.read_genbank, "embl": records.read_embl, "parquet": database.load,
}
WRITERS: dict[str, Callable[..., None]] = {
    "tsv": delimited.write_tsv, "csv": delimited.write_csv, "bed": delimited.write_plain, "tsv_matrix": delimited.write_matrix, "fasta": sequence_files.write_fasta, "sam": sequence_files.write_sam,
    "gff": annotation.write_gff, "xlsx": delimited.write_xlsx, "parquet": database.save,
}


class Catalog:
    """Named sources of one's own, by category: catalog.register(f, "feats", "yeast"), then catalog.yeast.feats(spark)."""

    def register(self, source: Callable[..., Any], name: str | None = None, category: str | None = None) -> None:
        if category:
            if category not in vars(self):
                setattr(self, category, Catalog())
            getattr(self, category).register(source, name)
        else:
            setattr(self, name or source.__name__, source)


catalog = Catalog()


def add_format(extension: str, reader: Callable[..., Any] | None = None, writer: Callable[..., None] | None = None) -> None:
    """Register a format of one's own."""
    if reader:
        READERS[extension] = reader
    if writer:
        WRITERS[extension] = writer


def _format(path: str, known: dict[str, Any]) -> str:
    for part in path.rsplit("/", 1)[-1].split(".")[:0:-1]:
        if part in known:
            return part
    raise ValueError(f"no format for {path}")


def read(spark: SparkSession, path: str, format: str | None = None, detect: bool = False, **options: Any) -> Any:
    """A file or folder as a dataset; detect: text columns of numbers become numbers."""
    out = READERS[format or _format(path, READERS)](spark, path, **options)
    return out.Detect() if detect and isinstance(out, Dataset) else out


def write(ds: Dataset, path: str, format: str | None = None, **options: Any) -> None:
    """A dataset to a file or folder."""
    WRITERS[format or _format(path, WRITERS)](ds, path, **options)
