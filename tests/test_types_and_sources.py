"""Type strings, inference and formats."""

import pytest
from pyspark.sql import types as T

from lattica.dataset import rep
from lattica.expr import _
from lattica.sources import read, write
from lattica.sources.database import Catalog
from lattica.sources.delimited import sniff
from lattica.types import common_type, create_type, match_type, type_string


def test_type_strings():
    assert create_type("[x:~]<(a=int64?, b={s}<string)") == T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.ArrayType(T.StringType()))]))
    assert type_string(create_type("(a=real64, b=bool)")) == "(a=real64, b=bool)"
    with pytest.raises(ValueError):
        create_type("nonsense")
    assert match_type(T.LongType(), "number") and match_type(T.LongType(), "int64|bool") and not match_type(T.StringType(), "number")


def test_common_types():
    assert common_type(T.LongType(), T.FloatType()) == T.FloatType()
    assert common_type(T.BooleanType(), T.LongType()) == T.LongType()
    assert common_type(T.LongType(), T.StringType()) == T.StringType()
    assert common_type(T.ArrayType(T.LongType()), T.ArrayType(T.DoubleType())) == T.ArrayType(T.DoubleType())


def test_detect(spark):
    d = rep(spark, [("1", "1.5", "x", "NA"), ("", "2", "3", "7")]).Detect()
    assert list(d.Type.values()) == ["int", "real64", "string", "int"] or list(d.Type.values())[0] in ("int", "int64")


def test_sniff():
    found = sniff(["# made by hand", "name\tage", "ann\t3", "bob\t4"])
    assert (found.delimiter, found.comment, found.header) == ("\t", "#", ["name", "age"])
    assert sniff(["1,2,3", "4,5,6"]).header is None
    assert sniff(["a;b", '"x;y";2']).quote == '"'


def _file(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_tables(spark, tmp_path):
    d = read(spark, _file(tmp_path, "x.tsv", "Name\tMy Age\nann\t3\nbob\t\n"), detect=True)
    assert d.Names == ["name", "my_age"] and d.ToPython() == [{"name": "ann", "my_age": 3}, {"name": "bob", "my_age": None}]
    m = read(spark, _file(tmp_path, "m.tsv_matrix", "gene\ta\tb\ng1\t1\t2\ng2\t3\t4\n"))
    assert sorted(map(str, m.Get("gene", "matrix").ToPython())) == ["{'gene': 'g1', 'matrix': [1.0, 2.0]}", "{'gene': 'g2', 'matrix': [3.0, 4.0]}"]


def test_sequence_files(spark, tmp_path):
    fa = read(spark, _file(tmp_path, "x.fasta", ">a|1\nACGT\nAC\n>b|2\nGG\n"))
    assert sorted(tuple(r.values()) for r in fa.ToPython()) == [("a", "1", "ACGTAC"), ("b", "2", "GG")]
    fq = read(spark, _file(tmp_path, "x.fastq", "@r1\nAC\n+\nII\n@r2\nGT\n+\nJJ\n"))
    assert sorted(tuple(r.values()) for r in fq.ToPython()) == [("r1", "AC", "II"), ("r2", "GT", "JJ")]
    line = "r1\t0\tchr1\t7\t30\t2M\t*\t0\t0\tAC\tII"
    sam = read(spark, _file(tmp_path, "x.sam", f"@HD\tVN:1\n{line}\tNM:i:0\tX\n{line}\nshort\n"))
    assert [r["optional"] for r in sam.ToPython()] == ["NM:i:0\tX", None] and sam.ToPython()[0]["pos"] == 7
    write(sam, str(tmp_path / "out.sam"))
    assert read(spark, str(tmp_path / "out.sam")).Len() == 2


def test_annotation(spark, tmp_path):
    gff = read(spark, _file(tmp_path, "x.gff", "##gff-version 3\nc1\tsrc\tgene\t1\t9\t.\t+\t.\tID=g1;Name=A%20b\n"))
    row = gff.ToPython()[0]
    assert (row["id"], row["name"], row["score"], row["start"]) == ("g1", "A b", None, 1)
    maf = read(spark, _file(tmp_path, "x.maf", "##maf version=1\n\na score=5.0\ns h.1 0 3 + 9 ACG\ns m.1 1 3 - 8 A-G\n\na score=1\ns h.1 5 2 + 9 AC\n"))
    assert sorted((r["score"], r["size"]) for r in maf.ToPython()) == [(1.0, [2]), (5.0, [3, 3])]
    head = '##INFO=<ID=DP,Number=1,Type=Integer,Description="d">\n##INFO=<ID=AF,Number=A,Type=Float,Description="f">\n##FORMAT=<ID=GT,Number=1,Type=String,Description="g">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n'
    vcf = read(spark, _file(tmp_path, "x.vcf", head + "1\t10\trs1\tA\tC,G\t20\tPASS\tDP=5;AF=0.1,0.2\tGT\t0/1\t1/1\n"))
    row = vcf.ToPython()[0]
    assert round(row["qual"], 6) == 0.01 and row["alt"] == ["C", "G"] and row["info_dp"] == 5 and row["info_af"] == [0.1, 0.2] and row["fmt_gt"] == ["0/1", "1/1"] and row["sample_names"] == ["s1", "s2"]


def test_records(spark, tmp_path):
    xml = read(spark, _file(tmp_path, "x.xml", "<a k='1'><b>t</b><b/></a>"))
    assert [(r["node"], r["parent"], r["node_name"], r["node_value"]) for r in sorted(xml.ToPython(), key=lambda r: r["node"])] == [(0, -1, "a", None), (1, 0, "b", "t"), (2, 0, "b", None)]
    psi = "<entrySet><entry><experimentList><experimentDescription id='e1'><names><shortLabel>x</shortLabel></names></experimentDescription></experimentList><interactorList><interactor id='p1'><names><shortLabel>P</shortLabel></names></interactor></interactorList><interactionList><interaction id='i1'><names><shortLabel>I</shortLabel></names><participantList><participant><interactorRef>p1</interactorRef></participant></participantList></interaction></interactionList></entry></entrySet>"
    parts = read(spark, _file(tmp_path, "x.psimi", psi))
    assert parts["interactions"].ToPython()[0]["participants"] == ["p1"] and parts["experiments"].Len() == parts["interactors"].Len() == 1
    gb = 'LOCUS       X1   6 bp\nDEFINITION  two\n            lines.\nACCESSION   X1\n  ORGANISM  Y z\nFEATURES             Location/Qualifiers\n     gene            1..6\n                     /gene="abc"\nORIGIN\n        1 acgtac\n//\n'
    row = read(spark, _file(tmp_path, "x.genbank", gb)).ToPython()[0]
    assert (row["accession"], row["description"], row["seq"], row["feat_type"], row["feat_attr"]) == ("X1", "two lines.", "acgtac", ["gene"], [{"gene": "abc"}])
    embl = 'ID   X2; SV 1; linear;\nAC   X2;\nDE   words\nOS   Y z\nFT   gene            1..6\nFT                   /gene="abc"\nSQ   Sequence 6 BP;\n     acgtac   6\n//\n'
    row = read(spark, _file(tmp_path, "x.embl", embl)).ToPython()[0]
    assert (row["accession"], row["name"], row["seq"], row["feat_type"], row["feat_attr"]) == ("X2", "X2", "acgtac", ["gene"], [{"gene": "abc"}])
    assert row["feat_spans"] == [[{"ref": None, "start": 1, "end": 6, "strand": "+", "partial": False}]]


def test_spans_and_named_sources(spark):
    from lattica.sources import catalog
    from lattica.sources.records import spans

    got = [(x["ref"], x["start"], x["end"], x["strand"], x["partial"]) for x in spans("join(complement(3..5),J00194.1:100..202,complement(join(<9, 12^13)),7..>8)")]
    assert got == [(None, 3, 5, "-", False), ("J00194.1", 100, 202, "+", False), (None, 9, 9, "-", True), (None, 12, 13, "-", False), (None, 7, 8, "+", True)]
    catalog.register(lambda spark: rep(spark, [1, 2]), "numbers", "tests")
    assert catalog.tests.numbers(spark).ToPython() == [1, 2]


def test_catalog(spark):
    c, d = Catalog(spark), rep(spark, [([1, 2], "a"), ([3], "b")])
    c.Drop("t1")
    c.Store("t1", d)
    c.Store("t1", d)
    back = c.Get("t1")
    assert back.Len() == 4 and back.Dims == d.Dims and sorted(back.Get(s=_.f0.Sum()).ToPython()) == [3, 3, 3, 3]
    assert c.Query("SELECT count(*) AS n FROM t1").ToPython() == [4]
    c.Drop("t1")
    assert "t1" not in c.Tables()


def test_lines_are_told_by_their_place(spark, tmp_path):
    from lattica.sources.delimited import read_tsv
    from lattica.sources.sequence_files import read_fasta, read_fastq

    (tmp_path / "a.tsv").write_text("made by hand\non a day\nname\tn\nx\t1\nname\tn\ny\t2\n")
    got = read_tsv(spark, str(tmp_path / "a.tsv"), skiprows=2, fieldnames=True)
    assert got.Names == ["name", "n"] and sorted(map(tuple, got.toDF().collect())) == [("name", "n"), ("x", "1"), ("y", "2")]
    (tmp_path / "b.tsv").write_text("# a comment\nname\tn\nx\t1\nname\tn\n# another\ny\t2\n")
    assert sorted(map(tuple, read_tsv(spark, str(tmp_path / "b.tsv"), fieldnames=True).toDF().collect())) == [("name", "n"), ("x", "1"), ("y", "2")]
    (tmp_path / "c.fa").write_text(">s1 a->b x\nAC\nGT\n>s2\n\nTT\n")
    assert sorted(map(tuple, read_fasta(spark, str(tmp_path / "c.fa")).toDF().collect())) == [("s1 a->b x", "ACGT"), ("s2", "TT")]
    long = "r" * 1_200_000
    (tmp_path / "d.fq").write_text(f"@{long}\nAC\n+\n!!\n")
    assert read_fastq(spark, str(tmp_path / "d.fq")).toDF().first().sequenceid == long
