"""FASTA records over many tasks, and reads of single regions."""

import random
from collections import defaultdict

import pytest

from strandframe.sources import readers as rd
from strandframe.sources import writers as wr


def plain(text):
    """header -> bases, a record at a time."""
    out, header = defaultdict(str), None
    for line in text.splitlines():
        if line.startswith(">"):
            header = line[1:].strip()
        elif header is not None:
            out[header] += "".join(line.split()).upper()
    return {h: s for h, s in out.items() if s}


def whole(chunks):
    rows = sorted(chunks.collect(), key=lambda r: (r["header"], r["chunk_id"]))
    out = defaultdict(str)
    for r in rows:
        assert r["chunk_start"] == len(out[r["header"]]) + 1
        out[r["header"]] += r["seq"]
    return dict(out)


@pytest.fixture(scope="module")
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


@pytest.mark.parametrize("seed,chunk,end", [(1, 64, "\n"), (2, 1000, "\r\n"), (3, 7, "\n")])
def test_records_over_splits(spark, small_splits, tmp_path, seed, chunk, end):
    pick, folder, told = random.Random(seed), tmp_path / "fa", {}
    folder.mkdir()
    for f in range(3):
        lines = ["stray bases"] if f == 0 else []
        for k in range(6):
            lines.append(f"> r{f}_{k}|chr{k} of a>b " if k % 2 else f">r{f}_{k} chr1:5-9(+)")
            size = [0, 1, 59, 60, 300, 6000 if f else 300][k]
            bases = "".join(pick.choice("acgtnACGT") for _ in range(size))
            lines += [bases[i : i + 60] for i in range(0, size, 60)]
            lines += ["", " \t "] if k == 3 else []
        text = end.join(lines) + (end if f else "")
        (folder / f"{f}.fa").write_text(text, newline="")
        told |= plain(text)
    got = rd.read_fasta(spark, str(folder), chunk)
    assert whole(got) == told
    assert {r["name"]: r["length"] for r in rd.fasta_references(got).collect()} == {h.split()[0].split("|")[0]: len(s) for h, s in told.items()}
    assert got.columns == ["name", "header", "chunk_id", "chunk_start", "seq"]


def test_a_record_is_no_row(spark, small_splits, tmp_path):
    bases = "".join(random.Random(5).choices("ACGT", k=40_000))
    (tmp_path / "one.fa").write_text(">one\n" + "\n".join(bases[i : i + 50] for i in range(0, len(bases), 50)))
    lines = spark.read.text(str(tmp_path / "one.fa")).selectExpr("_metadata.file_path AS file", "_metadata.file_block_start AS block", "monotonically_increasing_id() AS line", "value")
    parts = rd._fragments(lines).selectExpr("length(seq) AS n", "block").collect()
    assert len({r["block"] for r in parts}) > 20 and max(r["n"] for r in parts) < 2000 and sum(r["n"] for r in parts) == 40_000


def test_empty_files(spark, tmp_path):
    (tmp_path / "none.fa").write_text("")
    (tmp_path / "heads.fa").write_text(">a\n>b\n\n")
    assert rd.read_fasta(spark, str(tmp_path / "*.fa")).count() == 0


def test_region_reads(spark, tmp_path):
    pick = random.Random(8)
    told = {f"chr{k}": "".join(pick.choices("ACGT", k=5000 + k)) for k in range(1, 4)}
    (tmp_path / "g.fa").write_text("".join(f">{n} assembly\n{s[:70]}\n{s[70:]}\n" for n, s in told.items()))
    wr.write_chunks(rd.read_fasta(spark, str(tmp_path / "g.fa"), 100), str(tmp_path / "stored"))
    for name, start, end in [("chr1", 1, 1), ("chr2", 100, 101), ("chr3", 4990, 6000), ("chr1", 101, 200), ("chr2", -5, 30), ("chr3", 57, 2222)]:
        df = rd.read_region(spark, str(tmp_path / "stored"), name, start, end, 100)
        (row,) = df.collect()
        assert row["seq"] == told[name][max(0, start - 1) : end] and (row["start_pos"], row["end_pos"]) == (max(1, start), min(end, len(told[name])))
    assert rd.read_region(spark, str(tmp_path / "stored"), "chr1", 9000, 9100, 100).count() == 0
    assert rd.read_region(spark, str(tmp_path / "stored"), "chr9", 1, 10, 100).count() == 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(name,chr3), GreaterThan(chunk_s" in plan  # Spark cuts long lists of pushed filters short
