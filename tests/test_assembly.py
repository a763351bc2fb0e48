"""Windows, transcripts and chunk-border scans against plain Python."""

import re

from strandframe.functions import bases
from strandframe.operators import assembly

TEXT = "TATAAACGTATATATAAAGGATCTATATATACCGTATAAATTTATATAAC"
CHUNKS = "chrom string, chunk_start long, seq string"


def chunks(spark, sizes):
    rows, at = [], 0
    for n in sizes:
        rows.append(("1", at + 1, TEXT[at : at + n]))
        at += n
    assert at == len(TEXT)
    return spark.createDataFrame(rows, CHUNKS)


def test_hits_over_borders_are_found_once(spark):
    want = sorted((m.start() + 1, m.group(1)) for m in re.finditer("(?=(TATA[AT]A))", TEXT))
    for sizes in ([50], [3, 1, 1, 2, 43], [10] * 5, [1] * 50):
        got = assembly.chunked_hits(chunks(spark, sizes), "TATA[AT]A", 6).collect()
        assert sorted((r["pos"], r["word"]) for r in got) == want


def test_no_chunks_no_hits(spark):
    assert assembly.chunked_hits(spark.createDataFrame([], CHUNKS), "TATA[AT]A", 6).count() == 0


def test_transcripts_join_exons_in_reading_order(spark):
    exons = [("a", "1", "+", 20, 25), ("a", "1", "+", 1, 7), ("b", "1", "-", 3, 9), ("b", "1", "-", 12, 14), ("c", "1", "+", 48, 60), ("d", "2", "+", 1, 9), (None, "1", "+", 1, 3)]
    table = spark.createDataFrame(exons, "gene_name string, chrom string, strand string, start_pos long, end_pos long")
    got = {r["gene_name"]: r for r in assembly.transcripts(table, chunks(spark, [10] * 5)).collect()}
    assert set(got) == {"a", "b", "c", None}
    assert got["a"]["cds"] == TEXT[0:7] + TEXT[19:25] and got["a"]["complete"] and got["a"]["n_exons"] == 2
    assert got["b"]["cds"] == (TEXT[2:9] + TEXT[11:14])[::-1].translate(str.maketrans("ATGC", "TACG"))
    assert got["c"]["cds"] == TEXT[47:] and not got["c"]["complete"]


def test_motif_around_counts_from_the_first_base_read(spark):
    fs = [("1", 4, 9, "+", "p"), ("1", 30, 33, "-", "m"), ("1", 44, 49, "-", "end"), ("2", 1, 5, "+", "none")]
    table = spark.createDataFrame(fs, "chrom string, start_pos long, end_pos long, strand string, id string")
    want = set()
    for chrom, s, e, strand, name in fs[:3]:
        first, last = max(s - 8, 1), min(e + 8, len(TEXT))
        places = range(first, last + 1) if strand == "+" else range(last, first - 1, -1)
        read = "".join(TEXT[p - 1] if strand == "+" else TEXT[p - 1].translate(str.maketrans("ATGC", "TACG")) for p in places)
        for m in re.finditer("(?=AT[AC])", read):
            at = places[m.start()]
            want.add((name, at - s if strand == "+" else e - at, s <= at <= e))
    got = assembly.motif_around(table, chunks(spark, [7] * 7 + [1]), "AT[AC]", 3, 8).collect()
    assert {(r["id"], r["relative"], r["in_feature"]) for r in got} == want and len(got) == len(want)


def test_quantities_of_the_callers_own_and_rows_that_count_for_nothing(spark):
    rows = [("1", 1, 150, "gene", "x"), ("1", 90, 110, "CDS", "y"), ("1", 9, 2, "gene", "x"), ("1", None, 5, "gene", "x"), ("1", 500, 510, "other", None)]
    table = spark.createDataFrame(rows, "chrom string, start_pos long, end_pos long, feature_type string, source string")
    known = assembly.QUANTITIES | {"gene_bases": assembly.Quantity(lambda shared, size: shared, ("gene",))}
    got = assembly.quantity_windows(table, 100, ["genes", "cds_length", "gene_bases"], known).collect()
    assert sorted((r["win"], r["genes"], r["cds_length"], r["gene_bases"]) for r in got) == [(0, 1, 11, 100), (1, 1, 10, 50)]


def test_shapes_of_empty_short_and_null_sequences(spark):
    rows = spark.createDataFrame([("",), ("AC",), ("ATGCATG",), (None,)], "s string")
    s = rows["s"]
    got = [tuple(r) for r in rows.select(bases.rotate(s, 3), bases.pad(s, 4), bases.tile(s, 5), bases.crop_centre(s, 3)).collect()]
    assert got == [("", "NNNN", "", ""), ("AC", "ACNN", "ACACA", "AC"), ("CATGATG", "ATGCATG", "ATGCA", "GCA"), (None, None, None, None)]


def test_smoothed_grid_keeps_inner_cells(spark):
    grid = spark.createDataFrame([(i, j, i * 10 + j) for i in range(3) for j in range(4)], "i long, j long, v long")
    got = sorted(tuple(r) for r in assembly.smoothed_grid(grid, "i", "j", "v").collect())
    assert got == [(1, 1, 0.5 * 11 + 0.25 * (1 + 21 + 10 + 12)), (1, 2, 0.5 * 12 + 0.25 * (2 + 22 + 11 + 13))]
