"""Readers, writers and streams on small files."""

from pyspark.sql import functions as F

from strandframe.sources import readers as rd
from strandframe.sources import writers as wr
from strandframe.streaming.detectors import sliding_windows, streamed_hits, windowed_counts


def put(path, text):
    path.write_text(text)
    return str(path)


def test_gtf(spark, tmp_path):
    line = 'chr1\thavana\texon\t10\t20.0\t.\t+\t.\tgene_id "G1"; gene_name "ABC"; transcript_name "ABC-201"; exon_number "2"; gene_biotype "lncRNA"; tag "a"; tag "b"; level 3;\n'
    row = rd.read_gtf(spark, put(tmp_path / "a.gtf", "#x\n" + line + "chr2\t.\tgene\tx\t9\t1.5\t-\t.\tgene_id \"G2\"\n")).orderBy("chrom").collect()
    a, b = row
    assert (a.chrom, a.start_pos, a.end_pos, a.score, a.name, a.feature_type) == ("1", 10, 20, None, "ABC-201-ex2", "lncRNA_exon")
    assert a.attributes["tag"] == ["a", "b"] and a.attributes["level"] == ["3"]
    assert (b.start_pos, b.score, b.name, b.feature_type) == (None, 1.5, "G2", "gene")


def test_vcf(spark, tmp_path):
    text = "##h\n#CHROM\nchr1\t100\t.\tG\tA,ATT\t5.67\tPASS\tAC=1;DB;AF=0.5\tGT:DP\t1|2:6\n1\t7\trs1\tGTC\tG\t.\t.\t.\tGT\t./1\n"
    a, b = rd.read_vcf(spark, put(tmp_path / "a.vcf", text)).orderBy(F.col("pos").desc()).collect()
    assert (a.chrom, a.alts, a.genotype, a.delta, a.end_pos, a["info"]["AF"], a.call["DP"]) == ("1", ["ATT", "A"], "A/ATT", 2, 101, "0.5", "6")
    assert (b.genotype, b.delta, b.qual) == ("./G", -2, None)


def test_beds_and_tables(spark, tmp_path):
    bed = put(tmp_path / "r.bed", "chr1\t5\t25\t(CAG)n\tSimple_repeat\tC\nchr1\t5\t25\tAluY\tSINE\t+\n")
    row = rd.simple_repeats(rd.read_repeatmasker(spark, bed)).first()
    assert (row.motif, row.strand, round(row.repeat_count, 3)) == ("CAG", "-", 6.667)
    peaks = rd.read_peaks(spark, put(tmp_path / "p.bed", "track name=x\nchr2\t0\t9\tp\t7\t+\n")).first()
    assert (peaks.chrom, peaks.start_pos, peaks.score) == ("2", 1, 7.0)
    info = rd.read_gene_info(spark, put(tmp_path / "g.tsv", "#h\n9606\t1\tA1BG\t-\tA1B|ABG\n")).first()
    assert info.synonyms == ["A1B", "ABG"] and info.gene_id == 1
    clin = rd.read_clinvar(spark, put(tmp_path / "c.tsv", "1\t5\t6\tid\tA\tC\tLikely_pathogenic\td\tBRCA1:672\tSNV\tC=0.01\t.\t0.2\t.\tm\n")).first()
    assert clin.is_pathogenic and clin.gene_name == "BRCA1" and clin.af_esp == 0.01 and clin.af_exac is None and clin.af_tgp == 0.2
    uc = rd.read_clusters(spark, put(tmp_path / "u.uc", "S\t0\t30\t*\t.\t*\t*\t*\ta\t*\nH\t0\t29\t97.5\t+\t*\t*\t*\tb\ta\nC\t0\t2\t*\t*\t*\t*\t*\ta\t*\n")).orderBy("query").collect()
    assert [(r.query, r.centroid, r.identity) for r in uc] == [("a", "a", 100.0), ("b", "a", 97.5)]
    exp = rd.read_expression(spark, put(tmp_path / "e.bed", "chrom\tstart\tend\tid\ttype\tname\tstrand\tm\tt\tn\tk\n1\t9\t12\tx\tt\tn\t+\t0.5\t1\t2\t3\n")).collect()
    assert len(exp) == 1 and exp[0].mean_exp == 0.5


def test_fasta_round_trip_and_headers(spark, tmp_path):
    seqs = [("a", "1", 5, 14, "+", "ACGTACGTAC"), ("b", "X", 1, 200, "-", "ACGT" * 50)]
    df = spark.createDataFrame(seqs, "name string, chrom string, start_pos long, end_pos long, strand string, seq string")
    wr.write_fasta(df, str(tmp_path / "fa"), width=60)
    back = rd.read_fasta(spark, str(tmp_path / "fa"), chunk=64)
    whole = back.groupBy("name", "header").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "seq"))), lambda x: x.seq), "").alias("seq"))
    got = {r.name: r for r in whole.select("name", "seq", *rd.header_place(F.col("header"))).collect()}
    assert {n: got[n].seq for n in got} == {s[0]: s[5] for s in seqs}
    assert (got["b"].chrom, got["b"].start_pos, got["b"].end_pos, got["b"].strand) == ("X", 1, 200, "-")
    pipe = spark.createDataFrame([("n|3|7|9|-",)], "h string").select(*rd.header_place(F.col("h"))).first()
    assert tuple(pipe) == ("3", 7, 9, "-")


def test_jaspar(spark, tmp_path):
    text = ">M1 X\nA [ 1 2 ]\nC [ 0 0 ]\nG [ 3 0 ]\nT [ 0 4 ]\n>BAD y\nA [ 1 ]\n"
    rows = rd.read_jaspar(spark, put(tmp_path / "m.jaspar", text)).collect()
    assert {(r.motif_id, r.pos, r.base): r.cnt for r in rows}[("M1", 1, "T")] == 4.0 and len(rows) == 8


def test_feature_writer(spark, tmp_path):
    df = spark.createDataFrame([("z", None, 3, 0.123456789, "1"), ("y", "g", 1, 2.0, "1")], "extra string, name string, start_pos long, score double, chrom string").withColumn("end_pos", F.col("start_pos"))
    wr.write_features(df, str(tmp_path / "f"), "csv", partitions=1)
    lines = "".join(p.read_text() for p in sorted((tmp_path / "f").glob("part-*"))).splitlines()
    assert lines == ["chrom\tstart_pos\tend_pos\tscore\tname\textra", "1\t1\t1\t2.00000\tg\ty", "1\t3\t3\t0.123457\t.\tz"]
    wr.write_by_class(df, str(tmp_path / "c"), "extra")
    assert spark.read.parquet(str(tmp_path / "c")).filter("extra = 'z'").count() == 1


def test_streams(spark, tmp_path):
    rows = [("1", 1, "AACCGG"), ("1", 7, "GGGGTT"), ("1", 13, "CG"), ("2", 1, "GGGG")]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "chrom string, chunk_start long, seq string").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("chrom string, chunk_start long, seq string").parquet(src)
    hits = sliding_windows(stream, 4, 2, lambda s: sum(c in "GC" for c in s) / len(s), 0.75)
    q = hits.writeStream.format("memory").queryName("hits").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    want = []
    for chrom in "12":
        whole = "".join(s for c, _, s in rows if c == chrom)
        want += [(chrom, k + 1) for k in range(0, len(whole) - 3, 2) if sum(c in "GC" for c in whole[k : k + 4]) >= 3]
    assert sorted((r.chrom, r.start) for r in spark.table("hits").collect()) == want
    counts = windowed_counts(stream.withColumnRenamed("chunk_start", "start_pos"), 10)
    q = counts.writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("counts").collect())) == [("1", 0, 2), ("1", 1, 1), ("2", 0, 1)]


def test_rna_tables(spark, tmp_path):
    line = "chr3\t5\t9\thsa-lncRNA7|P|-\t2\t+\t6\t8\t1,2\t4\t10,,30\t1,2,3\n"
    r = rd.read_lncrna(spark, put(tmp_path / "l.tsv", line)).first()
    assert (r.chrom, r.name, r.name_tag, r.parent_feature, r["info"], r.read_types) == ("3", "hsa-lncRNA7", "7", "P", "", [1, 2])
    assert [tuple(p) for p in r.data] == [(10, 1), (30, 3)]
    p = rd.read_pirna(spark, put(tmp_path / "p.tsv", "chr1\t1\t30\tpiR-1\t4\t-\n")).first()
    assert (p.chrom, p.num, p.strand, p.feature_type) == ("1", 4, "-", "piRNA_hit")


def test_dataset_by_its_columns_and_by_class(spark, tmp_path):
    rows = spark.createDataFrame([("1", 5, 9, "gene", 1.5, "x"), ("1", 2, 3, "exon", None, "y"), ("2", 1, 1, "gene", 2.0, None)], "chrom string, start_pos long, end_pos long, feature_type string, score double, note string")
    wr.write_features(rows, str(tmp_path / "t"), fmt="text", partitions=1)
    back = rd.read_dataset(spark, str(tmp_path / "t"), wr.ordered_columns(rows))
    assert sorted(map(str, back.select(*rows.columns).collect())) == sorted(map(str, rows.collect()))
    wr.write_by_class(rows, str(tmp_path / "c"), "feature_type", fmt="json")
    assert rd.read_by_class(spark, str(tmp_path / "c"), "feature_type", ["gene"], "json").count() == 2
    assert [r.start_pos for r in rd.first_rows(rows, 1, "1").collect()] == [2] and rd.first_rows(rows, 9).count() == 3


def test_personal_fasta(spark, tmp_path):
    regions = spark.createDataFrame([(1, "r", "1", 11, "ACGT")], "seq_id long, name string, chrom string, start_pos long, seq string")
    calls = spark.createDataFrame([("1", 12, "C", "CTT")], "chrom string, pos long, ref string, alt string")
    wr.write_personal_fasta(regions, calls, str(tmp_path / "f"))
    assert sorted(x.value for x in spark.read.text(str(tmp_path / "f")).collect()) == [">r_personal", ">r_reference", "ACGT", "ACTTGT"]


def test_streamed_hits_over_borders(spark, tmp_path):
    text, src = "TATAAACGTATATATAAAGG", str(tmp_path / "in")
    rows = [("1", at + 1, text[at : at + 3]) for at in range(0, len(text), 3)]
    spark.createDataFrame(rows, "chrom string, chunk_start long, seq string").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("chrom string, chunk_start long, seq string").parquet(src)
    q = streamed_hits(stream, "TATA[AT]A", 6).writeStream.format("memory").queryName("streamed").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    want = [k + 1 for k in range(len(text) - 5) if text[k : k + 5] in ("TATAA", "TATAT") and text[k + 5] == "A"]
    assert sorted(r.start for r in spark.table("streamed").collect()) == want and want


def test_bed_dfam_and_repeat_dump(spark, tmp_path):
    a, b = rd.read_bed(spark, put(tmp_path / "a.bed", "track name=x\nbrowser position\nchr1\t5\t9\tn\t7.5\t-\n2\t1\t3\tm\t.\t.\n")).orderBy("chrom").collect()
    assert (a.chrom, a.start_pos, a.end_pos, a.name, a.score, a.strand) == ("1", 5, 9, "n", 7.5, "-")
    assert (b.chrom, b.score, b.strand) == ("2", None, ".")
    line = "chr7\t100\t180\tAluY\t55.5\t-\tDF01\t1e-9\t0.3\t1\t80\t99\t181\t5000\t4.5\n"
    d = rd.read_dfam(spark, put(tmp_path / "d.tsv", line)).first()
    assert (d.chrom, d.start_pos, d.end_pos, d.name, d.bits, d.e_value, d.start_hmm, d.end_hmm, d.sq_len, d.kimura_div) == ("7", 100, 180, "AluY", 55.5, 1e-9, 1, 80, 5000, 4.5)
    line = "585\t463\t13\t6\t17\tchr1\t10000\t10468\t-249\t+\t(TAACCC)n\tSimple_repeat\tSimple_repeat\t1\t471\t0\t1\n"
    r = rd.read_rmsk(spark, put(tmp_path / "r.tsv", line)).first()
    assert (r.chrom, r.start_pos, r.end_pos, r.strand, r.name, r.repeat_class, r.repeat_family) == ("1", 10001, 10468, "+", "(TAACCC)n", "Simple_repeat", "Simple_repeat")
