"""What transcripts share is read once, and only what a variant asks for."""

import random

from strandframe.operators import coding


def _tables(spark):
    r = random.Random(4)
    text = "".join(r.choice("ACGT") for _ in range(600))
    text = text[:9] + "ATG" + text[12:]
    segments = [(f"t{i}", "1", "+" if i % 4 else "-", 10 + 60 * k, 30 + 60 * k) for i in range(40) for k in range(3)]
    segments += [("far", "1", "+", 400 + 30 * k, 420 + 30 * k) for k in range(3)] + [(None, "1", "+", 10, 30)]
    variants = [("1", p, text[p - 1], "ACGT"["ACGT".index(text[p - 1]) ^ 1]) for p in (14, 20, 75, 78)] + [("1", 350, text[349], "A")]
    return (
        spark.createDataFrame(segments, "transcript string, chrom string, strand string, start_pos long, end_pos long"),
        spark.createDataFrame(variants, "chrom string, pos long, ref string, alt string"),
        spark.createDataFrame([("1", 1, text[:50]), ("1", 51, text[50:])], "chrom string, chunk_start long, seq string"),
    )


def _reads(monkeypatch):
    asked, keep = [], coding.interval_sequences
    monkeypatch.setattr(coding, "interval_sequences", lambda rows, *a: asked.append(rows.count()) or keep(rows, *a))
    return asked


def test_codon_effects_read_only_transcripts_that_variants_lie_in(spark, monkeypatch):
    segments, variants, chunks = _tables(spark)
    asked = _reads(monkeypatch)
    got = coding.codon_changes_of(variants, segments, chunks).collect()
    assert asked == [6]  # three places on both strands, of 40 transcripts
    plain = coding.codon_changes_of(variants, segments.filter("transcript in ('t0', 't1')"), chunks).collect()
    mine = lambda rows, i: sorted(tuple(x)[1:] for x in rows if x["transcript"] == f"t{i}")
    assert {x["transcript"] for x in got if x["strand"] == "+"} == {f"t{i}" for i in range(40) if i % 4}
    assert all(mine(got, i) == mine(plain, 1 if i % 4 else 0) for i in range(40)) and mine(got, 1)


def test_protein_changes_read_and_change_a_place_once(spark, monkeypatch):
    segments, variants, chunks = _tables(spark)
    asked = _reads(monkeypatch)
    got = {x["transcript"]: x for x in coding.protein_changes(segments, variants, chunks).collect()}
    assert asked == [6] and got.keys() == {f"t{i}" for i in range(40)} | {"far"}
    alone = [coding.coding_sequences(segments.filter(f"transcript = 't{i}'"), chunks).first()["protein"] or "" for i in (0, 1)]
    for i in range(40):
        assert got[f"t{i}"]["protein"] == alone[1 if i % 4 else 0] and got[f"t{i}"]["n_applied"] == 4
    assert got["far"]["n_applied"] == 0 and got["far"]["protein"] == got["far"]["personal"]
    assert got["t1"]["protein"] != got["t1"]["personal"]
